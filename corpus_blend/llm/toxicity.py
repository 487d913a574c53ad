"""Toxicity scores of whole texts from subword embeddings and a linear softmax.

A word is the bag of its character n-grams and itself, each with a vector of its own (hashed into a
fixed number of buckets); a word's vector is their mean, a text's vector the mean of its words, and
a linear softmax turns that into the probability of a label. Vectors and softmax are trained
jointly in numpy on a bounded sample of labelled rows. A misspelling that was never seen shares
most of its n-grams, hence of its vector, with the word it comes from.

One insult in a thousand words would drown in the mean of them all. So the mean is taken over
windows of words, and a text is as toxic as the worst of its windows, in training as in scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_blend.llm.common import id_and_text, text_slices

#: Text that a task scores at once.
SLICE_BYTES = 4 << 20
#: Words whose n-grams are worked out together: each character takes some hundred bytes meanwhile.
WORDS_AT_ONCE = 16_384
#: Stripped from both ends of a word.
MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


@dataclass(frozen=True)
class Settings:
    """The model's size, and the bounds of the sample it is trained on.

    ``max_rows`` rows at most, half of them of either label if there are so many, none with a text
    of over ``max_chars`` characters. Scores always use whole texts.
    """

    max_rows: int = 8000
    max_chars: int = 4000
    buckets: int = 1 << 18
    dim: int = 8
    shortest: int = 4
    longest: int = 6
    window: int = 6
    padding: int = 3
    epochs: int = 14
    batch: int = 400
    rate: float = 0.05
    scale: float = 10.0
    spread: float = 0.01
    seed: int = 7


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_spans(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (lower case, outer marks stripped), each word's number, where each text ends."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()))
    words = pc.ascii_split_whitespace(lower)
    places = np.asarray(words.offsets)
    coded = words.values[places[0] : places[-1]].dictionary_encode()
    stripped = pc.utf8_trim(coded.dictionary, MARKS).dictionary_encode()
    distinct = stripped.dictionary.to_pylist()
    number = np.asarray(stripped.indices, np.int64)[np.asarray(coded.indices, np.int64)]
    ends = places[1:] - places[0]
    if "" in distinct:  # white space at an end, or marks alone
        empty = distinct.index("")
        real = number != empty
        ends = np.r_[0, np.cumsum(real)][ends]
        number = number[real]
        number -= number > empty
        del distinct[empty]
    # Of a word that follows itself one is enough: a text that repeats a word has no rarer ones.
    fresh = np.r_[True, number[1:] != number[:-1]][: len(number)]
    fresh[(starts := np.r_[0, ends[:-1]])[starts < len(number)]] = True
    return distinct, number[fresh], np.r_[0, np.cumsum(fresh)][ends]


def subwords(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' n-grams and of the words themselves, and where each word's begin."""
    parts = [_some_subwords(words[i : i + WORDS_AT_ONCE], settings) for i in range(0, len(words), WORDS_AT_ONCE)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    shift = np.cumsum([0, *(len(found) for found, _ in parts[:-1])])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + n for p, n in zip(parts, shift, strict=True)])


def _some_subwords(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    marked = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(marked.encode("utf-32-le"), "<u4").astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(words)), length)
    left = np.repeat(begin + length, length) - np.arange(len(points))  # characters up to the end
    prime = np.uint64(0x9E3779B97F4A7C15)
    spread = points * prime ^ points >> np.uint64(7)
    state, buckets, owners = np.zeros(len(points), np.uint64), [], []
    for n in range(1, settings.longest + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        state = (state[:m] ^ spread[n - 1 :][:m]) * prime
        state ^= state >> np.uint64(29)
        if n >= settings.shortest:
            inside = np.flatnonzero(left[:m] >= n)
            buckets.append(state[inside] + np.uint64(n))
            owners.append(owner[inside])
    # The word itself: a polynomial over its places, of whatever length.
    powers = np.cumprod(np.full(int(length.max(initial=1)), prime))
    place = np.arange(len(points)) - np.repeat(begin, length)
    whole = np.add.reduceat(spread * powers[place], begin) if len(words) else np.zeros(0, np.uint64)
    buckets.append(whole * prime)
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    hashes = np.concatenate(buckets)[order]
    shift = np.uint64(64 - int(settings.buckets).bit_length() + 1)
    found = ((hashes ^ hashes >> np.uint64(31)) * prime >> shift).astype(np.int32)
    return found, np.searchsorted(owner[order], np.arange(len(words)))


def windows(ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each window, and where each text's windows begin; every text has one at
    least. A last window of less than half the size is joined to the one before it."""
    starts = np.r_[0, ends[:-1]]
    n = np.maximum(1, (ends - starts + size // 2) // size)
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    begin = np.repeat(starts, n) + place * size
    end = np.where(place + 1 == np.repeat(n, n), np.repeat(ends, n), begin + size)
    return begin, end, first


class Model:
    """Trained vectors; for scoring, what each bucket adds to the log odds is all that is left."""

    def __init__(self, settings: Settings, weights: np.ndarray, bias: float):
        self.settings, self.weights, self.bias = settings, weights, bias

    def odds(self, worth: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The log odds of windows, given what each word adds."""
        running = np.r_[0.0, np.cumsum(worth)]
        s = self.settings
        return s.scale * (running[end] - running[begin]) / (end - begin + s.padding) + self.bias

    def worth(self, buckets: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """What each word adds: the mean of its n-grams."""
        if not len(begin):
            return np.zeros(0)
        return np.add.reduceat(self.weights[buckets], begin) / np.diff(np.r_[begin, len(buckets)])

    def score(self, texts: pa.Array) -> np.ndarray:
        """The probability of label 1 of every whole text."""
        if not len(texts):
            return np.zeros(0)
        words, number, ends = word_spans(texts)
        steps = range(0, len(words), WORDS_AT_ONCE)
        parts = [self.worth(*subwords(words[i : i + WORDS_AT_ONCE], self.settings)) for i in steps]
        worth = np.concatenate([np.zeros(0), *parts])[number]
        begin, end, first = windows(ends, self.settings.window)
        odds = np.maximum.reduceat(self.odds(worth, begin, end), first)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def train(texts: pa.Array, labels: np.ndarray, settings: Settings) -> Model:
    """Train vectors and softmax by Adam on the log loss of ``labels`` (0 or 1).

    In each epoch a text is represented by its worst window so far and by one at random, the
    latter only if its label is 0: every window of such a text is clean.
    """
    s, rng = settings, np.random.default_rng(settings.seed)
    if not len(labels):
        return Model(s, np.zeros(s.buckets), 0.0)
    words, number, ends = word_spans(texts)
    buckets, first_gram = subwords(words, s)
    grams = np.diff(np.r_[first_gram, len(buckets)])
    begin, end, first = windows(ends, s.window)
    n_windows = np.diff(np.r_[first, len(begin)])
    table = rng.normal(0, s.spread, (s.buckets, s.dim)).astype(np.float32)
    out = rng.normal(0, 1, (s.dim + 1, 2)).astype(np.float32)  # the last row is the bias
    out[-1] = 0
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (table, out)]
    model, step = Model(s, np.zeros(s.buckets), 0.0), 0
    for epoch in range(s.epochs):
        odds = model.odds(model.worth(buckets, first_gram)[number], begin, end)
        odds += rng.random(len(odds)) * (1.0 if epoch == 0 else 1e-6)
        ranked = np.lexsort((-odds, np.repeat(np.arange(len(first)), n_windows)))
        clean = np.flatnonzero(labels == 0)
        drawn = first[clean] + rng.integers(0, n_windows[clean])
        rows = np.r_[ranked[first], drawn]
        target = np.r_[labels, np.zeros(len(clean), int)]
        order = rng.permutation(len(rows))
        for at in range(0, len(order), s.batch):
            chosen = order[at : at + s.batch]
            start, n = begin[rows[chosen]], (end - begin)[rows[chosen]]
            used, which = np.unique(number[_ranges(start, n)], return_inverse=True)
            size = grams[used]
            found = buckets[_ranges(first_gram[used], size)]
            share = np.repeat(1 / size.astype(np.float32), size)[:, None]
            # mean of n-grams, mean of words, softmax
            vectors = _sums(np.cumsum(size) - size, table[found] * share)
            per_word = (s.scale / (n + s.padding)).astype(np.float32)
            text = np.zeros((len(chosen), s.dim + 1), np.float32)
            filled = n > 0
            text[filled, :-1] = _sums((np.cumsum(n) - n)[filled], vectors[which]) * per_word[filled, None]
            text[:, -1] = 1
            logits = text @ out
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(chosen)), target[chosen]] -= 1
            slope = (chance / len(chosen)).astype(np.float32)
            # and back
            to_text = (slope @ out[:-1].T) * per_word[:, None]
            to_word = _spread(which, np.repeat(to_text, n, axis=0), len(used))
            to_table = _spread(found, np.repeat(to_word, size, axis=0) * share, s.buckets)
            step += 1
            for x, grad, (m, v) in zip((table, out), (to_table, text.T @ slope), moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                x -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        toward = out[:, 1] - out[:, 0]
        model = Model(s, (table @ toward[:-1]).astype(np.float64), float(toward[-1]))
    return model


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _sums(begin: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of runs of rows."""
    return np.add.reduceat(rows, begin, axis=0) if len(begin) else np.zeros((0, rows.shape[1]), rows.dtype)


def _spread(owner: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of each owner."""
    return np.stack([np.bincount(owner, c, n) for c in rows.T], axis=1).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings, id_col="doc_id", text_col="text", label_col="toxic"):
    """The rows to learn from: ``id, text, label``, chosen by a hash of the id.

    Ids held out, null ids, labels but 0 and 1 and ids with both labels are left out. Only the
    chosen ids are broadcast, of which there are about ``max_rows``.
    """
    known = (
        labels.where(~held_out(id_col) & F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull())
        .groupBy(F.col(f"`{id_col}`").cast("bigint").alias("id"))
        .agg(F.min(f"`{label_col}`").cast("int").alias("label"), F.max(f"`{label_col}`").cast("int").alias("other"))
        .where("label = other")
        .select("id", "label")
    )
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    most = {k: min(n, max(settings.max_rows // 2, settings.max_rows - sizes.get(1 - k, 0))) for k, n in sizes.items()}
    share = {k: most[k] / sizes[k] for k in sizes}
    draw = F.pmod(F.xxhash64("id", F.lit(settings.seed)), F.lit(1 << 30)) / float(1 << 30)
    part = F.when(F.col("label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    chosen = known.where(draw < part)
    texts = id_and_text(docs.where(F.length(f"`{text_col}`") <= settings.max_chars), id_col, text_col)
    known = texts.join(F.broadcast(chosen), "id")
    # An id may be repeated without end; each counts once, by the least of its texts.
    return known.groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, **columns) -> Model:
    """Train on a sample of ``docs`` with known ``labels``; without any, every score is one half."""
    settings = settings or Settings()
    rows = labelled_sample(docs, labels, settings, **columns).toArrow()
    rows = rows.sort_by([("id", "ascending"), ("text", "ascending")]).slice(0, 2 * settings.max_rows)
    return train(rows.column("text").combine_chunks(), rows.column("label").to_numpy(), settings)


def reject(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` with a score below ``threshold``, whole; scores as in ``score``."""
    shared = df.sparkSession.sparkContext.broadcast((model.settings, model.weights.astype(np.float32), model.bias))

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            for part in text_slices(batch, text_col, SLICE_BYTES):
                texts = part.column(text_col).fill_null("")
                yield part.filter(pa.array(own.score(texts) < threshold))

    return df.mapInArrow(run, df.schema)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row; a null text is empty, and a text without words has the score of
    the model's bias alone. No rows give no rows; repeated rows have equal scores."""
    shared = df.sparkSession.sparkContext.broadcast((model.settings, model.weights.astype(np.float32), model.bias))

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            for part in text_slices(batch, most_bytes=SLICE_BYTES):
                found = own.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found)], names=["id", "score"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "id bigint, score double")
