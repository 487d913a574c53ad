"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are made from every shingle of a text. Different fingerprints then meet by the
pigeonhole rule: of ``distance + agree`` bit blocks, ``agree`` at least are equal in two fingerprints
that differ in ``distance`` bits, so every choice of ``agree`` blocks is a key. Within a key the
fingerprints are sorted by Gray rank, which puts similar bit patterns next to each other, and a
tree is built over that order. A node holds the bits that all fingerprints below it share and that
its parent does not already hold. A search adds up, node by node, the bits in which it differs and
drops a whole group as soon as the sum exceeds the distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_blend.llm.common import id_and_text, stage, text_slices
from corpus_blend.llm.components import connected_components, local_roots

WORDS = 4
DISTANCE = 4
SEED = 42
#: Fingerprints of one key that a search meets at once; more are searched block against block.
BLOCK = 4096
#: How many fingerprints a key should have on average; more blocks must agree if it has more.
PER_KEY = 4096
FANOUT = 8
#: Pairs of a fingerprint and a node that a search holds at once.
FRONTIER = 1 << 20


def fingerprints(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    seed: int = SEED,
    marked: bool = False,
) -> DataFrame:
    """``id, fingerprint`` (64 bits as a bigint) of every row; if ``marked`` with a hash of its text.

    Words are what lies between blanks after lower-casing A-Z; a shingle is ``words`` of them, and
    its XXH64 counts as often as it occurs. A bit is 1 if it is set in over half of the hashes.
    A text of fewer words is one shingle; a text without words, or a null, has fingerprint 0.
    """

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text").cast(pa.binary())
                found = np.fromiter((simhash(t.as_py(), words, seed) for t in texts), np.uint64, len(texts))
                others = [part.column(c) for c in names[:-1]]
                yield pa.RecordBatch.from_arrays([*others, pa.array(found.view(np.int64))], names=names)

    rows, names = id_and_text(df, id_col, text_col), ["id", "fingerprint"]
    if marked:
        rows, names = rows.withColumn("mark", F.xxhash64("text")), ["id", "mark", "fingerprint"]
    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def simhash(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of one UTF-8 text."""
    return majority(shingle_hashes(text, words, seed))


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED):
    """The hashes of a text's shingles in order, some at a time."""
    parts = text.lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    last = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    digest, step = xxhash.xxh64_intdigest, 1 << 16
    for at in range(0, n, step):
        spans = zip(first[at : min(n, at + step)].tolist(), last[at : at + step].tolist(), strict=True)
        yield np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)


def majority(parts) -> int:
    """The bits that are set in over half of these arrays' hashes."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        total += _bit_counts(hashes)
        n += len(hashes)
    return int(sum(1 << i for i in np.flatnonzero(2 * total > n).tolist()))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def near_duplicates(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``component`` next to every row of ``prints (id, fingerprint)`` and its other columns.

    Fingerprints are linked at ``distance`` or fewer differing bits, and a component is the smallest
    id that links can reach. All links count, however many fingerprints share a key. A row with a
    null id takes part by its fingerprint; a component without any other id has component null.
    """
    prints = stage(prints, "fingerprints")
    # A fingerprint is its own node, so that one held only by rows with a null id joins others too.
    distinct = stage(
        prints.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("id").alias("smallest")), "distinct-prints"
    )
    links = close_links(distinct.select("fingerprint", F.col("fingerprint").alias("first")), distance, block)
    parts = connected_components(links)
    named = distinct.join(parts, distinct["fingerprint"] == parts["node"], "left").select(
        "fingerprint", "smallest", F.coalesce("component", "fingerprint").alias("part")
    )
    smallest = named.groupBy("part").agg(F.min("smallest").alias("component"))
    roots = named.join(smallest, "part").select("fingerprint", "component")
    return prints.join(roots, "fingerprint", "left").select(*prints.columns, "component")


def key_masks(n: int, distance: int = DISTANCE, per_key: int = PER_KEY) -> list[int]:
    """The bits that must agree, one mask per key: the fewest keys that leave ``per_key`` of ``n``
    evenly spread fingerprints to a key (seven blocks of which three agree is as far as it goes up)."""
    found = []
    for agree in (1, 2, 3):
        blocks = distance + agree
        edges = np.linspace(0, 64, blocks + 1).round().astype(int)
        pieces = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        found = [sum(chosen) for chosen in combinations(pieces, agree)]
        if n >> min(m.bit_count() for m in found) <= per_key:
            break
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_links(distinct: DataFrame, distance: int, block: int) -> DataFrame:
    """Links that connect what lies within ``distance``: a forest of each searched group."""
    n = distinct.count()
    masks = key_masks(n, distance)
    keyed = distinct.select(
        "fingerprint",
        "first",
        F.posexplode(F.array(*(F.col("fingerprint").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("choice", "key"),
    )
    # A crowded key is cut into blocks, each a cell, and every two blocks meet in a cell of their own.
    crowded = (
        keyed.groupBy("choice", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > block)
        .select("choice", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    crowded = stage(crowded, "crowded-keys")
    own = F.pmod(F.xxhash64("fingerprint", "choice"), F.coalesce("blocks", F.lit(1))).cast("int")
    placed = keyed.join(crowded, ["choice", "key"], "left").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    celled = placed.withColumn("other", other).select(
        "choice",
        "key",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        "fingerprint",
        "first",
    )
    cell = ["choice", "key", "low", "high"]
    sorted_cells = celled.repartition(*cell).sortWithinPartitions(*cell)

    def run(batches):
        yield from _search_cells(batches, distance)

    return sorted_cells.mapInArrow(run, "a bigint, b bigint")


def _search_cells(batches, distance: int, most: int = 1 << 16):
    """Search whole cells in batches of some; a cell is never cut, and has two blocks at most."""
    names = ("choice", "key", "low", "high", "fingerprint", "first")
    waiting = [np.zeros(0, np.int64)] * len(names)
    for batch in batches:
        columns = [np.concatenate((w, batch.column(c).to_numpy().astype(np.int64))) for w, c in zip(waiting, names, strict=True)]
        last = _starts(columns[:4])[-1] if len(columns[0]) else 0
        if last and len(columns[0]) >= most:
            yield from _search([c[:last] for c in columns], distance)
            columns = [c[last:] for c in columns]
        waiting = columns
    if len(waiting[0]):
        yield from _search(waiting, distance)


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    """Where a new combination of keys begins in sorted rows."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _search(columns: list[np.ndarray], distance: int):
    *cell, prints, first = columns
    codes = prints.view(np.uint64)
    group = np.zeros(len(codes), np.int64)
    group[_starts(cell)[1:]] = 1
    group = np.cumsum(group)
    order = np.lexsort((gray_rank(codes), group))
    codes, first, group = codes[order], first[order], group[order]
    roots = np.arange(len(codes))
    for a, b in close_pairs(codes, group, distance):
        roots = local_roots(len(codes), a, b, roots)
    linked = np.flatnonzero(roots != np.arange(len(codes)))
    yield pa.RecordBatch.from_arrays([pa.array(first[linked]), pa.array(first[roots[linked]])], names=["a", "b"])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in the binary reflected Gray code."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def build_index(codes: np.ndarray, group: np.ndarray, fanout: int = FANOUT) -> list[dict]:
    """Levels of nodes over codes sorted by group and Gray rank, one top node per group.

    A node has ``stop``, the end of its rows, ``child``, where its children (at the lowest level:
    its rows) begin, ``mask``, the bits all its rows share and its parent does not hold, and
    ``bits``, their values.
    """
    levels = []
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    child_group, child_stop, ones, zeros = group, np.arange(1, len(codes) + 1), codes, ~codes
    while True:
        starts = np.flatnonzero(np.r_[True, child_group[1:] != child_group[:-1]])
        place = np.arange(len(child_group)) - np.repeat(starts, np.diff(np.r_[starts, len(child_group)]))
        child = np.flatnonzero(place % fanout == 0)
        ones, zeros = np.bitwise_and.reduceat(ones, child), np.bitwise_and.reduceat(zeros, child)
        level = {
            "child": child,
            "end": np.r_[child[1:], len(child_group)],
            "stop": child_stop[np.r_[child[1:], len(child_group)] - 1],
            "mask": ones | zeros,
            "bits": ones,
        }
        levels.append(level)
        child_group, child_stop = child_group[child], level["stop"]
        if len(child_group) == len(starts):
            break
    for upper, lower in zip(levels[1:], levels[:-1], strict=True):  # keep what the parent lacks
        above = np.repeat(upper["mask"], upper["end"] - upper["child"])
        lower["own"] = lower["mask"] & (above ^ full)
    levels[-1]["own"] = levels[-1]["mask"]
    return levels[::-1]


def close_pairs(codes: np.ndarray, group: np.ndarray, distance: int):
    """Batches of ``(i, j)``, i < j, of one group and within ``distance``; codes sorted as above."""
    if not len(codes):
        return
    levels = build_index(codes, group)
    top_of = group - group[0]
    sizes = np.bincount(top_of)[top_of]
    cuts = np.cumsum(sizes) // FRONTIER  # as many searches at once as could meet so many rows
    for part in np.split(np.arange(len(codes)), np.flatnonzero(np.diff(cuts)) + 1):
        query, node, apart = part, top_of[part], np.zeros(len(part), np.int64)
        for depth, level in enumerate(levels):
            apart = apart + np.bitwise_count((codes[query] ^ level["bits"][node]) & level["own"][node])
            near = (apart <= distance) & (level["stop"][node] > query + 1)
            query, node, apart = query[near], node[near], apart[near]
            width = level["end"][node] - level["child"][node]
            within = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            below = np.repeat(level["child"][node], width) + within
            query, node, apart = np.repeat(query, width), below, np.repeat(apart, width)
            if depth == len(levels) - 1:
                later = node > query
                query, node = query[later], node[later]
                close = np.bitwise_count(codes[query] ^ codes[node]) <= distance
                yield query[close], node[close]


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id, fingerprint, component`` of every row of ``df``; see the two steps above.

    No rows give no rows. Rows of equal text, repeated rows among them, have one component. Other
    columns are not looked at.
    """
    return near_duplicates(fingerprints(df, id_col, text_col), **options)


def drop_near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE
) -> DataFrame:
    """The rows of ``df``, with all its columns, that no row with a smaller id is linked to.

    Of each component the document with the smallest id stays. A row goes by its id and its text, so
    one that repeats an id with quite another text stays; a repeated row stays or goes as a whole.
    A row without an id goes if its component has any id, else all of the component stay. No rows give
    no rows.
    """
    prints = fingerprints(df, id_col, text_col, words, marked=True)
    found = near_duplicates(prints, distance)
    later = found.where(F.col("component").isNotNull() & ~F.col("id").eqNullSafe(F.col("component")))
    gone = stage(later.select(F.col("id").alias("_gone_id"), F.col("mark").alias("_gone_mark")).distinct(), "gone")
    own_id, own_text = F.col(f"`{id_col}`").cast("bigint"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    same = own_id.eqNullSafe(F.col("_gone_id")) & (F.xxhash64(own_text) == F.col("_gone_mark"))
    return df.join(gone, same, "left_anti")
