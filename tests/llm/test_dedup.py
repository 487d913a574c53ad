"""Exact dedup, SimHash, line dedup and components against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from frames import ROWS, documents, empty

from corpus_blend.llm import exact_dedup, line_dedup, simhash
from corpus_blend.llm.components import connected_components, local_roots


def components(nodes, links):
    """The smallest node of each node's component."""
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


# --- components -----------------------------------------------------------------------


def test_components_of_random_links(spark):
    rng = random.Random(5)
    links = [(a, a + 1) for a in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)]
    links += [(500, i) for i in range(501, 700)] + [(900, 900)]
    want = components({x for link in links for x in link if len(set(link)) > 1}, [x for x in links if x[0] != x[1]])
    got = connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_no_links_have_no_components(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_local_roots_extend():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    want = components(range(400), list(zip(a.tolist(), b.tolist(), strict=True)))
    roots = local_roots(400, a[:150], b[:150])
    assert local_roots(400, a[150:], b[150:], roots).tolist() == [want[i] for i in range(400)]


# --- exact ------------------------------------------------------------------------------


def exact_model(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    groups = {}
    for (i, *_), t in zip(rows, norm, strict=True):
        groups.setdefault(t, []).append(i)
    out = []
    for (i, *_), t in zip(rows, norm, strict=True):
        known = [x for x in groups[t] if x is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [True, False])
def test_exact_dedup(spark, digest):
    rows = [*ROWS, (21, "x" * 300 + "1", "en", "a", 1), (20, "x" * 300 + "2", "en", "a", 1), (19, "x" * 300 + "1", "en", "a", 1)]
    got = exact_dedup.exact_dedup(documents(spark, rows), digest=digest)
    assert got.columns == ["id", "keep_id", "group_size", "kept"] + ["sha256"] * digest
    want = exact_model(rows)
    if not digest:
        want = sorted((w[:-1] for w in want), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


# --- SimHash ----------------------------------------------------------------------------


def simhash_model(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def unsigned(x):
    return x % (1 << 64)


def test_fingerprints(spark):
    got = simhash.fingerprints(documents(spark)).collect()
    want = sorted(((r[0], simhash_model(r[1])) for r in ROWS), key=str)
    assert sorted(((r.id, unsigned(r.fingerprint)) for r in got), key=str) == want


def test_simhash_dedup_of_edge_rows(spark):
    got = simhash.simhash_dedup(documents(spark)).collect()
    assert len(got) == len(ROWS)
    by_id = {r.id: r.component for r in got}
    assert by_id[2] == 1 and by_id[4] == by_id[5] == 3 and by_id[7] == 6 and by_id[9] == 9
    assert simhash.simhash_dedup(empty(spark)).count() == 0


def around(rng, centre, n, flips):
    for _ in range(n):
        code = centre
        for bit in rng.sample(range(64), rng.randint(0, flips)):
            code ^= 1 << bit
        yield code


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("block", [4096, 16])
def test_links_like_all_pairs(spark, block):
    """Many fingerprints around few centres: chains, ties and keys that many share."""
    rng = random.Random(1)
    codes = [0, 0, (1 << 64) - 1, (1 << 64) - 1]
    for size in (60, 30, 5, 5, 2, 2, 1):
        codes += around(rng, rng.getrandbits(64), size, 6)
    rng.shuffle(codes)
    rows = [(i, signed(c)) for i, c in enumerate(codes)]
    links = [(i, j) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 4]
    want = components(range(len(codes)), links)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "id bigint, fingerprint bigint"), block=block).collect()
    assert {r.id: r.component for r in got} == want


@pytest.mark.parametrize("n", [100, 1 << 26, 1 << 40])
def test_every_pair_within_distance_shares_a_key(n):
    masks = simhash.key_masks(n)
    rng = random.Random(2)
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & m == 0 for m in masks)


def test_gray_order_index_finds_all_pairs():
    rng = random.Random(4)
    codes = np.array(sorted({c for _ in range(20) for c in around(rng, rng.getrandbits(64), 25, 5)}), np.uint64)
    group = np.sort(np.array([rng.randrange(3) for _ in codes]))
    order = np.lexsort((simhash.gray_rank(codes), group))
    codes, group = codes[order], group[order]
    found = {p for a, b in simhash.close_pairs(codes, group, 4) for p in zip(a.tolist(), b.tolist(), strict=True)}
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 4
    want = {(i, j) for i, j in zip(*np.nonzero(near & (group[:, None] == group))) if i < j}
    assert found == want


# --- lines ------------------------------------------------------------------------------


def line_model(rows, min_words):
    """Every run of every length, by its text; a run that starts earlier somewhere else goes."""
    texts = sorted({(float("inf") if i is None else i, xxhash.xxh64_intdigest((t or "").encode(), 42), t) for i, t, *_ in rows if t},
                   key=lambda x: (x[0], x[1] - (1 << 64) if x[1] >> 63 else x[1]))
    seen, gone = set(), {}
    for i, h, text in texts:
        lines = [(no, x.strip(" \t\r\x0b\x0c")) for no, x in enumerate(text.split("\n"))]
        lines = [(no, x) for no, x in lines if x]
        for s in range(len(lines)):
            words = 0
            for e in range(s, len(lines)):
                words += len(lines[e][1].split())
                if words >= min_words:
                    run = tuple(x for _, x in lines[s : e + 1])
                    if run in seen:
                        gone.setdefault((i, text), set()).update(no for no, _ in lines[s : e + 1])
                    seen.add(run)
        drop = gone.get((i, text), set())
        for (a, _), (b, _) in zip(lines, lines[1:]):
            if a in drop and b in drop:  # blank lines between
                drop.update(range(a, b))
    out = []
    for i, t, *_ in rows:
        drop = gone.get((float("inf") if i is None else i, t), set())
        out.append((i, t and "\n".join(x for no, x in enumerate(t.split("\n")) if no not in drop), len(drop)))
    return sorted(out, key=str)


def random_documents(seed, n):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(7)]
    out = []
    for i in range(n):
        text = "\n".join(rng.choice([*lines, "", "  ", f"own line {i}"]) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(0, 14)))
        out.append((rng.choice([i, i, i, None]), text, "en", "a", 1))
    return out + [out[0], out[1]]


@pytest.mark.parametrize(("seed", "min_words"), [(0, 4), (1, 9)])
def test_line_dedup_like_all_runs(spark, seed, min_words):
    rows = random_documents(seed, 40)
    got = line_dedup.line_dedup(documents(spark, rows), min_words=min_words, removed_col="n_gone")
    assert got.columns == [*documents(spark, rows).columns, "n_gone"]
    found = sorted(((r.doc_id, r.text, r.n_gone) for r in got.collect()), key=str)
    assert found == line_model(rows, min_words)


def test_line_dedup_keeps_columns_of_any_name(spark):
    text = "\n".join(f"words of line {i}" for i in range(20))
    rows = spark.createDataFrame([(1, text, "a", 5, "s"), (2, text, "b", 6, "t")], "doc_id long, text string, __doc string, __VERSION int, __spans string")
    got = sorted(line_dedup.line_dedup(rows, removed_col="n_gone").collect())
    assert [tuple(r) for r in got] == [(1, text, "a", 5, "s", 0), (2, "", "b", 6, "t", 20)]
    assert line_dedup.line_dedup(rows).columns == rows.columns


def test_line_dedup_of_edge_rows(spark):
    got = line_dedup.line_dedup(documents(spark)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((r[0], r[1]) for r in ROWS), key=str)
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_a_planted_passage_goes_from_later_documents(spark):
    passage = "\n".join(" ".join(f"p{i}w{j}" for j in range(20)) for i in range(4))
    rows = [(i, f"begin {i}\n{passage}\n\nend {i}", "en", "a", 1) for i in (3, 1, 2)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(documents(spark, rows)).collect()}
    assert got == {1: rows[1][1], 2: "begin 2\n\nend 2", 3: "begin 3\n\nend 3"}


def test_as_many_spans_as_lines(spark):
    n = 50_000
    first = "\n".join(f"u{i} v{i}" for i in range(n))
    mixed = "\n".join(f"u{i} v{i}\nown{i}" for i in range(n))
    rows = [(1, first, "en", "a", 1), (2, mixed, "en", "a", 1)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(documents(spark, rows), min_words=2, removed_col="n_gone").collect()}
    # "own0 u1 v1" and the like are runs of enough words too, but are no repeats
    assert got[2].text == "\n".join(f"own{i}" for i in range(n)) and got[2].n_gone == n
    assert got[1].text == first
