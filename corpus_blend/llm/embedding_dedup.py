"""Near-duplicate embeddings by an inverted file with product quantisation.

Vectors of length one are dealt to coarse lists by their nearest centroid; what is left after the
centroid (the residual) is split into subspaces, and each part is stored as the number of its
nearest codeword. A search looks up, per subspace, the product of its vector with every codeword,
so that the product with a stored vector is a sum of table entries (asymmetric distances). As the
stored vector lies no further from its reconstruction than its recorded error, whatever could reach
the threshold is known for certain; only that is compared exactly.

Lists are searched as far as the geometry asks for it. If ``x`` and ``y`` are at most ``gap`` apart
and ``y`` is nearest to centroid ``c``, then for every other centroid ``b`` the distance by which
``x`` lies on ``b``'s side of the plane halfway between ``b`` and ``c`` is at most ``gap``. With the
gap of the threshold (``margin=None``) no link is lost; a smaller margin searches fewer lists.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_blend.llm.common import stage
from corpus_blend.llm.components import connected_components, local_roots


@dataclass(frozen=True)
class Settings:
    """``sample`` vectors at most are used to place centroids and codewords; all are indexed."""

    threshold: float = 0.9
    margin: float | None = None
    sample: int = 20_000
    lists: int | None = None
    most_lists: int = 4096
    subspaces: int = 8
    codewords: int = 256
    rounds: int = 8
    block: int = 2048
    seed: int = 11


@dataclass(frozen=True)
class Quantizer:
    """Centroids of length one, codewords of residuals by subspace, and the subspaces' edges."""

    centroids: np.ndarray
    codewords: list[np.ndarray]
    edges: np.ndarray

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and error of each vector; the error bounds its distance to what is stored."""
        lists = np.argmax(x @ self.centroids.T, axis=1)
        rest = x - self.centroids[lists]
        codes = np.empty((len(x), len(self.codewords)), np.uint8)
        for m, words in enumerate(self.codewords):
            part = rest[:, self.edges[m] : self.edges[m + 1]]
            codes[:, m] = np.argmin((words**2).sum(axis=1) - 2 * part @ words.T, axis=1)
            rest[:, self.edges[m] : self.edges[m + 1]] -= words[codes[:, m]]
        return lists, codes, np.linalg.norm(rest, axis=1) + 1e-6

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """Per subspace, the product of every vector with every codeword."""
        return [x[:, a:b] @ w.T for a, b, w in zip(self.edges[:-1], self.edges[1:], self.codewords, strict=True)]

    def probes(self, x: np.ndarray, margin: float) -> np.ndarray:
        """Which lists to search for each vector: by its distance to the planes halfway."""
        near = x @ self.centroids.T
        own = np.argmax(near, axis=1)
        apart = self.centroids @ self.centroids.T
        between = np.sqrt(np.maximum(2 - 2 * apart[own], 1e-12))
        return (near[np.arange(len(x)), own][:, None] - near) / between <= margin + 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool = False) -> np.ndarray:
    """Lloyd's rounds; an empty cluster starts anew at a random vector."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        size = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, c, k) for c in x.T], axis=1)
        centres = sums / np.maximum(size, 1)[:, None]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        centres[size == 0] = x[rng.integers(0, len(x), int((size == 0).sum()))]
    return centres


def train(x: np.ndarray, lists: int, settings: Settings) -> Quantizer:
    rng = np.random.default_rng(settings.seed)
    centroids = kmeans(x, lists, settings.rounds, rng, unit=True)
    rest = x - centroids[np.argmax(x @ centroids.T, axis=1)]
    edges = np.linspace(0, x.shape[1], min(settings.subspaces, x.shape[1]) + 1).round().astype(int)
    k = min(settings.codewords, 256)
    words = [kmeans(rest[:, a:b], k, settings.rounds, rng) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return Quantizer(centroids, words, edges)


def embedding_dedup(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings | None = None
) -> DataFrame:
    """``id, n_links, component, kept`` of every row of ``df``.

    Vectors are linked if their cosine (of the stored numbers, in double precision) is at least the
    threshold. ``n_links`` counts the other rows linked directly, equal vectors among them, and
    ``component`` is the smallest id that links can reach. Vectors that are null, empty, zero, or
    hold a null or a number that is not finite, link with nothing. Vectors of different lengths have
    no cosine, so each length that occurs is trained and searched by itself. A null id links like any other but is no component. Rows that
    repeat an id have a line each, with equal numbers. No rows give no rows.
    """
    settings = settings or Settings()
    raw = df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    )
    usable = F.coalesce(
        (F.size("v") > 0)
        & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
        & F.exists("v", lambda e: e != 0.0),
        F.lit(False),
    )
    rows = stage(raw.withColumn("usable", usable).withColumn("key", F.sha2(F.to_json("v"), 256)), "vectors")
    good = F.col("usable")
    # one number per length that occurs
    sizes = [r["dim"] for r in rows.where(good).select(F.size("v").alias("dim")).distinct().orderBy("dim").collect()]
    # Equal vectors are searched once: a group of copies is one vector with a weight.
    distinct = stage(
        rows.where(good)
        .groupBy("key")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v"))
        .withColumn("node", F.monotonically_increasing_id()),  # fixed once it is written
        "distinct-vectors",
    )
    found = [_search(distinct.where(F.size("v") == dim), settings) for dim in sizes or [1]]
    links = stage(reduce(DataFrame.unionByName, found), "vector-links")
    # A line of the search is a count (b is null) or a link of the forest.
    counts = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = connected_components(links.where("b is not null").select("a", "b"))
    named = distinct.join(parts, "node", "left").select(
        "key", "node", "first", "copies", F.coalesce("component", "node").alias("part")
    )
    smallest = named.groupBy("part").agg(F.min("first").alias("component"))
    by_key = (
        named.join(smallest, "part").join(counts, "node", "left")
        .select("key", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    known = rows.select("id", F.when(good, F.col("key")).alias("key"))
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return known.join(by_key, "key", "left").select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    x = values.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _search(distinct: DataFrame, settings: Settings) -> DataFrame:
    """``a, b, n``: with null ``b`` that ``a`` has ``n`` linked rows more, else a link."""
    n = distinct.count()
    spark = distinct.sparkSession
    if n == 0:
        return spark.createDataFrame([], "a bigint, b bigint, n bigint")
    share = min(1.0, settings.sample / n)
    drawn = distinct.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("node", "v")
    sample = drawn.limit(settings.sample).toArrow().sort_by("node")
    lists = settings.lists or int(np.clip(np.sqrt(n) / 2, 1, settings.most_lists))
    quantizer = train(_matrix(sample.column("v").combine_chunks()), lists, settings)
    shared = spark.sparkContext.broadcast(quantizer)
    exact = float(np.sqrt(max(0.0, 2 - 2 * settings.threshold)))
    margin = exact if settings.margin is None else min(exact, settings.margin)

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            own, codes, error = shared.value.assign(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    batch.column("copies"),
                    pa.array(own.astype(np.int32)),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(error),
                    pa.array([v.tobytes() for v in x], pa.binary()),
                ],
                names=["node", "copies", "list", "codes", "error", "x"],
            )

    index = stage(
        distinct.select("node", "copies", "v").mapInArrow(
            assign, "node bigint, copies bigint, list int, codes binary, error double, x binary"
        ),
        "vector-index",
    )

    def probe(batches):
        for batch in batches:
            x = np.stack([np.frombuffer(v.as_buffer()) for v in batch.column("x")]) if batch.num_rows else np.zeros((0, 1))
            for at in range(0, len(x), 1024):
                part = batch.slice(at, 1024)
                wanted = shared.value.probes(x[at : at + 1024], margin)
                # Links go both ways: the vector of the lower list searches the higher.
                wanted &= np.arange(wanted.shape[1]) >= np.asarray(part.column("list"))[:, None]
                row, target = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays(
                    [c.take(pa.array(row)) for c in part.columns] + [pa.array(target.astype(np.int32))],
                    names=[*part.schema.names, "target"],
                )

    searches = index.mapInArrow(probe, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in index.schema)}, target int")
    # Crowded lists are cut into blocks, and so are the searches of a list; each two are a cell.
    stored = index.groupBy("list").count()
    asked = searches.groupBy("target").count()
    blocks = stage(
        stored.join(asked, stored.list == asked.target).select(
            "target",
            F.ceil(stored["count"] / settings.block).cast("int").alias("stored"),
            F.ceil(asked["count"] / (4 * settings.block)).cast("int").alias("asked"),
        ),
        "vector-blocks",
    )
    pick = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["node", "copies", "codes", "error", "x"]
    left = searches.join(F.broadcast(blocks), "target").withColumn("row", pick("asked")).withColumn("column", every("stored"))
    right = index.withColumnRenamed("list", "target").join(F.broadcast(blocks), "target")
    right = right.withColumn("column", pick("stored")).withColumn("row", every("asked"))
    cell = ["target", "row", "column"]
    both = left.select(*cell, F.col("list").alias("from"), *columns).unionByName(
        right.select(*cell, F.lit(-1).alias("from"), *columns)
    )
    sorted_cells = both.repartition(*cell).sortWithinPartitions(*cell, "from", "node")

    def search(batches):
        yield from _cells(batches, shared.value, settings.threshold)

    return sorted_cells.mapInArrow(search, "a bigint, b bigint, n bigint")


def _cells(batches, quantizer: Quantizer, threshold: float):
    """One cell after the other; a cell has a block of stored vectors and one of searches."""
    waiting = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if waiting is None else pa.concat_tables([waiting, table])
        keys = [table.column(c).to_numpy() for c in ("target", "row", "column")]
        new = np.zeros(len(table), bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        edges = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield from _cell(table.slice(a, b - a), quantizer, threshold)
        waiting = table.slice(edges[-1])
    if waiting is not None and len(waiting):
        yield from _cell(waiting, quantizer, threshold)


def _cell(table: pa.Table, quantizer: Quantizer, threshold: float):
    origin = table.column("from").to_numpy()
    stored, asking = np.flatnonzero(origin < 0), np.flatnonzero(origin >= 0)
    if not len(stored) or not len(asking):
        return
    own = int(table.column("target")[0].as_py())
    node, copies = (table.column(c).to_numpy() for c in ("node", "copies"))
    x = np.frombuffer(b"".join(table.column("x").to_pylist())).reshape(len(table), -1)
    codes = np.frombuffer(b"".join(table.column("codes").take(stored).to_pylist()), np.uint8).reshape(len(stored), -1)
    least = (threshold - 1e-5 - table.column("error").to_numpy()[stored]).astype(np.float32)
    linked = np.zeros(len(table), np.int64)
    roots = np.arange(len(table))
    for at in range(0, len(asking), 256):
        some = asking[at : at + 256]
        q = x[some]
        sums = np.repeat((q @ quantizer.centroids[own]).astype(np.float32)[:, None], len(stored), axis=1)
        for m, lookup in enumerate(quantizer.tables(q)):
            sums += lookup.astype(np.float32)[:, codes[:, m]]
        i, j = np.nonzero(sums >= least)
        i, j = some[i], stored[j]
        inside = origin[i] == own  # both in this list: each meets the other, so one way is enough
        i, j = i[~inside | (node[i] < node[j])], j[~inside | (node[i] < node[j])]
        for part in range(0, len(i), 1 << 16):  # exact, in double precision
            a, b = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            close = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            a, b = a[close], b[close]
            np.add.at(linked, a, copies[b])
            np.add.at(linked, b, copies[a])
            roots = local_roots(len(table), a, b, roots)
    counted = np.flatnonzero(linked)
    joined = np.flatnonzero(roots != np.arange(len(table)))
    empty = pa.nulls(len(counted), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(node[counted]), empty, pa.array(linked[counted])], names=["a", "b", "n"])
    yield pa.RecordBatch.from_arrays(
        [pa.array(node[joined]), pa.array(node[roots[joined]]), pa.nulls(len(joined), pa.int64())], names=["a", "b", "n"]
    )
