"""Mixing sources row by row, in turn or by weight, with short sources starting over.

Both forms are worked out from the rows' side. A source of n rows that is drawn
from K times uses its row i for the picks i, i + n, i + 2n, ... below K, so rows
are repeated where they lie and no row has to be looked up by a hot key. By
weight, pick k of a source is then matched with the draw it was made in: a join
in which every key occurs once on either side.

Draws come in blocks, one row a block. What a block adds to each source is an array
of counts in its row, and draws are numbered inside their block, from the number of
earlier ones: no draw is exchanged to be counted or numbered.

Only positions are looked at to plan. If the rows of every source are numbered without
gaps, a row's number follows from the table of files, and rows stay where they are
until they are placed. Otherwise positions alone are numbered, picked and placed, and
the rows join what was planned for them, in the one exchange that moves them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpus_blend.functions.keys import FILE, HASH_BITS, POSITION, ROW, SRC, hash_number
from corpus_blend.operators.combine import concatenate
from corpus_blend.operators.places import places_of
from corpus_blend.operators.select import dense_index
from corpus_blend.staging import stage

ALL, FIRST = "all_exhausted", "first_exhausted"
BLOCK = 1 << 13  # draws counted together
BLOCKS_TOGETHER = 1 << 10  # blocks whose counts are added up in one group
CHUNK = 1 << 16  # copies of a row made at once
ROWS_PER_TASK = 1_000_000
DRAWS_PER_TASK = 10_000_000
MOST_TASKS = 50_000


def normalize_weights(weights: Sequence[float], stop: str = ALL) -> list[float]:
    """Weights divided by their sum."""
    weights = [float(w) for w in weights]
    if any(not math.isfinite(w) or w < 0 for w in weights) or not sum(weights) > 0:
        raise ValueError("weights must be at least 0, and one of them above 0")
    if stop == ALL and 0 in weights:
        raise ValueError(f"a source of weight 0 is never exhausted, so {ALL} would not end")
    return [w / sum(weights) for w in weights]


def check_stop(stop: str) -> str:
    if stop not in (ALL, FIRST):
        raise ValueError(f"unknown stopping strategy {stop!r} (use {ALL} or {FIRST})")
    return stop


def interleave(
    frames: Sequence[DataFrame],
    weights: Sequence[float] | None = None,
    seed=42,
    stop: str = ALL,
    max_copies: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Interleaved rows with a new position; ``_from`` and ``_index`` name the row used.

    ``max_copies`` keeps only the first copies of each row, for callers that
    remove repeats anyway.
    """
    frames = list(frames)
    check_stop(stop)
    if weights is not None and len(weights) != len(frames):
        raise ValueError(f"{len(frames)} sources need as many weights, not {len(weights)}")
    rows = concatenate(frames)
    spark = rows.sparkSession
    places = places_of(rows)
    plan = plan_picks(spark, places.counts, weights, seed, stop, block)
    if places.without_gaps and places.packed:
        return pick_rows(places.indexed(places.pack(rows)).drop("_no", "_at"), plan, max_copies)
    planned = place_rows(dense_index(rows.select(*POSITION), POSITION, within=SRC), plan, max_copies)
    return repositioned(rows.join(planned, list(POSITION)), F.col("_place"))


class Picks(NamedTuple):
    """Rows per source, picks per source, and by weight the draw each pick was made in."""

    lengths: dict[int, int]
    counts: dict[int, int]
    draws: DataFrame | None


def plan_picks(
    spark: SparkSession,
    lengths: dict[int, int],
    weights: Sequence[float] | None = None,
    seed=42,
    stop: str = ALL,
    block: int = BLOCK,
) -> Picks:
    check_stop(stop)
    if not lengths:
        return Picks({}, {}, None)
    if weights is None:
        turns = (max if stop == ALL else min)(lengths.values())
        return Picks(lengths, dict.fromkeys(lengths, turns), None)
    shares = normalize_weights([weights[s] for s in sorted(lengths)], stop)
    counts, draws = _draws(spark, lengths, shares, seed, stop, block)
    return Picks(lengths, counts, draws)


def pick_rows(indexed: DataFrame, plan: Picks, max_copies: int | None = None) -> DataFrame:
    """Rows with ``_src`` and ``_index``, repeated, their position that of the mix."""
    return repositioned(place_rows(indexed, plan, max_copies), F.col("_place"))


def place_rows(indexed: DataFrame, plan: Picks, max_copies: int | None = None) -> DataFrame:
    """Rows with ``_src`` and ``_index``, repeated as planned, with their ``_place`` in the mix."""
    drawn = _picked(indexed, plan.lengths, plan.counts, max_copies)
    if plan.draws is not None:
        return drawn.join(plan.draws, [SRC, "_pick"]).drop("_pick")
    rank = _by_source({s: i for i, s in enumerate(sorted(plan.lengths))})
    place = F.col("_pick") * len(plan.lengths) + rank
    return drawn.withColumn("_place", place.cast("bigint")).drop("_pick")


def _by_source(values: dict[int, int]) -> Column:
    """A per-source number; there are as many as sources in the configuration."""
    found = F.lit(None).cast("bigint")
    for source, value in values.items():
        found = F.when(F.col(SRC) == source, F.lit(value).cast("bigint")).otherwise(found)
    return found


def repositioned(df: DataFrame, place: Column) -> DataFrame:
    """Rows whose position is their place in the mix."""
    return (
        df.withColumn("_from", F.col(SRC))
        .withColumn(ROW, place.cast("bigint"))
        .withColumn(FILE, F.lit(""))
        .withColumn(SRC, F.lit(0))
        .drop("_place")
    )


# --- repeating rows -------------------------------------------------------------------


def _picked(
    indexed: DataFrame,
    lengths: dict[int, int],
    picks: dict[int, int],
    max_copies: int | None,
    chunk: int = CHUNK,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every row once per pick that uses it, with the pick's number in ``_pick``."""
    length = _by_source(lengths)
    index = F.col("_index")
    used = indexed.where(index < _by_source(picks))
    repeating = [s for s in lengths if picks.get(s, 0) > lengths[s]]
    if not repeating or max_copies == 1:
        return used.withColumn("_pick", index)
    single = [s for s in lengths if s not in repeating]
    once = used.where(F.col(SRC).isin(single)).withColumn("_pick", index)

    copies = F.ceil((_by_source(picks) - index) / length)
    if max_copies is not None:
        copies = F.least(copies, F.lit(max_copies))
    many = used.where(F.col(SRC).isin(repeating)).withColumn("_copies", copies)
    # a short source may lie in one task: spread its chunks of copies before making them
    last_chunk = F.floor((F.col("_copies") - 1) / chunk)
    many = many.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)))
    rows = sum(
        picks[s] if max_copies is None else min(picks[s], max_copies * lengths[s])
        for s in repeating
    )
    if rows > rows_per_task:
        tasks = min(math.ceil(rows / rows_per_task), MOST_TASKS)
        many = many.repartition(tasks, SRC, "_index", "_chunk")
    first = F.col("_chunk") * chunk
    last = F.least(F.col("_copies"), first + chunk) - 1
    many = (
        many.withColumn("_copy", F.explode(F.sequence(first, last)))
        .withColumn("_pick", index + F.col("_copy") * length)
        .drop("_copies", "_chunk", "_copy")
    )
    return once.unionByName(many) if single else many


# --- drawing by weight ---------------------------------------------------------------


def _source_of(draw: Column, sources: list[int], shares: list[float], seed) -> Column:
    """The source of a draw, from a hash of its number."""
    unit = hash_number(seed, draw.cast("string")) / F.lit(float(1 << HASH_BITS))
    bounds, upto = [], 0.0
    for share in shares:
        upto += share
        bounds.append(upto)
    live = [i for i, share in enumerate(shares) if share > 0]
    source = F.lit(sources[live[-1]])
    for i in reversed(live[:-1]):
        source = F.when(unit < bounds[i], sources[i]).otherwise(source)
    return source


def _enough(lengths: dict[int, int], shares: dict[int, float], stop: str) -> int:
    """Draws that all but surely reach the stop: the mean and six deviations."""

    def needed(n: int, p: float) -> float:
        return n / p + 6 * math.sqrt(n * (1 - p)) / p + 64

    each = [needed(lengths[s], p) for s, p in shares.items() if p > 0]
    return math.ceil(max(each) if stop == ALL else min(each))


class _Drawing:
    """The draws of a mix, block by block."""

    def __init__(self, spark: SparkSession, sources: list[int], shares: list[float], seed, block: int):
        self.spark, self.sources, self.shares, self.seed, self.block = spark, sources, shares, seed, block

    def blocks(self, start: int, end: int) -> DataFrame:
        """``_block`` and ``_picked``, its draws in order, each with its source."""
        cores = self.spark.sparkContext.defaultParallelism
        tasks = max(1, min(end - start, max(cores, math.ceil((end - start) * self.block / DRAWS_PER_TASK))))
        return self.with_picked(self.spark.range(start, end, 1, tasks).withColumnRenamed("id", "_block"))

    def with_picked(self, blocks: DataFrame) -> DataFrame:
        first = F.col("_block") * self.block
        draws = F.sequence(first, first + (self.block - 1))

        def with_source(draw: Column) -> Column:
            source = _source_of(draw, self.sources, self.shares, self.seed)
            return F.struct(draw.alias("draw"), source.alias("source"))

        return blocks.withColumn("_picked", F.transform(draws, with_source))

    def of(self, source: int, upto: int | None = None) -> Column:
        """The draws of a block that go to the source, in order; up to a draw if there is one."""
        # the condition looks at nothing but the draw, or Spark would make the whole block anew for each
        wanted = lambda x: (x["source"] == source) & (F.lit(True) if upto is None else x["draw"] <= upto)
        return F.transform(F.filter("_picked", wanted), lambda x: x["draw"])

    def counted(self, start: int, end: int) -> DataFrame:
        """A row per block: how many of its draws go to each source."""
        sizes = F.array(*(F.size(self.of(s)).cast("bigint") for s in self.sources))
        return self.blocks(start, end).select("_block", sizes.alias("_counts"))

    def cumulated(self, counts: DataFrame, n_blocks: int) -> DataFrame:
        """With ``_before``: how many draws of earlier blocks went to each source.

        Many counts are added up in groups of blocks side by side, then over the groups, of which
        there is one to BLOCKS_TOGETHER blocks.
        """
        each = [F.col("_counts")[i] for i in range(len(self.sources))]
        none = F.lit(0).cast("bigint")
        earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        if n_blocks <= BLOCKS_TOGETHER:
            before = F.array(*(F.coalesce(F.sum(c).over(earlier), none) for c in each))
            return stage(counts.select("_block", "_counts", before.alias("_before")), "draws")
        counts = stage(counts, "counts")
        grouped = counts.withColumn("_group", F.floor(F.col("_block") / BLOCKS_TOGETHER))
        within = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        sums = grouped.groupBy("_group").agg(*(F.sum(c).alias(f"_s{i}") for i, c in enumerate(each)))
        over = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
        groups = sums.select("_group", *(F.coalesce(F.sum(f"_s{i}").over(over), none).alias(f"_g{i}") for i in range(len(each))))
        before = [F.coalesce(F.sum(c).over(within), none) + F.col(f"_g{i}") for i, c in enumerate(each)]
        added = grouped.join(F.broadcast(groups), "_group").select("_block", "_counts", F.array(*before).alias("_before"))
        return stage(added, "draws")


def _draws(spark, lengths, shares, seed, stop, block):
    """Picks per source up to the stop, and the draws as (source, pick, place)."""
    sources = sorted(lengths)
    drawing = _Drawing(spark, sources, shares, seed, block)
    wanted = _enough(lengths, dict(zip(sources, shares)), stop)
    table, done = None, 0
    while True:
        end = max(done + 1, math.ceil(wanted / block))
        counts = drawing.counted(done, end)  # earlier blocks are counted already
        if table is not None:
            counts = table.select("_block", "_counts").unionByName(counts)
        table, done = drawing.cumulated(counts, end), end
        # the last first-time pick of each source: in one block per source at most
        hits = [
            (F.col("_before")[i] < lengths[s]) & (F.col("_before")[i] + F.col("_counts")[i] >= lengths[s])
            for i, s in enumerate(sources)
        ]
        near = drawing.with_picked(table.where(reduce(lambda x, y: x | y, hits)))
        near = near.select("_block", "_before", "_counts", F.transform("_picked", lambda x: x["source"]).alias("_sources")).collect()
        last_picks = {}
        for r in near:
            for i, s in enumerate(sources):
                nth = lengths[s] - r["_before"][i]
                if 0 < nth <= r["_counts"][i]:
                    own = [k for k, x in enumerate(r["_sources"]) if x == s]
                    last_picks[s] = r["_block"] * block + own[nth - 1]
        if last_picks and (stop == FIRST or len(last_picks) == len(sources)):
            break
        wanted = 2 * done * block
    stop_at = (max if stop == ALL else min)(last_picks.values())
    final = next(r for r in near if r["_block"] == stop_at // block)
    reached = final["_sources"][: stop_at % block + 1]
    picks = {s: final["_before"][i] + reached.count(s) for i, s in enumerate(sources)}

    used = table.where(F.col("_block") <= stop_at // block)
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(stop_at / DRAWS_PER_TASK))
    if stop_at > DRAWS_PER_TASK:  # a row is a whole block, so few rows are much work
        used = used.repartition(min(tasks, MOST_TASKS), "_block")
    each = F.array(
        *(
            F.struct(F.lit(s).alias(SRC), F.col("_before")[i].alias("_from"), drawing.of(s, stop_at).alias("_own"))
            for i, s in enumerate(sources)
        )
    )
    parts = drawing.with_picked(used).select(F.explode(each).alias("p")).select("p.*")
    drawn = parts.select(SRC, "_from", F.posexplode("_own").alias("_nth", "_place"))
    return picks, drawn.select(SRC, (F.col("_from") + F.col("_nth")).alias("_pick"), "_place")
