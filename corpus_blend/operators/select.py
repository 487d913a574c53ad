"""Choosing and ordering rows exactly: first n, random n, random order, split, dense index."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_blend.functions.keys import (
    HASH_BITS,
    POSITION,
    as_list,
    hash_number,
    key_text,
    not_after,
)
from corpus_blend.staging import stage

STEP_BITS = 12  # a counting pass has 2^12 groups, in each task and on the driver
SMALL = 10_000  # a group of at most this many keys is finished by an ordered take
ORDERED_TAKE = 10_000  # keys each task of first_rows may send to one; beyond, they are indexed
SAMPLED = 20_000  # keys, about, that are looked at to guess between which two the n-th lies
TASK_BITS = 33  # monotonically_increasing_id keeps the task number above these bits


def peek(df: DataFrame, n: int = 5, order=None) -> DataFrame:
    """n rows to look at; any n unless an order is asked for."""
    return df.orderBy(*as_list(order)).limit(n) if order else df.limit(n)


# --- exact random selection ----------------------------------------------------


def _hash_cut(df: DataFrame, salt, key: list[str], size_of: Callable[[int], int], small: int):
    """Row count, and the (hash, key) of the k-th row in hash order, k = size_of(count).

    Counts rows per leading bits of the hash and goes on inside the one group
    where the k-th row lies. Nothing is sorted or exchanged but those counts. A group of
    more than ``small`` rows is written, hashes and keys alone, so that ``df`` is read twice
    at most, whatever its number of rows.
    """
    columns = ["_order", *key]
    rows = df.select(hash_number(salt, key_text(key)).alias("_order"), *key)
    total = wanted = None
    written = False
    shift = HASH_BITS
    while True:
        shift -= min(STEP_BITS, shift)
        group = F.shiftright("_order", shift).alias("group")
        counts = {r["group"]: r["count"] for r in rows.groupBy(group).count().collect()}
        if total is None:
            total = sum(counts.values())
            wanted = size_of(total)
            if wanted <= 0 or wanted >= total:
                return total, max(wanted, 0), None
        for chosen in sorted(counts):
            if wanted <= counts[chosen]:
                break
            wanted -= counts[chosen]
        low, high = chosen << shift, (chosen + 1) << shift
        rows = rows.where((F.col("_order") >= low) & (F.col("_order") < high))
        if counts[chosen] > small and not written:
            rows, written = stage(rows, "hash-group"), True
        if counts[chosen] <= small:
            last = rows.orderBy(*columns).limit(wanted + 1).collect()
            if len(last) > wanted and last[wanted] == last[wanted - 1]:
                break
            return total, size_of(total), list(last[wanted - 1])
        if shift == 0:
            break
    raise ValueError(f"the key ({', '.join(key)}) does not tell all rows apart")


def _hash_chosen(df, salt, key, size_of, small) -> Column:
    """The condition that holds for exactly size_of(count) rows of the frame."""
    key = as_list(key)
    _, wanted, cut = _hash_cut(df, salt, key, size_of, small)
    if cut is None:
        return F.lit(wanted > 0)
    return not_after([hash_number(salt, key_text(key)), *key], cut)


def sample_rows(df: DataFrame, n: int, seed=42, key=POSITION, small: int = SMALL) -> DataFrame:
    """Exactly n random rows (all, if there are fewer)."""
    return df.where(_hash_chosen(df, f"{seed}/sample", key, lambda _: n, small))


def sample_fraction(
    df: DataFrame, fraction: float | None, seed=42, key=POSITION, small: int = SMALL
) -> DataFrame:
    """Exactly max(1, int(count * fraction)) random rows; fractions outside (0, 1) keep all."""
    if fraction is None or not 0 < fraction < 1:
        return df

    def size(count: int) -> int:
        return min(count, max(1, int(count * fraction)))

    return df.where(_hash_chosen(df, f"{seed}/sample", key, size, small))


def split_sizes(count: int, size: float | int) -> int:
    """Rows of the test split: a share of the rows, rounded up, or a number of rows."""
    if isinstance(size, float):
        if not 0 < size < 1:
            raise ValueError(f"a test share must lie between 0 and 1, not {size}")
        test = math.ceil(count * size)
    else:
        test = size
        if test < 0:
            raise ValueError(f"a number of test rows cannot be {size}")
    if test >= count:
        raise ValueError(f"{test} test rows out of {count} leave no training rows")
    return test


def split_condition(
    df: DataFrame, size: float | int | None, seed=42, key=POSITION, small: int = SMALL
) -> Column | None:
    """Which rows are test rows; no condition without a size."""
    if not size:
        return None
    return _hash_chosen(df, f"{seed}/split", key, lambda count: split_sizes(count, size), small)


def split_train_test(
    df: DataFrame, size: float | int | None, seed=42, key=POSITION, small: int = SMALL
) -> DataFrame:
    """Add ``split``: an exact number of random rows is ``test``, the others are ``train``."""
    chosen = split_condition(df, size, seed, key, small)
    label = F.lit("train") if chosen is None else F.when(chosen, "test").otherwise("train")
    return df.withColumn("split", label)


# --- random order ----------------------------------------------------------------


def default_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hash_slot(order, partitions: int):
    """Which of ``partitions`` equal ranges of the hash a row falls into."""
    share = order.cast("double") / F.lit(float(1 << HASH_BITS))
    return F.least(F.floor(share * partitions), F.lit(partitions - 1)).cast("int")


def shuffle(df: DataFrame, seed=42, key=POSITION, partitions: int | None = None) -> DataFrame:
    """Rows in the order of a hash of (seed, key), the same for any number of partitions.

    The hash is uniform, so equal ranges of it are equal partitions: rows are
    sent to their range directly, without the sampling pass of a sort.
    """
    key = as_list(key)
    partitions = partitions or default_partitions(df)
    ordered = df.withColumn("_order", hash_number(seed, key_text(key)))
    placed = ordered.repartitionById(partitions, hash_slot(F.col("_order"), partitions))
    return placed.sortWithinPartitions("_order", *key).drop("_order")


# --- exact order --------------------------------------------------------------------


def dense_index(df: DataFrame, order=POSITION, within: str | None = None) -> DataFrame:
    """Add ``_index``, the row's number from 0 in ``order`` (per value of ``within``, which
    then leads the order).

    Range partitions are numbered inside by Spark and written out; what is left
    is to add the rows in earlier partitions, one number per partition written.
    """
    order = as_list(order)
    if within and order[0] != within:
        order = [within, *order]
    numbered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", TASK_BITS).cast("int"))
    )
    written = stage(numbered, "indexed")
    # as JSON, so that a null group is a group like any other
    group = F.to_json(F.struct(F.col(within).alias("g"))) if within else F.lit("")
    # rows = partitions written, plus one for each group that begins inside one
    sizes = written.groupBy("_part", group.alias("_group")).agg(
        F.count("*").alias("n"), F.min("_id").alias("first")
    )
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    # written out, so that its true size decides whether it is broadcast
    shift = stage(sizes.select("_part", "_group", (before - F.col("first")).alias("_shift")), "offsets")
    return (
        written.withColumn("_group", group)
        .join(shift, ["_part", "_group"])
        .withColumn("_index", F.col("_id") + F.col("_shift"))
        .drop("_id", "_part", "_group", "_shift")
    )


def _last_of(keys: DataFrame, order: list[str], n: int) -> list:
    first = keys.orderBy(*order).limit(n)
    return first.orderBy(*[F.col(c).desc() for c in order]).limit(1).collect()


def _nth(keys: DataFrame, order: list[str], n: int, ordered_take: int, sampled: int | None = None) -> list:
    """The n-th key in ``order``, in a list; empty if there are fewer.

    A sample by hash, of bounded size, tells two keys between which it most likely lies. Keys up to the lower are
    counted and those between written, which is exact: only if the guess was wrong, keys repeat
    so much that it rules out little, or some are null are all keys sorted.
    """
    sampled = sampled or SAMPLED
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in order])
    total, nulls = keys.agg(F.count(F.lit(1)), F.count_if(missing)).first()
    if n > total:
        return []
    every = total // sampled
    if every > 1 and not nulls:
        drawn = keys.where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).distinct()
        guesses = [list(r) for r in drawn.orderBy(*order).limit(4 * sampled).collect()]
        at, slack = n // every, 4 * math.isqrt(n // every) + 10
        low = guesses[at - slack] if 0 <= at - slack < len(guesses) else None
        high = guesses[at + slack] if at + slack < len(guesses) else None
        up_to = F.lit(False) if low is None else not_after(order, low)
        below = keys.where(up_to).count() if low is not None else 0
        inside = keys.where(~up_to & (F.lit(True) if high is None else not_after(order, high)))
        inside = stage(inside, "bracket")
        found = inside.count()
        if 0 < n - below <= found and found <= total // 2:
            if n - below <= ordered_take:
                return _last_of(inside, order, n - below)
            return _nth(inside, order, n - below, ordered_take, sampled)
    return dense_index(keys, order).where(F.col("_index") == n - 1).select(*order).collect()


def first_rows(
    df: DataFrame, n: int | None, order=POSITION, ordered_take: int = ORDERED_TAKE
) -> DataFrame:
    """The first n rows in ``order``; no n, or 0, keeps all.

    Only the order columns are looked at to find the last row wanted; the rows
    themselves are then filtered where they are.
    """
    if not n:
        return df
    order = as_list(order)
    keys = df.select(*order)
    if n <= ordered_take:
        last = _last_of(keys, order, n)
    else:
        last = _nth(keys, order, n, ordered_take)
    return df.where(not_after(order, list(last[0]))) if last else df
