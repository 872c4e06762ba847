"""Reproducible order, samples, splits and budgets.

Randomness is a SHA-256 of a seed and a row's key, never rand(): results don't depend on how rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int | str, *keys: Column | str) -> Column:
    """A hash of the seed and the keys, as hex: rows in its order are shuffled."""
    parts = [F.lit(str(seed))]
    for k in keys:
        parts += [F.lit(":"), (F.col(k) if isinstance(k, str) else k).cast("string")]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def bernoulli(df: DataFrame, fraction: float, seed: int, *keys: str) -> DataFrame:
    """Each row with a chance of `fraction`; the filter stands before all later work."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie between 0 and 1")
    limit = int(fraction * 2**32)
    draw = F.conv(F.substring(order_key(seed, *keys), 1, 8), 16, 10).cast("long")
    return df.where(draw < limit)


def calibrated(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """About n rows: a Bernoulli sample of n / count."""
    total = df.count()
    return bernoulli(df, min(1.0, n / total) if total else 1.0, seed, *keys)


def fixed(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """Exactly n rows (all, if fewer), by a top-k and no sort of the rest."""
    return df.withColumn("_order", order_key(seed, *keys)).orderBy("_order", *keys).limit(n).drop("_order")


#: Rows that one task numbers, about.
A_RANGE = 500_000


def ranked(df: DataFrame, stratum: str, seed: int, *keys: str, rows: int = A_RANGE) -> DataFrame:
    """With rank within and size of each stratum, in the seed's order.

    A stratum of many rows is dealt over ranges of the order key, as many as its size asks for; each range ranks its own,
    and a table of one row for each range has how many come before.
    """
    at = df.withColumn("_order", order_key(seed, F.coalesce(F.col(stratum).cast("string"), F.lit("")), *keys))
    sizes = df.groupBy(F.col(stratum).alias("_of")).agg(F.count(F.lit(1)).alias("size"))
    at = at.join(sizes, F.col(stratum).eqNullSafe(F.col("_of"))).drop("_of").withColumn("_range", _buckets(F.col("_order"), F.ceil(F.col("size") / rows)))
    counts = at.groupBy(F.col(stratum).alias("_of"), F.col("_range").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_of", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(stratum, "_range").orderBy("_order", *keys))
    out = at.withColumn("_own", own).join(base, F.col(stratum).eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_at")))
    return out.withColumn("rank", F.col("_own") + F.col("_base")).drop("_order", "_range", "_own", "_of", "_at", "_base")


def stratified_sample(df: DataFrame, stratum: str, fraction: float, least: int, seed: int, *keys: str) -> DataFrame:
    """min(max(least, ceil(size * fraction)), size) rows of each stratum."""
    wanted = F.least(F.greatest(F.lit(least), F.ceil(F.col("size") * F.lit(float(fraction)))), "size")
    return ranked(df, stratum, seed, *keys).where(F.col("rank") <= wanted).drop("rank", "size")


def stratified_holdout(df: DataFrame, stratum: str, fraction: float, seed: int, *keys: str) -> DataFrame:
    """All rows with held_out: the first max(1, round-half-even(size * fraction)) of each stratum."""
    wanted = F.greatest(F.lit(1), F.bround(F.col("size") * F.lit(float(fraction))))
    return ranked(df, stratum, seed, *keys).withColumn("held_out", F.col("rank") <= wanted).drop("rank", "size")


def batches(df: DataFrame, size: int, seed: int, epoch: int, *keys: str, parts: int | None = None) -> DataFrame:
    """An epoch's permutation: position and batch_id of every row, numbered without gathering rows in one task."""
    out = numbered(df.withColumn("_order", order_key(seed + epoch, *keys)), "_order", parts=parts)
    return out.withColumn("batch_id", F.floor(F.col("position") / size).cast("long")).drop("_order")


def _buckets(order: Column, parts: int | Column) -> Column:
    """Ranges of a hex order key, as even as its hash."""
    return F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("double") * parts / 2**32).cast("int")


def numbered(df: DataFrame, order: str, weight: Column | None = None, name: str = "position", parts: int | None = None, below: int | None = None) -> DataFrame:
    """Exclusive running sum of a weight (1: the row's number) in the order of a hash key.

    With `below`, only rows whose sum is under it; ranges that begin there or later are neither sent nor sorted.

    Rows are dealt over ranges of the key (`parts`, or as many as the number of rows asks for); each range sums its own,
    and a table of one row for each range has the rest.
    """
    parts = parts or max(8, -(-df.count() // A_RANGE))
    weight = F.lit(1) if weight is None else weight
    rows = df.withColumn("_range", _buckets(F.col(order), parts)).withColumn("_weight", weight.cast("long"))
    sums = rows.groupBy("_range").agg(F.sum("_weight").alias("_sum"))
    # one row for each range, so one task holds `parts` rows
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    own = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("_weight").over(own), F.lit(0))
    rows = rows.join(F.broadcast(base if below is None else base.where(F.col("_base") < below)), "_range")
    out = rows.withColumn(name, local + F.col("_base")).drop("_range", "_weight", "_base")
    return out if below is None else out.where(F.col(name) < below)


def byte_budget(df: DataFrame, text: Column, target: int, seed: int, *keys: str, parts: int = 4096) -> DataFrame:
    """Rows in shuffled order until their UTF-8 bytes reach the target; the row that crosses it is in.

    So many ranges that rows needn't be counted first, and few of them reach beyond a small target.
    """
    out = numbered(df.withColumn("_order", order_key(seed, *keys)).withColumn("bytes", F.octet_length(text).cast("long")), "_order", F.col("bytes"), "bytes_before", parts, target)
    return out.drop("_order")
