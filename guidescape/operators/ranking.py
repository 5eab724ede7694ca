"""Exact ranks over a whole table without a window that holds it.

Rows are first collapsed to distinct values, then laid out in buckets by a monotone function of the value. Offsets between
buckets come from the bucket histogram, whose size is bounded by the bucket function and not by the data; ranks inside a
bucket come from a window over that bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from guidescape.runtime import checkpointed

PER_DECADE = 256


def probability_bucket(p: Column) -> Column:
    """Monotone bucket of a probability: equal steps of log10 (at most about 83,000 of them)."""
    floor = -PER_DECADE * 324
    return F.when(p <= 0, floor).otherwise(F.floor(F.log10(p) * PER_DECADE)).cast("int")


def range_bucket(lowest: Column, highest: Column, buckets: int = 4096) -> Callable[[Column], Column]:
    """Monotone bucket of a value between two known ends."""

    def bucket(value: Column) -> Column:
        share = (value - lowest) / F.nullif(highest - lowest, F.lit(0.0))
        return F.coalesce(F.floor(share * buckets), F.lit(0)).cast("int")

    return bucket


def tie_ranks(
    df: DataFrame,
    value: str,
    bucket: Callable[[Column], Column],
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """One row per (``by``, distinct value): ``ties`` rows share it, ``below`` rows are smaller, of ``group_rows``.

    With ``weight`` a row stands for that many rows.
    """
    by = list(by)
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    ties = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(rows.alias("ties"))
        .withColumn("_bucket", bucket(F.col(value)))
    )
    histogram = ties.groupBy(*by, "_bucket").agg(F.sum("ties").alias("_held"))
    group = Window.partitionBy(*by)
    offsets = histogram.select(
        *by,
        "_bucket",
        (F.sum("_held").over(group.orderBy("_bucket")) - F.col("_held")).alias("_before"),
        F.sum("_held").over(group).alias("group_rows"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(value)
    return ties.join(offsets, [*by, "_bucket"]).withColumn(
        "below", F.col("_before") + F.sum("ties").over(inside) - F.col("ties")
    )


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float]) -> list[float]:
    """Quantiles with linear interpolation between order statistics; one float per probability."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).first()
    if not ends["n"]:
        return [None] * len(probabilities)
    ranked = tie_ranks(df, value, range_bucket(F.lit(float(ends["lo"])), F.lit(float(ends["hi"]))))
    picks = []
    for i, p in enumerate(probabilities):
        h = (ends["n"] - 1) * p
        below = int(h)
        above = min(below + 1, ends["n"] - 1)
        for name, rank in (("a", below), ("b", above)):
            hit = (F.col("below") <= rank) & (F.lit(rank) < F.col("below") + F.col("ties"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"{name}{i}"))
    row = ranked.agg(*picks).first()
    out = []
    for i, p in enumerate(probabilities):
        h = (ends["n"] - 1) * p
        out.append(row[f"a{i}"] + (h - int(h)) * (row[f"b{i}"] - row[f"a{i}"]))
    return out


def grouped_quantiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str]) -> DataFrame:
    """As ``exact_quantiles`` for every group: ``by`` and _marks, an array with one quantile per probability."""
    by, last = list(by), F.col("group_rows") - 1
    ends = df.groupBy(*by).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    inside = range_bucket(F.col("_lo"), F.col("_hi"))
    ranked = tie_ranks(df.join(ends, by), value, inside, [*by, "_lo", "_hi"])
    picks = []
    for i, p in enumerate(probabilities):
        for name, rank in (("a", F.floor(last * p)), ("b", F.least(F.floor(last * p) + 1, last))):
            hit = (F.col("below") <= rank) & (rank < F.col("below") + F.col("ties"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}{i}"))
    row = ranked.groupBy(*by).agg(*picks, F.max("group_rows").alias("group_rows"))
    part = [last * p - F.floor(last * p) for p in probabilities]
    marks = [F.col(f"_a{i}") + x * (F.col(f"_b{i}") - F.col(f"_a{i}")) for i, x in enumerate(part)]
    return row.select(*by, F.array(*marks).alias("_marks"))


def seeded_hash(key: str, seed: int) -> Column:
    """Hexadecimal digest of seed and key; its text order is its numeric order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def lowest_by_hash(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Exactly the ``n`` rows with the smallest seeded hash of a unique ``key`` (ties by key), for any ``n``.

    A histogram over the 65,536 four-digit prefixes of the hash finds the prefix that holds the cut, only the rows of that
    prefix are ranked, and the answer itself is a plain filter on the hash.
    """
    value = seeded_hash(key, seed)
    # keys and hashes are written once: the input itself is only gone through for them and for the answer
    hashed = checkpointed(df.select(key, value.alias("_hash"), F.substring(value, 1, 4).alias("_prefix")))
    histogram = hashed.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_held"))
    running = histogram.withColumn("_upto", F.sum("_held").over(Window.orderBy("_prefix")))
    cut = running.where(F.col("_upto") >= n).orderBy("_prefix").first()
    if cut is None:
        return df
    wanted = n - (cut["_upto"] - cut["_held"])
    rank = F.row_number().over(Window.partitionBy("_prefix").orderBy("_hash", key))
    edge = hashed.where(F.col("_prefix") == cut["_prefix"]).withColumn("_rank", rank)
    last = edge.where(F.col("_rank") == wanted).first()
    if last is None:
        return df.limit(0)
    return df.where((value < last["_hash"]) | ((value == last["_hash"]) & (F.col(key) <= F.lit(last[key]))))
