"""Packing into optimal length buckets.

Dynamic programming over the global histogram of lengths picks the bucket boundaries with the least padding; inside a bucket
documents fill batches of a fixed token budget. The histogram has one row per distinct length, so its size follows the longest
document and not their number; it is the only thing the driver sees. Every document is packed whole.

The length of a document is its words plus one end token, so null, blank and empty texts have length 1. A document longer than
the budget is a batch of its own. Repeated rows are packed as often as they occur. Columns other than doc_id and text are
not read. An empty table gives no batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from guidescape.llm.text import words
from guidescape.runtime import checkpointed

BUCKETS = 8
BUDGET = 65_536
SHARD = 1 << 16


def token_length(text: Column) -> Column:
    return (F.size(words(text)) + 1).cast("long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding; of equal solutions the one whose
    boundaries, from the last to the first, are smallest.

    Layer by layer, all subproblems of one recursion depth at once: the best cut never moves left when the right end moves
    right, so each depth scans the lengths about once.
    """
    d = len(lengths)
    if d == 0:
        return []
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    mass = np.concatenate([[0], np.cumsum(counts)])
    filled = np.concatenate([[0], np.cumsum(counts * lengths)])

    def padding(i: np.ndarray, j: np.ndarray) -> np.ndarray:  # lengths i..j-1 padded to the largest of them
        return (mass[j] - mass[i]) * lengths[j - 1] - (filled[j] - filled[i])

    best = padding(np.zeros(d, np.int64), np.arange(1, d + 1))  # best[j-1]: first j lengths in one bucket
    cuts = []
    for _ in range(1, min(buckets, d)):
        previous = np.concatenate([[0], best])
        now, cut = previous[1:].copy(), np.zeros(d, np.int64)
        lo, hi = np.array([1]), np.array([d])
        first, last = np.array([0]), np.array([d - 1])
        while len(lo):
            mid = (lo + hi) // 2
            start, stop = first, np.minimum(last, mid - 1)
            width = stop - start + 1
            offset = np.concatenate([[0], np.cumsum(width)[:-1]])
            i = np.arange(width.sum()) - np.repeat(offset, width) + np.repeat(start, width)
            cost = previous[i] + padding(i, np.repeat(mid, width))
            least = np.minimum.reduceat(cost, offset)
            hit = np.flatnonzero(cost == np.repeat(least, width))
            at = i[hit[np.searchsorted(hit, offset)]]
            now[mid - 1], cut[mid - 1] = least, at
            left, right = lo < mid, mid < hi
            lo, hi, first, last = (
                np.concatenate([lo[left], mid[right] + 1]),
                np.concatenate([mid[left] - 1, hi[right]]),
                np.concatenate([first[left], at[right]]),
                np.concatenate([at[left], last[right]]),
            )
        best = now
        cuts.append(cut)
    bounds, j = [], d
    for cut in reversed(cuts):
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j - 1])
        if j == 0:
            return bounds[::-1]
    return [int(lengths[j - 1]), *bounds[::-1]]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket (its padded length), batch (number within the bucket), padding.

    Within a bucket documents are taken in order of (doc_id, n_tokens). Positions come from per-shard counts, so a bucket
    with a third of all rows is ranked by many tasks. A shard holds ``SHARD`` consecutive ids.
    """
    rows = checkpointed(docs.select("doc_id", token_length(F.col("text")).alias("n_tokens")))
    found = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").toPandas()
    bounds = optimal_boundaries(found["n_tokens"].to_numpy(), found["n"].to_numpy(), buckets)
    bucket = F.lit(None).cast("long")
    for bound in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(bound).cast("long")).otherwise(bucket)
    shard = F.floor(F.col("doc_id") / SHARD)
    placed = rows.withColumns({"bucket": bucket, "shard": shard})
    earlier = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    skip = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip")
    offsets = sizes.select(F.col("bucket").alias("of"), F.col("shard").alias("at"), skip)
    same = (F.col("bucket") == F.col("of")) & F.col("shard").eqNullSafe(F.col("at"))
    own = Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")
    rank = F.col("skip") + F.row_number().over(own) - 1
    size = F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1))
    return placed.join(offsets, same).select(
        "doc_id",
        "n_tokens",
        "bucket",
        F.floor(rank / size).cast("long").alias("batch"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )
