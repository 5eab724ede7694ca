"""Correlation between profiles and genes, its p-values, singular values and canonical correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from guidescape.functions.tails import student_two_sided
from guidescape.operators.components import leading_singular_values
from guidescape.runtime import checkpointed, total

ROW_CHUNK = 2048
COLUMN_BLOCK = 256
DENSE_LIMIT = 1024


def profile_corr(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r for every pair of the listed columns (upper triangle), in one aggregate over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        raise ValueError("at least two columns are needed")
    row = wide.agg(
        F.array(
            *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]
        ).alias("_pairs")
    )
    return row.select(F.explode("_pairs").alias("_p")).select(
        F.col("_p.a").alias("col_a"), F.col("_p.b").alias("col_b"), F.col("_p.r").alias("r")
    )


def _spread(long: DataFrame, chunks: int, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
    """Place every matrix entry in its row chunk and column block, once per block of the other side."""
    chunk = F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk")
    block = F.pmod(F.xxhash64("col"), F.lit(own_blocks)).cast("int").alias(own)
    others = F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))).alias(other)
    # fresh column identities, so that a matrix can be multiplied with itself
    fresh = [F.col(c).alias(c) for c in ("row", "col", "value")]
    return long.select(chunk, block, others, *fresh)


def _block_product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Aᵀ·B of one row chunk and one pair of column blocks, as long rows."""
    if left.empty or right.empty:
        return pd.DataFrame({"col_a": [], "col_b": [], "value": []}).astype({"value": "float64"})
    a = left.pivot(index="row", columns="col", values="value")
    b = right.pivot(index="row", columns="col", values="value")
    rows = a.index.intersection(b.index)
    product = a.loc[rows].fillna(0.0).to_numpy().T @ b.loc[rows].fillna(0.0).to_numpy()
    return pd.DataFrame(
        {
            "col_a": np.repeat(a.columns.to_numpy(), len(b.columns)),
            "col_b": np.tile(b.columns.to_numpy(), len(a.columns)),
            "value": product.ravel(),
        }
    )


def _column_stats(long: DataFrame) -> DataFrame:
    """Rows, mean and centred length of every column: one pass over the matrix, one row per column."""
    return checkpointed(
        long.groupBy("col").agg(
            F.count("value").alias("_rows"),
            F.avg("value").alias("_mean"),
            F.sqrt(F.var_pop("value") * F.count("value")).alias("_length"),
        )
    )


def cross_product(
    a: DataFrame, b: DataFrame, stats_a: DataFrame | None = None, stats_b: DataFrame | None = None
) -> DataFrame:
    """Aᵀ·B of two long matrices (row, col, value), as (col_a, col_b, value).

    Rows are cut into chunks and columns into blocks of fixed expected size; each task multiplies one chunk of one block
    pair, and the partial products are added up by Spark. No task sees a whole column and nothing reaches the driver.
    """
    stats_a = _column_stats(a) if stats_a is None else stats_a
    stats_b = _column_stats(b) if stats_b is None else stats_b
    shape = stats_a.agg(F.max("_rows").alias("rows"), F.count(F.lit(1)).alias("cols")).first()
    chunks = max(1, math.ceil((shape["rows"] or 0) / ROW_CHUNK))
    blocks_a = max(1, math.ceil(shape["cols"] / COLUMN_BLOCK))
    blocks_b = max(1, math.ceil(stats_b.count() / COLUMN_BLOCK))
    left = _spread(a, chunks, "block_a", blocks_a, "block_b", blocks_b)
    right = _spread(b, chunks, "block_b", blocks_b, "block_a", blocks_a)
    keys = ["chunk", "block_a", "block_b"]
    partial = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(_block_product, "col_a string, col_b string, value double")
    )
    return partial.groupBy("col_a", "col_b").agg(F.sum("value").alias("value"))


def _standardised(long: DataFrame, stats: DataFrame) -> DataFrame:
    """Columns centred and scaled to unit length, so that products of columns are correlations."""
    scaled = (F.col("value") - F.col("_mean")) / F.col("_length")
    return long.join(stats.where(F.col("_length") > 0), "col").select("row", "col", scaled.alias("value"))


def cross_corr(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson r between every column of ``a`` and every column of ``b`` over the same, complete rows.

    Constant columns have no correlation and give no row.
    """
    stats_a, stats_b = _column_stats(a), _column_stats(b)
    product = cross_product(_standardised(a, stats_a), _standardised(b, stats_b), stats_a, stats_b)
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value")))
    return product.select("col_a", "col_b", bounded.alias("r"))


def corr_pvalues(corr: DataFrame, n_rows: int) -> DataFrame:
    """Two-sided t test of each correlation over ``n_rows`` rows."""
    df = n_rows - 2
    r = F.col("r")
    t = r * F.sqrt(df / F.nullif(1 - r * r, F.lit(0.0)))
    return corr.withColumn("t", t).withColumn(
        "p_value", F.when(F.abs(r) >= 1, 0.0).otherwise(student_two_sided(F.col("t"), F.lit(df)))
    )


def singular_values(corr: DataFrame, k: int) -> DataFrame:
    """Largest ``k`` singular values of a correlation matrix given as (col_a, col_b, r) rows; an absent entry is 0.

    The matrix is only multiplied with thin blocks, a pass over its rows each; neither its square nor the matrix is gathered.
    """
    names = corr.select("col_b").distinct().orderBy("col_b")
    # as many names as the matrix has columns
    place = total(names, F.sort_array(F.collect_list("col_b")))
    rows = corr.withColumn("_at", (F.array_position(place, F.col("col_b")) - 1).cast("int")).groupBy("col_a").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_at").alias("i"), F.col("r").alias("v")))).alias("_e")
    )
    rows = checkpointed(rows.select(F.col("_e.i").alias("indices"), F.col("_e.v").alias("values")))
    values = leading_singular_values(rows, k, names.count())
    return corr.sparkSession.createDataFrame(
        [(i + 1, float(v)) for i, v in enumerate(values)], "component int, singular_value double"
    )


def _dense(product: DataFrame, rows: list[str], cols: list[str]) -> np.ndarray:
    found = product.toPandas()
    out = np.zeros((len(rows), len(cols)))
    at = pd.Index(rows).get_indexer(found["col_a"]), pd.Index(cols).get_indexer(found["col_b"])
    out[at] = found["value"]
    return out


def _inverse_root(gram: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(gram)
    keep = values > values.max() * len(values) * np.finfo(float).eps
    return vectors[:, keep] / np.sqrt(values[keep])


@dataclass
class Canonical:
    """``correlations``, falling, and for each side the columns' names and coefficients (columns × pairs)."""

    correlations: np.ndarray
    columns: tuple[list[str], list[str]]
    coefficients: tuple[np.ndarray, np.ndarray]


def canonical_pairs(a: DataFrame, b: DataFrame) -> Canonical:
    """Canonical correlations and coefficients of two long matrices on the same rows, without centring.

    The sides times their coefficients have columns of length 1 that are orthogonal to each other, and to all but the matching
    one of the other side. The first side's largest coefficient of a pair is positive. The three cross-products are distributed;
    the final solve is columns × columns, so the number of columns is checked.
    """
    names = []
    for side in (a, b):
        listed = [r["col"] for r in side.select("col").distinct().orderBy("col").limit(DENSE_LIMIT + 1).collect()]
        if len(listed) > DENSE_LIMIT:
            raise ValueError(f"canonical correlation solves a dense system of at most {DENSE_LIMIT} columns")
        names.append(listed)
    saa = _dense(cross_product(a, a), names[0], names[0])
    sbb = _dense(cross_product(b, b), names[1], names[1])
    sab = _dense(cross_product(a, b), names[0], names[1])
    root_a, root_b = _inverse_root(saa), _inverse_root(sbb)
    u, values, vt = np.linalg.svd(root_a.T @ sab @ root_b, full_matrices=False)
    x, y = root_a @ u, root_b @ vt.T
    largest = np.abs(x).argmax(axis=0)
    sign = np.where(x[largest, np.arange(x.shape[1])] < 0, -1.0, 1.0)
    return Canonical(np.clip(values, 0.0, 1.0), (names[0], names[1]), (x * sign, y * sign))


def canonical_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """component, correlation: the canonical correlations of ``canonical_pairs``."""
    values = canonical_pairs(a, b).correlations
    return a.sparkSession.createDataFrame(
        [(i + 1, float(v)) for i, v in enumerate(values)], "component int, correlation double"
    )


def canonical_coefficients(a: DataFrame, b: DataFrame) -> DataFrame:
    """side (a, b), col, component, coefficient of ``canonical_pairs``."""
    found = canonical_pairs(a, b)
    rows = [
        (side, name, i + 1, float(v))
        for side, names, table in zip("ab", found.columns, found.coefficients)
        for name, values in zip(names, table)
        for i, v in enumerate(values)
    ]
    return a.sparkSession.createDataFrame(rows, "side string, col string, component int, coefficient double")


def guide_density(
    cells: DataFrame, guide_id: str, bandwidth: float = 0.2, points: int = 512, margin: float = 3.0
) -> DataFrame:
    """Gaussian kernel density of guide ids per cluster, on a grid from ``margin`` bandwidths around the ids seen.

    Cells collapse to counts per distinct id first; each count then adds its kernel to every grid point.
    """
    counts = cells.groupBy("louvain", guide_id).agg(F.count(F.lit(1)).alias("_n"))
    ends = counts.groupBy("louvain").agg(
        (F.min(guide_id) - margin * bandwidth).alias("_lo"),
        (F.max(guide_id) + margin * bandwidth).alias("_hi"),
        F.sum("_n").alias("_total"),
    )
    placed = (
        counts.join(ends, "louvain")
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", F.col("_lo") + F.col("point") * ((F.col("_hi") - F.col("_lo")) / (points - 1)))
    )
    z = (F.col("x") - F.col(guide_id)) / bandwidth
    kernel = F.exp(-0.5 * z * z) / (bandwidth * math.sqrt(2 * math.pi))
    return placed.groupBy("louvain", "point", "x").agg(
        F.sum(F.col("_n") / F.col("_total") * kernel).alias("density")
    )
