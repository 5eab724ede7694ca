"""Fitted expression curves along pseudotime, and the tree of genes by the shape of their curves.

A gene's curve is the least-squares spline of the tests in ``nested``: all genes share the design, so sums per (gene, design
column) and one small inverse give every coefficient, and the curve is the basis at the grid's points times them.

The tree is Ward's: the two groups merge whose union adds least to the squared distances within. Nearest neighbours of all
groups are found by Spark, and every pair that is nearest to each other merges in the same round; for Ward's distance that gives
the tree of one merge after another. What the driver holds is the groups' mean curves, genes × points numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from guidescape.operators.nested import _bends, _gram, _inner, design, with_spline
from guidescape.operators.ranking import grouped_quantiles
from guidescape.runtime import checkpointed, importable

TASK_ROWS = 256  # groups whose nearest neighbour one task looks for


def fitted_curves(
    expr: DataFrame,
    cells: DataFrame,
    col: str = "pseudotime",
    points: int = 100,
    by: Sequence[str] = (),
    genes: DataFrame | None = None,
) -> DataFrame:
    """gene, ``by``, point, ``pseudotime`` of it, curve, z: the fitted spline at equally spaced places.

    Places run from the group's least to its greatest pseudotime; z is the curve less its mean over its standard deviation, null
    for a flat one. Cells without a row in ``expr`` count as zeros; with ``genes`` those without any row have a curve of zeros.
    """
    by = list(by)
    group = by or ["_one"]
    held = cells if by else cells.withColumn("_one", F.lit(0))
    placed, spline = with_spline(held, col, group)
    rows, _ = design(placed, [spline], group)
    rows = checkpointed(rows)
    gram = _gram(rows, 4, group)
    inverse = {key: _inner(g).inverse for key, g in gram.items()}

    share = F.col("point") / F.lit(max(points - 1, 1))
    marks = checkpointed(
        placed.groupBy(*group).agg(F.min(col).cast("double").alias("_low"), F.max(col).cast("double").alias("_high"))
    ).join(_knots(held, col, group), group)
    grid = marks.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("_basis", F.array(F.lit(1.0), *_bends(share, F.col("_a"), F.col("_b"))))
    ends = {}
    for r in grid.select(*group, "point", "_low", "_high", "_basis").collect():  # groups × points
        ends.setdefault(tuple(r[c] for c in group), []).append((r["point"], r["_low"], r["_high"], r["_basis"]))
    basis, at = {}, {}
    for key, found in ends.items():
        found.sort()
        basis[key] = np.array([f[3] for f in found])
        at[key] = np.array([f[1] + (f[2] - f[1]) * f[0] / max(points - 1, 1) for f in found])

    sums = (
        expr.select("cell_id", "gene", "value")
        .join(rows, "cell_id")
        .select(*group, "gene", "value", F.explode("entries").alias("e"))
        .groupBy(*group, "gene", F.col("e.j").alias("j"))
        .agg(F.sum(F.col("value") * F.col("e.x")).alias("v"))
    )
    per_gene = sums.groupBy(*group, "gene").agg(F.collect_list("j").alias("js"), F.collect_list("v").alias("vs"))
    if genes is not None:
        every = genes.select("gene").distinct()
        every = every.withColumn("_g", F.explode(marks.agg(F.collect_list(F.struct(*group))).scalar())).select("_g.*", "gene")
        per_gene = every.join(per_gene, [*group, "gene"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in per_gene.schema}

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                key = tuple(row[: len(group)])
                xy = np.zeros(4)
                if row.js is not None:
                    xy[np.asarray(row.js)] = row.vs
                curve = basis[key] @ (inverse[key] @ xy)
                spread = curve.std(ddof=1) if len(curve) > 1 else 0.0
                flat = not spread > 1e-12 * max(np.abs(curve).max(initial=0.0), 1e-300)
                out = pd.DataFrame({"point": np.arange(points), "at": at[key], "curve": curve})
                out["z"] = None if flat else (curve - curve.mean()) / spread
                yield out.assign(gene=row.gene, **dict(zip(group, key)))[[*group, "gene", "point", "at", "curve", "z"]]

    heads = ", ".join(f"{c} {kinds[c]}" for c in [*group, "gene"])
    ordered = per_gene.select(*group, "gene", "js", "vs")
    curves = ordered.mapInPandas(fit, f"{heads}, point int, at double, curve double, z double")
    return curves.select("gene", *by, "point", F.col("at").alias(col), "curve", "z")


def _knots(cells: DataFrame, col: str, group: list[str]) -> DataFrame:
    """Inner knots of each group as shares of its range."""
    at = [F.col("_marks")[i] for i in range(4)]
    width = F.coalesce(F.nullif(at[3] - at[0], F.lit(0.0)), F.lit(1.0))
    marks = grouped_quantiles(cells, col, [0.0, 1 / 3, 2 / 3, 1.0], group)
    return marks.select(*group, ((at[1] - at[0]) / width).alias("_a"), ((at[2] - at[0]) / width).alias("_b"))


@dataclass
class GeneTree:
    """``merges``: (left, right, height) in rising height; leaves are places in ``genes``, merge i makes group len(genes) + i."""

    genes: list[str]
    merges: list[tuple[int, int, float]]

    def cut(self, groups: int) -> dict[str, int]:
        """Group number of each gene when the last merges are undone; numbers follow the genes' order."""
        n = len(self.genes)
        label = list(range(n + len(self.merges)))
        for i, (a, b, _) in enumerate(self.merges[: max(0, n - groups)]):
            label[a] = label[b] = n + i
        roots = []
        for v in range(n):
            while label[v] != v:
                v = label[v]
            roots.append(v)
        number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        return {g: number[r] for g, r in zip(self.genes, roots)}


def _nearest(spark: SparkSession, means: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every group the one it would cost least to merge with (ties: the first), and that cost."""
    sent = importable(spark).sparkContext.broadcast((means, sizes))  # groups × points, at most genes × points numbers
    tasks = -(-len(means) // TASK_ROWS)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, n = sent.value
        for pdf in batches:
            for task in pdf["id"]:
                own = np.arange(task * TASK_ROWS, min(len(x), (task + 1) * TASK_ROWS))
                # exact differences: equal curves must come out equally far from everything
                cost = np.empty((len(own), len(x)))
                for i, v in enumerate(own):
                    cost[i] = 2.0 * n[v] * n / (n[v] + n) * ((x - x[v]) ** 2).sum(axis=1)
                cost[np.arange(len(own)), own] = np.inf
                best = cost.argmin(axis=1)
                yield pd.DataFrame({"v": own, "near": best, "cost": cost[np.arange(len(own)), best]})

    found = spark.range(0, tasks, 1, min(tasks, 1024)).mapInPandas(look, "v int, near int, cost double").toPandas()
    sent.unpersist()
    found = found.sort_values("v")
    return found["near"].to_numpy(), found["cost"].to_numpy()


def gene_tree(curves: DataFrame, value: str = "z", place: str = "point") -> GeneTree:
    """Ward's tree of the genes of a table with one row per gene and place; a null value counts as 0."""
    spark = curves.sparkSession
    listed = curves.groupBy("gene").agg(
        F.sort_array(F.collect_list(F.struct(place, F.coalesce(value, F.lit(0.0)).alias("v"))))["v"].alias("vs")
    )
    rows = sorted(((r["gene"], r["vs"]) for r in listed.collect()))
    genes = [g for g, _ in rows]
    means = np.array([v for _, v in rows], float)
    sizes, names = np.ones(len(genes)), np.arange(len(genes))
    made: list[tuple[int, int, float]] = []
    while len(names) > 1:
        near, cost = _nearest(spark, means, sizes)
        left = np.flatnonzero((near[near] == np.arange(len(near))) & (np.arange(len(near)) < near))
        right = near[left]
        weight = sizes[left] + sizes[right]
        means[left] = (means[left] * sizes[left, None] + means[right] * sizes[right, None]) / weight[:, None]
        sizes[left] = weight
        for a, b in zip(left, right):
            made.append((names[a], names[b], float(np.sqrt(cost[a]))))
        fresh = len(genes) + len(made) - len(left) + np.arange(len(left))
        names[left] = fresh
        keep = np.setdiff1d(np.arange(len(names)), right)
        means, sizes, names = means[keep], sizes[keep], names[keep]
    # rounds give merges out of order: number them anew by height, a merge after those that it is made of
    order = sorted(range(len(made)), key=lambda i: (made[i][2], i))
    n, new = len(genes), {}
    for place_, i in enumerate(order):
        new[n + i] = n + place_
    return GeneTree(genes, [tuple(sorted((int(new.get(a, a)), int(new.get(b, b))))) + (h,) for a, b, h in (made[i] for i in order)])


def tree_groups(curves: DataFrame, groups: int, value: str = "z", place: str = "point") -> DataFrame:
    """gene, group: the tree of the curves cut into ``groups``."""
    cut = gene_tree(curves, value, place).cut(groups)
    return curves.sparkSession.createDataFrame(list(cut.items()), "gene string, group int")
