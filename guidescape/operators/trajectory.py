"""Principal tree, pseudotime, states and branches.

A tree starts as k-means centres joined by a minimum spanning tree. Reverse graph embedding then moves the centres: cells belong
to centres in soft shares, and the tree's edges pull its centres together, so that the tree follows the middle of the cells.
Only the tree (k centres) lives on the driver; every round is one aggregate over the cells, whose size depends on k alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from guidescape.operators.components import summed


@dataclass
class Tree:
    centres: np.ndarray
    edges: list[tuple[int, int]]

    def length(self, edge: tuple[int, int]) -> float:
        return float(np.linalg.norm(self.centres[edge[0]] - self.centres[edge[1]]))

    def neighbours(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.centres]
        for a, b in self.edges:
            out[a].append(b)
            out[b].append(a)
        return out

    def branch_points(self) -> list[int]:
        return [v for v, around in enumerate(self.neighbours()) if len(around) > 2]


def spanning_tree(centres: np.ndarray) -> Tree:
    """Minimum spanning tree over a few centres, grown from the first one."""
    gaps = np.linalg.norm(centres[:, None, :] - centres[None, :, :], axis=2)
    inside = [0]
    edges = []
    while len(inside) < len(centres):
        outside = [v for v in range(len(centres)) if v not in inside]
        a, b = min(((u, v) for u in inside for v in outside), key=lambda e: (gaps[e], e))
        edges.append((a, b))
        inside.append(b)
    return Tree(centres, edges)


def fit_tree(points: DataFrame, k: int, seed: int = 55) -> Tree:
    """k-means centres of the embedding and the tree that joins them."""
    vectors = points.select(array_to_vector(F.transform("values", lambda v: v.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed).fit(vectors)
    return spanning_tree(np.array(model.clusterCenters()))


def _soft_sums(points: DataFrame, centres: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Over all cells: weight of each centre, weighted sums, free energy, and squared distances to the nearest centre."""
    k, dim = centres.shape

    def add(out: np.ndarray, x: np.ndarray) -> None:
        gaps = ((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)).clip(min=0)
        nearest = gaps.min(axis=1)
        if sigma > 0:
            share = np.exp(-(gaps - nearest[:, None]) / sigma)
            whole = share.sum(axis=1)
            share /= whole[:, None]
            out[:k, 0] += share.sum(axis=0)
            out[:k, 1:] += share.T @ x
            out[k, 0] += (nearest - sigma * np.log(whole)).sum()
        out[k, 1] += nearest.sum()

    sums = summed(points, dim, k + 1, dim + 1, add)
    return sums[:k, 0], sums[:k, 1:], float(sums[k, 0]), float(sums[k, 1])


def principal_tree(
    points: DataFrame,
    k: int,
    seed: int = 55,
    smooth: float = 1.0,
    sigma: float | None = None,
    rounds: int = 30,
    history: list[float] | None = None,
) -> Tree:
    """A tree that follows the middle of the cells, by reverse graph embedding.

    The objective is the soft k-means free energy of the cells, with bandwidth ``sigma`` (by default the mean squared distance to
    the nearest k-means centre), plus half of ``smooth`` × cells / k times the squared lengths of the tree's edges. A round takes
    one aggregate of soft shares, solves for all centres at once (the shares' weights plus the tree's Laplacian), and spans a new
    tree over them; each of the three steps can only lower the objective, which ``history`` collects. Rounds end when it falls
    by less than a ten-thousandth. ``points`` are read once a round, so write them before where they are costly.
    """
    tree = fit_tree(points, k, seed)
    k = len(tree.centres)
    _, _, _, spread = _soft_sums(points, tree.centres, 0.0)
    n = points.count()
    if not n or spread <= 0:
        return tree
    sigma = sigma if sigma is not None else spread / n
    pull = smooth * n / k
    before = np.inf
    for _ in range(rounds):
        weight, sums, energy, _ = _soft_sums(points, tree.centres, sigma)
        now = energy + pull / 2 * sum(tree.length(e) ** 2 for e in tree.edges)
        if history is not None:
            history.append(now)
        if before - now <= 1e-4 * abs(now):
            break
        before = now
        laplacian = np.diag(weight)
        for a, b in tree.edges:
            laplacian[[a, b], [a, b]] += pull / 2
            laplacian[[a, b], [b, a]] -= pull / 2
        tree = spanning_tree(np.linalg.solve(laplacian, sums))
    return tree


def project_cells(points: DataFrame, tree: Tree) -> DataFrame:
    """Nearest tree edge of every cell, the position on it (0 at its first end), and the nearest vertex."""
    kind = dict(points.dtypes)["cell_id"]
    centres, edges = tree.centres, np.array(tree.edges, dtype=int).reshape(-1, 2)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = centres[edges[:, 0]]
        along = centres[edges[:, 1]] - start
        square = np.maximum((along**2).sum(axis=1), 1e-300)
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack([np.asarray(v, dtype=float) for v in pdf["values"]])
            to_vertex = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
            share = np.clip(((x[:, None, :] - start) * along).sum(axis=2) / square, 0.0, 1.0)
            foot = start + share[:, :, None] * along
            best = ((x[:, None, :] - foot) ** 2).sum(axis=2).argmin(axis=1)
            yield pd.DataFrame(
                {
                    "cell_id": pdf["cell_id"],
                    "vertex": to_vertex.argmin(axis=1),
                    "edge": best,
                    "share": share[np.arange(len(best)), best],
                }
            )

    return points.select("cell_id", "values").mapInPandas(
        project, f"cell_id {kind}, vertex int, edge int, share double"
    )


def root_vertex(cells: DataFrame, col: str, root_type) -> DataFrame:
    """The vertex that is closest to most cells of one type; ties go to the first vertex."""
    counts = cells.where(F.col(col) == F.lit(root_type)).groupBy("vertex").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "vertex").limit(1)


def _per_edge(values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("edge") + 1)


def _walk(tree: Tree, root: int):
    """Vertices in walking order from the root, with the vertex each was reached from."""
    around = tree.neighbours()
    order, seen = [(root, None)], {root}
    for v, _ in order:
        for w in sorted(around[v]):
            if w not in seen:
                seen.add(w)
                order.append((w, v))
    return order


def pseudotime(projected: DataFrame, tree: Tree, root: int) -> DataFrame:
    """Distance along the tree from the root to each cell's place on it."""
    distance = {root: 0.0}
    for v, before in _walk(tree, root)[1:]:
        distance[v] = distance[before] + tree.length((before, v))
    start = [distance[a] for a, _ in tree.edges]
    signed = [distance[b] - distance[a] for a, b in tree.edges]
    return projected.withColumn("pseudotime", _per_edge(start) + F.col("share") * _per_edge(signed))


def trajectory_states(projected: DataFrame, tree: Tree, root: int) -> DataFrame:
    """Segment number of each cell; a new segment starts at the root and behind every branch point."""
    degree = [len(around) for around in tree.neighbours()]
    state: dict[tuple[int, int], int] = {}
    into: dict[int, int] = {}
    for v, before in _walk(tree, root)[1:]:
        same = before in into and degree[before] == 2
        into[v] = into[before] if same else max(into.values(), default=0) + 1
        state[(min(v, before), max(v, before))] = into[v]
    numbers = [state[(min(e), max(e))] for e in tree.edges]
    return projected.withColumn("state", _per_edge(numbers))


def _above(tree: Tree, root: int) -> dict[int, int | None]:
    """Every vertex with the one before it on the way from the root."""
    return dict(_walk(tree, root))


def branch_paths(tree: Tree, root: int) -> list[tuple[int, int, int]]:
    """(branch_point, side, edge): the edges that belong to each side of each branch point, seen from the root.

    A side is one of the ways on from a branch point: all edges behind it, and the edges from the root up to the branch point,
    which every side shares. Sides are numbered in walking order. A tree of k centres has at most k²/2 such rows.
    """
    above = _above(tree, root)
    number = {(min(e), max(e)): i for i, e in enumerate(tree.edges)}

    def edge(v: int) -> int:
        return number[(min(v, above[v]), max(v, above[v]))]

    children: dict[int, list[int]] = {v: [] for v in above}
    for v, before in above.items():
        if before is not None:
            children[before].append(v)
    out = []
    for point in tree.branch_points():
        if point not in above:
            continue
        shared, v = [], point
        while above[v] is not None:
            shared.append(edge(v))
            v = above[v]
        for side, child in enumerate(sorted(children[point])):
            below, todo = [], [child]
            while todo:
                v = todo.pop()
                below.append(edge(v))
                todo += children[v]
            out += [(point, side, e) for e in sorted(shared + below)]
    return out


def branch_members(projected: DataFrame, tree: Tree, root: int) -> DataFrame:
    """branch_point, side, cell_id, pseudotime: the cells of every side of every branch point, in one table.

    Cells before a branch point are on all its sides; cells of other branches are on none. ``projected`` is the outcome of
    ``project_cells``. A tree without branch points gives no rows.
    """
    paths = projected.sparkSession.createDataFrame(branch_paths(tree, root), "branch_point int, side int, edge int")
    timed = pseudotime(projected, tree, root).select("cell_id", "edge", "pseudotime")
    # the paths have a row per side and edge of a tree of few centres, so they are small whatever the number of cells
    return timed.join(F.broadcast(paths), "edge").select("branch_point", "side", "cell_id", "pseudotime")
