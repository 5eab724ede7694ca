"""Exact neighbour search over an embedding, without comparing every pair of rows.

Points are grouped around a bounded set of pivots, the centres of a bounded sample; groups that lie near each other make up
parts of a fixed number of bytes, and a group too large for one is split. First every part meets itself, which gives each of
its points a bound of the distance that matters. Then two parts meet in one task for both directions, and only points
travel there that the triangle inequality cannot rule out (the pivot method for k-nearest-neighbour joins, Lu et al. 2012).
So a point is copied once per part it may have to do with, never once per block of its candidates, and only a few parts
away at a time: what lies on disk at once is a few copies of the points, whatever their number.

Inside a task groups are passed over by the same rule. A pair's distance is bounded from below by its distance along the
sample's first principal axes together with the difference of what the two points have off those axes; where that lets many
pairs through, by the matrix product of all columns, less what rounding can be. Only pairs within those bounds are measured
from their differences, and only a query's best candidates leave a task. The answer does not depend on sample, pivots, axes,
blocks or parts.

``points`` has ``cell_id`` and ``values`` (array of numbers).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from guidescape.runtime import checkpointed, discard_shuffles, importable, release

BLOCK_ROWS = 256
MAX_PIVOTS = 1024
SAMPLE = 1024  # points at least that pivots and axes are taken from, as far as they hold no more than SAMPLE_VALUES numbers
SAMPLE_VALUES = 1 << 22
AXES = 16
PART_VALUES = 1 << 22  # numbers of a part's points, and
PART_ROWS = 1 << 16  # points of a part
TILE_VALUES = 1 << 20  # pairs looked at together
# guards the pruning comparisons against rounding; candidates are always decided on exact distances
SLACK = 1e-9
# of the squared lengths: far more than rounding does to squares and products of this size
DOUBT = 1e-10
AXES_DOUBT = 1e-7
# Where the axes let a larger share of a tile's pairs through, the product of all columns is the cheaper bound.
FEW = 1 / 8


@dataclass
class Layout:
    """Points placed in parts, with the bounded facts that pruning needs."""

    placed: DataFrame  # cell_id, vector, weight, pivot, part
    pivots: np.ndarray  # pivot positions
    frame: tuple[np.ndarray, np.ndarray]  # mean of the sample and its first principal axes
    radius: np.ndarray  # farthest member of each pivot
    held: np.ndarray  # members of each pivot
    spans: np.ndarray  # pivots x parts: whether the part may hold members of the pivot
    block_rows: int
    id_type: str


def _matrix(rows) -> np.ndarray:
    return np.stack([np.asarray(r, dtype=float) for r in rows])


def _packed(matrix: np.ndarray) -> list[bytes]:
    """Rows as bytes: single precision where that loses nothing in any of them."""
    with np.errstate(over="ignore"):
        short = matrix.astype(np.float32)
    return [row.tobytes() for row in (short if (short == matrix).all() else matrix)]


def _unpacked(rows, dim: int) -> np.ndarray:
    """Rows of ``_packed``; their length tells the precision."""
    if len({len(r) for r in rows}) > 1:
        return _matrix([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64) for r in rows])
    kind = np.float32 if len(rows[0]) == 4 * dim else np.float64
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), dim).astype(float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances from exact differences, a few rows at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        gap = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def _measured(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Euclidean distances of the listed pairs from exact differences, a few pairs at a time."""
    out = np.empty(len(rows))
    step = max(1, 1_000_000 // max(1, a.shape[1]))
    for i in range(0, len(rows), step):
        gap = a[rows[i : i + step]] - b[columns[i : i + step]]
        out[i : i + step] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _centres(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` centres of a sample: points far from each other, then moved to the means of what is nearest to them."""
    chosen, gaps = [0], _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(k, len(sample)):
        chosen.append(int(gaps.argmax()))
        gaps = np.minimum(gaps, _distances(sample, sample[chosen[-1:]])[:, 0])
    centres = sample[chosen]
    for _ in range(4):
        own = _distances(sample, centres).argmin(axis=1)
        held = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


def _chain(pivots: np.ndarray) -> np.ndarray:
    """An order in which every pivot is followed by the nearest one not yet named."""
    order, left = [0], np.ones(len(pivots), dtype=bool)
    left[0] = False
    while left.any():
        gaps = _distances(pivots[order[-1] :][:1], pivots)[0]
        order.append(int(np.where(left, gaps, np.inf).argmin()) if np.isfinite(gaps[left]).any() else int(left.argmax()))
        left[order[-1]] = False
    return np.array(order)


def _principal_axes(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sample's mean, and orthonormal columns along which it varies most."""
    middle = sample.mean(axis=0)
    _, _, vt = np.linalg.svd(sample - middle, full_matrices=False)
    return middle, vt[:AXES].T


def _sides(a: np.ndarray, squares: np.ndarray, doubt: float) -> tuple[np.ndarray, np.ndarray]:
    """Left and right factor whose product is the squared distance of two rows, less ``doubt`` of their squared lengths."""
    one, less = np.ones((len(a), 1)), (squares * (1 - doubt))[:, None]
    return np.hstack([-2 * a, less, one]), np.hstack([a, one, less])


class _Cloud:
    """Points of a task: positions, and the factors of both lower bounds, worked out a set of rows at a time."""

    def __init__(self, matrix: np.ndarray, frame: tuple[np.ndarray, np.ndarray]):
        middle, axes = frame
        self.at = matrix
        self.centred = matrix - middle
        self.squares = np.einsum("ij,ij->i", self.centred, self.centred)
        along = self.centred @ axes
        off = np.sqrt(np.maximum(self.squares - np.einsum("ij,ij->i", along, along), 0.0))
        self.short = np.hstack([along, off[:, None]])
        self.axes_help = matrix.shape[1] > 2 * self.short.shape[1]
        self.skip = 0  # tiles to go before the axes are tried again
        self.measured = 0

    def lower(self, rows: np.ndarray, columns: np.ndarray, by_axes: bool) -> np.ndarray:
        """Lower bounds of squared distances."""
        wide, doubt = (self.short, AXES_DOUBT) if by_axes else (self.centred, DOUBT)
        left, _ = _sides(wide[rows], self.squares[rows], doubt)
        _, right = _sides(wide[columns], self.squares[columns], doubt)
        return left @ right.T

    def near(
        self, rows: np.ndarray, columns: np.ndarray, reach: np.ndarray, back: np.ndarray | None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that may lie within ``reach`` of their row or ``back`` of their column: row, column, exact distance."""
        limit = _limit(reach)[:, None]
        limits = [limit] if back is None else [limit, _limit(back)[None, :]]

        def passing(by_axes: bool) -> np.ndarray:
            square = self.lower(rows, columns, by_axes)
            hit = square <= limits[0]
            if back is not None:
                hit |= square <= limits[1]
            return np.flatnonzero(hit)

        hits = None
        if self.axes_help and not self.skip:
            hits = passing(True)
            if len(hits) > FEW * len(rows) * len(columns):
                hits, self.skip = None, 32
            else:
                self.measured += len(hits)
        if hits is None:
            self.skip = max(0, self.skip - 1)
            hits = passing(False)
            self.measured += len(rows) * len(columns)
        r, c = rows[hits // len(columns)], columns[hits % len(columns)]
        return r, c, _measured(self.at, self.at, r, c)


def _limit(reach: np.ndarray) -> np.ndarray:
    return (reach * (1 + SLACK) + SLACK) ** 2


def _near(a: np.ndarray, b: np.ndarray, frame: tuple[np.ndarray, np.ndarray], reach: np.ndarray) -> np.ndarray:
    """Distances of the pairs that may lie within ``reach`` of their row; infinite for those that a lower bound rules out."""
    cloud = _Cloud(np.concatenate([a, b]), frame)
    r, c, distance = cloud.near(np.arange(len(a)), np.arange(len(a), len(a) + len(b)), reach, None)
    out = np.full((len(a), len(b)), np.inf)
    out[r, c - len(a)] = distance
    return out


def _codes(ids: pd.Series) -> np.ndarray:
    """Whole numbers in the order of the ids; equal ids share one, ids that are null have one each, behind all others."""
    known = ids.notna().to_numpy()
    codes = len(ids) + np.arange(len(ids))
    if known.any():
        codes[known] = np.unique(ids.to_numpy()[known], return_inverse=True)[1]
    return codes


def _listed(values: pd.Series, kind: str) -> list:
    """Plain values; whole numbers that pandas made floats because some are null become whole again."""
    whole = kind in ("tinyint", "smallint", "int", "bigint") and values.dtype.kind == "f"
    return [None if v is None or v != v else int(v) if whole else v for v in values.tolist()]


def lay_out(points: DataFrame, block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS) -> Layout:
    """Assign every point to a pivot near it and the groups to parts.

    A ``weight`` column, if present, travels with the points.
    """
    slim = points.select(
        "cell_id",
        F.transform("values", lambda v: v.cast("double")).alias("values"),
        (F.col("weight") if "weight" in points.columns else F.lit(0.0)).cast("double").alias("weight"),
    )
    id_type = dict(slim.dtypes)["cell_id"]
    n, dim = slim.agg(F.count(F.lit(1)), F.max(F.size("values"))).first()
    wanted = max(1, min(max_pivots, math.ceil(n / block_rows)))
    size = max(1, min(max(wanted, SAMPLE), SAMPLE_VALUES // max(dim or 1, 1)))
    sample = slim.orderBy(F.xxhash64("cell_id"), "cell_id").limit(size).select("values").collect()
    sample = _matrix([r["values"] for r in sample])
    pivots, frame = _centres(sample, wanted), _principal_axes(sample)
    pivots = pivots[_chain(pivots)]

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = 0
        for pdf in batches:
            if pdf.empty:
                continue
            matrix = _matrix(pdf["values"])
            best = (np.einsum("ij,ij->i", pivots, pivots) - 2 * matrix @ pivots.T).argmin(axis=1)
            gap = _measured(matrix, pivots, np.arange(len(best)), best)
            spread = (first + np.arange(len(best))) * 0.6180339887498949 % 1  # even over any run of rows
            first += len(best)
            out = pdf[["cell_id", "weight"]].assign(vector=_packed(matrix), pivot=best.astype("int32"), gap=gap)
            yield out.assign(spread=spread)[["cell_id", "vector", "weight", "pivot", "gap", "spread"]]

    schema = f"cell_id {id_type}, vector binary, weight double, pivot int, gap double, spread double"
    placed = checkpointed(slim.mapInPandas(nearest, schema))
    stats = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("r")).collect()
    held = np.zeros(len(pivots), dtype=int)
    radius = np.zeros(len(pivots))
    for row in stats:
        held[row["pivot"]] = row["n"]
        radius[row["pivot"]] = row["r"]
    parts = _part_count(points.sparkSession.sparkContext.defaultParallelism, n, dim, block_rows)
    ends = held.cumsum()
    starts = ends - held
    each = n / parts
    low, high = (starts / each).astype(int), (np.maximum(starts, ends - 1e-6) / each).astype(int)
    number = np.arange(parts)
    spans = (number >= low[:, None] - 1) & (number <= high[:, None] + 1) & (held > 0)[:, None]
    start, own = (F.element_at(F.array(*[F.lit(int(x)) for x in v]), F.col("pivot") + 1) for v in (starts, held))
    part = F.least(F.floor((start + F.col("spread") * own) / F.lit(each)), F.lit(parts - 1)).cast("int")
    table = placed.select("cell_id", "vector", "weight", "pivot", part.alias("part"))
    table._written_to = placed._written_to
    return Layout(table, pivots, frame, radius, held, spans, block_rows, id_type)


def _part_count(cores: int, n: int, dim: int, block_rows: int) -> int:
    """An odd number, so that parts meet along a ring: as many as memory asks for, or as keep the cores busy."""
    busy = math.ceil((1 + math.sqrt(1 + 8 * cores)) / 2)
    return max(math.ceil(n * max(dim or 1, 1) / PART_VALUES), math.ceil(n / PART_ROWS), min(busy, n // (4 * block_rows))) | 1


def _apart(spark: SparkSession, n: int) -> list[int]:
    """``n`` keys of which Spark's hash puts no two into the same of ``n`` partitions, as far as such are soon found."""
    most = int(n * (math.log(n) + 8)) + 8
    rows = spark.sql(f"select pmod(hash(k), {n}) as p, k from (select explode(sequence(0, {most})) as k)").collect()
    by_place = {}
    for row in rows:
        by_place.setdefault(row["p"], row["k"])
    return [*by_place.values(), *range(-1, -1 - n, -1)][:n]


class _Task:
    """What a kernel works on: the points of one or two parts, sorted into blocks of one part and pivot each."""

    def __init__(self, layout: dict, pdf: pd.DataFrame):
        self.layout = layout
        pdf = pdf.sort_values(["part", "pivot"], kind="stable").reset_index(drop=True)
        self.rows = pdf
        self.cloud = _Cloud(_unpacked(pdf["vector"], layout["pivots"].shape[1]), layout["frame"])
        self.code = _codes(pdf["cell_id"])
        self.weight = pdf["weight"].to_numpy(dtype=float)
        self.part = pdf["part"].to_numpy()
        pivot = pdf["pivot"].to_numpy()
        cuts = np.flatnonzero((np.diff(self.part) != 0) | (np.diff(pivot) != 0)) + 1
        self.blocks = [
            piece
            for group in np.split(np.arange(len(pdf)), cuts)
            for piece in np.array_split(group, math.ceil(len(group) / layout["block_rows"]))
        ]
        self.pivot_of = np.array([pivot[b[0]] for b in self.blocks])
        self.part_of = np.array([self.part[b[0]] for b in self.blocks])

    def near_pivots(self, rows: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """rows x pivots: whether a member of the pivot may lie within reach of the row."""
        pivots, middle = self.layout["pivots"], self.layout["frame"][0]
        at = pivots - middle
        left, _ = _sides(self.cloud.centred[rows], self.cloud.squares[rows], DOUBT)
        _, right = _sides(at, np.einsum("ij,ij->i", at, at), DOUBT)
        gaps = np.sqrt(np.maximum(left @ right.T, 0.0))
        return (gaps - self.layout["radius"] <= (reach * (1 + SLACK) + SLACK)[:, None]) & (self.layout["held"] > 0)

    def tiles(self, reach: np.ndarray, across: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and columns of different blocks that have to meet; ``across`` only blocks of different parts."""
        asks = np.stack([self.near_pivots(b, reach[b]).any(axis=0)[self.pivot_of] for b in self.blocks])
        asks |= asks.T
        for i, rows in enumerate(self.blocks):
            later = [j for j in range(i + 1, len(self.blocks)) if asks[i, j] and not (across and self.part_of[i] == self.part_of[j])]
            if later:
                columns = np.concatenate([self.blocks[j] for j in later])
                step = max(1, TILE_VALUES // len(rows))
                for at in range(0, len(columns), step):
                    yield rows, columns[at : at + step]


class _Nearest:
    """Kernel that keeps the ``k`` nearest allowed points of every point; ties go to the smaller id."""

    def __init__(self, task: _Task, k: int, reach: np.ndarray, denser: bool):
        self.task, self.k, self.denser = task, k, denser
        self.reach = reach * (1 + SLACK) + SLACK  # the bound may have been summed in another order
        self.gap = np.full((len(reach), k), np.inf)
        self.at = np.full((len(reach), k), -1)

    def allowed(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        code, weight = self.task.code, self.task.weight
        if not self.denser:  # an id that is null equals none, its own neither
            return (code[r] != code[c]) | (code[r] >= len(code))
        return (weight[c] > weight[r]) | ((weight[c] == weight[r]) & (code[c] < code[r]))

    def keep(self, r: np.ndarray, c: np.ndarray, gap: np.ndarray) -> None:
        fits = gap <= self.reach[r]
        r, c, gap = r[fits], c[fits], gap[fits]
        fits = self.allowed(r, c)
        r, c, gap = r[fits], c[fits], gap[fits]
        if not len(r):
            return
        touched = np.unique(r)
        r, c = np.concatenate([r, np.repeat(touched, self.k)]), np.concatenate([c, self.at[touched].ravel()])
        gap = np.concatenate([gap, self.gap[touched].ravel()])
        order = np.lexsort((self.task.code[c], gap, r))
        r, c, gap = r[order], c[order], gap[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        best = rank < self.k
        self.gap[r[best], rank[best]] = gap[best]
        self.at[r[best], rank[best]] = np.where(np.isfinite(gap[best]), c[best], -1)
        self.reach[touched] = np.minimum(self.reach[touched], self.gap[touched, -1])

    def inside(self, rows: np.ndarray) -> None:
        """A block with itself."""
        task, cloud = self.task, self.task.cloud
        if not self.denser and len(rows) > self.k and np.isinf(self.reach[rows]).all():
            square = cloud.lower(rows, rows, False)
            square[task.code[rows][:, None] == task.code[rows][None, :]] = np.inf
            most = np.partition(square, self.k - 1, axis=1)[:, self.k - 1] + 4 * DOUBT * (cloud.squares[rows] + cloud.squares[rows].max())
            self.reach[rows] = np.sqrt(np.maximum(most, 0.0)) * (1 + SLACK) + SLACK
        self.keep(*cloud.near(rows, rows, self.reach[rows], None))

    def across(self, rows: np.ndarray, columns: np.ndarray) -> None:
        r, c, gap = self.task.cloud.near(rows, columns, self.reach[rows], self.reach[columns])
        self.keep(r, c, gap)
        self.keep(c, r, gap)

    def found(self) -> pd.DataFrame:
        row, rank = np.nonzero(self.at >= 0)
        ids = self.task.rows["cell_id"]
        return pd.DataFrame(
            {
                "src": ids.iloc[row].to_numpy(),
                "dst": ids.iloc[self.at[row, rank]].to_numpy(),
                "distance": self.gap[row, rank],
            }
        )


class _Sums:
    """Kernel that adds up exp(-(d/dc)²) over the other points within ``radius``, or over all in a tile where that is None."""

    def __init__(self, task: _Task, dc: float, reach: np.ndarray, radius: float | None):
        self.task, self.dc, self.reach, self.radius = task, dc, reach, radius
        self.rho = np.zeros(len(reach))

    def inside(self, rows: np.ndarray) -> None:
        self.meet(rows, rows, False)

    def across(self, rows: np.ndarray, columns: np.ndarray) -> None:
        self.meet(rows, columns, True)

    def meet(self, rows: np.ndarray, columns: np.ndarray, both: bool) -> None:
        code, cloud = self.task.code, self.task.cloud
        middle = cloud.at[rows].mean(axis=0)
        a, b = cloud.at[rows] - middle, cloud.at[columns] - middle
        square_a, square_b = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        reach = self.reach[0]
        # a product of all columns is as good as differences where the points are not large against dc
        rough = 1e-16 * a.shape[1] * (square_a.max() + square_b.max()) / self.dc**2
        close = np.sqrt(square_b) <= reach + np.sqrt(square_a.max())
        if self.radius is None and rough < 1e-11 and close.mean() > FEW:
            left, _ = _sides(a / self.dc, square_a / self.dc**2, 0.0)
            _, right = _sides(b / self.dc, square_b / self.dc**2, 0.0)
            share = left @ -right.T
            np.exp(share, out=share)
            same = np.flatnonzero(np.isin(code[columns], code[rows]))
            if len(same):
                share[:, same] *= code[rows][:, None] != code[columns][same][None, :]
            if not both:
                own = code[rows] >= len(code)  # an id that is null equals none, its own neither
                share[own, own] = 1.0
            cloud.measured += share.size
            self.rho[rows] += share.sum(axis=1)
            if both:
                self.rho[columns] += share.sum(axis=0)
            return
        r, c, gap = cloud.near(rows, columns, self.reach[rows], None)
        other = (gap <= reach) & ((code[r] != code[c]) | (code[r] >= len(code)))
        r, c = r[other], c[other]
        share = np.exp(-((gap[other] / self.dc) ** 2))
        self.rho += np.bincount(r, share, len(self.rho))
        if both:
            self.rho += np.bincount(c, share, len(self.rho))

    def found(self) -> pd.DataFrame:
        return pd.DataFrame({"cell_id": self.task.rows["cell_id"].to_numpy(), "rho": self.rho})


def _search(
    layout: Layout,
    bound: Callable[[np.ndarray, np.ndarray], np.ndarray],
    kernel: Callable[[_Task, np.ndarray], _Nearest | _Sums],
    schema: str,
    measured: Accumulator | None = None,
) -> DataFrame:
    """What ``kernel`` finds in every part and in every two parts that may have to do with each other.

    ``bound(vectors, weights)`` gives an upper bound of the distance that matters for each point, or infinity; what a kernel
    finds in the point's own part lowers it. ``measured`` counts the pairs whose distance was worked out. Tables written on
    the way are deleted, that of the layout too.
    """
    spark = importable(layout.placed.sparkSession)
    parts = layout.spans.shape[1]
    spans = layout.spans.astype(np.float32)
    facts = {k: getattr(layout, k) for k in ("pivots", "frame", "radius", "held", "block_rows")}
    columns = dict(p.split(" ", 1) for p in schema.split(", "))
    lists = ", ".join(f"_{name} array<{kind}>" for name, kind in columns.items())
    carried = f"cell_id {layout.id_type}, vector binary, weight double, pivot int, part int"

    def count(cloud: _Cloud) -> None:
        if measured is not None:
            measured.add(int(cloud.measured))

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        task = _Task(facts, pdf)
        work = kernel(task, bound(task.cloud.at, task.weight))
        for rows in task.blocks:
            work.inside(rows)
        for tile in task.tiles(work.reach, False):
            work.across(*tile)
        count(task.cloud)
        # the pivots that the part's points ask for, and per point the parts
        asked, wanted = np.zeros(len(facts["pivots"]), dtype=bool), []
        for rows in task.blocks:
            near = task.near_pivots(rows, work.reach[rows])
            asked |= near.any(axis=0)
            wanted += [x.tobytes() for x in np.packbits(near.astype(np.float32) @ spans > 0, axis=1)]
        out = task.rows[["cell_id", "vector", "weight", "pivot", "part"]].assign(reach=work.reach, wanted=wanted, asked=None)
        out.loc[0, "asked"] = np.packbits(asked).tobytes()
        found = work.found()
        for name, kind in columns.items():
            out[f"_{name}"] = None
            out.at[0, f"_{name}"] = _listed(found[name], kind)
        return out

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        task = _Task(facts, pdf)
        work = kernel(task, task.rows["reach"].to_numpy(dtype=float))
        for tile in task.tiles(work.reach, True):
            work.across(*tile)
        count(task.cloud)
        return work.found()

    keys = F.element_at(F.array(*[F.lit(k) for k in _apart(spark, parts)]), F.col("part") + 1)
    dealt = layout.placed.withColumn("_task", keys).repartition(parts, "_task")
    state = checkpointed(
        dealt.groupBy("_task").applyInPandas(alone, f"{carried}, reach double, wanted binary, asked binary, {lists}")
    )
    release(layout.placed)
    firsts = state.where("asked is not null")
    own = firsts.select(F.explode(F.arrays_zip(*[f"_{name}" for name in columns])).alias("_f")).select(
        *[F.col(f"_f._{name}").alias(name) for name in columns]
    )
    results = [checkpointed(own)]
    asks = np.zeros((parts, len(layout.pivots)), dtype=bool)
    for row in firsts.select("part", "asked").collect():
        asks[row["part"]] = np.unpackbits(np.frombuffer(row["asked"], np.uint8))[: len(layout.pivots)]

    # parts on a ring meet those so many steps on; as many steps at once as keep the cores busy
    steps = np.arange(1, parts // 2 + 1)
    at_once = max(1, math.ceil(2 * spark.sparkContext.defaultParallelism / parts))
    for first in range(0, len(steps), at_once):
        now = steps[first : first + at_once]
        names = np.array(_apart(spark, len(now) * parts)).reshape(len(now), parts)

        def travel(batches: Iterator[pd.DataFrame], now=now, names=names) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                part, pivot = pdf["part"].to_numpy(), pdf["pivot"].to_numpy()
                bits = [np.frombuffer(w, np.uint8) for w in pdf["wanted"]]
                wanted = np.unpackbits(np.stack(bits), axis=1) if bits else np.zeros((0, parts), dtype=np.uint8)
                slim = pdf.drop(columns=["wanted"])
                for step, name in zip(now, names):
                    for ahead in (True, False):
                        other = (part + (step if ahead else -step)) % parts
                        goes = asks[other, pivot] | (wanted[np.arange(len(part)), other] > 0)
                        yield slim[goes].assign(_task=name[np.where(ahead, part, other)[goes]])

        moved = state.select("cell_id", "vector", "weight", "pivot", "part", "reach", "wanted").mapInPandas(
            travel, f"{carried}, reach double, _task long"
        )
        met = moved.repartition(names.size, "_task").groupBy("_task").applyInPandas(some, schema)
        results.append(checkpointed(met))
        del moved, met
        discard_shuffles(spark)
    release(state)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    out._parts = results
    return out


def _finished(found: DataFrame, result: DataFrame) -> DataFrame:
    """The written result, with what it was made of deleted."""
    written = checkpointed(result)
    release(*found._parts)
    discard_shuffles(written.sparkSession)
    return written


def knn(
    points: DataFrame,
    k: int,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
    measured: Accumulator | None = None,
) -> DataFrame:
    """The ``k`` nearest other cells of every cell: src, dst, distance, rank. Ties go to the smaller id.

    ``measured``, an accumulator, counts the pairs whose distance was worked out.
    """
    layout = lay_out(points, block_rows, max_pivots)
    kind = layout.id_type
    found = _search(
        layout,
        lambda matrix, weight: np.full(len(matrix), np.inf),
        lambda task, reach: _Nearest(task, k, reach, False),
        f"src {kind}, dst {kind}, distance double",
        measured,
    )
    order = Window.partitionBy("src").orderBy("distance", "dst")
    return _finished(found, found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def local_density(
    points: DataFrame, dc: float, radius: float | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """rho = Σ exp(−(d/dc)²) over other cells, or over those within ``radius``.

    Without ``radius`` pairs are left out only where even all cells together would add less than 1e-16 to a sum.
    """
    layout = lay_out(points, block_rows)
    reach = dc * math.sqrt(math.log(max(layout.held.sum(), 1)) + 16 * math.log(10)) if radius is None else radius
    found = _search(
        layout,
        lambda matrix, weight: np.full(len(matrix), float(reach)),
        lambda task, reach: _Sums(task, dc, reach, radius),
        f"cell_id {layout.id_type}, rho double",
    )
    return _finished(found, found.groupBy("cell_id").agg(F.sum("rho").alias("rho")))


def nearest_denser(points: DataFrame, rho: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For every cell the nearest cell of higher density (ties by smaller id): cell_id, rho, delta, parent.

    The densest cell has no parent; its delta is its distance to the farthest cell.
    """
    weighted = checkpointed(points.select("cell_id", "values").join(rho.withColumnRenamed("rho", "weight"), "cell_id"))
    layout = lay_out(weighted, block_rows)
    top = weighted.orderBy(F.desc("weight"), "cell_id").select("cell_id", "values", "weight").first()
    peak_id, peak = top["cell_id"], np.asarray(top["values"], dtype=float)
    # the densest member of each pivot group gives every query one denser point it can certainly reach
    leaders = (
        layout.placed.groupBy("pivot")
        .agg(F.max_by("vector", "weight").alias("v"), F.max("weight").alias("w"))
        .collect()
    )
    leader_at = _unpacked([r["v"] for r in leaders], len(peak))
    leader_weight = np.array([r["w"] for r in leaders])

    def bound(matrix, weight):
        out = np.sqrt(((matrix - peak) ** 2).sum(axis=1))
        for i in range(0, len(matrix), 1024):
            gaps = _distances(matrix[i : i + 1024], leader_at)
            gaps[leader_weight[None, :] <= weight[i : i + 1024, None]] = np.inf
            out[i : i + 1024] = np.minimum(gaps.min(axis=1), out[i : i + 1024])
        return out

    kind = layout.id_type
    found = _search(
        layout,
        bound,
        lambda task, reach: _Nearest(task, 1, reach, True),
        f"src {kind}, dst {kind}, distance double",
    )
    nearest = F.min(F.struct(F.col("distance").alias("delta"), F.col("dst").alias("parent")))
    best = found.groupBy(F.col("src").alias("cell_id")).agg(nearest.alias("_b"))

    def farthest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not pdf.empty:
                yield pd.DataFrame({"far": [_distances(_matrix(pdf["values"]), peak[None, :]).max()]})

    far = weighted.select(F.transform("values", lambda v: v.cast("double")).alias("values")).mapInPandas(
        farthest, "far double"
    )
    reach = far.agg(F.max("far").alias("_far")).scalar()
    out = weighted.select("cell_id", F.col("weight").alias("rho")).join(best, "cell_id", "left")
    delta = F.when(F.col("cell_id") == F.lit(peak_id), reach).otherwise(F.col("_b.delta"))
    result = out.select("cell_id", "rho", delta.alias("delta"), F.col("_b.parent").alias("parent"))
    result = _finished(found, result)
    release(weighted)
    return result
