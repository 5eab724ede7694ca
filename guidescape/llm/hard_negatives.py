"""Hard negatives of anchor vectors, found along a spanning tree of the anchors.

An anchor's positives are its best-scoring other rows of the same label; for each positive, its hard negatives are the
best-scoring rows of other labels whose score lies within a window below the positive's score. Scores are inner products of
the vectors' components times 256, rounded down: whole numbers, so that ties and window ends are exact.

Anchors of a block are joined by a minimum spanning tree that also holds the origin, its root, where every score is 0. Along
an edge a score changes by at most the edge's length times the candidate's norm, so a parent's score, exact or itself bounded,
bounds the child's. Only candidates whose bounds reach what is still wanted - the k-th best positive so far, or the windows
above the third best negative so far - are scored exactly; whatever the bounds rule out cannot be in the result.

Anchors and candidates are cut into blocks of bounded size, and every block of anchors meets every block of candidates (of its
label, for positives) in a task of its own: a hot label or a long table only makes more blocks. A task keeps the few best of
each anchor, a second step the best of those. Exact whatever the data; how much is ruled out depends on how close anchors lie.
With n rows and n/50 anchors the work grows with n², as the question does: all anchors against all rows.

Defined cases: rows with a null label, a null vector or any null or non-finite component take no part. Vectors of different
lengths are compared as if the shorter ended in zeros; an empty vector scores 0. Rows without id are never anchors and come
last among equal scores. Components beyond 1e98 count as 1e98. Repeated rows take part one by one, as candidates, as anchors (with results of their own) and as
"other rows" of their copies. Scores beyond 64 bits count as the largest or smallest 64-bit number. An anchor without other
rows of its label has no rows, nor has a positive whose window is empty. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from guidescape.runtime import checkpointed, importable

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
CANDIDATE_VALUES, ANCHOR_VALUES = 1 << 22, 1 << 18  # numbers held by a block of candidates, and of anchors
SEGMENT = 8192  # candidates bounded at a time

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


# --- inside a task ---------------------------------------------------------------------------------------------------


def whole(vectors: pd.Series) -> np.ndarray:
    """Components × 256, rounded down, one row per vector, zeros behind the shorter ones."""
    lengths = np.fromiter(map(len, vectors), int, len(vectors))
    out = np.zeros((len(vectors), max(lengths.max(initial=0), 1)))
    filled = np.arange(out.shape[1]) < lengths[:, None]
    out[filled] = np.concatenate([*(np.asarray(v, float) for v in vectors), np.empty(0)])
    return np.floor(np.clip(out, -1e98, 1e98) * 256.0)


def exact_scores(vectors: np.ndarray, norms: np.ndarray, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of the chosen vectors with one anchor, as 64-bit numbers."""
    width = min(vectors.shape[1], len(anchor))
    bound = norms.max(initial=0.0) * np.linalg.norm(anchor)
    if bound < 2.0**53:  # sums of whole numbers below 2^53 are exact in any order
        if 4 * len(at) > len(vectors):
            return (vectors[:, :width] @ anchor[:width])[at].astype(np.int64)
        return (vectors[at, :width] @ anchor[:width]).astype(np.int64)
    whole_anchor = [int(x) for x in anchor[:width]]
    sums = (sum(int(x) * y for x, y in zip(vectors[i, :width], whole_anchor)) for i in at)
    return np.fromiter((min(max(s, _LEAST), _MOST) for s in sums), np.int64, len(at))


@dataclass
class Tree:
    """Anchors in the order in which they are visited; ``store`` is where a node's bounds are kept, ``source`` its parent's."""

    order: np.ndarray
    edge: np.ndarray
    store: np.ndarray
    source: np.ndarray


def spanning_tree(anchors: np.ndarray) -> Tree:
    """Minimum spanning tree of the anchors and the origin, grown from the origin.

    A node's largest subtree is visited last, in its own place, so only about log2(anchors) sets of bounds exist at a time.
    """
    points = np.vstack([np.zeros((1, anchors.shape[1])), anchors])
    n = len(points)
    parent, gap, open_ = np.zeros(n, int), np.full(n, np.inf), np.ones(n, bool)
    grown, v = [0], 0
    open_[0] = False
    for _ in range(n - 1):
        step = np.linalg.norm(points - points[v], axis=1)
        nearer = open_ & (step < gap)
        gap[nearer], parent[nearer] = step[nearer], v
        v = int(np.argmin(np.where(open_, gap, np.inf)))
        open_[v] = False
        grown.append(v)
    weight = np.ones(n, int)
    for v in reversed(grown[1:]):
        weight[parent[v]] += weight[v]
    children: list[list[int]] = [[] for _ in range(n)]
    for v in grown[1:]:
        children[parent[v]].append(v)
    order, store, source, todo = [], [], [], [(0, 0, 0)]
    while todo:
        v, place, before = todo.pop()
        order.append(v), store.append(place), source.append(before)
        below = sorted(children[v], key=lambda c: weight[c])
        todo += [(c, place if c == below[-1] else place + 1, place) for c in reversed(below)]
    at = np.array(order[1:])
    return Tree(at - 1, gap[at], np.array(store[1:]), np.array(source[1:]))


def walk(tree: Tree, anchors: np.ndarray, vectors: np.ndarray, norms: np.ndarray, wanted, take) -> int:
    """Bound every candidate at every anchor, score those that ``wanted`` asks for, hand them to ``take``; count them."""
    longest = np.linalg.norm(anchors, axis=1).max(initial=0.0)
    slack = norms * (longest * 1e-14)  # rounding of the bounds
    low = np.zeros((tree.store.max(initial=0) + 1, len(vectors)))
    high = np.zeros_like(low)
    scored = 0
    for i, edge, place, before in zip(tree.order, tree.edge, tree.store, tree.source):
        reach = edge * norms + slack
        np.subtract(low[before], reach, out=low[place])
        np.add(high[before], reach, out=high[place])
        at = np.flatnonzero(wanted(i, low[place], high[place]))
        if len(at):
            found = exact_scores(vectors, norms, anchors[i], at)
            low[place, at] = high[place, at] = found
            take(i, at, found)
            scored += len(at)
    return scored


class Best:
    """The ``k`` rows with the highest scores so far, ties by id, rows without id last."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.empty((0, 4), np.int64)  # score, no id, id, index

    @property
    def least(self) -> int:
        """What a score must reach to matter."""
        return int(self.rows[-1, 0]) if len(self.rows) == self.k else _LEAST

    def add(self, scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray, index: np.ndarray) -> None:
        if len(scores) > self.k:
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, no_id, ids, index = scores[keep], no_id[keep], ids[keep], index[keep]
        rows = np.vstack([self.rows, np.column_stack([scores, no_id, ids, index]).astype(np.int64)])
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], ~rows[:, 0]))][: self.k]


def window(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest whole score between ``low`` and ``high`` per cent of the positive's."""
    return -(-low * positive // 100), high * positive // 100


class Block:
    """Candidates of one task."""

    def __init__(self, pdf: pd.DataFrame):
        self.row = pdf["_row"].to_numpy(np.int64)
        self.no_id = pdf["vec_id"].isna().to_numpy()
        self.ids = pdf["vec_id"].fillna(0).astype("int64").to_numpy()
        self.label = pdf["_label"].to_numpy()
        self.vectors = whole(pdf["_vector"])
        self.norms = np.linalg.norm(self.vectors, axis=1)

    def segments(self):
        return (slice(at, at + SEGMENT) for at in range(0, len(self.row), SEGMENT))

    def named(self, found: pd.DataFrame) -> pd.DataFrame:
        """Ids for the candidates' positions in this block."""
        at = found["vec_id"].to_numpy(np.int64)
        return found.assign(vec_id=pd.arrays.IntegerArray(self.ids[at], self.no_id[at]))


def _tree_of(pdf: pd.DataFrame) -> tuple[Tree, np.ndarray]:
    """The tree in visiting order; rows of ``pdf`` must be sorted by ``_step``."""
    tree = Tree(np.arange(len(pdf)), *(pdf[c].to_numpy() for c in ("_edge", "_store", "_source")))
    return tree, whole(pdf["_vector"])


def _frame(found: list[tuple[np.ndarray, ...]], columns: list[str]) -> pd.DataFrame:
    parts = [np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(len(columns))]
    return pd.DataFrame(dict(zip(columns, parts)))


def best_positives(anchors: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """(_anchor, vec_id, score): the ``k`` best other rows of a block for each anchor; all are of one label."""
    if anchors.empty or candidates.empty:
        return _frame([], ["_anchor", "vec_id", "score"])
    anchors = anchors.sort_values("_step")
    tree, points = _tree_of(anchors)
    own = anchors["_row"].to_numpy()
    block, best = Block(candidates), [Best(k) for _ in own]
    for part in block.segments():
        rows, no_id, ids = block.row[part], block.no_id[part], block.ids[part]
        index = np.arange(len(block.row))[part]

        def wanted(i, low, high):
            return (high >= best[i].least) & (rows != own[i])

        def take(i, at, scores):
            best[i].add(scores, no_id[at], ids[at], index[at])

        walk(tree, points, block.vectors[part], block.norms[part], wanted, take)
    found = [(np.full(len(b.rows), row), b.rows[:, 3], b.rows[:, 0]) for row, b in zip(own, best)]
    return block.named(_frame(found, ["_anchor", "vec_id", "score"]))


def best_negatives(anchors: pd.DataFrame, candidates: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    """(_anchor, place, vec_id, score): for each anchor and positive the ``k`` best rows of a block within its window."""
    columns = ["_anchor", "place", "vec_id", "score"]
    if anchors.empty or candidates.empty:
        return _frame([], columns)
    anchors = anchors.sort_values("_step")
    tree, points = _tree_of(anchors)
    label = anchors["_label"].to_numpy()
    windows = [[window(int(s), low, high) for s in scores] for scores in anchors["_scores"]]
    top = np.array([max((b for _, b in w), default=_LEAST) for w in windows], float)
    block, best = Block(candidates), [[Best(k) for _ in w] for w in windows]
    for part in block.segments():
        other, no_id, ids = block.label[part], block.no_id[part], block.ids[part]
        index = np.arange(len(block.row))[part]

        def wanted(i, least, most):
            if not windows[i]:
                return np.zeros(len(least), bool)
            floor = min(max(a, b.least) for (a, _), b in zip(windows[i], best[i]))
            return (most >= floor) & (least <= top[i]) & (other != label[i])

        def take(i, at, scores):
            for (a, b), kept in zip(windows[i], best[i]):
                inside = np.flatnonzero((scores >= max(a, kept.least)) & (scores <= b))
                if len(inside):
                    kept.add(scores[inside], no_id[at[inside]], ids[at[inside]], index[at[inside]])

        walk(tree, points, block.vectors[part], block.norms[part], wanted, take)
    found = []
    for row, kept in zip(anchors["_row"], best):
        for place, b in enumerate(kept):
            found.append((np.full(len(b.rows), row), np.full(len(b.rows), place), b.rows[:, 3], b.rows[:, 0]))
    return block.named(_frame(found, columns))


# --- in Spark --------------------------------------------------------------------------------------------------------


def participants(rows: DataFrame, label: Column, anchor: Column) -> DataFrame:
    """_row, vec_id, _label, _vector, _anchor of the rows that take part, written once so that row numbers stay."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    chosen = rows.where(label.isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("_row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        label.alias("_label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("_vector"),
        F.coalesce(anchor, F.lit(False)).alias("_anchor"),
    )
    return checkpointed(chosen)


def _blocks(rows: DataFrame, by: list[str], dim: int, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Anchors with their tree, repeated for every block of candidates, and candidates repeated for every block of anchors.

    Both carry ``by``, _a and _c: the block of anchors and that of candidates. Blocks are of bounded size within ``by``.
    """
    per_a, per_c = max(64, ANCHOR_VALUES // dim), max(256, CANDIDATE_VALUES // dim)
    rows = rows.withColumn("_all", F.pmod("_row", F.lit(1)))  # one group of all rows
    sizes = rows.groupBy(*by).agg(
        F.ceil(F.count(F.lit(1)) / per_c).cast("int").alias("_cs"),
        F.ceil(F.sum(F.col("_anchor").cast("long")) / per_a).cast("int").alias("_as"),
    )
    sizes = checkpointed(sizes.where("_as > 0"))
    spread = rows.join(sizes, by).withColumn("_h", F.xxhash64("_row"))
    anchors = spread.where("_anchor").withColumn("_a", F.pmod("_h", F.col("_as")).cast("int"))
    if extra is not None:
        anchors = anchors.join(extra, "_row")
    carried = ["_row", "_label", "_vector", "_cs", *(extra.columns[1:] if extra is not None else [])]
    kinds = {f.name: f.dataType.simpleString() for f in anchors.schema}

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = spanning_tree(whole(pdf["_vector"]))
        out = pdf.iloc[tree.order].copy()
        out["_step"], out["_edge"], out["_store"], out["_source"] = range(len(out)), tree.edge, tree.store, tree.source
        return out

    keys = [*by, "_a"]
    held = [*keys, *(c for c in carried if c not in by)]
    shape = ", ".join(f"{c} {kinds[c]}" for c in held) + ", _step int, _edge double, _store int, _source int"
    planted = checkpointed(anchors.select(held).groupBy(*keys).applyInPandas(plant, shape))
    left = planted.withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_cs") - 1)))
    right = spread.withColumn("_c", F.pmod(F.xxhash64("_h"), F.col("_cs")).cast("int")).withColumn(
        "_a", F.explode(F.sequence(F.lit(0), F.col("_as") - 1))
    )
    held = ["_row", "vec_id", "_label", "_vector"]
    return left, right.select(*keys, "_c", *(c for c in held if c not in by))


def hard_negatives(
    rows: DataFrame,
    label: Column,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id and embedding; ``label`` and ``anchor`` are expressions over its columns, the latter true for anchors.
    """
    importable(rows.sparkSession)
    table = participants(rows, label, anchor)
    dim = table.agg(F.max(F.size("_vector"))).first()[0] or 1

    def mates(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return best_positives(a, c, positives)

    left, right = _blocks(table, ["_label"], dim)
    cell = ["_label", "_a", "_c"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(mates, "_anchor long, vec_id long, score long")
    order = Window.partitionBy("_anchor").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= positives)
    listed = F.sort_array(F.collect_list(F.struct("_place", "vec_id", "score")))
    best = checkpointed(found.groupBy(F.col("_anchor").alias("_row")).agg(listed.alias("_best")))

    def others(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return best_negatives(a, c, negatives, low, high)

    left, right = _blocks(table, ["_all"], dim, best.select("_row", F.col("_best.score").alias("_scores")))
    cell = ["_all", "_a", "_c"]
    shape = "_anchor long, place int, vec_id long, score long"
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(others, shape)
    order = Window.partitionBy("_anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = table.where("_anchor").select("_row", F.col("vec_id").alias("anchor_id")).join(best, "_row")
    one = F.element_at("_best", F.col("place") + 1)
    return found.join(named, found["_anchor"] == named["_row"]).select(
        "anchor_id",
        one["vec_id"].alias("positive_id"),
        "rank",
        F.col("vec_id").alias("negative_id"),
        one["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
