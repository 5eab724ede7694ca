"""Per-gene likelihood-ratio tests of nested models.

All genes share the cells and therefore the design, so each model costs one cells-only cross-product and one grouped sum per
(gene, design column). Output: gene, status, pval, qval. A gene that cannot be fitted has status FAIL and p = q = 1; the
correction runs over the genes that could.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from guidescape.functions.tails import chi2_upper
from guidescape.operators.enrichment import bh_adjust
from guidescape.operators.ranking import exact_quantiles, grouped_quantiles
from guidescape.runtime import checkpointed, total

MAX_DESIGN = 2048


def _finish(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """From (``by``, gene, lr, df), null lr meaning no fit, to the output contract; corrected within ``by``."""
    by, scored = list(by), checkpointed(scored)
    ok = F.col("lr").isNotNull() & ~F.isnan("lr") & (F.col("df") > 0)
    tested = scored.select(
        *by, "gene", F.when(ok, "OK").otherwise("FAIL").alias("status"), F.when(ok, F.col("lr")).alias("lr"), "df"
    ).withColumn("_p", chi2_upper(F.col("lr"), F.when(F.col("status") == "OK", F.col("df"))))
    adjusted = bh_adjust(tested, "_p", by)
    return adjusted.select(
        *by,
        "gene",
        "status",
        F.coalesce("_p", F.lit(1.0)).alias("pval"),
        F.coalesce("qval", F.lit(1.0)).alias("qval"),
    )


def de_one_factor(
    expr: DataFrame,
    factor: str,
    family: str = "gaussian",
    cells: DataFrame | None = None,
    genes: DataFrame | None = None,
) -> DataFrame:
    """One factor against the constant, in closed form from one grouped pass.

    ``family`` is ``gaussian`` or ``inverse_gaussian`` (shared shape; genes with a value ≤ 0 fail). With ``cells`` (cell_id and
    the factor) absent (cell, gene) rows count as zeros, and only their number per level is needed; with ``genes`` those without
    any row are listed as failed.
    """
    value = F.col("value")
    per = expr.groupBy("gene", factor).agg(
        F.count("value").alias("_rows"),
        F.avg("value").alias("_mean"),
        F.var_pop("value").alias("_var"),
        F.sum(F.when(value > 0, 1 / value)).alias("inverse"),
        F.min("value").alias("low"),
    )
    if cells is None:
        per = checkpointed(per.withColumn("n", F.col("_rows")))
        sizes = per.groupBy("gene").agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_levels"))
        per = per.join(sizes, "gene")
    else:
        sizes = checkpointed(cells.groupBy(factor).agg(F.count(F.lit(1)).alias("n")))
        per = per.join(sizes, per[factor].eqNullSafe(sizes[factor])).drop(sizes[factor])
        per = per.withColumns({"_all": total(sizes, F.sum("n")), "_levels": total(sizes, F.count(F.lit(1)))})
    zeros = F.col("n") - F.col("_rows")
    per = per.withColumns(
        {
            "mean": F.col("_mean") * F.col("_rows") / F.col("n"),
            "squares": F.col("_rows") * F.col("_var") + F.col("_mean") * F.col("_mean") * F.col("_rows") * zeros / F.col("n"),
            "low": F.when(zeros > 0, F.least("low", F.lit(0.0))).otherwise(F.col("low")),
        }
    )
    per = checkpointed(per.select("gene", "n", "mean", "squares", "inverse", "low", "_all", "_levels"))
    whole = per.groupBy("gene").agg(
        F.max("_all").alias("n"),
        (F.sum(F.col("n") * F.col("mean")) / F.max("_all")).alias("centre"),
        F.sum("squares").alias("within"),
        F.max("_levels").alias("groups"),
        F.sum("inverse").alias("inverse"),
        F.sum(F.col("n") / F.nullif(F.col("mean"), F.lit(0.0))).alias("n_over_mean"),
        F.min("low").alias("low"),
        F.sum("n").alias("_seen"),
    )
    between = per.join(whole.select("gene", "centre"), "gene").groupBy("gene").agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("centre"), 2)).alias("between")
    )
    unseen = F.col("n") - F.col("_seen")  # cells of levels in which the gene has only zeros
    rows = whole.join(between, "gene").withColumn("between", F.col("between") + unseen * F.col("centre") * F.col("centre"))
    if family == "gaussian":
        null, full = F.col("within") + F.col("between"), F.col("within")
        usable = full > 0
    elif family == "inverse_gaussian":
        null = F.col("inverse") - F.col("n") / F.nullif(F.col("centre"), F.lit(0.0))
        full = F.col("inverse") - F.col("n_over_mean")
        usable = (F.col("low") > 0) & (unseen == 0) & (full > 0)
    else:
        raise ValueError(f"unknown family: {family}")
    ratio = F.when(usable, F.col("n") * F.log(null / full))
    scored = rows.select("gene", ratio.alias("lr"), (F.col("groups") - 1).alias("df"))
    return _finish(scored if genes is None else genes.select("gene").distinct().join(scored, "gene", "left"))


def cluster_markers(
    expr: DataFrame, k: int = 5, alpha: float = 0.05, cells: DataFrame | None = None
) -> DataFrame:
    """louvain, gene, pval, qval, rank: the ``k`` genes most clearly higher in a cluster than in all others together.

    All clusters are tested at once, each against the rest, from sums per (gene, cluster); q-values are each cluster's own, and
    only genes below ``alpha`` are listed. With ``cells`` absent (cell, gene) rows count as zeros.
    """
    per = expr.groupBy("gene", "louvain").agg(
        F.count("value").alias("_rows"), F.avg("value").alias("_mean"), F.var_pop("value").alias("_var")
    )
    if cells is None:
        per = per.withColumn("n", F.col("_rows"))
    else:
        sizes = cells.groupBy("louvain").agg(F.count(F.lit(1)).alias("n"))
        per = sizes.join(per.select("gene").distinct().withColumn("louvain", F.explode(total(sizes, F.collect_list("louvain")))), "louvain").join(
            per, ["gene", "louvain"], "left"
        ).fillna(0, ["_rows", "_mean", "_var"])
    rows, mean = F.col("_rows"), F.col("_mean")
    squares = rows * F.col("_var") + mean * mean * rows * (F.col("n") - rows) / F.col("n")
    per = checkpointed(per.select("gene", "louvain", "n", (mean * rows / F.col("n")).alias("mean"), squares.alias("within")))
    whole = per.groupBy("gene").agg(
        F.sum("n").alias("_all"),
        F.sum(F.col("n") * F.col("mean")).alias("_sum"),
        F.sum("within").alias("_within"),
    ).withColumn("_centre", F.col("_sum") / F.col("_all"))
    spread = per.join(whole.select("gene", "_centre"), "gene").groupBy("gene").agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_centre"), 2)).alias("_between")
    )
    rest = F.col("_all") - F.col("n")
    others = (F.col("_sum") - F.col("n") * F.col("mean")) / F.nullif(rest, F.lit(0))
    parted = F.col("n") * rest / F.col("_all") * F.pow(F.col("mean") - others, 2)
    null = F.col("_within") + F.col("_between")
    full = null - parted
    tested = per.join(whole, "gene").join(spread, "gene").withColumns(
        {"_up": F.col("mean") > others, "_lr": F.when(full > 1e-12 * null, F.col("_all") * F.log(null / full))}
    )
    tested = checkpointed(tested.select("louvain", "gene", "_up", "_lr").withColumn("pval", chi2_upper(F.col("_lr"), F.lit(1))))
    own = Window.partitionBy("louvain").orderBy(F.desc("_lr"), "gene")
    kept = bh_adjust(tested, "pval", ["louvain"]).where(F.col("_up") & (F.col("qval") < alpha))
    ranked = kept.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return ranked.select("louvain", "gene", "pval", "qval", "rank")


# --- designs: rows of (cell_id, entries array<struct<j int, x double>>), only non-zero entries -----------------------


class Term:
    """A block of design columns: ``width`` of them, and the non-zero entries of one row given a first index."""

    def __init__(self, width: int, entries):
        self.width = width
        self.entries = entries


def _entry(j: Column, x: Column) -> Column:
    return F.struct(j.cast("int").alias("j"), x.cast("double").alias("x"))


def factor_term(cells: DataFrame, col: str) -> Term:
    """One indicator column per level. Levels are the design's own width, so their number is checked."""
    listed = cells.select(F.col(col).cast("string").alias("level")).distinct().orderBy("level").limit(MAX_DESIGN + 1)
    levels = [r["level"] for r in listed.collect()]
    if len(levels) > MAX_DESIGN:
        raise ValueError(f"{col} has more than {MAX_DESIGN} levels")
    if not levels:
        return Term(0, lambda base: F.filter(F.array(_entry(F.lit(0), F.lit(0.0))), lambda e: F.lit(False)))
    index = F.create_map(*[F.lit(v) for i, name in enumerate(levels) for v in (name, i)])
    return Term(len(levels), lambda base: F.array(_entry(index[F.col(col).cast("string")] + base, F.lit(1.0))))


def _bends(t: Column, a: Column, b: Column) -> list[Column]:
    """Natural cubic spline columns of ``t`` in 0..1 with inner knots ``a`` and ``b``.

    A truncated-power basis is enough, since the tests depend on its span only.
    """

    def cube(at: Column) -> Column:
        return F.pow(F.greatest(t - at, F.lit(0.0)), F.lit(3))

    def bend(at: Column) -> Column:
        return (cube(at) - cube(F.lit(1.0))) / F.coalesce(F.nullif(1.0 - at, F.lit(0.0)), F.lit(1.0))

    return [t, bend(F.lit(0.0)) - bend(b), bend(a) - bend(b)]


def spline_term(cells: DataFrame, col: str) -> Term:
    """Natural cubic spline with three degrees of freedom on ``col`` scaled to 0..1.

    Knots: minimum, terciles, maximum.
    """
    low, a, b, high = exact_quantiles(cells, col, [0.0, 1 / 3, 2 / 3, 1.0])
    width = (high - low) or 1.0
    columns = _bends((F.col(col) - low) / width, F.lit((a - low) / width), F.lit((b - low) / width))
    return Term(3, lambda base: F.array(*[_entry(F.lit(base + i), c) for i, c in enumerate(columns)]))


def with_spline(cells: DataFrame, col: str, by: Sequence[str]) -> tuple[DataFrame, Term]:
    """As ``spline_term`` with each group's own knots; the cells carry the columns' values."""
    marks = grouped_quantiles(cells, col, [0.0, 1 / 3, 2 / 3, 1.0], by)
    at = [F.col("_marks")[i] for i in range(4)]
    width = F.coalesce(F.nullif(at[3] - at[0], F.lit(0.0)), F.lit(1.0))
    columns = _bends((F.col(col) - at[0]) / width, (at[1] - at[0]) / width, (at[2] - at[0]) / width)
    placed = cells.join(marks, list(by)).withColumn("_spline", F.array(*columns)).drop("_marks")
    return placed, Term(3, lambda base: F.array(*[_entry(F.lit(base + i), F.col("_spline")[i]) for i in range(3)]))


def interaction(left: Term, right: Term) -> Term:
    """Products of every column of one term with every column of the other."""

    def entries(base: int) -> Column:
        return F.flatten(
            F.transform(
                left.entries(0),
                lambda l: F.transform(
                    right.entries(0), lambda r: _entry(l["j"] * right.width + r["j"] + base, l["x"] * r["x"])
                ),
            )
        )

    return Term(left.width * right.width, entries)


def design(cells: DataFrame, terms: Sequence[Term], carried: Sequence[str] = ()) -> tuple[DataFrame, list[int]]:
    """Design rows, with the constant as column 0, and the first column index behind each term."""
    parts, ends, base = [F.array(_entry(F.lit(0), F.lit(1.0)))], [1], 1
    for term in terms:
        parts.append(term.entries(base))
        base += term.width
        ends.append(base)
    if base > MAX_DESIGN:
        raise ValueError(f"a design of {base} columns is too wide (limit {MAX_DESIGN}): absorb its widest factor")
    rows = F.filter(F.flatten(F.array(*parts)), lambda e: e["x"] != 0)
    return cells.select(*carried, "cell_id", rows.alias("entries")), ends


@dataclass
class _Inner:
    """A model for one group of cells: generalised inverse of its columns' inner products, and rank."""

    inverse: np.ndarray
    rank: int


def _inner(gram: np.ndarray) -> _Inner:
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    unit = gram / np.outer(scale, scale)
    rank = int(np.linalg.matrix_rank(unit, tol=1e-10 * max(len(gram), 1), hermitian=True)) if len(gram) else 0
    return _Inner(np.linalg.pinv(unit, rcond=1e-10, hermitian=True) / np.outer(scale, scale), rank)


def _squares(pairs: DataFrame, width: int, by: list[str]) -> dict[tuple, np.ndarray]:
    """Per group a width × width matrix from rows (i, j, v). Groups are few: branch points of a tree, or one."""
    found = pairs.toPandas()
    out: dict[tuple, np.ndarray] = {}
    for key, part in found.groupby(by, dropna=False) if by else [((), found)]:
        square = out.setdefault(tuple(key), np.zeros((width, width)))
        square[part["i"], part["j"]] = part["v"]
    return out


def _gram(rows: DataFrame, width: int, by: list[str]) -> dict[tuple, np.ndarray]:
    """XᵀX per group. Rows hold a handful of entries, so pairs within a row are few."""
    pairs = (
        rows.select(*by, "entries", F.explode("entries").alias("a"))
        .select(*by, "a", F.explode("entries").alias("b"))
        .groupBy(*by, F.col("a.j").alias("i"), F.col("b.j").alias("j"))
        .agg(F.sum(F.col("a.x") * F.col("b.x")).alias("v"))
    )
    return _squares(pairs, width, by)


def _level(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def _between_levels(rows: DataFrame, width: int, by: list[str]) -> tuple[DataFrame, dict[tuple, np.ndarray], dict[tuple, int]]:
    """What absorbing a factor takes from the other columns.

    Per level its cells and the other columns' sums over them; per group BᵀD⁻¹B, to be taken off their cross-product, and the
    number of levels.
    """
    keys = [*by, "_level"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cells"))
    held = rows.select(*keys, F.explode("entries").alias("e")).groupBy(*keys, F.col("e.j").alias("j")).agg(
        F.sum("e.x").alias("s")
    )
    held = held.groupBy(*keys).agg(F.collect_list(F.struct("j", "s")).alias("_columns"))
    levels = checkpointed(sizes.join(held, keys))
    pairs = (
        levels.select(*by, "_cells", "_columns", F.explode("_columns").alias("a"))
        .select(*by, "_cells", "a", F.explode("_columns").alias("b"))
        .groupBy(*by, F.col("a.j").alias("i"), F.col("b.j").alias("j"))
        .agg(F.sum(F.col("a.s") * F.col("b.s") / F.col("_cells")).alias("v"))
    )
    counts = levels.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()
    return levels, _squares(pairs, width, by), {tuple(r[c] for c in by): r["n"] for r in counts}


def de_nested(
    expr: DataFrame,
    cells: DataFrame,
    reduced: Sequence[Term],
    extra: Sequence[Term],
    absorbed: str | None = None,
    absorbed_in: str = "both",
    by: Sequence[str] = (),
    genes: DataFrame | None = None,
) -> DataFrame:
    """For every gene: constant + ``reduced`` + ``extra`` against constant + ``reduced``.

    The matrix is read once: sums per (gene, design column) serve both models, whose explained sums of squares follow from
    the cells-only cross-product. Degrees of freedom come from ranks, so a redundant extra term fails.

    * Cells of ``cells`` without a row in ``expr`` count as zeros, so a matrix may leave its zeros out. With ``genes`` those
      that have no row at all are listed too, as failed.
    * ``absorbed``: a factor of any number of levels in both models, or in the full one only (``absorbed_in="full"``). Its
      columns are never built: sums over levels are taken off the other columns' cross-product (a Schur complement) and off
      their products with the gene.
    * ``by``: independent fits for groups of cells, such as branch points; a cell may be in several, and several times in one.
    """
    by = list(by)
    if absorbed is not None:
        cells = cells.withColumn("_level", _level(absorbed))
    carried = [*by, "_level"] if absorbed is not None else by
    rows, ends = design(cells, [*reduced, *extra], carried)
    rows = checkpointed(rows)
    small, width = ends[len(reduced)], ends[-1]
    gram = _gram(rows, width, by)
    ones = {key: g[0] for key, g in gram.items()}
    levels, taken, n_levels = _between_levels(rows, width, by) if absorbed is not None else (None, {}, {})

    def inner(key: tuple, columns: int, absorbing: bool) -> _Inner:
        whole = gram[key][:columns, :columns]
        if not absorbing:
            return _inner(whole)
        # the constant lies in the absorbed factor's span: what is left of it is zero
        rest = whole - taken[key][:columns, :columns]
        rest[np.abs(rest) < 1e-9 * np.sqrt(np.outer(np.diag(whole), np.diag(whole)))] = 0.0
        found = _inner(rest)
        return _Inner(found.inverse, found.rank + n_levels[key])

    full = {key: inner(key, width, absorbed is not None) for key in gram}
    less = {key: inner(key, small, absorbed is not None and absorbed_in == "both") for key in gram}

    entries = F.transform("entries", lambda e: F.struct(e["j"].alias("j"), F.lit(None).cast("string").alias("level"), e["x"].alias("x")))
    if absorbed is not None:
        own = F.struct(F.lit(-1).alias("j"), F.col("_level").alias("level"), F.lit(1.0).alias("x"))
        entries = F.concat(entries, F.array(own))
    sums = (
        expr.select("cell_id", "gene", "value")
        .join(rows, "cell_id")
        .select(*by, "gene", "value", F.explode(entries).alias("e"))
        .groupBy(*by, "gene", F.col("e.j").alias("j"), F.col("e.level").alias("_level"))
        .agg(
            F.sum(F.col("value") * F.col("e.x")).alias("v"),
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.var_pop("value").alias("var"),
        )
    )
    key = [*by, "gene"]
    if absorbed is not None:
        sums = checkpointed(sums)
    constant = F.col("j") == 0
    per_gene = sums.where("j >= 0").groupBy(*key).agg(
        F.collect_list("j").alias("js"),
        F.collect_list("v").alias("vs"),
        *(F.max(F.when(constant, F.col(c))).alias(c) for c in ("n", "mean", "var")),
        F.max(F.when(constant, F.col("v"))).alias("total"),
    )
    if absorbed is not None:
        per_level = sums.where("j < 0").select(*key, "_level", F.col("v").alias("_v")).join(levels, [*by, "_level"])
        share = F.col("_v") / F.col("_cells")
        through = per_level.select(*key, share.alias("_share"), F.explode("_columns").alias("c")).groupBy(
            *key, F.col("c.j").alias("j")
        ).agg(F.sum(F.col("_share") * F.col("c.s")).alias("v"))
        through = through.groupBy(*key).agg(F.collect_list("j").alias("tjs"), F.collect_list("v").alias("tvs"))
        whole = per_gene.select(*key, F.col("total").alias("_total"))
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
        spread = per_level.join(whole, key)
        spread = spread.join(sizes, by) if by else spread.withColumn("_all", F.lit(float(ones[()][0])) if ones else F.lit(1.0))
        centre = F.col("_total") / F.col("_all")
        explained = spread.groupBy(*key).agg(
            F.sum(F.col("_cells") * F.pow(share - centre, 2)).alias("present"), F.sum("_cells").alias("seen")
        )
        per_gene = per_gene.join(through, key).join(explained, key)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ratios, dfs = [], []
            for row in pdf.itertuples(index=False):
                group = tuple(getattr(row, c) for c in by)
                one, size = ones[group], ones[group][0]
                raw = np.zeros(width)
                raw[np.asarray(row.js)] = row.vs
                mean = row.total / size
                xy = raw - mean * one  # centring changes neither model, both contain the constant
                zeros = size - row.n
                square = row.var * row.n + row.mean * row.mean * row.n * zeros / size

                def explained(columns: int, model: _Inner, absorbing: bool) -> float:
                    if not absorbing:
                        return xy[:columns] @ model.inverse @ xy[:columns]
                    rest = raw.copy()
                    rest[np.asarray(row.tjs)] -= row.tvs
                    rest[np.abs(rest) < 1e-12 * np.abs(raw)] = 0.0
                    by_level = row.present + mean * mean * (size - row.seen)
                    return by_level + rest[:columns] @ model.inverse @ rest[:columns]

                rss1 = square - explained(width, full[group], absorbed is not None)
                rss0 = square - explained(small, less[group], absorbed is not None and absorbed_in == "both")
                good = square > 0 and rss1 > 1e-12 * square
                ratios.append(max(0.0, size * np.log(rss0 / rss1)) if good else np.nan)
                dfs.append(full[group].rank - less[group].rank)
            out = pdf[key].copy()
            out["lr"], out["df"] = np.array(ratios, dtype=float), np.array(dfs, dtype=int)
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in per_gene.schema}
    scored = per_gene.mapInPandas(fit, ", ".join(f"{c} {kinds[c]}" for c in key) + ", lr double, df int")
    if genes is not None:
        every = genes.select("gene").distinct()
        if by:
            groups = total(rows.select(*by).distinct(), F.collect_list(F.struct(*by)))
            every = every.withColumn("_g", F.explode(groups)).select("_g.*", "gene")
        scored = every.join(scored, key, "left")
    return _finish(scored, by)


def de_pseudotime(
    expr: DataFrame, cells: DataFrame, col: str = "pseudotime", cutoff: float | None = 1e-4, genes: DataFrame | None = None
) -> DataFrame:
    """Spline of pseudotime against the constant; with ``cutoff`` only genes below that q-value are kept."""
    out = de_nested(expr, cells, [], [spline_term(cells, col)], genes=genes)
    return out if cutoff is None else out.where((F.col("status") == "OK") & (F.col("qval") < cutoff))


def branch_test(
    expr: DataFrame, cells: DataFrame, col: str = "pseudotime", branch: str = "branch", genes: DataFrame | None = None
) -> DataFrame:
    """Spline × branch against one spline: gene, pval, qval, most significant first."""
    spline, sides = spline_term(cells, col), factor_term(cells, branch)
    out = de_nested(expr, cells, [spline], [sides, interaction(spline, sides)], genes=genes)
    return out.select("gene", "status", "pval", "qval").orderBy("qval", "gene")


def branch_tests(expr: DataFrame, members: DataFrame, cutoff: float | None = None, genes: DataFrame | None = None) -> DataFrame:
    """``branch_test`` for every branch point of a tree at once: branch_point, gene, status, pval, qval.

    ``members`` (branch_point, side, cell_id, pseudotime) lists the cells of each side, those before the branch point on every
    side. Knots and correction are each branch point's own; the matrix is read once for all. With ``cutoff`` only genes below
    that q-value are kept.
    """
    by = ["branch_point"]
    cells, spline = with_spline(members, "pseudotime", by)
    sides = factor_term(members, "side")
    out = de_nested(expr, cells, [spline], [sides, interaction(spline, sides)], by=by, genes=genes)
    return out if cutoff is None else out.where((F.col("status") == "OK") & (F.col("qval") < cutoff))


def ordering_genes(tests: DataFrame, k: int = 200) -> DataFrame:
    """The ``k`` genes with the smallest q."""
    return tests.orderBy("qval", "gene").limit(k).select("gene", "qval")


def pseudotime_profile(
    expr: DataFrame,
    cells: DataFrame,
    col: str = "pseudotime",
    bins: int = 100,
    by: Sequence[str] = (),
    within: Sequence[str] = (),
    genes: DataFrame | None = None,
) -> DataFrame:
    """Mean expression per gene and pseudotime bin, z-scored within each gene (and each value of ``by``).

    Bins have equal widths from the least to the greatest pseudotime, taken apart for each value of ``within``, some of ``by``.
    Cells without a row in ``expr`` count as zeros: every gene (of ``genes``, or with any row) has a mean in every bin that
    holds cells.
    """
    by, within = list(by), list(within)
    ends = cells.groupBy(*within).agg(F.min(col).alias("_low"), F.max(col).alias("_high"))
    ranged = cells.join(ends, within) if within else cells.withColumn("_ends", total(ends, F.first(F.struct("_low", "_high"))))
    low, high = (F.col("_low"), F.col("_high")) if within else (F.col("_ends._low"), F.col("_ends._high"))
    share = (F.col(col) - low) / F.coalesce(F.nullif(high - low, F.lit(0)), F.lit(1))
    bin_no = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
    binned = checkpointed(ranged.select("cell_id", *by, bin_no.alias("bin")))
    sizes = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("_cells"))
    sums = (
        expr.select("cell_id", "gene", "value")
        .join(binned, "cell_id")
        .groupBy("gene", *by, "bin")
        .agg(F.sum("value").alias("_sum"))
    )
    named = genes.select("gene").distinct() if genes is not None else expr.select("gene").distinct()
    # bins × values of ``by`` are few: one short array, laid beside every gene
    places = named.withColumn("_p", F.explode(total(sizes, F.collect_list(F.struct(*by, "bin", "_cells"))))).select("gene", "_p.*")
    means = places.join(sums, ["gene", *by, "bin"], "left").select(
        "gene", *by, "bin", (F.coalesce("_sum", F.lit(0.0)) / F.col("_cells")).alias("mean")
    )
    own = Window.partitionBy("gene", *by)
    spread = F.nullif(F.stddev_samp("mean").over(own), F.lit(0.0))
    return means.select("gene", *by, "bin", "mean", ((F.col("mean") - F.avg("mean").over(own)) / spread).alias("z"))


def gene_groups(profile: DataFrame, groups: int, bins: int = 100, seed: int = 55) -> DataFrame:
    """Genes grouped by the shape of their profile; a bin without cells holds 0."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    held = profile.groupBy("gene").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.coalesce("z", F.lit(0.0))))).alias("_held")
    )
    at = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("_held", b), F.lit(0.0)))
    vectors = held.select("gene", array_to_vector(at).alias("features"))
    model = BisectingKMeans(k=groups, seed=seed).fit(vectors)
    return model.transform(vectors).select("gene", F.col("prediction").alias("group"))
