"""The same questions in plain SQL, for DuckDB over the benchmark tables.

``VIEWS`` are named sub-queries; a query lists what it needs by simply using the names.
"""

from __future__ import annotations

import re

VIEWS = {
    # --- cells and associations
    "cells": r"""
        select o_orderkey as cell_id, cast(substr(o_orderpriority, 1, 1) as int) - 1 as louvain,
               case when c_nationkey = 0 then '0' else concat('N', c_nationkey, '.', c_custkey % 4, '.sg') end as guide_cov,
               c_mktsegment as donor_cov, o_totalprice as numi_cov,
               coalesce(nullif(regexp_extract(
                   case when c_nationkey = 0 then '0' else concat('N', c_nationkey, '.', c_custkey % 4, '.sg') end,
                   '^[[:alnum:]]+\.[[:digit:]]+'), ''), '0') as guide
        from orders join customer on o_custkey = c_custkey""",
    "guide_genes": """
        select concat('N', s_nationkey, '.', l_partkey % 4) as guide, p_brand as gene,
               cast(sum(cast(round(l_discount * 100) as bigint)) as double) / count(*) / 100 as fdr, count(*) as support
        from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey group by 1, 2""",
    "sig": "select * from guide_genes where fdr < 0.05",
    "sigpos": "select * from guide_genes where fdr < 0.045",
    "cluster_genes": """
        select cast(substr(o_orderpriority, 1, 1) as int) - 1 as cluster, p_brand as gene,
               cast(sum(cast(round(l_discount * 100) as bigint)) as double) / count(*) / 100 as fdr
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2""",
    "cluster_sig": "select * from cluster_genes where fdr < 0.05",
    "scaffold": """
        select distinct guide from guide_genes union select '0' union select 'Z0.0' union select 'Z0.1'""",
    "counts": "select louvain, guide, count(*) as n from cells group by 1, 2",
    "guide_totals": "select guide, sum(n) as k from counts group by 1",
    "shares": """
        select louvain, guide, cast(n as double) / cast(k as double) as share
        from counts join guide_totals using (guide) where guide <> '0'""",
    "enriched": """
        select louvain, guide from shares
        qualify row_number() over (partition by louvain order by share desc, guide) <= 8""",
    "depleted": """
        select louvain, guide from shares
        qualify row_number() over (partition by louvain order by share, guide) <= 8""",
    "uniquely_enriched": """
        select min(louvain) as louvain, guide from enriched group by guide having count(distinct louvain) = 1""",
    "wide": """
        select "row", max(guide) filter (louvain = 0) as cluster_0, max(guide) filter (louvain = 1) as cluster_1,
               max(guide) filter (louvain = 2) as cluster_2, max(guide) filter (louvain = 3) as cluster_3,
               max(guide) filter (louvain = 4) as cluster_4
        from (select *, cast(row_number() over (partition by louvain order by guide) as int) as "row"
              from uniquely_enriched) group by "row" """,
    "axis": "select guide, cast(c as int) as louvain from scaffold, range(5) t(c)",
    "numi": """
        select louvain, guide, cast(floor(sum(cast(numi_cov as decimal(18, 4)))) as bigint) as numi_cov
        from cells group by 1, 2""",
    "numi_profile": """
        select guide, louvain, coalesce(cast(numi_cov as double), 0) as value
        from axis left join numi using (guide, louvain)""",
    "count_profile": """
        select guide, louvain, coalesce(cast(n as double), 0) as value
        from axis left join counts using (guide, louvain)""",
    "hits": """
        select louvain, guide, gene, count(*) as n from cells join sig using (guide) group by 1, 2, 3""",
    "hits_pos": """
        select louvain, guide, gene, count(*) as n from cells join sigpos using (guide) group by 1, 2, 3""",
    "combos": """
        select louvain, guide, gene, h.n as n, k, m, (select count(*) from cells) - m as rest
        from hits h
        join (select guide, gene, sum(n) as k from hits group by 1, 2) using (guide, gene)
        join (select louvain, count(*) as m from cells group by 1) using (louvain)""",
    "tails": """
        select distinct louvain, n, k,
            list_sum(list_transform(range(cast(n as bigint), cast(least(k, m) as bigint) + 1), lambda i:
                exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1)
                    + lgamma(rest + 1) - lgamma(k - i + 1) - lgamma(rest - k + i + 1)
                    - lgamma(m + rest + 1) + lgamma(k + 1) + lgamma(m + rest - k + 1)))) as up,
            list_sum(list_transform(range(cast(greatest(0, k - rest) as bigint), cast(n as bigint) + 1), lambda i:
                exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1)
                    + lgamma(rest + 1) - lgamma(k - i + 1) - lgamma(rest - k + i + 1)
                    - lgamma(m + rest + 1) + lgamma(k + 1) + lgamma(m + rest - k + 1)))) as down
        from (select distinct louvain, n, k, m, rest from combos)""",
    "tested": """
        select louvain, guide, gene, n, least(up, 1.0) as p_value_enrich, least(down, 1.0) as p_value_deplete
        from combos join tails using (louvain, n, k)""",
    "ranked": """
        select *, p_value_enrich * count(*) over (partition by louvain)
                  / count(*) over (partition by louvain order by p_value_enrich) as raw_e,
               p_value_deplete * count(*) over (partition by louvain)
                  / count(*) over (partition by louvain order by p_value_deplete) as raw_d
        from tested""",
    "final": """
        select louvain, guide, gene, n, p_value_enrich, p_value_deplete,
               least(1.0, min(raw_e) over (partition by louvain order by p_value_enrich desc)) as p_adj_enrich,
               least(1.0, min(raw_d) over (partition by louvain order by p_value_deplete desc)) as p_adj_deplete
        from ranked""",
    "significant": "select * from final where round(p_value_enrich, 9) < 0.05",
    "top_fifty": """
        select louvain, guide, n from counts where guide in (select guide from sigpos)
        qualify row_number() over (partition by louvain order by n desc, guide) <= 50""",
    "not_in_ref": """
        select * from top_fifty where louvain <> 4 and guide not in (select guide from top_fifty where louvain = 4)""",
    "ref_totals": "select guide, sum(n) as total from not_in_ref group by 1",
    "numi_corr": """
        select concat('cluster_', a.louvain) as col_a, concat('cluster_', b.louvain) as col_b,
               corr(a.value, b.value) as r
        from numi_profile a join numi_profile b on a.guide = b.guide and a.louvain < b.louvain group by 1, 2""",
    # --- matrix
    "matrix": """
        select vec_id as cell_id, cast(label % 5 as int) as louvain, label,
               case when vec_id % 12 = 0 then '0' else concat('G', vec_id % 12, '.1') end as guide,
               cast(embedding as double[]) as v
        from embeddings""",
    "expr": """
        select cell_id, louvain, guide, concat('g', i - 1) as gene, v[i] as value
        from (select *, unnest(range(1, len(v) + 1)) as i from matrix)""",
    "expr_pos": "select cell_id, louvain, guide, gene, value + 1 as value from expr",
    "expr_scaffold": "select distinct guide from matrix union select 'Z0.0' union select 'Z0.1'",
    "means": "select louvain, guide, gene, avg(value) as value from expr group by 1, 2, 3",
    "weights": "select louvain, guide, count(*) as n from matrix group by 1, 2",
    "weighted": """
        select louvain, guide, avg(value) * any_value(n) as avg_group_exprs
        from means join weights using (louvain, guide) group by 1, 2""",
    "fills": """
        select louvain, avg(m) as avg from (select louvain, gene, avg(value) as m from means group by 1, 2) group by 1""",
    "stacked": """
        select louvain, guide, gene, coalesce(value, 0) as value
        from (select guide, cast(c as int) as louvain, gene
              from expr_scaffold, range(5) t(c), (select distinct gene from expr))
        left join means using (louvain, guide, gene)""",
    "detected": "select gene, count(*) filter (value > 0.0001) as num_cells_expressed from expr group by 1",
    "flagged": """
        select gene, count(*) filter (value > 0.15) as num_cells_expressed,
               count(*) filter (value > 0.15) > cast(0.11 as double) * (select count(*) from matrix) as use_for_ordering
        from expr group by 1""",
    "factors": """
        select cell_id, exp(ln(t) - avg(ln(t)) over ()) as size_factor
        from (select cell_id, sum(value) as t from expr_pos group by 1)""",
    "dispersions": """
        select gene, avg(y) as mean, var_samp(y) as variance,
               (var_samp(y) - (select avg(1 / size_factor) from factors) * avg(y)) / (avg(y) * avg(y)) as dispersion
        from (select gene, value / size_factor as y from expr_pos join factors using (cell_id)) group by 1""",
    "list_hits": """
        select list_id, cell_id, louvain
        from expr join (values (0, 'g0'), (0, 'g1'), (0, 'g2'), (1, 'g10'), (1, 'g11')) l(list_id, gene) using (gene)
        where value > 0.0001 group by 1, 2, 3
        having count(*) = case list_id when 0 then 3 else 2 end""",
    "timed": """
        select *, cast(cell_id % 100 as double) / cast(99 as double) as pseudotime, cell_id % 2 as branch from matrix""",
    "timed_bins": """
        select cell_id, branch, cast(least(floor(pseudotime * 100), 99) as int) as bin from timed""",
    # --- graph
    "dist": """
        select a.cell_id as src, b.cell_id as dst, list_distance(a.v, b.v) as d
        from matrix a, matrix b where a.cell_id <> b.cell_id""",
    "knn": """
        select src, dst, d, row_number() over (partition by src order by d, dst) as rank from dist qualify rank <= 3""",
    "shared": """
        select e.src, e.dst, (select count(*) from knn a join knn b on a.dst = b.dst where a.src = e.src and b.src = e.dst) as s
        from knn e""",
    "both_ways": "select src, dst from knn union select dst, src from knn",
    "rho": """
        select src as cell_id, round(sum(exp(-power(d / cast(0.6 as double), 2))), 10) as rho
        from dist group by 1""",
    "centred": "select cell_id, gene, value - avg(value) over (partition by gene) as z from expr",
    "near_z": "select gene, dst, z as zi from knn join centred on cell_id = src",
    "moran": """
        select gene, n / s0 * cross_sum / z2 as morans_i,
               (n / s0 * cross_sum / z2 + 1 / (n - 1))
               / sqrt((n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0)
                       - n * z4 / (z2 * z2) * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0))
                      / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - 1 / ((n - 1) * (n - 1))) as morans_test_statistic
        from (select b.gene, sum(zi * b.z) as cross_sum
              from near_z join centred b on near_z.gene = b.gene and near_z.dst = b.cell_id group by 1)
        join (select gene, sum(z * z) as z2, sum(z * z * z * z) as z4 from centred group by 1) using (gene),
        (select cast(count(*) as double) as n from matrix),
        (select cast(count(*) as double) as s0 from knn),
        (select cast(sum(c * c) as double) as s1
         from (select count(*) as c from knn group by least(src, dst), greatest(src, dst))),
        (select cast(sum(c * c) as double) as s2
         from (select count(*) as c from (select src as x from knn union all select dst from knn) group by x))""",
    # --- differential tests
    "groups": """
        select gene, louvain, count(*) as n, avg(value) as mean, var_pop(value) * count(*) as rss from expr group by 1, 2""",
    "gaussian": """
        select gene, sum(n) * ln(any_value(rss0) / sum(rss)) as lr
        from groups join (select gene, var_pop(value) * count(*) as rss0 from expr group by 1) using (gene) group by gene""",
    "inverse_gaussian": """
        select gene, sum(n) * ln((sum(inv) - sum(n) / (sum(total) / sum(n))) / (sum(inv) - sum(n * n / total))) as lr
        from (select gene, louvain, count(*) as n, sum(value) as total, sum(1 / value) as inv from expr_pos group by 1, 2)
        group by gene""",
}

# Natural cubic spline of pseudotime (terciles as inner knots), made orthogonal column by column, once over all cells
# and once inside each branch; a residual sum of squares is then a difference of squares.
VIEWS |= {
    "knots": """
        select lo, hi, (a - lo) / (hi - lo) as ka, (b - lo) / (hi - lo) as kb
        from (select min(pseudotime) as lo, max(pseudotime) as hi,
                     quantile_cont(pseudotime, cast(1 as double) / 3) as a,
                     quantile_cont(pseudotime, cast(2 as double) / 3) as b from timed)""",
    "bends": """
        select cell_id, branch, s, power(greatest(s, 0), 3) as e0,
               power(greatest(s - ka, 0), 3) / (1 - ka) as e1, power(greatest(s - kb, 0), 3) / (1 - kb) as e2
        from (select cell_id, branch, (pseudotime - lo) / (hi - lo) as s, ka, kb from timed, knots)""",
    "framed": """
        select 'all' as model, 0 as side, cell_id, s as b1, e0 - e2 as b2, e1 - e2 as b3 from bends
        union all select 'split', branch, cell_id, s, e0 - e2, e1 - e2 from bends""",
    "ortho1": """
        select model, side, cell_id, b1 - avg(b1) over w as q1, b2 - avg(b2) over w as c2, b3 - avg(b3) over w as c3
        from framed window w as (partition by model, side)""",
    "ortho2": """
        select model, side, cell_id, q1, c2 - q1 * sum(c2 * q1) over w / sum(q1 * q1) over w as q2,
               c3 - q1 * sum(c3 * q1) over w / sum(q1 * q1) over w as d3
        from ortho1 window w as (partition by model, side)""",
    "ortho3": """
        select model, side, cell_id, q1, q2, d3 - q2 * sum(d3 * q2) over w / sum(q2 * q2) over w as q3
        from ortho2 window w as (partition by model, side)""",
    "spline_fits": """
        select gene, model, side, count(*) as n, var_pop(value) * count(*) as tss,
               var_pop(value) * count(*) - power(sum(value * q1), 2) / sum(q1 * q1)
               - power(sum(value * q2), 2) / sum(q2 * q2) - power(sum(value * q3), 2) / sum(q3 * q3) as rss
        from expr join ortho3 using (cell_id) group by 1, 2, 3""",
    "spline_lr": """
        select gene, any_value(n) * ln(any_value(tss) / any_value(rss)) as lr
        from spline_fits where model = 'all' group by 1""",
    "branch_lr": """
        select gene, sum(n) filter (model = 'all')
                     * ln(sum(rss) filter (model = 'all') / sum(rss) filter (model = 'split')) as lr
        from spline_fits group by 1""",
    "nested_lr": """
        select gene, any_value(small.n) * ln(any_value(small.rss) / sum(big.rss)) as lr
        from (select gene, sum(n) as n, sum(rss) as rss from groups group by 1) small
        join (select gene, var_pop(value) * count(*) as rss from expr group by gene, louvain, cell_id % 3) big
        using (gene) group by 1""",
    "flow": """
        select a.cell_id, round(a.rho, 6) + 0.0 as rho_out, a.rho as rho,
               coalesce(min(d) filter (b.rho > a.rho or (b.rho = a.rho and b.cell_id < a.cell_id)), max(d)) as delta,
               arg_min(b.cell_id, (d, b.cell_id))
                   filter (b.rho > a.rho or (b.rho = a.rho and b.cell_id < a.cell_id)) as parent
        from rho a join dist on src = a.cell_id join rho b on dst = b.cell_id group by a.cell_id, a.rho""",
    "centres": "select cell_id from flow order by rho * delta desc, cell_id limit 9",
}


def _erf(z: str) -> str:
    """erf of a positive number as a series of positive terms; beyond 6.5 it is 1 in double precision."""
    x = f"least({z}, 6.5)"
    return f"list_sum(list_transform(range(0, 300), lambda i: exp((2 * i + 1) * ln({x}) - {x} * {x} - lgamma(i + 1.5))))"


# upper tails of χ² with three, four and ten degrees of freedom
_CHI3 = f"1 - {_erf('sqrt(lr / 2)')} + 2 / sqrt(pi()) * sqrt(lr / 2) * exp(-lr / 2)"
_CHI4 = "exp(-lr / 2) * (1 + lr / 2)"
_CHI10 = "exp(-lr / 2) * list_sum(list_transform(range(0, 5), lambda i: power(lr / 2, i) / gamma(i + 1)))"


def _gene_test(source: str, tail: str, digits: int) -> str:
    """p-values of likelihood ratios, then Benjamini–Hochberg over genes."""
    return f"""
        select gene, 'OK' as status, round(p, {digits}) + 0.0 as pval,
               round(least(1.0, min(p * n / r) over (order by p desc)), {digits}) + 0.0 as qval
        from (select gene, p, count(*) over () as n, count(*) over (order by p) as r
              from (select gene, {tail} as p from {source}))"""


_MATERIALISED = {
    "dist", "knn", "tails", "tested", "cells", "guide_genes", "expr", "centred", "hits", "ortho3", "rho", "flow",
    "moran", "near_z",
}


def _round(digits: int, *names: str) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 as {n}" for n in names)


def _needs(text: str) -> set[str]:
    return set(re.findall(r"\w+", text)) & VIEWS.keys()


def with_views(body: str, others: dict[str, str] | None = None) -> str:
    """Prefix a query with exactly the views it uses, in order of dependence; ``others`` take the place of views."""
    views = VIEWS | (others or {})
    wanted: set[str] = set()
    todo = _needs(body)
    while todo:
        name = todo.pop()
        wanted.add(name)
        todo |= (_needs(views[name]) - {name}) - wanted
    if not wanted:
        return body
    done: list[str] = []
    while len(done) < len(wanted):
        ready = [n for n in views if n in wanted and n not in done and (_needs(views[n]) - {n}) <= set(done)]
        done += ready
    parts = [f"{n} as {'materialized ' if n in _MATERIALISED else ''}({views[n]})" for n in done]
    return "with recursive " + ",\n".join(parts) + "\n" + body


_COLUMNS = [f"cluster_{c}" for c in range(5)]


def _pivot(source: str, value: str, digits: int) -> str:
    picks = ", ".join(
        f"round(max({value}) filter (louvain = {c}), {digits}) + 0.0 as cluster_{c}" for c in range(5)
    )
    return f"select guide, {picks} from {source} group by guide"


_BODIES = {
    "sample_cells": """
        select cell_id, louvain, guide from cells order by md5(concat('55:', cell_id)), cell_id limit 1000""",
    "sample_fraction": """
        select cell_id, louvain, guide from cells where substr(md5(concat('55:', cell_id)), 1, 8) < '0ccccccc'""",
    "marker_subset": f"""
        select cell_id, louvain, guide, gene, {_round(6, 'value')} from expr
        where gene in ('g0', 'g1', 'g2', 'g3')
          and cell_id in (select cell_id from matrix order by md5(concat('55:', cell_id)), cell_id limit 200)""",
    "expr_cluster_subset": f"select cell_id, louvain, guide, gene, {_round(6, 'value')} from expr where louvain in (1, 2)",
    "parse_guide": "select cell_id, guide_cov, guide from cells",
    "wt_share": """
        select guide = '0' as wt, count(*) as n, round(count(*) / (select count(*) from cells), 8) as share
        from cells group by 1""",
    "cluster_guide_counts": "select concat(louvain, '-', guide) as cluster_guide, n from counts",
    "lump_enriched": """
        select cell_id, guide,
               case when guide in (select guide from enriched where louvain = 1) then guide else 'other' end as lumped
        from cells""",
    "priority_reorder": """
        select cell_id, guide, cast(coalesce(list_position(['G2.1', 'G1.1'], guide), 0) as int) as priority_rank,
               case when guide in ('G2.1', 'G1.1') then guide else 'other' end as priority_reorder,
               round(v[1], 6) + 0.0 as dim1, round(v[2], 6) + 0.0 as dim2
        from matrix""",
    "tidy_feats_enriched": "select louvain, guide from enriched",
    "tidy_feats_depleted": "select louvain, guide from depleted",
    "unique_feats_wide": "select * from wide",
    "unique_feats_roundtrip": "select louvain, guide from uniquely_enriched",
    "profile_zero_fill": _pivot("numi_profile", "value", 4),
    "profile_mean_fill": _pivot(
        """(select guide, louvain, coalesce(avg_group_exprs, avg) as x
            from (select guide, cast(c as int) as louvain from expr_scaffold, range(5) t(c))
            left join weighted using (louvain, guide) left join fills using (louvain))""",
        "x",
        6,
    ),
    "profile_stacked": f"select louvain, guide, gene, {_round(6, 'value')} from stacked",
    "profile_colmean_fill": """
        select guide, gene, round(coalesce(value, avg(value) over (partition by gene)), 6) + 0.0 as value
        from (select guide, gene from expr_scaffold, (select distinct gene from expr))
        left join (select guide, gene, value from means where louvain = 1) using (guide, gene)""",
    "expr_long": f"select cell_id, gene, {_round(6, 'value')} from expr",
    "profile_squared": """
        select cast(power(louvain - 1, 2) as double) as louvain, guide, gene, round(power(value, 2), 6) + 0.0 as value
        from means where louvain = 3""",
    "cluster_sizes": "select louvain, count(*) as n from cells group by 1",
    "cluster_complement": """
        select louvain, count(*) as n, (select count(*) from cells) - count(*) as n_hyper from cells group by 1""",
    "guide_gene_totals": "select guide, gene, count(*) as n from cells join sig using (guide) group by 1, 2",
    "guide_gene_hits": "select * from hits",
    "guide_frequency": "select guide, count(*) as n from cells group by 1",
    "donor_guide_frequency": "select donor_cov, guide, count(*) as n from cells group by 1, 2",
    "control_share": """
        select louvain, round(avg(case when guide = '0' then 1.0 else 0.0 end), 8) + 0.0 as share from cells group by 1""",
    "guide_coverage": """
        select round(count(distinct cell_id) filter (guide in (select guide from sigpos)) / count(distinct cell_id), 8)
                   as covered,
               round(1 - count(distinct cell_id) filter (guide = '0') / count(distinct cell_id), 8) as not_control
        from cells""",
    "absent_guides": "select guide from scaffold where guide not in (select guide from cells)",
    "guide_share": """
        select louvain, guide, n, cast(sum(n) over (partition by louvain) as bigint) as cluster_n,
               round(n / sum(n) over (partition by louvain), 8) as normalized
        from counts""",
    "genes_per_cluster_guide": "select louvain, guide, count(*) as n from hits_pos group by 1, 2",
    "rows_per_cluster": """
        select louvain, count(*) as n, count(distinct guide) as n_guides, count(distinct gene) as n_genes
        from hits_pos group by 1""",
    "significant_per_cluster": """
        select louvain, count(*) as n, count(distinct guide) as n_guides, count(distinct gene) as n_genes
        from significant group by 1""",
    "enriched_cell_count": """
        select louvain, count(*) as n from cells where (louvain, guide) in (select (louvain, guide) from enriched)
        group by 1""",
    "de_genes_per_cluster": "select cluster as louvain, count(*) as n from cluster_sig group by 1",
    "top_guides_per_cluster": """
        select louvain, guide, n, cast(row_number() over (partition by louvain order by n desc, guide) as int) as rank
        from counts where guide in (select guide from sigpos) qualify rank <= 50""",
    "top_genes_per_cluster": """
        select louvain, gene, n, cast(row_number() over (partition by louvain order by n desc, gene) as int) as rank
        from (select louvain, s.gene, count(*) as n
              from cells join sigpos s using (guide) join cluster_sig c on s.gene = c.gene and louvain = cluster
              group by 1, 2)
        qualify rank <= 20""",
    "top_guides_not_in_ref": "select louvain, guide, n from not_in_ref",
    "top_guides_total": "select guide, cast(total as bigint) as total from ref_totals",
    "leaders_in_ref_cluster": """
        select guide, count(*) as n from cells
        where louvain = 4 and guide in (select guide from ref_totals order by total desc, guide limit 15) group by 1""",
    "top_guides_rank_2_4": """
        select guide, n, cast(row_number() over (order by n desc, guide) as int) as rank
        from counts where louvain = 1 qualify rank between 2 and 4""",
    "supra_join": """
        select cell_id, louvain, guide, s.gene
        from cells join sigpos s using (guide) join cluster_sig c on s.gene = c.gene and louvain = cluster""",
    "unmatched_guides": "select distinct guide from cells where guide not in (select guide from sig)",
    "unique_genes": """
        select min(cluster) as louvain, gene from cluster_sig group by gene having count(distinct cluster) = 1""",
    "unique_guides": "select louvain, guide from uniquely_enriched",
    "significant_unique_guides": """
        select min(louvain) as louvain, guide from significant group by guide having count(distinct louvain) = 1""",
    "unique_guide_genes": """
        select guide, gene, round(fdr, 8) + 0.0 as fdr from sigpos
        where guide in (select guide from uniquely_enriched where louvain = 1)""",
    "enriched_guide_genes": """
        select guide, gene, round(fdr, 8) + 0.0 as fdr from sigpos
        where guide in (select guide from enriched where louvain = 0)""",
    "hypergeom_enrich": f"""
        select louvain, guide, gene, n, {_round(5, 'p_value_enrich', 'p_adj_enrich')},
               round(-log10(p_value_enrich), 4) + 0.0 as neg_log10_p
        from final""",
    "hypergeom_deplete": f"""
        select louvain, guide, gene, n, {_round(5, 'p_value_deplete', 'p_adj_deplete')},
               round(-log10(p_value_deplete), 4) + 0.0 as neg_log10_p
        from final""",
    "bh_adjust": """
        select guide, gene, block, round(p, 8) + 0.0 as p,
               round(least(1.0, min(raw) over (partition by block order by p desc)), 8) + 0.0 as qval
        from (select guide, gene, split_part(guide, '.', 2) as block, fdr as p,
                     fdr * count(*) over (partition by split_part(guide, '.', 2))
                     / count(*) over (partition by split_part(guide, '.', 2) order by fdr) as raw
              from guide_genes)""",
    "qq_points": """
        select rank, round(-log10((rank - 0.5) / cast(n as double)), 8) + 0.0 as expected,
               round(-log10(p), 4) + 0.0 as observed
        from (select row_number() over (order by p_value_enrich) as rank, count(*) over () as n, p_value_enrich as p
              from tested)""",
    "pvalue_histogram": """
        select louvain, measure,
               cast(least(floor(coalesce((p - lo) / nullif(hi - lo, 0), 0) * 100) + 1, 100) as int) as bin, count(*) as n
        from (select *, min(p) over (partition by louvain, measure) as lo, max(p) over (partition by louvain, measure) as hi
              from (unpivot (select louvain, p_value_enrich, p_value_deplete, p_adj_enrich, p_adj_deplete from final)
                    on p_value_enrich, p_value_deplete, p_adj_enrich, p_adj_deplete into name measure value p))
        group by 1, 2, 3""",
    "cluster_corr": f"select col_a, col_b, {_round(6, 'r')} from numi_corr",
    "cross_corr": """
        select concat('cluster_', a.louvain) as col_a, concat('cluster_', b.louvain) as col_b,
               round(corr(a.value, b.value), 6) + 0.0 as r
        from numi_profile a join count_profile b on a.guide = b.guide group by 1, 2""",
    "gene_corr": """
        select a.col as col_a, b.col as col_b, round(corr(a.value, b.value), 6) + 0.0 as r
        from (select louvain, guide, gene as col, value from stacked
              union all select distinct louvain, guide, 'louvain', cast(louvain as double) from stacked) a
        join (select louvain, guide, gene as col, value from stacked
              union all select distinct louvain, guide, 'louvain', cast(louvain as double) from stacked) b
        on a.louvain = b.louvain and a.guide = b.guide group by 1, 2""",
    # two-sided t tail as a finite sum; the series differs for even and odd degrees of freedom
    "corr_pvalues": """
        select col_a, col_b, round(r, 6) + 0.0 as r, round(t, 4) + 0.0 as t,
               round(case when df % 2 = 0
                     then 1 - sin(a) * list_sum(list_transform(range(0, df // 2), lambda i:
                              exp(lgamma(i + 0.5) - lgamma(0.5) - lgamma(i + 1)) * power(cos(a), 2 * i)))
                     else 1 - 2 / pi() * (a + sin(a) * list_sum(list_transform(range(0, (df - 1) // 2), lambda i:
                              exp(lgamma(i + 1) + lgamma(1.5) - lgamma(i + 1.5)) * power(cos(a), 2 * i + 1))))
                     end, 6) + 0.0 as p_value
        from (select *, r * sqrt(df / (1 - r * r)) as t, atan(abs(r * sqrt(df / (1 - r * r))) / sqrt(df)) as a
              from numi_corr, (select count(*) - 2 as df from scaffold))""",
    "guide_density": """
        select louvain, point, round(any_value(x), 6) + 0.0 as x, round(sum(kernel), 6) + 0.0 as density
        from (select louvain, point, lo + point * ((hi - lo) / 511) as x,
                     n / total * exp(-0.5 * power((lo + point * ((hi - lo) / 511) - id) / 0.2, 2))
                     / (0.2 * sqrt(2 * pi())) as kernel
              from (select louvain, id, count(*) as n from ids group by 1, 2)
              join (select louvain, cast(min(id) as double) - cast(0.6 as double) as lo,
                           cast(max(id) as double) + cast(0.6 as double) as hi, count(*) as total
                    from ids group by 1) using (louvain),
              (select cast(c as int) as point from range(512) t(c)))
        group by 1, 2""",
    "gene_detection_summary": """
        select cast(min(c) as double) as "min", quantile_cont(c, 0.25) as q1, quantile_cont(c, 0.5) as median,
               quantile_cont(c, 0.75) as q3, cast(max(c) as double) as "max", round(avg(c), 6) as mean
        from (select cast(num_cells_expressed as double) as c from detected)""",
    "guide_mean_expr": f"select louvain, guide, gene, {_round(6, 'value')} from means",
    "guide_mean_expr_sparse": """
        select louvain, guide, gene, round(sum(value) / any_value(n), 6) + 0.0 as value
        from expr join weights using (louvain, guide) where value > 0.0001 group by 1, 2, 3""",
    "guide_weights": "select * from weights",
    "weighted_group_expr": f"select louvain, guide, {_round(6, 'avg_group_exprs')} from weighted",
    "cluster_mean_of_means": f"select louvain, {_round(6, 'avg')} from fills",
    "grand_mean": "select round(avg(value), 6) + 0.0 as avg_tot from expr",
    "numi_counts": "select * from numi",
    "genes_detected": "select * from detected",
    "cells_detected": "select cell_id, count(*) filter (value > 0.0001) as num_genes_expressed from expr group by 1",
    "use_for_ordering": "select * from flagged",
    "retained_share": "select round(avg(cast(use_for_ordering as int)), 8) + 0.0 as retained from flagged",
    "size_factors": f"select cell_id, {_round(6, 'size_factor')} from factors",
    "dispersion_table": f"select gene, {_round(6, 'mean', 'variance', 'dispersion')} from dispersions",
    "dispersion_fit": """
        select round(regr_intercept(dispersion, 1 / mean), 5) + 0.0 as asymptote,
               round(regr_slope(dispersion, 1 / mean), 5) + 0.0 as extra
        from dispersions where mean > 0""",
    "genelist_cells": "select * from list_hits",
    "genelist_enrichment": """
        select list_id, louvain, n, k, m, round(least(1.0, list_sum(list_transform(range(n, least(k, m) + 1), lambda i:
                exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1)
                    + lgamma(rest + 1) - lgamma(k - i + 1) - lgamma(rest - k + i + 1)
                    - lgamma(m + rest + 1) + lgamma(k + 1) + lgamma(m + rest - k + 1))))), 6) + 0.0 as p_value
        from (select list_id, louvain, count(*) as n,
                     cast(sum(count(*)) over (partition by list_id) as bigint) as k from list_hits group by 1, 2)
        join (select louvain, count(*) as m, (select count(*) from matrix) - count(*) as rest from matrix group by 1)
        using (louvain)""",
    "marker_overlay": """
        select cell_id, round(v[1], 6) + 0.0 as dim1, round(v[2], 6) + 0.0 as dim2, gene, round(value, 6) + 0.0 as value
        from matrix join (select cell_id, gene, value from expr where gene in ('g5', 'g6')) using (cell_id)""",
    "knn_graph": "select src, dst, round(d, 6) + 0.0 as distance, cast(rank as int) as rank from knn",
    "jaccard_graph": "select src, dst, round(s / (6 - s), 8) as weight from shared where s > 0",
    "modularity": """
        select round(sum(inside / mass - power(everything / mass, 2)), 8) + 0.0 as modularity
        from (select a.louvain, count(*) filter (a.louvain = b.louvain) as inside, count(*) as everything
              from both_ways join matrix a on a.cell_id = src join matrix b on b.cell_id = dst group by 1),
             (select count(*) as mass from both_ways)""",
    "graph_partitions": """
        , reach(cell_id, seen) as (
            select cell_id, cell_id from matrix
            union select r.cell_id, e.dst from reach r join both_ways e on r.seen = e.src)
        select cell_id, min(seen) as partition from reach group by 1""",
    "density_rho_delta": "select cell_id, rho_out as rho, round(delta, 6) + 0.0 as delta, parent from flow",
    "density_peaks": """
        , follow(cell_id, centre) as (
            select cell_id, cell_id from centres
            union select f.cell_id, g.centre from flow f join follow g on f.parent = g.cell_id
            where f.cell_id not in (select cell_id from centres))
        select * from follow""",
    "root_vertex": """
        select label as vertex, count(*) as n from matrix where guide = '0' group by 1 order by n desc, vertex limit 1""",
    "morans_i": f"""
        select gene, {_round(6, 'morans_i', 'morans_test_statistic', 'pval')},
               round(least(1.0, min(pval * n / r) over (order by pval desc)), 6) + 0.0 as qval
        from (select *, count(*) over () as n, count(*) over (order by pval) as r
              from (select *, 0.5 - 0.5 * sign(morans_test_statistic)
                              * {_erf('(abs(morans_test_statistic) / sqrt(2))')} as pval from moran))""",
    "morans_top3": f"""
        select gene, {_round(6, 'morans_test_statistic')} from moran order by moran.morans_test_statistic desc, gene limit 3""",
    "de_one_factor": _gene_test("gaussian", _CHI4, 8),
    "de_inverse_gaussian": _gene_test("inverse_gaussian", _CHI4, 8),
    "de_nested": _gene_test("nested_lr", _CHI10, 6),
    "de_pseudotime": _gene_test("spline_lr", _CHI3, 6),
    "branch_test": _gene_test("branch_lr", _CHI4, 6),
    "ordering_genes": f"""
        select gene, qval from ({_gene_test('gaussian', _CHI4, 8)}) order by qval, gene limit 200""",
    "pseudotime_profile": """
        select gene, bin, round(m, 6) + 0.0 as mean,
               round((m - avg(m) over (partition by gene)) / nullif(stddev_samp(m) over (partition by gene), 0), 6) + 0.0 as z
        from (select gene, bin, avg(value) as m from expr join timed_bins using (cell_id) group by 1, 2)""",
    "branch_profile": """
        select gene, branch, bin, round(m, 6) + 0.0 as mean,
               round((m - avg(m) over (partition by gene, branch))
                     / nullif(stddev_samp(m) over (partition by gene, branch), 0), 6) + 0.0 as z
        from (select gene, branch, bin, avg(value) as m from expr join timed_bins using (cell_id) group by 1, 2, 3)""",
}

VIEWS["ids"] = r"""
    select louvain, case when guide = '0' then 0
                         else cast(regexp_extract(guide, '^N(\d+)\.(\d+)$', 1) as int) * 4
                              + cast(regexp_extract(guide, '^N(\d+)\.(\d+)$', 2) as int) + 1 end as id
    from cells"""

# χ² upper tail for any degrees of freedom, one minus the series of the lower one
_CHI = """case when lr <= 0 then 1.0 else 1 - list_sum(list_transform(range(0, 400), lambda i:
    exp((df / 2.0 + i) * ln(lr / 2) - lr / 2 - lgamma(df / 2.0 + i + 1)))) end"""


def _levels_lr(fine: str, coarse: str = "cell_id is null") -> str:
    """Means of the finer levels against those of the coarser ones that they lie in."""
    return f"""(
        select small.gene, small.n * ln(small.rss / big.rss) as lr, big.k - small.k as df
        from (select gene, sum(n) as n, sum(rss) as rss, count(*) as k from (
                  select gene, count(*) as n, var_pop(value) * count(*) as rss from expr group by gene, {coarse}) group by 1) small
        join (select gene, sum(rss) as rss, count(*) as k from (
                  select gene, var_pop(value) * count(*) as rss from expr group by gene, {fine}) group by 1) big using (gene))"""


VIEWS |= {
    "one_against_rest": """
        select louvain, gene, n * ln(tss / (tss - parted)) as lr, mean > rest as up from (
            select g.louvain, g.gene, a.n, a.tss, g.mean, (a.s - g.n * g.mean) / (a.n - g.n) as rest,
                   cast(g.n as double) * (a.n - g.n) / a.n * power(g.mean - (a.s - g.n * g.mean) / (a.n - g.n), 2) as parted
            from groups g
            join (select gene, count(*) as n, sum(value) as s, var_pop(value) * count(*) as tss from expr group by 1) a
            using (gene))""",
    "markers": f"""
        select louvain, gene, p as pval, q as qval,
               row_number() over (partition by louvain order by lr desc, gene) as rank
        from (select *, least(1.0, min(p * n / r) over (partition by louvain order by p desc)) as q
              from (select *, count(*) over (partition by louvain) as n,
                           count(*) over (partition by louvain order by p) as r
                    from (select *, 1 - {_erf('sqrt(lr / 2)')} as p from one_against_rest)))
        where up and q < 0.99""",
}

_BODIES |= {
    "cluster_markers": f"select louvain, gene, {_round(6, 'pval', 'qval')}, cast(rank as int) as rank from markers where rank <= 5",
    "genelist_cells_indexed": "select * from list_hits",
    "expression_of_cells": f"""
        select cell_id, louvain, guide, gene, {_round(6, 'value')} from expr
        where guide in ('G1.1', 'G2.1') and louvain < 2""",
    "de_one_factor_guide": _gene_test(_levels_lr("guide"), _CHI, 6),
    "de_one_factor_cluster_guide": _gene_test(_levels_lr("(louvain, guide)"), _CHI, 6),
    "de_nested_absorbed": _gene_test(_levels_lr("(louvain, guide)", "louvain"), _CHI, 6),
}

ORACLE = {name: with_views(body) for name, body in _BODIES.items()}

ORACLE["marker_list_enrichment"] = with_views(
    _BODIES["genelist_enrichment"],
    {
        "list_hits": """
        select m.louvain as list_id, e.cell_id, e.louvain from expr e join markers m using (gene)
        where m.rank <= 2 and e.value > 0.0001 group by 1, 2, 3
        having count(*) = (select count(*) from markers x where x.rank <= 2 and x.louvain = m.louvain)"""
    },
)

# The sparse matrix is the dense one with its small entries set to zero, and its questions are the dense ones.
_WITH_ZEROS = {
    "expr": VIEWS["expr"].replace("v[i] as value", "case when v[i] > 0.05 then v[i] else 0 end as value"),
    "expr_pos": "select cell_id, louvain, guide, gene, value from expr",
}
SPARSE = (
    *("grand_mean", "genes_detected", "cells_detected", "gene_detection_summary", "size_factors", "dispersion_table"),
    *("de_one_factor", "de_nested", "de_pseudotime", "branch_test", "pseudotime_profile", "branch_profile"),
)
ORACLE |= {f"{name}_sparse": with_views(_BODIES[name], _WITH_ZEROS) for name in SPARSE}
