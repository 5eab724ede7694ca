import contextlib
import threading
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from guidescape import runtime
from guidescape.operators import density, graph, neighbours, spatial, trajectory


def points_frame(spark, matrix):
    return spark.createDataFrame(
        pd.DataFrame({"cell_id": np.arange(len(matrix)), "values": [list(map(float, v)) for v in matrix]})
    )


def all_distances(matrix):
    return np.sqrt(((matrix[:, None, :] - matrix[None, :, :]) ** 2).sum(axis=2))


@pytest.fixture(params=[2_000_000, 3])
def task_size(request, monkeypatch):
    """Everything must hold with and without split keys."""
    monkeypatch.setattr(runtime, "ROWS_PER_TASK", request.param)


CLOUDS = {
    "plane": np.random.default_rng(1).random((300, 2)),
    "clumps": np.concatenate([np.random.default_rng(2).normal(c, 0.05, (100, 3)) for c in (0, 3, 9)]),
    "wide": np.random.default_rng(3).normal(size=(120, 20)),
    "copies": np.repeat(np.random.default_rng(4).integers(0, 4, (40, 2)), 5, axis=0).astype(float),
}


@pytest.mark.parametrize("name", list(CLOUDS))
@pytest.mark.parametrize("k,block", [(1, 16), (5, 16), (40, 16), (3, 512)])
def test_neighbours_equal_brute_force(spark, name, k, block):
    matrix = CLOUDS[name]
    gaps = all_distances(matrix)
    got = neighbours.knn(points_frame(spark, matrix), k, block_rows=block).toPandas()
    got = got.sort_values(["src", "rank"]).groupby("src")["dst"].apply(list)
    for i in range(len(matrix)):
        order = sorted((j for j in range(len(matrix)) if j != i), key=lambda j: (gaps[i, j], j))
        assert got[i] == order[:k]


def test_most_pairs_are_ruled_out_on_clustered_data(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 64))
    matrix = centres[rng.integers(0, 12, 4_000)] + 0.1 * rng.normal(size=(4_000, 64))
    measured = spark.sparkContext.accumulator(0)
    got = neighbours.knn(points_frame(spark, matrix), 4, measured=measured).toPandas()
    share = measured.value / 4_000**2
    print(f"share of pairs measured: {share:.3f}")
    assert share < 0.2
    for i in range(0, 4_000, 397):
        own = np.sqrt(((matrix - matrix[i]) ** 2).sum(axis=1))
        own[i] = np.inf
        assert got[got["src"] == i].sort_values("rank")["dst"].tolist() == np.argsort(own, kind="stable")[:4].tolist()


def most_on_disk(spark, work):
    """What ``work`` gives back, and the most bytes of shuffle files seen on disk while it ran."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    folders, most, done = [Path(str(f)) for f in folders], [], threading.Event()

    def held():
        total = 0
        for path in (p for f in folders for p in f.rglob("shuffle_*.data")):
            with contextlib.suppress(FileNotFoundError):
                total += path.stat().st_size
        return total

    def watch():
        while not done.wait(0.02):
            most.append(held())

    runtime.discard_shuffles(spark)
    first, watcher = held(), threading.Thread(target=watch)
    watcher.start()
    try:
        out = work()
    finally:
        done.set()
        watcher.join()
    return out, max(most, default=0) - first


def test_points_travel_few_times_where_nothing_can_be_ruled_out(spark):
    matrix = np.random.default_rng(15).normal(size=(6_000, 32))
    df = points_frame(spark, matrix).persist()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables that are too large for it
    try:
        got, disk = most_on_disk(spark, lambda: neighbours.knn(df, 3).toPandas())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        df.unpersist()
    print(f"bytes on disk per byte of points: {disk / matrix.nbytes:.1f}")
    assert disk < 8 * matrix.nbytes
    for i in range(0, 6_000, 397):
        own = np.sqrt(((matrix - matrix[i]) ** 2).sum(axis=1))
        own[i] = np.inf
        assert got[got["src"] == i].sort_values("rank")["dst"].tolist() == np.argsort(own, kind="stable")[:3].tolist()


def test_bounds_let_every_near_pair_through():
    rng = np.random.default_rng(13)
    for offset in (0.0, 1e4):
        a, b = rng.normal(size=(60, 30)) + offset, rng.normal(size=(50, 30)) + offset
        frame = neighbours._principal_axes(a)
        exact = neighbours._distances(a, b)
        reach = np.quantile(exact, 0.2, axis=1)
        found = neighbours._near(a, b, frame, reach)
        inside = exact <= reach[:, None]
        assert (found[inside] == exact[inside]).all()
        assert np.isinf(found).any()


def test_fewer_points_than_neighbours(spark):
    got = neighbours.knn(points_frame(spark, np.array([[0.0], [1.0], [3.0]])), 10).toPandas()
    assert len(got) == 6


def test_text_ids_work(spark):
    df = spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", [1.5])], "cell_id string, values array<double>")
    got = {r["src"]: r["dst"] for r in neighbours.knn(df, 1).collect()}
    assert got == {"a": "b", "b": "c", "c": "b"}


@pytest.mark.parametrize("name", ["plane", "clumps", "copies"])
def test_density_equals_brute_force(spark, name):
    matrix, dc = CLOUDS[name], 0.1
    gaps = all_distances(matrix)
    np.fill_diagonal(gaps, np.inf)
    rho = np.round(np.where(gaps <= 6.1 * dc, np.exp(-((gaps / dc) ** 2)), 0).sum(axis=1), 10)
    df = points_frame(spark, matrix)
    found = neighbours.local_density(df, dc, block_rows=16).withColumn("rho", F.round("rho", 10))
    table = neighbours.nearest_denser(df, found, block_rows=16).toPandas().set_index("cell_id").sort_index()
    assert np.allclose(table["rho"], rho, atol=1e-9)
    for i in range(len(matrix)):
        seen = table["rho"]
        denser = [j for j in range(len(matrix)) if seen[j] > seen[i] or (seen[j] == seen[i] and j < i)]
        if not denser:
            assert pd.isna(table["parent"][i])
            assert table["delta"][i] == pytest.approx(gaps[i][np.isfinite(gaps[i])].max())
            continue
        best = min(denser, key=lambda j: (gaps[i, j], j))
        assert (table["parent"][i], table["delta"][i]) == (best, pytest.approx(gaps[i, best]))


def test_only_the_densest_cell_has_no_parent(spark, monkeypatch):
    """Bounds and distances may differ by rounding; distances to the densest cell are both."""
    monkeypatch.setattr(neighbours, "PART_ROWS", 200, raising=False)
    matrix = np.random.default_rng(16).normal(size=(900, 64)) / 8
    gaps = all_distances(matrix)
    order = gaps[17].argsort(kind="stable").argsort()
    df = points_frame(spark, matrix)
    rho = spark.createDataFrame([(i, float(1_000 - order[i] // 3)) for i in range(900)], "cell_id long, rho double")
    table = neighbours.nearest_denser(df, rho, block_rows=64).toPandas().set_index("cell_id").sort_index()
    for i in range(900):
        denser = [j for j in range(900) if (order[j] // 3, j) < (order[i] // 3, i)]
        best = min(denser, key=lambda j: (gaps[i, j], j), default=None)
        assert pd.isna(table["parent"][i]) if best is None else table["parent"][i] == best


def test_density_peaks_recover_planted_groups(spark, task_size):
    table = density.density_rho_delta(points_frame(spark, CLOUDS["clumps"]), 0.1)
    centre = density.density_peaks(table, 3).toPandas().set_index("cell_id")["centre"]
    groups = [set(centre[i] for i in range(s, s + 100)) for s in (0, 100, 200)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


@pytest.mark.parametrize("query", ["communities", "graph_partitions", "follow_parents"])
def test_rounds_leave_only_their_result(spark, tmp_path, monkeypatch, query):
    monkeypatch.setattr(runtime, "ensure_checkpoint_dir", lambda session: str(tmp_path))
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(12)], "src long, dst long, weight double")
    if query == "communities":
        out = graph.communities(edges)
    elif query == "graph_partitions":
        out = graph.graph_partitions(spark.range(13).withColumnRenamed("id", "cell_id"), edges)
    else:
        out = graph.follow_parents(spark.createDataFrame([(i, max(0, i - 1)) for i in range(13)], "cell_id long, parent long"))
    assert out.count() == 13
    assert len(list(tmp_path.glob("table-*"))) == 1


def test_jaccard_weights(spark, task_size):
    edges = [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1)]
    got = graph.jaccard_graph(spark.createDataFrame(edges, "src long, dst long")).collect()
    weights = {(r["src"], r["dst"]): r["weight"] for r in got}
    neighbours_of = {}
    for a, b in edges:
        neighbours_of.setdefault(a, set()).add(b)
    for a, b in edges:
        union = neighbours_of[a] | neighbours_of[b]
        share = len(neighbours_of[a] & neighbours_of[b]) / len(union)
        assert weights.get((a, b), 0.0) == pytest.approx(share)


def planted_edges():
    inside = [(a + o, b + o, 1.0) for o in (0, 10) for a in range(10) for b in range(a)]
    return inside + [(0, 10, 1.0)]


def test_communities_recover_planted_groups(spark, task_size):
    edges = spark.createDataFrame(planted_edges(), "src long, dst long, weight double")
    labels = graph.communities(edges)
    found = labels.toPandas().set_index("cell_id")["community"]
    assert len({found[i] for i in range(10)}) == 1 and len({found[i] for i in range(10, 20)}) == 1
    assert found[1] != found[11]
    score = graph.modularity(edges, labels).first()[0]
    assert score == pytest.approx(90 / 91 - 0.5, abs=1e-12)


def test_communities_label_every_cell(spark):
    ring = [(6 * c + a, 6 * c + b, 1.0) for c in range(5) for a in range(6) for b in range(a)]
    ring += [(6 * c, (6 * c + 7) % 30, 0.5) for c in range(5)]
    edges = spark.createDataFrame(ring, "src long, dst long, weight double")
    vertices = spark.range(33).withColumnRenamed("id", "cell_id")
    found = graph.communities(edges, vertices).toPandas().set_index("cell_id")["community"]
    assert found.index.is_unique and set(found.index) == set(range(33))
    assert all(found[i] == i for i in (30, 31, 32))
    assert all({found[6 * c + a] for a in range(6)} == {6 * c} for c in range(5))


def test_communities_are_connected_and_as_good_as_a_greedy_run(spark):
    rng = np.random.default_rng(15)
    group = np.arange(60) % 4
    pairs = [(a, b) for a in range(60) for b in range(a) if rng.random() < (0.5 if group[a] == group[b] else 0.04)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")
    labels = runtime.checkpointed(graph.communities(edges))
    row = graph.community_quality(edges, labels).first()
    assert row["connected"] == row["communities"]

    def score(names):
        degree = np.bincount(np.array(pairs).ravel(), minlength=60)
        inside = sum(names[a] == names[b] for a, b in pairs) / len(pairs)
        return inside - sum((degree[np.array(names) == c].sum() / (2 * len(pairs))) ** 2 for c in set(names))

    found = labels.toPandas().set_index("cell_id")["community"]
    assert row["modularity"] == pytest.approx(score([found[i] for i in range(60)]))
    assert row["modularity"] >= score(list(group)) - 0.02
    split = labels.withColumn("community", F.lit(0).cast("long"))
    parts = [(0, 1, 1.0), (2, 3, 1.0)]
    lone = graph.community_quality(spark.createDataFrame(parts, "src long, dst long, weight double"), split.where("cell_id < 4"))
    assert (lone.first()["communities"], lone.first()["connected"]) == (1, 0)


def test_connected_groups_and_isolated_cells(spark, task_size):
    chain = [(i, i + 1) for i in range(0, 40)] + [(50, 51), (52, 51)]
    vertices = spark.createDataFrame([(i,) for i in [*range(41), 50, 51, 52, 99]], "cell_id long")
    got = graph.graph_partitions(vertices, spark.createDataFrame(chain, "src long, dst long"))
    found = {r["cell_id"]: r["partition"] for r in got.collect()}
    assert {found[i] for i in range(41)} == {0}
    assert {found[i] for i in (50, 51, 52)} == {50}
    assert found[99] == 99


def test_pseudotime_follows_a_line(spark):
    x = np.linspace(0, 10, 200)
    matrix = np.c_[x, np.zeros(200)]
    df = points_frame(spark, matrix)
    tree = trajectory.fit_tree(df, 6)
    placed = trajectory.project_cells(df, tree)
    root = int(np.argmin(tree.centres[:, 0]))
    time = trajectory.pseudotime(placed, tree, root).toPandas().set_index("cell_id").sort_index()["pseudotime"]
    assert (np.diff(time) >= -1e-9).all() and time.iloc[-1] > time.iloc[0]
    assert tree.branch_points() == []
    states = trajectory.trajectory_states(placed, tree, root).toPandas()["state"]
    assert set(states) == {1}


def test_states_split_at_a_branch(spark):
    centres = np.array([[0.0, 0.0], [1.0, 0.0], [2.0, 1.0], [2.0, -1.0]])
    tree = trajectory.spanning_tree(centres)
    assert tree.branch_points() == [1]
    df = points_frame(spark, np.array([[0.5, 0.0], [1.6, 0.6], [1.6, -0.6]]))
    placed = trajectory.project_cells(df, tree)
    got = trajectory.trajectory_states(placed, tree, 0).toPandas().set_index("cell_id")["state"]
    assert len(set(got)) == 3
    time = trajectory.pseudotime(placed, tree, 0).toPandas().set_index("cell_id")["pseudotime"]
    assert time[0] == pytest.approx(0.5) and time[1] == pytest.approx(time[2]) and time[1] > 1.0


def test_root_vertex_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(3, "w"), (1, "w"), (3, "x")], "vertex int, kind string")
    assert trajectory.root_vertex(df, "kind", "w").first()["vertex"] == 1


def test_moran_against_dense_formula(spark, task_size):
    rng = np.random.default_rng(8)
    n = 60
    matrix = np.c_[np.repeat([0.0, 5.0], 30) + rng.normal(0, 0.1, n), rng.normal(size=n), np.ones(n)]
    links = [(i, (i + s) % 30 + (i // 30) * 30) for i in range(n) for s in (1, 2)]
    w = np.zeros((n, n))
    for a, b in links:
        w[a, b] = 1
    genes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "flat")], "pos int, gene string")
    got = spatial.morans_i(points_frame(spark, matrix), genes, spark.createDataFrame(links, "src long, dst long"))
    rows = {r["gene"]: r for r in got.collect()}
    assert set(rows) == {"a", "b"}
    for j, gene in enumerate("ab"):
        z = matrix[:, j] - matrix[:, j].mean()
        s0, s1 = w.sum(), 0.5 * ((w + w.T) ** 2).sum()
        s2 = ((w.sum(axis=0) + w.sum(axis=1)) ** 2).sum()
        i, e = n / s0 * (z @ w @ z) / (z @ z), -1 / (n - 1)
        k = n * (z**4).sum() / (z @ z) ** 2
        var = (
            n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - k * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)
        ) / ((n - 1) * (n - 2) * (n - 3) * s0**2) - e * e
        assert rows[gene]["morans_i"] == pytest.approx(i)
        assert rows[gene]["morans_test_statistic"] == pytest.approx((i - e) / np.sqrt(var))
    top = spatial.top_spatial_genes(got, 1).first()
    assert top["gene"] == "a"
