"""Neighbour graphs as edge tables: weights, communities, connected groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from guidescape.runtime import checkpointed, discard_shuffles, hot_keys, hot_keys_within, hot_lookup, release, total

# Rounds of local moves without a better score before a level ends although some vertices still want to move.
PATIENCE = 4


def _at(name: str, hubs: DataFrame | None) -> DataFrame | None:
    """Hot vertices under another column name."""
    return None if hubs is None else hubs.withColumnRenamed("dst", name)


def jaccard_graph(knn: DataFrame) -> DataFrame:
    """Weight of each neighbour edge: shared neighbours over the union of both neighbour lists.

    Only existing edges are weighed, so a cell that is everybody's neighbour adds one row per edge and never a pair per
    two of its admirers. Lists hold k ids each.
    """
    lists = knn.groupBy("src").agg(F.collect_set("dst").alias("_list"))
    own = lists.withColumnRenamed("_list", "_own")
    theirs = lists.select(F.col("src").alias("dst"), F.col("_list").alias("_theirs"))
    hubs = hot_keys_within(knn, ["dst"])
    both = hot_lookup(knn.select("src", "dst").join(own, "src"), theirs, ["dst"], hubs)
    shared = F.size(F.array_intersect("_own", "_theirs"))
    union = F.size("_own") + F.size("_theirs") - shared
    return both.select("src", "dst", (shared / union).alias("weight")).where(F.col("weight") > 0)


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge once, without loops; the larger weight wins."""
    forth = edges.select("src", "dst", "weight")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return forth.unionByName(back).where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def communities(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Modularity clustering: cell_id, community (the smallest cell of it), one row per vertex.

    Cells move between communities until modularity stops growing; then every community becomes one vertex, its inner
    weight a loop, and the same is done on the smaller graph, until a level gains nothing. A community that is not connected
    then falls into its connected parts, which can only raise modularity. Vertices without an edge (``vertices``: cell_id) are
    communities of their own.
    """
    whole = graph = checkpointed(undirected(edges))
    ends = graph.select(F.col("src").alias("cell_id"))
    ends = ends if vertices is None else ends.unionByName(vertices.select("cell_id"))
    labels = checkpointed(ends.distinct().select("cell_id", F.col("cell_id").alias("community")))
    loops = checkpointed(labels.select("cell_id", F.lit(0.0).alias("loop")))
    mass = graph.agg(F.sum("weight")).first()[0] or 1.0
    while not graph.isEmpty():
        made = _local_moves(graph, loops, mass)
        if made is None:
            break
        moved = made.select("cell_id", "community")
        step = moved.select(F.col("cell_id").alias("community"), F.col("community").alias("_next"))
        named = hot_lookup(labels, step, ["community"], hot_keys_within(labels, ["community"]), "left")
        named = checkpointed(named.select("cell_id", F.coalesce("_next", "community").alias("community")))
        smaller, grown = _contracted(graph, loops, moved)
        release(labels, loops, made, *([] if graph is whole else [graph]))
        labels, graph, loops = named, smaller, grown
    src = labels.select(F.col("cell_id").alias("src"), F.col("community").alias("_a"))
    dst = labels.select(F.col("cell_id").alias("dst"), F.col("community").alias("_b"))
    hubs = hot_keys_within(whole, ["dst"])
    ends = hot_lookup(whole, src, ["src"], _at("src", hubs))
    inner = checkpointed(hot_lookup(ends, dst, ["dst"], hubs).where("_a = _b").select("src", "dst"))
    parts = graph_partitions(labels, inner)
    release(inner, labels, loops, whole, *([] if graph is whole else [graph]))
    return parts.select("cell_id", F.col("partition").alias("community"))


def community_quality(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: communities, those of them that are connected, modularity."""
    src = labels.select(F.col("cell_id").alias("src"), F.col("community").alias("_a"))
    dst = labels.select(F.col("cell_id").alias("dst"), F.col("community").alias("_b"))
    inner = undirected(edges).join(src, "src").join(dst, "dst").where("_a = _b").select("src", "dst")
    parts = graph_partitions(labels, checkpointed(inner)).join(labels, "cell_id")
    per = parts.groupBy("community").agg((F.min("partition") == F.max("partition")).alias("_whole"))
    counts = per.agg(F.count(F.lit(1)).alias("communities"), F.sum(F.col("_whole").cast("long")).alias("connected"))
    return counts.withColumn("modularity", modularity(edges, labels).scalar())


def _contracted(graph: DataFrame, loops: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Communities as vertices: edges between them, and loops that hold both directions of what lies inside."""
    src = labels.select(F.col("cell_id").alias("src"), F.col("community").alias("_a"))
    dst = labels.select(F.col("cell_id").alias("dst"), F.col("community").alias("_b"))
    hubs = hot_keys_within(graph, ["dst"])
    ends = hot_lookup(graph, src, ["src"], _at("src", hubs))
    ends = hot_lookup(ends, dst, ["dst"], hubs)
    between = checkpointed(ends.groupBy(F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(F.sum("weight").alias("weight")))
    inner = between.where("src = dst").select(F.col("src").alias("cell_id"), F.col("weight").alias("loop"))
    kept = loops.join(labels, "cell_id").select(F.col("community").alias("cell_id"), "loop")
    grown = checkpointed(kept.unionByName(inner).groupBy("cell_id").agg(F.sum("loop").alias("loop")))
    outer = checkpointed(between.where("src <> dst"))
    release(between)
    return outer, grown


def _local_moves(graph: DataFrame, loops: DataFrame, mass: float) -> DataFrame | None:
    """A written table with the labels (cell_id, community) of the vertices with an edge, or None where no move gains.

    In each round half of the vertices, drawn anew by a hash, move to the neighbouring community with the largest gain, if that
    is larger than staying. Two single-vertex communities only merge towards the smaller id, so partners cannot swap places. A
    round's table also holds what the modularity before it is made of. Rounds end when nobody wants to move; as moves made at
    once may undo each other's gain, they also end after ``PATIENCE`` without a better score. The best labels are returned.
    Only the best and the last round stay on disk, and no round's shuffle outlives it.
    """
    hubs = hot_keys_within(graph, ["dst"])
    linked = graph.groupBy(F.col("src").alias("cell_id")).agg(
        F.sum("weight").alias("_out"), F.count(F.lit(1)).alias("_links")
    )
    degree = checkpointed(
        linked.join(loops, "cell_id", "left").select("cell_id", (F.col("_out") + F.coalesce("loop", F.lit(0.0))).alias("_k"), "_links")
    )
    labels = degree.select("cell_id", F.col("cell_id").alias("community"))
    best, last, score, idle, step = None, None, None, 0, 0
    while True:
        made = _one_round(graph, degree, labels, hubs, mass, step)
        step += 1
        inside, squares, wishes = made.agg(
            F.sum("_inside"), F.sum(F.col("_k") / mass * (F.col("_held") / mass)), F.sum(F.col("_wants").cast("long"))
        ).first()
        now = inside / mass - squares
        gone = last
        if score is None:
            score = now
        elif now > score + 1e-9:
            best, gone, score, idle = last, best, now, 0
        else:
            idle += 1
        release(*(t for t in [gone] if t is not None))
        last, labels = made, made.select("cell_id", "community")
        discard_shuffles(graph.sparkSession)
        if not wishes or idle > PATIENCE:
            break
    release(last, degree, *([] if hubs is None else [hubs]))
    return best


def _one_round(graph: DataFrame, degree: DataFrame, labels: DataFrame, hubs: DataFrame, mass: float, step: int) -> DataFrame:
    """New labels; per vertex also its degree _k, its weight to its old community, that one's mass, and whether it wants away."""
    held = degree.join(labels, "cell_id")
    sizes = held.groupBy("community").agg(
        F.sum("_k").alias("_mass"),
        F.count(F.lit(1)).alias("_members"),
        (F.sum("_links") + F.count(F.lit(1))).alias("_rows"),
    )
    # a community's rows are edges and vertices: where even all of them fit a task, none needs splitting
    large = None if hubs is None else hot_keys(sizes, ["community"], "_rows")
    sizes = sizes.drop("_rows")
    own_size = sizes.select("community", F.col("_members").alias("_own_members"))
    state = hot_lookup(
        held.select("cell_id", "_k", "community"), own_size, ["community"], large
    ).withColumnRenamed("community", "_own")
    theirs = labels.withColumnRenamed("cell_id", "dst")
    links = hot_lookup(graph, theirs, ["dst"], hubs).select(F.col("src").alias("cell_id"), "community", "weight")
    stay = labels.select("cell_id", "community", F.lit(0.0).alias("weight"))
    options = links.unionByName(stay).groupBy("cell_id", "community").agg(F.sum("weight").alias("_in"))
    options = hot_lookup(options, sizes, ["community"], large)
    options = hot_lookup(options, state, ["cell_id"], _at("cell_id", hubs))
    stays = F.col("community") == F.col("_own")
    others = F.col("_mass") - F.when(stays, F.col("_k")).otherwise(0.0)
    gain = F.round(F.col("_in") - F.col("_k") * others / mass, 12)
    allowed = stays | (F.col("_members") > 1) | (F.col("_own_members") > 1) | (F.col("community") < F.col("_own"))
    best = (
        options.where(allowed)
        .groupBy("cell_id")
        .agg(
            F.min(F.struct((-gain).alias("loss"), F.col("community").alias("community"))).alias("_best"),
            F.max(F.when(stays, -gain)).alias("_loss"),
            F.max(F.when(stays, F.col("_in"))).alias("_inside"),
            F.max(F.when(stays, F.col("_mass"))).alias("_held"),
            F.first("_own").alias("_own"),
            F.first("_k").alias("_k"),
        )
    )
    wants = F.col("_best.loss") < F.col("_loss")
    turn = F.pmod(F.xxhash64("cell_id", F.lit(step)), F.lit(2)) == 0
    moved = F.when(turn & wants, F.col("_best.community")).otherwise(F.col("_own"))
    return checkpointed(best.select("cell_id", moved.alias("community"), "_k", "_inside", "_held", wants.alias("_wants")))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of edge weight inside communities, minus what degrees alone would give."""
    graph = checkpointed(undirected(edges))
    mass = total(graph, F.sum("weight"))
    hubs = hot_keys_within(graph, ["dst"])
    src = labels.select(F.col("cell_id").alias("src"), F.col("community").alias("_a"))
    dst = labels.select(F.col("cell_id").alias("dst"), F.col("community").alias("_b"))
    ends = hot_lookup(graph, src, ["src"], _at("src", hubs))
    ends = hot_lookup(ends, dst, ["dst"], hubs)
    per = ends.groupBy(F.col("_a").alias("community")).agg(
        F.sum(F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0.0)).alias("_in"),
        F.sum("weight").alias("_all"),
    )
    share = F.col("_all") / mass
    return per.select((F.col("_in") / mass - share * share).alias("_q")).agg(F.sum("_q").alias("modularity"))


def graph_partitions(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected groups: cell_id, partition (the smallest cell of the group).

    Every round takes the smallest label among neighbours and then follows labels one step, until nothing changes.
    """
    forth = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    graph = checkpointed(forth.unionByName(back).where("src <> dst").distinct())
    hubs = hot_keys_within(graph, ["dst"])
    table = checkpointed(vertices.select("cell_id", F.col("cell_id").alias("partition")))
    labels = table
    while True:
        seen = labels.select(F.col("cell_id").alias("dst"), F.col("partition").alias("_seen"))
        lowest = hot_lookup(graph, seen, ["dst"], hubs).groupBy(F.col("src").alias("cell_id")).agg(
            F.min("_seen").alias("_low")
        )
        hooked = checkpointed(
            labels.join(lowest, "cell_id", "left").select(
                "cell_id",
                F.col("partition").alias("_before"),
                F.least("partition", "_low").alias("_label"),
            )
        )
        ahead = hooked.select(F.col("cell_id").alias("_label"), F.col("_label").alias("partition"))
        hot = hot_keys_within(hooked, ["_label"])
        jumped = checkpointed(hot_lookup(hooked, ahead, ["_label"], hot))
        release(table, hooked, *([] if hot is None else [hot]))
        table, labels = jumped, jumped.select("cell_id", "partition")
        settled = jumped.where(F.col("partition") != F.col("_before")).isEmpty()
        del seen, lowest, hooked, ahead
        discard_shuffles(graph.sparkSession)
        if settled:
            release(graph, *([] if hubs is None else [hubs]))
            return labels


def follow_parents(pointers: DataFrame) -> DataFrame:
    """Root of every cell in a forest given as (cell_id, parent), roots pointing at themselves, by pointer jumping."""
    table = checkpointed(pointers.select("cell_id", "parent"))
    pointers = table
    while True:
        ahead = pointers.select(F.col("cell_id").alias("parent"), F.col("parent").alias("_next"))
        hot = hot_keys_within(pointers, ["parent"])
        jumped = checkpointed(hot_lookup(pointers, ahead, ["parent"], hot))
        release(table, *([] if hot is None else [hot]))
        table, pointers = jumped, jumped.select("cell_id", F.col("_next").alias("parent"))
        settled = jumped.where(F.col("_next") != F.col("parent")).isEmpty()
        discard_shuffles(jumped.sparkSession)
        if settled:
            return pointers
