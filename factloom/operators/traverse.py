"""Iterative graph operators as frontier joins.

Every operator takes edges (src, dst) and keeps its state in tables written between
rounds (``Stages``); the driver sees one count a round.  The edges are dealt by their
source once, so a round moves the frontier and not the graph.  The visited set is joined
anti, so cycles end; it is written anew as one table every ``COMPACT`` rounds.  Rounds go
on until nothing is new: a depth is a limit only where the caller gives one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.stages import Stages


#: Rounds between two compactions of the visited set.
COMPACT = 8


def _spread(stages: Stages, edges: DataFrame, front: DataFrame, key: list[str], max_depth: int | None, depth: bool) -> DataFrame:
    """Everything that the frontier (``key``, with ``id``) leads to, by rounds."""
    edges = stages.laid_out(edges.select("src", "dst").distinct(), "src")
    carried = [c for c in key if c != "id"]
    seen, parts, n = front, 1, 0
    while (max_depth is None or n < max_depth) and front.head(1):
        n += 1
        step = edges.join(front.select(*carried, F.col("id").alias("src")), "src").select(*carried, F.col("dst").alias("id")).distinct()
        fresh = step.join(seen, key, "left_anti")
        front = stages.write(fresh.withColumn("depth", F.lit(n)) if depth else fresh)
        seen, parts = seen.unionByName(front), parts + 1
        if parts > COMPACT:
            seen, parts = stages.write(seen), 1
    edges.unpersist()
    return seen


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, keep_origin: bool = False) -> DataFrame:
    """(id, depth), with ``origin`` too if kept: everything reachable from seeds (id) and its least depth."""
    stages = Stages(edges.sparkSession, "reach")
    key = ["origin", "id"] if keep_origin else ["id"]
    start = seeds.select("id").distinct()
    front = start.select(F.col("id").alias("origin"), "id") if keep_origin else start
    return _spread(stages, edges, stages.write(front.withColumn("depth", F.lit(0))), key, max_depth, True)


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(origin, id, depth) for every seed."""
    return reach(edges, seeds, max_depth, keep_origin=True)


def khop(edges: DataFrame, seeds: DataFrame, radius: int = 2) -> DataFrame:
    """(id, depth) within ``radius`` steps, ignoring direction."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return reach(both, seeds, radius)


def bounded_lineage(flow: DataFrame, origins: DataFrame, max_depth: int = 32, max_nodes: int = 2000) -> tuple[DataFrame, DataFrame, bool]:
    """Ordered breadth-first lineage with a node bound: (nodes (id, depth), edges (edge_id), truncated).

    ``flow`` has (edge_id, src, dst, kind).  Candidate edges of a level are ordered by
    (rank of the source, kind, edge id); a new target takes the place of its first edge.
    When a target would exceed ``max_nodes``, edges after that one are left out, as is
    the target itself.  A level leaves at most ``max_nodes`` nodes, which bounds the
    one-partition ordering window.
    """
    if max_depth < 0 or max_nodes < 1:
        raise ValueError("max_depth must not be negative and max_nodes must be positive")
    stages = Stages(flow.sparkSession, "lineage")
    flow = stages.write(flow.select("edge_id", "src", "dst", "kind"))
    order = Window.orderBy("id")
    first = stages.write(origins.select("id").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_nodes))
    truncated = origins.select("id").distinct().limit(max_nodes + 1).count() > max_nodes
    seen = first.select("id", F.lit(0).alias("depth"))
    front, edges, count = first, None, first.count()
    for depth in range(1, max_depth + 1):
        if truncated:
            break
        numbered = stages.write(
            front.join(flow, front["id"] == flow["src"]).select("rank", "kind", "edge_id", "dst").withColumn("place", F.row_number().over(Window.orderBy("rank", "kind", "edge_id")))
        )
        fresh = numbered.join(seen.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy("dst").agg(F.min("place").alias("place"))
        ranked = stages.write(fresh.withColumn("rank", F.row_number().over(Window.orderBy("place"))))
        room = max_nodes - count
        over = ranked.where(F.col("rank") > room).agg(F.min("place").alias("cut")).first()["cut"]
        kept = numbered.select("edge_id") if over is None else numbered.where(F.col("place") <= over).select("edge_id")
        edges = kept if edges is None else edges.unionByName(kept)
        front = ranked.where(F.col("rank") <= room).select(F.col("dst").alias("id"), "rank")
        added = front.count()
        count += added
        seen = seen.unionByName(front.select("id", F.lit(depth).alias("depth")))
        truncated = over is not None
        if not added:
            break
    edges = flow.select("edge_id").limit(0) if edges is None else edges.distinct()
    return seen, edges, truncated


def shortest_path(edges: DataFrame, source: str, target: str) -> list[str]:
    """Ids of one shortest path (fewest edges, then smallest ids backwards); empty if there is none."""
    stages = Stages(edges.sparkSession, "path")
    edges = stages.laid_out(edges.select("src", "dst").distinct(), "src")
    seen = front = stages.write(edges.sparkSession.createDataFrame([(source, None)], "id string, parent string"))
    levels = [front]
    found, parts = source == target, 1
    while not found and front.head(1):
        step = edges.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = stages.write(step.join(seen.select("id"), "id", "left_anti"))
        levels.append(front)
        seen, parts = seen.unionByName(front), parts + 1
        if parts > COMPACT:
            seen, parts = stages.write(seen), 1
        found = bool(front.where(F.col("id") == target).head(1))
    edges.unpersist()
    if not found:
        return []
    path = [target]
    for level in reversed(levels[1:]):  # one point lookup a level
        path.append(level.where(F.col("id") == path[-1]).first()["parent"])
    return path[::-1]


def label_fixpoint(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label): seed labels (id, label) carried along edges until nothing changes.

    Labels are a small fixed domain.  A node with one incoming edge has its own labels and
    its predecessor's, so runs of such nodes are jumped over by doubling (a chain of n
    nodes takes log n rounds); what is left is a graph of the other nodes, whose edges
    carry the labels met on the runs, and its rounds are semi-naive.
    """
    stages = Stages(edges.sparkSession, "labels")
    plain = stages.write(edges.select("src", "dst").where("src <> dst").distinct())
    seeds = stages.write(labels.select("id", "label").where("label is not null").groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("own")))
    none = F.array().cast("array<string>")
    only = plain.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("up")).where("n = 1").select(F.col("dst").alias("id"), "up")
    # (id, up, met): the nearest ancestor known so far and the labels from the node up to below it
    jump = stages.write(only.join(seeds, "id", "left").select("id", "up", F.coalesce("own", none).alias("met")))
    far, left = None, jump.count()
    while left:
        above = jump.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("met").alias("met2"))
        longer = stages.write(jump.join(above, "up", "left").select("id", F.coalesce("up2", "up").alias("up"), F.array_union("met", F.coalesce("met2", none)).alias("met"), F.col("up2").isNotNull().alias("more")))
        far, jump, before = longer, longer.select("id", "up", "met"), left
        left = longer.where("more").count()
        if left == before:  # the rest hangs from cycles without any entry
            break
    hung = far.where("more").select("id") if left else None
    runs = jump if hung is None else stages.write(jump.join(hung, "id", "left_anti"))
    # edges into the other nodes start at the roots of the runs and bring what the runs meet
    inner = plain.join(runs.select(F.col("id").alias("dst")), "dst", "left_anti").join(runs.select(F.col("id").alias("src"), "up", "met"), "src", "left")
    inner = stages.write(inner.select(F.coalesce("up", "src").alias("src"), "dst", "met"))
    brought = inner.where("met is not null").select(F.col("dst").alias("id"), F.explode("met").alias("label"))
    start = stages.write(brought.unionByName(seeds.select("id", F.explode("own").alias("label")).join(runs.select("id"), "id", "left_anti")).distinct())
    known = _spread(stages, inner.select("src", "dst"), start, ["id", "label"], None, False)
    met = runs.select("id", F.explode("met").alias("label"))
    passed = runs.join(known.select(F.col("id").alias("up"), "label"), "up").select("id", "label")
    return known.unionByName(met).unionByName(passed).distinct()


def parent_chain(hierarchy: DataFrame, nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, ancestor, depth): the chain of smallest parents of each node (id), itself at depth 0."""
    up = hierarchy.groupBy("child").agg(F.min("parent").alias("parent"))
    chain = closure(up.select(F.col("child").alias("src"), F.col("parent").alias("dst")), nodes, max_depth)
    return chain.select(F.col("origin").alias("id"), F.col("id").alias("ancestor"), "depth")


def breadcrumbs(hierarchy: DataFrame, membership: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, position, crumb): the smallest group of the node or of its nearest grouped ancestor, then ancestors from the top."""
    chain = parent_chain(hierarchy, nodes)
    groups = membership.groupBy(F.col("member_id").alias("ancestor")).agg(F.min("group_id").alias("group_id"))
    prefix = chain.join(groups, "ancestor").groupBy("id").agg(F.min_by("group_id", "depth").alias("crumb"), F.lit(2**31 - 1).alias("depth"))
    rows = chain.select("id", F.col("ancestor").alias("crumb"), "depth").unionByName(prefix.select("id", "crumb", "depth"))
    return rows.select("id", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("depth"))).alias("position"), "crumb")


def nearest_of_level(hierarchy: DataFrame, nodes: DataFrame, level: str = "module") -> DataFrame:
    """(id, anchor): the nearest node of ``level`` upwards (ties to the smaller id), the node itself included, else itself."""
    up = closure(hierarchy.select(F.col("child").alias("src"), F.col("parent").alias("dst")), nodes.select("id"))
    at = nodes.where(F.col("level") == level).select(F.col("id").alias("anchor"))
    near = up.join(at, up["id"] == at["anchor"]).groupBy("origin").agg(F.min_by("anchor", F.struct("depth", "anchor")).alias("anchor"))
    return nodes.select("id").join(near.withColumnRenamed("origin", "id"), "id", "left").select("id", F.coalesce("anchor", "id").alias("anchor"))


def first_group(membership: DataFrame, hierarchy: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(member_id, group_id): members and all under them, each given to its first group (by ``order`` (group_id, rank), else by id)."""
    down = hierarchy.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    under = closure(down, membership.select(F.col("member_id").alias("id")))
    all_members = membership.join(under, membership["member_id"] == under["origin"]).select("group_id", F.col("id").alias("member_id"))
    if order is None:
        return all_members.groupBy("member_id").agg(F.min("group_id").alias("group_id"))
    return all_members.join(order, "group_id").groupBy("member_id").agg(F.min_by("group_id", F.struct("rank", "group_id")).alias("group_id"))


def layer_ranks(edges: DataFrame, nodes: DataFrame, max_rank: int = 1000) -> DataFrame:
    """(id, rank): longest-path relaxation, at most one round fewer than nodes and never over ``max_rank``.

    Only nodes whose rank has risen push in the next round.
    """
    stages = Stages(edges.sparkSession, "layers")
    edges = stages.laid_out(edges.select("src", "dst").where("src <> dst").distinct(), "src")
    ranks = moved = stages.write(nodes.select("id").distinct().withColumn("rank", F.lit(0)))
    for _ in range(min(max_rank, max(1, ranks.count() - 1))):
        push = edges.join(moved.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg((F.max("rank") + 1).alias("up"))
        after = stages.write(ranks.join(push, "id", "left").select("id", F.greatest("rank", F.coalesce("up", F.lit(0))).cast("int").alias("rank"), (F.coalesce("up", F.lit(0)) > F.col("rank")).alias("moved")))
        ranks, moved = after.select("id", "rank"), after.where("moved").select("id", "rank")
        if not moved.head(1):
            break
    edges.unpersist()
    return ranks


def visible(hierarchy: DataFrame, roots: DataFrame, expanded: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots and, under every expanded visible node, its children: (nodes (id, depth), induced edges but contains)."""
    open_ = hierarchy.join(expanded.select(F.col("id").alias("parent")), "parent", "left_semi")
    shown = reach(open_.select(F.col("parent").alias("src"), F.col("child").alias("dst")), roots)
    return shown, induced(edges.where("kind <> 'contains'"), shown)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id)."""
    ends = nodes.select("id")
    inner = edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi")
    return inner.join(ends.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)
