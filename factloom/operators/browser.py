"""Explorer rows and the browser's forms of search, lineage, paper edges and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..plans.stages import Stages
from ..schema import EvidenceGraph
from . import explore, project, traverse


def _attribute(name: str) -> Column:
    return F.get_json_object("attributes_json", f"$.{name}")


def semantic_allowed(nodes: DataFrame, phase: str = "all") -> DataFrame:
    """Semantic nodes that are more than declared and belong to the phase (no phase belongs to all)."""
    own = _attribute("phase")
    fits = F.lit(True) if phase == "all" else own.isNull() | own.isin("both", phase)
    return nodes.where((F.col("level") == "semantic") & (F.coalesce(_attribute("declaration_only"), F.lit("false")) != "true") & fits)


def available_runs(graph: EvidenceGraph) -> DataFrame:
    """(id) of all runs in order."""
    return graph.runs.select("id").orderBy("id")


def explorer_rows(nodes: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """Nodes as explorer rows with key, child count and metadata (attributes, evidence, tensor, confidence, modalities, phase).

    ``children`` has (parent, child_count); nodes without a row there have none.
    """
    level = tx.explorer_level(F.col("level"))
    metadata = F.to_json(F.struct(
        F.try_parse_json(F.coalesce("attributes_json", F.lit("{}"))).alias("attributes"), "evidence_ids", "tensor", _attribute("confidence").cast("double").alias("confidence"),
        F.from_json(_attribute("modalities"), "array<string>").alias("modalities"), _attribute("phase").alias("phase"),
    ))
    count = F.coalesce("child_count", F.lit(0)).cast("long")
    rows = nodes.join(children.select(F.col("parent").alias("id"), "child_count"), "id", "left") if children is not None else nodes.withColumn("child_count", F.lit(0))
    return rows.select(
        tx.node_key(level, F.col("id")).alias("key"), F.col("id").alias("entity_id"), level.alias("level"), "label", "kind", "role", "identity_kind",
        count.alias("child_count"), "run_id", "occurrence_index", "definition_id", "source", metadata.alias("metadata_json"),
    )


def node(graph: EvidenceGraph, key: str, run_id: str | None = None) -> DataFrame:
    """The explorer row of one key, if the run shows it; no row otherwise."""
    wanted = explore.visible_in_run(graph.nodes, run_id).where(tx.node_key(tx.explorer_level(F.col("level")), F.col("id")) == key)
    below = explore.children_of(graph, run_id).join(wanted.select(F.col("id").alias("parent")), "parent", "left_semi")
    return explorer_rows(wanted, below.groupBy("parent").agg(F.count("*").alias("child_count")))


def paper_slice(graph: EvidenceGraph, phase: str | None = None, max_components: int = 12) -> tuple[DataFrame, DataFrame, int]:
    """(rows, edges, candidates) of the paper level: components as explorer rows, quotient edges with their evidence edges."""
    chosen, rolled = project.paper_view(graph, phase=phase, limit=max_components)
    extra = graph.nodes.select(F.col("id").alias("group_id"), F.to_json(F.struct(F.from_json(_attribute("member_ids"), "array<string>").alias("member_ids"), F.from_json(_attribute("modalities"), "array<string>").alias("modalities"), _attribute("confidence").cast("double").alias("confidence"))).alias("metadata_json"))
    paper = lambda column: tx.node_key(F.lit("paper"), F.col(column))
    rows = chosen.join(extra, "group_id").select("rank", paper("group_id").alias("key"), F.col("group_id").alias("entity_id"), F.lit("paper").alias("level"), "label", F.lit("paper_component").alias("kind"), "role", F.lit(1).alias("child_count"), "metadata_json")
    place = F.row_number().over(Window.orderBy("src", "dst")) - 1  # at most the square of ``max_components`` rows
    edges = rolled.select(F.concat(F.lit("paper-edge:"), place.cast("string")).alias("key"), paper("src").alias("source_key"), paper("dst").alias("target_key"), F.lit("data").alias("kind"), F.col("edge_ids").alias("entity_edge_ids"))
    return rows, edges, chosen.count()


def browser_search(nodes: DataFrame, query: str, run_id: str | None = None, limit: int = 80) -> DataFrame:
    """Ranked nodes whose id, label, role, kind, places and tensor hold every token: (id, label, score), by score, then label."""
    wanted = query.strip().lower()
    tokens = wanted.split()
    places = F.array_join(F.transform("source", lambda s: F.concat_ws(" ", s["path"], s["symbol"])), " ")
    shape = F.to_json(F.transform("tensor.shape", lambda d: F.coalesce(d["size"].cast("string"), d["symbol"])))
    held = F.lower(F.concat_ws(" ", "id", "label", "role", "kind", places, "tensor.dtype", "tensor.device", F.array_join("tensor.semantics", " "), F.translate(shape, '"', "")))
    found = explore.visible_in_run(nodes, run_id).withColumn("held", held)
    for token in tokens:
        found = found.where(F.contains("held", F.lit(token)))
    label = F.lower("label")
    name = F.when((label == wanted) | (F.lower("id") == wanted), 100).when(F.startswith(label, F.lit(wanted)), 60).otherwise(0)
    role = F.when(F.contains(F.lower(F.coalesce("role", F.lit(""))), F.lit(wanted)), 40).otherwise(0)
    out = found.select("id", "label", (F.lit(10 * len(tokens)) + name + role).alias("score"))
    return out.orderBy(F.desc("score"), "label", "id").limit(limit) if tokens else out.limit(0)


def soft_lineage(graph: EvidenceGraph, origin: str, downstream: bool = True, run_id: str | None = None, max_nodes: int = 2500) -> tuple[DataFrame, DataFrame]:
    """(nodes (id), edges (edge_id)): breadth-first flow from a node or a group's members with a soft bound.

    Nodes are opened in the order they were met (edges by id) until ``max_nodes`` have
    been met; an opened node brings all its edges, so the bound may be passed by one
    node's neighbours.  The ordering windows hold one level of at most ``max_nodes`` nodes
    and their edges.
    """
    spark = graph.nodes.sparkSession
    stages = Stages(spark, "soft")
    there = explore.visible_in_run(graph.nodes, run_id).select("id")
    flow = graph.flow().join(there.withColumnRenamed("id", "dst" if downstream else "src"), "dst" if downstream else "src", "left_semi")
    ends = ("src", "dst") if downstream else ("dst", "src")
    steps = stages.laid_out(flow.select("edge_id", F.col(ends[0]).alias("a"), F.col(ends[1]).alias("b")), "a")
    group = graph.nodes.where((F.col("id") == origin) & (F.col("level") == "semantic")).head(1)
    start = graph.membership().where(F.col("group_id") == origin).select(F.col("member_id").alias("id")).distinct() if group else spark.createDataFrame([(origin,)], "id string")
    front = stages.write(start.withColumn("rank", F.row_number().over(Window.orderBy("id"))))
    seen, edges, met = front.select("id"), None, front.count()
    while met < max_nodes and front.head(1):
        out = stages.write(steps.join(front.select(F.col("id").alias("a"), "rank"), "a"))
        first = out.join(seen.select(F.col("id").alias("b")), "b", "left_anti").groupBy("b").agg(F.min(F.struct("rank", "edge_id")).alias("at"))
        fresh = stages.write(first.select(F.col("b").alias("id"), F.col("at.rank").alias("by"), F.row_number().over(Window.orderBy("at")).alias("rank")))
        # the node that reaches the bound is opened still; those after it are not
        last = fresh.where(F.col("rank") >= max_nodes - met).agg(F.min("by").alias("by")).first()["by"]
        within = (lambda column: F.lit(True)) if last is None else lambda column: F.col(column) <= last
        used = out.where(within("rank")).select("edge_id")
        edges = used if edges is None else edges.unionByName(used)
        front = stages.write(fresh.where(within("by")).select("id", "rank"))
        seen = seen.unionByName(front.select("id"))
        met += front.count()
        if last is not None:
            break
    steps.unpersist()
    return seen, graph.flow().select("edge_id").limit(0) if edges is None else edges.distinct()


def ancestors_to_reveal(hierarchy: DataFrame, membership: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, ancestor): what has to be open to show each node: its smallest group and its chain of smallest parents."""
    chain = traverse.parent_chain(hierarchy, nodes).where("depth > 0").select("id", "ancestor")
    own = nodes.select("id").join(membership.groupBy(F.col("member_id").alias("id")).agg(F.min("group_id").alias("ancestor")), "id")
    return chain.unionByName(own).distinct()


def paper_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, kind, n_edges, first_edge, last_edge) of flow edges (edge_id, source, target, kind) between groups; several kinds make ``data``.

    ``members`` has (member_id, group_id), one group a member.
    """
    out = edges.join(members.select(F.col("member_id").alias("source"), F.col("group_id").alias("src")), "source")
    both = out.join(members.select(F.col("member_id").alias("target"), F.col("group_id").alias("dst")), "target").where("src <> dst")
    rolled = both.groupBy("src", "dst").agg(F.min("kind").alias("low"), F.max("kind").alias("high"), F.count_distinct("edge_id").alias("n_edges"), F.min("edge_id").alias("first_edge"), F.max("edge_id").alias("last_edge"))
    return rolled.select("src", "dst", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("data").alias("kind"), "n_edges", "first_edge", "last_edge")


def overlay_export(overlays: DataFrame, project_name: str) -> DataFrame:
    """(name, json): the overlays (id, alias, note) of a project as one JSON document and its file name.

    Overlays are typed in by hand; one document holds them all.
    """
    record = F.struct(F.col("alias"), F.col("note"))
    one = overlays.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", record.alias("v"))))).alias("overlays"))
    name = F.concat(F.lower(F.regexp_replace(F.lit(project_name), "(?i)[^a-z0-9]+", "-")), F.lit("-overlays.json"))
    return one.select(name.alias("name"), F.to_json(F.struct(F.lit(project_name).alias("project"), "overlays")).alias("json"))


def selection_history(selections: DataFrame, keep: int = 80) -> DataFrame:
    """(seq, id): the last ``keep`` selections (seq, id) of a session, a repeat of the one before left out."""
    before = F.lag("id").over(Window.orderBy("seq"))  # one session's clicks
    changed = selections.withColumn("before", before).where(~F.col("id").eqNullSafe(F.col("before"))).where("id is not null")
    return changed.select("seq", "id").orderBy(F.desc("seq")).limit(keep).orderBy("seq")


def related(graph: EvidenceGraph, subjects: DataFrame) -> DataFrame:
    """(subject_id, id): the mechanical nodes of semantic nodes (id): listed members and all that is under them.

    Children are targets of any contains edge and nodes that name a parent.
    """
    listed = graph.nodes.join(subjects.select("id").distinct(), "id", "left_semi").where("level = 'semantic'")
    members = listed.select(F.col("id").alias("subject_id"), F.explode(F.from_json(_attribute("member_ids"), "array<string>")).alias("member"))
    own = graph.nodes.select(F.explode("parent_ids").alias("src"), F.col("id").alias("dst"))
    down = own.unionByName(graph.edges.where("kind = 'contains'").select(F.col("source").alias("src"), F.col("target").alias("dst")))
    under = traverse.closure(down, members.select(F.col("member").alias("id")))
    every = members.join(under.select(F.col("origin").alias("member"), "id"), "member").select("subject_id", "id").distinct()
    return every.join(graph.nodes.where("level <> 'semantic'").select("id"), "id", "left_semi").select("subject_id", "id")


def claim_counts(graph: EvidenceGraph) -> DataFrame:
    """One row: claims of authors and conflicts of authors with the implementation."""
    claims = graph.claims.agg(F.count_if(F.startswith("id", F.lit("claim.author."))).alias("claim_count"))
    return claims.crossJoin(graph.conflicts.agg(F.count_if(F.col("kind") == "author_implementation_mismatch").alias("conflict_count")))  # one row each
