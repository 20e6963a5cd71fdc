"""Interactive queries: search, expansion, excerpts, repeat collapse, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..schema import EvidenceGraph


def visible_in_run(nodes: DataFrame, run_id: str | None) -> DataFrame:
    """Nodes of the run and nodes without a run (all, if no run is asked for)."""
    return nodes if run_id is None else nodes.where(F.col("run_id").isNull() | (F.col("run_id") == run_id))


def run_values(nodes: DataFrame, run_id: str) -> DataFrame:
    """(id, kind) of the values that go into a run and come out of it."""
    return nodes.where((F.col("identity_kind") == "value") & F.col("kind").isin("input", "output") & (F.col("run_id") == run_id)).select("id", "kind")


def definitions_in_run(nodes: DataFrame, run_id: str) -> DataFrame:
    """(definition_id, label) of the definitions that occur in a run."""
    seen = nodes.where((F.col("identity_kind") == "occurrence") & (F.col("run_id") == run_id)).select("definition_id").distinct()
    return seen.join(nodes.select(F.col("id").alias("definition_id"), "label"), "definition_id").select("definition_id", "label")


def search_text(nodes: DataFrame) -> DataFrame:
    """Adds ``haystack``: id, label, kind, role, paths, symbols, tensor texts and shape, keys and values of scalar attributes, lowered."""
    scalars = F.transform(F.filter(tx.attribute_parts(F.col("attributes_json")), lambda a: a["kind"] == "scalar"), lambda a: F.concat_ws(" ", a["key"], a["text"]))
    parts = [
        F.col("id"), F.col("label"), F.col("kind"), F.col("role"),
        F.array_join(F.transform("source", lambda s: s["path"]), " "), F.array_join(F.transform("source", lambda s: s["symbol"]), " "),
        F.col("tensor.dtype"), F.col("tensor.device"), F.array_join("tensor.semantics", " "), tx.shape_text(F.col("tensor.shape")), F.array_join(scalars, " "),
    ]
    return nodes.withColumn("haystack", F.lower(F.concat_ws(" ", *parts)))


def search_score(query: str) -> Column:
    """Score of a node that holds all tokens of the query."""
    q = query.strip().lower()
    label, role = F.lower("label"), F.lower("role")
    paths = F.lower(F.array_join(F.transform("source", lambda s: s["path"]), " "))
    tensor = F.lower(F.concat_ws(" ", "tensor.dtype", "tensor.device", F.array_join("tensor.semantics", " ")))
    has = lambda c: F.coalesce(F.contains(c, F.lit(q)), F.lit(False))
    name = (
        F.when((F.lower("id") == q) | (label == q), 100).when(F.startswith(label, F.lit(q)), 70).when(has(label), 50).otherwise(0)
    )
    return F.lit(10 * len(q.split())) + name + F.when(has(role), 40).otherwise(0) + F.when(has(paths), 30).otherwise(0) + F.when(has(tensor), 20).otherwise(0)


def search(nodes: DataFrame, query: str, run_id: str | None = None, limit: int = 50) -> DataFrame:
    """Ranked nodes whose text holds every token: (key, id, label, score), by score, lowered label, key."""
    if limit < 1:
        raise ValueError("limit must be positive")
    tokens = query.strip().lower().split()
    found = search_text(visible_in_run(nodes, run_id))
    for token in tokens:
        found = found.where(F.contains("haystack", F.lit(token)))
    key = tx.node_key(tx.explorer_level(F.col("level")), F.col("id"))
    out = found.select(key.alias("key"), "id", "label", search_score(query).alias("score"))
    return out.orderBy(F.desc("score"), F.lower("label"), "key").limit(limit) if tokens else out.limit(0)


def top_members(membership: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Members that have no parent inside the same group."""
    inner = membership.join(hierarchy, membership["member_id"] == hierarchy["parent"]).select("group_id", F.col("child").alias("member_id"))
    return membership.join(inner, ["group_id", "member_id"], "left_anti")


def expand(children: DataFrame, limit: int = 200) -> DataFrame:
    """(parent, child, position, child_count, truncated): the first ``limit`` children by id and the whole count."""
    if limit < 1:
        raise ValueError("limit must be positive")
    count = children.groupBy("parent").agg(F.count("*").alias("child_count"))
    ranked = children.withColumn("position", F.row_number().over(Window.partitionBy("parent").orderBy("child"))).where(F.col("position") <= limit)
    return ranked.join(count, "parent").select("parent", "child", "position", "child_count", (F.col("child_count") > limit).alias("truncated"))


def children_of(graph: EvidenceGraph, run_id: str | None = None) -> DataFrame:
    """(parent, child) of every node as expanded: top members of groups, mechanical children, or flow neighbours of childless operations."""
    nodes = visible_in_run(graph.nodes, run_id)
    hierarchy, flow = graph.hierarchy(), graph.flow()
    groups = top_members(graph.membership(), hierarchy).select(F.col("group_id").alias("parent"), F.col("member_id").alias("child"))
    neighbours = flow.select(F.col("src").alias("parent"), F.col("dst").alias("child")).unionByName(flow.select(F.col("dst").alias("parent"), F.col("src").alias("child"))).distinct()
    leaves = nodes.where(~F.col("level").isin("paper", "semantic", "module", "source")).select(F.col("id").alias("parent")).join(hierarchy, "parent", "left_anti")
    beside = neighbours.join(leaves, "parent", "left_semi")
    shown = nodes.select(F.col("id").alias("child"))
    return hierarchy.unionByName(groups).unionByName(beside).distinct().join(shown, "child", "left_semi").select("parent", "child")


def collapse_repeats(children: DataFrame, least: int = 3) -> DataFrame:
    """(parent, row_id, label, members): ``least`` and more siblings of one definition as one row.

    ``children`` has (parent, child, label, definition_id, definition_label).
    """
    # a count and a join: a parent with very many children without a definition is no window's group
    counts = children.where("definition_id is not null").groupBy("parent", "definition_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    counted = children.join(counts, ["parent", "definition_id"], "left")
    many = F.col("definition_id").isNotNull() & (F.col("n") >= least)
    row = F.when(many, F.concat(F.lit("repeat:"), "parent", F.lit(":definition:"), "definition_id")).otherwise(F.col("child"))
    label = F.when(many, F.concat("definition_label", F.lit(" ×"), F.col("n").cast("string"))).otherwise(F.col("label"))
    return counted.select("parent", row.alias("row_id"), label.alias("label")).groupBy("parent", "row_id", "label").agg(F.count("*").alias("members"))


def overlaid(nodes: DataFrame, overlays: DataFrame) -> DataFrame:
    """Labels replaced by non-blank aliases of overlays (id, alias)."""
    found = nodes.join(overlays.select("id", "alias"), "id", "left")
    return found.withColumn("label", F.coalesce(F.nullif(F.trim("alias"), F.lit("")), "label")).drop("alias")


def excerpts(spans: DataFrame, files: DataFrame, context: int = 3, max_excerpts: int = 8) -> DataFrame:
    """(id, n, line, text) of the first spans (id, n, path, start_line, end_line) of each node, with context lines.

    ``files`` has (path, text); paths that leave the root (``..`` or absolute) give nothing.
    """
    if context < 0 or max_excerpts < 0:
        raise ValueError("context and max_excerpts must not be negative")
    inside = spans.where(F.col("n") < max_excerpts).where(~F.startswith("path", F.lit("/")) & ~F.contains(F.concat(F.lit("/"), "path", F.lit("/")), F.lit("/../")))
    first = F.greatest(F.lit(1), F.col("start_line") - context)
    # only the lines asked for are exploded, not whole files
    wanted = F.slice(F.split("text", "\n"), first, F.greatest(F.lit(0), F.col("end_line") + context - first + 1))
    lines = inside.join(files, "path").select("id", "n", first.alias("first"), F.posexplode(wanted).alias("at", "text"))
    return lines.select("id", "n", (F.col("first") + F.col("at")).alias("line"), "text")


def inspect(graph: EvidenceGraph, node_id: str) -> dict[str, DataFrame]:
    """Evidence, claims and conflicts of one node."""
    node = graph.nodes.where(F.col("id") == node_id)
    evidence = graph.evidence.join(node.select(F.explode("evidence_ids").alias("id")).distinct(), "id", "left_semi")
    claims = graph.claims.where(F.col("subject_id") == node_id)
    named = graph.conflicts.select("id", F.explode("claim_ids").alias("claim_id")).join(claims.select(F.col("id").alias("claim_id")), "claim_id", "left_semi")
    return {"evidence": evidence, "claims": claims, "conflicts": graph.conflicts.join(named.select("id").distinct(), "id", "left_semi")}
