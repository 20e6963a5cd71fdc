"""Component selection and the quotient graph over selected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.rules import ROLES
from ..schema import EvidenceGraph


def quotient(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, n_edges, min_edge, max_edge): edges (edge_id, source, target) between different groups.

    ``members`` has (member_id, group_id), one group a member; the counts are partial
    aggregates, so a hot pair of groups is no hot task.
    """
    out = edges.join(members.select(F.col("member_id").alias("source"), F.col("group_id").alias("src")), "source")
    both = out.join(members.select(F.col("member_id").alias("target"), F.col("group_id").alias("dst")), "target")
    return both.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n_edges"), F.min("edge_id").alias("min_edge"), F.max("edge_id").alias("max_edge"))


def components(graph: EvidenceGraph, phase: str | None = None, min_confidence: float = 0.55, declarations: bool = False, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), limit: int = 12) -> DataFrame:
    """(group_id, label, role, rank): semantic components that pass, by role priority, first source place and id."""
    if not 0 <= min_confidence <= 1 or limit < 0:
        raise ValueError("min_confidence must be within 0..1 and limit not negative")
    a = lambda name: F.get_json_object("attributes_json", f"$.{name}")
    priority = F.coalesce(*[F.when(F.col("role") == r, p) for r, _, _, _, p, _ in ROLES], F.lit(999))
    rows = graph.nodes.where("level = 'semantic'").where(tx.confidence(a("confidence"), 0.0) >= min_confidence).where(tx.phase_matches(a("phase"), phase))
    if not declarations:
        rows = rows.where(F.coalesce(a("declaration_only"), F.lit("false")) != "true")
    if include:
        rows = rows.where(F.col("role").isin(*include))
    if exclude:
        rows = rows.where(F.col("role").isNull() | ~F.col("role").isin(*exclude))
    first = F.get("source", F.lit(0))
    order = Window.orderBy(priority, F.coalesce(first["path"], F.lit("~")), F.coalesce(first["start_line"], F.lit(10**9)), "id")
    return rows.select(F.col("id").alias("group_id"), "label", "role", F.row_number().over(order).alias("rank")).where(F.col("rank") <= limit)


def paper_view(graph: EvidenceGraph, **policy) -> tuple[DataFrame, DataFrame]:
    """(components, edges (src, dst, edge_ids)): the quotient over direct members of the chosen components.

    A member of several components belongs to the first; contains edges and pairs
    within a component are left out; edges list their evidence edges in order.
    """
    chosen = components(graph, **policy)
    members = graph.membership().join(chosen.select("group_id", "rank"), "group_id").groupBy("member_id").agg(F.min_by("group_id", "rank").alias("group_id"))
    edges = graph.edges.where("kind <> 'contains'").select(F.col("id").alias("edge_id"), "source", "target")
    inner = edges.join(members.select(F.col("member_id").alias("source"), F.col("group_id").alias("src")), "source").join(members.select(F.col("member_id").alias("target"), F.col("group_id").alias("dst")), "target")
    rolled = inner.where("src <> dst").groupBy("src", "dst").agg(F.sort_array(F.collect_set("edge_id")).alias("edge_ids"))
    return chosen, rolled
