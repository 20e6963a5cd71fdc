"""Component roles: rule hypotheses, label propagation, anchors, groups, overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.rules import MODALITIES, PRIMARY_MODALITIES, ROLES
from ..schema import PROPAGATION_KINDS, SCHEMAS, EvidenceGraph
from ..plans.stages import Stages
from . import traverse

#: Fixed confidences of the rules.
STRUCTURAL, KEYWORD, GENERIC, FUSION, MEETING = 0.99, 0.88, 0.58, 0.91, 0.82


def node_text(nodes: DataFrame) -> DataFrame:
    """(id, level, kind, text, tensor_text) of nodes, normalised for keyword rules.

    The text holds label, role, source paths, symbols and, by key, the attributes: keys and
    values of scalars, scalar items of lists.  Neither the id nor the kind belongs to it.
    """
    values = F.transform(tx.attribute_parts(F.col("attributes_json")), lambda a: F.when(a["kind"] == "scalar", F.concat_ws(" ", a["key"], a["text"])).when(a["kind"] == "list", F.array_join(a["items"], " ")))
    each = lambda name: F.array_join(F.transform("source", lambda s: s[name]), " ")
    text = F.concat_ws(" ", "label", "role", each("path"), each("symbol"), F.array_join(values, " "))
    return nodes.select("id", "level", "kind", tx.normal_text(text).alias("text"), tx.normal_text(F.array_join("tensor.semantics", " ")).alias("tensor_text"))


def _hits(text, keywords) -> list:
    return [F.when(tx.keyword_hit(text, F.lit(k)), k) for k in keywords]


def keyword_roles(texts: DataFrame) -> DataFrame:
    """(id, role, confidence, reason): each role with a keyword in the text.

    The rule table is unrolled into one expression a role, so the rules cost one
    narrow pass over the nodes and no join.
    """
    rows = []
    for role, _, _, _, priority, keywords in ROLES:
        found = F.array_compact(F.array(*_hits(F.col("text"), sorted(keywords))))
        score = FUSION if role == "multimodal_fusion" else GENERIC if role.startswith("generic_") else KEYWORD
        rows.append(F.when(F.size(found) > 0, F.struct(F.lit(role).alias("role"), F.lit(priority).alias("priority"), F.lit(score).alias("confidence"), F.concat(F.lit("name/source keyword: "), F.array_join(F.slice(found, 1, 3), ", ")).alias("reason"))))
    return texts.select("id", F.explode(F.array_compact(F.array(*rows))).alias("h")).select("id", "h.*")


def modality_seeds(texts: DataFrame) -> DataFrame:
    """(id, label): modalities named by the text or by the tensor's semantics."""
    rows = []
    for modality, keywords in MODALITIES:
        hit = [tx.keyword_hit(F.col(c), F.lit(k)) for k in keywords for c in ("text", "tensor_text")]
        any_ = hit[0]
        for h in hit[1:]:
            any_ = any_ | F.coalesce(h, F.lit(False))
        rows.append(F.when(any_, modality))
    return texts.select("id", F.explode(F.array_compact(F.array(*rows))).alias("label"))


def node_modalities(graph: EvidenceGraph) -> DataFrame:
    """(id, modalities): what reaches each mechanical node along the flow, own names included; nodes without any give no row."""
    stages = Stages(graph.nodes.sparkSession, "modalities")
    mechanical = graph.mechanical()
    ends = mechanical.select("id")
    flow = graph.flow(PROPAGATION_KINDS).join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    labels = traverse.label_fixpoint(flow.select("src", "dst"), stages.write(modality_seeds(node_text(mechanical))))
    return labels.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("modalities"))


def hypotheses(graph: EvidenceGraph) -> DataFrame:
    """(id, role, priority, confidence, reasons, rank): all hypotheses of each mechanical node, best first."""
    stages = Stages(graph.nodes.sparkSession, "hypotheses")
    texts = stages.write(node_text(graph.mechanical()))
    structural = texts.where(F.col("kind").isin("loss", "dataset", "environment")).select(
        "id", F.col("kind").alias("role"), F.lit(STRUCTURAL).alias("confidence"), F.concat(F.lit("node kind: "), "kind").alias("reason")
    )
    priorities = {r: p for r, _, _, _, p, _ in ROLES}
    ends = graph.mechanical().select("id")
    flow = graph.flow(PROPAGATION_KINDS).join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    labels = traverse.label_fixpoint(flow.select("src", "dst"), modality_seeds(texts))
    arriving = flow.join(labels.withColumnRenamed("id", "src"), "src").where(F.col("label").isin(*PRIMARY_MODALITIES)).select(F.col("dst").alias("id"), "label").distinct()
    meeting = arriving.groupBy("id").agg(F.sort_array(F.collect_set("label")).alias("l")).where(F.size("l") >= 2).select(
        "id", F.lit("multimodal_fusion").alias("role"), F.lit(MEETING).alias("confidence"), F.concat(F.lit("multiple upstream modalities: "), F.array_join("l", ", ")).alias("reason")
    )
    every = keyword_roles(texts).select("id", "role", "confidence", "reason").unionByName(structural).unionByName(meeting)
    best = every.groupBy("id", "role").agg(F.max("confidence").alias("confidence"), F.collect_list(F.struct("confidence", "reason")).alias("all"))
    reasons = F.array_sort(F.transform(F.filter("all", lambda x: x["confidence"] == F.col("confidence")), lambda x: x["reason"]))
    priority = F.coalesce(*[F.when(F.col("role") == r, p) for r, p in priorities.items()], F.lit(999))
    out = best.select("id", "role", priority.alias("priority"), "confidence", reasons.alias("reasons"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("confidence"), "priority", "role")))


def anchor_winners(top: DataFrame, anchors: DataFrame, min_confidence: float = 0.55) -> DataFrame:
    """(anchor, id, role, confidence): the best top hypothesis (id, role, priority, confidence) at each anchor, if it is good enough."""
    order = Window.partitionBy("anchor").orderBy(F.desc("confidence"), "priority", "id")
    best = top.join(anchors, "id").withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return best.where(F.col("confidence") >= min_confidence).select("anchor", "id", "role", "confidence")


def anchor_members(containment: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, member): everything contained in each anchor (id), itself included."""
    return traverse.closure(containment, anchors).select(F.col("origin").alias("anchor"), F.col("id").alias("member"))


def apply_overrides(members: DataFrame, overrides: DataFrame) -> DataFrame:
    """(group_id, member_id): machine members but those that an override (group_id, member_id) names, and the overrides."""
    kept = members.join(overrides.select("member_id").distinct(), "member_id", "left_anti").select("group_id", "member_id")
    return kept.unionByName(overrides.select("group_id", "member_id"))


def recover(graph: EvidenceGraph, overrides: list[dict] | None = None, min_confidence: float = 0.55) -> tuple[EvidenceGraph, DataFrame]:
    """The graph with semantic groups, and the unclassified nodes (id, status, candidates).

    Overrides are dictionaries with ``role``, ``member_ids`` and optionally ``label``;
    their members leave machine groups.  No data edge is ever added.
    """
    spark = graph.nodes.sparkSession
    mechanical = graph.mechanical()
    known = {r["id"] for r in mechanical.where(F.col("id").isin([m for o in overrides or [] for m in o["member_ids"]])).select("id").collect()} if overrides else set()
    for o in overrides or []:
        if not o["member_ids"] or set(o["member_ids"]) - known:
            raise ValueError("an override needs known members")
    stages = Stages(spark, "recover")
    found = stages.write(hypotheses(graph))  # read three times below
    taken = spark.createDataFrame([(m,) for o in overrides or [] for m in o["member_ids"]], "id string")
    top = found.where("rank = 1").join(taken, "id", "left_anti")
    anchors = traverse.nearest_of_level(graph.hierarchy(), mechanical)
    winners = stages.write(anchor_winners(top, anchors, min_confidence))
    numbered = winners.withColumn("n", F.row_number().over(Window.orderBy("anchor")) - 1).withColumn("group_id", tx.sequence_id("semantic.group", F.col("n")))
    contains = graph.edges.where("kind = 'contains'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    members = anchor_members(contains, winners.select(F.col("anchor").alias("id"))).join(mechanical.select(F.col("id").alias("member")), "member", "left_semi")
    members = members.join(taken.withColumnRenamed("id", "member"), "member", "left_anti").join(numbered.select("anchor", "group_id", "role", "confidence"), "anchor")
    # alternatives: the best hypothesis of each other role over the members
    scored = members.join(found.select(F.col("id").alias("member"), F.col("role").alias("other"), F.col("confidence").alias("c"), "priority"), "member").where("other <> role")
    other = scored.groupBy("group_id", "other").agg(F.max("c").alias("c"), F.min("priority").alias("priority"))
    ranked = other.withColumn("_r", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("c"), "priority", "other"))).where("_r <= 5")
    alternatives = ranked.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("_r", "other"))).alias("l")).select("group_id", F.transform("l", lambda x: x["other"]).alias("alternatives"))
    phase = F.coalesce(*[F.when(F.col("role") == r, F.lit(p)) for r, _, p, _, _, _ in ROLES], F.lit("both"))
    label = F.coalesce(*[F.when(F.col("role") == r, F.lit(l)) for r, l, _, _, _, _ in ROLES], F.lit("Unknown"))
    listed = members.groupBy("group_id", "role", "confidence").agg(F.sort_array(F.collect_set("member")).alias("member_ids")).join(alternatives, "group_id", "left")
    made = listed.select("group_id", "role", "confidence", "member_ids", F.coalesce("alternatives", F.array().cast("array<string>")).alias("alternatives"))
    if overrides:
        n = made.count()
        human = spark.createDataFrame([(f"semantic.group.{n + i:07d}", o["role"], 1.0, sorted(o["member_ids"]), []) for i, o in enumerate(overrides)], "group_id string, role string, confidence double, member_ids array<string>, alternatives array<string>")
        made = made.unionByName(human)
    spans = graph.nodes.select(F.col("id").alias("m"), "source", "evidence_ids")
    support = made.select("group_id", F.explode("member_ids").alias("m")).join(spans, "m").groupBy("group_id").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("support"), F.min_by("source", F.struct(-F.size("source"), F.col("m"))).alias("source")
    )
    nodes = made.join(support, "group_id", "left").select(
        F.col("group_id").alias("id"), F.lit("semantic").alias("level"), F.lit("semantic_component").alias("kind"), F.lit("group").alias("identity_kind"), label.alias("label"), "role",
        F.array().cast("array<string>").alias("parent_ids"), "source", F.coalesce("support", F.array().cast("array<string>")).alias("evidence_ids"),
        F.to_json(F.struct("confidence", "member_ids", phase.alias("phase"), "alternatives")).alias("attributes_json"),
    )
    edges = made.select("group_id", F.posexplode("member_ids").alias("i", "m")).select(
        F.concat("group_id", F.lit(".contains."), F.lpad(F.col("i").cast("string"), 5, "0")).alias("id"), F.col("group_id").alias("source"), F.col("m").alias("target"), F.lit("contains").alias("kind"), F.array().cast("array<string>").alias("evidence_ids")
    )
    blank = lambda name: spark.createDataFrame([], SCHEMAS[name])
    out = graph.with_tables(nodes=graph.nodes.unionByName(blank("nodes").unionByName(nodes, allowMissingColumns=True)), edges=graph.edges.unionByName(blank("edges").unionByName(edges, allowMissingColumns=True)))
    return out, unclassified(mechanical, made.select(F.explode("member_ids").alias("id")), found)


def unclassified(nodes: DataFrame, grouped: DataFrame, found: DataFrame) -> DataFrame:
    """(id, status, candidates): nodes outside all groups with their best three roles."""
    left = nodes.select("id").join(grouped.select("id").distinct(), "id", "left_anti")
    best = found.where("rank <= 3").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "role"))).alias("l"))
    out = left.join(best, "id", "left")
    return out.select("id", F.when(F.col("l").isNull(), "unknown").otherwise("low_confidence").alias("status"), F.coalesce(F.array_join(F.transform("l", lambda x: x["role"]), ","), F.lit("")).alias("candidates"))
