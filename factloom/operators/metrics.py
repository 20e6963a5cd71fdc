"""One-pass quality metrics, roll-ups and the text report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..schema import DOMAINS, EvidenceGraph


def histogram(rows: DataFrame, column: str, domain: tuple[str, ...] = ()) -> DataFrame:
    """(value, n) of a column; values of ``domain`` that don't occur have 0."""
    found = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    if not domain:
        return found
    dim = rows.sparkSession.createDataFrame([(v,) for v in domain], "value string")
    return dim.join(found, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def coverage_counts(coverage: DataFrame) -> DataFrame:
    return histogram(coverage, "status", DOMAINS["coverage_status"])


def top_values(rows: DataFrame, column: str, ordinal: str, limit: int = 10) -> DataFrame:
    """(label, n, first_seen): the most frequent values as ``name ×n``, ties by first appearance."""
    counted = rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"), F.min(ordinal).alias("first_seen"))
    return counted.orderBy(F.desc("n"), "first_seen").limit(limit).select(F.concat("name", F.lit(" ×"), F.col("n").cast("string")).alias("label"), "n", "first_seen")


def rollup_examples(rows: DataFrame, category: str, example: str, ordinal: str, keep: int = 10) -> DataFrame:
    """(category, n, examples): counts and the first examples of each category.

    Only ``keep`` rows of a category reach the ordered list; the count is a partial aggregate.
    """
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(category).orderBy(ordinal))).where(F.col("_r") <= keep)
    listed = ranked.groupBy(category).agg(F.sort_array(F.collect_list(F.struct("_r", F.col(example).cast("string").alias("e")))).alias("l"))
    counts = rows.groupBy(category).agg(F.count("*").alias("n"))
    return counts.join(listed, category).select(F.col(category).alias("category"), "n", F.array_join(F.transform("l", lambda x: x["e"]), "|").alias("examples"))


def graph_metrics(graph: EvidenceGraph) -> DataFrame:
    """One row of counts and ratios over nodes and edges (one pass each)."""
    nodes = graph.nodes.agg(
        F.count("*").alias("n_nodes"),
        F.count_if(F.col("level") == "semantic").alias("n_groups"),
        F.count_if(F.col("identity_kind") == "definition").alias("n_definitions"),
        F.count_if(F.col("identity_kind") == "occurrence").alias("n_occurrences"),
        F.count_if(F.col("identity_kind") == "value").alias("n_values"),
        F.count_if(F.col("identity_kind") == "state").alias("n_states"),
        F.count_if((F.col("identity_kind") == "value") & F.col("tensor").isNotNull()).alias("n_tensors"),
    )
    edges = graph.edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("kind").isin("data", "produces", "consumes")).alias("n_flow"), F.count_if(F.col("kind") == "contains").alias("n_contains"))
    both = nodes.crossJoin(edges)  # one row each
    return both.select("*", F.round(tx.ratio(F.col("n_tensors"), F.col("n_values")), 6).alias("tensor_coverage"), F.round(tx.ratio(F.col("n_occurrences"), F.col("n_definitions")), 6).alias("calls_per_definition"))


def project_stats(graph: EvidenceGraph) -> DataFrame:
    """(what, n): nodes, edges other than containment, runs and groups of a project."""
    size = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    nodes = graph.nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("level") == "semantic").alias("groups"))
    both = nodes.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in ("nodes", "groups")])).alias("s")).select("s.what", "s.n")
    return both.unionByName(size("edges", graph.edges.where("kind <> 'contains'"))).unionByName(size("runs", graph.runs))


def entrypoint_scores(reasons: DataFrame) -> DataFrame:
    """(path, score, reasons) of rows (path, points, reason), best first."""
    return reasons.groupBy("path").agg(F.sum("points").alias("score"), F.array_join(F.sort_array(F.collect_list("reason")), "; ").alias("reasons")).orderBy(F.desc("score"), "path")


def clip_budget(docs: DataFrame, order: list, limit: int, each: int, budget: int) -> DataFrame:
    """The first ``limit`` rows by ``order``, their ``text`` clipped to ``each`` characters and to what is left of ``budget``."""
    ranked = docs.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= limit)
    size = F.least(F.length("text"), F.lit(each))
    before = F.coalesce(F.sum(size).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.least(size, F.greatest(F.lit(0), F.lit(budget) - before))
    return ranked.withColumn("_left", left).where("_left > 0").withColumn("text", F.substring("text", F.lit(1), F.col("_left").cast("int"))).drop("_left")


def markdown(rows: DataFrame, title: str, columns: list[str]) -> str:
    """A small ordered table as Markdown, whole (report rendering: the caller has cut it to what a page holds)."""
    lines = [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows.select(*columns).collect()]
    return "\n".join(lines)
