"""Metrics of static, runtime, system and hybrid analyses, their results and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import EvidenceGraph

#: Fixed roles of definitions and of probed occurrences.
MODULE_ROLE, OPERATOR_ROLE = "pytorch_module_definition", "pytorch_operator_definition"
PROBE_ROLES = ("adapter", "transport", "environment")


def _one(*rows: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(r)
    return out


def _n(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def inside_root(path: Column, root: str) -> Column:
    """Whether a path, taken from ``root`` if relative, stays under it once dots are resolved."""
    base = root.rstrip("/")
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(base + "/"), path))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    # a path has few parts: the fold copies no more than their square
    resolved = F.aggregate(parts, start, lambda acc, p: F.when(p == "..", up(acc)).otherwise(F.array_append(acc, p)))
    text = F.concat(F.lit("/"), F.array_join(resolved, "/"))
    return (text == (base or "/")) | F.startswith(text, F.lit(base + "/"))


def _owned(root: str | None) -> Column:
    """Definitions with a source place (under ``root``, if one is given)."""
    placed = F.size("source") > 0
    if root is not None:
        placed = F.exists("source", lambda s: inside_root(s["path"], root))
    return (F.col("identity_kind") == "definition") & placed


def static_metrics(files: DataFrame, symbols: DataFrame, calls: DataFrame, entries: DataFrame, references: DataFrame, entrypoints: DataFrame, submodules: DataFrame, graph: EvidenceGraph, unclassified: DataFrame) -> DataFrame:
    """One row of the 25 static measures, one pass a table.

    files (path, parse_error), symbols, calls (resolution), entries, references (status),
    entrypoints, submodules (path, materialized), unclassified (id).
    """
    resolution, status = F.col("resolution"), F.col("status")
    rows = _one(
        files.agg(F.count("*").alias("python_files"), _n(F.col("parse_error").isNotNull(), "parse_errors")),
        symbols.agg(F.count("*").alias("symbols")),
        calls.agg(F.count("*").alias("calls"), *[_n(resolution == r, f"{r}_calls") for r in ("local", "external", "dynamic", "unresolved")]),
        entries.agg(F.count("*").alias("config_entries")),
        references.agg(F.count("*").alias("config_references"), _n(status == "dynamic", "dynamic_config_references"), _n(status == "unresolved", "unresolved_config_references")),
        entrypoints.agg(F.count("*").alias("entrypoints")),
        graph.nodes.agg(F.count("*").alias("graph_nodes"), _n(F.size("source") > 0, "source_span_nodes"), _n(F.col("level") == "semantic", "semantic_components"), _n(~F.col("level").isin("semantic", "paper"), "_mechanical")),
        graph.edges.agg(F.count("*").alias("graph_edges"), _n(F.col("kind") == "data", "dataflow_edges")),
        unclassified.agg(F.count("*").alias("semantic_unclassified_nodes")),
        submodules.agg(F.count("*").alias("declared_submodules"), _n(~F.col("materialized"), "unmaterialized_submodules")),
    )
    share = lambda a, b: tx.ratio(a, F.col(b))
    return rows.select(
        "*", share(F.col("python_files") - F.col("parse_errors"), "python_files").alias("parse_success_rate"), share(F.col("local_calls") + F.col("external_calls"), "calls").alias("call_resolution_rate"),
        share(F.col("source_span_nodes"), "graph_nodes").alias("source_span_coverage"), share(F.col("_mechanical") - F.col("semantic_unclassified_nodes"), "_mechanical").alias("semantic_coverage"),
    ).drop("_mechanical")


def _sizes(graph: EvidenceGraph) -> list[Column]:
    kind = F.col("identity_kind")
    return [F.count("*").alias("runtime_nodes"), _n(kind == "definition", "definitions"), _n(kind == "occurrence", "occurrences"), _n(kind == "value", "values")]


def _edge_sizes(*kinds: str) -> list[Column]:
    return [F.count("*").alias("runtime_edges"), *[_n(F.col("kind") == k, f"{k}_edges") for k in kinds]]


def runtime_metrics(graph: EvidenceGraph, root: str, trace_seconds: float, parameter_count: int, output_tensor_count: int) -> DataFrame:
    """One row of the measures of a traced module run."""
    owned, definition, tensor = _owned(root), F.col("identity_kind") == "definition", F.col("tensor").isNotNull()
    nodes = graph.nodes.agg(
        *_sizes(graph), _n(definition & (F.col("role") == MODULE_ROLE), "module_definitions"), _n(definition & (F.col("role") == OPERATOR_ROLE), "operator_definitions"),
        _n(F.col("identity_kind") == "state", "states"), _n(owned & (F.col("role") == MODULE_ROLE), "target_source_definitions"), _n(owned & (F.col("role") == OPERATOR_ROLE), "target_operator_source_definitions"),
        _n(tensor, "tensor_nodes"), _n(tensor & (F.col("tensor.shape").isNotNull() | F.col("tensor.dtype").isNotNull()), "tensor_spec_nodes"),
    )
    rows = _one(nodes, graph.edges.agg(*_edge_sizes("consumes", "produces", "derived_from")))
    return rows.select("*", tx.ratio(F.col("tensor_spec_nodes"), F.col("tensor_nodes")).alias("tensor_spec_coverage"), F.lit(float(trace_seconds)).alias("trace_seconds"), F.lit(parameter_count).cast("long").alias("parameter_count"), F.lit(output_tensor_count).cast("long").alias("output_tensor_count"))


def system_metrics(graph: EvidenceGraph, trace_seconds: float = 0.0) -> DataFrame:
    """One row of the measures of a probed system run."""
    kind, placed, tensor = F.col("identity_kind"), F.size("source") > 0, F.col("tensor").isNotNull()
    role = F.get_json_object("attributes_json", "$.probe_role")
    nodes = graph.nodes.agg(
        *_sizes(graph), _n((kind == "definition") & placed, "source_definitions"), _n((kind == "definition") & ~placed, "external_definitions"), _n((kind == "value") & tensor, "tensor_values"),
        _n((kind == "value") & tensor & F.col("tensor.shape").isNotNull(), "_shaped"), *[_n((kind == "occurrence") & (role == r), f"{r}_occurrences") for r in PROBE_ROLES],
    )
    rows = _one(nodes, graph.edges.agg(*_edge_sizes("consumes", "produces", "calls", "next")))
    return rows.select("*", tx.ratio(F.col("_shaped"), F.col("tensor_values")).alias("tensor_spec_coverage"), F.lit(float(trace_seconds)).alias("trace_seconds")).drop("_shaped")


def hybrid_metrics(static: EvidenceGraph, runtime: EvidenceGraph, merged: EvidenceGraph, root: str | None = None, reconciliation_seconds: float = 0.0) -> DataFrame:
    """One row of the measures of a reconciliation; with a ``root`` its target is the modules under it, else (a system) all placed definitions.

    A definition is aligned if an alignment edge of ``merged`` starts at it.
    """
    aligned = merged.edges.where("kind = 'alias'").where(F.startswith("id", F.lit("edge.alignment"))).select(F.col("source").alias("id")).distinct().withColumn("aligned", F.lit(True))
    wanted = _owned(root) & (F.col("role") == MODULE_ROLE) if root is not None else _owned(None)
    operators = _owned(root) & (F.col("role") == OPERATOR_ROLE) if root is not None else F.lit(False)
    status = F.col("status")
    total = lambda df, name: df.agg(F.count("*").alias(name))
    rows = _one(
        total(static.nodes, "static_nodes"), total(static.edges, "static_edges"), total(runtime.edges, "runtime_edges"), total(merged.nodes, "merged_nodes"), total(aligned, "source_alignments"),
        runtime.nodes.join(aligned, "id", "left").agg(F.count("*").alias("runtime_nodes"), _n(wanted, "target_runtime_definitions"), _n(wanted & F.col("aligned").isNotNull(), "aligned_target_runtime_definitions"), _n(operators, "target_operator_definitions")),
        merged.edges.agg(F.count("*").alias("merged_edges"), _n(F.col("kind") == "alias", "alias_edges")),
        merged.coverage.agg(F.count("*").alias("coverage_records"), *[_n(status == s, s) for s in ("always_observed", "sometimes_observed", "static_reachable_unobserved")]),
    )
    return rows.select("*", tx.ratio(F.col("aligned_target_runtime_definitions"), F.col("target_runtime_definitions")).alias("target_alignment_rate"), F.lit(float(reconciliation_seconds)).alias("reconciliation_seconds"))


def result(metrics: DataFrame, case: str, mode: str, kind: str, status: str = "completed") -> DataFrame:
    """(case_id, mode, status, metric_kind, metrics_json) of one analysis."""
    return metrics.select(F.lit(case).alias("case_id"), F.lit(mode).alias("mode"), F.lit(status).alias("status"), F.lit(kind).alias("metric_kind"), F.to_json(F.struct("*")).alias("metrics_json"))


def write_results(results: DataFrame, failures: DataFrame, path: str) -> None:
    """One JSON record a result, with its failures (case_id, mode, category, severity, message, n)."""
    listed = failures.groupBy("case_id", "mode").agg(F.sort_array(F.collect_list(F.struct("category", "severity", "message", "n"))).alias("failures"))
    out = results.join(listed, ["case_id", "mode"], "left").withColumn("metrics", F.try_parse_json("metrics_json")).drop("metrics_json")
    out.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def _m(name: str) -> Column:
    return F.get_json_object("metrics_json", f"$.{name}")


def _percent(name: str) -> Column:
    return F.format_string("%.1f%%", 100 * _m(name).cast("double"))


def _seconds(name: str) -> Column:
    return F.format_string("%.2fs", _m(name).cast("double"))


#: Sections of the report: metric kind, title, and the columns behind case and status.
SECTIONS = (
    ("static", "Static", (("Parse", _percent, "parse_success_rate"), ("Call resolution", _percent, "call_resolution_rate"), ("Semantic coverage", _percent, "semantic_coverage"), ("Nodes", _m, "graph_nodes"), ("Edges", _m, "graph_edges"))),
    ("runtime", "Runtime", (("Trace", _seconds, "trace_seconds"), ("Target module defs", _m, "target_source_definitions"), ("Nodes", _m, "runtime_nodes"), ("Op defs", _m, "operator_definitions"), ("Tensor spec", _percent, "tensor_spec_coverage"))),
    ("system_runtime", "System Runtime", (("Trace", _seconds, "trace_seconds"), ("Source defs", _m, "source_definitions"), ("External defs", _m, "external_definitions"), ("Occurrences", _m, "occurrences"), ("Values", _m, "values"))),
    ("hybrid", "Hybrid", (("Reconcile", _seconds, "reconciliation_seconds"), ("Target module alignment", _percent, "target_alignment_rate"), ("Alignments", _m, "source_alignments"), ("Merged nodes", _m, "merged_nodes"))),
)


def report_lines(results: DataFrame, failures: DataFrame) -> DataFrame:
    """(section, place, line) of the report: a table for each kind of metrics and the failures of every result.

    ``results`` is (case_id, mode, status, metric_kind, metrics_json), ``failures`` (case_id, mode, category, severity, message, n).
    """
    spark = results.sparkSession
    heads, rows = [(0, "", "# Benchmark Report"), (0, "0", "")], None
    for i, (kind, title, columns) in enumerate(SECTIONS, 1):
        found = results.where(F.col("metric_kind") == kind)
        cells = F.concat(F.lit("| "), F.concat_ws(" | ", "case_id", "status", *[F.coalesce(f(name), F.lit("")) for _, f, name in columns]), F.lit(" |"))
        part = found.select(F.lit(i).alias("section"), F.concat(F.lit("2"), "case_id", F.lit(" "), "mode").alias("place"), cells.alias("line"))
        there = found.limit(1).select(F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.lit(t).alias("line")) for p, t in (
            ("10", f"## {title}"), ("11", ""), ("12", "| Case | Status | " + " | ".join(c for c, _, _ in columns) + " |"), ("13", "| --- | --- |" + " ---: |" * len(columns)),
        )])).alias("h"))
        part = part.unionByName(there.select(F.lit(i).alias("section"), "h.place", "h.line")).unionByName(found.limit(1).select(F.lit(i).alias("section"), F.lit("3").alias("place"), F.lit("").alias("line")))
        rows = part if rows is None else rows.unionByName(part)
    heads += [(9, "0", "## Failure taxonomy"), (9, "1", "")]
    names = F.concat(F.lit("- **"), "case_id", F.lit(" ("), "mode", F.lit(")**"))
    failed = failures.select("case_id", "mode").distinct().withColumn("failed", F.lit(True))
    each = results.join(failed, ["case_id", "mode"], "left").select(F.lit(9).alias("section"), F.concat(F.lit("2"), "case_id", F.lit(" "), "mode").alias("place"), F.when(F.col("failed"), names).otherwise(F.concat(names, F.lit(": no recorded warnings/errors."))).alias("line"))
    detail = F.concat(F.lit("  - `"), "category", F.lit("` ("), "severity", F.lit(", n="), F.col("n").cast("string"), F.lit("): "), "message")
    more = failures.select(F.lit(9).alias("section"), F.concat(F.lit("2"), "case_id", F.lit(" "), "mode", F.lit("\t"), "category").alias("place"), detail.alias("line"))
    return spark.createDataFrame(heads, "section int, place string, line string").unionByName(rows).unionByName(each).unionByName(more)


def markdown_report(results: DataFrame, failures: DataFrame) -> str:
    """The report as text; results are one row an analysis, so the driver can hold their lines."""
    return "\n".join(r["line"] for r in report_lines(results, failures).orderBy("section", "place", "line").collect()) + "\n"
