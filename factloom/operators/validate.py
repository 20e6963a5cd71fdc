"""Integrity rules as violation queries: (rule, record_id, detail); no rows mean valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DOMAINS, EvidenceGraph


def _rows(df: DataFrame, rule: str, bad: Column | str, detail: Column | None = None) -> DataFrame:
    return df.where(bad).select(F.lit(rule).alias("rule"), F.col("id").alias("record_id"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def dangling(rule: str, refs: DataFrame, known: DataFrame) -> DataFrame:
    """References (id, ref) without a target (id) in ``known``."""
    return refs.where("ref is not null").join(known.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti").select(F.lit(rule).alias("rule"), F.col("id").alias("record_id"), F.col("ref").alias("detail"))


def duplicate_ids(ids: DataFrame) -> DataFrame:
    """Ids that occur more than once over all collections (collection, id)."""
    return ids.groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("collection")), ",").alias("where")).where("n > 1").select(
        F.lit("duplicate_id").alias("rule"), F.col("id").alias("record_id"), F.concat_ws(":", "where", F.col("n").cast("string")).alias("detail")
    )


def coverage_rules(coverage: DataFrame) -> DataFrame:
    """Observed within considered; status agrees with the two sets."""
    seen, asked = F.array_distinct("observed_run_ids"), F.array_distinct("considered_run_ids")
    both = F.size(F.array_intersect(seen, asked))
    stray, all_seen = both < F.size(seen), both == F.size(asked)
    status = F.col("status")
    parts = [
        _rows(coverage, "coverage_observed_not_considered", stray),
        _rows(coverage, "coverage_always", (status == "always_observed") & ((F.size(asked) == 0) | ~all_seen | stray)),
        _rows(coverage, "coverage_sometimes", (status == "sometimes_observed") & ((F.size(seen) == 0) | all_seen)),
        _rows(coverage, "coverage_unobserved", status.isin("static_reachable_unobserved", "unreachable_under_configuration") & (F.size(seen) > 0)),
    ]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _checked(df: DataFrame, rules: list[tuple], *extra: Column) -> DataFrame:
    """Violations of rules (name, condition, detail or null) on one table, in one pass; ``extra`` are arrays of further ones."""
    row = lambda rule, detail: F.struct(F.lit(rule).alias("rule"), (F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(None))).alias("detail"))
    found = F.array_compact(F.array(*[F.when(bad, row(rule, detail)) for rule, bad, detail in rules]))
    return df.select("id", F.explode(F.concat(found, *extra) if extra else found).alias("v")).select("v.rule", F.col("id").alias("record_id"), "v.detail")


def _domain(column: str, domain: str) -> tuple:
    return f"domain_{domain}", F.col(column).isNull() | ~F.col(column).isin(*DOMAINS[domain]), F.col(column)


def _bad_spans(spans: Column) -> Column:
    """One violation for each span whose numbers are out of order."""
    bad = lambda s: F.coalesce((s["start_line"] < 1) | (s["end_line"] < s["start_line"]) | (s["start_column"] < 0) | (s["end_column"] < 0), F.lit(False))
    made = F.transform(F.filter(spans, bad), lambda s: F.struct(F.lit("span_order").alias("rule"), F.lit("").alias("detail")))
    return F.coalesce(made, F.array().cast("array<struct<rule:string,detail:string>>"))


def record_rules(graph: EvidenceGraph) -> DataFrame:
    """Rules that look at one record: spans, occurrences, claims, conflicts, confidences, domains; one pass a table."""
    occurrence, range_ = F.col("identity_kind") == "occurrence", (F.col("confidence") < 0) | (F.col("confidence") > 1)
    distinct = F.size(F.array_distinct("claim_ids"))
    nodes = [
        ("occurrence_without_run", occurrence & F.col("run_id").isNull(), None),
        ("index_without_occurrence", ~occurrence & F.col("occurrence_index").isNotNull(), None),
        ("definition_without_occurrence", ~occurrence & F.col("definition_id").isNotNull(), None),
        _domain("level", "level"), _domain("kind", "node_kind"), _domain("identity_kind", "identity_kind"),
    ]
    conflicts = [
        ("conflict_claims", (distinct < 2) | (distinct < F.size("claim_ids")), None),
        ("conflict_resolution", (F.col("status") == "resolved") & (F.coalesce(F.trim("resolution"), F.lit("")) == ""), None),
        _domain("kind", "conflict_kind"), _domain("status", "conflict_status"),
    ]
    claims = [("claim_object_xor_value", F.col("object_id").isNull() == (F.col("value_json").isNull() | (F.col("value_json") == "null")), None), ("confidence_range", range_, None)]
    return _union([
        _checked(graph.nodes, nodes, _bad_spans(F.col("source"))),
        _checked(graph.edges, [_domain("kind", "edge_kind")]),
        _checked(graph.evidence, [("confidence_range", range_, None), _domain("kind", "evidence_kind"), _domain("status", "fact_status")], _bad_spans(F.array_compact(F.array("source")))),
        _checked(graph.claims, claims),
        _checked(graph.conflicts, conflicts),
        _checked(graph.coverage, [_domain("status", "coverage_status")]),
        coverage_rules(graph.coverage),
    ])


def references(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(rule, record_id, target, ref) of rules (name, target, column) on one table, in one pass; a column is an id or a list of ids."""
    kinds = dict(df.select(*[F.col(c).alias(str(i)) for i, (_, _, c) in enumerate(rules)]).dtypes)

    def each(i: int, rule: str, target: str, column: str) -> Column:
        ids = F.col(column) if kinds[str(i)].startswith("array") else F.array(column)
        some = F.array_compact(F.coalesce(ids, F.array().cast("array<string>")))
        return F.transform(some, lambda x: F.struct(F.lit(rule).alias("rule"), F.lit(target).alias("target"), x.alias("ref")))

    made = [each(i, *r) for i, r in enumerate(rules)]
    return df.select("id", F.explode(F.concat(*made)).alias("r")).select("r.rule", F.col("id").alias("record_id"), "r.target", "r.ref")


def reference_rules(graph: EvidenceGraph) -> DataFrame:
    """Rules that look for the records others point to: all references meet all ids in one join by (target, id)."""
    refs = _union([
        references(graph.nodes, [("node_parent", "node", "parent_ids"), ("node_evidence", "evidence", "evidence_ids"), ("node_run", "run", "run_id"), ("node_definition", "node", "definition_id")]),
        references(graph.edges, [("edge_source", "node", "source"), ("edge_target", "node", "target"), ("edge_evidence", "evidence", "evidence_ids")]),
        references(graph.evidence, [("evidence_run", "run", "run_id")]),
        references(graph.claims, [("claim_subject", "subject", "subject_id"), ("claim_object", "subject", "object_id"), ("claim_evidence", "evidence", "evidence_ids"), ("claim_run", "run", "scope.run_ids")]),
        references(graph.conflicts, [("conflict_claim", "claim", "claim_ids")]),
        references(graph.coverage, [("coverage_subject", "subject", "subject_id"), ("coverage_run", "run", "considered_run_ids"), ("coverage_run", "run", "observed_run_ids"), ("coverage_evidence", "evidence", "evidence_ids")]),
    ])
    none = F.lit(None).cast("string")
    ids = lambda df, kind, *targets: df.select(F.explode(F.array(*map(F.lit, targets))).alias("target"), F.col("id").alias("ref"), kind.alias("kind"))
    known = _union([
        ids(graph.nodes, F.coalesce("identity_kind", F.lit("")), "node", "subject"), ids(graph.edges, none, "subject"), ids(graph.runs, none, "run", "subject"),
        ids(graph.evidence, none, "evidence"), ids(graph.claims, none, "claim"),
    ]).groupBy("target", "ref").agg(F.count("*").alias("there"), F.collect_set("kind").alias("kinds"))
    met = refs.join(known, ["target", "ref"], "left")
    missing = met.where("there is null").select("rule", "record_id", F.col("ref").alias("detail"))
    # a definition has to be one; an id used twice counts as each of its kinds
    other = F.size(F.array_remove("kinds", "definition")) > 0
    wrong = met.where((F.col("rule") == "node_definition") & other).select(F.lit("definition_kind").alias("rule"), "record_id", F.col("ref").alias("detail"))
    return missing.unionByName(wrong)


def violations(graph: EvidenceGraph) -> DataFrame:
    """All violations of a graph."""
    return _union([record_rules(graph), reference_rules(graph), duplicate_ids(graph.ids())])


def require_valid(graph: EvidenceGraph, show: int = 5) -> None:
    """Raise ValueError with the first violations, if there are any."""
    bad = violations(graph).limit(show).collect()
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['record_id']} {r['detail']}".strip() for r in bad))
