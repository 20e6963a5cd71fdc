"""Author declarations, implementation facts and their conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import FROZEN, NEGATED_AFTER, NEGATED_BEFORE, ROLE_PATTERNS, TRAINABLE


def lines_of(docs: DataFrame) -> DataFrame:
    """(path, line, text): one row a line of rows (path, text)."""
    return docs.select("path", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def frozen_value(text: Column) -> Column:
    """True for frozen words, false for trainable ones, null for both or neither."""
    frozen, trainable = F.regexp_like(text, F.lit(f"(?iU){FROZEN}")), F.regexp_like(text, F.lit(f"(?iU){TRAINABLE}"))
    return F.when(frozen != trainable, frozen)


def presence(text: Column, pattern: str) -> Column:
    """Whether the first match stands without a negation in the 80 characters before or after."""
    start = F.regexp_instr(text, F.lit(pattern))
    hit = F.regexp_extract(text, pattern, 0)
    before = F.lower(F.substring(text, F.greatest(F.lit(1), start - 80), F.least(start - 1, F.lit(80))))
    after = F.lower(F.substring(text, start + F.length(hit), F.lit(80)))
    return ~F.regexp_like(before, F.lit(f"(?iU){NEGATED_BEFORE}")) & ~F.regexp_like(after, F.lit(f"(?iU){NEGATED_AFTER}"))


def declarations(lines: DataFrame, patterns: tuple[tuple[str, str], ...] = ROLE_PATTERNS) -> DataFrame:
    """(path, line, role, predicate, value): first match of each pattern in each line; a role's facts once a line.

    The patterns are unrolled into the projection: one pass over the lines, no join.
    """
    found = [
        F.when(F.regexp_like("text", F.lit(f"(?iU){p}")), F.struct(F.lit(role).alias("role"), presence(F.col("text"), f"(?iU){p}").alias("value"))) for role, p in patterns
    ]
    hits = lines.select("path", "line", frozen_value(F.col("text")).alias("frozen"), F.explode(F.array_compact(F.array(*found))).alias("h"))
    present = hits.select("path", "line", "h.role", F.lit("component_present").alias("predicate"), "h.value")
    frozen = hits.where("frozen is not null").select("path", "line", "h.role", F.lit("frozen").alias("predicate"), F.col("frozen").alias("value"))
    return present.unionByName(frozen).distinct()


def subjects(declared: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds ``subject_id``: the one component of the role (group_id, role), null where there are none or several."""
    only = groups.groupBy("role").agg(F.count("*").alias("n"), F.min("group_id").alias("subject_id")).where("n = 1").select("role", "subject_id")
    return declared.join(only, "role", "left")


def unanimous(votes: DataFrame) -> DataFrame:
    """(subject_id, value): boolean votes (subject_id, value) that all agree."""
    return votes.where("value is not null").groupBy("subject_id").agg(F.min("value").alias("value"), F.max("value").alias("top")).where("value = top").select("subject_id", "value")


def frozen_votes(graph_nodes: DataFrame, related: DataFrame) -> DataFrame:
    """(subject_id, value): what mechanical nodes (id) related to a subject say about frozen weights."""
    a = lambda name: F.get_json_object("attributes_json", f"$.{name}")
    flag = lambda c: F.when(c == "true", True).when(c == "false", False)
    tensor = F.when(F.col("kind") == "parameter", ~F.col("tensor.requires_grad"))
    votes = F.array_compact(F.array(flag(a("frozen")), ~flag(a("trainable")), ~flag(a("requires_grad")), tensor))
    return related.join(graph_nodes, "id").select("subject_id", F.explode(votes).alias("value"))


def compare(author: DataFrame, implementation: DataFrame) -> DataFrame:
    """Author claims (claim_id, subject_id, predicate, value) with status supported, contradicted or unresolved.

    At most one implementation claim (subject_id, predicate, value, impl_id) a key.
    """
    impl = implementation.groupBy("subject_id", "predicate").agg(F.min_by("value", "impl_id").alias("impl_value"), F.min("impl_id").alias("impl_id"))
    status = F.when(F.col("impl_id").isNull(), "unresolved").when(F.col("value").eqNullSafe(F.col("impl_value")), "supported").otherwise("contradicted")
    return author.join(impl, ["subject_id", "predicate"], "left").withColumn("status", status)


def conflicts(compared: DataFrame) -> DataFrame:
    """(author_claim, implementation_claim, subject_id, predicate, kind, status) of contradictions."""
    return compared.where("status = 'contradicted'").select(
        F.col("claim_id").alias("author_claim"), F.col("impl_id").alias("implementation_claim"), "subject_id", "predicate", F.lit("author_implementation_mismatch").alias("kind"), F.lit("open").alias("status")
    )
