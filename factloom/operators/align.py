"""Static-runtime reconciliation: merge, source alignment, coverage, as-of producers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..schema import SCHEMAS, EvidenceGraph

THRESHOLD = 8


def collisions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids of both tables (id, payload) with different payloads: (id)."""
    return left.select("id", F.col("payload").alias("l")).join(right.select("id", F.col("payload").alias("r")), "id").where(~F.col("l").eqNullSafe(F.col("r"))).select("id")


def payload(df: DataFrame) -> DataFrame:
    """(id, payload): canonical JSON of all columns."""
    return df.select("id", F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("payload"))


def merge_projects(left: DataFrame, right: DataFrame) -> DataFrame:
    """The two projects (one row or none each) as one: left values first, both metadata side by side."""
    names = ("name", "root", "repository_url", "revision")
    # one row each; an empty text counts as none
    blank = left.sparkSession.range(1).select(F.lit(1).alias("_"))
    side = lambda df, tag: blank.join(df.limit(1).select(F.lit(1).alias("_"), *[F.nullif(F.col(c), F.lit("")).alias(f"{tag}{c}") for c in names], F.col("metadata_json").alias(f"{tag}m")), "_", "left")
    both = side(left, "l").join(side(right, "r"), "_")
    metadata = F.to_json(F.struct(F.try_parse_json("lm").alias("static"), F.try_parse_json("rm").alias("runtime")))
    merged = both.select(*[F.coalesce(f"l{c}", f"r{c}").alias(c) for c in names], metadata.alias("metadata_json"))
    there = left.limit(1).unionByName(right.limit(1)).limit(1).select(F.lit(1).alias("_"))
    return merged.join(there, F.lit(True), "left_semi")


def merge(left: EvidenceGraph, right: EvidenceGraph) -> EvidenceGraph:
    """Union by id; raises if projects differ or one id has two payloads."""
    a, b = left.projects.first(), right.projects.first()
    for field in ("repository_url", "revision"):
        if a and b and a[field] and b[field] and a[field] != b[field]:
            raise ValueError(f"different {field}")
    out = {}
    for name in SCHEMAS:
        if name == "projects":
            continue
        l, r = getattr(left, name), getattr(right, name)
        bad = collisions(payload(l), payload(r)).limit(3).collect()
        if bad:
            raise ValueError(f"{name}: different payloads for {[x['id'] for x in bad]}")
        out[name] = l.unionByName(r.join(l.select("id"), "id", "left_anti").select(*l.columns))
    merged = EvidenceGraph(projects=merge_projects(left.projects, right.projects), **out)
    twice = merged.ids().groupBy("id").count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"one id in several collections: {[x['id'] for x in twice]}")
    return merged


def spans_of(nodes: DataFrame) -> DataFrame:
    """(id, label, role, path, start_line, end_line, symbol): one row a source span, paths normal."""
    flat = nodes.select("id", "label", "role", F.explode("source").alias("s"))
    path = tx.normal_path(F.col("s.path"))
    # a span without an end is one line
    end = F.coalesce(F.nullif(F.col("s.end_line"), F.lit(0)), "s.start_line").alias("end_line")
    return flat.select("id", "label", "role", path.alias("path"), "s.start_line", end, "s.symbol")


def match_scores(runtime: DataFrame, static: DataFrame) -> DataFrame:
    """(rt, st, score) of span pairs of which one path is the other or its end at a slash.

    Every path meets the other side's paths by equality with each of its own ends, so a
    common base name (such as an initialiser of every package) is no key by itself.
    """
    r = runtime.select(F.col("id").alias("rt"), F.col("path").alias("rp"), F.col("start_line").alias("rs"), F.col("end_line").alias("re"), F.col("symbol").alias("rsym"))
    s = static.select(F.col("id").alias("st"), F.col("path").alias("sp"), F.col("start_line").alias("ss"), F.col("end_line").alias("se"), F.col("symbol").alias("ssym"), "label", "role")
    near = F.when(F.col("rs") == F.col("ss"), 5).when((F.col("rs") <= F.col("se")) & (F.col("ss") <= F.col("re")), 2).otherwise(0)
    score = (
        F.lit(4) + near
        + F.when(F.col("label") == "forward", 2).otherwise(0)
        + F.when(F.col("role") == "python_method_definition", 1).otherwise(0)
        + F.when(tx.tail(F.col("rsym")) == tx.tail(F.col("ssym")), 2).otherwise(0)
    )
    ends = lambda path: F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda i: F.array_join(F.slice(F.split(path, "/"), i, F.size(F.split(path, "/"))), "/"))
    longer = r.withColumn("end", F.explode(ends(F.col("rp")))).join(s, F.col("end") == F.col("sp")).drop("end")
    shorter = s.withColumn("end", F.explode(ends(F.col("sp")))).where("end <> sp").join(r, F.col("end") == F.col("rp")).drop("end").select(*longer.columns)
    pairs = longer.unionByName(shorter)
    return pairs.groupBy("rt", "st").agg(F.max(score).alias("score"))


def best_unique(scores: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(rt, st, score): the best static match of each runtime node; a tie at the top gives none."""
    top = scores.where(F.col("score") >= threshold).groupBy("rt").agg(F.max("score").alias("score"))
    best = scores.join(top, ["rt", "score"]).groupBy("rt", "score").agg(F.count("*").alias("n"), F.min("st").alias("st"))
    return best.where("n = 1").select("rt", "st", "score")


def coverage_of(subjects: DataFrame, seen: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, n_considered, n_observed, status) of subjects (id) from occurrences (id, run_id)."""
    observed = seen.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi").select("id", "run_id").distinct().groupBy("id").agg(F.count("*").alias("n_observed"))
    total = runs.agg(F.count("*").alias("n_considered"))
    out = subjects.select("id").distinct().join(observed, "id", "left").crossJoin(F.broadcast(total))  # one row of totals
    n = F.coalesce("n_observed", F.lit(0))
    status = F.when(n == 0, "static_reachable_unobserved").when(n == F.col("n_considered"), "always_observed").otherwise("sometimes_observed")
    return out.select("id", "n_considered", n.alias("n_observed"), status.alias("status"))


def reconcile(static: EvidenceGraph, runtime: EvidenceGraph) -> EvidenceGraph:
    """Merged graph with an alias edge, evidence and coverage for each uniquely aligned runtime definition."""
    merged = merge(static, runtime)
    definitions = lambda g: g.nodes.where("identity_kind = 'definition'").where(F.size("source") > 0)
    best = best_unique(match_scores(spans_of(definitions(runtime)), spans_of(static.nodes.where(F.size("source") > 0))))
    numbered = best.withColumn("n", F.row_number().over(Window.orderBy("rt")) - 1)
    spark = merged.nodes.sparkSession
    make = lambda name, df: spark.createDataFrame([], SCHEMAS[name]).unionByName(df, allowMissingColumns=True)
    evidence = make("evidence", numbered.select(
        tx.sequence_id("evidence.alignment", F.col("n")).alias("id"), F.lit("static").alias("kind"), F.lit("inferred").alias("status"),
        F.least(F.lit(0.99), F.col("score") / 12.0).alias("confidence"), F.concat(F.lit("source alignment, score "), F.col("score").cast("string")).alias("description"),
    ))
    edges = make("edges", numbered.select(
        tx.sequence_id("edge.alignment", F.col("n")).alias("id"), F.col("rt").alias("source"), F.col("st").alias("target"), F.lit("alias").alias("kind"),
        F.array(tx.sequence_id("evidence.alignment", F.col("n"))).alias("evidence_ids"),
    ))
    seen = runtime.nodes.where("identity_kind = 'occurrence'").select(F.col("definition_id").alias("id"), "run_id")
    status = coverage_of(numbered.select(F.col("rt").alias("id")), seen, runtime.runs).where("n_considered > 0")
    runs = runtime.runs.agg(F.sort_array(F.collect_set("id")).alias("considered_run_ids"))
    observed = seen.groupBy("id").agg(F.sort_array(F.collect_set("run_id")).alias("observed_run_ids"))
    coverage = make("coverage", status.join(numbered.select(F.col("rt").alias("id"), "n"), "id").join(observed, "id", "left").crossJoin(F.broadcast(runs)).select(
        tx.sequence_id("coverage.alignment", F.col("n")).alias("id"), F.col("id").alias("subject_id"), "status", "considered_run_ids",
        F.coalesce("observed_run_ids", F.array().cast("array<string>")).alias("observed_run_ids"), F.array(tx.sequence_id("evidence.alignment", F.col("n"))).alias("evidence_ids"),
    ))
    return merged.with_tables(edges=merged.edges.unionByName(edges), evidence=merged.evidence.unionByName(evidence), coverage=merged.coverage.unionByName(coverage))


def last_producer(events: DataFrame, by: list[str], order: list[str], produced: str) -> DataFrame:
    """Adds ``producer``: the latest earlier non-null ``produced`` of the same keys."""
    earlier = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("producer", F.last(produced, ignorenulls=True).over(earlier))


def previous(events: DataFrame, by: list[str], order: list[str], value: str = "id") -> DataFrame:
    """Adds ``previous``: the value of the row before in each group."""
    return events.withColumn("previous", F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def versions(events: DataFrame, by: list[str], order: list[str], value: str = "id") -> DataFrame:
    """Adds ``version`` (from 1) of each object key and ``derived_from``, the value of the version before."""
    window = Window.partitionBy(*by).orderBy(*order)
    return events.withColumns({"version": F.row_number().over(window), "derived_from": F.lag(value).over(window)})


def innermost(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(id, parent): the enclosing interval of the same ``grp`` with the latest start; intervals are (grp, id, enter, leave)."""
    o = outer.select("grp", F.col("id").alias("parent"), F.col("enter").alias("oe"), F.col("leave").alias("ol"))
    pairs = inner.join(o, "grp").where("oe <= enter and leave <= ol and id <> parent and (oe < enter or leave < ol)")
    return pairs.groupBy("id").agg(F.max_by("parent", F.struct("oe", "parent")).alias("parent"))
