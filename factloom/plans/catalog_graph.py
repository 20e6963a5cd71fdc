"""Third part of the catalogue: browser forms, metrics, flows through the resolvers' operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmark, browser, flows, metrics, semantics
from ..schema import EvidenceGraph
from ..sources import manifests, repository
from ..sources.tables import bind, calls, read
from .catalog import _id, _members, query

# -- flow ----------------------------------------------------------------------------


def _event_calls(spark, sf):
    """Events as calls in the scope of their user, which assign their type and read two names."""
    place = [F.lit(0).alias("col"), F.lit(0).alias("ord")]
    return read(spark, sf, "events").select(
        _id("event", "event_id").alias("id"), F.lit("app.py").alias("path"), _id("customer", "user_id").alias("caller"), F.col("event_id").alias("line"), *place,
        F.array(F.lit("purchase"), F.lit("click")).alias("args"), F.array("event_type").alias("targets"), F.lit(None).cast("string").alias("symbol_id"),
    )


@query("""WITH w AS (SELECT event_id, v, last_value(CASE WHEN event_type = v THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, v ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
FROM events, (VALUES ('purchase'), ('click')) n(v)) SELECT 'event:' || p AS producer, 'event:' || event_id AS consumer, v AS variable FROM w WHERE p IS NOT NULL""")
def def_use(spark, sf):
    """The latest event of each read type before every event of a user."""
    return flows.def_use(_event_calls(spark, sf))


@query("""SELECT 'event:' || max(event_id) AS producer, 'order:' || o_orderkey AS consumer, 'purchase' AS variable FROM orders JOIN events ON user_id = o_custkey WHERE event_type = 'purchase' AND event_id <= 100000 GROUP BY o_orderkey
UNION ALL SELECT 'event:' || event_id, 'order:' || o_orderkey, '<return>' FROM orders JOIN (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id) f ON user_id = o_custkey""")
def return_flow(spark, sf):
    """What a customer returns to its orders: its latest purchase up to a line, and its first event as a call."""
    inner = _event_calls(spark, sf)
    outer = read(spark, sf, "orders").select(_id("order", "o_orderkey").alias("id"), _id("customer", "o_custkey").alias("symbol_id"))
    none = F.lit(None)
    resolved = inner.unionByName(outer, allowMissingColumns=True)
    names = read(spark, sf, "customer").select(_id("customer", "c_custkey").alias("symbol"), F.lit("purchase").alias("name"), F.lit(100_000).cast("long").alias("line"), none.cast("int").alias("col"))
    first = read(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("line")).select(_id("customer", "user_id").alias("symbol"), none.cast("string").alias("name"), "line", F.lit(0).alias("col"))
    return flows.return_flow(resolved, names.unionByName(first))


# -- explorer and browser ------------------------------------------------------------


@query("WITH_GRAPH SELECT id FROM (SELECT DISTINCT run AS id FROM node WHERE run IS NOT NULL) x ORDER BY id")
def available_runs(spark, sf):
    """All runs."""
    return browser.available_runs(bind(spark, sf))


@query("""WITH_GRAPH, c AS (SELECT parent, count(*) AS n FROM hier GROUP BY parent)
SELECT level, kind, identity_kind, count(*) AS n, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS children, min(key) AS first_key FROM (SELECT *, CASE level WHEN 'semantic' THEN 'semantic' ELSE level END || ':' || replace(id, ':', '%3A') AS key FROM node) x LEFT JOIN c ON c.parent = x.id GROUP BY ALL""")
def explorer_rows(spark, sf):
    """All nodes as explorer rows, by level and kind."""
    g = bind(spark, sf)
    rows = browser.explorer_rows(g.nodes, g.hierarchy().groupBy("parent").agg(F.count("*").alias("child_count")))
    return rows.groupBy("level", "kind", "identity_kind").agg(F.count("*").alias("n"), F.sum("child_count").alias("children"), F.min("key").alias("first_key"))


@query("""WITH_GRAPH SELECT 'module:customer%3A7' AS key, 'customer:7' AS entity_id, label, role, (SELECT count(*) FROM hier WHERE parent = 'customer:7') AS child_count FROM node WHERE id = 'customer:7'""")
def node_lookup(spark, sf):
    """One customer by its key."""
    return browser.node(bind(spark, sf), "module:customer%3A7").select("key", "entity_id", "label", "role", "child_count")


@query("SELECT 'region:' || r_regionkey AS id FROM region WHERE r_regionkey % 3 IN (0, 2)")
def semantic_allowed(spark, sf):
    """Groups that belong to training."""
    return browser.semantic_allowed(bind(spark, sf).nodes, "training").select("id")


@query("""WITH_GRAPH SELECT id, label, CAST(20 + CASE WHEN lower(label) = 'red widget' OR id = 'red widget' THEN 100 WHEN starts_with(lower(label), 'red widget') THEN 60 ELSE 0 END + CASE WHEN contains(coalesce(role, ''), 'red widget') THEN 40 ELSE 0 END AS INT) AS score
FROM node WHERE contains(lower(id || ' ' || label || ' ' || coalesce(role, '') || ' ' || kind), 'red') AND contains(lower(id || ' ' || label || ' ' || coalesce(role, '') || ' ' || kind), 'widget') ORDER BY score DESC, label, id LIMIT 80""")
def browser_search(spark, sf):
    """Ranked browser search."""
    return browser.browser_search(bind(spark, sf).nodes, "Red Widget")


@query("""WITH_GRAPH, r(id) AS (SELECT 'customer:7' UNION SELECT target FROM r JOIN edge ON source = r.id AND kind IN ('data', 'consumes', 'produces'))
SELECT 'node' AS what, id FROM r UNION ALL SELECT 'edge', edge.id FROM edge JOIN r ON r.id = source WHERE kind IN ('data', 'consumes', 'produces')""")
def browser_lineage(spark, sf):
    """Everything that flows from one customer, within the soft bound."""
    nodes, edges = browser.soft_lineage(bind(spark, sf), "customer:7", max_nodes=2500)
    return nodes.select(F.lit("node").alias("what"), "id").unionByName(edges.select(F.lit("edge").alias("what"), F.col("edge_id").alias("id")))


@query("""WITH_GRAPH SELECT 'customer:' || c_custkey AS id, 'nation:' || c_nationkey AS ancestor FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation""")
def ancestors_to_reveal(spark, sf):
    """What has to be open to show each customer and nation."""
    g = bind(spark, sf)
    return browser.ancestors_to_reveal(g.hierarchy(), g.membership(), g.nodes.where("id like 'customer:%' or id like 'nation:%'").select("id"))


@query("""WITH_GRAPH, m AS (SELECT 'customer:' || c_custkey AS id, n_regionkey AS g FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'supplier:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT call.id, n_regionkey FROM call JOIN orders ON o_orderkey = ok JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'order:' || o_orderkey, (o_orderkey % 5) FROM orders)
SELECT 'region:' || a.g AS src, 'region:' || b.g AS dst, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'data' END AS kind, count(DISTINCT edge.id) AS n_edges, min(edge.id) AS first_edge, max(edge.id) AS last_edge
FROM edge JOIN m a ON a.id = source JOIN m b ON b.id = target WHERE kind IN ('data', 'consumes', 'produces') AND a.g <> b.g GROUP BY 1, 2""")
def paper_edges(spark, sf):
    """Edges between regions with their kinds; orders belong to a region by key, calls to their customer's."""
    g = bind(spark, sf)
    region = lambda c: F.concat(F.lit("region:"), c.cast("string"))
    own = _members(spark, sf)
    orders = read(spark, sf, "orders")
    placed = calls(spark, sf).join(orders.select(F.col("o_orderkey").alias("ok"), _id("customer", "o_custkey").alias("member_id")), "ok").join(own, "member_id").select(F.col("id").alias("member_id"), "group_id")
    members = own.unionByName(placed.select("member_id", "group_id")).unionByName(orders.select(_id("order", "o_orderkey").alias("member_id"), region(F.col("o_orderkey") % 5).alias("group_id")))
    return browser.paper_edges(g.flow().select("edge_id", F.col("src").alias("source"), F.col("dst").alias("target"), "kind"), members)


def _grouped(spark, sf):
    """The bound graph with one group a region that lists its nations as members."""
    g = bind(spark, sf)
    listed = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(_id("nation", "n_nationkey"))).alias("m")).select(_id("region", "n_regionkey").alias("id"), F.to_json(F.struct(F.col("m").alias("member_ids"))).alias("j"))
    nodes = g.nodes.join(listed, "id", "left").withColumn("attributes_json", F.coalesce("j", "attributes_json")).select(*g.nodes.columns)
    return g.with_tables(nodes=nodes)


@query("""WITH_GRAPH, c AS (SELECT 'region:' || n_regionkey AS subject_id, 'nation:' || n_nationkey AS n FROM nation),
r(subject_id, id) AS (SELECT subject_id, n FROM c UNION SELECT r.subject_id, h.child FROM r JOIN hier h ON h.parent = r.id) SELECT subject_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM r GROUP BY 1""")
def related_nodes(spark, sf):
    """All that stands under the members of each region."""
    g = _grouped(spark, sf)
    return browser.related(g, g.nodes.where("level = 'semantic'").select("id")).groupBy("subject_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("""SELECT count(*) AS claim_count, count(*) FILTER (quality = 0) AS conflict_count FROM labels""")
def claim_counts(spark, sf):
    """Labels as author claims, those of low quality in conflict."""
    labels = read(spark, sf, "labels")
    claims = labels.select(_id("claim.author.", "doc_id").alias("id")).select(F.regexp_replace("id", ":", "").alias("id"))
    conflicts = labels.where("quality = 0").select(_id("conflict", "doc_id").alias("id"), F.lit("author_implementation_mismatch").alias("kind"))
    g = EvidenceGraph.of(spark)
    return browser.claim_counts(g.with_tables(claims=g.claims.unionByName(claims, allowMissingColumns=True), conflicts=g.conflicts.unionByName(conflicts, allowMissingColumns=True)))


@query("""WITH_GRAPH, l(id, m) AS (SELECT 'customer:' || c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'vision' WHEN 1 THEN 'audio' ELSE 'reward' END FROM customer UNION SELECT target, m FROM l JOIN edge ON source = l.id AND kind IN ('data', 'consumes', 'produces')),
g AS (SELECT id, string_agg(m, ',' ORDER BY m) AS modalities FROM l GROUP BY id) SELECT split_part(id, ':', 1) AS family, modalities, count(*) AS n FROM g GROUP BY ALL""")
def node_modalities(spark, sf):
    """Modalities that reach orders, calls and suppliers from customers named for one."""
    g = bind(spark, sf)
    key = F.substring_index("id", ":", -1).cast("long")
    named = F.when(F.startswith("id", F.lit("customer:")), F.get(F.array(F.lit("camera"), F.lit("speech"), F.lit("reward")), (key % 3).cast("int"))).otherwise("plain")
    found = semantics.node_modalities(g.with_tables(nodes=g.nodes.withColumns({"label": named, "role": F.lit(None).cast("string"), "attributes_json": F.lit(None).cast("string")})))
    return found.groupBy(F.substring_index("id", ":", 1).alias("family"), F.array_join("modalities", ",").alias("modalities")).agg(F.count("*").alias("n"))


# -- metrics -------------------------------------------------------------------------

_SIZES = """(SELECT count(*) FROM node) AS runtime_nodes, (SELECT count(*) FROM node WHERE identity_kind = 'definition') AS definitions, (SELECT count(*) FROM node WHERE identity_kind = 'occurrence') AS occurrences,
(SELECT count(*) FROM node WHERE identity_kind = 'value') AS "values", (SELECT count(*) FROM edge) AS runtime_edges, (SELECT count(*) FROM edge WHERE kind = 'consumes') AS consumes_edges, (SELECT count(*) FROM edge WHERE kind = 'produces') AS produces_edges"""


def _traced(spark, sf):
    """The bound graph with places (parts under /repo, every second customer outside), roles, probe roles and tensors of orders."""
    g = bind(spark, sf)
    key = F.substring_index("id", ":", -1).cast("long")
    span = lambda path: F.array(F.struct(path.alias("path"), F.lit(1).alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("int").alias("start_column"), F.lit(None).cast("int").alias("end_column"), F.lit(None).cast("string").alias("symbol")))
    part, customer, order, call = (F.startswith("id", F.lit(p + ":")) for p in ("part", "customer", "order", "call"))
    path = F.when(part, F.concat(F.lit("src/../p"), (key % 3).cast("string"), F.lit(".py"))).when(customer & (key % 2 == 0), F.concat(F.lit("../out/c"), F.lit(".py")))
    source = F.when(path.isNotNull(), span(path)).otherwise(F.col("source"))
    role = F.when(part & (key % 2 == 0), benchmark.MODULE_ROLE).when(part, benchmark.OPERATOR_ROLE).when(customer, benchmark.MODULE_ROLE).otherwise(F.col("role"))
    none = lambda kind: F.lit(None).cast(kind)
    shape = F.when(key % 3 == 0, F.array(F.struct(F.lit(2).cast("long").alias("size"), none("string").alias("symbol"))))
    tensor = F.when(order, F.struct(shape.alias("shape"), F.when(key % 3 == 1, "f4").alias("dtype"), none("string").alias("device"), none("string").alias("layout"), none("boolean").alias("requires_grad"), F.array().cast("array<string>").alias("semantics")))
    probe = F.when(call, F.to_json(F.struct(F.get(F.array(*map(F.lit, benchmark.PROBE_ROLES)), (F.substring_index(F.substring_index("id", ":", 3), ":", -1).cast("int") % 4)).alias("probe_role")))).otherwise(F.col("attributes_json"))
    return g.with_tables(nodes=g.nodes.withColumns({"source": source, "role": role, "tensor": tensor, "attributes_json": probe}))


_ORDERS = "SELECT o_orderkey % 3 AS k FROM orders"


@query(f"""WITH_GRAPH SELECT {_SIZES}, CAST((SELECT count(*) FROM part WHERE p_partkey % 2 = 0) + (SELECT count(*) FROM customer) AS BIGINT) AS module_definitions, (SELECT count(*) FROM part WHERE p_partkey % 2 = 1) AS operator_definitions, CAST(0 AS BIGINT) AS states,
(SELECT count(*) FROM part WHERE p_partkey % 2 = 0) AS target_source_definitions, (SELECT count(*) FROM part WHERE p_partkey % 2 = 1) AS target_operator_source_definitions, (SELECT count(*) FROM orders) AS tensor_nodes,
(SELECT count(*) FROM ({_ORDERS}) x WHERE k < 2) AS tensor_spec_nodes, CAST(0 AS BIGINT) AS derived_from_edges, round((SELECT count(*) FROM ({_ORDERS}) x WHERE k < 2) / (SELECT count(*) FROM orders), 6) AS tensor_spec_coverage,
1.5::DOUBLE AS trace_seconds, CAST(42 AS BIGINT) AS parameter_count, CAST(2 AS BIGINT) AS output_tensor_count""")
def runtime_metrics(spark, sf):
    """Measures of a traced run."""
    return benchmark.runtime_metrics(_traced(spark, sf), "/repo", 1.5, 42, 2).withColumn("tensor_spec_coverage", F.round("tensor_spec_coverage", 6))


@query(f"""WITH_GRAPH SELECT {_SIZES}, (SELECT count(*) FROM edge WHERE kind = 'calls') AS calls_edges, (SELECT count(*) FROM edge WHERE kind = 'next') AS next_edges,
CAST((SELECT count(*) FROM part) + (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS BIGINT) AS source_definitions, CAST((SELECT count(*) FROM customer WHERE c_custkey % 2 = 1) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS BIGINT) AS external_definitions,
(SELECT count(*) FROM orders) AS tensor_values, round((SELECT count(*) FROM ({_ORDERS}) x WHERE k = 0) / (SELECT count(*) FROM orders), 6) AS tensor_spec_coverage, 0.0::DOUBLE AS trace_seconds,
(SELECT count(*) FROM call WHERE CAST(split_part(id, ':', 3) AS INT) % 4 = 0) AS adapter_occurrences, (SELECT count(*) FROM call WHERE CAST(split_part(id, ':', 3) AS INT) % 4 = 1) AS transport_occurrences, (SELECT count(*) FROM call WHERE CAST(split_part(id, ':', 3) AS INT) % 4 = 2) AS environment_occurrences""")
def system_metrics(spark, sf):
    """Measures of a probed system."""
    return benchmark.system_metrics(_traced(spark, sf)).withColumn("tensor_spec_coverage", F.round("tensor_spec_coverage", 6))


@query("""WITH_GRAPH SELECT count(*) AS static_nodes, (SELECT count(*) FROM edge) AS static_edges, count(*) AS runtime_nodes, (SELECT count(*) FROM edge) AS runtime_edges, count(*) AS merged_nodes, CAST((SELECT count(*) FROM edge) + (SELECT count(*) FROM part WHERE p_partkey % 4 = 0) AS BIGINT) AS merged_edges,
(SELECT count(*) FROM part WHERE p_partkey % 2 = 0) AS target_runtime_definitions, (SELECT count(*) FROM part WHERE p_partkey % 4 = 0) AS aligned_target_runtime_definitions, round((SELECT count(*) FROM part WHERE p_partkey % 4 = 0) / (SELECT count(*) FROM part WHERE p_partkey % 2 = 0), 6) AS target_alignment_rate,
(SELECT count(*) FROM part WHERE p_partkey % 2 = 1) AS target_operator_definitions, (SELECT count(*) FROM part WHERE p_partkey % 4 = 0) AS source_alignments, (SELECT count(*) FROM part WHERE p_partkey % 4 = 0) AS alias_edges, (SELECT count(*) FROM supplier) AS coverage_records,
(SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0) AS always_observed, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 1) AS sometimes_observed, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 2) AS static_reachable_unobserved, 0.0::DOUBLE AS reconciliation_seconds FROM node""")
def hybrid_metrics(spark, sf):
    """Measures of a reconciliation in which every fourth part is aligned."""
    g = _traced(spark, sf)
    part = read(spark, sf, "part").where("p_partkey % 4 = 0")
    alias = part.select(F.concat(F.lit("edge.alignment."), F.col("p_partkey").cast("string")).alias("id"), _id("part", "p_partkey").alias("source"), _id("part", "p_partkey").alias("target"), F.lit("alias").alias("kind"))
    k = F.col("s_suppkey") % 3
    status = F.when(k == 0, "always_observed").when(k == 1, "sometimes_observed").otherwise("static_reachable_unobserved")
    coverage = read(spark, sf, "supplier").select(_id("coverage", "s_suppkey").alias("id"), status.alias("status"))
    merged = g.with_tables(edges=g.edges.unionByName(alias, allowMissingColumns=True), coverage=g.coverage.unionByName(coverage, allowMissingColumns=True))
    return benchmark.hybrid_metrics(g, g, merged, "/repo").withColumn("target_alignment_rate", F.round("target_alignment_rate", 6))


@query("""WITH_GRAPH, f AS (SELECT count(*) AS n, count(*) FILTER (p_partkey % 10 = 0) AS bad FROM part), c AS (SELECT count(*) AS n, count(*) FILTER (ok % 4 = 0) AS l, count(*) FILTER (ok % 4 = 1) AS e, count(*) FILTER (ok % 4 = 2) AS d, count(*) FILTER (ok % 4 = 3) AS u FROM call),
g AS (SELECT count(*) AS n, count(*) FILTER (level = 'semantic') AS s FROM node), u AS (SELECT count(*) AS n FROM supplier), p AS (SELECT CAST((SELECT count(*) FROM part) + (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS BIGINT) AS n)
SELECT f.n AS python_files, bad AS parse_errors, (SELECT count(*) FROM customer) AS symbols, c.n AS calls, l AS local_calls, e AS external_calls, d AS dynamic_calls, u AS unresolved_calls, (SELECT count(*) FROM region) AS config_entries, (SELECT count(*) FROM nation) AS config_references,
(SELECT count(*) FROM nation WHERE n_nationkey % 3 = 1) AS dynamic_config_references, (SELECT count(*) FROM nation WHERE n_nationkey % 3 = 2) AS unresolved_config_references, (SELECT count(*) FROM region) AS entrypoints, g.n AS graph_nodes, p.n AS source_span_nodes, g.s AS semantic_components,
(SELECT count(*) FROM edge) AS graph_edges, (SELECT count(*) FROM edge WHERE kind = 'data') AS dataflow_edges, u.n AS semantic_unclassified_nodes, (SELECT count(*) FROM region) AS declared_submodules, (SELECT count(*) FROM region WHERE r_regionkey % 2 = 1) AS unmaterialized_submodules,
round((f.n - bad) / f.n, 6) AS parse_success_rate, round((l + e) / c.n, 6) AS call_resolution_rate, round(p.n / g.n, 6) AS source_span_coverage, round((g.n - g.s - u.n) / (g.n - g.s), 6) AS semantic_coverage FROM f, c, g, u, p""")
def static_metrics(spark, sf):
    """The 25 static measures over the bound tables."""
    pick = lambda c, *names: F.get(F.array(*map(F.lit, names)), (F.col(c) % len(names)).cast("int"))
    files = read(spark, sf, "part").select(_id("part", "p_partkey").alias("path"), F.when(F.col("p_partkey") % 10 == 0, "bad").alias("parse_error"))
    resolved = calls(spark, sf).select(pick("ok", "local", "external", "dynamic", "unresolved").alias("resolution"))
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    references = nation.select(pick("n_nationkey", "resolved", "dynamic", "unresolved").alias("status"))
    modules = region.select((F.col("r_regionkey") % 2 == 0).alias("materialized"))
    rows = benchmark.static_metrics(files, read(spark, sf, "customer"), resolved, region, references, region, modules, _traced(spark, sf), read(spark, sf, "supplier"))
    return rows.select(*[F.round(c, 6).alias(c) if c.endswith(("_rate", "_coverage")) else F.col(c) for c in rows.columns])


@query("""SELECT '| ' || n_name || ' | ' || CASE WHEN n_nationkey % 2 = 0 THEN 'completed' ELSE 'failed' END || ' | ' || printf('%.2fs', n_nationkey / 4.0) || ' | ' || n_regionkey || ' | ' || n_nationkey || ' | 1 | ' || printf('%.1f%%', 100.0 * n_regionkey / 4) || ' |' AS line FROM nation
UNION ALL SELECT unnest(['# Benchmark Report', '', '## Runtime', '', '| Case | Status | Trace | Target module defs | Nodes | Op defs | Tensor spec |', '| --- | --- | ---: | ---: | ---: | ---: | ---: |', '', '## Failure taxonomy', ''])
UNION ALL SELECT '- **' || n_name || ' (runtime)**' || CASE WHEN n_nationkey % 2 = 0 THEN ': no recorded warnings/errors.' ELSE '' END FROM nation UNION ALL SELECT '  - `parse_error` (warning, n=3): broken' FROM nation WHERE n_nationkey % 2 = 1""")
def report_lines(spark, sf):
    """The report of made-up runtime results of nations, every second one failed."""
    n = read(spark, sf, "nation")
    bad = F.col("n_nationkey") % 2 == 1
    metrics_json = F.to_json(F.struct((F.col("n_nationkey") / 4.0).alias("trace_seconds"), F.col("n_regionkey").alias("target_source_definitions"), F.col("n_nationkey").alias("runtime_nodes"), F.lit(1).alias("operator_definitions"), (F.col("n_regionkey") / 4.0).alias("tensor_spec_coverage")))
    results = n.select(F.col("n_name").alias("case_id"), F.lit("runtime").alias("mode"), F.when(bad, "failed").otherwise("completed").alias("status"), F.lit("runtime").alias("metric_kind"), metrics_json.alias("metrics_json"))
    failures = n.where(bad).select(F.col("n_name").alias("case_id"), F.lit("runtime").alias("mode"), F.lit("parse_error").alias("category"), F.lit("warning").alias("severity"), F.lit("broken").alias("message"), F.lit(3).alias("n"))
    return benchmark.report_lines(results, failures).select("line")


# -- sources -------------------------------------------------------------------------


@query("""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, octet_length(encode(text)) AS b FROM documents)
SELECT path, CASE WHEN b IS NULL THEN 'not_utf8_text' WHEN b > 8000 THEN 'file_too_large' ELSE 'embedded' END AS outcome FROM d""")
def source_bundle(spark, sf):
    """All documents as referenced files, bounded by file size only."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.col("text").isNotNull().alias("utf8"))
    return repository.bundle(docs.select("path"), docs, max_file=8000, max_total=10**15).select("path", "outcome")


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256, CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'mismatch' ELSE 'missing' END AS status FROM documents WHERE text IS NOT NULL AND doc_id % 3 < 2
UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, 'missing' FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 2""")
def resource_check(spark, sf):
    """Fingerprints of documents against wanted ones: a third right, a third wrong, a third not there."""
    docs = read(spark, sf, "documents").where("text is not null").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))
    wanted = docs.select("path", F.when(F.col("doc_id") % 3 == 1, "0").otherwise(F.col("sha256")).alias("sha256"))
    return manifests.verified(wanted, docs.where("doc_id % 3 < 2").select("path", "sha256", "size_bytes")).select("path", "sha256", "status")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def metadata_histogram(spark, sf):
    """Counts of event types."""
    return metrics.histogram(read(spark, sf, "events"), "event_type")
