"""Second half of the catalogue: semantics, claims, static resolution, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import align, claims, compare, explore, flows, metrics, semantics, traverse
from ..schema import EvidenceGraph
from ..sources.configs import flatten_json
from ..sources.tables import bind, calls, read
from .catalog import _id, query

# -- static resolution ---------------------------------------------------------------

_TYPES = "['click', 'error', 'purchase', 'signup', 'view']"


@query(f"""WITH e AS (SELECT event_id, 'customer:' || user_id AS sym, event_type AS formal FROM events)
SELECT DISTINCT 'order:' || o_orderkey AS producer, 'event:' || event_id AS consumer, o_orderpriority AS variable
FROM orders JOIN e ON sym = 'customer:' || o_custkey AND formal = {_TYPES}[1 + o_custkey % 5]""")
def argument_flow(spark, sf):
    """Orders as outer calls of customers, events as inner calls naming the customer's formal."""
    orders = read(spark, sf, "orders")
    outer = orders.select(_id("order", "o_orderkey").alias("id"), F.lit(None).cast("string").alias("caller"), _id("customer", "o_custkey").alias("symbol_id"), F.array().cast("array<string>").alias("args"))
    inner = read(spark, sf, "events").select(_id("event", "event_id").alias("id"), _id("customer", "user_id").alias("caller"), F.lit(None).cast("string").alias("symbol_id"), F.array("event_type").alias("args"))
    formal = F.get(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), (F.col("c_custkey") % 5).cast("int"))
    params = read(spark, sf, "customer").select(_id("customer", "c_custkey").alias("symbol"), F.lit(0).alias("pos"), formal.alias("formal"))
    bound = orders.select(_id("order", "o_orderkey").alias("call_id"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("formal"), F.col("o_orderpriority").alias("actual"))
    return flows.argument_flow(outer.unionByName(inner), params, bound)


@query("""WITH s AS (SELECT 'm' || (n_nationkey % 5) || '.' || lower(n_name) AS name, 'nation:' || n_nationkey AS id FROM nation UNION ALL SELECT 'm2.B.run', 'method:B.run'),
c AS (SELECT c_custkey, c_nationkey % 5 AS m, CASE c_custkey % 6 WHEN 0 THEN 'nation_' || c_nationkey WHEN 1 THEN 'len' WHEN 2 THEN 'self.run' WHEN 3 THEN 'lib.' || lower(c_mktsegment) WHEN 4 THEN '' ELSE 'missing' END AS callee FROM customer),
t AS (SELECT c_custkey, CASE WHEN callee = '' THEN NULL WHEN callee LIKE 'nation%' THEN 'm' || m || '.' || callee WHEN callee = 'len' THEN 'builtins.len' WHEN callee = 'self.run' AND m = 2 THEN 'm2.B.run' WHEN callee LIKE 'lib.%' AND m < 3 THEN 'vendor.' || callee END AS target FROM c)
SELECT 'customer:' || c_custkey AS id, CASE WHEN s.id IS NOT NULL THEN 'local' WHEN target IS NOT NULL THEN 'external' ELSE 'dynamic' END AS resolution, target, s.id AS symbol_id FROM t LEFT JOIN s ON s.name = target""")
def call_resolution(spark, sf):
    """Made-up calls of customers: own names, builtins, self methods, imports, unknown names."""
    kind = F.col("c_custkey") % 6
    callee = (
        F.when(kind == 0, F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"))).when(kind == 1, "len").when(kind == 2, "self.run")
        .when(kind == 3, F.concat(F.lit("lib."), F.lower("c_mktsegment"))).when(kind == 4, "").otherwise("missing")
    )
    module = F.concat(F.lit("m"), (F.col("c_nationkey") % 5).cast("string"))
    rows = read(spark, sf, "customer").select(_id("customer", "c_custkey").alias("id"), module.alias("module"), F.concat(module, F.lit(".C")).alias("caller_class"), callee.alias("callee"))
    symbols = read(spark, sf, "nation").select(_id("nation", "n_nationkey").alias("id"), F.concat(F.lit("m"), (F.col("n_nationkey") % 5).cast("string"), F.lit("."), F.lower("n_name")).alias("name"), F.lit(0).alias("ordinal"))
    symbols = symbols.unionByName(spark.createDataFrame([("method:B.run", "m2.B.run", 0)], "id string, name string, ordinal int"))
    imports = spark.createDataFrame([(f"m{i}", "lib", "vendor.lib", 0) for i in range(3)], "module string, local string, target string, ordinal int")
    bases = spark.createDataFrame([("m2.C", "m2.B", 0)], "cls string, base string, ord int")
    methods = spark.createDataFrame([("m2.B", "run")], "cls string, method string")
    return flows.resolve_calls(rows, symbols, imports, bases, methods).select("id", "resolution", "target", "symbol_id")


@query("""WITH RECURSIVE b AS (SELECT n_nationkey AS k, n_nationkey // 2 AS p, '0000' AS o FROM nation WHERE n_nationkey > 0 UNION ALL SELECT n_nationkey, n_nationkey // 3, '0001' FROM nation WHERE n_nationkey > 2),
r(cls, here, path) AS (SELECT n_nationkey, n_nationkey, '' FROM nation UNION ALL SELECT r.cls, b.p, r.path || b.o FROM r JOIN b ON b.k = r.here)
SELECT 'nation:' || cls AS cls, method, 'nation:' || arg_min(here, path) AS owner FROM (SELECT r.cls, r.here, r.path, 'm' || (r.here % 4) AS method FROM r WHERE r.here % 2 = 1) x GROUP BY cls, method""")
def inherited_method(spark, sf):
    """Methods found through two ordered bases of each nation."""
    n = read(spark, sf, "nation")
    half = n.where("n_nationkey > 0").select(_id("nation", "n_nationkey").alias("cls"), F.expr("concat('nation:', n_nationkey div 2)").alias("base"), F.lit(0).alias("ord"))
    third = n.where("n_nationkey > 2").select(_id("nation", "n_nationkey").alias("cls"), F.expr("concat('nation:', n_nationkey div 3)").alias("base"), F.lit(1).alias("ord"))
    methods = n.where("n_nationkey % 2 = 1").select(_id("nation", "n_nationkey").alias("cls"), F.concat(F.lit("m"), (F.col("n_nationkey") % 4).cast("string")).alias("method"))
    return flows.inherited(half.unionByName(third), methods)


@query("""SELECT 'nation:' || n_nationkey AS id, CASE WHEN n_nationkey % 5 = 4 THEN 'dynamic' WHEN n_nationkey % 5 < 2 THEN 'resolved' ELSE 'unresolved' END AS status,
CASE WHEN n_nationkey % 5 < 2 THEN 'region:' || (n_nationkey % 5) ELSE '' END AS entries FROM nation""")
def config_resolution(spark, sf):
    """References of nations to the configuration files of two regions."""
    k = F.col("n_nationkey") % 5
    refs = read(spark, sf, "nation").select(_id("nation", "n_nationkey").alias("id"), F.lit("load").alias("kind"), F.concat(F.lit("./x/../conf/r"), k.cast("string")).alias("path"), F.lit(None).cast("string").alias("name"), (k == 4).alias("dynamic"))
    entries = read(spark, sf, "region").where("r_regionkey < 2").select(_id("region", "r_regionkey").alias("entry_id"), F.concat(F.lit("conf//r"), F.col("r_regionkey").cast("string"), F.lit(".yaml")).alias("path"))
    return flows.resolve_configs(refs, entries).select("id", "status", F.array_join("entry_ids", ",").alias("entries"))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def config_flatten(spark, sf):
    """Leaves of the events' property documents."""
    return flatten_json(read(spark, sf, "events").select("event_id", F.col("props").alias("json")), "event_id")


@query("""SELECT 'part:' || p_partkey AS path, CAST(sum(points) AS BIGINT) AS score, string_agg(reason, '; ' ORDER BY reason) AS reasons FROM (
SELECT p_partkey, 4 AS points, 'filename' AS reason FROM part WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey, 6, 'guard' FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 1, 'framework' FROM part WHERE p_type = 'ECONOMY') x GROUP BY p_partkey""")
def entrypoint_score(spark, sf):
    """Scores summed from reasons."""
    p = read(spark, sf, "part").select(_id("part", "p_partkey").alias("path"), "p_size", "p_type")
    row = lambda cond, points, reason: p.where(cond).select("path", F.lit(points).alias("points"), F.lit(reason).alias("reason"))
    return metrics.entrypoint_scores(row("p_size % 5 = 0", 4, "filename").unionByName(row("p_size % 3 = 0", 6, "guard")).unionByName(row("p_type = 'ECONOMY'", 1, "framework")))


# -- alignment -----------------------------------------------------------------------


@query("""WITH s AS (SELECT 'part:' || p_partkey AS st, 'd' || (p_partkey % 7) AS d, p_partkey % 40 AS f, p_size AS a, p_size + 3 AS b, p_partkey % 4 = 0 AS fwd, p_partkey % 3 = 0 AS met, p_partkey % 5 AS m FROM part),
r AS (SELECT 'supplier:' || s_suppkey AS rt, 'd' || (s_suppkey % 7) AS d, s_suppkey % 40 AS f, 1 + s_suppkey % 50 AS a, 3 + s_suppkey % 50 AS b, s_suppkey % 5 AS m FROM supplier),
x AS (SELECT rt, st, 4 + CASE WHEN r.a = s.a THEN 5 WHEN r.a <= s.b AND s.a <= r.b THEN 2 ELSE 0 END + CASE WHEN fwd THEN 2 ELSE 0 END + CASE WHEN met THEN 1 ELSE 0 END + CASE WHEN r.m = s.m THEN 2 ELSE 0 END AS score FROM r JOIN s ON r.d = s.d AND r.f = s.f),
t AS (SELECT *, rank() OVER (PARTITION BY rt ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY rt, score) AS n FROM x WHERE score >= 8) SELECT rt, st, CAST(score AS INT) AS score FROM t WHERE k = 1 AND n = 1""")
def align_suffix_best(spark, sf):
    """Suppliers as runtime definitions under /srv, parts as static ones: unique best matches."""
    path = lambda key: F.concat(F.lit("pkg/d"), (F.col(key) % 7).cast("string"), F.lit("/f"), (F.col(key) % 40).cast("string"), F.lit(".py"))
    nothing = F.lit(None).cast("string")
    span = lambda p, a, b, symbol: F.array(F.struct(p.alias("path"), a.cast("int").alias("start_line"), b.cast("int").alias("end_line"), symbol.alias("symbol")))
    symbol = lambda key: F.concat(F.lit("X.m"), (F.col(key) % 5).cast("string"))
    static = read(spark, sf, "part").select(
        _id("part", "p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, "forward").otherwise(F.col("p_name")).alias("label"), F.when(F.col("p_partkey") % 3 == 0, "python_method_definition").alias("role"),
        span(path("p_partkey"), F.col("p_size"), F.col("p_size") + 3, symbol("p_partkey")).alias("source"),
    )
    runtime = read(spark, sf, "supplier").select(
        _id("supplier", "s_suppkey").alias("id"), nothing.alias("label"), nothing.alias("role"),
        span(F.concat(F.lit("/srv/./"), path("s_suppkey")), F.col("s_suppkey") % 50 + 1, F.col("s_suppkey") % 50 + 3, symbol("s_suppkey")).alias("source"),
    )
    return align.best_unique(align.match_scores(align.spans_of(runtime), align.spans_of(static)))


@query("""WITH d AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT DISTINCT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark)
SELECT item_id, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM b JOIN d USING (line) GROUP BY item_id""")
def containment_alignment(spark, sf):
    """Documents that hold a whole line of a benchmark item (equal lines, an equi join)."""
    lines = lambda name, key: read(spark, sf, name).select(key, F.explode(F.split("text", "\n")).alias("line")).distinct()
    return lines("benchmark", "item_id").join(lines("documents", "doc_id"), "line").groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


# -- semantics -----------------------------------------------------------------------

# parts with names that the fixed role table knows; the SQL repeats the three roles they meet
_WORDS = ("resnet trunk", "memory bank", "text encoder", "bolt")


def _parts(spark, sf):
    """Parts as mechanical nodes, a third of them losses by kind, with a word of the role table by key."""
    part = read(spark, sf, "part")
    word = F.get(F.array(*map(F.lit, _WORDS)), (F.col("p_partkey") % 4).cast("int"))
    none = F.array().cast("array<string>")
    return part.select(
        _id("part", "p_partkey").alias("id"), F.lit("operation").alias("level"), F.when(F.col("p_partkey") % 5 == 0, "loss").otherwise("operation").alias("kind"), F.lit("definition").alias("identity_kind"),
        F.col("p_name").alias("label"), none.alias("parent_ids"), none.alias("evidence_ids"), F.to_json(F.struct(word.alias("of"), F.array(F.lit("x")).alias("list"))).alias("attributes_json"),
    )


def _hypotheses(spark, sf):
    """The hypotheses of parts by the fixed role table."""
    graph = EvidenceGraph.of(spark)
    return semantics.hypotheses(graph.with_tables(nodes=graph.nodes.unionByName(_parts(spark, sf), allowMissingColumns=True)))


_HYP_SQL = """p AS (SELECT 'part:' || p_partkey AS id, p_partkey AS k, p_brand FROM part),
h AS (SELECT id, 'vision_encoder' AS role, 10 AS priority, 0.88 AS confidence FROM p WHERE k % 4 = 0 UNION ALL SELECT id, 'memory', 43, 0.88 FROM p WHERE k % 4 = 1
UNION ALL SELECT id, 'language_encoder', 11, 0.88 FROM p WHERE k % 4 = 2 UNION ALL SELECT id, 'generic_encoder', 90, 0.58 FROM p WHERE k % 4 = 2 UNION ALL SELECT id, 'loss', 60, 0.99 FROM p WHERE k % 5 = 0)"""


@query(f"WITH {_HYP_SQL} SELECT id, role, confidence::DOUBLE AS confidence, CAST(row_number() OVER (PARTITION BY id ORDER BY confidence DESC, priority, role) AS INT) AS rank FROM h")
def role_hypotheses(spark, sf):
    """Ranked roles of parts by the whole rule table."""
    return _hypotheses(spark, sf).select("id", "role", "confidence", "rank")


@query(f"""WITH {_HYP_SQL}, t AS (SELECT h.*, 'brand:' || p_brand AS anchor FROM h JOIN p ON p.id = h.id QUALIFY row_number() OVER (PARTITION BY h.id ORDER BY confidence DESC, priority, role) = 1)
SELECT anchor, id, role, confidence::DOUBLE AS confidence FROM t QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY confidence DESC, priority, id) = 1""")
def anchor_winner(spark, sf):
    """The winning part of each brand."""
    anchors = read(spark, sf, "part").select(_id("part", "p_partkey").alias("id"), F.concat(F.lit("brand:"), "p_brand").alias("anchor"))
    return semantics.anchor_winners(_hypotheses(spark, sf).where("rank = 1"), anchors)


@query(f"""WITH {_HYP_SQL}, r AS (SELECT id, role, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, priority, role) AS rank FROM h)
SELECT 'part:' || p_partkey AS id, CASE WHEN c IS NULL THEN 'unknown' ELSE 'low_confidence' END AS status, coalesce(c, '') AS candidates
FROM part LEFT JOIN (SELECT id, string_agg(role, ',' ORDER BY rank) AS c FROM r WHERE rank <= 3 GROUP BY id) g ON g.id = 'part:' || p_partkey WHERE p_size % 4 <> 0""")
def unclassified_nodes(spark, sf):
    """Parts outside groups with their best roles."""
    nodes = read(spark, sf, "part").select(_id("part", "p_partkey").alias("id"), "p_size")
    return semantics.unclassified(nodes, nodes.where("p_size % 4 = 0").select("id"), _hypotheses(spark, sf))


@query("""SELECT 'brand:' || p_brand AS group_id, 'part:' || p_partkey AS member_id FROM part WHERE p_partkey % 11 <> 0 UNION ALL SELECT 'human:' || (p_partkey % 3), 'part:' || p_partkey FROM part WHERE p_partkey % 11 = 0""")
def override_groups(spark, sf):
    """Machine groups without overridden members, and the overrides."""
    part = read(spark, sf, "part")
    machine = part.select(F.concat(F.lit("brand:"), "p_brand").alias("group_id"), _id("part", "p_partkey").alias("member_id"))
    human = part.where("p_partkey % 11 = 0").select(F.concat(F.lit("human:"), (F.col("p_partkey") % 3).cast("string")).alias("group_id"), _id("part", "p_partkey").alias("member_id"))
    return semantics.apply_overrides(machine, human)


# -- claims --------------------------------------------------------------------------

_SAY = ("uses a vision encoder", "no memory bank is used", "the tokenizer is frozen", "a trainable planner, without a controller", "fine tuned policy", "nothing here")
_SAID = """(VALUES (0, 'vision_encoder', 'component_present', true), (1, 'memory', 'component_present', false), (2, 'tokenizer', 'component_present', true), (2, 'tokenizer', 'frozen', true), (3, 'planner', 'component_present', true),
(3, 'planner', 'frozen', false), (3, 'controller', 'component_present', false), (3, 'controller', 'frozen', false), (4, 'policy', 'component_present', true), (4, 'policy', 'frozen', false)) s(k, role, predicate, value)"""


@query(f"SELECT CAST(doc_id AS VARCHAR) AS path, CAST(2 AS INT) AS line, role, predicate, value FROM documents JOIN {_SAID} ON s.k = doc_id % 6")
def author_declarations(spark, sf):
    """Declarations by the fixed patterns in the second line made for each document, negations and frozen words included."""
    say = F.get(F.array(*map(F.lit, _SAY)), (F.col("doc_id") % len(_SAY)).cast("int"))
    docs = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("# title\n"), say).alias("text"))
    return claims.declarations(claims.lines_of(docs))


_CLAIMS = """WITH a AS (SELECT 'claim:' || doc_id AS claim_id, 'doc:' || doc_id AS subject_id, 'good' AS predicate, quality = 1 AS value, doc_id FROM labels),
i AS (SELECT 'impl:' || doc_id AS impl_id, 'doc:' || doc_id AS subject_id, n_chars > 800 AS impl_value FROM documents)
SELECT a.claim_id, a.subject_id, a.predicate, a.value, impl_id, impl_value, CASE WHEN impl_id IS NULL THEN 'unresolved' WHEN value = impl_value THEN 'supported' ELSE 'contradicted' END AS status FROM a LEFT JOIN i USING (subject_id)"""


def _compared(spark, sf):
    author = read(spark, sf, "labels").select(_id("claim", "doc_id").alias("claim_id"), _id("doc", "doc_id").alias("subject_id"), F.lit("good").alias("predicate"), (F.col("quality") == 1).alias("value"))
    facts = read(spark, sf, "documents").select(_id("doc", "doc_id").alias("subject_id"), F.lit("good").alias("predicate"), (F.col("n_chars") > 800).alias("value"), _id("impl", "doc_id").alias("impl_id"))
    return claims.compare(author, facts)


@query(_CLAIMS)
def claim_check(spark, sf):
    """Label claims against facts of the documents."""
    return _compared(spark, sf).select("claim_id", "subject_id", "predicate", "value", "impl_id", "impl_value", "status")


@query(f"SELECT claim_id AS author_claim, impl_id AS implementation_claim, subject_id, predicate, 'author_implementation_mismatch' AS kind, 'open' AS status FROM ({_CLAIMS}) x WHERE status = 'contradicted'")
def conflicts(spark, sf):
    """Conflicts of contradicted claims."""
    return claims.conflicts(_compared(spark, sf))


# -- reports -------------------------------------------------------------------------


@query("""SELECT CASE WHEN c LIKE 'super.%' THEN 'super_method' WHEN c LIKE 'self.%' THEN 'self_attribute' WHEN c LIKE '<dynamic>%' THEN 'call_result_attribute' WHEN NOT contains(c, '.') THEN 'bare_callable' ELSE 'receiver_attribute' END AS shape, count(*) AS n
FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'super.' WHEN 1 THEN 'self.' WHEN 2 THEN '<dynamic>.' WHEN 3 THEN '' ELSE 'x.' END || p_name AS c FROM part) x GROUP BY 1""")
def call_shape_histogram(spark, sf):
    """Shapes of unresolved callees."""
    k = F.col("p_partkey") % 5
    callee = F.concat(F.when(k == 0, "super.").when(k == 1, "self.").when(k == 2, "<dynamic>.").when(k == 3, "").otherwise("x."), "p_name")
    return metrics.histogram(read(spark, sf, "part").select(tx.call_shape(callee).alias("shape")), "shape").select(F.col("value").alias("shape"), "n")


@query("""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)
SELECT event_type AS category, count(*) AS n, string_agg(CASE WHEN k <= 10 THEN CAST(event_id AS VARCHAR) END, '|' ORDER BY k) AS examples FROM r GROUP BY event_type""")
def failure_rollup(spark, sf):
    """Counts and first examples of each event type."""
    return metrics.rollup_examples(read(spark, sf, "events").select("event_type", "event_id"), "event_type", "event_id", "event_id")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS rank, least(length(text), 1200) AS s FROM documents), b AS (SELECT *, coalesce(sum(s) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WHERE rank <= 24)
SELECT doc_id, CAST(rank AS INT) AS rank, CAST(least(s, greatest(0, 20000 - before)) AS INT) AS n_chars FROM b WHERE least(s, greatest(0, 20000 - before)) > 0""")
def context_budget(spark, sf):
    """The first documents clipped under a running budget."""
    rows = read(spark, sf, "documents").select("doc_id", "source", "text")
    return metrics.clip_budget(rows, ["source", "doc_id"], 24, 1200, 20000).select("doc_id", "rank", F.length("text").alias("n_chars"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS line FROM d)
SELECT 'doc:' || doc_id AS id, CAST(0 AS INT) AS n, CAST(line AS INT) AS line, t AS text FROM x WHERE line BETWEEN 2 AND 4""")
def source_excerpt(spark, sf):
    """Line 3 of documents with a line of context."""
    docs = read(spark, sf, "documents")
    spans = docs.select(_id("doc", "doc_id").alias("id"), F.lit(0).alias("n"), F.col("doc_id").cast("string").alias("path"), F.lit(3).alias("start_line"), F.lit(3).alias("end_line"))
    return explore.excerpts(spans, docs.select(F.col("doc_id").cast("string").alias("path"), "text"), context=1)


@query("""WITH_GRAPH, c AS (SELECT 'supplier:' || sk AS parent, call.id AS child, 'part:' || pk AS def, p_name, count(*) OVER (PARTITION BY sk, pk) AS n FROM call JOIN part ON p_partkey = pk)
SELECT parent, CASE WHEN n >= 3 THEN 'repeat:' || parent || ':definition:' || def ELSE child END AS row_id, CASE WHEN n >= 3 THEN p_name || ' ×' || n ELSE child END AS label, count(*) AS members FROM c GROUP BY ALL""")
def repeat_collapse(spark, sf):
    """Calls of one part under one supplier, collapsed."""
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("pk"), F.col("p_name").alias("definition_label"))
    rows = calls(spark, sf).join(part, "pk").select(_id("supplier", "sk").alias("parent"), F.col("id").alias("child"), F.col("id").alias("label"), _id("part", "pk").alias("definition_id"), "definition_label")
    return explore.collapse_repeats(rows)


@query("""WITH_GRAPH, s AS (SELECT run, lower(p_type) || '::' || lower(p_name) AS key, count(*) AS n, min('part:' || pk) AS id FROM call JOIN part ON p_partkey = pk WHERE run IN ('run.1996', 'run.1997') GROUP BY 1, 2),
a AS (SELECT * FROM s WHERE run = 'run.1997'), b AS (SELECT * FROM s WHERE run = 'run.1996')
SELECT coalesce(a.key, b.key) AS key, coalesce(a.id, b.id) AS id, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.key = b.key""")
def semantic_diff(spark, sf):
    """Kinds of parts sold in two years."""
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("pk"), F.lower("p_type").alias("role"), F.col("p_name").alias("label"))
    sold = calls(spark, sf).where("run in ('run.1996', 'run.1997')").join(part, "pk").groupBy("run", "role", "label").agg(F.count("*").alias("n_members"), F.min(_id("part", "pk")).alias("id"))
    rows = sold.select("run", "id", "role", "label", F.lit(None).cast("string").alias("phase"), F.lit("").alias("modalities"), "n_members", F.lit(0).alias("ordinal"))
    return compare.diff(compare.fingerprints(rows.where("run = 'run.1997'")), compare.fingerprints(rows.where("run = 'run.1996'")))


@query("""WITH_GRAPH, v AS (SELECT 'nation:' || n_nationkey AS id, 0 AS depth FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 'customer:' || c_custkey, 1 FROM customer WHERE c_nationkey < 3 UNION ALL SELECT 'supplier:' || s_suppkey, 1 FROM supplier WHERE s_nationkey < 3
UNION ALL SELECT 'order:' || o_orderkey, 2 FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 3 AND c_custkey % 10 = 0)
SELECT CASE WHEN depth IS NULL THEN 'edges' ELSE 'depth ' || depth END AS what, n FROM (SELECT depth, count(*) AS n FROM v GROUP BY depth UNION ALL SELECT NULL, count(*) FROM edge WHERE kind <> 'contains' AND source IN (SELECT id FROM v) AND target IN (SELECT id FROM v)) x""")
def visible_graph(spark, sf):
    """Five nations, three of them open, every tenth customer open."""
    g = bind(spark, sf)
    key = F.split("id", ":")[1].cast("int")
    roots = g.nodes.where("id like 'nation:%'").where(key < 5).select("id")
    opened = g.nodes.where("id like 'nation:%'").where(key < 3).select("id").unionByName(g.nodes.where("id like 'customer:%'").where(key % 10 == 0).select("id"))
    shown, edges = traverse.visible(g.hierarchy(), roots, opened, g.edges)
    return shown.groupBy(F.concat(F.lit("depth "), F.col("depth").cast("string")).alias("what")).agg(F.count("*").alias("n")).unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n"))
