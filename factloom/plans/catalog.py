"""Query catalogue: every operator over the bound driver tables, with its SQL.

``QUERIES`` maps names to (spark, sf_dir) -> DataFrame, ``ORACLE_SQL`` the same
names to DuckDB SQL.  Queries are declared by ``query`` next to their SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import align, explore, metrics, project, traverse, validate
from ..sources.tables import SQL, bind, calls, read
from ..sources.traces import number_occurrences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name; ``sql`` may start from the bound common tables with WITH_GRAPH."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.replace("WITH_GRAPH", "WITH RECURSIVE " + SQL)
        return f

    return add


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def _members(spark, sf):
    """(member_id, group_id): customers and suppliers to their region."""
    nation = read(spark, sf, "nation").select(F.col("n_nationkey").alias("nk"), _id("region", "n_regionkey").alias("group_id"))
    people = read(spark, sf, "customer").select(_id("customer", "c_custkey").alias("member_id"), F.col("c_nationkey").alias("nk")).unionByName(
        read(spark, sf, "supplier").select(_id("supplier", "s_suppkey").alias("member_id"), F.col("s_nationkey").alias("nk"))
    )
    return people.join(nation, "nk").select("member_id", "group_id")


@query("""WITH_GRAPH
SELECT 'region:' || a.n_regionkey AS src, 'region:' || b.n_regionkey AS dst, count(*) AS n_edges, min(c.id) AS min_edge, max(c.id) AS max_edge
FROM call c JOIN orders ON o_orderkey = c.ok JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = c_nationkey
JOIN supplier ON s_suppkey = c.sk JOIN nation b ON b.n_nationkey = s_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2""")
def paper_projection(spark, sf):
    """Quotient graph of regions over the calls between their customers and suppliers."""
    flow = calls(spark, sf).join(read(spark, sf, "orders").select(F.col("o_orderkey").alias("ok"), "o_custkey"), "ok")
    return project.quotient(flow.select(F.col("id").alias("edge_id"), _id("customer", "o_custkey").alias("source"), _id("supplier", "sk").alias("target")), _members(spark, sf))


_COMPONENTS = """SELECT id AS group_id, label, role, CAST(row_number() OVER (ORDER BY id) AS INT) AS rank FROM (
SELECT 'region:' || r_regionkey AS id, r_name AS label, lower(r_name) AS role, (r_regionkey + 5) / 10.0 AS confidence,
CASE r_regionkey % 3 WHEN 0 THEN 'training' WHEN 1 THEN 'inference' ELSE 'both' END AS phase FROM region) x
WHERE confidence >= {c} AND phase IN ('both', '{p}') {more} QUALIFY rank <= {n}"""


@query(_COMPONENTS.format(c=0.55, p="training", n=2, more="AND role <> 'asia'"))
def paper_projection_topk(spark, sf):
    """The first two training components but Asia."""
    return project.components(bind(spark, sf), phase="training", exclude=("asia",), limit=2)


@query(_COMPONENTS.format(c=0.6, p="inference", n=12, more=""))
def select_components_phase(spark, sf):
    """Inference components of some confidence."""
    return project.components(bind(spark, sf), phase="inference", min_confidence=0.6)


@query("""WITH_GRAPH SELECT level, count(*) AS n FROM node WHERE run IS NULL OR run = 'run.1996' GROUP BY level""")
def visible_in_run(spark, sf):
    """Visible nodes of one run by level."""
    return explore.visible_in_run(bind(spark, sf).nodes, "run.1996").groupBy("level").agg(F.count("*").alias("n"))


@query("""WITH_GRAPH SELECT id, kind FROM node WHERE identity_kind = 'value' AND kind IN ('input', 'output') AND run = 'run.1997'""")
def runtime_inputs_outputs(spark, sf):
    """Input and output values of one run."""
    return explore.run_values(bind(spark, sf).nodes, "run.1997")


@query("""SELECT e AS evidence_id, count(*) AS n_nodes FROM (
SELECT 'evidence:' || n_regionkey AS e FROM nation UNION ALL SELECT 'evidence:' || c_nationkey FROM customer
UNION ALL SELECT 'evidence:' || lower(c_mktsegment) FROM customer UNION ALL SELECT 'evidence:' || s_nationkey FROM supplier) x GROUP BY 1""")
def evidence_for_node(spark, sf):
    """How many nodes each evidence row supports."""
    g = bind(spark, sf)
    used = g.nodes.select(F.explode("evidence_ids").alias("evidence_id")).join(g.evidence.select(F.col("id").alias("evidence_id")), "evidence_id")
    return used.groupBy("evidence_id").agg(F.count("*").alias("n_nodes"))


@query("""WITH_GRAPH, s AS (SELECT id FROM node WHERE level = 'module' AND (parent = 'nation:1' OR id = 'nation:1') UNION SELECT 'order:' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 1)
SELECT kind, count(*) AS n, min(id) AS first_edge FROM edge WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s) GROUP BY kind""")
def edges_within_slice(spark, sf):
    """Edges among a nation, its modules and its customers' orders."""
    g = bind(spark, sf)
    inner = g.nodes.where("level = 'module'").where(F.array_contains("parent_ids", "nation:1") | (F.col("id") == "nation:1")).select("id")
    orders = g.nodes.where("identity_kind = 'value'").select("id", F.get("parent_ids", F.lit(0)).alias("p")).join(inner.select(F.col("id").alias("p")), "p", "left_semi").select("id")
    return traverse.induced(g.edges, inner.unionByName(orders)).groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("first_edge"))


@query("""WITH_GRAPH SELECT id, 'part:' || pk AS definition_id, CAST(row_number() OVER (PARTITION BY pk ORDER BY id) - 1 AS INT) AS occurrence_index FROM call""")
def occurrences_of_definition(spark, sf):
    """Numbered occurrences of every definition."""
    g = bind(spark, sf)
    definitions = g.nodes.where("identity_kind = 'definition'").select(F.col("id").alias("definition_id"))
    rows = g.nodes.where("identity_kind = 'occurrence'").select("id", "definition_id").join(definitions, "definition_id")
    # all calls as one run, in the order of their ids
    numbered = number_occurrences(rows.withColumn("seq", F.col("id")).withColumn("run_id", F.col("definition_id")))
    return numbered.select("id", "definition_id", "occurrence_index")


@query("""WITH_GRAPH SELECT DISTINCT 'part:' || pk AS definition_id, p_name AS label FROM call JOIN part ON p_partkey = pk WHERE run = 'run.1996'""")
def definitions_producing_in_run(spark, sf):
    """Definitions that occur in one run."""
    return explore.definitions_in_run(bind(spark, sf).nodes, "run.1996")


@query("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def next_edges(spark, sf):
    """The event before each event of a user."""
    return align.previous(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "previous")


_INTERVAL = "CAST(date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS BIGINT)"


@query(f"""WITH i AS (SELECT user_id AS grp, event_id AS id, {_INTERVAL} AS s, {_INTERVAL} + 3600 * (event_id % 50) AS e FROM events)
SELECT a.id, arg_max(b.id, (b.s, b.id)) AS parent FROM i a JOIN i b ON a.grp = b.grp AND b.s <= a.s AND a.e <= b.e AND a.id <> b.id AND (b.s < a.s OR a.e < b.e) GROUP BY a.id""")
def enclosing_call(spark, sf):
    """The innermost interval around each interval of a user."""
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', date_trunc('second', ts))")
    i = read(spark, sf, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("id"), start.alias("enter"), (start + 3600 * (F.col("event_id") % 50)).alias("leave"))
    return align.innermost(i, i)


@query("""SELECT event_id, CAST(row_number() OVER w AS INT) AS version, lag(event_id) OVER w AS derived_from FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def value_versions(spark, sf):
    """Versions of one object key and what each is derived from."""
    return align.versions(read(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id").select("event_id", "version", "derived_from")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS producer FROM events""")
def def_use_last_producer(spark, sf):
    """The latest purchase before each event of a user."""
    rows = read(spark, sf, "events").withColumn("made", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return align.last_producer(rows, ["user_id"], ["ts", "event_id"], "made").select("event_id", "producer")


@query("""WITH o AS (SELECT o_orderkey, o_custkey AS u, o_orderdate + INTERVAL 27 YEAR AS due FROM orders)
SELECT o_orderkey, arg_max(event_id, (ts, event_id)) AS producer FROM o JOIN events ON user_id = u AND ts <= due GROUP BY 1""")
def return_producer_asof(spark, sf):
    """The latest event of the customer at or before each order (shifted to the events' years), by union and window."""
    uses = read(spark, sf, "orders").select(F.col("o_custkey").alias("u"), F.expr("o_orderdate + interval 27 year").alias("at"), F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    made = read(spark, sf, "events").select(F.col("user_id").alias("u"), F.col("ts").alias("at"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    rows = made.unionByName(uses).withColumn("late", F.col("o_orderkey").isNotNull())
    found = align.last_producer(rows, ["u"], ["at", "late", "event_id", "o_orderkey"], "event_id")
    return found.where("o_orderkey is not null and producer is not null").select("o_orderkey", "producer")


@query("""WITH_GRAPH, cov AS (SELECT pk, count(DISTINCT run) AS n FROM call GROUP BY pk), r AS (SELECT count(DISTINCT run) AS n FROM node WHERE run IS NOT NULL)
SELECT 'part:' || p_partkey AS id, CAST(r.n AS BIGINT) AS n_considered, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_observed,
CASE WHEN coalesce(cov.n, 0) = 0 THEN 'static_reachable_unobserved' WHEN cov.n = r.n THEN 'always_observed' ELSE 'sometimes_observed' END AS status
FROM part LEFT JOIN cov ON pk = p_partkey CROSS JOIN r""")
def coverage_status(spark, sf):
    """Run coverage of every part."""
    g = bind(spark, sf)
    seen = g.nodes.where("identity_kind = 'occurrence'").select(F.col("definition_id").alias("id"), "run_id")
    return align.coverage_of(g.nodes.where("identity_kind = 'definition' and level = 'operation'").select("id"), seen, g.runs)


@query("""WITH_GRAPH SELECT 'part:' || p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT pk FROM call WHERE run = 'run.1996')""")
def coverage_unobserved(spark, sf):
    """Parts that don't occur in one run."""
    g = bind(spark, sf)
    seen = g.nodes.where("identity_kind = 'occurrence' and run_id = 'run.1996'").select(F.col("definition_id").alias("id"))
    return g.nodes.where("identity_kind = 'definition' and level = 'operation'").select("id").join(seen, "id", "left_anti")


@query("""SELECT 'part:' || p_partkey AS id FROM part WHERE p_partkey % 3 = 0 AND p_size > 25""")
def merge_collisions(spark, sf):
    """Ids whose payloads differ between two versions of the parts."""
    part = read(spark, sf, "part")
    old = part.select(_id("part", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_size").alias("size"))
    new = part.where("p_partkey % 3 = 0").select(_id("part", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.least(F.col("p_size"), F.lit(25)).alias("size"))
    return align.collisions(align.payload(old), align.payload(new))


@query("""SELECT id, label FROM (SELECT 'supplier:' || s_suppkey AS id, s_name AS label FROM supplier UNION SELECT 'supplier:' || s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0) x""")
def merge_dedupe(spark, sf):
    """Union by id of overlapping tables."""
    rows = read(spark, sf, "supplier").select(_id("supplier", "s_suppkey").alias("id"), F.col("s_name").alias("label"), "s_suppkey")
    return rows.drop("s_suppkey").unionByName(rows.where("s_suppkey % 2 = 0").drop("s_suppkey")).dropDuplicates(["id"])


@query("""WITH_GRAPH, n AS (SELECT id FROM node WHERE id NOT IN ('nation:3', 'part:7'))
SELECT rule, count(*) AS n, min(detail) AS first_detail FROM (
SELECT 'node_parent' AS rule, parent AS detail FROM node WHERE id IN (SELECT id FROM n) AND parent IS NOT NULL AND parent NOT IN (SELECT id FROM n)
UNION ALL SELECT 'node_definition', definition FROM node WHERE definition IS NOT NULL AND definition NOT IN (SELECT id FROM n)
UNION ALL SELECT 'edge_source', source FROM edge WHERE source NOT IN (SELECT id FROM n)
UNION ALL SELECT 'edge_target', target FROM edge WHERE target NOT IN (SELECT id FROM n)) x GROUP BY rule""")
def violations_dangling(spark, sf):
    """Dangling references after two nodes are taken out."""
    g = bind(spark, sf)
    g = g.with_tables(nodes=g.nodes.where(~F.col("id").isin("nation:3", "part:7")))
    return validate.reference_rules(g).groupBy("rule").agg(F.count("*").alias("n"), F.min("detail").alias("first_detail"))


@query("""SELECT 'duplicate_id' AS rule, 'event:' || event_id AS record_id, 'edges,nodes:2' AS detail FROM events WHERE event_id % 10 = 0""")
def violations_duplicate_ids(spark, sf):
    """Ids used by two collections."""
    e = read(spark, sf, "events")
    ids = e.select(F.lit("nodes").alias("collection"), _id("event", "event_id").alias("id")).unionByName(e.where("event_id % 10 = 0").select(F.lit("edges").alias("collection"), _id("event", "event_id").alias("id")))
    return validate.duplicate_ids(ids)


@query("""WITH_GRAPH, c AS (SELECT pk, list_distinct(list(run)) AS seen, ['run.1995', 'run.1996', 'run.1997', 'run.1998'] AS asked,
CASE pk % 3 WHEN 0 THEN 'always_observed' WHEN 1 THEN 'sometimes_observed' ELSE 'static_reachable_unobserved' END AS status FROM call GROUP BY pk), s AS (SELECT *, len(list_intersect(seen, asked)) AS n_both FROM c)
SELECT rule, count(*) AS n FROM (
SELECT 'coverage_observed_not_considered' AS rule FROM s WHERE n_both < len(seen)
UNION ALL SELECT 'coverage_always' FROM s WHERE status = 'always_observed' AND (n_both <> len(asked) OR n_both < len(seen))
UNION ALL SELECT 'coverage_sometimes' FROM s WHERE status = 'sometimes_observed' AND (len(seen) = 0 OR n_both = len(asked))
UNION ALL SELECT 'coverage_unobserved' FROM s WHERE status = 'static_reachable_unobserved' AND len(seen) > 0) x GROUP BY rule""")
def violations_coverage(spark, sf):
    """Coverage rules over made-up statuses."""
    seen = calls(spark, sf).groupBy("pk").agg(F.collect_set("run").alias("observed_run_ids"))
    status = F.when(F.col("pk") % 3 == 0, "always_observed").when(F.col("pk") % 3 == 1, "sometimes_observed").otherwise("static_reachable_unobserved")
    rows = seen.select(_id("part", "pk").alias("id"), status.alias("status"), F.array(*[F.lit(f"run.{y}") for y in range(1995, 1999)]).alias("considered_run_ids"), "observed_run_ids")
    return validate.coverage_rules(rows).groupBy("rule").agg(F.count("*").alias("n"))


@query("""WITH_GRAPH SELECT 'operation:' || replace(id, ':', '%3A') AS key, id, label, CAST(20 + CASE WHEN lower(label) = 'red widget' THEN 100 WHEN starts_with(lower(label), 'red widget') THEN 70 WHEN contains(lower(label), 'red widget') THEN 50 ELSE 0 END AS INT) AS score
FROM node WHERE id LIKE 'part:%' AND contains(lower(label), 'red') AND contains(lower(label), 'widget') ORDER BY score DESC, lower(label), key LIMIT 50""")
def search_ranked(spark, sf):
    """Ranked text search."""
    return explore.search(bind(spark, sf).nodes, "red widget")


@query("""WITH_GRAPH, r AS (SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY child) AS position, count(*) OVER (PARTITION BY parent) AS child_count FROM hier)
SELECT parent, child, CAST(position AS INT) AS position, child_count, child_count > 5 AS truncated FROM r WHERE position <= 5""")
def expand_children(spark, sf):
    """The first five children of every node."""
    return explore.expand(bind(spark, sf).hierarchy(), 5)


@query("""WITH_GRAPH, m AS (SELECT 'region:' || n_regionkey AS group_id, 'nation:' || n_nationkey AS member_id FROM nation UNION SELECT 'region:' || n_regionkey, 'customer:' || c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey)
SELECT group_id, member_id FROM m WHERE NOT EXISTS (SELECT 1 FROM hier h JOIN m p ON p.member_id = h.parent WHERE h.child = m.member_id AND p.group_id = m.group_id)""")
def top_members(spark, sf):
    """Members without a parent in their group."""
    g = bind(spark, sf)
    some = _members(spark, sf).where("member_id like 'customer:%'").select("group_id", "member_id")
    return explore.top_members(g.membership().unionByName(some).distinct(), g.hierarchy())


@query("""WITH_GRAPH, c(id, ancestor, depth) AS (SELECT 'customer:' || c_custkey, 'customer:' || c_custkey, 0 FROM customer UNION ALL SELECT c.id, h.parent, depth + 1 FROM c JOIN (SELECT child, min(parent) AS parent FROM hier GROUP BY child) h ON h.child = c.ancestor),
g AS (SELECT c.id, arg_min('region:' || n_regionkey, depth) AS crumb FROM c JOIN nation ON 'nation:' || n_nationkey = c.ancestor GROUP BY c.id)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS INT) AS position, crumb FROM (SELECT id, ancestor AS crumb, depth FROM c UNION ALL SELECT id, crumb, 1000000 FROM g) x""")
def breadcrumbs(spark, sf):
    """Group and ancestors of every customer, top first."""
    g = bind(spark, sf)
    return traverse.breadcrumbs(g.hierarchy(), g.membership(), g.nodes.where("id like 'customer:%'").select("id"))


_REACH = """WITH_GRAPH, r(id, depth) AS (SELECT '{seed}', 0 UNION SELECT {to}, depth + 1 FROM r JOIN edge ON {frm} = r.id AND kind IN ('data', 'consumes', 'produces'))
SELECT id, CAST(min(depth) AS INT) AS depth FROM r GROUP BY id"""


@query(_REACH.format(seed="customer:7", frm="source", to="target"))
def lineage_downstream(spark, sf):
    """Everything that flows from one customer."""
    g = bind(spark, sf)
    return traverse.reach(g.flow().select("src", "dst"), spark.createDataFrame([("customer:7",)], "id string"))


@query(_REACH.format(seed="supplier:3", frm="target", to="source"))
def lineage_upstream(spark, sf):
    """Everything that flows to one supplier."""
    g = bind(spark, sf)
    return traverse.reach(g.flow().select(F.col("dst").alias("src"), F.col("src").alias("dst")), spark.createDataFrame([("supplier:3",)], "id string"))


@query()
def lineage_bounded(spark, sf):
    """Ordered lineage of one customer cut at 60 nodes."""
    nodes, edges, truncated = traverse.bounded_lineage(bind(spark, sf).flow(), spark.createDataFrame([("customer:7",)], "id string"), 32, 60)
    rows = nodes.select(F.lit("node").alias("what"), "id").unionByName(edges.select(F.lit("edge").alias("what"), F.col("edge_id").alias("id")))
    return rows.withColumn("truncated", F.lit(truncated))


@query("""WITH_GRAPH, s AS (SELECT min('supplier:' || sk) AS target FROM call JOIN orders ON o_orderkey = ok WHERE o_custkey = 7), r(id, depth) AS (SELECT 'customer:7', 0 UNION SELECT target, depth + 1 FROM r JOIN edge ON source = r.id AND kind IN ('data', 'consumes', 'produces') WHERE depth < 8)
SELECT target, CAST(min(depth) AS BIGINT) AS n_edges FROM s JOIN r ON r.id = s.target GROUP BY target""")
def shortest_path(spark, sf):
    """Edges of the shortest path from a customer to one of its suppliers."""
    g = bind(spark, sf)
    target = calls(spark, sf).join(read(spark, sf, "orders").where("o_custkey = 7"), F.col("ok") == F.col("o_orderkey")).agg(F.min(_id("supplier", "sk")).alias("t")).first()["t"]
    path = traverse.shortest_path(g.flow().select("src", "dst"), "customer:7", target) if target else []
    return spark.createDataFrame([(target, len(path) - 1)] if path else [], "target string, n_edges long")


@query("""WITH_GRAPH, f AS (SELECT source AS a, target AS b FROM edge WHERE kind IN ('data', 'consumes', 'produces') UNION SELECT target, source FROM edge WHERE kind IN ('data', 'consumes', 'produces'))
SELECT id, CAST(min(d) AS INT) AS depth FROM (SELECT 'customer:7' AS id, 0 AS d UNION ALL SELECT b, 1 FROM f WHERE a = 'customer:7' UNION ALL SELECT y.b, 2 FROM f x JOIN f y ON y.a = x.b WHERE x.a = 'customer:7') z GROUP BY id""")
def khop_focus(spark, sf):
    """The two-step neighbourhood of one customer."""
    return traverse.khop(bind(spark, sf).flow().select("src", "dst"), spark.createDataFrame([("customer:7",)], "id string"), 2)


@query("""WITH_GRAPH, l(id, label) AS (SELECT 'customer:' || c_custkey, lower(c_mktsegment) FROM customer UNION SELECT target, label FROM l JOIN edge ON source = l.id AND kind IN ('data', 'consumes', 'produces'))
SELECT label, count(*) AS n FROM l WHERE id LIKE 'supplier:%' OR id LIKE 'call:%' GROUP BY label""")
def reachable_labels(spark, sf):
    """How many calls and suppliers each segment's label reaches."""
    g = bind(spark, sf)
    seeds = g.nodes.where("id like 'customer:%'").select("id", F.col("role").alias("label"))
    found = traverse.label_fixpoint(g.flow().select("src", "dst"), seeds)
    return found.where("id like 'supplier:%' or id like 'call:%'").groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH_GRAPH SELECT n.id, coalesce(p.id, n.id) AS anchor FROM node n LEFT JOIN node p ON p.id = n.parent AND p.level = 'module' WHERE n.id LIKE 'order:%'""")
def nearest_module(spark, sf):
    """The module above each order."""
    g = bind(spark, sf)
    return traverse.nearest_of_level(g.hierarchy(), g.nodes.where("level = 'module'").select("id", "level").unionByName(g.nodes.where("identity_kind = 'value'").select("id", "level"))).where("id like 'order:%'")


@query("""SELECT 'nation:' || n_nationkey AS anchor, CAST(1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS BIGINT) AS n_members FROM nation""")
def anchor_members(spark, sf):
    """How many nodes each nation contains."""
    from ..operators import semantics

    g = bind(spark, sf)
    contains = g.edges.where("kind = 'contains'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return semantics.anchor_members(contains, g.nodes.where("id like 'nation:%'").select("id")).groupBy("anchor").agg(F.count("*").alias("n_members"))


@query("""WITH_GRAPH SELECT group_id, count(*) AS n FROM (
SELECT 'nation:' || n_nationkey AS m, 'region:' || n_regionkey AS group_id FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'region:' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'supplier:' || s_suppkey, 'region:' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'order:' || o_orderkey, 'region:' || n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT id, 'region:' || n_regionkey FROM call JOIN supplier ON s_suppkey = sk JOIN nation ON n_nationkey = s_nationkey) x GROUP BY group_id""")
def transitive_membership(spark, sf):
    """Nodes under each region, through all levels."""
    g = bind(spark, sf)
    return traverse.first_group(g.membership(), g.hierarchy()).groupBy("group_id").agg(F.count("*").alias("n"))


@query("""WITH_GRAPH, r(id, rank) AS (SELECT 'customer:' || c_custkey, 0 FROM customer UNION SELECT target, rank + 1 FROM r JOIN edge ON source = r.id AND kind IN ('produces', 'consumes', 'data'))
SELECT rank, count(*) AS n FROM (SELECT n.id, coalesce(max(r.rank), 0)::INT AS rank FROM node n LEFT JOIN r ON r.id = n.id WHERE n.id NOT LIKE 'region:%' GROUP BY n.id) x GROUP BY rank""")
def layer_rank(spark, sf):
    """Longest-path layers of the flow."""
    g = bind(spark, sf)
    ranks = traverse.layer_ranks(g.flow().select("src", "dst"), g.mechanical().select("id"))
    return ranks.groupBy("rank").agg(F.count("*").alias("n"))


@query("""WITH_GRAPH SELECT split_part(id, ':', 1) AS family, count(*) AS n_keys, min(level || ':' || replace(id, ':', '%3A')) AS first_key, bool_and(id = replace(replace(id, ':', '%3A'), '%3A', ':')) AS round_trip FROM node GROUP BY 1""")
def key_encoding(spark, sf):
    """Encoded keys and their round trip, by family."""
    nodes = bind(spark, sf).nodes
    key = tx.node_key(F.col("level"), F.col("id"))
    return nodes.groupBy(F.substring_index("id", ":", 1).alias("family")).agg(F.count("*").alias("n_keys"), F.min(key).alias("first_key"), F.bool_and(tx.key_id(key) == F.col("id")).alias("round_trip"))


@query("""WITH_GRAPH SELECT (SELECT count(*) FROM node) AS n_nodes, (SELECT count(*) FROM node WHERE level = 'semantic') AS n_groups, (SELECT count(*) FROM node WHERE identity_kind = 'definition') AS n_definitions,
(SELECT count(*) FROM node WHERE identity_kind = 'occurrence') AS n_occurrences, (SELECT count(*) FROM node WHERE identity_kind = 'value') AS n_values, CAST(0 AS BIGINT) AS n_states, CAST(0 AS BIGINT) AS n_tensors,
(SELECT count(*) FROM edge) AS n_edges, (SELECT count(*) FROM edge WHERE kind IN ('data', 'produces', 'consumes')) AS n_flow, (SELECT count(*) FROM edge WHERE kind = 'contains') AS n_contains,
0.0::DOUBLE AS tensor_coverage, round((SELECT count(*) FROM node WHERE identity_kind = 'occurrence') / (SELECT count(*) FROM node WHERE identity_kind = 'definition'), 6) AS calls_per_definition""")
def graph_metrics(spark, sf):
    """One row of graph metrics."""
    return metrics.graph_metrics(bind(spark, sf))


@query("""WITH_GRAPH, m AS (SELECT id, kind FROM edge WHERE kind <> 'contains')
SELECT 'nodes' AS what, count(*) AS n FROM node UNION ALL SELECT 'edges', count(*) FROM m UNION ALL SELECT 'runs', count(DISTINCT run) FROM node WHERE run IS NOT NULL UNION ALL SELECT 'groups', count(*) FROM region""")
def project_stats(spark, sf):
    """Sizes of a project."""
    return metrics.project_stats(bind(spark, sf))
