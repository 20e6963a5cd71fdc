"""Star-schema tables bound to an evidence graph.

Regions are semantic groups of nations; nations, customers and suppliers are module
definitions, parts operation definitions; orders are values and distinct line items
occurrences of parts.  The same binding as SQL common tables is in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import SCHEMAS, EvidenceGraph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ok, pk, sk, run): one row a distinct line item."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.min(F.year("l_shipdate")).alias("y"))
    return lines.select(
        F.concat_ws(":", F.lit("call"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"),
        F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.concat(F.lit("run."), F.col("y").cast("string")).alias("run"),
    )


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def typed(df: DataFrame, name: str, given: dict) -> DataFrame:
    """All columns of a collection from the given ones (columns or texts); the others are null."""
    fields = StructType.fromDDL(SCHEMAS[name])
    return df.select(*[(F.lit(given.get(f.name)) if not isinstance(given.get(f.name), Column) else given[f.name]).cast(f.dataType).alias(f.name) for f in fields])


def bind(spark: SparkSession, sf_dir: str) -> EvidenceGraph:
    """The driver tables as one graph (lazy: each query reads the columns it needs)."""
    t = lambda name: read(spark, sf_dir, name)
    c = calls(spark, sf_dir)

    def part(df: DataFrame, node_id, level, kind, identity, label, role=None, parent=None, definition=None, run=None, evidence=None, attributes=None) -> DataFrame:
        given = {
            "id": node_id, "level": level, "kind": kind, "identity_kind": identity, "label": label, "role": role, "definition_id": definition, "run_id": run, "attributes_json": attributes,
            "parent_ids": F.array() if parent is None else F.array(parent), "evidence_ids": F.array() if evidence is None else F.array(*evidence), "source": F.array(),
        }
        return typed(df, "nodes", given)

    region_json = F.to_json(F.struct(((F.col("r_regionkey") + 5) / 10.0).alias("confidence"), F.when(F.col("r_regionkey") % 3 == 0, "training").when(F.col("r_regionkey") % 3 == 1, "inference").otherwise("both").alias("phase")))
    status = F.when(F.col("o_orderstatus") == "O", "input").when(F.col("o_orderstatus") == "F", "output").otherwise("tensor")
    nodes = (
        part(t("region"), _id("region", "r_regionkey"), "semantic", "semantic_component", "group", F.col("r_name"), F.lower("r_name"), attributes=region_json)
        .unionByName(part(t("nation"), _id("nation", "n_nationkey"), "module", "module", "definition", F.col("n_name"), evidence=[_id("evidence", "n_regionkey")]))
        .unionByName(part(t("customer"), _id("customer", "c_custkey"), "module", "module", "definition", F.col("c_name"), F.lower("c_mktsegment"), _id("nation", "c_nationkey"), evidence=[_id("evidence", "c_nationkey"), F.concat(F.lit("evidence:"), F.lower("c_mktsegment"))]))
        .unionByName(part(t("supplier"), _id("supplier", "s_suppkey"), "module", "module", "definition", F.col("s_name"), None, _id("nation", "s_nationkey"), evidence=[_id("evidence", "s_nationkey")]))
        .unionByName(part(t("part"), _id("part", "p_partkey"), "operation", "operation", "definition", F.col("p_name"), F.lower("p_type"), attributes=F.to_json(F.struct(F.col("p_brand").alias("brand")))))
        .unionByName(part(t("orders"), _id("order", "o_orderkey"), "operation", status, "value", F.col("o_orderpriority"), F.lower("o_orderstatus"), _id("customer", "o_custkey"), run=F.concat(F.lit("run."), F.year("o_orderdate").cast("string"))))
        .unionByName(part(c, F.col("id"), "operation", "operation", "occurrence", F.col("id"), None, _id("supplier", "sk"), _id("part", "pk"), F.col("run")))
    )

    def edge(df: DataFrame, kind: str, source, target) -> DataFrame:
        name = F.concat(F.lit(f"{kind}:"), source, F.lit(">"), target)
        return typed(df, "edges", {"id": name, "source": source, "target": target, "kind": kind, "evidence_ids": F.array()})

    ends = [
        edge(t("nation"), "contains", _id("region", "n_regionkey"), _id("nation", "n_nationkey")),
        edge(t("customer"), "contains", _id("nation", "c_nationkey"), _id("customer", "c_custkey")),
        edge(t("supplier"), "contains", _id("nation", "s_nationkey"), _id("supplier", "s_suppkey")),
        edge(t("orders"), "produces", _id("customer", "o_custkey"), _id("order", "o_orderkey")),
        edge(c, "consumes", _id("order", "ok"), F.col("id")),
        edge(c, "data", F.col("id"), _id("supplier", "sk")),
    ]
    edges = ends[0]
    for e in ends[1:]:
        edges = edges.unionByName(e)
    years = c.select(F.col("run").alias("id")).unionByName(t("orders").select(F.concat(F.lit("run."), F.year("o_orderdate").cast("string")).alias("id"))).distinct()
    keys = t("nation").select(_id("evidence", "n_nationkey").alias("id")).unionByName(t("customer").select(F.concat(F.lit("evidence:"), F.lower("c_mktsegment")).alias("id"))).distinct()
    evidence = typed(keys, "evidence", {"id": F.col("id"), "kind": "static", "status": "observed", "confidence": F.lit(1.0)})
    runs = typed(years, "runs", {"id": F.col("id")})
    return EvidenceGraph.of(spark, nodes=nodes, edges=edges, evidence=evidence, runs=runs)


#: The binding as SQL common tables: call, node and edge.
SQL = """
call AS (
  SELECT 'call:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id, l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk,
         'run.' || CAST(min(year(l_shipdate)) AS VARCHAR) AS run
  FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey),
node AS (
  SELECT 'region:' || r_regionkey AS id, 'semantic' AS level, 'semantic_component' AS kind, 'group' AS identity_kind, r_name AS label, lower(r_name) AS role, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS definition, CAST(NULL AS VARCHAR) AS run FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'module', 'module', 'definition', n_name, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'module', 'module', 'definition', c_name, lower(c_mktsegment), 'nation:' || c_nationkey, NULL, NULL FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'module', 'module', 'definition', s_name, NULL, 'nation:' || s_nationkey, NULL, NULL FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'operation', 'operation', 'definition', p_name, lower(p_type), NULL, NULL, NULL FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'operation', CASE o_orderstatus WHEN 'O' THEN 'input' WHEN 'F' THEN 'output' ELSE 'tensor' END, 'value', o_orderpriority, lower(o_orderstatus), 'customer:' || o_custkey, NULL, 'run.' || CAST(year(o_orderdate) AS VARCHAR) FROM orders
  UNION ALL SELECT id, 'operation', 'operation', 'occurrence', id, NULL, 'supplier:' || sk, 'part:' || pk, run FROM call),
edge AS (
  SELECT kind || ':' || source || '>' || target AS id, source, target, kind FROM (
    SELECT 'contains' AS kind, 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target FROM nation
    UNION ALL SELECT 'contains', 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
    UNION ALL SELECT 'contains', 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
    UNION ALL SELECT 'produces', 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
    UNION ALL SELECT 'consumes', 'order:' || ok, id FROM call
    UNION ALL SELECT 'data', id, 'supplier:' || sk FROM call) x),
hier AS (
  SELECT DISTINCT parent, child FROM (
    SELECT parent, id AS child FROM node WHERE parent IS NOT NULL
    UNION ALL SELECT source, target FROM edge WHERE kind = 'contains') x WHERE parent NOT LIKE 'region:%')
"""
