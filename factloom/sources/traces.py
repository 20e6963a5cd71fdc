"""Raw execution traces (JSON) as graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import SPAN, EvidenceGraph
from .tables import typed

_SPAN = SPAN
RAW = f"""run struct<id:string,framework:string,python_version:string,backend:string>,
definitions array<struct<id:string,key:string,label:string,role:string,boundary:string,source:{_SPAN},evidence_ids:array<string>,external:boolean,stubbed:boolean>>,
occurrences array<struct<id:string,definition_id:string,label:string,role:string,boundary:string,run_id:string,occurrence_index:int,parent_ids:array<string>,source:{_SPAN},evidence_ids:array<string>,status:string,attributes:string>>,
values array<struct<id:string,label:string,role:string,run_id:string,evidence_ids:array<string>,structure:string>>,
edges array<struct<id:string,source:string,target:string,kind:string,evidence_ids:array<string>>>,
evidence array<struct<id:string,status:string,description:string,source:{_SPAN},run_id:string,metadata:string>>"""


def read_trace(spark: SparkSession, path: str) -> EvidenceGraph:
    """Definitions, occurrences, values, edges and evidence of raw traces."""
    raw = spark.read.option("multiLine", True).schema(RAW).json(path)
    each = lambda name: raw.select(F.explode(name).alias("r")).select("r.*")
    spans = lambda: F.when(F.col("source").isNotNull(), F.array("source")).otherwise(F.array().cast(f"array<{SPAN}>"))
    blank = F.array().cast("array<string>")
    d, o, v = each("definitions"), each("occurrences"), each("values")
    nodes = (
        typed(d, "nodes", {"id": F.col("id"), "level": "operation", "kind": "operation", "identity_kind": "definition", "label": F.col("label"), "role": F.col("role"), "parent_ids": blank, "source": spans(), "evidence_ids": F.coalesce("evidence_ids", blank), "attributes_json": F.to_json(F.struct("boundary", "external", "stubbed"))})
        .unionByName(typed(o, "nodes", {"id": F.col("id"), "level": "operation", "kind": "operation", "identity_kind": "occurrence", "label": F.col("label"), "role": F.col("role"), "parent_ids": F.coalesce("parent_ids", blank), "definition_id": F.col("definition_id"), "run_id": F.col("run_id"), "occurrence_index": F.col("occurrence_index"), "source": spans(), "evidence_ids": F.coalesce("evidence_ids", blank), "attributes_json": F.to_json(F.struct("boundary", "status", "attributes"))}))
        .unionByName(typed(v, "nodes", {"id": F.col("id"), "level": "operation", "kind": "tensor", "identity_kind": "value", "label": F.col("label"), "role": F.col("role"), "parent_ids": blank, "run_id": F.col("run_id"), "source": F.array(), "evidence_ids": F.coalesce("evidence_ids", blank), "attributes_json": F.col("structure")}))
    )
    e = each("edges")
    edges = typed(e, "edges", {c: F.col(c) for c in ("id", "source", "target", "kind")} | {"evidence_ids": F.coalesce("evidence_ids", blank)})
    x = each("evidence")
    evidence = typed(x, "evidence", {"id": F.col("id"), "kind": "runtime", "status": F.col("status"), "confidence": F.lit(1.0), "description": F.col("description"), "source": F.col("source"), "run_id": F.col("run_id"), "metadata_json": F.col("metadata")})
    runs = typed(raw.select("run.*").distinct(), "runs", {"id": F.col("id"), "framework": F.col("framework"), "python_version": F.col("python_version"), "metadata_json": F.to_json(F.struct("backend"))})
    return EvidenceGraph.of(spark, nodes=nodes, edges=edges, evidence=evidence, runs=runs)


def number_occurrences(events: DataFrame) -> DataFrame:
    """Adds ``occurrence_index`` of each definition of a run and ``previous`` of the run, by ``seq``."""
    own, run = Window.partitionBy("run_id", "definition_id").orderBy("seq"), Window.partitionBy("run_id").orderBy("seq")
    return events.withColumns({"occurrence_index": F.row_number().over(own) - 1, "previous": F.lag("id").over(run)})


def shared_definitions(objects: DataFrame) -> DataFrame:
    """(object_id, canonical, aliases): one definition an object, named by its smallest alias."""
    return objects.groupBy("object_id").agg(F.min("alias").alias("canonical"), F.sort_array(F.collect_set("alias")).alias("aliases"))


def conflicting_probes(probes: DataFrame) -> DataFrame:
    """Keys (key, payload) that are declared with more than one payload."""
    return probes.groupBy("key").agg(F.count_distinct("payload").alias("n")).where("n > 1").select("key")


