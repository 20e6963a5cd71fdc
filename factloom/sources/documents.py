"""Graph documents (one JSON a project) and Parquet tables of a graph."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import inferred_identity
from ..operators.validate import require_valid
from ..schema import SCHEMAS, EvidenceGraph

VERSION = "0.2"
#: Free-form fields of the documents and the JSON columns that hold them.
OPEN_FIELDS = {"attributes": "attributes_json", "metadata": "metadata_json", "value": "value_json", "conditions": "conditions_json"}


def _raw_schema(name: str) -> str:
    """Spark schema of a collection in a document: free-form fields as JSON text."""
    back = {v: k for k, v in OPEN_FIELDS.items()}
    fields = StructType.fromDDL(SCHEMAS[name])
    parts = []
    for f in fields:
        kind = f.dataType.simpleString()
        if name in ("nodes", "edges") and f.name == "tensor":
            kind = "struct<shape:array<string>,dtype:string,device:string,layout:string,requires_grad:boolean,semantics:array<string>>"
        if f.name == "scope":
            kind = "struct<run_ids:array<string>,conditions:string,tags:array<string>>"
        parts.append(f"`{back.get(f.name, f.name)}` {kind}")
    return ", ".join(parts)


def read_document(spark: SparkSession, path: str, lenient: bool = False, check: bool = False) -> EvidenceGraph:
    """Load JSON documents; older ones are migrated, unknown versions are errors unless ``lenient``.

    With ``check`` every integrity rule has to hold (ValueError with the first violations).

    The open fields are read as JSON text, so no schema is inferred from the data.
    """
    schema = "schema_version string, project struct<name:string,root:string,repository_url:string,revision:string,metadata:string>, " + ", ".join(
        f"{n} array<struct<{_raw_schema(n).replace('` ', '`:')}>>" for n in SCHEMAS if n != "projects"
    )
    docs = spark.read.option("multiLine", True).schema(schema).json(path)
    version = F.coalesce("schema_version", F.lit("0.1"))
    if not lenient:
        bad = docs.where(~version.isin("0.1", VERSION)).select(version.alias("v")).limit(1).collect()
        if bad:
            raise ValueError(f"unsupported document version: {bad[0]['v']}")
    tables = {n: _collection(docs, n) for n in SCHEMAS if n != "projects"}
    nodes = tables["nodes"]
    tables["nodes"] = nodes.withColumn("identity_kind", F.coalesce("identity_kind", inferred_identity(F.coalesce("kind", F.lit("other")), F.coalesce("level", F.lit("semantic")))))
    migrated = F.when(version == "0.1", F.lit(json.dumps({"schema_migrations": [{"from": "0.1", "to": VERSION}]}))).otherwise(F.col("project.metadata"))
    projects = docs.select("project.name", "project.root", "project.repository_url", "project.revision", migrated.alias("metadata_json"))
    graph = EvidenceGraph(projects=projects, **tables)
    if check:
        require_valid(graph)
    return graph


def _collection(docs: DataFrame, name: str) -> DataFrame:
    rows = docs.select(F.explode(name).alias("r"))
    back = {v: k for k, v in OPEN_FIELDS.items()}
    columns = []
    for f in StructType.fromDDL(SCHEMAS[name]):
        c = F.col(f"r.{back.get(f.name, f.name)}")
        if f.name == "tensor":
            shape = F.expr("transform(r.tensor.shape, s -> named_struct('size', try_cast(s as bigint), 'symbol', if(try_cast(s as bigint) is null, s, null)))")
            c = F.when(c.isNotNull(), F.struct(shape.alias("shape"), c["dtype"].alias("dtype"), c["device"].alias("device"), c["layout"].alias("layout"), c["requires_grad"].alias("requires_grad"), c["semantics"].alias("semantics")))
        elif f.name == "scope":
            c = F.when(c.isNotNull(), F.struct(c["run_ids"].alias("run_ids"), c["conditions"].alias("conditions_json"), c["tags"].alias("tags")))
        elif f.dataType.typeName() == "array":
            c = F.coalesce(c, F.array().cast(f.dataType))
        columns.append(c.alias(f.name))
    return rows.select(*columns)


def read_tables(spark: SparkSession, folder: str) -> EvidenceGraph:
    """A graph from Parquet tables, one folder a collection."""
    return EvidenceGraph(**{n: spark.read.schema(SCHEMAS[n]).parquet(f"{folder}/{n}") for n in SCHEMAS})


def write_tables(graph: EvidenceGraph, folder: str) -> None:
    """One Parquet folder a collection."""
    for n in SCHEMAS:
        getattr(graph, n).write.mode("overwrite").parquet(f"{folder}/{n}")


def _raw(name: str) -> list:
    """Columns of a collection as a document holds them: open fields and shapes as JSON values."""
    back = {v: k for k, v in OPEN_FIELDS.items()}
    out = []
    for f in StructType.fromDDL(SCHEMAS[name]):
        c = F.col(f.name)
        if f.name in back:
            c = F.try_parse_json(c)
        elif f.name == "tensor":
            symbol = lambda d: F.to_json(F.to_variant_object(F.array(d["symbol"])))
            each = F.transform(c["shape"], lambda d: F.coalesce(d["size"].cast("string"), F.substring(symbol(d), F.lit(2), F.length(symbol(d)) - 2)))
            sizes = F.try_parse_json(F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")))
            c = F.when(c.isNotNull(), F.struct(F.when(c["shape"].isNotNull(), sizes).alias("shape"), c["dtype"].alias("dtype"), c["device"].alias("device"), c["layout"].alias("layout"), c["requires_grad"].alias("requires_grad"), c["semantics"].alias("semantics")))
        elif f.name == "scope":
            c = F.when(c.isNotNull(), F.struct(c["run_ids"].alias("run_ids"), F.try_parse_json(c["conditions_json"]).alias("conditions"), c["tags"].alias("tags")))
        out.append(c.alias(back.get(f.name, f.name)))
    return out


def write_document(graph: EvidenceGraph, path: str) -> None:
    """One JSON document that ``read_document`` reads back: records by id, open fields as JSON values.

    A document is one text and so one task's work; graphs beyond that belong in tables
    (``write_tables``), which every operator reads as well.
    """
    lists = {n: getattr(graph, n).select("id", F.struct(*_raw(n)).alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.to_json("r").alias("r")))), lambda x: x["r"]).alias(n)) for n in SCHEMAS if n != "projects"}
    project = F.to_json(F.struct("name", "root", "repository_url", "revision", F.try_parse_json("metadata_json").alias("metadata")))
    one = graph.projects.limit(1).select(project.alias("p")).agg(F.coalesce(F.max("p"), F.lit("{}")).alias("project"))
    for df in lists.values():
        one = one.crossJoin(df)  # one row each
    parts = [F.lit(f'{{"schema_version":"{VERSION}","project":'), F.col("project")]
    for n in lists:
        parts += [F.lit(f',"{n}":['), F.array_join(n, ","), F.lit("]")]
    one.select(F.concat(*parts, F.lit("}")).alias("value")).write.mode("overwrite").text(path)
