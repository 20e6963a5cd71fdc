"""Table schemas, value domains and the graph container."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.stages import plain_unions

SPAN = "struct<path:string,start_line:int,end_line:int,start_column:int,end_column:int,symbol:string>"
TENSOR = "struct<shape:array<struct<size:bigint,symbol:string>>,dtype:string,device:string,layout:string,requires_grad:boolean,semantics:array<string>>"

#: Spark DDL of each collection.
SCHEMAS = {
    "nodes": f"id string, level string, kind string, identity_kind string, label string, role string, parent_ids array<string>, definition_id string, run_id string, occurrence_index int, source array<{SPAN}>, evidence_ids array<string>, tensor {TENSOR}, attributes_json string",
    "edges": f"id string, source string, target string, kind string, label string, evidence_ids array<string>, tensor {TENSOR}, attributes_json string",
    "evidence": f"id string, kind string, status string, confidence double, description string, source {SPAN}, run_id string, metadata_json string",
    "runs": "id string, entrypoint string, argv array<string>, config_paths array<string>, framework string, framework_version string, python_version string, metadata_json string",
    "claims": "id string, subject_id string, predicate string, object_id string, value_json string, evidence_ids array<string>, status string, confidence double, scope struct<run_ids:array<string>,conditions_json:string,tags:array<string>>, metadata_json string",
    "conflicts": "id string, claim_ids array<string>, kind string, status string, description string, resolution string, metadata_json string",
    "coverage": "id string, subject_id string, status string, considered_run_ids array<string>, observed_run_ids array<string>, evidence_ids array<string>, conditions_json string, metadata_json string",
    "projects": "name string, root string, repository_url string, revision string, metadata_json string",
}

#: Fixed value domains of the data model.
DOMAINS = {
    "level": ("paper", "semantic", "module", "operation", "source"),
    "node_kind": ("input", "output", "semantic_component", "module", "operation", "tensor", "parameter", "source", "config", "control", "dataset", "loss", "environment", "other"),
    "identity_kind": ("group", "definition", "occurrence", "value", "state", "source"),
    "edge_kind": ("data", "control", "contains", "calls", "implements", "instance_of", "produces", "consumes", "parameter", "gradient", "alias", "reads", "writes", "derived_from", "next"),
    "evidence_kind": ("runtime", "static", "source", "author", "semantic", "user", "imported"),
    "fact_status": ("observed", "inferred", "declared", "corrected", "unknown"),
    "coverage_status": ("always_observed", "sometimes_observed", "static_reachable_unobserved", "unreachable_under_configuration", "unresolved"),
    "conflict_kind": ("contradictory_claims", "author_implementation_mismatch", "static_runtime_mismatch", "coverage_mismatch", "other"),
    "conflict_status": ("open", "resolved", "accepted"),
}

#: Edge kinds that carry values, for lineage and for label propagation (fixed values).
LINEAGE_KINDS = ("data", "consumes", "produces", "derived_from", "alias", "next", "parameter")
PROPAGATION_KINDS = ("data", "produces", "consumes", "derived_from", "next")


def empty(spark: SparkSession, name: str) -> DataFrame:
    """An empty table of one collection."""
    return spark.createDataFrame([], SCHEMAS[name])


def table(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """A small table from dictionaries; missing fields are null, missing arrays empty."""
    from pyspark.sql.types import ArrayType, StructType

    schema = StructType.fromDDL(SCHEMAS[name])
    default = {f.name: [] if isinstance(f.dataType, ArrayType) else None for f in schema}
    return spark.createDataFrame([tuple((default | row)[f.name] for f in schema) for row in rows], schema)


@dataclass(frozen=True)
class EvidenceGraph:
    """The seven collections and the projects, as lazily evaluated DataFrames."""

    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame
    runs: DataFrame
    claims: DataFrame
    conflicts: DataFrame
    coverage: DataFrame
    projects: DataFrame

    def __post_init__(self) -> None:
        plain_unions(self.nodes.sparkSession)

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame | list[dict]) -> EvidenceGraph:
        """A graph from the given tables (DataFrames or rows); the others are empty."""
        found = {n: tables.get(n, []) for n in SCHEMAS}
        return cls(**{n: t if isinstance(t, DataFrame) else table(spark, n, t) for n, t in found.items()})

    def with_tables(self, **tables: DataFrame) -> EvidenceGraph:
        return replace(self, **tables)

    def collections(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in SCHEMAS if n != "projects"}

    def ids(self) -> DataFrame:
        """(collection, id) of every record."""
        out = None
        for name, df in self.collections().items():
            part = df.select(F.lit(name).alias("collection"), "id")
            out = part if out is None else out.unionByName(part)
        return out

    def mechanical(self) -> DataFrame:
        """Nodes that are neither semantic nor paper nodes."""
        return self.nodes.where(~F.col("level").isin("semantic", "paper"))

    def hierarchy(self) -> DataFrame:
        """Distinct (parent, child) of the mechanical tree: parent ids and contains edges whose parent is not semantic."""
        own = self.nodes.select(F.explode("parent_ids").alias("parent"), F.col("id").alias("child"))
        contains = self.edges.where("kind = 'contains'").select(F.col("source").alias("parent"), F.col("target").alias("child"))
        mechanical = self.mechanical().select(F.col("id").alias("parent"))
        return own.unionByName(contains).join(mechanical, "parent", "left_semi").distinct()

    def membership(self) -> DataFrame:
        """Distinct (group_id, member_id): contains edges of semantic nodes and listed members that exist."""
        semantic = self.nodes.where("level = 'semantic'")
        listed = semantic.select(F.col("id").alias("group_id"), F.explode(F.from_json(F.get_json_object("attributes_json", "$.member_ids"), "array<string>")).alias("member_id"))
        edges = self.edges.where("kind = 'contains'").select(F.col("source").alias("group_id"), F.col("target").alias("member_id"))
        edges = edges.join(semantic.select(F.col("id").alias("group_id")), "group_id", "left_semi")
        there = self.nodes.select(F.col("id").alias("member_id"))
        return edges.unionByName(listed).join(there, "member_id", "left_semi").select("group_id", "member_id").distinct()

    def flow(self, kinds: tuple[str, ...] = LINEAGE_KINDS) -> DataFrame:
        """(edge_id, src, dst, kind) of the value-carrying edges."""
        return self.edges.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("edge_id"), F.col("source").alias("src"), F.col("target").alias("dst"), "kind")
