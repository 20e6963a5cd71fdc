"""Benchmark manifests, run specifications, repository facts and resource fingerprints."""

from __future__ import annotations

import json
import subprocess
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "id string, repository string, revision string, branch string, tier string, modes array<string>, tags array<string>, notes string, runtime_spec string, runtime_environment string, system_spec string"
VALUE = "struct<kind:string,shape:array<bigint>,dtype:string,generator:string,requires_grad:boolean>"
RUNTIME_SPEC = f"schema_version string, framework string, import_root string, module string, symbol string, constructor_kwargs string, args array<{VALUE}>, kwargs string, required_imports array<string>, seed long, eval_mode boolean, no_grad boolean, capture_operators boolean, expected_output_shapes array<array<bigint>>"
ENVIRONMENT_SPEC = "schema_version string, python string, packages array<struct<distribution:string,version:string>>, overlays array<struct<repository_path:string,module:string,require_private_copy:boolean>>"
SYSTEM_SPEC = "schema_version string, framework string, scenario string, python_paths array<string>, probes array<struct<module:string,symbol:string,role:string,boundary:string>>, required_imports array<string>, resources array<struct<path:string,kind:string,sha256:string>>"
SPECS = {"runtime": RUNTIME_SPEC, "environment": ENVIRONMENT_SPEC, "system": SYSTEM_SPEC}
#: Fixed defaults of left-out fields.
DEFAULTS = {
    "runtime": {"schema_version": "1", "framework": "pytorch", "import_root": ".", "seed": 7, "eval_mode": True, "no_grad": True, "capture_operators": True},
    "environment": {"schema_version": "1"},
    "system": {"schema_version": "1", "framework": "python"},
}


def _text(spark: SparkSession, path: str) -> str:
    """A small text file, read through Spark from any store."""
    return spark.read.text(path, wholetext=True).first()["value"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a TOML manifest (tables named ``case``); a case needs id, repository and a revision of 7 characters."""
    found = tomllib.loads(_text(spark, path)).get("case", [])
    for c in found:
        if not c.get("id") or not c.get("repository") or len(c.get("revision", "")) < 7:
            raise ValueError(f"incomplete case: {c}")
    names = [f.split()[0] for f in CASE.split(", ")]
    blank = {"tier": "research", "modes": ["static"], "tags": []}
    return spark.createDataFrame([tuple((blank | c).get(n) for n in names) for c in found], CASE)


def case(manifest: DataFrame, case_id: str) -> DataFrame:
    """The one case of an id; KeyError if there is none or more than one."""
    found = manifest.where(F.col("id") == case_id)
    if len(found.limit(2).collect()) != 1:
        raise KeyError(f"benchmark case {case_id!r} not found uniquely")
    return found


def read_spec(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row of a specification (runtime, environment or system) with its defaults filled in."""
    spec = spark.read.option("multiLine", True).schema(SPECS[kind]).json(path)
    return spec.select(*[F.coalesce(F.col(f), F.lit(DEFAULTS[kind][f])).alias(f) if f in DEFAULTS[kind] else F.col(f) for f in spec.columns])


def git_facts(spark: SparkSession, root: str) -> DataFrame:
    """(revision, dirty, submodules (path, materialized)) of a checkout on the driver; nulls where it is none."""

    def git(*arguments: str) -> str | None:
        done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, check=False)
        return done.stdout if done.returncode == 0 else None

    revision, status, modules = git("rev-parse", "HEAD"), git("status", "--porcelain"), git("submodule", "status")
    # a module that was never fetched is marked by a minus
    listed = [(line[1:].split()[1], line[0] != "-") for line in (modules or "").splitlines() if len(line[1:].split()) > 1]
    return spark.createDataFrame([(revision.strip() if revision else None, None if status is None else bool(status.strip()), listed)], "revision string, dirty boolean, submodules array<struct<path:string,materialized:boolean>>")


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, size_bytes) of all files under a folder, read by the executors; paths are relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = folder.rstrip("/").split("://")[-1].split("file:")[-1]
    relative = F.expr(f"substring(path, instr(path, {json.dumps(base + '/')}) + {len(base) + 1})")
    return files.select(relative.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def verified(resources: DataFrame, files: DataFrame) -> DataFrame:
    """(path, sha256, size_bytes, status) of wanted files (path, sha256 or null): ok, missing, escapes or mismatch."""
    found = resources.select("path", F.col("sha256").alias("wanted")).join(files, "path", "left")
    escapes = F.startswith("path", F.lit("/")) | F.contains(F.concat(F.lit("/"), "path", F.lit("/")), F.lit("/../"))
    status = F.when(escapes, "escapes").when(F.col("size_bytes").isNull(), "missing").when(F.col("wanted").isNotNull() & (F.col("wanted") != F.col("sha256")), "mismatch").otherwise("ok")
    return found.select("path", F.when(F.col("wanted").isNotNull(), F.col("sha256")).alias("sha256"), "size_bytes", status.alias("status"))


def tensor_shapes(value: object) -> list[list[int]]:
    """Shapes of all tensors of a described value (an object with ``shape`` is one), keys in order, depth first."""
    found, todo = [], [value]
    while todo:
        now = todo.pop()
        if isinstance(now, dict) and "shape" in now:
            found.append([int(n) for n in now["shape"]])
        elif isinstance(now, dict):
            todo += [now[k] for k in sorted(now, key=str, reverse=True)]
        elif isinstance(now, list | tuple):
            todo += reversed(now)
    return found


#: Fixed bounds of a value's summary: depth, keys, items, characters.
DEPTH, KEYS, ITEMS, CHARS = 2, 20, 10, 128


def summary(value: object, depth: int = 0) -> dict:
    """A bounded description of a JSON value: type, and value, length, keys or items where they fit the bounds."""
    kind = type(value).__name__
    match value:
        case None | bool() | int() | float():
            return {"type": kind, "value": value}
        case str():
            return {"type": kind, "value": value[:CHARS], "length": len(value)}
        case dict() if depth < DEPTH:
            some = list(value)
            return {"type": kind, "length": len(value), "keys": some[:50], "items": {k: summary(value[k], depth + 1) for k in some[:KEYS]}}
        case list() | tuple() if depth < DEPTH:
            return {"type": kind, "length": len(value), "items": [summary(v, depth + 1) for v in value[:ITEMS]]}
    return {"type": kind}
