"""Source repositories as tables: file scan and Python syntax index.

Files are read by Spark's ``binaryFile`` source and parsed one by one inside
``mapInPandas`` (a syntax tree has no relational form); everything after that
(resolution, flow, scores) is DataFrame work in ``operators.flows``.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import IGNORED_PARTS
from ..schema import EvidenceGraph

# Entry point names, frameworks, vendored folders, model bases.
ENTRY_NAMES = ("main.py", "train.py", "eval.py", "evaluate.py", "inference.py", "demo.py", "run.py", "app.py")
FRAMEWORKS = ("torch", "jax", "tensorflow")
VENDORED_PARTS = ("third_party", "third-party", "vendor", "vendors", "external", "externals", "deps", "dependencies")
MODEL_BASES = ("Module", "nn.Module", "torch.nn.Module", "LightningModule", "PreTrainedModel", "Model")


@dataclass(frozen=True)
class ScanPolicy:
    """What a scan leaves out."""

    include_vendored: bool = False
    include_nested: bool = False
    extra_ignored: tuple[str, ...] = ()


def scan(spark: SparkSession, root: str, pattern: str = "*.py", policy: ScanPolicy = ScanPolicy()) -> DataFrame:  # noqa: B008
    """(path, content) of the files under ``root``, paths relative to it, ignored and vendored folders left out."""
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    relative = F.regexp_replace("path", f"^(file:)?/*{root.lstrip('/')}/", "")
    parts = IGNORED_PARTS + policy.extra_ignored + (() if policy.include_vendored else VENDORED_PARTS)
    found = files.select(relative.alias("path"), "content").where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, parts))))
    if policy.include_nested:
        return found
    return drop_nested(found, nested_roots(spark, root))


def nested_roots(spark: SparkSession, root: str) -> DataFrame:
    """(nested): folders under ``root`` that hold a repository of their own."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    found, queue = [], [base]
    while queue:
        for status in fs.listStatus(queue.pop()):
            name = status.getPath().getName()
            if name == ".git":
                nested = status.getPath().getParent().toUri().getPath()
                if nested.rstrip("/") != base.toUri().getPath().rstrip("/"):
                    found.append((nested[len(base.toUri().getPath().rstrip("/")) + 1 :],))
            elif status.isDirectory() and name not in IGNORED_PARTS:
                queue.append(status.getPath())
    return spark.createDataFrame(found, "nested string")


def drop_nested(files: DataFrame, nested: DataFrame) -> DataFrame:
    """Files outside all nested folders: every prefix of a path is looked up, so the join is an equi join."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    inside = files.select("path", F.explode(prefixes).alias("nested")).join(nested, "nested", "left_semi").select("path").distinct()
    return files.join(inside, "path", "left_anti")


def dotted(node: ast.AST) -> str:
    """Source form of a callee: names and attributes, ``super`` calls, else ``<dynamic>``."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{dotted(node.value)}.{node.attr}"
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "super":
        return "super"
    return "<dynamic>"


def names_in(target: ast.AST) -> list[str]:
    """Names bound by an assignment target."""
    if isinstance(target, ast.Name):
        return [target.id]
    if isinstance(target, (ast.Tuple, ast.List)):
        return [n for t in target.elts for n in names_in(t)]
    return names_in(target.value) if isinstance(target, ast.Starred) else []


class FileIndex(ast.NodeVisitor):
    """Tagged rows (kind, record) of one file."""

    def __init__(self, path: str, module: str) -> None:
        self.path, self.module = path, module
        self.scope: list[tuple[str, str]] = []
        self.targets: list[str] = []
        self.rows: list[tuple[str, dict]] = []
        self.order = 0

    def emit(self, kind: str, /, **record) -> None:
        self.rows.append((kind, record))

    @property
    def qualname(self) -> str:
        return ".".join(n for n, _ in self.scope)

    def symbol(self) -> str:
        return f"{self.path}::{self.qualname}"

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.emit("import", module=self.module, local=a.asname or a.name.split(".")[0], target=a.name if a.asname else a.name.split(".")[0], ordinal=node.lineno)
            if a.name.split(".")[0] in FRAMEWORKS:
                self.emit("framework")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = node.module or ""
        if node.level:
            keep = self.module.split(".")[: -node.level] if not self.path.endswith("__init__.py") else self.module.split(".")[: len(self.module.split(".")) - node.level + 1]
            base = ".".join([*keep, base]).strip(".")
        for a in node.names:
            self.emit("import", module=self.module, local=a.asname or a.name, target=f"{base}.{a.name}", ordinal=node.lineno)
        if base.split(".")[0] in FRAMEWORKS:
            self.emit("framework")

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.scope.append((node.name, "class"))
        bases = [dotted(b) for b in node.bases]
        model = any(b in MODEL_BASES or "Module" in b or "Model" in b for b in bases)
        self.emit("symbol", id=self.symbol(), name=f"{self.module}.{self.qualname}", kind="class", line=node.lineno, end=node.end_lineno, model=model, ordinal=node.lineno)
        for i, b in enumerate(bases):
            self.emit("base", cls=f"{self.module}.{node.name}", base=b, ord=i)
        for child in node.body:
            self.visit(child)
        self.scope.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        owner = self.scope[-1] if self.scope else None
        method = owner is not None and owner[1] == "class"
        self.scope.append((node.name, "method" if method else "function"))
        me = self.symbol()
        self.emit("symbol", id=me, name=f"{self.module}.{self.qualname}", kind=self.scope[-1][1], line=node.lineno, end=node.end_lineno, model=False, ordinal=node.lineno)
        if method:
            self.emit("method", cls=f"{self.module}.{owner[0]}", method=node.name)
        for d in node.decorator_list:
            if "hydra" in ast.unparse(d):
                self.emit("reason", points=4, reason="hydra entry point")
        a = node.args
        formals = [x.arg for x in [*a.posonlyargs, *a.args]]
        if method and formals and formals[0] in ("self", "cls"):
            formals = formals[1:]
        formals += [x.arg for x in ([a.vararg] if a.vararg else []) + a.kwonlyargs + ([a.kwarg] if a.kwarg else [])]
        for i, f in enumerate(formals):
            self.emit("param", symbol=me, pos=i, formal=f)
        for child in node.body:
            self.visit(child)
        self.scope.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Assign(self, node: ast.Assign) -> None:
        before, self.targets = self.targets, [n for t in node.targets for n in names_in(t)]
        self.visit(node.value)
        self.targets = before

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        before, self.targets = self.targets, names_in(node.target)
        if node.value is not None:
            self.visit(node.value)
        self.targets = before

    def visit_Return(self, node: ast.Return) -> None:
        if self.scope and isinstance(node.value, ast.Name):
            self.emit("return", symbol=self.symbol(), name=node.value.id, line=node.lineno, col=0)
        elif self.scope and isinstance(node.value, ast.Call):
            self.emit("return", symbol=self.symbol(), name=None, line=node.value.lineno, col=node.value.col_offset)
        if node.value is not None:
            self.visit(node.value)

    def visit_If(self, node: ast.If) -> None:
        if isinstance(node.test, ast.Compare) and "__name__" in ast.unparse(node.test) and "__main__" in ast.unparse(node.test):
            self.emit("reason", points=6, reason="main guard")
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        callee = dotted(node.func)
        args = [x.id for x in node.args if isinstance(x, ast.Name)]
        named = [(k.arg, k.value.id) for k in node.keywords if k.arg and isinstance(k.value, ast.Name)]
        call = f"{self.path}:{node.lineno}:{node.col_offset}:{self.order}"
        kinds = [k for _, k in self.scope]
        cls = f"{self.module}.{self.scope[-2][0]}" if kinds and kinds[-1] == "method" else None
        self.emit(
            "call", id=call, path=self.path, module=self.module, caller=self.symbol() if self.scope else f"{self.path}::", caller_class=cls, callee=callee, line=node.lineno, col=node.col_offset, ord=self.order,
            args=[*args, *(v for _, v in named)], targets=self.targets,
        )
        self.order += 1
        for i, x in enumerate(node.args):
            if isinstance(x, ast.Name):
                self.emit("binding", call_id=call, pos=i, formal=None, actual=x.id)
        for k, v in named:
            self.emit("binding", call_id=call, pos=None, formal=k, actual=v)
        if callee.endswith(".add_argument"):
            self.emit("reason", points=1, reason="argument parser")
        if callee.split(".")[-1] in ("load", "safe_load", "read_text", "open") and node.args:
            fixed = node.args[0].value if isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str) else None
            self.emit("reference", id=call, kind="load", path=fixed, name=None, dynamic=fixed is None)
        before, self.targets = self.targets, []
        for x in [*node.args, *(k.value for k in node.keywords)]:
            self.visit(x)
        self.targets = before


def index_file(path: str, content: bytes) -> list[tuple[str, dict]]:
    """Tagged rows of one Python file; a syntax error is a row of its own."""
    module = path.removesuffix(".py").replace("/", ".").removesuffix(".__init__")
    index = FileIndex(path, module)
    name = path.rsplit("/", 1)[-1].lower()
    if name in ENTRY_NAMES:
        index.emit("reason", points=4, reason=f"entry point name: {name}")
    try:
        index.visit(ast.parse(bytes(content).decode("utf-8", "replace")))
    except (SyntaxError, ValueError) as e:
        index.emit("error", message=str(getattr(e, "msg", e)), line=getattr(e, "lineno", None))
    if any(k == "framework" for k, _ in index.rows):
        index.emit("reason", points=1, reason="framework import")
    return [r for r in index.rows if r[0] != "framework"]


RECORDS = {
    "symbol": "struct<id:string,name:string,kind:string,line:int,end:int,model:boolean,ordinal:int>",
    "import": "struct<module:string,local:string,target:string,ordinal:int>",
    "base": "struct<cls:string,base:string,ord:int>",
    "method": "struct<cls:string,method:string>",
    "param": "struct<symbol:string,pos:int,formal:string>",
    "return": "struct<symbol:string,name:string,line:int,col:int>",
    "call": "struct<id:string,path:string,module:string,caller:string,caller_class:string,callee:string,line:int,col:int,ord:int,args:array<string>,targets:array<string>>",
    "binding": "struct<call_id:string,pos:int,formal:string,actual:string>",
    "reference": "struct<id:string,kind:string,path:string,name:string,dynamic:boolean>",
    "reason": "struct<points:int,reason:string>",
    "error": "struct<message:string,line:int>",
}


def index_repository(files: DataFrame) -> dict[str, DataFrame]:
    """Tables of an index (one a record kind, each with ``file``) from (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, k, json.dumps(r)) for p, c in zip(pdf["path"], pdf["content"], strict=True) for k, r in index_file(p, c)]
            yield pd.DataFrame(rows, columns=["file", "kind", "record"])

    tagged = files.mapInPandas(run, "file string, kind string, record string")
    out = {k: tagged.where(F.col("kind") == k).select("file", F.from_json("record", s).alias("r")).select("file", "r.*") for k, s in RECORDS.items()}
    # bases are spelled in the file: a local class or an import gives the full name
    bound = out["import"].groupBy("file", "local").agg(F.max_by("target", "ordinal").alias("target"))
    module = F.regexp_replace("cls", r"\.[^.]+$", "")
    head, rest = F.substring_index("base", ".", 1), F.expr("substring(base, length(substring_index(base, '.', 1)) + 1)")
    bases = out["base"].withColumns({"local": head, "rest": rest}).join(bound, ["file", "local"], "left")
    out["base"] = bases.select("file", "cls", F.coalesce(F.concat("target", "rest"), F.concat(module, F.lit("."), "base")).alias("base"), "ord")
    return out


def entry_reasons(index: dict[str, DataFrame]) -> DataFrame:
    """(path, points, reason) of an index."""
    return index["reason"].select(F.col("file").alias("path"), "points", "reason")


def context_documents(files: DataFrame) -> DataFrame:
    """(path, text, rank key) of readmes first, then documentation folders."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    folders = F.transform(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), lambda p: F.lower(p))
    readme = F.startswith(name, F.lit("readme"))
    found = files.where(readme | F.arrays_overlap(folders, F.array(F.lit("doc"), F.lit("docs"), F.lit("documentation"))))
    return found.select("path", F.col("content").cast("string").alias("text"), F.when(readme, 0).otherwise(1).alias("tier"))


def referenced_paths(graph: EvidenceGraph) -> DataFrame:
    """(path): the distinct paths of node and evidence spans."""
    spans = graph.nodes.select(F.explode("source").alias("s")).unionByName(graph.evidence.where("source is not null").select(F.col("source").alias("s")))
    return spans.select("s.path").where("path is not null").distinct()


def bundle(paths: DataFrame, files: DataFrame, max_file: int = 256_000, max_total: int = 5_000_000) -> DataFrame:
    """(path, outcome, bytes): which referenced files a bounded bundle holds; a skipped file uses nothing.

    ``files`` has (path, size, utf8) of the files under the root; paths that are absolute
    or climb out are outside.  What a path can tell alone is decided where it is; only
    files that may be taken run, sorted, through one stream that keeps one number.
    """
    if max_file < 1 or max_total < 1:
        raise ValueError("limits must be positive")
    outside = F.startswith("path", F.lit("/")) | F.contains(F.concat(F.lit("/"), "path", F.lit("/")), F.lit("/../"))
    known = paths.select("path").distinct().join(files.select("path", "size", "utf8"), "path", "left")
    alone = F.when(outside, "outside_source_root").when(F.col("size").isNull(), "missing").when(F.col("size") > max_file, "file_too_large")
    marked = known.withColumn("outcome", alone)

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room = max_total
        for pdf in batches:
            found = []
            for size, text in zip(pdf["bytes"].tolist(), pdf["utf8"].tolist(), strict=True):
                fits = size <= room
                found.append("embedded" if fits and text else "not_utf8_text" if fits else "total_limit")
                room -= size if fits and text else 0
            yield pdf[["path"]].assign(outcome=found, bytes=pdf["bytes"])

    open_ = marked.where("outcome is null").select("path", F.col("size").cast("long").alias("bytes"), "utf8").repartition(1).sortWithinPartitions("path")
    done = marked.where("outcome is not null").select("path", "outcome", F.col("size").cast("long").alias("bytes"))
    return done.unionByName(open_.mapInPandas(take, "path string, outcome string, bytes long"))
