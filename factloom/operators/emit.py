"""A repository index as graph tables, and the smaller joins around captured graphs."""

from __future__ import annotations

from urllib.parse import parse_qs, urlencode

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..schema import DOMAINS, SPAN, EvidenceGraph
from ..sources.tables import typed
from . import flows


def _span(path, start, end, symbol):
    none = F.lit(None)
    return F.array(F.struct(path.alias("path"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), none.cast("int").alias("start_column"), none.cast("int").alias("end_column"), symbol.cast("string").alias("symbol"))).cast(f"array<{SPAN}>")


def static_graph(index: dict[str, DataFrame], entries: DataFrame | None = None) -> EvidenceGraph:
    """Symbols, calls, value flow and configuration reads of an index as nodes, edges and evidence.

    Classes are modules, other symbols source nodes, calls operation definitions.  A call's
    evidence has confidence 1.0 if the callee is resolved and 0.7 if not; flow across calls 0.9.
    ``entries`` are configuration entries (path, key, value_json).
    """
    spark = index["symbol"].sparkSession
    calls = flows.resolve_calls(index["call"], index["symbol"], index["import"], index["base"], index["method"])
    cls = F.col("kind") == "class"
    qualname = F.split_part("id", F.lit("::"), F.lit(2))
    symbols = typed(index["symbol"], "nodes", {
        "id": F.col("id"), "level": F.when(cls, "module").otherwise("source"), "kind": F.when(cls, "module").otherwise("other"), "identity_kind": "definition", "label": tx.tail(qualname),
        "role": F.concat(F.lit("python_"), "kind", F.lit("_definition")), "parent_ids": F.array(), "evidence_ids": F.array(F.concat(F.lit("evidence:"), "id")),
        "source": _span(F.col("file"), F.col("line"), F.col("end"), qualname), "attributes_json": F.to_json(F.struct(F.col("name").alias("qualname"))),
    })
    sites = typed(calls, "nodes", {
        "id": F.concat(F.lit("call:"), "id"), "level": "operation", "kind": "operation", "identity_kind": "definition", "label": F.col("callee"), "role": "python_call_site", "parent_ids": F.array(),
        "evidence_ids": F.array(F.concat(F.lit("evidence:call:"), "id")), "source": _span(F.col("path"), F.col("line"), F.col("line"), F.col("callee")),
        "attributes_json": F.to_json(F.struct("resolution", F.col("target").alias("resolved_target"), F.col("targets").alias("result_targets"), F.col("args").alias("argument_names"))),
    })
    nodes = symbols.unionByName(sites)
    evidence = typed(index["symbol"], "evidence", {"id": F.concat(F.lit("evidence:"), "id"), "kind": "static", "status": "observed", "confidence": F.lit(1.0)}).unionByName(
        typed(calls, "evidence", {"id": F.concat(F.lit("evidence:call:"), "id"), "kind": "static", "status": "observed", "confidence": F.when(F.col("resolution") == "dynamic", 0.7).otherwise(1.0)})
    )

    def edges(df: DataFrame, kind: str, source, target, label=None, evidence_ids=None) -> DataFrame:
        name = F.concat_ws(">", F.lit(kind), source, target, *([label] if label is not None else []))
        return typed(df, "edges", {"id": name, "source": source, "target": target, "kind": kind, "label": label, "evidence_ids": F.array() if evidence_ids is None else evidence_ids})

    site = lambda c: F.concat(F.lit("call:"), F.col(c))
    parent = F.concat(F.split_part("id", F.lit("::"), F.lit(1)), F.lit("::"), F.regexp_replace(qualname, r"\.?[^.]+$", ""))
    nested = index["symbol"].withColumn("parent", parent).join(index["symbol"].select(F.col("id").alias("parent")), "parent", "left_semi")
    inside = calls.join(index["symbol"].select(F.col("id").alias("caller")), "caller", "left_semi")
    local = calls.where("symbol_id is not null")
    own = flows.def_use(index["call"])
    across = flows.argument_flow(calls, index["param"], index["binding"]).unionByName(flows.return_flow(calls, index["return"])).distinct()
    across_id = F.concat_ws(">", F.lit("evidence:flow"), "producer", "consumer", "variable")
    out = (
        edges(nested, "contains", F.col("parent"), F.col("id"))
        .unionByName(edges(inside, "contains", F.col("caller"), site("id")))
        .unionByName(edges(local, "calls", site("id"), F.col("symbol_id")))
        .unionByName(edges(own, "data", site("producer"), site("consumer"), F.col("variable")))
        .unionByName(edges(across.join(own, ["producer", "consumer", "variable"], "left_anti"), "data", site("producer"), site("consumer"), F.col("variable"), F.array(across_id)))
    )
    evidence = evidence.unionByName(typed(across.join(own, ["producer", "consumer", "variable"], "left_anti"), "evidence", {"id": across_id, "kind": "static", "status": "inferred", "confidence": F.lit(0.9)}))
    if entries is not None:
        entry_id = F.concat(F.lit("config:"), "path", F.lit("#"), "key")
        nodes = nodes.unionByName(typed(entries, "nodes", {"id": entry_id, "level": "source", "kind": "config", "identity_kind": "state", "label": F.col("key"), "parent_ids": F.array(), "evidence_ids": F.array(), "source": F.array(), "attributes_json": F.to_json(F.struct("value_json"))}))
        read = flows.resolve_configs(index["reference"].drop("file"), entries.select(entry_id.alias("entry_id"), "path"))
        out = out.unionByName(edges(read.select("id", F.explode("entry_ids").alias("entry")), "reads", site("id"), F.col("entry")))
    return EvidenceGraph.of(spark, nodes=nodes, edges=out, evidence=evidence)


def file_graph(index: dict[str, DataFrame], files: DataFrame, scores: DataFrame) -> EvidenceGraph:
    """The coarse graph: one source node a file with its entry score, one module node a model class."""
    ranked = files.select("path").join(scores.select("path", "score"), "path", "left").withColumn("n", F.row_number().over(Window.orderBy("path")) - 1)
    nodes = typed(ranked, "nodes", {
        "id": tx.sequence_id("source.file", F.col("n")), "level": "source", "kind": "source", "identity_kind": "source", "label": F.col("path"), "parent_ids": F.array(), "evidence_ids": F.array(),
        "source": _span(F.col("path"), F.lit(1), F.lit(1), F.lit(None)), "attributes_json": F.to_json(F.struct(F.coalesce("score", F.lit(0)).alias("entrypoint_score"))),
    })
    models = index["symbol"].where("kind = 'class' and model").select(F.col("file").alias("path"), "id", "line", "end").join(ranked.select("path", "n"), "path")
    classes = typed(models, "nodes", {
        "id": F.col("id"), "level": "module", "kind": "module", "identity_kind": "definition", "label": tx.tail(F.split_part("id", F.lit("::"), F.lit(2))), "parent_ids": F.array(tx.sequence_id("source.file", F.col("n"))),
        "evidence_ids": F.array(), "source": _span(F.col("path"), F.col("line"), F.col("end"), F.lit(None)),
    })
    contains = typed(models, "edges", {"id": F.concat(F.lit("contains>"), "id"), "source": tx.sequence_id("source.file", F.col("n")), "target": F.col("id"), "kind": "contains", "evidence_ids": F.array()})
    return EvidenceGraph.of(files.sparkSession, nodes=nodes.unionByName(classes), edges=contains)


def match_structured(captured: DataFrame, definitions: DataFrame) -> DataFrame:
    """(id, definition_id): captured nodes (id, target, label) to definitions (id, label, aliases, ordinal).

    An alias equal to the target wins, then an equal label, then a definition whose label
    is a dotted piece of the target; within a rule the first definition by order.
    """
    d = definitions.select(F.col("id").alias("definition_id"), F.col("label").alias("dl"), "aliases", "ordinal")
    by_alias = captured.join(d.select("definition_id", "ordinal", F.explode("aliases").alias("target")), "target").select("id", "definition_id", "ordinal", F.lit(0).alias("rule"))
    by_label = captured.join(d.withColumnRenamed("dl", "label"), "label").select("id", "definition_id", "ordinal", F.lit(1).alias("rule"))
    pieces = captured.select("id", F.explode(F.split("target", r"\.")).alias("dl")).distinct()
    by_piece = pieces.join(d, "dl").select("id", "definition_id", "ordinal", F.lit(2).alias("rule"))
    best = by_alias.unionByName(by_label).unionByName(by_piece).groupBy("id").agg(F.min_by("definition_id", F.struct("rule", "ordinal")).alias("definition_id"))
    return captured.select("id").join(best, "id", "left")


def remap_sources(spans: DataFrame, roots: dict[str, str]) -> DataFrame:
    """Span paths under an installed root become repository paths (longest root first); roots are a few parameters."""
    path = F.col("path")
    out = path
    for installed, repository in sorted(roots.items(), key=lambda x: len(x[0])):
        base = installed.rstrip("/") + "/"
        moved = F.concat(F.lit(repository.rstrip("/") + "/" if repository else ""), F.substring(path, F.lit(len(base) + 1), F.length(path)))
        out = F.when(F.startswith(path, F.lit(base)), moved).otherwise(out)
    return spans.withColumn("path", out)


def static_metrics(calls: DataFrame, symbols: DataFrame, graph: EvidenceGraph) -> DataFrame:
    """One row: call resolution, symbols, graph sizes and shares, one pass a table."""
    c = calls.agg(F.count("*").alias("n_calls"), *[F.count_if(F.col("resolution") == r).alias(f"n_{r}") for r in ("local", "external", "dynamic")])
    s = symbols.agg(F.count("*").alias("n_symbols"), F.count_if(F.col("kind") == "class").alias("n_classes"))
    n = graph.nodes.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("level") == "semantic").alias("n_groups"))
    e = graph.edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("kind") == "data").alias("n_flow"))
    rows = c.crossJoin(s).crossJoin(n).crossJoin(e)  # one row each
    return rows.withColumn("resolved_share", tx.ratio(F.col("n_local") + F.col("n_external"), F.col("n_calls")))


#: Fixed names of the state's fields in a URL, in their order; only ``expanded`` repeats.
STATE_FIELDS = (("view", "view"), ("selected_key", "selected"), ("run_id", "run"), ("expanded_keys", "expanded"), ("search", "q"))


def encode_state(state: dict[str, str | list[str] | None]) -> str:
    """Explorer state as a URL query; empty values are left out, the view is always there."""
    filled = {"view": "paper"} | {k: v for k, v in state.items() if v}
    return urlencode([(short, v) for name, short in STATE_FIELDS if name in filled for v in (filled[name] if isinstance(filled[name], list) else [filled[name]])])


def decode_state(text: str) -> dict[str, str | list[str] | None]:
    """Inverse of ``encode_state``; unknown views are the paper view, other fields are ignored."""
    found = parse_qs(text.removeprefix("?"))
    out = {name: found.get(short, []) if name == "expanded_keys" else next(iter(found.get(short, [])), None) for name, short in STATE_FIELDS}
    return out | {"view": out["view"] if out["view"] in DOMAINS["level"] else "paper"}
