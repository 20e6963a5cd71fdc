"""Static resolution over indexed code: callees, inherited methods, value flow, configurations.

Tables: calls (id, path, module, caller, caller_class, callee, line, col, ord,
args array, targets array), symbols (id, name: module.qualname, ordinal), imports
(module, local, target, ordinal), bases (class, base, ord), params (symbol, formal, pos).
"""

from __future__ import annotations

import builtins

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..plans.stages import Stages


def inherited(bases: DataFrame, methods: DataFrame) -> DataFrame:
    """(cls, method, owner): the class that defines each method, searched depth-first through bases in order.

    A class is reached from another first along the least path, paths being strings of
    fixed-width base positions.  Only that path is kept and carried on when it gets
    smaller, so diamonds cost no more than their edges, and cycles end by themselves (a
    longer way round is a larger string).
    """
    stages = Stages(bases.sparkSession, "bases")
    step = bases.select(F.col("cls").alias("at"), "base", F.lpad(F.col("ord").cast("string"), 4, "0").alias("o"))
    starts = methods.select("cls").unionByName(bases.select("cls")).unionByName(bases.select(F.col("base").alias("cls"))).distinct()
    best = front = stages.write(starts.select("cls", F.col("cls").alias("at"), F.lit("").alias("path")))
    while front.head(1):
        found = front.join(step, "at").groupBy("cls", F.col("base").alias("at")).agg(F.min(F.concat("path", "o")).alias("path"))
        before = best.select("cls", "at", F.col("path").alias("old"))
        front = stages.write(found.join(before, ["cls", "at"], "left").where("old is null or path < old").select("cls", "at", "path"))
        best = stages.write(best.unionByName(front).groupBy("cls", "at").agg(F.min("path").alias("path")))
    owned = best.join(methods.select(F.col("cls").alias("at"), "method"), "at")
    return owned.groupBy("cls", "method").agg(F.min_by("at", "path").alias("owner"))


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, bases: DataFrame, methods: DataFrame) -> DataFrame:
    """Adds ``resolution`` (local, external, dynamic), ``target`` and ``symbol_id``; the first rule that fits decides.

    Symbols and imports: the last definition of a name wins.
    """
    table = symbols.groupBy("name").agg(F.max_by("id", "ordinal").alias("symbol_id"))
    bound = imports.groupBy("module", "local").agg(F.max_by("target", "ordinal").alias("bound"))
    owners = inherited(bases, methods)
    direct = bases.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("ord", "base"))).alias("b"))
    parent = direct.select("cls", F.explode("b").alias("x")).select("cls", "x.base", "x.ord")
    above = parent.join(owners.select(F.col("cls").alias("base"), "method", "owner"), "base").groupBy("cls", "method").agg(F.min_by("owner", "ord").alias("above"))
    callee, dot = F.col("callee"), F.contains("callee", F.lit("."))
    head, rest = F.substring_index(callee, ".", 1), F.expr("substring(callee, instr(callee, '.') + 1)")
    c = calls.withColumns({"head": F.when(dot, head).otherwise(callee), "rest": F.when(dot, rest), "own": F.concat("module", F.lit("."), "callee")})
    c = c.join(table.select(F.col("name").alias("own"), F.lit(True).alias("own_symbol")), "own", "left")
    c = c.join(bound.withColumnRenamed("local", "head"), ["module", "head"], "left")
    c = c.join(owners.select(F.col("cls").alias("caller_class"), F.col("method").alias("rest"), F.col("owner")), ["caller_class", "rest"], "left")
    c = c.join(above.select(F.col("cls").alias("caller_class"), F.col("method").alias("rest"), "above"), ["caller_class", "rest"], "left")
    deep, method = F.contains("rest", F.lit(".")), F.col("caller_class").isNotNull()
    names = sorted(n for n in dir(builtins) if not n.startswith("_"))
    plain = F.when(F.col("own_symbol"), F.col("own")).when(F.col("bound").isNotNull(), F.col("bound")).when(callee.isin(*names), F.concat(F.lit("builtins."), "callee"))
    of_self = F.when(~deep & F.col("owner").isNotNull(), F.concat("owner", F.lit("."), "rest"))
    of_super = F.when(~deep & F.col("above").isNotNull(), F.concat("above", F.lit("."), "rest"))
    dotted = F.when((F.col("head") == "self") & method, of_self).when((F.col("head") == "super") & method, of_super).when(F.col("bound").isNotNull(), F.concat("bound", F.lit("."), "rest"))
    target = F.when(F.coalesce(callee, F.lit("")) == "", None).when(~dot, plain).otherwise(dotted)
    out = c.withColumn("target", target).join(table.withColumnRenamed("name", "target"), "target", "left")
    resolution = F.when(F.col("symbol_id").isNotNull(), "local").when(F.col("target").isNotNull(), "external").otherwise("dynamic")
    return out.withColumn("resolution", resolution).select(*calls.columns, "resolution", "target", "symbol_id")


def def_use(calls: DataFrame) -> DataFrame:
    """(producer, consumer, variable): each argument's latest earlier call in the scope that assigns the name.

    One union of definitions and uses and one window, never a self join.
    """
    key = F.struct("line", "col", "ord")
    defs = calls.select("path", "caller", key.alias("k"), F.explode("targets").alias("v"), F.col("id").alias("d"), F.lit(None).cast("string").alias("u"))
    uses = calls.select("path", "caller", key.alias("k"), F.explode("args").alias("v"), F.lit(None).cast("string").alias("d"), F.col("id").alias("u"))
    # a call's own definition comes after its use: uses sort before definitions at one place
    w = Window.partitionBy("path", "caller", "v").orderBy("k", F.col("d").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    found = defs.unionByName(uses).withColumn("p", F.last("d", ignorenulls=True).over(w))
    return found.where("u is not null and p is not null").select(F.col("p").alias("producer"), F.col("u").alias("consumer"), F.col("v").alias("variable")).distinct()


def argument_flow(resolved: DataFrame, params: DataFrame, bindings: DataFrame) -> DataFrame:
    """(producer, consumer, variable): an outer call to each inner call of its callee whose arguments name the bound formal.

    ``bindings`` has (call_id, pos or formal, actual) of bare-name arguments.
    """
    bound = bindings.join(resolved.where("symbol_id is not null").select(F.col("id").alias("call_id"), "symbol_id"), "call_id")
    named = bound.where("formal is not null").select("call_id", "symbol_id", "formal", "actual")
    placed = bound.where("formal is null").select("call_id", "symbol_id", "pos", "actual").join(params.select(F.col("symbol").alias("symbol_id"), "pos", "formal"), ["symbol_id", "pos"])
    inner = resolved.select(F.col("id").alias("consumer"), F.col("caller").alias("symbol_id"), F.explode("args").alias("formal"))
    every = named.unionByName(placed.select("call_id", "symbol_id", "formal", "actual"))
    return every.join(inner, ["symbol_id", "formal"]).select(F.col("call_id").alias("producer"), "consumer", F.col("actual").alias("variable")).distinct()


def return_flow(resolved: DataFrame, returns: DataFrame) -> DataFrame:
    """(producer, consumer, variable) of returned names and calls to the outer call.

    ``returns`` has (symbol, name, line) for names and (symbol, line, col) for calls.
    """
    inner = resolved.select(F.col("id").alias("producer"), F.col("caller").alias("symbol"), "line", "col", "ord", "targets")
    outer = resolved.where("symbol_id is not null").select(F.col("id").alias("consumer"), F.col("symbol_id").alias("symbol"))
    # definitions and returns of a name in one window: the latest definition up to the return
    names = returns.where("name is not null").select("symbol", "name", F.col("line").alias("at"), F.lit(None).cast("string").alias("d"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("long").alias("o"))
    made = inner.select("symbol", F.explode("targets").alias("name"), F.col("line").alias("at"), F.col("producer").alias("d"), F.col("col").cast("long").alias("c"), F.col("ord").cast("long").alias("o"))
    order = Window.partitionBy("symbol", "name").orderBy("at", F.col("d").isNull(), "c", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = made.unionByName(names).withColumn("producer", F.last("d", ignorenulls=True).over(order)).where("d is null and producer is not null")
    exact = inner.join(returns.where("name is null").select("symbol", "line", "col"), ["symbol", "line", "col"]).groupBy("symbol", "line", "col").agg(F.min_by("producer", "ord").alias("producer"))
    both = latest.select("symbol", "producer", F.col("name").alias("variable")).unionByName(exact.select("symbol", "producer", F.lit("<return>").alias("variable")))
    return both.join(outer, "symbol").select("producer", "consumer", "variable").distinct()


def resolve_configs(references: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, status, entry_ids, candidates): references (id, kind, path, name, dynamic) against entries (entry_id, path)."""
    missing = (F.col("kind") == "hydra") & F.col("name").isNull()
    listed = references.withColumn("candidates", F.when(~F.col("dynamic"), tx.config_candidates(F.col("kind"), F.col("path"), F.col("name"))))
    files = entries.select(tx.collapsed_path(F.col("path")).alias("file"), "entry_id")
    hits = listed.where(~missing & ~F.col("dynamic")).select("id", F.explode("candidates").alias("file")).join(files, "file").groupBy("id").agg(F.sort_array(F.collect_set("entry_id")).alias("entry_ids"))
    status = F.when(F.col("dynamic") | missing, "dynamic").when(F.col("entry_ids").isNotNull(), "resolved").otherwise("unresolved")
    return listed.join(hits, "id", "left").select("id", status.alias("status"), F.coalesce("entry_ids", F.array().cast("array<string>")).alias("entry_ids"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))
