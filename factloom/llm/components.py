"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: Edges of one partition; small tables take few tasks, large ones as many as they need.
PART_EDGES = 100_000


def _star(scratch: Scratch, edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One star round over rows (u, v) with u > v.

    The minimum of each neighbourhood is a partial aggregate, written so that the
    join back sees two plain exchanges (a hot centre is split by the skew join).
    """
    if large:
        both = scratch.write(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "sym", parts)
    else:
        both = edges
    least = scratch.write(both.groupBy("u").agg(F.min("v").alias("w")).withColumn("m", F.least("u", "w")).select("u", "m"), "min", parts)
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    result = scratch.write(out.where("u <> v").distinct(), "large" if large else "small", parts)
    scratch.drop("min", "sym")
    return result


def _unsettled(edges: DataFrame) -> int:
    """Nodes that keep the edges from being stars: with two centres, or centre and leaf at once."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    each = ends.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return each.where("leaf > 1 or (leaf > 0 and centre > 0)").agg(F.count("*").alias("n")).first()["n"]


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id that some edge touches.

    Nulls and self loops are ignored; repeated and reversed edges count once; no
    edges give no rows.  Work a round is linear in the edges and the rounds are
    logarithmic in the diameter; nothing but counts reaches the driver.
    """
    now = scratch.write(
        edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges", scratch.few()
    )
    parts = max(8, -(-now.count() // PART_EDGES))
    while _unsettled(now):
        large = _star(scratch, now, True, parts)
        scratch.drop("small", "edges")
        now = _star(scratch, large, False, parts)
        scratch.drop("large")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
