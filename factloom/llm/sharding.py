"""Uniform shuffle into shards of exact sizes, in DataFrame operations only.

Law ``rows``: shard counts differ by one at most.  Rows sit in partitions (a hash of
a row number written once, so equal rows, hot ids and hot sources are spread).  The
matrix of how many rows of each partition go to each shard is drawn exactly, row by
row, from the multivariate hypergeometric law given all sizes.  Each partition is
permuted (a seeded hash order) and dealt along its row of the matrix, rows are
exchanged, and each shard is permuted again: its rows are cut into buckets by a second
hash, ordered in each bucket, and numbered after the buckets before it, so no task
holds a whole shard.  The driver sees one count a partition and draws the matrix.

Draws are by inversion in double precision: exact for the sizes that doubles hold; for
shards of some 1e10 rows the logarithms of factorials leave a relative error of about
1e-5 in single probabilities, far below the spread of the counts.

Edge cases: null texts have size 8 and crc 0; null ids, repeated rows and empty
tables are dealt like others; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

PART_ROWS = 20_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Exact draw by inversion outwards from the mode; sizes are not bounded."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - p
    if u < 0:
        return mode
    down, up, pd, pu = mode, mode, p, p
    while down > low or up < high:
        if up < high:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= pu
            if u < 0:
                return up
        if down > low:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u < 0:
                return down
        if pu + pd < 1e-300:
            break
    return mode


def matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each partition for each shard; columns differ by one at most."""
    rng = random.Random(seed)
    total = sum(counts)
    room = [total // shards + (k < total % shards) for k in range(shards)]
    out = []
    for n in counts:
        left, row, rest = n, [], sum(room)
        for k in range(shards):
            rest -= room[k]
            take = hypergeometric(rng, room[k], rest, left)
            row.append(take)
            left -= take
        room = [a - b for a, b in zip(room, row, strict=True)]
        out.append(row)
    return out


def shard(docs: DataFrame, shards: int = 24, seed: int = 7, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row (doc_id, text)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    utf8 = F.col("text").cast("binary")
    rows = scratch.write(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32(utf8), F.lit(0)).cast("long").alias("text_crc32"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "rows",
    )
    parts = max(1, -(-rows.count() // part_rows))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(parts)).cast("int"))
    counted = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    drawn = matrix([counted.get(p, 0) for p in range(parts)], shards, seed)
    ends = [(p, [sum(row[: k + 1]) for k in range(shards)]) for p, row in enumerate(drawn)]
    plan = spark.createDataFrame(ends, "part int, ends array<long>")
    local = Window.partitionBy("part").orderBy(F.xxhash64("rid", F.lit(seed + 1)), "rid")
    placed = dealt.withColumn("r", F.row_number().over(local)).join(plan, "part")
    second = F.xxhash64("rid", F.lit(seed + 2))
    buckets = max(1, -(-sum(counted.values()) // (shards * part_rows)))
    exchanged = scratch.write(
        placed.select(
            "doc_id", "size", "text_crc32", "rid",
            F.size(F.filter("ends", lambda e: e < F.col("r"))).alias("shard"),
            second.alias("h"),
            # buckets are ranges of h, so slots follow a random order of the whole shard
            F.least(F.floor(F.shiftrightunsigned(second, 11) / F.lit(2.0**53) * buckets), F.lit(buckets - 1)).cast("int").alias("bucket"),
        ),
        "exchanged",
    )
    sizes = exchanged.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.write(sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "offsets")
    again = Window.partitionBy("shard", "bucket").orderBy("h", "rid")
    return (
        exchanged.withColumn("k", F.row_number().over(again))
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
