"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Words: A-Z lowered, then the runs of characters outside ``SEPARATORS``.  A window is
``width`` consecutive words of an item, or the whole item if it has fewer words (an
item without words has none).  A document word inside any occurrence of a window is
hit.

Join.  Tokens are ordered by rarity, counted over all documents.  Exact containment
of a window needs every one of its tokens, so its necessary prefix is its rarest
token: document words join the windows' rarest tokens, the length and positional
bounds (the window must fit around the matched word) drop impossible starts, and the
words of the window are compared one by one.  The windows are broadcast in blocks of
about ``BLOCK`` rows and ``BLOCK_BYTES`` bytes, measured before the blocks are cut (the
proven bound), whatever the size of the benchmark and of its words; documents are never
joined with each other, and no pair of texts is formed.  A benchmark of one block costs
two passes over the documents, one for the rarity of its words and one for the hits.

Edge cases: null and empty texts have no words and no hits; items with a null id are
skipped; repeated items count once; repeated documents get a row each; other columns
are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
#: Windows broadcast at once, and the bytes of their words.
BLOCK, BLOCK_BYTES = 100_000, 1 << 25


def words_of(text: Column) -> Column:
    """Array of words."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, window array, n) of every item."""
    words = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    cut = words.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))).alias("s"))
    return cut.select("item_id", F.slice("w", F.col("s"), F.lit(width)).alias("window")).distinct()


def hits(docs: DataFrame, items: DataFrame, scratch: Scratch, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(k1, k2, n_hit, n_items, items_sha256) of the documents that any window hits."""
    owned = scratch.write(windows(items, width).withColumn("wid", F.xxhash64("window")), "owned")
    distinct = owned.select("wid", "window").distinct()
    size = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("window", " "))), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block), -(-size["bytes"] // BLOCK_BYTES))
    seen = docs.select("k1", "k2", words_of(F.col("text")).alias("words"))
    found = None
    for i in range(blocks):
        part = distinct.where(F.pmod("wid", F.lit(blocks)) == i)
        needed = part.select(F.explode("window").alias("w")).distinct()
        rarity = docs.select(F.explode(words_of(F.col("text"))).alias("w")).join(F.broadcast(needed), "w", "left_semi").groupBy("w").agg(F.count("*").alias("n"))
        order = part.select("wid", "window", F.posexplode("window").alias("off", "w")).join(F.broadcast(rarity), "w", "left")  # at most ``width`` words a window of the block
        prefix = scratch.write(
            order.groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("off"), F.col("w"))).alias("rare"), F.first("window").alias("window"))
            .where("rare.n > 0")  # a token that no document holds: no occurrence
            .select("wid", "window", F.size("window").alias("len"), "rare.off", "rare.w"),
            "prefix",
        )
        words = seen.select("k1", "k2", "words", F.posexplode("words").alias("p", "w"))
        at = F.col("p") - F.col("off")
        met = (
            words.join(F.broadcast(prefix), "w")
            .where((at >= 0) & (at + F.col("len") <= F.size("words")))
            .where(F.slice("words", at + 1, F.col("len")) == F.col("window"))
            .select("k1", "k2", "wid", at.alias("start"), "len")
        )
        found = met if found is None else found.unionByName(met)
    found = scratch.write(found, "found")
    reach = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "len")).alias("runs"))
    reach = reach.select("k1", "k2", F.expr("size(array_distinct(flatten(transform(runs, r -> sequence(r.start, r.start + r.len - 1)))))").cast("long").alias("n_hit"))
    named = found.select("k1", "k2", "wid").distinct().join(owned.select("wid", "item_id"), "wid")
    listed = named.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    return scratch.write(
        reach.join(listed, ["k1", "k2"]).select("k1", "k2", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")), "hits"
    )


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with a 96-bit key of (id, text): equal rows share their result."""
    return docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.hash("text", "doc_id")})


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = keyed(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    found = hits(rows, items.select("item_id", F.col("text").cast("string").alias("text")), Scratch(docs.sparkSession, "decontaminate"), width, block)
    counted = rows.select("doc_id", "k1", "k2", F.coalesce(F.greatest(F.size(words_of(F.col("text"))), F.lit(0)), F.lit(0)).cast("long").alias("n_words"))
    return counted.join(found, ["k1", "k2"], "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that no window hits, with all their columns (whatever they are called)."""
    rows = keyed(docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", F.col("text").cast("string").alias("text")))
    found = hits(rows, items.select("item_id", F.col("text").cast("string").alias("text")), Scratch(docs.sparkSession, "decontaminate"), width)
    return rows.join(found.select("k1", "k2"), ["k1", "k2"], "left_anti").select("doc.*")
