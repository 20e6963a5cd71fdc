"""The ``opN_*`` queries and their SQL: thin readers over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, packing, secrets, sharding, tokencount, topk, toxicity
from .common import crc_fold, table
from .minhash import near_duplicates

#: Production vocabulary of the token counts; a parameter of the operators.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece tokens of every document: doc_id, n_tokens."""
    return tokencount.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), VOCABULARY)


def op2_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in windows of 2,048 tokens."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return packing.pack_documents(docs, VOCABULARY)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(*langid.sample(docs, crc_fold("doc_id", 3) != 1))
    held = F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", held, "text"), model)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return secrets.findings(docs, secrets.fit(docs))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of every query (vec_id divisible by 50)."""
    return topk.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words hit in every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """The lexicon and weights learned from the training fold of the labels."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.fit(*toxicity.sample(docs, labels, crc_fold("doc_id", 5) != 0))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held = F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    scored = toxicity.score(docs.select("doc_id", held, "text"), toxicity_model(spark, docs, sf_dir))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards."""
    return sharding.shard(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one whose texts hold control strings, read back from their windows."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat.digests(chat.format_conversations(rows.unionByName(extra), VOCABULARY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_minhash_groups": op2_minhash_groups,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_language_id": op4_language_id,
    "op5_secret_scan": op5_secret_scan,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_chat_windows": op10_chat_windows,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Queries whose rows SQL can express.  The others need a trained model (4, 5, 8), an
#: automaton (1), greedy packing (3), random draws (9) or window sizes (10).
ORACLE_SQL: dict[str, str] = {
    "op2_minhash_groups": rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + least(5, len(w)) - 1], ' ') AS g FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) u(s) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(id, other) AS (SELECT x, y FROM e UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.other),
m AS (SELECT id, min(other) AS low FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.low, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.id = d.doc_id""",
    "op6_exact_top_k": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op7_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS t FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) u(s) WHERE len(w) > 0),
g AS (SELECT k, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM (SELECT k, w, n FROM d, (SELECT DISTINCT n FROM win) x WHERE len(w) >= n) y, unnest(range(1, len(w) - n + 2)) u(s)),
h AS (SELECT k, s, g.n, item_id FROM g JOIN win ON win.t = g.t AND win.n = g.n),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM h, unnest(range(s, s + n)) u(p) GROUP BY k),
it AS (SELECT k, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS i FROM h) z GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.k = d.k LEFT JOIN it ON it.k = d.k""",
}
