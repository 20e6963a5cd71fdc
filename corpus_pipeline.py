"""Corpus pipeline over ``documents``: filter, deduplicate, decontaminate, redact, pack.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept.  The
first four return the columns of ``documents``; the last returns packed pieces.  An empty
table passes every stage as an empty one, repeated rows are decided alike, and columns
beyond those named are carried along whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, minhash, packing, secrets, toxicity
from factloom.llm.common import Scratch, table
from factloom.llm.queries import VOCABULARY, toxicity_model

#: The stages call Python models, iterations and packing that SQL can't express.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; null and empty texts score as texts without matches and stay."""
    return toxicity.keep_clean(docs, toxicity_model(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the smallest id; null ids and texts without words stay, of rows that repeat an id one stays."""
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; null texts have none and stay; no benchmark keeps all."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and n_chars renewed where something was; null texts stay null."""
    return secrets.redact(docs, secrets.fit(docs.select("doc_id", "text")))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token windows: doc_id, piece, start, length, bin, bin_offset; a text without tokens is one piece without a bin."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
