"""Structural diff of two component sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprints(groups: DataFrame) -> DataFrame:
    """(key, id, fingerprint) of components (id, role, label, phase, modalities, n_members, ordinal); the last of a key wins."""
    key = F.concat(F.coalesce("role", F.lit("")), F.lit("::"), F.lower("label"))
    printed = F.to_json(F.struct("role", "label", "phase", "modalities", "n_members"))
    return groups.groupBy(key.alias("key")).agg(F.max_by("id", "ordinal").alias("id"), F.max_by(printed, "ordinal").alias("fingerprint"))


def diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(key, id, status): added, removed, changed or same; removed rows carry the baseline's id."""
    c = current.select("key", F.col("id").alias("cid"), F.col("fingerprint").alias("cf"))
    b = baseline.select("key", F.col("id").alias("bid"), F.col("fingerprint").alias("bf"))
    status = F.when(F.col("bid").isNull(), "added").when(F.col("cid").isNull(), "removed").when(F.col("cf") == F.col("bf"), "same").otherwise("changed")
    return c.join(b, "key", "full_outer").select("key", F.coalesce("cid", "bid").alias("id"), status.alias("status"))
