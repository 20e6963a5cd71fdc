"""Best-fit packing of token runs into fixed windows under conflicts.

Texts longer than the capacity are cut into full pieces and a rest.  A full piece fills
a bin by itself and never meets another piece, so its bin is numbered where the row is;
only the rests, one a row, are dealt into packing groups.  Rows are dealt by a number of
their own (their place in a table of lengths written once), so a group holds about
``GROUP_ROWS`` rows however often an id, a source or a cluster is repeated.  In a group,
rests go longest first into the open bin with the smallest residual that holds them and
has no conflict: a bin holds one piece of a duplicate cluster and ``per_source`` pieces
of a source.  Open bins are ordered by residual; each carries bitmaps of its clusters and
of its sources (one plane for each piece of a source it may hold).  The successor search
starts at the piece's length and goes on until a compatible bin is found, so the tightest
compatible bin always wins; if there is none, a bin is opened.

Clusters are a column of the caller's, such as the ``component_id`` of near-duplicate
groups; without one, texts that are equal once lowered and trimmed are one cluster.

Edge cases: null and empty texts and texts without tokens have length 0 and take no
bin (bin null); null ids are packed like others; null sources and clusters conflict with
nothing; ties go to the older bin, equal lengths to the earlier row; repeated rows are
packed separately; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .tokencount import token_counts

CAPACITY, PER_SOURCE, GROUP_ROWS = 2048, 4, 8192
_BIN_BITS = 24


def pack_group(lengths, sources, clusters, capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; pieces are taken in the order given."""
    seen: dict = {}
    for c in clusters:
        if c is not None:
            seen[c] = seen.get(c, 0) + 1
    cluster_bit: dict = {}
    source_bit: dict = {}
    cluster_map: list[int] = []
    source_maps: list[list[int]] = []
    used: list[int] = []
    open_: list[tuple[int, int]] = []  # (residual, bin), ascending
    out = []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        # a cluster that occurs once can't conflict and gets no bit
        mine = 1 << cluster_bit.setdefault(cluster, len(cluster_bit)) if cluster is not None and seen[cluster] > 1 else 0
        plane = 1 << source_bit.setdefault(source, len(source_bit)) if source is not None else 0
        at = bisect_left(open_, (length, -1))
        while at < len(open_):
            b = open_[at][1]
            if not cluster_map[b] & mine and not source_maps[b][per_source - 1] & plane:
                break
            at += 1
        if at == len(open_):
            b = len(used)
            used.append(0)
            cluster_map.append(0)
            source_maps.append([0] * per_source)
        else:
            del open_[at]
        out.append((b, used[b]))
        used[b] += length
        cluster_map[b] |= mine
        for i in range(per_source):
            if not source_maps[b][i] & plane:
                source_maps[b][i] |= plane
                break
        if used[b] < capacity:
            insort(open_, (capacity - used[b], b))
    return out


def pack(rows: DataFrame, n_rows: int, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pack rows (rid long, doc_id, n_tokens, source, cluster): doc_id, piece, start, length, bin, bin_offset.

    ``rid`` is different for every row.  Bins of rests are numbered from 0 (by group),
    those of full pieces from -1 down (by row and piece).
    """
    if not (capacity > 0 and per_source > 0 and group_rows > 0):
        raise ValueError("capacity, per_source and group_rows must be positive")
    groups = max(1, -(-n_rows // group_rows))
    whole = F.floor(F.col("n_tokens") / capacity)
    full = rows.where(F.col("n_tokens") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))).alias("piece"))
    full = full.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), (-1 - F.monotonically_increasing_id()).alias("bin"), F.lit(0).cast("long").alias("bin_offset"))
    # a row without tokens keeps one piece of length 0
    rest = rows.where((F.col("n_tokens") % capacity > 0) | (F.col("n_tokens") == 0)).select(
        "rid", "doc_id", whole.cast("int").alias("piece"), "source", "cluster", (F.col("n_tokens") - whole * capacity).cast("long").alias("length"), F.pmod(F.xxhash64("rid"), F.lit(groups)).alias("pack_group")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "rid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        part = pdf[pdf["length"] > 0]
        none = lambda column: [None if pd.isna(v) else v for v in column]
        where = pack_group(part["length"].tolist(), none(part["source"]), none(part["cluster"]), capacity, per_source)
        group = int(pdf["pack_group"].iloc[0]) << _BIN_BITS
        placed = pd.DataFrame({"bin": [group + b for b, _ in where], "bin_offset": [o for _, o in where]}, index=part.index, dtype="Int64")
        out = pdf[["doc_id", "piece", "length"]].join(placed)
        out.insert(2, "start", out["piece"].astype("int64") * capacity)
        return out

    kind = rows.schema["doc_id"].dataType.simpleString()
    packed = rest.groupBy("pack_group").applyInPandas(run, f"doc_id {kind}, piece int, start long, length long, bin long, bin_offset long")
    return packed.unionByName(full)


def cluster_of(text_col: str = "text"):
    """Duplicate cluster of a text: a fingerprint of the lower-cased text without outer blanks (null for none)."""
    text = F.trim(F.lower(F.col(text_col)))
    return F.when(F.length(text) > 0, F.xxhash64(text))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_rows: int = GROUP_ROWS, cluster: str | None = None) -> DataFrame:
    """Pack documents (doc_id, text, source) by their word-piece counts; ``cluster`` names the column of duplicate clusters."""
    own = F.xxhash64(F.col(cluster)) if cluster else cluster_of()
    # a null cluster conflicts with nothing (its hash would be one)
    marked = docs.select("doc_id", "source", (F.when(F.col(cluster).isNotNull(), own) if cluster else own).alias("cluster"), "text")
    counted = Scratch(docs.sparkSession, "packing").write(token_counts(marked, vocabulary, keep=("source", "cluster")).withColumn("rid", F.monotonically_increasing_id()), "counted")
    return pack(counted, counted.count(), capacity, per_source, group_rows)
