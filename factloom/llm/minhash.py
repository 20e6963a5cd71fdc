"""Near-duplicate groups: MinHash bands, signature checks, exact confirmation, star components.

Definitions.  Words are the runs of bytes outside 0x20 and 0x09-0x0D after A-Z are
lowered; a document's set holds its distinct ``width``-word shingles (the whole
sequence as one, if it has fewer words).  Two documents are linked when
``100 * |A & B| >= percent * |A | B|``; a group is a connected component.

Edge cases.  Null, empty and blank texts have an empty set and are linked with
nothing.  Rows with a null id are returned with a null component and are kept.  An
empty table gives an empty result.
Rows that repeat an id are one node: it is linked when any of their texts is.
Documents with equal sets share one representative before any pair is formed, so a
group of copies costs one row a copy.  Other columns are never read.

Recall.  ``BANDS`` x ``ROWS`` minima: a pair of similarity 0.75 shares no band with
probability (1 - 0.75**4)**32 = 5e-6.  Pairs whose signatures agree in less than
``FLOOR`` of the lanes (over 5 standard deviations under 0.75) are not compared.
Each document is first confirmed against its nearest candidates, then against all
candidates of other components.  Buckets that still hold several components are
settled in two steps.  Packs of ``PACK`` strays meet the packs of their bucket by
signature only; the pairs that agree are kept as a forest a pair of packs, whose
components are clusters of documents that have to be compared.  The full sets then
travel once a document, into packs of its cluster (at most ``SET_DOCS`` documents and
about ``SET_ITEMS`` shingles); the packs of strays meet all packs of the cluster and
every pair of different components is decided there on the full sets.  A pair of packs
returns one link for two components at most, so a large group never becomes rows of
all pairs, and there is no cap on buckets or partners.

Sets hold 64-bit fingerprints of the shingles; ids are integers (others raise TypeError).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import textkernel as tk
from .common import Scratch
from .components import components

BANDS, ROWS = 32, 4
FLOOR = 0.55
#: Documents of a pack of signatures; documents and shingles of a pack of full sets.
PACK, SET_DOCS, SET_ITEMS = 256, 64, 32_768
#: Shingles of one slice of the matrix that counts intersections.
SLICE = 16_384

_rng = np.random.default_rng(75)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_BAND = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)
_STEP = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingle fingerprints, sorted."""
    n = len(words)
    if not n:
        return words
    k = min(n, width)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        out += tk.fmix(words[j : n - k + 1 + j] * _STEP[j]) * _STEP[j + width if j + width < 64 else j]
    return np.unique(tk.fmix(out + np.uint64(k)))


def bands(found: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of ``ROWS`` 16-bit minima each; equal lanes estimate the similarity."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for i in range(0, len(found), 1024):
        np.minimum(least, (found[i : i + 1024, None] * _A + _B).min(axis=0), out=least)
    lanes = (tk.fmix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return (lanes.view(np.uint64) ^ _BAND).view(np.int64)


def doc_shingles(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of an Arrow column, in order."""
    for lo, hi, data, offsets in tk.chunks(column):
        data = tk.LOWER[data]
        starts, ends = tk.spans(data, offsets)
        words = tk.hash_spans(data, starts, ends)
        cut = np.searchsorted(starts, offsets)
        for i in range(hi - lo):
            yield shingles(words[cut[i] : cut[i + 1]], width)


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, sig = [], [], [], []
            for found in doc_shingles(batch.column(1), width):
                n.append(len(found))
                k1.append(np.bitwise_xor.reduce(tk.fmix(found)) if len(found) else np.uint64(0))
                k2.append(np.add.reduce(tk.fmix(found ^ np.uint64(0xA5A5A5A5))) if len(found) else np.uint64(0))
                sig.append(bands(found) if len(found) else np.zeros(BANDS, np.int64))
            flat = np.concatenate(sig) if sig else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(n, dtype=np.int64)), pa.array(np.array(k1, dtype=np.uint64).view(np.int64)), pa.array(np.array(k2, dtype=np.uint64).view(np.int64)), lists],
                names=["doc_id", "n_shingles", "k1", "k2", "bands"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [found.tobytes() for found in doc_shingles(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["id", "members"])

    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose signatures agree in ``FLOOR`` of the lanes; adds the agreement."""
    for batch in batches:
        left = batch.column("sa").flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, BANDS * ROWS)
        right = batch.column("sb").flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, BANDS * ROWS)
        same = (left == right).mean(axis=1)
        keep = same >= FLOOR
        a, b = (batch.column(c).to_numpy(zero_copy_only=False)[keep] for c in "ab")
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(same[keep])], names=["a", "b", "agree"])


def _overlap(p: np.ndarray, q: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    return int((q[np.minimum(at, len(q) - 1)] == p).sum())


def _members(value) -> np.ndarray:
    return np.frombuffer(value, dtype=np.uint64)


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ma"), batch.column("mb"), strict=True):
                p, q = _members(x.as_buffer()), _members(y.as_buffer())
                both = _overlap(p, q)
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            out = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(out.columns, names=["a", "b"])

    return run


class _Side:
    """One column of packs of a batch as flat arrays."""

    def __init__(self, column: pa.ListArray) -> None:
        docs = column.flatten()
        self.ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
        self.ids, self.c, self.n = (docs.field(f).to_numpy(zero_copy_only=False) for f in ("id", "c", "n"))
        self.stray = docs.field("stray").to_numpy(zero_copy_only=False)
        names = [f.name for f in docs.type]
        self.bands = docs.field("bands").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS) if "bands" in names else None
        self.members = docs.field("members") if "members" in names else None


def _packs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple]:
    """(key, left side, its slice, right side, its slice) of every row."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            keys = part.column("key").to_numpy(zero_copy_only=False)
            left, right = _Side(part.column("left")), _Side(part.column("right"))
            for i, key in enumerate(keys):
                yield key, left, slice(*left.ends[i : i + 2]), right, slice(*right.ends[i : i + 2])


def _open(left: _Side, p: slice, right: _Side, q: slice, percent: int) -> np.ndarray:
    """Pairs of different components and compatible sizes; a pair of strays is met from both sides and taken once."""
    mine = (~right.stray[None, q] | (left.ids[p, None] < right.ids[None, q])) & (left.c[p, None] != right.c[None, q])
    return mine & (100 * np.minimum(left.n[p, None], right.n[None, q]) >= percent * np.maximum(left.n[p, None], right.n[None, q]))


def _forest(rows: np.ndarray, cols: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its tree) of the graph of the pairs; columns are numbered after the ``width`` rows."""
    cols = cols + width
    label = np.arange(int(cols.max()) + 1)
    while True:
        least = np.minimum(label[rows], label[cols])
        before = label.copy()
        np.minimum.at(label, rows, least)
        np.minimum.at(label, cols, least)
        label = label[label]
        if (label == before).all():
            break
    nodes = np.union1d(rows, cols)
    nodes = nodes[label[nodes] != nodes]
    return nodes, label[nodes]


def _suspects(percent: int):
    """Edges that join the documents of a pair of packs whose signatures agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, left, p, right, q in _packs(batches, 64):
            x, y = left.bands[p], right.bands[q]
            mine, found = _open(left, p, right, q, percent), []
            for k in range(len(x)):
                cols = np.flatnonzero(mine[k])
                shared = y[cols] == x[k]
                # a pair belongs to the first band that it shares
                cols = cols[y[cols, shared.argmax(axis=1)] == key] if len(cols) else cols
                cols = cols[(y[cols].view(np.uint16) == x[k : k + 1].view(np.uint16)).mean(axis=1) >= FLOOR] if len(cols) else cols
                found.append(cols)
            rows = np.repeat(np.arange(len(x)), [len(f) for f in found])
            if len(rows):
                nodes, least = _forest(rows, np.concatenate(found), len(x))
                ids = np.concatenate([left.ids[p], right.ids[q]])
                one, two = ids[nodes], ids[least]
                apart = one != two
                yield pa.RecordBatch.from_arrays([pa.array(one[apart], pa.int64()), pa.array(two[apart], pa.int64())], names=["a", "b"])

    return run


def _incidence(values: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """0/1 matrix of the sets over a sorted slice of shingles."""
    out = np.zeros((len(values), len(vocabulary)), dtype=np.float32)
    for row, found in zip(out, values, strict=True):
        some = found[np.searchsorted(found, vocabulary[0]) : np.searchsorted(found, vocabulary[-1], "right")]
        at = np.searchsorted(vocabulary, some)
        row[at[vocabulary[np.minimum(at, len(vocabulary) - 1)] == some]] = 1
    return out


def _set_links(percent: int):
    """Links between the strays of one pack and the documents of another, decided on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, left, p, right, q in _packs(batches, 16):
            mine = _open(left, p, right, q, percent)
            rows, cols = np.flatnonzero(mine.any(axis=1)), np.flatnonzero(mine.any(axis=0))
            if not len(rows):
                continue
            x = [_members(left.members[int(p.start + i)].as_buffer()) for i in rows]
            y = [_members(right.members[int(q.start + i)].as_buffer()) for i in cols]
            vocabulary = np.intersect1d(np.concatenate(x), np.concatenate(y))
            both = np.zeros((len(x), len(y)), dtype=np.int64)
            for lo in range(0, len(vocabulary), SLICE):
                some = vocabulary[lo : lo + SLICE]
                both += (_incidence(x, some) @ _incidence(y, some).T).astype(np.int64)
            n, m = left.n[p][rows], right.n[q][cols]
            linked = mine[np.ix_(rows, cols)] & (100 * both >= percent * (n[:, None] + m[None, :] - both))
            i, j = np.nonzero(linked)
            c, d = left.c[p][rows[i]], right.c[q][cols[j]]
            # one link of two components is enough
            _, at = np.unique(np.stack([np.minimum(c, d), np.maximum(c, d)]), axis=1, return_index=True)
            a, b = left.ids[p][rows[i[at]]], right.ids[q][cols[j[at]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    return run


def _meetings(scratch: Scratch, rows: DataFrame, packs: str) -> DataFrame:
    """(key, left, right): each pack of strays of a key with each of its packs.

    ``rows`` has (key, id, n, c, stray, ...) and what ``packs`` needs, the number of packs
    of the key.  Packs are paired by number first, so a hot key is dealt by its packs.
    """
    docs = F.collect_list(F.struct(*[c for c in rows.columns if c not in ("key", "packs")])).alias("docs")
    number = F.pmod(F.xxhash64("id", F.lit(3)), F.expr(packs)).alias("pack")
    every = scratch.write(rows.select("*", number).groupBy("key", "pack").agg(docs), "packs")
    strays = scratch.write(rows.where("stray").select("*", number).groupBy("key", "pack").agg(docs), "strays")
    pairs = strays.select("key", F.col("pack").alias("one")).join(every.select("key", F.col("pack").alias("two")), "key")
    met = pairs.join(strays.select("key", F.col("pack").alias("one"), F.col("docs").alias("left")), ["key", "one"])
    return met.join(every.select("key", F.col("pack").alias("two"), F.col("docs").alias("right")), ["key", "two"]).select("key", "left", "right")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, scratch: Scratch | None = None) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept (see the module's text).

    The result reads tables of ``scratch``.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.write(slim.mapInArrow(_signed(width), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "signed")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    # one representative of equal sets
    reps = scratch.write(
        usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "reps"
    )
    banded = reps.select("id", "n", F.explode("bands").alias("key"))
    # each bucket gets another pivot, so that a group is tried from many sides
    shared = scratch.write(
        banded.groupBy("key")
        .agg(F.count("*").alias("members"), F.min_by("id", F.xxhash64("id", "key")).alias("pivot"), F.min_by("n", F.xxhash64("id", "key")).alias("pn"))
        .where("members > 1")
        .select("key", "members", "pivot", "pn"),
        "buckets",
    )
    member = scratch.write(banded.join(shared, "key").select("key", "members", "id", "n", "pivot", "pn"), "members")
    signature = reps.select(F.col("id"), F.col("bands"))

    def agreeing(pairs: DataFrame) -> DataFrame:
        """Pairs (a < b) of compatible sizes whose signatures agree."""
        left = pairs.join(signature.select(F.col("id").alias("a"), F.col("bands").alias("sa")), "a")
        both = left.join(signature.select(F.col("id").alias("b"), F.col("bands").alias("sb")), "b")
        return both.select("a", "b", "sa", "sb").mapInArrow(_agreeing, "a long, b long, agree double")

    sized = f"100 * least(n, pn) >= {percent} * greatest(n, pn)"
    near = scratch.write(
        agreeing(member.where(f"id <> pivot and {sized}").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()), "near"
    )
    # the best candidates of each document, seen from either end
    ends = near.select("a", "b", "agree", F.col("a").alias("e"), F.col("b").alias("p")).unionByName(
        near.select("a", "b", "agree", F.col("b").alias("e"), F.col("a").alias("p"))
    )
    best = ends.groupBy("e").agg(
        F.max_by(F.struct("a", "b"), F.struct("agree", "p")).alias("one"),  # its nearest
        F.max_by(F.struct("a", "b"), F.struct(F.col("agree") >= 0.8, -F.col("p"))).alias("other"),  # a near one that others share
    )
    first = scratch.write(best.select(F.explode(F.array("one", "other")).alias("p")).select("p.a", "p.b").distinct(), "first", scratch.few())

    def sets_of(ids: DataFrame) -> DataFrame:
        """The full sets of some documents, from one pass over the texts."""
        return scratch.write(slim.join(ids, "doc_id").mapInArrow(_sets(width), "id long, members binary"), "sets")

    sets = sets_of(scratch.write(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needed", scratch.few()))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs of ``pairs`` that are linked, decided on the full sets of their documents."""
        left = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a")
        both = left.join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
        return scratch.write(both.select("a", "b", "ma", "mb").mapInArrow(_linked(percent), "a long, b long"), "links")

    def labelled(side: DataFrame, column: str, name: str) -> DataFrame:
        found = side.join(classes.select(F.col("id").alias(column), F.col("component").alias(name)), column, "left")
        return found.withColumn(name, F.coalesce(name, column))

    links = confirmed(first)
    classes = scratch.write(components(scratch, links), "classes", scratch.few())
    # then all other candidates that are not in one component yet
    rest = scratch.write(labelled(labelled(near.select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb").join(first, ["a", "b"], "left_anti").select("a", "b"), "rest", scratch.few())
    if rest.head(1):
        links = links.unionByName(confirmed(rest))
        classes = scratch.write(components(scratch, links), "classes", scratch.few())
    scratch.drop("sets", "near", "rest", "first", "needed")
    # buckets that still hold several components: whom do their strays have to be compared with?
    placed = labelled(labelled(member.where("members > 2"), "id", "c"), "pivot", "pc")
    packs = F.ceil(F.col("members") / PACK).alias("packs")
    placed = scratch.write(placed.select("key", packs, "id", "n", "c", (F.col("c") != F.col("pc")).alias("stray")), "placed")
    open_ = scratch.write(placed.where("stray").select("key").distinct(), "open", scratch.few())
    scratch.drop("members", "buckets")
    if open_.head(1):
        met = _meetings(scratch, placed.join(open_, "key").join(signature, "id"), "packs")
        suspects = scratch.write(met.mapInArrow(_suspects(percent), "a long, b long"), "suspects")
        scratch.drop("packs", "strays", "placed")
        clusters = scratch.write(components(scratch, suspects), "clusters", scratch.few())
        # their full sets meet in packs of the cluster
        grouped = labelled(clusters.select("id", F.col("component").alias("key")), "id", "c").join(reps.select("id", "n"), "id")
        sizes = grouped.groupBy("key", "c").agg(F.count("*").alias("of"), F.sum("n").alias("items")).groupBy("key").agg(F.max_by("c", F.struct("of", "c")).alias("most"), F.sum("of").alias("of"), F.sum("items").alias("items"))
        needed = F.greatest(F.ceil(F.col("of") / SET_DOCS), F.ceil(F.col("items") / SET_ITEMS)).alias("packs")
        grouped = scratch.write(grouped.join(sizes, "key").select("key", needed, "id", "n", "c", (F.col("c") != F.col("most")).alias("stray")), "grouped", scratch.few())
        sets = sets_of(grouped.select(F.col("id").alias("doc_id")))
        more = scratch.write(_meetings(scratch, grouped.join(sets, "id"), "packs").mapInArrow(_set_links(percent), "a long, b long"), "more")
        scratch.drop("sets", "packs", "strays")
        if more.head(1):
            links = links.unionByName(more)
            classes = scratch.write(components(scratch, links), "classes", scratch.few())
    # members of a set class share their representative's component
    named = scratch.write(
        reps.select("k1", "k2", "id").join(classes, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component_id")), "named"
    )
    solo = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = usable.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id").unionByName(solo)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Of rows that repeat a kept id the one with the smallest text stays; rows with a null
    id and blank texts stay; an empty table gives an empty one.
    """
    inner = Scratch(docs.sparkSession, "minhash")
    groups = Scratch(docs.sparkSession, "groups").write(near_duplicates(docs, width=width, percent=percent, scratch=inner))
    inner.drop()
    gone = groups.where("not kept").select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = groups.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.head(1):
        whole = F.struct(*docs.columns)
        some = out.join(repeated, "doc_id", "left_semi").select("doc_id", F.struct("text", F.to_json(whole).alias("row")).alias("order"), whole.alias("doc"))
        single = some.groupBy("doc_id").agg(F.min_by("doc", "order").alias("doc")).select("doc.*")
        out = out.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(single)
    return out
