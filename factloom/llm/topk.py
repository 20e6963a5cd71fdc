"""Exact top-k inner products by dual cover-tree search.

Vectors are cut into integer components floor(256 * x), so scores are exact integers.

Between blocks.  At most ``CELLS`` rows (those of the smallest id hash: a bounded,
documented sample) are pivots, the top level of the cover: every query and every data row
belongs to the cell of its nearest pivot, whose covering radius is the largest distance
met there.  A hot cell is dealt over blocks of bounded size.  First each query meets one
block, of the cell that can score highest; its kth score there and the least of its
cell's queries' bound what follows.  Then a query's cell meets only the blocks of data
cells whose largest possible product, <cq, cp> + |cq| Rp + |cp| Rq + Rq Rp, is not under
that kth score; other pairs are pruned before any vector is sent.  The cell table (at
most ``CELLS`` squared bounds) is all that the driver holds.

Within a pair of blocks both sides are indexed by cover trees, which are traversed
together: a pair of nodes is pruned by the same bound against the worst kth score of the
node's queries, which starts at the score from the first meeting.  The best k of each
pair are merged by rank.

A node's members lie within its covering radius; its children's centres are further
apart than the radius they cover.  Where such a cover would not shrink (in high
dimensions most points are equally far from each other), the node stays a leaf and is
scored by one matrix product; nothing is dropped.

Edge cases: null vectors and vectors with null or non-finite components take no part;
shorter vectors count as padded with zeros; repeated identical rows count once;
candidates that share the query's id are the query's own; ties go to the smaller id;
products of 2**53 and more are computed with Python integers; an empty table or no query
gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

QUERY_ROWS, DATA_ROWS, CELLS = 1024, 8192, 1024
LEAF, SHRINK, TRIES = 64, 0.6, 32


class Node:
    """Members (row numbers) within ``radius`` of a centre, which is one of them."""

    __slots__ = ("center", "children", "members", "norm", "radius")

    def __init__(self, points: np.ndarray, members: np.ndarray) -> None:
        self.members = members
        own = points[members]
        first = int(np.argmin(((own - own.mean(axis=0)) ** 2).sum(axis=1)))
        self.center = own[first]
        self.norm = float(np.sqrt(self.center @ self.center))
        away = np.sqrt(((own - self.center) ** 2).sum(axis=1))
        self.radius = float(away.max())
        self.children: list[Node] = []
        if len(members) <= LEAF or self.radius == 0:
            return
        reach, groups, at, left = self.radius * SHRINK, [], first, np.arange(len(members))
        while len(left):
            if len(groups) >= TRIES and len(left) > len(members) // 2:
                return  # the cover does not shrink here
            near = np.sqrt(((own[left] - own[at]) ** 2).sum(axis=1)) <= reach
            groups.append(members[left[near]])
            left = left[~near]
            at = left[0] if len(left) else 0
        if len(groups) > 1 and len(groups) <= max(2, len(members) // 8):
            self.children = [Node(points, g) for g in groups]


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None) -> None:
        """``least``: scores that the kth best is known to reach (rows under them are not wanted)."""
        self.k = k
        self.scores = np.full((n, k), -np.inf) if least is None else np.repeat(least[:, None], k, axis=1)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge a block of scores (queries x ids); -inf takes no part."""
        worst = self.scores[queries, -1]
        if scores.shape[1] > self.k:
            worst = np.maximum(worst, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((scores >= worst[:, None]) & (scores > -np.inf))
        if not len(row):
            return
        rows = np.concatenate([row, np.repeat(np.arange(len(queries)), self.k)])
        values = np.concatenate([scores[row, col], self.scores[queries].ravel()])
        names = np.concatenate([ids[col], self.ids[queries].ravel()])
        order = np.lexsort((names, -values, rows))
        rows, values, names = rows[order], values[order], names[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        self.scores[queries[rows[keep]], place[keep]] = values[keep]
        self.ids[queries[rows[keep]], place[keep]] = names[keep]


def search(q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> Best:
    """Best k rows of ``p`` for each row of ``q`` by inner product, own id excluded; rows under ``least`` may be left out."""
    best = Best(len(q), k, least)
    norm = lambda x: float(np.sqrt((x * x).sum(axis=1).max()))
    if norm(q) * norm(p) >= 2**53:
        whole = [[int(v) for v in row] for row in p]
        for i, row in enumerate(q):
            row = [int(v) for v in row]
            found = sorted((-sum(a * b for a, b in zip(row, w, strict=True)), int(j)) for w, j in zip(whole, p_ids, strict=True) if j != q_ids[i])[:k]
            best.scores = best.scores.astype(object)
            best.ids[i] = np.iinfo(np.int64).max
            for c, (s, j) in enumerate(found):
                best.scores[i, c], best.ids[i, c] = -s, j
        return best

    def bound(a: Node, b: Node) -> float:
        x = float(a.center @ b.center) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return x + 1e-6 * (1 + abs(x))

    stack = [(Node(q, np.arange(len(q))), Node(p, np.arange(len(p))))]
    while stack:
        a, b = stack.pop()
        if bound(a, b) < best.scores[a.members, -1].min():
            continue
        if b.children and (not a.children or len(b.members) >= len(a.members)):
            stack += sorted(((a, c) for c in b.children), key=lambda pair: bound(*pair))
        elif a.children:
            stack += [(c, b) for c in a.children]
        else:
            for lo in range(0, len(a.members), 128):
                rows = a.members[lo : lo + 128]
                scores = q[rows] @ p[b.members].T
                scores[q_ids[rows][:, None] == p_ids[b.members][None, :]] = -np.inf
                best.offer(rows, scores, p_ids[b.members])
    return best


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for i, n in enumerate(lengths):
        out[i, :n] = flat[ends[i] : ends[i] + n]
    return out


def _assign(pivots: np.ndarray):
    """Adds the nearest pivot and the distance to it (rounded up) to rows (vec_id, v, is_query)."""
    width = pivots.shape[1]
    squares = (pivots * pivots).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(pa.chunked_array([batch.column("v")]), max(width, _width(batch.column("v"))))
            cell, away = np.zeros(len(x), np.int32), np.zeros(len(x))
            for lo in range(0, len(x), 1024):
                part = x[lo : lo + 1024]
                near = (squares - 2 * (part[:, :width] @ pivots.T)).argmin(axis=1)
                centre = np.zeros_like(part)
                centre[:, :width] = pivots[near]
                cell[lo : lo + 1024], away[lo : lo + 1024] = near, np.sqrt(((part - centre) ** 2).sum(axis=1)) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=["vec_id", "v", "is_query", "cell", "away"])

    return run


def _width(column: pa.Array) -> int:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return max(1, int(lengths.max()) if len(lengths) else 1)


def _bounds(pivots: np.ndarray, query_radius: np.ndarray, data_radius: np.ndarray) -> np.ndarray:
    """Largest possible product of a query of one cell (row) and a data row of another; cells without rows have radius -1."""
    norm = np.sqrt((pivots * pivots).sum(axis=1))
    top = pivots @ pivots.T + norm[:, None] * data_radius[None, :] + norm[None, :] * query_radius[:, None] + query_radius[:, None] * data_radius[None, :]
    top += 1e-6 * (1 + np.abs(top))
    top[query_radius < 0, :] = -np.inf
    top[:, data_radius < 0] = -np.inf
    return top


def top_k(data: DataFrame, is_query, k: int = 5, query_rows: int = QUERY_ROWS, data_rows: int = DATA_ROWS, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score over rows (vec_id, embedding); ``is_query`` marks the queries."""
    spark = data.sparkSession
    scratch = Scratch(spark, "topk")
    finite = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('Infinity'))"
    usable = data.select("vec_id", "embedding").where(finite)
    ints = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(embedding, x -> cast(floor(256 * cast(x as double)) as double))").alias("v")).distinct()
    ints = scratch.write(ints.withColumn("is_query", F.coalesce(is_query, F.lit(False))), "ints")
    n = ints.count()
    # about four cells a block of data, as far as the bound goes
    wanted = max(1, min(cells, 4 * -(-n // data_rows)))
    drawn = ints.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(wanted).select("v").collect()
    width = max([1, *(len(r["v"]) for r in drawn)])
    pivots = np.unique(np.array([list(r["v"]) + [0.0] * (width - len(r["v"])) for r in drawn] or [[0.0] * width]), axis=0)
    placed = scratch.write(ints.mapInArrow(_assign(pivots), "vec_id long, v array<double>, is_query boolean, cell int, away double"), "placed")
    # one row a cell
    found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r"), F.count_if("is_query").alias("q"), F.max(F.when(F.col("is_query"), F.col("away"))).alias("qr")).collect()
    blocks, counts = {r["cell"]: -(-r["n"] // data_rows) for r in found}, {r["cell"]: r["q"] for r in found if r["q"]}
    data_radius, query_radius = np.full(len(pivots), -1.0), np.full(len(pivots), -1.0)
    for r in found:
        data_radius[r["cell"]] = r["r"]
        if r["q"]:
            query_radius[r["cell"]] = r["qr"]
    top = _bounds(pivots, query_radius, data_radius)
    first = {c: int(top[c].argmax()) for c in counts}

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not queries.num_rows or not rows.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        wide = max(_width(t.column("v").combine_chunks()) for t in (queries, rows))
        q, p = _matrix(queries.column("v"), wide), _matrix(rows.column("v"), wide)
        q_ids, p_ids = (t.column("vec_id").to_numpy() for t in (queries, rows))
        best = search(q, q_ids, p, p_ids, k, queries.column("least").to_numpy().astype(np.float64))
        there = best.ids != np.iinfo(np.int64).max
        return pa.table([pa.array(np.repeat(q_ids, k)[there.ravel()]), pa.array(best.ids[there]), pa.array([int(s) for s in best.scores[there]], pa.int64())], names=names)

    block_of = F.pmod(F.xxhash64("vec_id", "v"), F.coalesce(F.get(F.lit([blocks.get(c, 1) for c in range(len(pivots))]), F.col("cell")), F.lit(1))).cast("int")
    one = placed.select("vec_id", "v", F.col("cell").alias("to"), block_of.alias("block"))
    two = placed.where("is_query").select("vec_id", "v", "cell")

    def met(left: DataFrame, pairs: list[tuple[int, int, int, int]]) -> DataFrame:
        """Results of the pairs (query cell, data cell, first block, end block).

        All queries that meet a data cell are dealt anew into groups of ``query_rows``, so a
        data row is sent once a group, not once a query cell; only rows that some pair needs
        are sent.
        """
        asked: dict[int, int] = {}
        needed: dict[int, tuple[int, int]] = {}
        for c, d, lo, hi in pairs:
            asked[d] = asked.get(d, 0) + counts[c]
            low, high = needed.get(d, (lo, hi))
            needed[d] = min(low, lo), max(high, hi)
        groups = {d: -(-n // query_rows) for d, n in asked.items()}
        sent = spark.createDataFrame([(c, d, groups[d], lo, hi) for c, d, lo, hi in pairs], "cell int, to int, groups int, lo int, hi int")
        kept = spark.createDataFrame([(d, groups[d], *needed[d]) for d in groups], "to int, groups int, lo int, hi int")
        group = F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.col("groups")).cast("int").alias("group")
        queries = left.join(sent, "cell").select("to", group, F.explode(F.sequence("lo", F.col("hi") - 1)).alias("block"), "vec_id", "v", "least")
        rows = one.join(kept, "to").where("block >= lo and block < hi").select("to", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "block", "vec_id", "v")
        # new names: both sides come from one table
        rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])
        by = ("to", "block", "group")
        return queries.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(run, "query_id long, vec_id long, score long")

    # first one block for each cell of queries
    start = met(two.withColumn("least", F.lit(float("-inf"))), [(c, first[c], 0, 1) for c in counts]) if counts else spark.createDataFrame([], "query_id long, vec_id long, score long")
    seeds = scratch.write(start, "seeds")
    least = seeds.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").cast("double").alias("s"))
    seeded = two.join(least, "vec_id", "left").withColumn("least", F.when(F.col("n") >= k, F.col("s")).otherwise(F.lit(float("-inf")))).drop("n", "s")
    seeded = scratch.write(seeded, "seeded")
    floor_ = {r["cell"]: r["s"] for r in seeded.groupBy("cell").agg(F.min("least").alias("s")).collect()}
    rest = [(c, int(d), int(d == first[c]), blocks[int(d)]) for c in counts for d in np.flatnonzero((top[c] >= floor_.get(c, -np.inf)) & (top[c] > -np.inf))]
    rest = [x for x in rest if x[2] < x[3]]
    every = seeds.unionByName(met(seeded, rest)) if rest else seeds
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
