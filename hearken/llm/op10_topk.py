"""Exact top-k search by inner product with M-trees and best-first search.

The rows are dealt to shards of bounded size. A shard is one M-tree of pages: an inner page holds children with their
routing vector, covering radius and distance to the page's own routing vector; a leaf page holds rows with that
distance. For a query q nothing under a node scores more than <q, r> + |q| * radius, and, before <q, r> is known, more
than <q, parent> + |q| * (distance to the parent + radius). Nodes are taken from a queue by falling bounds until the
k-th score passes the next one; the stored distances spare the inner products of children and rows that can't enter.

Trees are built once and written; a task holds one tree and reads the queries, which are written too, block by block.
So rows aren't copied for blocks of queries, and only k rows a query leave a shard.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearken.llm.common import file_system, new_path, written

#: Rows of a leaf page, children of an inner page, rows of a shard, queries that a task holds at a time.
PAGE, FANOUT, SHARD_ROWS, BLOCK_ROWS = 128, 16, 16_384, 1024
_EXACT = 2.0**53  # products whose norms stay below it are sums of exact doubles
_LONG = 2**63


def _far(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances from p, rounded up."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(np.sqrt(((x - p) ** 2).sum(1)) * (1 + 1e-9) + 1e-6, nan=np.inf)


def _low(score: int) -> float:
    """A double at or below an exact score."""
    try:
        return float(score) - abs(float(score)) * 1e-15
    except OverflowError:
        return float(np.finfo(float).max) if score > 0 else -np.inf


class MTree:
    """A tree over rows x (integers as doubles) with ids. Node n is a leaf with rows or has children; arrays are by node."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, page: int = PAGE, fanout: int = FANOUT):
        self.ids, self.x = ids, x
        self.router: list[np.ndarray] = []
        self.radius: list[float] = []
        #: Of a page: leaf?, rows or nodes, their distances to the router, their vectors or routers, and radii or norms.
        self.members: list[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.norms = np.sqrt((x**2).sum(1)) if len(x) else np.zeros(0)
        self.most = float(self.norms.max(initial=0.0))
        self.top = self._node(np.arange(len(ids)), page, fanout)

    def _halves(self, rows: np.ndarray) -> list[np.ndarray]:
        own = self.x[rows]
        a = own[np.argmax(((own - own[0]) ** 2).sum(1))]
        b = own[np.argmax(((own - a) ** 2).sum(1))]
        scale = np.abs(b - a).max() or 1.0
        order = np.argsort(own @ ((b - a) / scale), kind="stable")
        return [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]

    def _node(self, rows: np.ndarray, page: int, fanout: int) -> int:
        me = len(self.router)
        router = self.x[rows].mean(0) if len(rows) else np.zeros(self.x.shape[1])
        self.router.append(router)
        self.radius.append(0.0)
        self.members.append((True, rows, np.zeros(0), self.x[:0], np.zeros(0)))
        d = _far(self.x[rows], router)
        self.radius[me] = float(d.max()) if len(d) else 0.0
        if len(rows) <= page:
            order = np.argsort(-d, kind="stable")  # those within a bound are a prefix
            rows = rows[order]
            self.members[me] = (True, self.ids[rows], d[order], self.x[rows], self.norms[rows])
            return me
        parts = [rows]
        while len(parts) < fanout and max(map(len, parts)) > page:
            big = max(range(len(parts)), key=lambda k: len(parts[k]))
            parts += self._halves(parts.pop(big))
        kids = np.array([self._node(p, page, fanout) for p in parts])
        routers = np.stack([self.router[k] for k in kids])
        self.members[me] = (False, kids, _far(routers, router), routers, np.array([self.radius[k] for k in kids]))
        return me

    @staticmethod
    def _scores(q: np.ndarray, norm: float, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Exact inner products: by doubles where they can't round, else by integers, brought into the range of a long."""
        if norm * norms.max(initial=0.0) < _EXACT:
            return (x @ q).astype(np.int64)
        own = [int(a) for a in q]
        return np.array([min(max(sum(a * int(b) for a, b in zip(own, row, strict=True)), -_LONG), _LONG - 1) for row in x.tolist()], np.int64)

    def search(self, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), highest first, ties to smaller ids, of rows that don't bear the id `own`."""
        norm = float(np.sqrt((q**2).sum()))
        reach = norm * (1 + 1e-9)
        at = float(q @ self.router[self.top])
        more = 1e-6 + 1e-9 * reach * self.most  # for what doubles may have lost
        queue = [(-np.inf, self.top, at)]
        best: list[tuple[int, int]] = []  # a heap: the worst first, as (score, -id)
        while queue:
            bound, node, at = heapq.heappop(queue)
            full = len(best) == k
            least = _low(best[0][0]) if full else -np.inf
            if -bound < least:
                break
            leaf, kids, d, vectors, sizes = self.members[node]
            # by the product with the page's router alone: a row's or a child's distance to it bounds what they can add
            up = at + 1e-6 * abs(at) + more + reach * (d if leaf else d + sizes)
            if np.isnan(up).any():
                up = np.nan_to_num(up, nan=np.inf)
            if leaf:
                n = len(d) if up[-1:] >= least else int(np.searchsorted(-up, -least, side="right"))
                s = self._scores(q, norm, vectors[:n], sizes[:n])
                good = np.flatnonzero(s >= best[0][0]) if full else range(n)
                for j in good:
                    i, score = int(kids[j]), int(s[j])
                    if i == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -i))
                    elif (score, -i) > best[0]:
                        heapq.heapreplace(best, (score, -i))
                continue
            some = np.flatnonzero(up >= least)
            v = vectors[some] @ q
            tops = v + 1e-6 * np.abs(v) + more + reach * sizes[some]
            if np.isnan(tops).any():
                tops = np.nan_to_num(tops, nan=np.inf)
            for top, c, x in zip(tops.tolist(), kids[some].tolist(), v.tolist(), strict=True):
                if top >= least:
                    heapq.heappush(queue, (-top, c, x))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, d, v (256 * x in doubles, rounded down) of the vectors that take part: an id, no null or non-finite part."""
    v = F.transform("embedding", lambda x: x.cast("double") * 256)
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("d"), v.alias("v"))


def _matrix(column: pa.Array, n: int, d: int) -> np.ndarray:
    return np.floor(np.asarray(column.flatten(), dtype=float)).reshape(n, d)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product for each query (vec_id % every = 0).

    Only vectors of one length are compared. Vectors that are null or hold null or non-finite parts, and rows
    without vec_id, take no part; a row is no candidate for a query with its id; copies of a row are candidates of
    their own (a repeated query is answered once); fewer than k candidates give fewer rows. Scores are exact; one
    beyond a long is the nearest long, and ranks as that. Components beyond 2**1016 are out of range (an error).
    Other columns are ignored; no vectors give no rows.
    """
    spark = vectors.sparkSession
    own = written(integer_vectors(vectors), "vectors")
    sizes = {r["d"]: r["n"] for r in own.groupBy("d").agg(F.count("*").alias("n")).collect()}  # by length of vector
    shards = max(1, -(-sum(sizes.values()) // SHARD_ROWS))
    path = new_path(spark, "queries")
    asked = own.where(F.col("vec_id") % every == 0).groupBy("d", "vec_id").agg(F.min("v").alias("v"))
    asked.write.partitionBy("d").parquet(path)

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        d = key[1].as_py()
        x = _matrix(rows["v"].combine_chunks(), rows.num_rows, d)
        if not np.isfinite(x).all():
            raise ValueError("a component is out of range")
        return pa.table({"d": pa.array([d], pa.int32()), "tree": pa.array([pickle.dumps(MTree(np.asarray(rows["vec_id"]), x))], pa.binary())})

    # numbers of places, not ids, so that copies of an id spread over the shards
    placed = own.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    trees = written(placed.groupBy("shard", "d").applyInArrow(build, "d int, tree binary"), "trees")

    def blocks(d: int) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(f"{path}/d={d}")
        for info in fs.get_file_info(pa.fs.FileSelector(at, allow_not_found=True)):
            if info.path.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    yield from pq.ParquetFile(f).iter_batches(BLOCK_ROWS, columns=["vec_id", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tree = pickle.loads(stored.as_buffer())
                for block in blocks(d):
                    out: tuple[list, list, list] = ([], [], [])
                    ids = block.column(0).to_pylist()
                    for i, q in zip(ids, _matrix(block.column(1), len(ids), d), strict=True):
                        for s, j in tree.search(q, i, k):
                            out[0].append(i)
                            out[1].append(j)
                            out[2].append(s)
                    yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["query_id", "vec_id", "score"])

    # a task for a tree: they are few, and each is much work
    found = trees.repartition(max(1, shards * len(sizes)), "d", F.xxhash64("tree")).mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
