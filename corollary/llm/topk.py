"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors become integers, floor(scale * x). Candidates are dealt by a hash into blocks of about BLOCK
rows, queries into groups of about QUERIES; every block meets every group once, as two rows joined on
their numbers, so a task holds one block and one group whatever the table's size. In a block each
dimension has a list of its rows sorted by value. For a query the lists are read in parallel, each
from the end that its weight prefers; rows seen in any list get their full score by random access;
the bound is the score that a row at the present depth of every list would have. A row that is not
seen cannot beat it, so reading stops when the k-th score is over the bound (at equality an unseen
row could still tie with a smaller id). The blocks' top k meet in a ranked union: k rows per query
and block.

Null vectors, and those with null or non-finite components, take no part, nor do rows without id.
Vectors of different dimension do not meet. Rows with a query's own id are not its candidates. Ties
go to the smaller id; equal rows keep their own places, so a candidate that stands in several rows takes
several ranks. A query that stands in several rows is asked once. Scores are exact integers whatever the
components' size; one beyond 64 bits raises OverflowError. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERIES = 4096, 2048
#: Depths of sorted access, as shares of the block.
DEPTHS = (1 / 256, 1 / 64, 1 / 16, 1 / 4, 1)


def whole_numbers(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v (array of bigint), dim; only rows that take part."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return df.where(x.isNotNull() & ~bad & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(x).alias("dim"))


def _blocks(df: DataFrame, name: str, count: int) -> DataFrame:
    """One row per dimension and block: dim, block number, ids, vectors as bytes."""

    def pack(t: pa.Table) -> pa.Table:
        ids = np.asarray(t.column("id"), dtype="<i8")
        order = np.argsort(ids, kind="stable")
        flat = t.column("v").combine_chunks().flatten()
        v = np.asarray(flat, dtype="<i8").reshape(len(ids), -1)[order]
        return pa.table({"dim": pa.array([t.column("dim")[0].as_py()], pa.int32()), name: pa.array([t.column(name)[0].as_py()], pa.int64()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "vectors": pa.array([v.tobytes()], pa.binary())})

    dealt = df.withColumn(name, F.pmod(F.xxhash64("id", "v"), F.lit(count)))
    return dealt.groupBy("dim", name).applyInArrow(pack, f"dim int,{name} long,ids binary,vectors binary")


class Lists:
    """A block's rows with their sorted per-dimension lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.whole, self.x = vectors, vectors.astype(np.float64)
        self.largest = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))
        self.order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.sort(vectors, axis=0)

    def top(self, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows with another id than own, best first."""
        n = len(self.ids)
        used = np.flatnonzero(q)
        up = q[used] > 0
        # no sum is over this: float64 is exact below 2 ** 53, int64 below 2 ** 63, Python's integers always
        bound = len(q) * self.largest * max(int(q.max(initial=0)), -int(q.min(initial=0)))
        weights = q.astype(np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object)
        x = self.x if bound < 1 << 53 else self.whole
        seen = np.zeros(n, bool)
        best_scores, best_rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for share in DEPTHS:
            depth = max(1, int(np.ceil(n * share)))
            if depth >= n or not len(used):
                new = np.flatnonzero(~seen)
            else:
                touched = np.zeros(n, bool)
                touched[self.order[used[~up], :depth]] = True
                touched[self.order[used[up], n - depth :]] = True
                new = np.flatnonzero(touched & ~seen)
            seen[new] = True
            new = new[self.ids[new] != own]
            scores = np.concatenate([best_scores, (x[new].astype(weights.dtype, copy=False) @ weights).astype(np.int64)])
            rows = np.concatenate([best_rows, new])
            if len(scores) > 4 * k:  # rows are in order of id, so a stable cut by score keeps ties right
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= least
                scores, rows = scores[keep], rows[keep]
            order = np.lexsort((self.ids[rows], -scores))[:k]
            best_scores, best_rows = scores[order], rows[order]
            if depth >= n or not len(used):
                break
            edge = np.where(up, self.sorted[n - depth, used], self.sorted[depth - 1, used])
            if len(best_scores) == k and int(best_scores[-1]) > int(edge.astype(object) @ q[used].astype(object)):
                break
        return list(zip(best_scores.tolist(), self.ids[best_rows].tolist()))


def top_k(df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = BLOCK, group: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, all if fewer."""
    rows, asked = whole_numbers(df, id_col, vector_col, scale), whole_numbers(queries, id_col, vector_col, scale).distinct()
    n_blocks, n_groups = max(1, -(-df.count() // block)), max(1, -(-queries.count() // group))
    left = _blocks(rows, "block", n_blocks).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))))
    right = _blocks(asked, "part", n_groups).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))

    def search(c: pa.Table, q: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if c.num_rows and q.num_rows:
            dim = c.column("dim")[0].as_py()

            def read(t):
                ids = np.frombuffer(t.column("ids")[0].as_py(), "<i8")
                return ids, np.frombuffer(t.column("vectors")[0].as_py(), "<i8").reshape(len(ids), dim)

            lists = Lists(*read(c))
            for own, v in zip(*read(q)):
                for score, i in lists.top(v, int(own), k):
                    for name, x in zip(out, (int(own), i, score)):
                        out[name].append(x)
        return pa.table({name: pa.array(v, pa.int64()) for name, v in out.items()})

    keys = ["dim", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long,vec_id long,score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
