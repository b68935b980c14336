"""Hard negatives: rows of another label that score close to an anchor's positives, by inner product.

Vectors become integers, floor(scale * x). An orthogonal rotation onto the principal axes of all rows (their
second moments, summed in Spark; one small matrix per dimension) moves most of each product into the leading
components. An anchor's product with a row is accumulated over these in steps; what is left of it is at most
the product of the two residual norms, plus slack for the rounding of all float steps. A row that cannot reach
what the anchor still looks for is discarded early, after few components; survivors are scored by integer
products, so the result is exact and does not depend on the rotation.

Rows are dealt by a hash into blocks, anchors into groups, both of about ``cells`` components; every block
meets every group once, so a task holds one of each, whatever the table's size, and labels, however large, are
dealt like all rows. Two such passes over the same packed blocks: the first finds each anchor's positives (best
``positives`` rows of its label), the second knows their scores and finds for each the best ``negatives`` rows
of other labels with low * positive <= 100 * negative <= high * positive. From each block an anchor takes only
its best few. As every anchor is asked of every block, work grows with rows times anchors.

Rows with a null id, label or vector, or any null or non-finite component, take no part. Vectors of different
dimension do not meet, a row with an anchor's own id is neither its positive nor its negative. Ties go to the
smaller id; equal rows keep their own places. An anchor that stands in several equal rows is asked once, in
rows that differ each by itself. Positives with equal scores have the same negatives. Scores are exact integers
whatever the components' size; one beyond 64 bits raises OverflowError. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corollary.llm.common import checkpoint

#: Components (rows times dimension) of a block and of a group of anchors: the least, and the most.
CELLS, MOST_CELLS = 1 << 18, 1 << 22
#: Blocks grow only beyond so many.
BLOCKS = 64
#: Leading components of the rotation, and after how many of them rows are discarded.
LEADING, STEPS = 64, (8, 24)
#: Every so many-th row of a block is scored first; pairs are looked at one by one once so few are left.
SEEDS, FEW = 8, 32
#: Cells of a table of anchors by rows.
TILE = 1 << 20


def _rows(df: DataFrame, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, label, v, dim of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("x"))
    number = lambda c: c.cast("double")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(number(c)) | (F.abs(number(c)) == float("inf")))
    v = F.transform("x", lambda c: F.floor(number(c) * scale).cast("long"))
    return rows.dropna().where(~bad & (F.size("x") > 0)).select("id", "label", v.alias("v"), F.size("x").alias("dim"))


def axes(rows: DataFrame) -> DataFrame:
    """dim, basis (the leading principal axes, float64 bytes). A task adds up the outer products of its rows;
    the sums meet cell by cell, so one dimension's square is all that comes together."""

    def moments(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            dims = np.asarray(b.column("dim"), np.int64)
            flat, ends = np.asarray(b.column("v").flatten(), np.float64), np.cumsum(dims)
            for dim in np.unique(dims).tolist():
                x = flat[(ends[dims == dim] - dim)[:, None] + np.arange(dim)]
                held[dim] = held.get(dim, 0) + x.T @ x
            if sum(m.size for m in held.values()) > MOST_CELLS:
                yield from told(held)
                held = {}
        yield from told(held)

    def told(held):
        for dim, m in held.items():
            for row in range(dim):
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "row": pa.array([row], pa.int32()), "m": pa.array([m[row].tolist()], pa.list_(pa.float64()))})

    def rotation(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        m = np.zeros((dim, dim))
        m[np.asarray(t.column("row")), np.asarray(t.column("place"))] = np.asarray(t.column("m"))
        good = np.isfinite(m).all() and m.any()
        basis = np.linalg.eigh(m / np.abs(m).max())[1][:, ::-1] if good else np.eye(dim)
        return pa.table({"dim": pa.array([dim], pa.int32()), "basis": pa.array([np.ascontiguousarray(basis[:, :LEADING]).tobytes()], pa.binary())})

    sums = rows.select("dim", "v").mapInArrow(moments, "dim int, row int, m array<double>")
    cells = sums.select("dim", "row", F.posexplode("m").alias("place", "m")).groupBy("dim", "row", "place").agg(F.sum("m").alias("m"))
    return cells.groupBy("dim").applyInArrow(rotation, "dim int, basis binary")


_SIDE = "dim int, part long, ids binary, labels binary, vectors binary, goals binary"


def _packed(rows: DataFrame, count: int) -> DataFrame:
    """One row per dimension and part: ids, labels and vectors by label and id, the vectors in the narrowest
    integers that hold them; goals, if the rows have them."""
    goals = "goals" in rows.columns

    def pack(t: pa.Table) -> pa.Table:
        ids, labels = np.asarray(t.column("id"), "<i8"), np.asarray(t.column("label"), "<i8")
        order = np.lexsort((ids, labels))
        lists = lambda c: np.asarray(t.column(c).combine_chunks().flatten(), "<i8").reshape(len(ids), -1)[order]
        v = lists("v")
        kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or (v.min() >= np.iinfo(k).min and v.max() <= np.iinfo(k).max))
        out = {"ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "vectors": kind.encode() + v.astype(kind).tobytes(), "goals": lists("goals").tobytes() if goals else b""}
        return pa.table({"dim": pa.array([t.column("dim")[0].as_py()], pa.int32()), "part": pa.array([t.column("part")[0].as_py()], pa.int64())} | {n: pa.array([x], pa.binary()) for n, x in out.items()})

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", "v", "label"), F.lit(count)))
    return dealt.groupBy("dim", "part").applyInArrow(pack, _SIDE)


class Side:
    """A block of rows or a group of anchors, rotated. Rows are in the order of labels."""

    def __init__(self, t: pa.Table, basis: np.ndarray):
        self.ids, self.labels = (np.frombuffer(t.column(c)[0].as_py(), "<i8") for c in ("ids", "labels"))
        raw = t.column("vectors")[0].as_py()
        self.v = np.frombuffer(raw, raw[:3].decode(), offset=3).reshape(len(self.ids), -1)
        self.goals = np.frombuffer(t.column("goals")[0].as_py(), "<i8").reshape(len(self.ids), -1)
        x = self.v.astype(np.float64)
        self.lead = x @ basis
        rest = np.linalg.norm(x - self.lead @ basis.T, axis=1)
        tails = np.sqrt(np.cumsum((self.lead**2)[:, ::-1], axis=1)[:, ::-1])
        #: tails[:, r]: norm of all but the first r leading components
        self.tails = np.hypot(np.concatenate([tails, np.zeros((len(x), 1))], axis=1), rest[:, None])
        self.norm = np.linalg.norm(x, axis=1)
        self.largest = max(-int(self.v.min()), int(self.v.max()))

    def by_label(self) -> dict[int, range]:
        """Places of each label."""
        cuts = [0, *(np.flatnonzero(np.diff(self.labels)) + 1).tolist(), len(self.labels)]
        return {int(self.labels[a]): range(a, b) for a, b in zip(cuts, cuts[1:])}


def slack(basis: np.ndarray) -> float:
    """Rounding of a product in the rotated space, as a share of the two norms' product: how far the axes are
    from orthonormal, and the float steps of rotation, norms and sums."""
    dim, lead = basis.shape
    off = np.abs(basis.T @ basis - np.eye(lead)).sum()
    return float(4 * off + 64 * (dim + lead + 16) * np.finfo(float).eps)


def products(a: Side, i: np.ndarray, x: Side, j: np.ndarray) -> np.ndarray:
    """Exact integer products of anchors i with rows j, pair by pair."""
    bound = a.v.shape[1] * a.largest * x.largest  # no sum is over this
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
    out = np.zeros(len(i), np.int64 if bound < 1 << 63 else object)
    step = max(1, TILE // a.v.shape[1])
    for at in range(0, len(i), step):
        p, q = a.v[i[at : at + step]], x.v[j[at : at + step]]
        if kind is object:
            out[at : at + step] = [sum(s * t for s, t in zip(*two)) for two in zip(p.tolist(), q.tolist())]
        else:
            out[at : at + step] = np.einsum("ij,ij->i", p.astype(kind), q.astype(kind))
    return out


def search(a: Side, at: np.ndarray, x: Side, to: range, share: float, k: int, least: np.ndarray, most: np.ndarray, same: bool):
    """(anchors, rows, exact scores): pairs of anchors ``at`` with rows ``to`` of the same label or of others, without
    those that surely are not among the k best rows of any of the anchor's goals. least, most: a row per anchor, a
    column per goal; a goal with least > most wants nothing."""
    rows = slice(to.start, to.stop)
    width = a.lead.shape[1]
    steps = [0, *(s for s in STEPS if s < width), width]
    allowed = a.ids[at][:, None] != x.ids[rows][None, :]
    if not same:
        allowed &= a.labels[at][:, None] != x.labels[rows][None, :]
    with np.errstate(all="ignore"):
        need, cap = _reach(a, at, x, to, share, k, least, most, allowed)
        # what is left is at most the product of the residual norms, and the rounding of all steps
        root = np.sqrt(share)
        of_a, of_x = a.tails[at] + root * a.norm[at][:, None], x.tails[rows] + root * x.norm[rows][:, None]
        lead, other = a.lead[at], x.lead[rows]
        part = np.zeros(allowed.shape)
        for k_step, (before, now) in enumerate(zip(steps, steps[1:])):
            part += lead[:, before:now] @ other[:, before:now].T
            left = of_a[:, now][:, None] * of_x[:, now][None, :]
            # what overflows is told from nothing, and stays
            allowed &= ~((part + left < need[:, None]) | (part - left > cap[:, None]))
            if np.count_nonzero(allowed) * FEW < allowed.size:
                break
        i, j = np.nonzero(allowed)
        part = part[i, j]
        for before, now in zip(steps[k_step + 1 :], steps[k_step + 2 :]):
            part = part + np.einsum("ij,ij->i", lead[i, before:now], other[j, before:now])
            left = of_a[i, now] * of_x[j, now]
            keep = ~((part + left < need[i]) | (part - left > cap[i]))
            i, j, part = i[keep], j[keep], part[keep]
    return at[i], j + to.start, products(a, at[i], x, j + to.start)


def _reach(a: Side, at: np.ndarray, x: Side, to: range, share: float, k: int, least: np.ndarray, most: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a row must reach, and not exceed, to be of use for any goal of an anchor. Some rows are scored first:
    where k of them surely are within a goal's bounds, all others must reach the k-th."""
    some = np.arange(to.start, to.stop, SEEDS)
    score = a.v[at].astype(np.float64) @ x.v[some].astype(np.float64).T
    error = share * a.norm[at][:, None] * x.norm[some][None, :]
    low, high = score - error, score + error
    ok = allowed[:, some - to.start]
    need, cap = np.full(len(at), np.inf), np.full(len(at), -np.inf)
    for g in range(least.shape[1]):
        floor = least[:, g].astype(np.float64)
        if len(some) >= k:
            sure = np.where(ok & (low >= least[:, g][:, None]) & (high <= most[:, g][:, None]), low, -np.inf)
            floor = np.maximum(floor, np.partition(sure, len(some) - k, axis=1)[:, len(some) - k])
        wanted = least[:, g] <= most[:, g]
        need = np.where(wanted, np.minimum(need, floor), need)
        cap = np.where(wanted, np.maximum(cap, most[:, g]), cap)
    return need, cap


def best(i: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each anchor's k best, best first, ties by id."""
    order = np.array(sorted(range(len(i)), key=lambda p: (i[p], -scores[p], ids[p])), np.int64) if scores.dtype == object else np.lexsort((ids, -scores, i))
    place = np.arange(len(i)) - np.searchsorted(i[order], i[order])
    return order[place < k]


_FOUND = "anchor_id long, ask long, goal int, id long, score long"


def _meet(blocks: DataFrame, anchors: DataFrame, count: int, groups: int, k: int, same: bool) -> DataFrame:
    """anchor_id, ask (the anchor's row), goal, id, score, rank: for each anchor and goal the k best rows of its
    label (one goal), or of other labels within the goal's bounds."""
    each = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    left = blocks.withColumnRenamed("part", "block").select("*", each(groups, "group"))
    right = _packed(anchors, groups).withColumnRenamed("part", "group").select("*", each(count, "block"))

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if c.num_rows and q.num_rows:
            basis = np.frombuffer(c.column("basis")[0].as_py()).reshape(c.column("dim")[0].as_py(), -1)
            x, a, share = Side(c, basis), Side(q, basis), slack(basis)
            every, by_label = range(len(x.ids)), x.by_label()
            tasks = [(at, by_label[label]) for label, at in a.by_label().items() if label in by_label] if same else [(range(len(a.ids)), every)]
            for places, to in tasks:
                step = max(1, TILE // len(to))
                for s in range(places.start, places.stop, step):
                    tile = np.arange(s, min(s + step, places.stop))
                    # goals: the ask, then least and most of each
                    least, most = (np.full((len(tile), 1), e) for e in (-np.inf, np.inf)) if same else (a.goals[tile, 1::2], a.goals[tile, 2::2])
                    i, j, scores = search(a, tile, x, to, share, k, least, most, same)
                    for g in range(least.shape[1]):
                        inside = (scores >= least[i - s, g]) & (scores <= most[i - s, g])
                        ii, jj, sc = i[inside], j[inside], scores[inside]
                        keep = best(ii, x.ids[jj], sc, k)
                        ii, jj = ii[keep], jj[keep]
                        out.append((a.ids[ii], a.goals[ii, 0], np.full(len(ii), g), x.ids[jj], sc[keep]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table({f.split()[0]: pa.array(c.tolist() if c.dtype == object else c, kind) for f, c, kind in zip(_FOUND.split(", "), columns, kinds)})

    keys = ["dim", "block", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, _FOUND)
    place = Window.partitionBy("anchor_id", "ask", "goal").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def mined(df: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, cells: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. anchor: which rows
    are anchors; label: a row's label, both over df's columns."""
    rows = _rows(df, label, id_col, vector_col, scale)
    asked = _rows(df.where(anchor), label, id_col, vector_col, scale).distinct().withColumn("ask", F.xxhash64("v", "label"))
    size, asked_size = ((d.agg(F.sum(F.col("dim").cast("long"))).first()[0] or 0) for d in (rows, asked))
    cells = cells or min(MOST_CELLS, max(CELLS, size // BLOCKS))
    count, groups = max(1, -(-size // cells)), max(1, -(-asked_size // cells))
    blocks = checkpoint(_packed(rows, count).join(axes(rows), "dim"))
    first = _meet(blocks, asked.withColumn("goals", F.array("ask")), count, groups, positives, True)
    chosen = checkpoint(first.select("anchor_id", "ask", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # a negative's bounds in whole numbers: 100 * score is within them if score is within these
    p = F.col("positive_score").cast("decimal(20,0)")
    bound = F.struct("place", F.ceil(p * low / 100).cast("long").alias("least"), F.floor(p * high / 100).cast("long").alias("most"))
    bounds = chosen.groupBy(F.col("anchor_id").alias("id"), "ask").agg(F.sort_array(F.collect_list(bound)).alias("bounds"))  # as many as positives
    none = F.struct(F.lit(0).alias("place"), F.lit(1).cast("long").alias("least"), F.lit(0).cast("long").alias("most"))
    filled = F.slice(F.concat("bounds", F.array_repeat(none, positives)), 1, positives)
    goals = F.concat(F.array("ask"), F.flatten(F.transform(filled, lambda g: F.array(g.least, g.most))))
    second = _meet(blocks, asked.join(bounds, ["id", "ask"]).withColumn("goals", goals), count, groups, negatives, False)
    near = second.select("anchor_id", "ask", (F.col("goal") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(near, ["anchor_id", "ask", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
