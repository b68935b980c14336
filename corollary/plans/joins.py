"""The order of joins: join trees for acyclic bodies, one variable at a time for cyclic ones.

An acyclic body has a join tree: atoms are taken off one by one, each with all that it shares with the rest in
one other atom, its parent. Where estimates say that a join on the way would make far more rows than all atoms have, which
is what reducing costs, every atom is first reduced to the rows that have partners below it in the tree (semi-joins from
the leaves to the root); from the root down each join then only makes rows that are part of an answer.

A cyclic body (a triangle, a square) has no such tree, and joining two of its atoms first may make the square
of a hub's degree. Its variables are bound one at a time instead. Each binding so far takes the values of the
next variable from the atom that offers it the fewest (degrees are counted once per atom), and the other atoms
with that variable only keep or drop them. The rows made are bounded by what any body of this form can answer
for atoms of these sizes, whatever the degrees: for a triangle of n facts each, n to the power of 1.5.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bodies are reduced first if a join on the way is estimated to make so many times the rows that are read.
FAR_MORE = 4


@dataclass(frozen=True)
class Size:
    """Rows, and distinct values by column."""

    rows: float
    distinct: dict[str, float]

    def join(self, other: Size) -> Size:
        both = self.distinct.keys() & other.distinct.keys()
        rows = self.rows * other.rows
        for c in both:
            rows /= max(self.distinct[c], other.distinct[c], 1)
        values = {c: min(d[c] for d in (self.distinct, other.distinct) if c in d) for c in self.distinct.keys() | other.distinct.keys()}
        return Size(rows, {c: min(v, rows) for c, v in values.items()})


def join_tree(columns: list[set[str]]) -> list[tuple[int, int]] | None:
    """(part, its parent), leaves first, the root left out; None if the body is cyclic. Parts that share
    nothing hang anywhere."""
    left, out = list(range(len(columns))), []
    while len(left) > 1:
        ear = None
        for i in left:
            others = [j for j in left if j != i]
            shared = columns[i] & set().union(*(columns[j] for j in others))
            hosts = [j for j in others if shared <= columns[j]]
            if hosts:
                # where it shares most, so that a product is the last resort
                ear = i, max(hosts, key=lambda j: (len(columns[i] & columns[j]), -j))
                break
        if ear is None:
            return None
        out.append(ear)
        left.remove(ear[0])
    return out


def order(sizes: list[Size]) -> tuple[list[int], float, float]:
    """Parts in the order of joining, each next one with the fewest rows estimated, a product only where nothing
    is shared; the most rows of a step but the last, and those of the last."""
    todo = list(range(len(sizes)))
    first = min(todo, key=lambda i: (sizes[i].rows, i))
    todo.remove(first)
    out, cur, most = [first], sizes[first], 0.0
    while todo:
        tied = [i for i in todo if cur.distinct.keys() & sizes[i].distinct.keys()]
        best = min(tied or todo, key=lambda i: (cur.join(sizes[i]).rows, i))
        todo.remove(best)
        out.append(best)
        cur = cur.join(sizes[best])
        if todo:
            most = max(most, cur.rows)
    return out, most, cur.rows


def common(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def semi(df: DataFrame, by: DataFrame) -> DataFrame:
    on = common(df, by)
    # without a common variable the atom only has to have a row
    return df.join(by.select(*on), on, "left_semi") if on else df.join(by.limit(1).select(F.lit(1).alias("_there")), F.lit(True), "left_semi")


def _join(a: DataFrame, b: DataFrame) -> DataFrame:
    on = common(a, b)
    return a.join(b, on) if on else a.crossJoin(b)  # the query itself asks for a product


def reduced(parts: list[DataFrame], tree: list[tuple[int, int]]) -> DataFrame:
    """The join along the tree, every part reduced by those below it first."""
    parts = list(parts)
    for i, up in tree:
        parts[up] = semi(parts[up], parts[i])
    root = ({*range(len(parts))} - {i for i, _ in tree}).pop()
    return reduce(_join, [parts[i] for i, _ in reversed(tree)], parts[root])


def in_order(parts: list[DataFrame], sizes: list[Size] | None) -> DataFrame:
    """The join of an acyclic body: as the sizes tell, or in the order of the text, products last."""
    if sizes is not None:
        places, most, _ = order(sizes)
        tree = join_tree([set(p.columns) for p in parts])
        if tree and most > FAR_MORE * sum(s.rows for s in sizes):
            return reduced(parts, tree)
        return reduce(_join, [parts[i] for i in places])
    parts = list(parts)
    out = parts.pop(0)
    while parts:
        out = _join(out, parts.pop(next((k for k, p in enumerate(parts) if common(out, p)), 0)))
    return out


def one_by_one(parts: list[DataFrame], sizes: list[Size] | None = None) -> DataFrame:
    """The join of a body whose parts have one or two columns, a variable at a time."""
    first = min(range(len(parts)), key=lambda i: (sizes[i].rows if sizes else 0, -len(parts[i].columns), i))
    cur, left = parts[first], [p for i, p in enumerate(parts) if i != first]
    while left:
        closed = next((p for p in left if set(p.columns) <= set(cur.columns)), None)
        if closed is not None:
            cur = semi(cur, closed)
            left = [p for p in left if p is not closed]
            continue
        # the next variable: the one that most parts tie to what is bound
        offers: dict[str, list[DataFrame]] = {}
        for p in left:
            new = [c for c in p.columns if c not in cur.columns]
            if len(new) == 1:
                offers.setdefault(new[0], []).append(p)
        tied = {v: [p for p in ps if len(p.columns) == 2] for v, ps in offers.items()}
        if not any(tied.values()):
            cur = _join(cur, left.pop(0))
            continue
        v = max(tied, key=lambda v: (len(tied[v]), v))
        cur = _bind(cur, tied[v], v)
        left = [p for p in left if not any(p is q for q in tied[v])]
    return cur


def _bind(cur: DataFrame, offers: list[DataFrame], v: str) -> DataFrame:
    """cur with the values of v that all the offers have for it."""
    if len(offers) == 1:
        return _join(cur, offers[0])
    by = [next(c for c in p.columns if c != v) for p in offers]
    names = cur.columns
    for i, (p, c) in enumerate(zip(offers, by)):  # no partner, no row
        cur = cur.join(p.groupBy(c).agg(F.count("*").alias(f"_degree{i}")), c)
    fewest = F.least(*(F.col(f"_degree{i}") for i in range(len(offers))))
    place = F.coalesce(*(F.when(F.col(f"_degree{i}") == fewest, i) for i in range(len(offers))))
    cur = cur.withColumn("_from", place).select(*names, "_from")
    found = []
    for i, p in enumerate(offers):
        some = cur.where(F.col("_from") == i).drop("_from").join(p, by[i])
        found.append(reduce(semi, [q for k, q in enumerate(offers) if k != i], some).select(*names, v))
    return reduce(DataFrame.unionByName, found)
