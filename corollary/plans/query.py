"""Conjunctive queries as DataFrames.

An atom is a scan of its relation with its constants and repeated variables as filters, its columns
named by its variables. Atoms that are left with the same variables, such as those of a star, meet in one
aggregate: a key stays if every atom has it, so each atom is shuffled once, with at most one row a key
from each map task, and nothing is sorted or joined. Atoms that only restrict others are taken next, as
left semi-joins (an atom can go when what it shares with the rest is within one other atom and none of its
own variables is asked for); what is left is joined. Catalyst picks the physical joins.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corollary.plans.joins import Size, in_order, join_tree, one_by_one, semi
from corollary.plans.terms import CQ, UCQ, Atom, Const, Var

if TYPE_CHECKING:
    from corollary.plans.twins import Squares

#: Rows of a star's smaller atoms together up to which they are broadcast.
SMALL = 1 << 20


def scan(kb, atom: Atom, bag: bool = False) -> DataFrame:
    """One distinct column per variable of the atom, named by it; bag: rows may be repeated."""
    df = kb.bag(atom.rel) if bag else kb.relation(atom.rel)
    first: dict[Var, Column] = {}
    for t, name in zip(atom.terms, ("s", "o")):
        if isinstance(t, Const):
            df = df.where(F.col(name) == F.lit(t.value))
        elif t in first:
            df = df.where(F.col(name) == first[t])
        else:
            first[t] = F.col(name)
    return df.select(*(c.alias(v.name) for v, c in first.items()))


def _size(kb, atom: Atom) -> Size | None:
    """The estimated size of the atom's scan, if the base has been measured."""
    known = kb.sizes.get(atom.rel) if kb.sizes is not None else None
    if kb.sizes is None:
        return None
    rows, distinct = (known.rows, (known.subjects, known.objects)) if known else (0, (0, 0))
    values: dict[str, float] = {}
    for t, d in zip(atom.terms, distinct):
        if isinstance(t, Const) or t.name in values:
            rows /= max(d, 1)
        if isinstance(t, Var):
            values[t.name] = min(d, values.get(t.name, d))
    return Size(rows, {n: min(d, rows) for n, d in values.items()})


def _meet(parts: list[DataFrame]) -> DataFrame:
    """The rows that all parts have; they have the same columns."""
    names = parts[0].columns
    tagged = [p.select(*names, F.lit(1 << i).alias("_in")) for i, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, tagged).groupBy(*names).agg(F.bit_or("_in").alias("_in"))
    return every.where(F.col("_in") == (1 << len(parts)) - 1).select(*names)


def _star(parts: list[tuple[DataFrame, float | None]]) -> list[DataFrame]:
    """Parts with the same columns, each with the rows of its relation, if known: all but the largest are
    broadcast if they are small together, else all meet in one aggregate."""
    if all(n is not None for _, n in parts):
        small = sorted(parts, key=lambda p: p[1])
        if sum(n for _, n in small[:-1]) <= SMALL:
            return [reduce(lambda a, b: a.join(F.broadcast(b), b.columns, "left_semi"), (p for p, _ in small[:-1]), small[-1][0])]
    frames = [p for p, _ in parts]
    # as many at once as an integer has bits
    return [_meet(frames[i : i + 30]) if len(frames[i : i + 30]) > 1 else frames[i] for i in range(0, len(frames), 30)]


def body(kb, q: CQ, reduce_by_semi_joins: bool = True) -> DataFrame:
    """The bindings of the query's variables that its answer needs (others may be gone)."""
    if not q.atoms:
        raise ValueError("a query without atoms")
    asked = {t.name for t in q.answer if isinstance(t, Var)}
    parts = [scan(kb, a) for a in q.atoms]
    sizes: dict[frozenset[str], Size] = {}  # by columns, which tell parts apart once those alike have met
    given = [_size(kb, a) for a in q.atoms]

    def told(part: DataFrame, size: Size | None) -> None:
        key = frozenset(part.columns)
        if size and (key not in sizes or size.rows < sizes[key].rows):
            sizes[key] = size

    going, thin = reduce_by_semi_joins, set()
    if going and len(parts) > 1:
        # an atom's own variables that nobody asks for go first
        for i, p in enumerate(parts):
            kept = [c for c in p.columns if c in asked or any(c in o.columns for o in parts[:i] + parts[i + 1 :])]
            if len(kept) < len(p.columns):
                parts[i] = scan(kb, q.atoms[i], bag=True).select(*kept)  # repeats as the rest of its columns would leave
                thin.add(frozenset(kept))
                if given[i]:
                    values = {c: given[i].distinct[c] for c in kept}
                    given[i] = Size(max(values.values(), default=1), values)
        alike: dict[frozenset[str], list[tuple[DataFrame, float | None]]] = {}
        for p, size, a in zip(parts, given, q.atoms):
            read = kb.sizes[a.rel].rows if kb.sizes is not None and a.rel in kb.sizes else None
            alike.setdefault(frozenset(p.columns), []).append((p, read))
            told(p, size)
        parts = []
        for some in alike.values():
            parts += _star(some) if some[0][0].columns and len(some) > 1 else [p for p, _ in some]
    else:
        for p, size in zip(parts, given):
            told(p, size)
    while going and len(parts) > 1:
        going = False
        for i in range(len(parts) - 1, -1, -1):
            p, others = parts[i], parts[:i] + parts[i + 1 :]
            shared = {c for c in p.columns if any(c in o.columns for o in others)}
            if (set(p.columns) - shared) & asked:
                continue
            # the first atom that has them all: the atoms of a star then meet one host, side by side,
            # in one partitioning, instead of a chain of nested semi-joins
            host = next((k for k, o in enumerate(others) if shared <= set(o.columns)), None)
            # a variable asked for stays in its host, so nothing that is asked for is lost
            if host is not None:
                others[host] = semi(others[host], p)
                parts, going = others, True
                break
    if reduce_by_semi_joins and len(parts) > 1:  # repeated rows of joined parts would multiply
        parts = [p.distinct() if frozenset(p.columns) in thin else p for p in parts]
    known = [sizes[frozenset(p.columns)] for p in parts] if all(frozenset(p.columns) in sizes for p in parts) else None
    if reduce_by_semi_joins and len(parts) > 2 and join_tree([set(p.columns) for p in parts]) is None:
        return one_by_one(parts, known)
    return in_order(parts, known)


def answer(kb, q: CQ | UCQ, reduce_by_semi_joins: bool = True) -> DataFrame:
    """Distinct answers in columns x0, x1, ... A query that asks for nothing gives one row with column
    ``holds`` if it has a match, none otherwise."""
    if isinstance(q, tuple) and len(q) > 1:
        return reduce(DataFrame.unionByName, (_rows(kb, one, reduce_by_semi_joins) for one in q)).distinct()
    (one,) = q if isinstance(q, tuple) else (q,)
    if len(one.atoms) == 1 and len(one.atoms[0].variables) == 2 and set(one.answer) >= one.atoms[0].variables:
        return _rows(kb, one, reduce_by_semi_joins)  # a relation is a set
    if _squares(one):
        return squares(kb, one, reduce_by_semi_joins).facts().toDF("x0", "x1")
    return _rows(kb, one, reduce_by_semi_joins).distinct()


def squares(kb, q: CQ, reduce_by_semi_joins: bool = True) -> Squares | None:
    """The answers as pairs of classes, if they are pairs of entities that share a partner."""
    if not _squares(q):
        return None
    from corollary.plans.twins import Squares, Twins

    twins = Twins(kb, {q.atoms[0].rel}, written=False)
    return Squares(twins, _rows(twins.kb, q, reduce_by_semi_joins).distinct())


def repeated(kb, q: CQ) -> DataFrame:
    """The answers, some of them perhaps more than once: for readers that remove repeats anyway."""
    return answer(kb, q) if _squares(q) else _rows(kb, q, True)


def _squares(q: CQ) -> bool:
    """Whether the answers are the pairs of entities that share a partner in one relation: no fewer than the square
    of each partner's facts."""
    if len(q.atoms) != 2 or len(set(q.answer)) != 2 or len(q.answer) != 2 or not all(isinstance(t, Var) for t in q.answer):
        return False
    a, b = q.atoms
    if a.rel != b.rel or len(a.variables) != 2 or len(b.variables) != 2:
        return False
    return any(a.terms[i] == b.terms[i] and {a.terms[1 - i], b.terms[1 - i]} == set(q.answer) for i in (0, 1))


def _rows(kb, q: CQ, semi: bool) -> DataFrame:
    free = {t for t in q.answer if isinstance(t, Var)} - q.variables
    if free:
        raise ValueError(f"unsafe: {', '.join(map(str, free))} in the answer of {q}")
    df = body(kb, q, semi)
    if not q.answer:
        return df.limit(1).select(F.lit(1).alias("holds"))
    return df.select(*((F.col(t.name) if isinstance(t, Var) else F.lit(t.value).cast("long")).alias(f"x{i}") for i, t in enumerate(q.answer)))


def holds(kb, q: CQ) -> bool:
    return not body(kb, q).isEmpty()


def full_body(kb, q: CQ) -> DataFrame:
    """Distinct rows of all body columns: b0_s, b0_o, b1_s, ..."""
    return _provenance(kb, q).select(*_body_columns(q)).distinct()


def provenance(kb, q: CQ) -> DataFrame:
    """Every match: the answer (x0, x1, ...) with all body columns (b0_s, b0_o, ...)."""
    head = [(F.col(t.name) if isinstance(t, Var) else F.lit(t.value).cast("long")).alias(f"x{i}") for i, t in enumerate(q.answer)]
    return _provenance(kb, q).select(*head, *_body_columns(q))


def _provenance(kb, q: CQ) -> DataFrame:
    return body(kb, CQ(tuple(sorted(q.variables)), q.atoms), reduce_by_semi_joins=False)


def _body_columns(q: CQ) -> list[Column]:
    return [(F.col(t.name) if isinstance(t, Var) else F.lit(t.value).cast("long")).alias(f"b{i}_{n}") for i, a in enumerate(q.atoms) for t, n in zip(a.terms, ("s", "o"))]
