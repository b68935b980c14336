"""Queries over derived relations without unfolding them: a non-recursive program, layer by layer.

A union of conjunctive queries grows with the product of the rules along a path: fifteen relations with two rules
each have 2 ** 15 members. Here every derived atom that the query needs becomes a relation of its own, defined once
by the stored facts and the rules whose heads unify with it; rule bodies and the query read it under its name.
Constants go down into the definitions, so ``r(7, Y)`` only makes what it asks for, and atoms that are alike but
for the names of variables share one definition. Definitions that are read more than once are written to the shared
folder in the order in which they depend on each other, the others stay part of their reader's plan.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corollary.functions.lineage import checkpoint, dealt
from corollary.plans.logic import unify
from corollary.plans.query import answer, repeated
from corollary.plans.rewrite import NotRewritable, rewrite
from corollary.plans.terms import CQ, Atom, Rule, apart, canonical
from corollary.sources.kb import KnowledgeBase


#: Members of a union that are tried.
MOST = 2000


class Layers:
    """Definitions of the derived atoms that queries need: name -> (the atom, bodies by name)."""

    def __init__(self, rules: list[Rule]):
        self.by_head: dict[str, list[Rule]] = {}
        for r in rules:
            self.by_head.setdefault(r.head.rel, []).append(r)
        self.names: dict[Atom, str | None] = {}
        self.bodies: dict[str, tuple[Atom, list[CQ]]] = {}  # in order: a definition reads earlier ones only
        self.readers: dict[str, int] = {}

    def put(self, q: CQ) -> CQ:
        """The query over stored relations and definitions."""
        return CQ(q.answer, tuple(self._put(a) for a in q.atoms))

    def _put(self, atom: Atom) -> Atom:
        if atom.rel not in self.by_head:
            return atom
        like = canonical(CQ((), (atom,))).atoms[0]
        if like not in self.names:
            self.names[like] = None  # being defined
            bodies = []
            for rule in map(apart, self.by_head[atom.rel]):
                s = unify(like, rule.head)
                if s is not None:
                    bodies.append(self.put(CQ(rule.head.terms, rule.body).put(s)))
            name = f"\0layer{len(self.bodies)}"
            self.bodies[name] = like, bodies
            self.names[like] = name
        name = self.names[like]
        if name is None:
            raise NotRewritable(f"{atom.rel} depends on itself")
        self.readers[name] = self.readers.get(name, 0) + 1
        return Atom(name, atom.terms)

    def over(self, kb: KnowledgeBase) -> KnowledgeBase:
        """The base with the definitions as relations. Stored relations that several definitions read are written once, too.
        A definition's rows are dealt before repeats go, to as many tasks as what it reads has rows for."""
        out = KnowledgeBase(kb.spark, kb.relations)
        read = Counter(a.rel for _, bodies in self.bodies.values() for b in bodies for a in b.atoms)
        sizes: dict[str, int] = {}
        for n in read.keys() & kb.relations.keys():
            if read[n] > 1:
                out.relations[n] = checkpoint(kb.relation(n))
            sizes[n] = out.relation(n).count()
        for name, (like, bodies) in self.bodies.items():
            if like.rel in kb.relations and like.rel not in sizes:
                sizes[like.rel] = kb.relation(like.rel).count()
            parts = [repeated(out, q) for q in (CQ(like.terms, (like,)), *bodies)]
            rows = sizes.get(like.rel, 0) + sum(max(sizes.get(a.rel, 0) for a in b.atoms) for b in bodies)
            df = dealt(reduce(DataFrame.unionByName, parts), rows, "x0", "x1").distinct().select(F.col("x0").alias("s"), F.col("x1").alias("o"))
            written = self.readers.get(name, 0) > 1 and bool(bodies)
            out.relations[name] = checkpoint(df) if written else df
            sizes[name] = out.relations[name].count() if written else rows
        return out


def answer_layered(kb: KnowledgeBase, q: CQ, rules: list[Rule]) -> DataFrame:
    """The query's answers over the facts and all that the rules derive; NotRewritable if they are recursive."""
    layers = Layers(rules)
    q = layers.put(q)
    return answer(layers.over(kb), q)


def unfoldings(q: CQ, rules: list[Rule]) -> int:
    """How many members the query's union has before any is found to be another's; 1 where rules are recursive,
    whose unions only the rewriter can tell."""
    by_head: dict[str, list[Rule]] = {}
    for r in rules:
        by_head.setdefault(r.head.rel, []).append(r)
    known: dict[str, int | None] = {}

    def of(rel: str) -> int:
        if rel not in known:
            known[rel] = None
            known[rel] = 1 + sum(prod(of(a.rel) for a in r.body) for r in by_head.get(rel, ()))
        if known[rel] is None:
            raise NotRewritable(rel)
        return known[rel]

    try:
        return prod(of(a.rel) for a in q.atoms)
    except NotRewritable:
        return 1


def answer_derived(kb: KnowledgeBase, q: CQ, rules: list[Rule], **bounds: int) -> DataFrame:
    """The same in the best way that there is: as a union, if the rewriting stays within its bounds; layer by layer,
    if the rules that the query needs are not recursive; else over the closure of those rules."""
    try:
        if unfoldings(q, rules) <= bounds.get("most", MOST):
            return answer(kb, rewrite(q, rules, **bounds))
    except NotRewritable:
        pass
    try:
        return answer_layered(kb, q, rules)
    except NotRewritable:
        from corollary.operators.recover import closure

        need, todo = set(), {a.rel for a in q.atoms}
        while todo:
            need |= todo
            todo = {a.rel for r in rules if r.head.rel in todo for a in r.body} - need
        some = [r for r in rules if r.head.rel in need]
        base = KnowledgeBase(kb.spark, {n: df for n, df in kb.relations.items() if n in need})
        return answer(KnowledgeBase.from_facts(kb.spark, closure(base, some), sorted(need)), q)
