"""Rules as data: the bodies of any number of rules in a few joins.

A body is a shape and what fills it. The shape says which terms of its atoms are the same; relations, the
atoms' directions and constants are columns of small tables, a row per body, that the facts are joined with. So
thousands of rules are one branch per shape and one join per atom, and rules with the same body, or bodies
with the same first atoms, share them: a level's table has a row for each distinct beginning. A term that
nothing asks for any more goes at once, and repeated bindings with it.

What heads a body has is not joined per rule either: each distinct pair of a body meets the set of relations
that hold between its two terms, and counting by (body, relation) tells support and hits of every rule. The
pairs are shuffled by their terms once. Twins (``plans.twins``) are counted without being joined: pairs are of the
first entities of their classes, and weigh as much as both classes have members.

The rules' tables are as large as the rules, which the driver holds anyway; they are broadcast up to SMALL
rows, and joined as Spark sees fit beyond. Bodies whose atoms do not hang together (a product) are evaluated
one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corollary.plans.query import answer
from corollary.plans.terms import CQ, Const, Rule, Term, Var
from corollary.plans.twins import Twins

#: Rows of a rules' table that is broadcast.
SMALL = 100_000
#: So few bodies are planned one by one: Catalyst then sees the sizes of their own relations.
FEW = 8


@dataclass(frozen=True)
class Body:
    """atoms: two slots each, in the order of joining; head: the slots of the pair, the smaller first. Slots are
    numbers: constants first, then variables as they are met. An atom's relation comes with its direction:
    1 if its terms are swapped."""

    atoms: tuple[tuple[int, int], ...]
    head: tuple[int, int]
    rels: tuple[tuple[str, int], ...]
    constants: tuple[int, ...]

    @property
    def shape(self) -> tuple:
        return self.atoms, self.head, len(self.constants)


def as_body(rule: Rule) -> tuple[Body, int] | None:
    """The rule's body with the pair that its head asks for, and whether the head's terms are swapped; None if
    the atoms do not hang together."""
    constants = tuple(dict.fromkeys(t.value for a in (*rule.body, rule.head) for t in a.terms if isinstance(t, Const)))
    if any(not isinstance(c, int) for c in constants) or any(len(a.terms) != 2 for a in (*rule.body, rule.head)):
        return None
    slot: dict[Term, int] = {Const(c): i for i, c in enumerate(constants)}
    left, atoms, rels = list(rule.body), [], []
    first = next((t for t in rule.head.terms if isinstance(t, Var)), None)
    while left:
        # most known terms first, so that what closes a cycle filters early; at the start the head's term
        best = max(left, key=lambda a: (sum(t in slot for t in a.terms), not atoms and first in a.terms, -left.index(a)))
        if atoms and not any(t in slot for t in best.terms):
            return None
        left.remove(best)
        s, o = best.terms
        flipped = s not in slot and (o in slot or (o == first and s != first))
        s, o = (o, s) if flipped else (s, o)
        for t in (s, o):
            slot.setdefault(t, len(slot))
        if slot[s] > slot[o]:
            s, o, flipped = o, s, not flipped
        atoms.append((slot[s], slot[o]))
        rels.append((best.rel, int(flipped)))
    p, q = (slot[t] for t in rule.head.terms)
    return Body(tuple(atoms), (min(p, q), max(p, q)), tuple(rels), constants), int(p > q)


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= SMALL else df


class Facts:
    """The facts of some relations with numbered relations: rel, s, o; swapped facts have the next number."""

    def __init__(self, kb, names: set[str]):
        self.spark, self.code = kb.spark, {n: 2 * i for i, n in enumerate(sorted(names))}
        codes = _table(self.spark, list(self.code.items()), "rel string, code int")
        self.plain = kb.facts(*self.code).join(codes, "rel").select(F.col("code").alias("rel"), "s", "o") if names else self.spark.createDataFrame([], "rel int, s long, o long")

    def of(self, codes: set[int]) -> DataFrame:
        """rel, s, o of these numbers, in their directions."""
        both = []
        for swapped in (0, 1):
            here = sorted(c - swapped for c in codes if c % 2 == swapped)
            if here:
                df = self.plain.where(F.col("rel").isin(here))
                both.append(df.select((F.col("rel") + 1).alias("rel"), F.col("o").alias("s"), F.col("s").alias("o")) if swapped else df)
        return reduce(DataFrame.unionByName, both)

    def number(self, rel: str, swapped: int) -> int:
        return self.code[rel] + swapped


def _shape_pairs(facts: Facts, bodies: list[Body], ids: list[int]) -> DataFrame:
    """body, p, q: the distinct pairs of bodies of one shape."""
    spark, (atoms, head, n_constants) = facts.spark, bodies[0].shape
    beginnings: dict[tuple, int] = {}
    cur, known = None, list(range(n_constants))
    for k, (a, b) in enumerate(atoms):
        rows = set()
        for body, i in zip(bodies, ids):
            begun = (body.rels[: k + 1], body.constants)
            here = i if k == len(atoms) - 1 else beginnings.setdefault(begun, len(beginnings))
            rows.add((beginnings[body.rels[:k], body.constants] if k else 0, here, facts.number(*body.rels[k]), *(() if k else body.constants)))
        table = _table(spark, sorted(rows), "before int, here int, r int" + ("" if k else "".join(f", t{x} long" for x in known)))
        cur = cur.withColumnRenamed("here", "before").join(table, "before") if k else table
        on = [F.col("r") == F.col("rel")] + [F.col(f"t{x}") == F.col(c) for x, c in ((a, "s"), (b, "o")) if x in known]
        new = {x: c for x, c in ((b, "o"), (a, "s")) if x not in known}
        cur = facts.of({r[2] for r in rows}).join(cur, reduce(Column.__and__, on))
        if a == b and a in new:
            cur = cur.where("s = o")
        wanted = {*head} | {x for one in atoms[k + 1 :] for x in one}
        cur = cur.select("here", *(f"t{x}" for x in known if x in wanted), *(F.col(c).alias(f"t{x}") for x, c in new.items() if x in wanted))
        every = [*known, *new]
        known = [x for x in every if x in wanted]
        # constants are the same for all of a beginning
        if any(x >= n_constants for x in set(every) - set(known)):
            cur = cur.distinct()
    return cur.select(F.col("here").alias("body"), F.col(f"t{head[0]}").alias("p"), F.col(f"t{head[1]}").alias("q"))


class RuleSet:
    def __init__(self, kb, rules: list[Rule]):
        self.kb, self.rules = kb, list(rules)
        known: dict[Body | CQ, int] = {}
        self.of: list[tuple[int, int]] = []  # for each rule its body's number, and whether its head is swapped
        for r in self.rules:
            if not r.safe:
                raise ValueError(f"unsafe: {r}")
            body = as_body(r) if len(self.rules) > FEW else None
            key, swapped = body if body else (r.as_query(), 0)
            self.of.append((known.setdefault(key, len(known)), swapped))
        self.bodies = {i: b for b, i in known.items()}
        names = {n for b in self.bodies.values() if isinstance(b, Body) for n, _ in b.rels} | {r.head.rel for r in self.rules}
        self.facts = Facts(kb, names)

    def pairs(self) -> DataFrame:
        """body, p, q: the distinct pairs of every body."""
        shapes: dict[tuple, list[int]] = {}
        parts = []
        for i, b in self.bodies.items():
            if isinstance(b, Body):
                shapes.setdefault(b.shape, []).append(i)
            else:
                parts.append(answer(self.kb, b).select(F.lit(i).alias("body"), F.col("x0").alias("p"), F.col("x1").alias("q")))
        parts += [_shape_pairs(self.facts, [self.bodies[i] for i in ids], ids) for ids in shapes.values()]
        return reduce(DataFrame.unionByName, parts)

    def counted(self) -> DataFrame:
        """rule_id, support, hits; rules without matches may be missing."""
        if len(self.rules) <= FEW:
            return reduce(DataFrame.unionByName, (self._one(i, r) for i, r in enumerate(self.rules)))
        return self._over_twins().counted_by_class()

    def _one(self, i: int, rule: Rule) -> DataFrame:
        """rule_id, support, hits of one rule."""
        facts = self.kb.relation(rule.head.rel)
        if rule.symmetric and (square := self.kb.square(rule.head.rel)):
            return square.counted().select(F.lit(i).alias("rule_id"), "support", "hits")
        if rule.symmetric:  # as many facts above the diagonal as below it have their reverse
            above = facts.where("s > o").join(facts.where("o > s").select(F.col("o").alias("s"), F.col("s").alias("o")), ["s", "o"], "left_semi").agg(F.count("*").alias("above"))
            every = facts.agg(F.count("*").alias("support"), F.count_if(F.col("s") == F.col("o")).alias("level"))
            return every.join(F.broadcast(above)).select(F.lit(i).alias("rule_id"), "support", (F.col("level") + 2 * F.col("above")).alias("hits"))
        found = answer(self.kb, rule.as_query()).toDF("s", "o").join(facts.withColumn("there", F.lit(1)), ["s", "o"], "left")
        return found.agg(F.count("*").alias("support"), F.count("there").alias("hits")).select(F.lit(i).alias("rule_id"), "support", "hits")

    def _over_twins(self) -> RuleSet:
        """The same rules over one entity of each class of twins; what is there after is counted by the sizes of classes."""
        named = {t.value for r in self.rules for a in (r.head, *r.body) for t in a.terms if isinstance(t, Const) and isinstance(t.value, int)}
        twins = Twins(self.kb, {a.rel for r in self.rules for a in (r.head, *r.body)}, named)
        out = RuleSet(twins.kb, self.rules)
        out.twins = twins
        return out

    def counted_by_class(self) -> DataFrame:
        heads = {(body, self.facts.number(r.head.rel, swapped)) for r, (body, swapped) in zip(self.rules, self.of)}
        # relations that hold between two terms, in one row: no more than there are relations
        there = self.facts.of({c for _, c in heads}).groupBy(F.col("s").alias("p"), F.col("o").alias("q")).agg(F.collect_set("rel").alias("rels"))
        met = self.twins.weighed(self.pairs(), "p", "q").join(there, ["p", "q"], "left")
        # a pair of classes is as many pairs as both have members, but for heads h(X, X)
        once = sorted(i for i, b in self.bodies.items() if (b.head if isinstance(b, Body) else b.answer)[0] == (b.head if isinstance(b, Body) else b.answer)[1])
        weight = F.when(F.col("body").isin(once), F.col("p_n")).otherwise(F.col("p_n") * F.col("q_n")).alias("weight")
        every = F.concat(F.array(F.lit(-1)), F.coalesce("rels", F.array().cast("array<int>")))
        n = met.select("body", weight, F.explode(every).alias("rel")).groupBy("body", "rel").agg(F.sum("weight").alias("n"))
        of_body = n.groupBy("body").agg(F.max(F.when(F.col("rel") == -1, F.col("n"))).alias("support"), F.map_from_entries(F.collect_list(F.struct("rel", "n"))).alias("by_rel"))
        rows = [(i, body, self.facts.number(r.head.rel, swapped)) for i, (r, (body, swapped)) in enumerate(zip(self.rules, self.of))]
        table = _table(self.kb.spark, rows, "rule_id int, body int, rel int")
        return of_body.join(table, "body").select("rule_id", "support", F.coalesce(F.try_element_at("by_rel", F.col("rel")), F.lit(0)).alias("hits"))

    def inferred(self) -> DataFrame:
        """rule_id, rel, s, o: the distinct heads of each rule's body."""
        rows = [(i, body, r.head.rel, bool(swapped)) for i, (r, (body, swapped)) in enumerate(zip(self.rules, self.of))]
        table = _table(self.kb.spark, rows, "rule_id int, body int, rel string, swapped boolean")
        both = self.pairs().join(table, "body")
        pick = lambda yes, no: F.when(F.col("swapped"), F.col(yes)).otherwise(F.col(no))
        return both.select("rule_id", "rel", pick("q", "p").alias("s"), pick("p", "q").alias("o"))
