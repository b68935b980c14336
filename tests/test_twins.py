"""Answers and counts that are squares of groups: exact, and without work of that size."""

import random
from itertools import product
from pathlib import Path

import pytest

from corollary.operators import verify
from corollary.operators.compress import compress
from corollary.plans.query import answer
from corollary.plans.terms import parse_query, parse_rule
from corollary.plans.twins import Squares, Twins
from corollary.sources.encode import star
from corollary.sources.kb import KnowledgeBase


def base(spark, **relations):
    return KnowledgeBase(spark, {n: spark.createDataFrame(sorted(rows), "s long, o long") for n, rows in relations.items()})


def rows(df):
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("seed", range(4))
def test_pairs_that_share_a_partner(spark, seed):
    draw = random.Random(seed)
    a = {(draw.randrange(40), 100 + draw.randrange(4)) for _ in range(60)} | {(100, 100), (101, 3)}
    got = answer(base(spark, a=a), parse_query("?(X,Y) :- a(X,Z), a(Y,Z)"))
    assert rows(got) == {(x, y) for (x, z), (y, w) in product(a, a) if z == w}
    got = answer(base(spark, a=a), parse_query("?(Y,X) :- a(Z,X), a(Z,Y)"))
    assert rows(got) == {(y, x) for (z, x), (w, y) in product(a, a) if z == w}


def test_pairs_of_a_group_are_not_shuffled(spark):
    """3000 members of two groups are 4.5 million pairs; pieces of their lists are dealt."""
    a = {(i, 10_000 + i % 2) for i in range(3000)}
    got = answer(base(spark, a=a), parse_query("?(X,Y) :- a(X,Z), a(Y,Z)"))
    assert got.count() == 4_500_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Project") or plan.startswith("Generate")  # no aggregate above the pairs


@pytest.mark.parametrize("seed", range(3))
def test_rules_counted_by_classes(spark, seed):
    """More than eight rules, with constants, repeated head variables and twins on both sides."""
    draw = random.Random(seed)
    a = {(i, 100 + i % 3) for i in range(30)} | {(draw.randrange(30), 100 + draw.randrange(3)) for _ in range(4)}
    b = {(100 + i, 200 + i % 2) for i in range(3)} | {(200, 200)}
    h = {(i, 200 + j) for i in range(30) for j in range(2) if draw.random() < 0.5} | {(200, 200), (5, 5)}
    facts = {"a": a, "b": b, "h": h}
    texts = ["h(X,Y) :- a(X,Z), b(Z,Y)", "h(X,Y) :- a(X,Y)", "a(X,Y) :- a(X,Z), a(W,Z), a(W,Y)", "h(X,Y) :- a(X,Z), a(Y,Z)", "h(X,X) :- a(X,Z)", "h(X,X) :- b(X,X)", "h(X,Y) :- h(Y,X)", "h(X,Y) :- h(X,Y), a(X,101)", "a(X,Y) :- a(7,Y), h(X,Z)", "b(X,Y) :- b(X,Y)", "h(7,Y) :- a(7,Z), b(Z,Y)"]
    rules = [parse_rule(t) for t in texts]

    def brute(r):
        found = set()
        atoms = [facts[x.rel] for x in r.body]
        for some in product(*atoms):
            bound = {}
            if all(bound.setdefault(t, v) == v if not hasattr(t, "value") else t.value == v for x, row in zip(r.body, some) for t, v in zip(x.terms, row)):
                found.add(tuple(t.value if hasattr(t, "value") else bound[t] for t in r.head.terms))
        return len(found), len(found - facts[r.head.rel])

    got = {r.rule_id: (r.support, r.counterexamples) for r in verify.verify_rules(base(spark, **facts), rules).collect()}
    assert got == {i: brute(r) for i, r in enumerate(rules)}


def test_twins_are_joined_once(spark):
    kb = base(spark, a={(i, 1000 + i % 2) for i in range(200)}, b={(1000, 5000), (1001, 5001)})
    assert Twins(kb, ["a", "b"]).kb.facts("a").count() == 2
    assert Twins(kb, ["a", "b"], apart=[7, 9]).kb.facts("a").count() == 4


def _swapped(facts):
    return {(o, s) for s, o in facts}


@pytest.mark.parametrize("seed", range(3))
def test_symmetric_facts_told_by_classes(spark, seed):
    """Pairs of classes with and without their reverse, and a class with itself."""
    draw = random.Random(seed)
    a = {(i, 100 + draw.randrange(4)) for i in range(20)} | {(30, 100), (30, 101), (31, 102), (31, 103), (31, 100)}
    twins = Twins(base(spark, a=a), ["a"])
    first = sorted({r.s for r in twins.kb.facts("a").collect()})
    pairs = {(x, y) for x, y in product(first, first) if draw.random() < 0.6}
    square = Squares(twins, spark.createDataFrame(sorted(pairs), "x long, y long"))
    facts = rows(square.facts())
    both = facts & _swapped(facts)
    assert tuple(square.counted().first()) == (len(facts), len(both), sum(s > o for s, o in both))
    assert rows(square.below()) == {(s, o) for s, o in both if s > o}
    assert rows(square.others()) == facts - {(s, o) for s, o in both if s > o}


@pytest.mark.parametrize("nations, more", [((2,), ()), ((2, 3, 1), ("supplier_nation(X,Y) :- supplier_nation(X,Y)", "same_nation(X,Y) :- supplier_nation(X,Z), supplier_nation(Y,Z)")), ((40,), ())])
def test_symmetric_compression_of_a_square(spark, tmp_path, nations, more):
    keys = [(100 * n + k, n) for n, size in enumerate(nations) for k in range(size)]
    spark.createDataFrame(keys, "s_suppkey long, s_nationkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    kb = star(spark, str(tmp_path), "same_nation", *(["supplier_nation"] if more else []))
    facts = rows(kb.relation("same_nation"))
    small = compress(kb, [parse_rule(r) for r in ("same_nation(X,Y) :- same_nation(Y,X)", *more)])
    below = {(s, o) for s, o in facts if s > o}
    assert len(facts) == sum(n * n for n in nations)
    assert {(r.s, r.o) for r in small.deleted.where("step = 1").collect()} == below
    assert rows(small.at_level(1).relation("same_nation")) == facts - below
    if more:  # what the symmetric rule has left goes by the other one
        assert {(r.s, r.o) for r in small.deleted.where("step = 2 AND rel = 'same_nation'").collect()} == facts - below
    assert {(r.s, r.o) for r in small.recover().where("rel = 'same_nation'").collect()} == facts


def test_symmetric_compression_does_not_write_a_square(spark, tmp_path):
    """3000 suppliers of two nations: 2,248,500 facts go."""
    spark.range(3000).selectExpr("id AS s_suppkey", "id % 2 AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    stored = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = stored()
    small = compress(star(spark, str(tmp_path), "same_nation"), [parse_rule("same_nation(X,Y) :- same_nation(Y,X)")])
    assert small.deleted.count() == 2_248_500
    assert small.at_level().relation("same_nation").count() == 2_251_500
    assert stored() - before < 500_000
