"""Join trees, orders and cyclic bodies: against brute force, and by what their plans make."""

import random

import pytest
from brute import answers, largest

from corollary.plans.joins import Size, join_tree, order
from corollary.plans.query import answer, provenance
from corollary.plans.terms import parse_query
from corollary.sources.kb import KnowledgeBase

QUERIES = [
    "?(X,Y,Z) :- r0(X,Y), r1(Y,Z), r2(Z,X)",
    "?(X) :- r0(X,Y), r1(Y,Z), r2(Z,X)",
    "?(X,Z) :- r0(X,Y), r1(Y,Z), r2(Z,W), r0(W,X)",
    "?(X,Y) :- r0(X,Y), r1(Y,Z), r2(Z,X), r0(X,W), r1(W,1)",
    "?(X,W) :- r0(X,Y), r1(Y,Z), r2(Z,W)",
    "?(A,B,C,D) :- r0(A,B), r1(B,C), r2(C,A), r0(C,D), r1(D,A), r2(B,D)",
    "?(X,Y) :- r0(X,X), r1(X,Y), r2(Y,Y), r0(Y,Z), r1(Z,X)",
    "?(X0) :- r0(X0,A), r1(X0,B), r2(X0,C)",
    "?(X,U) :- r0(X,Y), r1(Z,U)",
    "?(X,V) :- r0(X,Y), r1(Y,Z), r2(Z,X), r0(U,V), r1(V,T), r2(T,U)",
]


def base(spark, facts, names):
    return KnowledgeBase.from_facts(spark, spark.createDataFrame(sorted(facts), "rel string, s long, o long"), names)


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(4)
    facts = {(f"r{rng.randrange(3)}", rng.randrange(6), rng.randrange(6)) for _ in range(40)}
    return facts, base(spark, facts, ["r0", "r1", "r2"])


@pytest.mark.parametrize("text", QUERIES)
def test_against_brute_force(some, text):
    facts, kb = some
    q = parse_query(text)
    for one in (kb, KnowledgeBase.from_facts(kb.spark, kb.every, kb.names).measure()):
        assert sorted(map(tuple, answer(one, q).collect())) == sorted(answers(facts, q)), one.sizes
    n = len(q.answer)
    assert {tuple(r)[:n] for r in provenance(kb, q).collect()} == answers(facts, q)


def test_join_trees():
    assert join_tree([{"a", "b"}, {"b", "c"}, {"c", "a"}]) is None
    assert join_tree([{"a", "b"}, {"b", "c"}, {"c", "d"}, {"d", "a"}]) is None
    path = join_tree([{"a", "b"}, {"b", "c"}, {"c", "d"}])
    assert len(path) == 2 and {i for i, _ in path} | {u for _, u in path} == {0, 1, 2}
    assert join_tree([{"a"}, {"b"}]) == [(0, 1)] and join_tree([{"a"}]) == []


def test_order_by_sizes():
    big, other, none = Size(1e6, {"x": 1e3, "y": 10.0}), Size(1e6, {"y": 10.0, "z": 1e3}), Size(0, {"z": 0.0, "w": 0.0})
    places, most, last = order([big, other, none])
    assert places[0] == 2 and last == 0 and most == 0
    _, most, last = order([big, other])
    assert last == pytest.approx(1e11) and most == 0


def test_an_empty_atom_ends_a_path_early(spark):
    n = 300
    facts = {("a", i, 0) for i in range(n)} | {("b", 0, i) for i in range(n)} | {("d", 1, 1)}
    kb = base(spark, facts, ["a", "b", "c", "d"]).measure()
    got, most = largest(answer(kb, parse_query("?(X,W) :- a(X,Y), b(Y,Z), c(Z,W)")))
    assert got == [] and most <= 2 * n  # a with b alone has n * n rows


def test_parts_are_reduced_where_joins_would_grow(spark):
    """A path with hubs before and behind its middle, which few of their rows get through."""
    n = 20
    facts = {("a", i, h) for i in range(n) for h in (0, 1)} | {("b", h, 100 + i) for i in range(n) for h in (0, 1)}
    facts |= {("c", 500 + i, h) for i in range(n) for h in (0, 1)} | {("d", h, 700 + i) for i in range(n) for h in (0, 1)}
    q = parse_query("?(X,Y,Z,W,V) :- a(X,Y), b(Y,Z), c(Z,W), d(W,V)")
    for more in (set(), {("c", 100, 0)}):
        df = answer(base(spark, facts | more, list("abcd")).measure(), q)
        got, most = largest(df)
        assert got == sorted(answers(facts | more, q)) and df._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 3
        assert most <= max(2 * n, len(got))  # as many rows on the way as the answer has, or an atom


def test_a_hub_makes_no_square(spark):
    """A triangle on a graph whose hub has n edges in and out: two atoms joined have n * n rows."""
    n = 400
    edges = {(0, i) for i in range(1, n)} | {(i, 0) for i in range(1, n)} | {(i, i % (n - 1) + 1) for i in range(1, n)}
    facts = {("e", *x) for x in edges}
    kb = base(spark, facts, ["e"])
    got, most = largest(answer(kb, parse_query("?(X,Y,Z) :- e(X,Y), e(Y,Z), e(Z,X)")))
    after = {}
    for x, y in edges:
        after.setdefault(x, set()).add(y)
    assert got == sorted((x, y, z) for x, y in edges for z in after[y] if x in after[z])
    assert most < 12 * n


def test_small_stars_are_broadcast(spark):
    facts = {(r, i, i % 7) for r in "abc" for i in range(50) if r != "c" or i % 3 == 0}
    kb = base(spark, facts, list("abc")).measure()
    df = answer(kb, parse_query("a(X0, X1), b(X0, X2), c(X0, X3)"))
    assert [r.x0 for r in df.orderBy("x0").collect()] == list(range(0, 50, 3))
    assert df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 2
