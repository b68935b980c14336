"""Closures of paths: exact, and without work of the size of their square."""

from pathlib import Path

import pytest

from corollary.operators import recover
from corollary.operators.recover import closure, transitive
from corollary.plans.terms import parse_rule
from corollary.sources.kb import KnowledgeBase


def base(spark, **relations):
    return KnowledgeBase(spark, {n: spark.createDataFrame(sorted(rows), "s long, o long") for n, rows in relations.items()})


def rows(df):
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


def stored(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_a_path_is_closed_without_writing_its_square(spark):
    n, before = 3000, stored(spark)
    kb = base(spark, next={(i, i + 1) for i in range(n)})
    rules = [parse_rule("after(X,Y) :- next(X,Y)"), parse_rule("after(X,Y) :- after(X,Z), next(Z,Y)")]
    got = closure(kb, rules).where("rel = 'after'")
    assert got.count() == n * (n + 1) // 2 and got.where("s >= o").isEmpty()
    assert got.select("s", "o").distinct().count() == n * (n + 1) // 2
    assert stored(spark) - before < 4_000_000


@pytest.mark.parametrize("edges", [{(i, i + 1) for i in range(700)} | {(2000 + i, 2001 + i) for i in range(3)}, {(1, 2), (2, 3), (3, 1), (7, 8), (8, 9)}, {(1, 1), (2, 3), (3, 4)}, {(1, 2), (1, 3), (3, 4)}, {(9, 4), (4, 7)}])
def test_closures_of_paths_and_others(spark, edges):
    want = set(edges)
    step = {}
    for s, o in edges:
        step.setdefault(s, set()).add(o)
    todo = set(edges)
    while todo:
        todo = {(s, p) for s, o in todo for p in step.get(o, ())} - want
        want |= todo
    assert rows(transitive(spark.createDataFrame(sorted(edges), "s long, o long"))[0]) == want


def test_facts_of_its_own_are_closed_too(spark):
    kb = base(spark, next={(1, 2), (2, 3)}, after={(7, 1)})
    rules = [parse_rule("after(X,Y) :- next(X,Y)"), parse_rule("after(X,Y) :- after(X,Z), next(Z,Y)")]
    assert rows(closure(kb, rules).where("rel = 'after'").select("s", "o")) == {(1, 2), (2, 3), (1, 3), (7, 1), (7, 2), (7, 3)}


def test_pieces_of_every_size(spark, monkeypatch):
    monkeypatch.setattr(recover, "PIECE", 8)
    monkeypatch.setattr(recover, "PARTS", (2, 3))
    monkeypatch.setattr(recover, "PAIRS", 50)
    ends = {k: 1000 * k + k for k in (1, 2, 7, 8, 9, 16, 17, 40)}  # edges of a path: its last entity
    got = transitive(spark.createDataFrame(sorted((i, i + 1) for k, end in ends.items() for i in range(1000 * k, end)), "s long, o long"))[0]
    assert rows(got) == {(i, j) for k, end in ends.items() for i in range(1000 * k, end + 1) for j in range(i + 1, end + 1)}
    assert got.rdd.getNumPartitions() == 25  # 1222 pairs, 50 a task


def shuffled(df):
    """Bytes that the exchanges of the plan, once run, have dealt."""

    def walk(p):
        name = p.nodeName()
        if "AdaptiveSparkPlan" in name:
            yield from walk(p.executedPlan())
        elif "QueryStage" in name:
            yield from walk(p.plan())
        else:
            if "Exchange" in name and p.metrics().get("dataSize").isDefined():
                yield p.metrics().get("dataSize").get().value()
            for i in range(p.children().size()):
                yield from walk(p.children().apply(i))

    return sum(walk(df._jdf.queryExecution().executedPlan()))


def test_pieces_of_long_paths_are_dealt_to_few_pairs(spark):
    """The pieces that are shuffled grow with the square of a path, too: a hundredth of a byte for a pair."""
    n = 20_000
    got = transitive(spark.range(n).selectExpr("id AS s", "id + 1 AS o"))[0].groupBy().count()
    assert got.collect()[0][0] == n * (n + 1) // 2
    assert 0 < shuffled(got) < n * n // 100


def test_no_edges_have_no_closure(spark):
    assert rows(transitive(spark.createDataFrame([], "s long, o long"))[0]) == set()
