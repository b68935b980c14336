"""Rows are dealt to more tasks as they grow, with the same results."""

from corollary.functions import lineage
from corollary.operators import compress as compressing
from corollary.plans import layers
from corollary.plans.terms import parse_query, parse_rule
from corollary.sources.kb import KnowledgeBase


def _base(spark, **facts):
    return KnowledgeBase(spark, {n: spark.createDataFrame(sorted(f), "s bigint, o bigint") for n, f in facts.items()})


def _spied(monkeypatch, module):
    parts = []

    def put(df, checkpoint=module.checkpoint):
        out = checkpoint(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(module, "checkpoint", put)
    monkeypatch.setattr(lineage, "ROWS", 50)
    return parts


def test_sets_of_rules_take_more_tasks_for_more_facts(spark, monkeypatch):
    a, b, c = {(i, 1000 + i) for i in range(1000)}, {(1000 + i, i % 5) for i in range(1000)}, {(i, 90 + i) for i in range(5)}
    h, g = {(i, i % 5) for i in range(1000)}, {(i, 90 + i % 5) for i in range(0, 1000, 2)} | {(7000, 1)}
    parts = _spied(monkeypatch, compressing)
    got = compressing.compress_sets(_base(spark, a=a, b=b, c=c, h=h, g=g), [parse_rule("g(X,Y) :- h(X,Z), c(Z,Y)"), parse_rule("h(X,Y) :- a(X,Z), b(Z,Y)")])
    # body facts of g's matches stay in the first round
    want = {("g", x, y, 1) for x, y in g if x < 1000} | {("h", x, y, 1 if x % 2 else 2) for x, y in h}
    assert {tuple(r) for r in got.deleted.collect()} == want
    assert max(parts) >= 20


def test_layers_take_more_tasks_for_more_rows(spark, monkeypatch):
    step = {(i, i + 1) for i in range(500)}
    rules = [parse_rule(r) for i in (1, 2, 3) for r in (f"r{i}(X,Y) :- r{i - 1}(X,Y)", f"r{i}(X,Y) :- r{i - 1}(X,Z), step(Z,Y)")]
    parts = _spied(monkeypatch, layers)
    got = layers.answer_layered(_base(spark, r0=step, step=step, r2={(3, 900)}), parse_query("?(X,Y) :- r3(X,Y)"), rules)
    assert {tuple(r) for r in got.collect()} == {(i, j) for i in range(501) for j in range(i + 1, min(i + 4, 500) + 1)} | {(3, 900)}
    assert max(parts) >= 10
