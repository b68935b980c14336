"""Levels of a base that was just compressed read what the run has written, once."""

from pathlib import Path

from corollary.operators.compress import compress
from corollary.plans.terms import parse_rule
from corollary.sources.kb import KnowledgeBase


def test_symmetric_facts_are_written_once(spark):
    facts = {(i, j) for i in range(40) for j in range(40)}
    kb = KnowledgeBase(spark, {"near": spark.createDataFrame(sorted(facts), "s long, o long")})
    small = compress(kb, [parse_rule("near(X,Y) :- near(Y,X)")])
    assert {(r.s, r.o) for r in small.deleted.collect()} == {(s, o) for s, o in facts if s > o}
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    stored = lambda: {p for p in folder.rglob("*") if p.is_file()}
    before = stored()
    assert {tuple(r) for r in small.at_level().facts("near").select("s", "o").collect()} == {(s, o) for s, o in facts if s <= o}
    assert small.at_level(0).facts("near").count() == 1600
    assert stored() == before
