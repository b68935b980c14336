"""Rules as data, closures by doubling, layers and changes of a compressed base: against brute force."""

import random

import pytest
from brute import answers, chase

from corollary.operators import fit, verify
from corollary.operators.compress import CompressedKB, compress, compress_sets
from corollary.operators.recover import Known, closure, groups, transitive
from corollary.operators.ruleset import RuleSet, as_body
from corollary.plans.fus import closures, domain_restricted, linear, rewritable, sticky
from corollary.plans.layers import Layers, answer_derived, answer_layered, unfoldings
from corollary.plans.query import answer
from corollary.plans.rewrite import NotRewritable
from corollary.plans.terms import parse_query, parse_rule
from corollary.sources.kb import KnowledgeBase, number, read_mapping

P = parse_rule
FACTS = "rel string, s long, o long"


def base(spark, facts, names):
    return KnowledgeBase.from_facts(spark, spark.createDataFrame(sorted(facts), FACTS), list(names))


def rows(df):
    return sorted(map(tuple, df.collect()))


# ---- rules as data --------------------------------------------------------------------------------

RULES = [
    "r0(X,Y) :- r1(X,Z), r2(Z,Y)", "r0(Y,X) :- r1(X,Z), r2(Z,Y)", "r0(X,Y) :- r2(Z,Y), r1(X,Z)", "r2(X,Y) :- r0(Y,X)", "r2(X,Y) :- r0(X,Y)", "r0(X,X) :- r1(X,X)", "r0(X,3) :- r1(X,Y)", "r0(2,3) :- r1(X,Y)",
    "r1(X,Y) :- r0(X,Z), r1(Z,W), r2(W,Y)", "r1(X,Y) :- r0(Z,X), r1(Z,W), r2(Y,W)", "r1(X,Y) :- r0(X,Y), r1(Y,Z), r2(Z,X)", "r0(X,Y) :- r1(X,1), r2(Y,1)", "r0(X,Y) :- r1(X,1), r2(X,Y)", "r0(X,Y) :- r1(X,2), r2(X,Y)",
    "r0(X,Y) :- r1(X,Z), r2(W,Y)", "r0(X,Y) :- r1(X,Y), r2(Z,Z)", "r0(X,Y) :- r0(X,Y), r0(Y,Y)", "r0(X,Y) :- r1(1,X), r2(X,Y), r1(Y,1)", "r0(X,X) :- r1(X,Z), r2(Z,X)",
]


def test_rules_against_brute_force(spark):
    rng = random.Random(5)
    facts = {(f"r{rng.randrange(3)}", rng.randrange(7), rng.randrange(7)) for _ in range(60)}
    kb, rules = base(spark, facts, ["r0", "r1", "r2"]), [P(r) for r in RULES]
    got = {r.rule_id: (r.support, r.counterexamples) for r in verify.verify_rules(kb, rules).collect()}
    wrong = {(r.rule_id, r.rel, r.s, r.o) for r in verify.counter_examples(kb, rules).collect()}
    want = set()
    for i, r in enumerate(rules):
        heads = {(r.head.rel, *h) for h in answers(facts, r.as_query())}
        assert got[i] == (len(heads), len(heads - facts)), str(r)
        want |= {(i, *h) for h in heads - facts}
    assert wrong == want
    few = [0, 1, 3, 6, 14]  # so few are planned one by one
    some = {r.rule_id: (r.support, r.counterexamples) for r in verify.verify_rules(kb, [rules[i] for i in few]).collect()}
    assert some == {k: got[i] for k, i in enumerate(few)}
    assert {(few[r.rule_id], r.rel, r.s, r.o) for r in verify.counter_examples(kb, [rules[i] for i in few]).collect()} == {w for w in want if w[0] in few}
    with pytest.raises(ValueError, match="unsafe"):
        verify.verify_rules(kb, [P("r0(X,W) :- r1(X,Y)")])


def test_thousands_of_rules_are_a_few_branches(spark):
    names = [f"p{i}" for i in range(12)]
    kb = base(spark, {(n, 1, 2) for n in names} | {("p0", 2, 3)}, names)
    rules = [P(f"{h}(X,Y) :- {a}({x}), {b}({y})") for h in names for a in names for b in names for x in ("X,Z", "Z,X") for y in ("Z,Y", "Y,Z")]
    some = RuleSet(kb, rules)
    assert len(rules) == 6912 and len({b.shape for b in some.bodies.values()}) == 1 and len(some.bodies) == 576
    got = {r.rule_id: (r.support, r.hits) for r in some.counted().collect()}
    i = rules.index(P("p3(X,Y) :- p5(X,Z), p0(Z,Y)"))
    assert got[i] == (1, 0) and P("p3(X,Y) :- p5(X,Z), p4(Z,Y)") in rules and rules.index(P("p3(X,Y) :- p5(X,Z), p4(Z,Y)")) not in got
    assert as_body(P("a(X,Y) :- b(X,Z), c(Z,Y)"))[0].shape == as_body(P("a(Y,X) :- c(Y,Z), b(Z,X)"))[0].shape


def test_mined_rules_are_not_verified_again(spark, monkeypatch):
    kb = base(spark, {("a", 1, 2), ("b", 2, 1)}, "ab")
    monkeypatch.setattr(fit, "verify_rules", lambda *_: pytest.fail("verified"))
    gone = []
    assert fit.filter_rules(kb, [P("a(X,Y) :- b(Y,X)"), P("b(X,Y) :- a(Y,X)")], left_out=gone, mined={P("a(X,Y) :- b(Y,X)"): 1, P("b(X,Y) :- a(Y,X)"): 0}) == [P("a(X,Y) :- b(Y,X)")] and len(gone) == 1


# ---- closures -------------------------------------------------------------------------------------

CLOSING = [
    ["t(X,Y) :- e(X,Y)", "t(X,Y) :- t(X,Z), e(Z,Y)"],
    ["t(X,Y) :- e(X,Y)", "t(X,Y) :- b(X,Y)", "t(X,Y) :- t(X,Z), e(Z,Y)", "t(X,Y) :- b(X,Z), t(Z,Y)"],
    ["t(X,Y) :- t(Z,Y), t(X,Z)"],
    ["t(X,Y) :- t(X,Z), e(Z,Y)"],
    ["a(X,Y) :- b(Y,X)", "b(X,Y) :- a(X,Z), e(Z,Y)", "u(X,Y) :- a(X,Z), b(Z,Y)"],
]


@pytest.mark.parametrize("texts", CLOSING)
def test_closures(spark, texts):
    rng = random.Random(len(texts))
    facts = {(rng.choice("ebtac"), rng.randrange(6), rng.randrange(6)) for _ in range(16)}
    rules = [P(t) for t in texts]
    assert rows(closure(base(spark, facts, "ebtac"), rules)) == sorted(chase(facts, rules))


def test_a_long_chain_closes_in_rounds_that_double(spark):
    n = 300
    closed, rounds = transitive(spark.range(n).selectExpr("id as s", "id + 1 as o"))
    assert closed.count() == n * (n + 1) // 2 and rounds <= 9
    ring, _ = transitive(spark.range(5).selectExpr("id as s", "(id + 1) % 5 as o"))
    assert ring.count() == 25 and transitive(spark.range(0).selectExpr("id as s", "id as o"))[0].count() == 0


def test_known_facts_are_not_shuffled(spark):
    known = Known(spark, spark.range(100).selectExpr("id as s", "id as o"))
    known.add(spark.range(100, 110).selectExpr("id as s", "id as o"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spark.range(105, 115).selectExpr("id as s", "id as o")
        plan = found.distinct().join(known.facts(), ["s", "o"], "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert known.new(found).count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert known.done().count() == 110


def test_groups_of_relations():
    got = groups([P("c(X,Y) :- b(X,Y)"), P("b(X,Y) :- a(X,Y)"), P("a(X,Y) :- b(Y,X)")])
    assert [names for names, _ in got] == [{"a", "b"}, {"c"}]


def test_closures_by_shared_relations():
    rules = [P("a(X,Y) :- b(X,Y)"), P("c(X,Y) :- d(X,Y)"), P("e(X,Y) :- b(X,Y)"), P("f(X,Y) :- f(Y,X)")]
    assert closures(rules) == [{0, 2}, {1}, {0, 2}, {3}]


def test_sets_by_groups(spark):
    facts = {("a", 1, 2), ("b", 1, 2), ("c", 1, 2), ("x", 5, 6), ("y", 5, 6)}
    rules = [P("b(X,Y) :- a(X,Y)"), P("c(X,Y) :- b(X,Y)"), P("y(X,Y) :- x(X,Y)")]
    small = compress_sets(base(spark, facts, "abcxy"), rules)
    assert rows(small.deleted) == [("b", 1, 2, 2), ("c", 1, 2, 1), ("y", 5, 6, 1)] and rows(small.recover()) == sorted(facts)


def test_bounded_recursion_is_taken(spark):
    """Of no class: Z is lost and joined, p depends on itself. Two steps lead back to p, so the union is finite."""
    rule = P("p(X,Y) :- a(X,Z), b(Z,Y), p(Y,X)")
    assert not sticky([rule]) and not linear([rule]) and not domain_restricted([rule]) and rewritable([rule])
    assert not rewritable([P("t(X,Y) :- t(X,Z), t(Z,Y)")]) and not rewritable([P("t(X,Y) :- e(X,Z), t(Z,Y)")])
    rng = random.Random(6)
    facts = chase({(rng.choice("aabbp"), rng.randrange(4), rng.randrange(4)) for _ in range(24)}, [rule])
    small = compress(base(spark, facts, "abp"), [rule])
    assert small.rules == [rule] and not small.deleted.isEmpty() and rows(small.recover()) == sorted(facts)
    q = parse_query("?(X,Y) :- p(X,Z), p(Z,Y)")
    assert rows(small.answer(q)) == sorted(answers(facts, q))


# ---- shared pieces ----------------------------------------------------------------------------------

UNIONS = [
    (["?(X,C) :- a(X,C), b(C,1), c(C,2)", "?(X,C) :- d(X,C), c(C,2), b(C,1)"], 1),  # a star with constants, in any order
    (["?(X,Y) :- a(X,Z), b(Z,W), c(W,Y)", "?(Y,X) :- b(U,V), c(V,X), a(Y,U), d(Y,T)"], 1),  # a path, one query is the piece
    (["?(X,Y) :- a(X,Z), b(Z,Y)", "?(X,Z) :- a(X,Z), b(Z,Y)"], 0),  # the middle is asked for once
    (["?(X,Y) :- a(X,Z), b(Z,Y), a(X,U), b(U,Y), d(X,Y)", "?(X,Y) :- a(X,V), b(V,Y)"], 1),
    (["?(X,Y) :- a(X,Z), a(Z,Y), d(X,Y)", "?(X,Y) :- a(X,Z), a(Z,Y), c(X,Y)", "?(X,Y) :- a(X,Z), a(Z,W), c(W,Y)"], 1),
]


@pytest.mark.parametrize("texts, pieces", UNIONS)
def test_shared_pieces(spark, texts, pieces):
    from corollary.plans.share import answer_shared, shared

    rng = random.Random(9)
    facts = {(rng.choice("abcd"), rng.randrange(4), rng.randrange(4)) for _ in range(40)}
    union = tuple(parse_query(t) for t in texts)
    want = sorted(set().union(*(answers(facts, q) for q in union)))
    kb = base(spark, facts, "abcd")
    made, queries = shared(kb, list(union))
    assert len(made.relations) - 4 == pieces or pieces and len(made.relations) > 4
    assert sorted({tuple(r) for q in queries for r in answer(made, q).collect()}) == want
    assert rows(answer_shared(kb.measure(), union)) == want


def test_pieces_are_made_where_they_save_rows(spark):
    from corollary.plans.share import shared

    n = 40
    hub = {("a", i, 0) for i in range(n)} | {("b", 0, i) for i in range(n)} | {("c", 1, 1), ("d", 2, 2)}
    path = {("a", i, i) for i in range(n)} | {("b", i, 0) for i in range(n)} | {("c", 1, 1), ("d", 2, 2)}
    union = [parse_query("?(X,Y) :- a(X,Z), b(Z,Y), c(X,X)"), parse_query("?(X,Y) :- a(X,Z), b(Z,Y), d(X,X)")]
    assert len(shared(base(spark, hub, "abcd").measure(), union)[0].relations) == 4  # n * n rows written to save 2 * n
    assert len(shared(base(spark, path, "abcd").measure(), union)[0].relations) == 5


# ---- layers -----------------------------------------------------------------------------------------


def test_layers_against_the_chase(spark):
    rng = random.Random(2)
    rules = [P(t) for i in range(1, 12) for t in (f"r{i}(X,Y) :- r{i - 1}(X,Y)", f"r{i}(X,Y) :- r{i - 1}(Y,Z), e(Z,X)")]
    facts = {("r0", rng.randrange(6), rng.randrange(6)) for _ in range(6)} | {("e", rng.randrange(6), rng.randrange(6)) for _ in range(5)} | {("r7", 1, 2)}
    full, kb = chase(facts, rules), base(spark, facts, [*(f"r{i}" for i in range(12)), "e"])
    for text in ("?(X,Y) :- r11(X,Z), r9(Z,Y), e(Y,W)", "?(X) :- r11(X,2)"):
        q = parse_query(text)
        assert unfoldings(q, rules) > 2000
        assert rows(answer_derived(kb, q, rules)) == sorted(answers(full, q))
    layers = Layers(rules)
    layers.put(parse_query("?(X,Y) :- r11(X,Y), r11(Y,X)"))
    assert len(layers.bodies) == 11  # one definition a relation
    recursive = [P("t(X,Y) :- e(X,Y)"), P("t(X,Y) :- t(X,Z), e(Z,Y)")]
    q = parse_query("?(X,Y) :- t(X,Z), r0(Z,Y)")
    with pytest.raises(NotRewritable):
        answer_layered(kb, q, recursive)
    assert rows(answer_derived(kb, q, recursive, most=3)) == sorted(answers(chase(facts, recursive), q))


# ---- changes ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("trial", range(5))
def test_updates_are_those_of_a_fresh_base(spark, trial):
    rng = random.Random(trial)
    rules = [P("h(X,Y) :- a(X,Z), b(Z,Y)"), P("g(X,Y) :- h(X,Z), c(Z,Y)"), P("k(X,Y) :- g(Y,X)")]
    facts = chase({(rng.choice("abc"), rng.randrange(5), rng.randrange(5)) for _ in range(18)} | {("h", 4, 4)}, rules)
    small = compress(base(spark, facts, "abcghk"), rules)
    removed = {f for f in facts if rng.random() < 0.15 and (trial % 2 or f[0] in "ab")}
    added = {(rng.choice("abcghk" if trial == 3 else "abc"), rng.randrange(5), rng.randrange(5)) for _ in range(trial % 3)}
    if trial == 2:  # what follows is added too, so no rule has to go
        added = chase((facts - removed) | added, rules) - (facts - removed)
    now = (facts - removed) | added
    new = small.updated(*(spark.createDataFrame(sorted(x), FACTS) for x in (added, removed)))
    assert set(rows(new.kb.facts())) == now
    for level in {0, len(new.rules) // 2, len(new.rules)}:
        assert set(rows(new.recover(level))) == now, level
    for text in ("k(X,Y)", "?(X,Y) :- g(X,Z), h(Z,Y)"):
        assert rows(new.answer(parse_query(text))) == sorted(answers(now, parse_query(text)))
    if trial == 2:
        assert new.rules == small.rules


def test_updates_at_the_edges(spark):
    small = compress(base(spark, {("a", 1, 2), ("h", 1, 2)}, "ah"), [P("h(X,Y) :- a(X,Y)")])
    same = small.updated()
    assert same.rules == small.rules and rows(same.deleted) == rows(small.deleted)
    none = spark.createDataFrame([(None, 1, 1), ("zz", 1, 1)], FACTS)
    assert rows(small.updated(removed=none).recover()) == [("a", 1, 2), ("h", 1, 2)]
    more = small.updated(added=none, removed=spark.createDataFrame([("a", 1, 2)], FACTS))
    assert rows(more.recover()) == [("h", 1, 2), ("zz", 1, 1)] and more.deleted.isEmpty() and more.rules == small.rules


# ---- folders and RDF --------------------------------------------------------------------------------


def test_folder_round_trip(spark, tmp_path):
    kb = base(spark, {("a", 1, 2), ("b", 2, 3), ("h", 1, 3), ("h", 2, 2)}, "abhz")
    kb.dictionary = number(spark.createDataFrame([("two words",), ("b",), ("ü 7",)], "name string"))
    small = compress(kb, [P("h(X,Y) :- a(X,Z), b(Z,Y)")])
    small.write_folder(f"{tmp_path}/kept")
    back = CompressedKB.from_folder(spark, f"{tmp_path}/kept")
    assert back.rules == small.rules and rows(back.at_level().facts()) == rows(small.at_level().facts()) and rows(back.recover()) == rows(kb.facts())
    assert rows(back.kb.dictionary) == [("b", 1), ("null", 0), ("two words", 2), ("ü 7", 3)] and back.kb.names == ["a", "b", "h", "z"]
    kb.dictionary = None
    kb.write_folder(f"{tmp_path}/plain")
    assert rows(KnowledgeBase.read_folder(spark, f"{tmp_path}/plain").facts()) == rows(kb.facts())
    (tmp_path / "mapping.txt").write_text("first\nsecond name\nthird 9\n")
    assert rows(read_mapping(spark, f"{tmp_path}/mapping.txt")) == [("first", 1), ("null", 0), ("second name", 2), ("third", 9)]


NT = r'''# a comment
<http://x#a> <http://x#likes> <http://x#b> .
  <http://x#a>	<http://x#name> "A \"quoted\" naïve \U0001F600 \\ text"@en-GB . # more

_:n1 <http://x#likes> _:n.2 .
<http://x#b> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x#Thing> .
<http://x#b> <http://x#age> "7"^^<http://www.w3.org/2001/XMLSchema#int> .
'''
XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x#" xml:base="http://base/doc">
  <x:Thing rdf:about="http://x#b" x:color="red"><x:likes rdf:resource="http://x#a"/><x:name>B &amp; co</x:name></x:Thing>
  <rdf:Description rdf:ID="here"><x:knows><x:Person rdf:nodeID="p1"><x:age>3</x:age></x:Person></x:knows><x:at rdf:parseType="Resource"><x:lat>1</x:lat></x:at></rdf:Description>
  <rdf:Description rdf:nodeID="p1"><x:empty/></rdf:Description>
</rdf:RDF>
"""
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def test_rdf(spark, tmp_path):
    from corollary.sources.rdf import parse_xml, read_ntriples, read_rdf_xml

    (tmp_path / "f.nt").write_text(NT)
    got = [tuple(r) for r in read_ntriples(spark, f"{tmp_path}/f.nt").collect()]
    assert ("http://x#a", "http://x#likes", "http://x#b") in got and ("http://x#a", "http://x#name", 'A "quoted" naïve 😀 \\ text') in got and ("http://x#b", "http://x#age", "7") in got
    (blank,) = [t for t in got if t[0].startswith("_:")]
    assert blank[0].endswith(".n1") and blank[2].endswith(".n.2") and len(got) == 5
    kb = KnowledgeBase.read_ntriples(spark, f"{tmp_path}/f.nt")
    assert kb.names == ["age", "likes", "name", "t"] and kb.dictionary.where("name = 'Thing'").count() == 1
    (tmp_path / "bad.nt").write_text("<a> <b> c .\n")
    with pytest.raises(Exception, match="not a line of N-Triples"):
        read_ntriples(spark, f"{tmp_path}/bad.nt").collect()
    want = {
        ("http://x#b", TYPE, "http://x#Thing"), ("http://x#b", "http://x#color", "red"), ("http://x#b", "http://x#likes", "http://x#a"), ("http://x#b", "http://x#name", "B & co"),
        ("http://base/doc#here", "http://x#knows", "_:m.n.p1"), ("_:m.n.p1", TYPE, "http://x#Person"), ("_:m.n.p1", "http://x#age", "3"), ("_:m.n.p1", "http://x#empty", ""),
        ("http://base/doc#here", "http://x#at", "_:m.1"), ("_:m.1", "http://x#lat", "1"),
    }
    assert set(parse_xml(XML.encode(), "m")) == want
    (tmp_path / "f.rdf").write_text(XML)
    assert read_rdf_xml(spark, f"{tmp_path}/f.rdf").count() == len(want)
    both = KnowledgeBase.read_rdf_xml(spark, f"{tmp_path}/f.rdf")
    assert both.names == ["age", "at", "color", "empty", "knows", "lat", "likes", "name", "t"]
    with pytest.raises(ValueError, match="not read"):
        list(parse_xml(XML.replace('parseType="Resource"', 'parseType="Literal"').encode(), "m"))
