"""The engine on micro bases: round trips, levels, validation, files."""

import random

import pytest
from pyspark.sql import functions as F

from corollary.functions import setops
from corollary.functions.lineage import checkpoint
from corollary.operators import fit as fitting
from corollary.operators.compress import CompressedKB, compress, compress_sets
from corollary.operators.mine import mine_rules
from corollary.operators.recover import closure
from corollary.operators.verify import entails, exact, verify_rules
from corollary.plans.query import answer, holds
from corollary.plans.terms import parse_query, parse_rule
from corollary.sources.kb import KnowledgeBase, number

P = parse_rule


def kb_of(spark, **relations):
    return KnowledgeBase(spark, {n: spark.createDataFrame(sorted(rows), "s bigint, o bigint") for n, rows in relations.items()})


def rows(df):
    return sorted(map(tuple, df.collect()))


def deleted(small):
    return rows(small.deleted.select("rel", "s", "o"))


def test_inverse_pair_keeps_one_side(spark):
    kb = kb_of(spark, p={(1, 2), (3, 4)}, q={(2, 1), (4, 3)})
    small = compress(kb, [P("q(X,Y) :- p(Y,X)"), P("p(X,Y) :- q(Y,X)")])
    assert deleted(small) == [("q", 2, 1), ("q", 4, 3)]
    assert rows(small.answer(parse_query("q(X,Y)"))) == [(2, 1), (4, 3)]
    assert fitting.validate_recovery(small)


def test_symmetric_keeps_one_orientation(spark):
    small = compress(kb_of(spark, r={(1, 2), (2, 1), (5, 5)}), [P("r(X,Y) :- r(Y,X)")])
    assert deleted(small) == [("r", 2, 1)]
    assert rows(small.recover().select("s", "o")) == [(1, 2), (2, 1), (5, 5)]


def test_chain_goes_through_deleted_facts(spark):
    kb = kb_of(spark, a={(1, 2)}, b={(2, 3)}, h={(1, 3)}, c={(3, 4)}, g={(1, 4)})
    small = compress(kb, [P("h(X,Y) :- a(X,Z), b(Z,Y)"), P("g(X,Y) :- h(X,Z), c(Z,Y)")])
    assert deleted(small) == [("g", 1, 4), ("h", 1, 3)]
    assert rows(small.answer(parse_query("g(X,Y)"))) == [(1, 4)]
    assert small.emptied == {"h": 1, "g": 2} and len(small.rewritten(parse_query("g(X,Y)"))) == 1 and len(small.rewritten(parse_query("g(X,Y)"), 0)) == 1
    assert rows(small.answer(parse_query("g(X,Y)"), 1)) == [(1, 4)]
    assert rows(small.at_level(1).facts("g")) == [("g", 1, 4)] and rows(small.at_level(0).facts("h")) == [("h", 1, 3)]
    assert [(r.step, r.total_deleted) for r in small.levels().orderBy("step").collect()] == [(1, 1), (2, 2)]


def test_saved_base_answers_and_recovers(spark, tmp_path):
    kb = kb_of(spark, a={(1, 2)}, b={(2, 3)}, h={(1, 3)})
    small = compress(kb, [P("h(X,Y) :- a(X,Z), b(Z,Y)")])
    small.save(f"{tmp_path}/small")
    back = CompressedKB.load(spark, f"{tmp_path}/small")
    assert back.rules == small.rules and back.emptied == {"h": 1} and rows(back.kb.facts()) == rows(kb.facts())
    assert rows(back.answer(parse_query("h(X,Y)"))) == [(1, 3)] and fitting.validate_recovery(back)
    none = compress(kb, [])
    none.save(f"{tmp_path}/none")
    assert rows(CompressedKB.load(spark, f"{tmp_path}/none").at_level().facts()) == rows(kb.facts())


def test_second_derivation_counts_behind_a_deleted_body(spark):
    kb = kb_of(spark, a={(1, 2), (1, 5)}, b={(2, 3), (5, 3)}, c={(2, 3)}, h={(1, 3)})
    small = compress(kb, [P("b(X,Y) :- c(X,Y)"), P("h(X,Y) :- a(X,Z), b(Z,Y)")])
    assert ("h", 1, 3) in deleted(small) and fitting.validate_recovery(small)


def test_inexact_unsafe_and_recursive_rules(spark):
    kb = kb_of(spark, a={(1, 2)}, b={(2, 3)}, h=set() or {(9, 9)}, t={(1, 2), (2, 3), (1, 3)})
    assert not exact(kb, P("h(X,Y) :- a(X,Z), b(Z,Y)"))
    with pytest.raises(ValueError, match="unsafe"):
        compress(kb, [P("h(X,Y) :- a(X,Z)")])
    with pytest.raises(ValueError, match="counter-examples: h"):
        compress(kb, [P("h(X,Y) :- a(X,Z), b(Z,Y)"), P("t(X,Y) :- a(X,Y)")])
    none = compress(kb, [P("t(X,Y) :- t(X,Z), t(Z,Y)")])
    assert none.rules == [] and [str(r) for r, _ in none.left_out] == ["t(X,Y) :- t(X,Z), t(Z,Y)"]
    stats = verify_rules(kb, [P("h(X,Y) :- a(X,Z), b(Z,Y)"), P("t(X,Y) :- t(X,Z), t(Z,Y)"), P("h(X,Y) :- h(X,Z), a(Z,Y)")]).orderBy("rule_id").collect()
    assert [(r.support, r.counterexamples) for r in stats] == [(1, 1), (1, 0), (0, 0)]
    assert entails(kb, [P("t(X,Y) :- t(X,Y)")], P("t(X,Y) :- t(X,Z), t(Z,Y)"))


def test_closure_ends_on_cycles(spark):
    kb = kb_of(spark, e={(1, 2), (2, 3), (3, 1)})
    got = closure(kb, [P("t(X,Y) :- e(X,Y)"), P("t(X,Y) :- t(X,Z), t(Z,Y)")])
    assert got.where("rel = 't'").count() == 9
    assert setops.equal(closure(kb, []), kb.facts())


def test_random_bases_round_trip(spark):
    rng = random.Random(5)
    rules = [P("h(X,Y) :- a(X,Z), b(Z,Y)"), P("q(X,Y) :- h(Y,X)"), P("h(X,Y) :- q(Y,X)"), P("s(X,Y) :- s(Y,X)"), P("s(X,Y) :- a(X,Z), a(Y,Z)")]
    for _ in range(3):
        base = kb_of(spark, **{n: {(rng.randint(1, 5), rng.randint(1, 5)) for _ in range(6)} for n in "abhqs"})
        kb = KnowledgeBase.from_facts(spark, checkpoint(closure(base, rules)))  # all rules hold there
        for method in (compress, compress_sets):
            small = method(kb, rules if method is compress else rules[:1])
            assert fitting.validate_recovery(small), method
        small = compress(kb, rules)
        for q in ("h(X0, X1), s(X0, X2)", "?(X,Y) :- q(X,Z), s(Z,Y)", "?(X) :- h(X,X)"):
            assert rows(small.answer(parse_query(q))) == rows(answer(kb, parse_query(q))), q


def test_planner_edges(spark):
    kb = kb_of(spark, a={(1, 2), (3, 3), (4, 2)}, b={(2, 7)})
    assert rows(answer(kb, parse_query("?(X) :- a(X,X)"))) == [(3,)]
    assert rows(answer(kb, parse_query("?(X,Y) :- a(X,2), b(Z,Y)"))) == [(1, 7), (4, 7)]
    assert rows(answer(kb, parse_query("?(X) :- a(X,Y), nothing(Z,W)"))) == []
    assert rows(answer(kb, parse_query("?(X) :- a(X,Y), b(Z,W)"))) == [(1,), (3,), (4,)]
    assert holds(kb, parse_query("?() :- a(X,Y), b(Y,Z)")) and not holds(kb, parse_query("?() :- b(X,X)"))
    assert rows(answer(kb, parse_query("?() :- b(X,X)"))) == []
    with pytest.raises(ValueError):
        answer(kb, parse_query("?(W) :- a(X,Y)"))
    for semi in (True, False):
        assert rows(answer(kb, parse_query("?(X,V) :- a(X,Y), b(Y,V), a(X,Y)"), semi)) == [(1, 7), (4, 7)]


def test_semi_joins_in_the_plan(spark):
    kb = kb_of(spark, a={(1, 2)}, b={(1, 7)})
    plan = lambda text: answer(kb, parse_query(text))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan("?(X0, X1) :- a(X0, X1), b(X0, X2)") and "Inner" not in plan("?(X0, X1) :- a(X0, X1), b(X0, X2)")
    assert "Join" not in plan("a(X0, X1), b(X0, X2)")  # a star's atoms meet in one aggregate


def test_stars(spark):
    kb = kb_of(spark, a={(1, 2), (1, 3), (4, 4), (5, 1)}, b={(1, 7), (4, 7)}, c={(4, 1), (1, 1), (9, 9)})
    for text, want in (("a(X0, X1), b(X0, X2), c(X0, X3)", [(1,), (4,)]), ("?(X,Y) :- a(X,Y), b(X,Z), c(X,W)", [(1, 2), (1, 3), (4, 4)]), ("?(X) :- a(X,X), c(X,Y), a(X,4)", [(4,)]), ("?() :- a(X,Y), b(X,Z), c(W,W)", [(1,)]), ("?(X) :- a(X,Y), b(Z,W), c(V,U)", [(1,), (4,), (5,)])):
        for semi in (True, False):
            assert rows(answer(kb, parse_query(text), semi)) == want, text


def test_files_and_dictionary(spark, tmp_path):
    kb = kb_of(spark, p={(1, 2), (3, 4)}, q={(2, 1)})
    kb.dictionary = number(spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "name string"))
    assert rows(kb.dictionary) == [("a", 1), ("b", 2)]
    kb.save(f"{tmp_path}/kb")
    back = KnowledgeBase.load(spark, f"{tmp_path}/kb")
    assert setops.equal(back.facts(), kb.facts()) and rows(back.counts()) == [("p", 2), ("q", 1)] and back.dictionary.count() == 2
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/meta.txt").write_text("p\t2\t2\nc\t1\t2\n")
    (tmp_path / "csv/p.csv").write_text("p_1,p_2\n1,2\n1,2\n3,4\n")
    (tmp_path / "csv/c.csv").write_text("c_1\n5\nx\n6\n")
    named = spark.createDataFrame([("c", 77)], "name string, id bigint")
    read = KnowledgeBase.read_csv(spark, f"{tmp_path}/csv", dictionary=named)
    assert rows(read.facts()) == [("p", 1, 2), ("p", 3, 4), ("type", 5, 77), ("type", 6, 77)]
    read.write_folder(f"{tmp_path}/out")
    read.write_triples(f"{tmp_path}/triples")
    assert spark.read.csv(f"{tmp_path}/triples", sep="\t").count() == 4
    (tmp_path / "n.tsv").write_text("<http://x#a>\t<http://x#likes>\t<http://x#b>\n<http://x#a>\trdf#type\t<http://x#c>\n")
    named = KnowledgeBase.read_triples(spark, f"{tmp_path}/n.tsv")
    assert named.names == ["likes", "t"] and named.dictionary.count() == 3
    read.register_views()
    assert spark.sql("select p_1 from p where p_2 = 4").first()[0] == 3


def test_mine_fit_and_evaluate(spark):
    a = {(i, i + 100) for i in range(40)}
    kb = kb_of(spark, a=a, b={(i + 100, i % 5 + 200) for i in range(40)}, h={(i, i % 5 + 200) for i in range(40)}, inv={(y, x) for x, y in a})
    found = [str(r) for r, _ in mine_rules(kb, 2, 30)]
    assert {"h(X,Y) :- a(X,Z1), b(Z1,Y)", "inv(X,Y) :- a(Y,X)", "a(X,Y) :- inv(Y,X)"} <= set(found)
    got = fitting.fit(kb, fitting.one_atom_queries(kb), max_len=2)
    assert got.compressed.deleted.count() >= 80 and 1 <= got.level <= len(got.compressed.rules)
    report = fitting.evaluate(got, fitting.one_atom_queries(kb)[:2])
    assert len(report) == 2 and fitting.validate_recovery(got.compressed)
    assert fitting.fit(kb, tuned=False, rules=[P("inv(X,Y) :- a(Y,X)")]).level == 1


def test_result_does_not_depend_on_partitions(spark):
    kb = kb_of(spark, a={(1, 2), (1, 5), (6, 2)}, b={(2, 3), (5, 3)}, h={(1, 3), (6, 3)})
    first = deleted(compress(kb, [P("h(X,Y) :- a(X,Z), b(Z,Y)")]))
    other = KnowledgeBase(spark, {n: df.repartition(7, F.rand(1)) for n, df in kb.relations.items()})
    assert deleted(compress(other, [P("h(X,Y) :- a(X,Z), b(Z,Y)")])) == first


def test_paths_of_three_are_mined_by_default(spark):
    n = range(40)
    kb = kb_of(spark, a={(i, 100 + i) for i in n}, b={(100 + i, 200 + i) for i in n}, c={(200 + i, 300 + i) for i in n}, h={(i, 300 + i) for i in n})
    assert P("h(X,Y) :- a(X,Z1), b(Z1,Z2), c(Z2,Y)") in [r for r, _ in mine_rules(kb)]


def test_a_hub_does_not_make_the_miner_join_its_pairs(spark):
    """Two relations into one hub: a and its way back have the square of the hub's degree in end pairs."""
    n = 400
    kb = kb_of(spark, a={(i, 9000) for i in range(n)}, b={(9000, 1)} | {(i, 7000 + i) for i in range(n)}, h={(i, 1) for i in range(n)}, c={(7000 + i, i) for i in range(n)})
    from corollary.operators import mine

    steps = mine._steps(kb)
    ends = mine._Ends(steps)
    possible = {tuple(r.sig) for r in ends.possible(steps, 2, n + 1).collect()}
    assert ("+a", "-a") not in possible and ("+a", "+b") in possible
    found = [str(r) for r, _ in mine_rules(kb)]
    assert "h(X,Y) :- a(X,Z1), b(Z1,Y)" in found and "c(X,Y) :- b(Y,X)" not in found
    rows_joined = mine._pairs(steps, ends.possible(steps, 3, n + 1).select("sig"), 3, ends, n + 1).count()
    assert rows_joined <= 40 * kb.facts().count()


def test_mined_rules_are_all_exact_path_rules(spark):
    """Against all signatures of three steps on random facts."""
    import itertools

    rng = random.Random(3)
    base = {n: {(rng.randint(1, 4), rng.randint(1, 4)) for _ in range(4)} for n in "ab"}
    base["h"] = {(x, y) for x, z in base["a"] for w, y in base["b"] if z == w} or {(1, 1)}
    kb = kb_of(spark, **base)
    walk = {s + n: f if s == "+" else {(o, x) for x, o in f} for n, f in base.items() for s in "+-"}
    want = set()
    for n in (1, 2, 3):
        for sig in itertools.product(walk, repeat=n):
            pairs = walk[sig[0]]
            for s in sig[1:]:
                pairs = {(x, y) for x, z in pairs for w, y in walk[s] if z == w}
            want |= {(h, sig) for h, f in base.items() if pairs and pairs <= f and sig != ("+" + h,)}
    from corollary.operators.mine import mined

    assert {(r.head, tuple(r.sig)) for r in mined(kb, 3, 1).collect()} == want


def test_named_constants_and_folders(spark, tmp_path):
    folder = tmp_path / "kb"
    folder.mkdir()
    (folder / "meta.txt").write_text("likes\t2\t3\nknows\t2\t1\n")
    (folder / "mapping.txt").write_text("bob\nAlice7\nhttp://x.org/c 3\n")
    (folder / "likes.csv").write_text("likes_1,likes_2\n1,2\n2,3\n3,1\n")
    (folder / "knows.csv").write_text("knows_1,knows_2\n1,2\n")
    (folder / "rules.txt").write_text("likes(X,Y) :- knows(X,Y)\nlikes(X,Y) :- other(X,Y)\nlikes(X,Y) :- knows(X,Z)\n")
    kb = KnowledgeBase.read_folder(spark, str(folder))
    assert dict(map(tuple, kb.dictionary.collect())) == {"null": 0, "bob": 1, "Alice7": 2, "http://x.org/c": 3}
    one, two = kb.numbered(parse_query("?(X) :- likes(X, Alice7)"), parse_query("?(X1) :- likes(http://x.org/c, X1)"))
    assert rows(answer(kb, one)) == [(1,)] and rows(answer(kb, two)) == [(1,)]
    with pytest.raises(ValueError, match="nobody"):
        kb.numbered(parse_query("?(X) :- likes(X, nobody)"))
    read = kb.read_rules(f"{folder}/rules.txt")
    assert [str(r) for r in read] == ["likes(X,Y) :- knows(X,Y)"]
    with_bob = kb.numbered(P("likes(X,Y) :- knows(X,Y), likes(bob,X)"))
    assert [str(r) for r in kb.with_names(with_bob)] == ["likes(X,Y) :- knows(X,Y), likes(bob,X)"]
    kb.write_rules([*read, *with_bob], f"{tmp_path}/dump", names=True)
    assert kb.read_rules(f"{tmp_path}/dump", names=True) == [*read, *with_bob]
    (folder / "rules.txt").write_text("likes(X,Y) :- likes(X,Z), likes(Z,Y)\n")
    with pytest.raises(ValueError):
        kb.read_rules(f"{folder}/rules.txt")


def test_report(spark, tmp_path):
    import json

    kb = kb_of(spark, a={(i, i + 100) for i in range(9)}, inv={(i + 100, i) for i in range(9)})
    got = fitting.fit(kb, tuned=False, rules=[P("inv(X,Y) :- a(Y,X)"), P("a(X,Y) :- inv(X,Y)"), P("inv(X,Y) :- a(Y,X), inv(X,Z)")], general_first=True, by_support=False)
    queries = fitting.one_atom_queries(kb)
    out = fitting.report(got, queries, queries[:1], rounds=2, decompress=True, path=f"{tmp_path}/report")
    assert json.loads(spark.read.text(f"{tmp_path}/report").first()[0]) == json.loads(json.dumps(out))
    assert out["recovered"] and out["ratio"] == 0.5 and out["deleted"] == 9 and out["rule_set_size"] == 2 and len(out["test"]["queries"]) == 1 and len(out["left_out"]) == 2
    assert "origin_s" not in fitting.report(got, queries, ucq_only=True)["train"]


def test_shared_sub_queries(spark):
    from corollary.plans.share import answer_shared, shared

    rng = random.Random(4)
    kb = kb_of(spark, **{n: {(rng.randint(1, 6), rng.randint(1, 6)) for _ in range(12)} for n in "abcd"})
    union = tuple(parse_query(q) for q in ("?(X,Y) :- a(X,Z), b(Z,Y), c(Y,W)", "?(X,Y) :- c(X,Y), a(U,V), b(V,X)", "?(X,Y) :- d(X,Y)", "?(X,Y) :- a(X,Z), b(Z,W), c(W,Y)"))
    base, members = shared(kb, list(union))
    assert len(base.names) > 4 and sum(len(m.atoms) for m in members) < sum(len(m.atoms) for m in union)
    assert rows(answer_shared(kb, union)) == rows(answer(kb, union))
    assert shared(kb, [union[2]])[1] == [union[2]]
