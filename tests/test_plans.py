"""Rules and rewriting without Spark: against brute force on small sets of facts."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corollary.plans.fus import domain_restricted, linear, rewritable, sticky
from corollary.plans.logic import core, covers, most_general, subsumes, unify
from corollary.plans.rewrite import Memo, NotRewritable, rewrite
from corollary.plans.terms import CQ, Atom, Const, Var, canonical, parse_mined, parse_query, parse_rule, parse_workload


def matches(facts, q):
    out = set()

    def go(i, s):
        if i == len(q.atoms):
            out.add(tuple(t.value if isinstance(t, Const) else s[t] for t in q.answer))
            return
        a = q.atoms[i]
        for rel, *args in facts:
            if rel == a.rel:
                more = dict(s)
                if all((t.value == v) if isinstance(t, Const) else more.setdefault(t, v) == v for t, v in zip(a.terms, args)):
                    go(i + 1, more)

    go(0, {})
    return out


def chase(facts, rules):
    facts = set(facts)
    while True:
        new = {(r.head.rel, *t) for r in rules for t in matches(facts, r.as_query())} - facts
        if not new:
            return facts
        facts |= new


def test_parse_and_print():
    r = parse_rule("h( X,Y ) :- b1(X,Z),b2(Z , Y).")
    assert str(r) == "h(X,Y) :- b1(X,Z), b2(Z,Y)" and r.safe
    assert parse_rule("h(X,Y) <= a(X,Y)") == parse_rule("h(X,Y):-a(X,Y)")
    assert parse_rule("h(X,Y) :- a(X,Z), =(Y,7)").head == Atom("h", (Var("X"), Const(7)))
    assert not parse_rule("h(X,Y) :- a(X,Z)").safe
    assert parse_query("r(X0, X1), q(X0, X2)").answer == (Var("X0"),)
    assert parse_query("r(X0, X1)").answer == (Var("X0"), Var("X1"))
    assert parse_query("?(X) :- a(X,7), b(X,http://x)").atoms[1].terms[1] == Const("http://x")
    assert len(parse_workload("a(X0, X1)\n\nb(X0, X1), c(X0, X2)\n")) == 2
    assert parse_mined("30\t30\t1.0\th(X,Y) <= a(X,Y)\n") == [(parse_rule("h(X,Y) :- a(X,Y)"), 30, 30)]
    for bad in ("", "h(X,Y)", "a(X,Y :- b(X,Y)", "h(X),g(X) :- b(X,Y)"):
        with pytest.raises(ValueError):
            parse_rule(bad)
    with pytest.raises(ValueError):
        parse_query("")


def test_unify_and_subsumption():
    assert unify(parse_rule("p(X,X) :- a(X,X)").head, parse_query("p(3,4)").atoms[0]) is None
    a, b = parse_rule("h(X,Y) :- a(X,Y)"), parse_rule("h(X,Y) :- a(X,Y), b(Y,Z)")
    assert subsumes(a, b) and not subsumes(b, a)
    assert most_general([b, a]) == [a]
    assert parse_rule("p(X,Y) :- p(Y,X)").symmetric and not parse_rule("p(X,Y) :- q(Y,X)").symmetric
    q = parse_query("?(X) :- a(X,Y), a(X,Z)")
    assert len(core(q).atoms) == 1 and covers(q, core(q)) and covers(core(q), q)
    assert canonical(parse_query("?(B) :- a(B,A)")) == canonical(parse_query("?(X) :- a(X,Y)"))


def test_classes():
    p = lambda *t: [parse_rule(x) for x in t]
    assert rewritable(p("q(X,Y) :- p(Y,X)", "p(X,Y) :- q(Y,X)"))
    assert rewritable(p("s(X,Y) :- s(Y,X)"))
    assert rewritable(p("h(X,Y) :- a(X,Z), b(Z,Y)", "g(X,Y) :- h(X,Z), c(Z,Y)"))
    assert not rewritable(p("t(X,Y) :- t(X,Z), t(Z,Y)"))
    assert linear(p("a(X,Y) :- b(X,Y)")) and domain_restricted(p("a(X,Y) :- b(X,Y), a(Y,X)")) and not sticky(p("t(X,Y) :- t(X,Z), t(Z,Y)"))
    with pytest.raises(NotRewritable):
        rewrite(parse_query("t(X,Y)"), p("t(X,Y) :- t(X,Z), t(Z,Y)"), most=20)


def test_answers_may_be_unified():
    rules = [parse_rule("p(X,X) :- a(X,Y)")]
    got = rewrite(parse_query("?(X,Y) :- p(X,Y)"), rules)
    assert any(q.answer[0] == q.answer[1] for q in got)
    assert set().union(*(matches({("a", 1, 2)}, q) for q in got)) == {(1, 1)}


RULES = [parse_rule(r) for r in ("h(X,Y) :- a(X,Z), b(Z,Y)", "g(X,Y) :- h(X,Z), c(Z,Y)", "b(X,Y) :- c(Y,X)", "a(X,Y) :- a(Y,X)", "g(X,X) :- c(X,Y)", "h(X,Y) :- g(X,Y)")]
FACTS = st.sets(st.tuples(st.sampled_from("abcgh"), st.integers(1, 3), st.integers(1, 3)), max_size=7)
TERMS = st.sampled_from([Var("X"), Var("Y"), Var("Z"), Const(1)])
ATOMS = st.lists(st.builds(lambda r, a, b: Atom(r, (a, b)), st.sampled_from("abcgh"), TERMS, TERMS), min_size=1, max_size=3)


@settings(max_examples=150, deadline=None)
@given(FACTS, st.sets(st.sampled_from(RULES[:5]), max_size=5), ATOMS)
def test_rewriting_answers_as_the_chase(facts, rules, atoms):
    rules = sorted(rules, key=str)
    q = CQ(tuple(sorted({v for a in atoms for v in a.variables}))[:2], tuple(dict.fromkeys(atoms)))
    try:
        union = rewrite(q, rules, most=150, steps=3000)
    except NotRewritable:
        return
    assert set().union(*(matches(facts, m) for m in union)) == matches(chase(facts, rules), q)


def test_memo_forgets_what_changes():
    memo = Memo([RULES[0]])
    assert len(memo.relation("g")) == 1
    memo.add(RULES[1])
    assert len(memo.relation("g")) == 3
    constants = memo.atom(parse_query("g(X,7)").atoms[0])
    facts = {("a", 1, 2), ("b", 2, 3), ("c", 3, 7), ("g", 9, 7), ("g", 9, 8)}
    assert set().union(*(matches(facts, q) for q in constants)) == {(1,), (9,)}
    assert list(itertools.chain(memo.rules)) == RULES[:2]


def test_many_rules_are_tested_in_seconds():
    import time

    from corollary.plans.fus import Program, closures
    from corollary.plans.terms import rule_set_size

    began = time.perf_counter()
    program = Program()
    for i in range(200):
        assert program.add(parse_rule(f"q{i}(X,Y) :- p{i}(Y,X)")) is None
    chain = Program()
    for i in range(40):
        assert chain.add(parse_rule(f"h{i + 1}(X,Y) :- h{i}(X,Z), e{i}(Z,Y)")) is None
    assert time.perf_counter() - began < 20
    assert len(chain.memo.relation("h40")) == 41 and len(chain.memo.relation("h3")) == 4
    assert "class" in chain.add(parse_rule("h0(X,Y) :- h40(X,Z), h40(Z,Y)")) and len(chain.rules) == 40
    assert chain.add(parse_rule("h0(X,Y) :- g(X,Y)")) is None and len(chain.memo.relation("h3")) == 5  # what was rewritten before is rewritten again
    rules = [parse_rule(r) for r in ("a(X,Y) :- b(X,Y)", "c(X,Y) :- d(Y,X)", "e(X,Y) :- b(X,Z), c(Z,Y)", "x(X,Y) :- y(X,Y)")]
    assert closures(rules) == [{0, 1, 2}, {0, 1, 2}, {0, 1, 2}, {3}] and rule_set_size(rules) == 9
