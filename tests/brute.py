"""Conjunctive queries and rules on small sets of facts (rel, s, o), said plainly."""

from corollary.plans.terms import Const, Var


def bindings(facts, atoms):
    out = [{}]
    for a in atoms:
        more = []
        for b in out:
            for rel, *values in facts:
                c = dict(b)
                if rel == a.rel and all(t.value == v if isinstance(t, Const) else c.setdefault(t, v) == v for t, v in zip(a.terms, values)):
                    more.append(c)
        out = more
    return out


def answers(facts, q):
    return {tuple(b[t] if isinstance(t, Var) else t.value for t in q.answer) for b in bindings(facts, q.atoms)}


def chase(facts, rules):
    facts = set(facts)
    while True:
        new = {(r.head.rel, *h) for r in rules for h in answers(facts, r.as_query())}
        if new <= facts:
            return facts
        facts |= new


def largest(df):
    """The answer, and the most rows that any step of the plan, once run, has put out."""
    got = sorted(map(tuple, df.collect()))

    def walk(p):
        name = p.nodeName()
        if "AdaptiveSparkPlan" in name:
            yield from walk(p.executedPlan())
        elif "QueryStage" in name:
            yield from walk(p.plan())
        else:
            n = p.metrics().get("numOutputRows")
            if n.isDefined():
                yield n.get().value()
            for i in range(p.children().size()):
                yield from walk(p.children().apply(i))

    return got, max(walk(df._jdf.queryExecution().executedPlan()), default=0)
