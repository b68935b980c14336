"""Backward chaining of conjunctive queries into unions of conjunctive queries.

Rules are safe Datalog, so each step unifies one atom with one rule's head and puts the body in its
place. Queries are reduced to their cores; a query that another one covers is dropped, which ends the
search for rule sets of first-order rewritable classes. Beyond the bounds ``NotRewritable`` is raised:
an answer is never partial.
"""

from __future__ import annotations

from collections import deque

from corollary.plans.logic import core, covers, unify
from corollary.plans.terms import CQ, UCQ, Atom, Rule, Var, apart, canonical


class NotRewritable(ValueError):
    pass


def rewrite(q: CQ, rules: list[Rule], most: int = 2000, steps: int = 20000) -> UCQ:
    """The union whose answers over the facts are q's answers over what the rules derive from them.
    The query itself comes first, if no other member covers it."""
    by_head: dict[str, list[Rule]] = {}
    for r in rules:
        by_head.setdefault(r.head.rel, []).append(r)
    found = [canonical(core(q))]
    names = {found[0]: relations(found[0])}
    todo = deque(found)
    while todo:
        one = todo.popleft()
        if one not in found:  # covered meanwhile
            continue
        for i, atom in enumerate(one.atoms):
            for rule in by_head.get(atom.rel, ()):
                steps -= 1
                if steps < 0 or len(found) > most:
                    raise NotRewritable(f"{q}: more than {most} queries or too many steps")
                rule = apart(rule)
                s = unify(atom, rule.head)
                if s is None:
                    continue
                new = canonical(core(CQ(one.answer, one.atoms[:i] + rule.body + one.atoms[i + 1 :]).put(s)))
                of_new = relations(new)
                # a query covers only those that have all its relations
                if any(names[k] <= of_new and covers(k, new) for k in found):
                    continue
                found = [k for k in found if not (of_new <= names[k] and covers(new, k))] + [new]
                names[new] = of_new
                todo.append(new)
    return tuple(found)


def relations(q: CQ) -> frozenset[str]:
    return frozenset(a.rel for a in q.atoms)


def rewrite_relation(rel: str, rules: list[Rule], **bounds: int) -> UCQ:
    x, y = Var("X"), Var("Y")
    return rewrite(CQ((x, y), (Atom(rel, (x, y)),)), rules, **bounds)


class Memo:
    """Rewritings of single relations, computed once."""

    def __init__(self, rules: list[Rule], **bounds: int):
        self.rules, self.bounds = list(rules), bounds
        self._of: dict[str, UCQ] = {}

    def relation(self, rel: str) -> UCQ:
        if rel not in self._of:
            self._of[rel] = rewrite_relation(rel, self.rules, **self.bounds)
        return self._of[rel]

    def add(self, rule: Rule) -> set[str]:
        """Forget what the new rule may change: relations whose rewritings reach its head. These are
        given back."""
        self.rules.append(rule)
        gone = {r for r, u in self._of.items() if any(a.rel == rule.head.rel for q in u for a in q.atoms)}
        self._of = {r: u for r, u in self._of.items() if r not in gone}
        return gone

    def copy(self) -> Memo:
        out = Memo(self.rules, **self.bounds)
        out._of = dict(self._of)
        return out

    def atom(self, atom: Atom) -> UCQ:
        """The rewriting of one atom, from its relation's: constants and repeated variables are put in."""
        out = []
        for q in self.relation(atom.rel):
            fresh = {v: Var(f"_a_{v.name}") for v in q.variables}
            q = q.put(fresh)
            s = unify(Atom("", q.answer), Atom("", atom.terms))
            if s is not None:
                out.append(CQ(tuple(dict.fromkeys(s.get(t, t) for t in atom.terms if isinstance(t, Var))), q.put(s).atoms))
        return tuple(out)
