"""Whether a rule set is first-order rewritable, by published sufficient classes.

Rules depend on each other where a head unifies with a body atom. Each strongly connected part of that
graph must be a single rule that does not depend on itself, or linear (one body atom), or domain
restricted (each head holds all variables of its body, or none), or sticky. Parts of none of these classes are
tried: rules here have no existential variables, so a step of backward chaining replaces one atom and leaves the
others alone; if the rewriting of each head ends, that of every query does, as it is made of these. A part whose
heads are rewritten within narrow bounds is bounded recursion, and taken.
"""

from __future__ import annotations

from corollary.plans.logic import unify
from corollary.plans.rewrite import Memo, NotRewritable, rewrite_relation
from corollary.plans.terms import Rule, Var, apart


#: Members of a union up to which rules of no known class are tried.
TRIED = 50


def dependencies(rules: list[Rule]) -> list[set[int]]:
    """For each rule those whose bodies may use its head."""
    return [{j for j, s in enumerate(rules) if any(unify(apart(r).head, a) is not None for a in s.body)} for r in rules]


def components(edges: list[set[int]]) -> list[list[int]]:
    """Strongly connected parts; reachability is enough for rule sets of a few hundred."""
    n = len(edges)
    reach = []
    for i in range(n):
        seen, todo = set(), list(edges[i])
        while todo:
            j = todo.pop()
            if j not in seen:
                seen.add(j)
                todo += edges[j]
        reach.append(seen)
    out, done = [], set()
    for i in range(n):
        if i not in done:
            part = sorted({i} | {j for j in reach[i] if i in reach[j]})
            done |= set(part)
            out.append(part)
    return out


def closures(rules: list[Rule]) -> list[set[int]]:
    """For each rule those that it is tied to by shared relations, in any number of steps, itself included."""
    parent: dict[str, str] = {}

    def find(n: str) -> str:
        while parent.setdefault(n, n) != n:
            parent[n] = n = parent[parent[n]]
        return n

    for r in rules:
        for a in r.body:
            parent[find(a.rel)] = find(r.head.rel)
    groups: dict[str, set[int]] = {}
    for i, r in enumerate(rules):
        groups.setdefault(find(r.head.rel), set()).add(i)
    return [groups[find(r.head.rel)] for r in rules]


def linear(rules: list[Rule]) -> bool:
    return all(len(r.body) == 1 for r in rules)


def domain_restricted(rules: list[Rule]) -> bool:
    return all(not r.head.variables or {v for a in r.body for v in a.variables} <= r.head.variables for r in rules)


def sticky(rules: list[Rule]) -> bool:
    """No marked variable stands twice in a body. Marked: variables that the head loses, and those that
    pass into a head position where some body has a marked one."""
    marked = {(i, v) for i, r in enumerate(rules) for a in r.body for v in a.variables if v not in r.head.variables}
    while True:
        places = {(a.rel, k) for i, r in enumerate(rules) for a in r.body for k, t in enumerate(a.terms) if (i, t) in marked}
        more = {(i, t) for i, r in enumerate(rules) for k, t in enumerate(r.head.terms) if isinstance(t, Var) and (r.head.rel, k) in places}
        if more <= marked:
            break
        marked |= more
    return all(sum(t == v for a in rules[i].body for t in a.terms) <= 1 for i, v in marked)


def in_a_class(rules: list[Rule], recursive: bool) -> bool:
    """Whether the rules of one strongly connected part are of a rewritable class."""
    return not recursive or linear(rules) or domain_restricted(rules) or sticky(rules)


def rewritable(rules: list[Rule], **bounds: int) -> bool:
    """Every part is in a rewritable class, and the bounded rewriter ends on every head."""
    program = Program(**bounds)
    return all(program.add(r) is None for r in rules)


class Program:
    """A rule set that grows and stays rewritable. A new rule is tested with the part of the dependency
    graph that it closes, and the heads whose rewritings it changes are rewritten; the rest stands."""

    def __init__(self, **bounds: int):
        self.rules: list[Rule] = []
        self.memo = Memo([], **bounds)
        self._uses: list[set[int]] = []  # for each rule those whose heads its body may use
        self._used: list[set[int]] = []
        self._heads: dict[str, set[int]] = {}
        self._bodies: dict[str, set[int]] = {}

    def add(self, rule: Rule, check: bool = True) -> str | None:
        """Take the rule, or say why not."""
        n, head = len(self.rules), apart(rule).head
        uses = {i for a in rule.body for i in self._heads.get(a.rel, ()) if unify(apart(self.rules[i]).head, a) is not None}
        used = {j for j in self._bodies.get(head.rel, ()) if any(unify(head, a) is not None for a in self.rules[j].body)}
        own = any(unify(head, a) is not None for a in rule.body)
        part = self._reached(uses, self._uses) & self._reached(used, self._used)
        recursive = own or bool(part)
        tied = [rule, *(self.rules[i] for i in sorted(part))]
        if check and not in_a_class(tied, recursive) and not self._bounded(rule, tied):
            return "of no rewritable class together with the rules before it"
        memo = self.memo.copy()
        changed = memo.add(rule)
        try:
            for rel in sorted({rule.head.rel, *(changed & self._heads.keys())}):
                memo.relation(rel)
        except NotRewritable as e:
            return f"not rewritten within the bounds: {e}"
        self.memo = memo
        self.rules.append(rule)
        self._uses.append(uses | ({n} if own else set()))
        self._used.append(used | ({n} if own else set()))
        for i in uses:
            self._used[i].add(n)
        for j in used:
            self._uses[j].add(n)
        self._heads.setdefault(rule.head.rel, set()).add(n)
        for a in rule.body:
            self._bodies.setdefault(a.rel, set()).add(n)
        return None

    def _bounded(self, rule: Rule, tied: list[Rule]) -> bool:
        """Whether the heads of a part of no known class are rewritten within narrow bounds."""
        try:
            for rel in sorted({r.head.rel for r in tied}):
                rewrite_relation(rel, [*self.rules, rule], most=TRIED, steps=10 * TRIED)
        except NotRewritable:
            return False
        return True

    def snapshot(self) -> tuple:
        return list(self.rules), self.memo, [set(x) for x in self._uses], [set(x) for x in self._used], *({k: set(v) for k, v in d.items()} for d in (self._heads, self._bodies))

    def restore(self, state: tuple) -> None:
        self.rules, self.memo, self._uses, self._used, self._heads, self._bodies = state

    @staticmethod
    def _reached(start: set[int], edges: list[set[int]]) -> set[int]:
        seen, todo = set(start), list(start)
        while todo:
            for j in edges[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return seen
