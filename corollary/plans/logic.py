"""Unification, homomorphisms, subsumption and cores; rules and queries have a few atoms."""

from __future__ import annotations

from corollary.plans.terms import CQ, Atom, Const, Rule, Term, Var


def unify(a: Atom, b: Atom) -> dict[Term, Term] | None:
    """A most general substitution that makes both atoms equal, or None."""
    if a.rel != b.rel or len(a.terms) != len(b.terms):
        return None
    s: dict[Term, Term] = {}

    def find(t: Term) -> Term:
        while t in s:
            t = s[t]
        return t

    for x, y in zip(a.terms, b.terms):
        x, y = find(x), find(y)
        if x == y:
            continue
        if isinstance(y, Const) and isinstance(x, Const):
            return None
        # keep constants, then the query's names (a's) over a renamed rule's (b's)
        if isinstance(x, Const) or isinstance(y, Var) and y.name.startswith("_"):
            x, y = y, x
        s[x] = y
    return {t: find(t) for t in s}


def homomorphism(source: tuple[Atom, ...], target: tuple[Atom, ...], start: dict[Term, Term] | None = None) -> dict[Term, Term] | None:
    """A mapping of source's variables that sends each of its atoms to one of target's."""
    s = dict(start or {})
    if not source:
        return s
    # the atom with most terms fixed first
    first = max(range(len(source)), key=lambda i: sum(isinstance(t, Const) or t in s for t in source[i].terms))
    atom, rest = source[first], source[:first] + source[first + 1 :]
    for goal in target:
        if goal.rel != atom.rel or len(goal.terms) != len(atom.terms):
            continue
        more, ok = dict(s), True
        for t, u in zip(atom.terms, goal.terms):
            if isinstance(t, Const):
                ok = t == u
            else:
                ok = more.setdefault(t, u) == u
            if not ok:
                break
        if ok and (found := homomorphism(rest, target, more)) is not None:
            return found
    return None


def covers(general: CQ, special: CQ) -> bool:
    """Whether every answer of special is one of general (a containment mapping)."""
    if len(general.answer) != len(special.answer):
        return False
    s: dict[Term, Term] = {}
    for t, u in zip(general.answer, special.answer):
        if isinstance(t, Const):
            if t != u:
                return False
        elif s.setdefault(t, u) != u:
            return False
    return homomorphism(general.atoms, special.atoms, s) is not None


def core(q: CQ) -> CQ:
    """An equivalent query with as few atoms as possible."""
    fixed = {t: t for t in q.answer if isinstance(t, Var)}
    atoms = list(dict.fromkeys(q.atoms))
    i = 0
    while i < len(atoms):
        less = tuple(atoms[:i] + atoms[i + 1 :])
        # an atom can only go where another one of its relation stays
        if any(a.rel == atoms[i].rel for a in less) and homomorphism(tuple(atoms), less, fixed) is not None:
            atoms = list(less)
            i = 0
        else:
            i += 1
    return CQ(q.answer, tuple(atoms))


def subsumes(general: Rule, special: Rule) -> bool:
    """Whether special follows from general alone: its body holds an instance of general's, with the
    same head."""
    general = general.put({v: Var(f"_g_{v.name}") for v in general.variables})
    if general.head.rel != special.head.rel:
        return False
    s = homomorphism((general.head,), (special.head,))
    return s is not None and homomorphism(general.body, special.body, s) is not None


def most_general(rules: list[Rule]) -> list[Rule]:
    """Rules without those that another one subsumes; of two that subsume each other the first stays."""
    out: list[Rule] = []
    for r in rules:
        if not any(subsumes(k, r) for k in out):
            out = [k for k in out if not subsumes(r, k)] + [r]
    return out
