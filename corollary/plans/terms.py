"""Terms, atoms, Horn rules and conjunctive queries.

A rule reads ``h(X,Y) :- b1(X,Z), b2(Z,Y)``, a query ``?(X0) :- r(X0, X1), q(X0, 7)`` or, without a
head, ``r(X0, X1), q(X0, X2)``: then a single atom answers with all its variables and several atoms
with the first one's first variable. A term is a constant if it starts with a digit or a minus sign,
holds ``://`` or has lower-case letters only; other terms are variables. Constants are numbers here:
names go through the entity dictionary before they reach a plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import count


@dataclass(frozen=True, order=True)
class Var:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True, order=True)
class Const:
    value: int | str

    def __str__(self) -> str:
        return str(self.value)


Term = Var | Const


@dataclass(frozen=True, order=True)
class Atom:
    rel: str
    terms: tuple[Term, ...]

    def __str__(self) -> str:
        return f"{self.rel}({','.join(map(str, self.terms))})"

    @property
    def variables(self) -> set[Var]:
        return {t for t in self.terms if isinstance(t, Var)}

    def put(self, s: dict[Term, Term]) -> Atom:
        return Atom(self.rel, tuple(s.get(t, t) for t in self.terms))


@dataclass(frozen=True)
class CQ:
    """answer: the head's terms; atoms: the body, as a set in order of writing."""

    answer: tuple[Term, ...]
    atoms: tuple[Atom, ...]

    def __str__(self) -> str:
        return f"?({','.join(map(str, self.answer))}) :- {', '.join(map(str, self.atoms))}"

    @property
    def variables(self) -> set[Var]:
        return {v for a in self.atoms for v in a.variables}

    def put(self, s: dict[Term, Term]) -> CQ:
        return CQ(tuple(s.get(t, t) for t in self.answer), tuple(dict.fromkeys(a.put(s) for a in self.atoms)))


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]

    def __str__(self) -> str:
        return f"{self.head} :- {', '.join(map(str, self.body))}"

    @property
    def variables(self) -> set[Var]:
        return self.head.variables | {v for a in self.body for v in a.variables}

    @property
    def safe(self) -> bool:
        """Every variable of the head stands in the body."""
        return bool(self.body) and self.head.variables <= {v for a in self.body for v in a.variables}

    @property
    def symmetric(self) -> bool:
        """``p(X,Y) :- p(Y,X)``."""
        return len(self.body) == 1 and self.body[0].rel == self.head.rel and len(self.head.variables) == 2 and self.body[0].terms == self.head.terms[::-1]

    def as_query(self) -> CQ:
        return CQ(self.head.terms, self.body)

    def put(self, s: dict[Term, Term]) -> Rule:
        return Rule(self.head.put(s), tuple(a.put(s) for a in self.body))


UCQ = tuple[CQ, ...]

_fresh = count()


def apart(rule: Rule) -> Rule:
    """The rule with variables that stand nowhere else."""
    n = next(_fresh)
    return rule.put({v: Var(f"_{n}_{v.name}") for v in rule.variables})


def canonical(q: CQ) -> CQ:
    """The query with variables named V0, V1, ... by their first place."""
    names: dict[Term, Term] = {}
    for t in (*q.answer, *(t for a in q.atoms for t in a.terms)):
        if isinstance(t, Var) and t not in names:
            names[t] = Var(f"V{len(names)}")
    return q.put(names)


_ATOM = re.compile(r"\s*([^\s(),]+)\s*\(([^()]*)\)\s*(,|$)")


def term(text: str) -> Term:
    text = text.strip()
    if not text:
        raise ValueError("an empty term")
    if re.fullmatch(r"-?[0-9]+", text):
        return Const(int(text))
    if text[0].isdigit() or "://" in text or (text.islower() and text.isalpha()):
        return Const(text)
    return Var(text)


def _atoms(text: str) -> tuple[Atom, ...]:
    out, at = [], 0
    text = text.strip().rstrip(".")
    while at < len(text):
        m = _ATOM.match(text, at)
        if not m:
            raise ValueError(f"not a list of atoms: {text!r}")
        out.append(Atom(m[1], tuple(term(t) for t in m[2].split(",")) if m[2].strip() else ()))
        at = m.end()
    return tuple(out)


def parse_rule(text: str) -> Rule:
    """A rule; ``<=`` may stand for ``:-``. Atoms ``=(X,c)`` in the body bind X."""
    head, sep, body = text.replace("<=", ":-").partition(":-")
    if not sep or len(heads := _atoms(head)) != 1:
        raise ValueError(f"not a rule: {text!r}")
    atoms = _atoms(body)
    bound = {a.terms[0]: a.terms[1] for a in atoms if a.rel == "="}
    return Rule(heads[0], tuple(a for a in atoms if a.rel != "=")).put(bound)


def parse_query(text: str) -> CQ:
    head, sep, body = text.partition(":-")
    if sep:
        return CQ(_atoms(head)[0].terms, _atoms(body))
    atoms = _atoms(text)
    if not atoms:
        raise ValueError("an empty query")
    if len(atoms) == 1:
        return CQ(tuple(dict.fromkeys(t for t in atoms[0].terms if isinstance(t, Var))), atoms)
    return CQ((atoms[0].terms[0],), atoms)


def names_in(*items: CQ | Rule) -> set[str]:
    """The texts that may name an entity: constants that are no numbers, and variables longer than a
    letter with digits."""
    terms = {t for x in items for a in ((x.head, *x.body) if isinstance(x, Rule) else (Atom("", x.answer), *x.atoms)) for t in a.terms}
    return {str(t.value) for t in terms if isinstance(t, Const) and isinstance(t.value, str)} | {t.name for t in terms if isinstance(t, Var) and not re.fullmatch(r"_.*|[A-Za-z][0-9]*", t.name)}


def numbered(item: CQ | Rule, ids: dict[str, int]) -> CQ | Rule:
    """The query or rule with names as numbers; a constant without a number raises."""
    lost = {n for n in names_in(item) if n not in ids and isinstance(term(n), Const)}
    if lost:
        raise ValueError(f"no entity has the name: {', '.join(sorted(lost))}")
    return item.put({t: Const(i) for n, i in ids.items() for t in (Var(n), Const(n))})


def named(rule: Rule, names: dict[int, str]) -> Rule:
    """The rule with numbers as names, where they have one."""
    return rule.put({Const(i): Const(n) for i, n in names.items()})


def rule_set_size(rules: list[Rule]) -> int:
    """Atoms of all rules."""
    return sum(len(r.body) + 1 for r in rules)


def parse_workload(text: str) -> list[CQ]:
    """One query per line."""
    return [parse_query(line) for line in text.splitlines() if line.strip()]


def parse_mined(text: str) -> list[tuple[Rule, int, int]]:
    """Lines ``predicted, correct, confidence, rule`` separated by tabs: (rule, predicted, correct)."""
    rows = [line.split("\t") for line in text.splitlines() if line.strip()]
    return [(parse_rule(r[3]), int(r[0]), int(r[1])) for r in rows]
