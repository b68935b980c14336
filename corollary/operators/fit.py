"""From facts and a workload to a compressed base: mine, filter, compress, tune; and its evaluation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from statistics import mean

from pyspark.sql import DataFrame

from corollary.functions.setops import equal
from corollary.operators.compress import CompressedKB, compress
from corollary.operators.mine import mine_rules
from corollary.operators.tune import Tuned, tune, workload_seconds
from corollary.operators.verify import verify_rules
from corollary.plans.logic import most_general, subsumes
from corollary.plans.query import answer
from corollary.plans.terms import CQ, Atom, Rule, Var, rule_set_size


def filter_rules(kb, rules: list[Rule], most: int = 1500, left_out: list | None = None, mined: dict[Rule, int] | None = None) -> list[Rule]:
    """Safe and exact rules with support, by support, body length and text; among rules of equal support
    only the most general. ``most`` of them are looked at; left_out takes (rule, why) of all others. mined: the
    support of rules that are known to be exact; the others are verified, in one job."""
    gone = left_out if left_out is not None else []
    safe = [r for r in dict.fromkeys(rules) if r.safe and r.head not in r.body]
    gone += [(r, "unsafe, or its head in its body") for r in dict.fromkeys(rules) if not (r.safe and r.head not in r.body)]
    support = {i: (mined or {}).get(r) for i, r in enumerate(safe)}
    unknown = [i for i, n in support.items() if n is None]
    if unknown:
        for r in verify_rules(kb, [safe[i] for i in unknown]).collect():  # one row per rule
            support[unknown[r.rule_id]] = 0 if r.counterexamples else r.support
    gone += [(safe[i], "not exact, or without support") for i, n in support.items() if not n]
    good = sorted((i for i, n in support.items() if n), key=lambda i: (-support[i], len(safe[i].body), str(safe[i])))
    gone += [(safe[i], "behind the rules of most support") for i in good[most:]]
    kept: list[int] = []
    for i in good[:most]:
        same = [j for j in kept if support[j] == support[i]]
        if any(subsumes(safe[j], safe[i]) for j in same):
            gone.append((safe[i], "a special case"))
            continue
        special = [j for j in same if subsumes(safe[i], safe[j])]
        gone += [(safe[j], "a special case") for j in special]
        kept = [j for j in kept if j not in special] + [i]
    return [safe[i] for i in kept]


def one_atom_queries(kb) -> list[CQ]:
    return [CQ((Var("X0"), Var("X1")), (Atom(n, (Var("X0"), Var("X1"))),)) for n in kb.names]


@dataclass
class Fitted:
    compressed: CompressedKB
    level: int
    tuned: Tuned | None
    left_out: list[tuple[Rule, str]] = field(default_factory=list)  # rules not taken, and why

    def answer(self, q: CQ) -> DataFrame:
        return self.compressed.answer(q, self.level)


def fit(kb, workload: list[CQ] = (), rules: list[Rule] | None = None, max_len: int = 3, min_support: int = 30, tuned: bool = True, acquisition: str = "qehvi", most: int = 1500, most_rules: int = 300, by_support: bool = True, general_first: bool = False) -> Fitted:
    """Mine (without ``rules``), filter, compress and tune. most, most_rules: rules looked at and taken;
    by_support=False keeps the rules' order; general_first drops special cases before anything else."""
    mined = dict(mine_rules(kb, max_len, min_support)) if rules is None else {}
    found = rules if rules is not None else list(mined)
    gone: list[tuple[Rule, str]] = []
    if general_first:
        kept = most_general(found)
        gone += [(r, "a special case") for r in found if r not in kept]
        found = kept
    good = filter_rules(kb, found, most, gone, mined)
    if not by_support:
        good.sort(key=found.index)
    small = compress(kb, good, most_rules=most_rules, verified=True)
    gone += small.left_out
    n = len(small.rules)
    if not (tuned and workload and n):
        return Fitted(small, n, None, gone)
    cr = [r.cr for r in small.levels().orderBy("step").collect()]
    origin = workload_seconds(answer(kb, q) for q in workload)
    result = tune(cr, lambda k: workload_seconds(small.answer(q, k) for q in workload) / origin, acquisition=acquisition)
    return Fitted(small, result.level, result, gone)


def evaluate(fitted: Fitted, workload: list[CQ], rounds: int = 1, ucq_only: bool = False) -> list[dict]:
    """For each query: its text, members of its rewriting, mean seconds of ``rounds`` runs on the original
    and on the compressed base. A wrong answer raises. ucq_only: no runs on the original, no comparison."""
    small, k, out = fitted.compressed, fitted.level, []
    for q in workload:
        b = small.answer(q, k)
        row = {"query": str(q), "members": len(small.rewritten(q, k)), "compressed_s": mean(workload_seconds([b]) for _ in range(rounds))}
        if not ucq_only:
            a = answer(small.kb, q)
            if not equal(a, b):
                raise AssertionError(f"the answers differ: {q}")
            row["origin_s"] = mean(workload_seconds([a]) for _ in range(rounds))
        out.append(row)
    return out


def report(fitted: Fitted, train: list[CQ], test: list[CQ] = (), rounds: int = 1, ucq_only: bool = False, decompress: bool = False, path: str | None = None) -> dict:
    """Measurements of a fitted base as one dictionary, written as JSON to ``path`` if there is one: facts
    kept and all, ratio, rules and their size, and for the workload that it was tuned on and one held out
    each query with the sums of seconds; with decompress whether the original facts come back."""
    small, k = fitted.compressed, fitted.level
    levels = {r.step: r for r in small.levels().collect()}  # one row per rule
    out: dict = {"level": k, "rules": k, "rule_set_size": rule_set_size(small.rules[:k]), "ratio": levels[k].cr if k else 1.0, "deleted": levels[k].total_deleted if k else 0, "left_out": [(str(r), why) for r, why in fitted.left_out]}
    for name, workload in (("train", train), ("test", test)):
        rows = evaluate(fitted, workload, rounds, ucq_only)
        out[name] = {"queries": rows, **{c: sum(r[c] for r in rows) for c in ("origin_s", "compressed_s") if rows and c in rows[0]}}
    if decompress:
        out["recovered"] = validate_recovery(small, k)
    if path:
        small.kb.spark.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return out


def validate_recovery(small: CompressedKB, k: int | None = None) -> bool:
    """Whether forward chaining gives back the original facts, as sets."""
    return equal(small.recover(k), small.kb.facts())
