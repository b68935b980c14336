"""Facts added to and removed from a compressed base, without compressing it anew.

Work grows with the batch and what it touches:

* a rule can only have got a counter-example through an added body fact, or through a removed fact that it still
  infers: both are joined from the batch's side. Such a rule is taken back;
* a deleted fact can only have lost its derivation if a removed fact, or another such fact, has a part in a match
  of it, or if a rule of its relation, or of one that its relation depends on, was taken back: these are in doubt;
* facts in doubt that the rules still derive from the others stay deleted, as of the last rule; the rest is put
  back among the kept facts.

Added facts are kept. Rules stay in their order, levels count the rules that are left. All rules of a step are one
job (``ruleset``): an atom that reads the batch is an atom of a relation of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corollary.functions.lineage import checkpoint
from corollary.operators.compress import CompressedKB
from corollary.operators.ruleset import RuleSet
from corollary.plans.terms import Atom, Rule
from corollary.sources.kb import FACTS, KnowledgeBase

FACT = ["rel", "s", "o"]
_MARK = "\0batch"


def _names(facts: DataFrame) -> set[str]:
    return {r.rel for r in facts.select("rel").distinct().collect()}  # relations


def _with_batch(kb: KnowledgeBase, batch: DataFrame, names: set[str]) -> KnowledgeBase:
    return KnowledgeBase(kb.spark, kb.relations | {n + _MARK: batch.where(F.col("rel") == n).select("s", "o") for n in names})


def _through(rules: list[Rule], names: set[str]) -> tuple[list[Rule], list[int]]:
    """The rules with one body atom of these relations reading the batch, each atom in turn; whose they are."""
    out = [(Rule(r.head, (Atom(a.rel + _MARK, a.terms), *r.body[:i], *r.body[i + 1 :])), k) for k, r in enumerate(rules) for i, a in enumerate(r.body) if a.rel in names]
    return [r for r, _ in out], [k for _, k in out]


def _guarded(rules: list[Rule], names: set[str]) -> tuple[list[Rule], list[int]]:
    """The rules of these heads, for heads in the batch only."""
    out = [(Rule(r.head, (Atom(r.head.rel + _MARK, r.head.terms), *r.body)), k) for k, r in enumerate(rules) if r.head.rel in names]
    return [r for r, _ in out], [k for _, k in out]


def _wrong(kb: KnowledgeBase, rules: list[Rule], added: DataFrame, removed: DataFrame) -> set[int]:
    """Rules that the batch has given a counter-example; kb: with the batch in it."""
    bad: set[int] = set()
    for batch, variants in ((added, _through), (removed, _guarded)):
        names = _names(batch)
        some, of = variants(rules, names)
        if some:
            found = RuleSet(_with_batch(kb, batch, names), some).inferred()
            if variants is _through:
                found = found.join(kb.facts(*sorted({r.head.rel for r in some})), FACT, "left_anti")
            bad |= {of[r.rule_id] for r in found.select("rule_id").distinct().collect()}  # rules
    return bad


def _doubtful(kb: KnowledgeBase, rules: list[Rule], gone: list[Rule], deleted: DataFrame, removed: DataFrame) -> DataFrame:
    """The deleted facts that may have lost their derivation; kb: as it was."""
    reached = {r.head.rel for r in gone}
    while more := {r.head.rel for r in rules if {a.rel for a in r.body} & reached} - reached:
        reached |= more
    found = checkpoint(deleted.where(F.col("rel").isin(sorted(reached))).select(FACT))
    front = removed
    while names := _names(front):
        some, _ = _through([r for r in rules if r.head.rel not in reached], names)
        if not some:
            break
        hit = RuleSet(_with_batch(kb, front, names), some).inferred().select(FACT).distinct()
        front = checkpoint(hit.join(deleted, FACT, "left_semi").join(found, FACT, "left_anti"))
        found = found.unionByName(front)
    return found


def updated(small: CompressedKB, added: DataFrame | None = None, removed: DataFrame | None = None) -> CompressedKB:
    """The compressed base of (facts without ``removed``) and ``added`` (rel, s, o). Answers are those of that base."""
    spark, old = small.kb.spark, small.kb
    none = spark.createDataFrame([], FACTS)
    added = (none if added is None else added).select(FACT).dropna().distinct()
    removed = (none if removed is None else removed).select(FACT).dropna().distinct().join(added, FACT, "left_anti")
    touched = _names(added.unionByName(removed))
    before = KnowledgeBase(spark, {n: old.relation(n) for n in touched}).facts() if touched else none
    added, removed = checkpoint(added.join(before, FACT, "left_anti")), checkpoint(removed.join(before, FACT, "left_semi"))
    now = KnowledgeBase(spark, old.relations, old.dictionary)
    for n in touched:
        mine = lambda df: df.where(F.col("rel") == n).select("s", "o")  # noqa: E731, B023
        now.relations[n] = old.relation(n).join(mine(removed), ["s", "o"], "left_anti").unionByName(mine(added))
    bad = _wrong(now, small.rules, added, removed)
    rules = [r for i, r in enumerate(small.rules) if i not in bad]
    place = {i + 1: k for k, i in enumerate((i for i in range(len(small.rules)) if i not in bad), 1)}
    deleted = small.deleted.join(removed, FACT, "left_anti")
    doubt = _doubtful(old, rules, [small.rules[i] for i in sorted(bad)], deleted, removed)
    again, doubted = [], _names(doubt)
    left = doubt
    while names := _names(left):
        some, _ = _guarded(rules, names)
        if not some:
            break
        lost = {n: left.where(F.col("rel") == n).select("s", "o") for n in names}
        sure = KnowledgeBase(spark, now.relations | {n: now.relation(n).join(df, ["s", "o"], "left_anti") for n, df in lost.items()})
        back = checkpoint(RuleSet(_with_batch(sure, left, names), some).inferred().select(FACT).distinct())
        if back.isEmpty():
            break
        again.append(back)
        left = checkpoint(left.join(back, FACT, "left_anti"))
    stay = deleted.join(doubt, FACT, "left_anti")
    if place:
        steps = F.create_map(*(F.lit(x) for pair in place.items() for x in pair))
        stay = stay.select(*FACT, F.element_at(steps, F.col("step")).alias("step"))
    last = [b.withColumn("step", F.lit(len(rules))) for b in again]
    kept_empty = {n: place[k] for n, k in small.emptied.items() if k in place and n not in touched | doubted}
    out = reduce(DataFrame.unionByName, [stay.select(*FACT, "step"), *last])
    return CompressedKB(now, rules, checkpoint(out), kept_empty, [*small.left_out, *((small.rules[i], "a counter-example was added") for i in sorted(bad))])
