"""How rules stand to the facts: support, counter-examples, estimates. All rules of a call are one job, in
which their bodies are data (``ruleset``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corollary.operators.ruleset import RuleSet
from corollary.plans.query import provenance
from corollary.plans.terms import Rule


def inferred(kb, rules: list[Rule]) -> DataFrame:
    """rule_id, rel, s, o: the distinct heads of each rule's body."""
    return RuleSet(kb, rules).inferred()


def counter_examples(kb, rules: list[Rule]) -> DataFrame:
    """rule_id, rel, s, o: inferred but no fact."""
    return inferred(kb, rules).join(kb.facts(*sorted({r.head.rel for r in rules})), ["rel", "s", "o"], "left_anti")


def verify_rules(kb, rules: list[Rule]) -> DataFrame:
    """rule_id, rule, body_len, support, counterexamples; a rule without matches has 0 and 0."""
    names = kb.spark.createDataFrame([(i, str(r), len(r.body)) for i, r in enumerate(rules)], "rule_id int, rule string, body_len int")
    if not rules:
        return names.withColumn("support", F.lit(0).cast("long")).withColumn("counterexamples", F.lit(0).cast("long"))
    found = RuleSet(kb, rules).counted().select("rule_id", "support", (F.col("support") - F.col("hits")).alias("counterexamples"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return names.join(found, "rule_id", "left").select("rule_id", "rule", "body_len", zero("support"), zero("counterexamples"))


def exact(kb, rule: Rule) -> bool:
    """Whether the rule has no counter-example; stops at the first."""
    return counter_examples(kb, [rule]).limit(1).isEmpty()


def hits(kb, rule: Rule) -> DataFrame:
    """The rule's inferred facts that are facts: (s, o)."""
    return inferred(kb, [rule]).select("s", "o").join(kb.relation(rule.head.rel), ["s", "o"], "left_semi")


def removable(kb, rules: list[Rule]) -> DataFrame:
    """rule_id, removable: facts that the rule infers and that no match of any of the rules has as a body
    fact; only rules with such facts."""
    heads = inferred(kb, rules).join(kb.facts(*sorted({r.head.rel for r in rules})), ["rel", "s", "o"], "left_semi")
    parts = []
    for r in rules:
        matches = provenance(kb, r.as_query())
        parts += [matches.select(F.lit(a.rel).alias("rel"), F.col(f"b{i}_s").alias("s"), F.col(f"b{i}_o").alias("o")) for i, a in enumerate(r.body)]
    used = reduce(DataFrame.unionByName, parts).distinct()
    return heads.join(used, ["rel", "s", "o"], "left_anti").groupBy("rule_id").agg(F.count("*").alias("removable"))


def most_removable(kb, rules: list[Rule], threshold: int = 0) -> DataFrame:
    """rule_id, removable of the rule with most removable facts, more than threshold (the first of several)."""
    return removable(kb, rules).where(F.col("removable") > threshold).orderBy(F.desc("removable"), "rule_id").limit(1)


def entails(kb, general: list[Rule], rule: Rule) -> bool:
    """Whether the others infer all that the rule infers from these facts."""
    own = inferred(kb, [rule]).select("rel", "s", "o")
    return own.join(inferred(kb, general).select("rel", "s", "o"), ["rel", "s", "o"], "left_anti").isEmpty() if general else own.isEmpty()
