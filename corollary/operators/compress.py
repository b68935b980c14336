"""Semantic compression: facts that exact rules derive from kept facts are deleted, rule by rule.

A step takes one more rule, rewrites its head under all rules accepted so far and evaluates every
rewriting but the identity over the facts still alive. A head fact that is alive and all of whose body
facts are alive goes. Rewritings are evaluated one after another, symmetric ones first, each over what
the one before left, so each deleted fact has a derivation from facts alive at that moment and the
order of deletion, read backwards, is an order of recovery. Where a rewriting's head relation stands in
its own body, facts that some match needs as body facts stay.

Deleted facts are written once per step, and what is left of a relation if a later rule may read it; of a relation that is
known as pairs of classes (``twins.Squares``) a symmetric rule's facts are written out as they are read. Level k of the
compressed base is ``step > k or null``, which leaves whole steps out of the plan, so moving between levels moves no data;
a base that was changed writes its relations once with the steps of their facts. The original facts stay
as they are. A rule that deletes nothing is not accepted.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corollary.functions.lineage import checkpoint, dealt, shared_folder
from corollary.operators.recover import closure
from corollary.operators.verify import verify_rules
from corollary.plans.fus import Program, closures
from corollary.plans.layers import answer_derived
from corollary.plans.query import answer, provenance
from corollary.plans.rewrite import NotRewritable, rewrite
from corollary.plans.terms import CQ, UCQ, Atom, Rule, parse_rule
from corollary.sources.kb import FACTS, KnowledgeBase

PATIENCE = 300


def deletable(alive: KnowledgeBase, rel: str, q: CQ) -> DataFrame:
    """(s, o): facts of rel that q, a rewriting of rel, derives and that can go together."""
    rule = Rule(Atom(rel, q.answer), q.atoms)
    here = alive.relation(rel)
    if rule.symmetric:  # one orientation stays
        swapped = here.select(F.col("o").alias("s"), F.col("s").alias("o"))
        return here.where("s > o").join(swapped.where("s > o"), ["s", "o"], "left_semi")
    own = [i for i, a in enumerate(q.atoms) if a.rel == rel]
    if not own:
        heads = answer(alive, q).select(F.col("x0").alias("s"), F.col("x1").alias("o"))
        return here.join(heads, ["s", "o"], "left_semi")
    matches = provenance(alive, q).withColumnRenamed("x0", "s").withColumnRenamed("x1", "o")
    used = reduce(DataFrame.unionByName, (matches.select(F.col(f"b{i}_s").alias("s"), F.col(f"b{i}_o").alias("o")) for i in own))
    heads = matches.select("s", "o").distinct().join(used.distinct(), ["s", "o"], "left_anti")
    return here.join(heads, ["s", "o"], "left_semi")


@dataclass
class CompressedKB:
    kb: KnowledgeBase
    rules: list[Rule]
    deleted: DataFrame  # rel, s, o, step (1 for the first rule)
    emptied: dict[str, int] = field(default_factory=dict)  # relations without a fact from that step on
    left_out: list[tuple[Rule, str]] = field(default_factory=list)  # rules not taken, and why
    parts: dict[str, list[DataFrame]] | None = None  # relations that lost facts: (rel, s, o, step) of what is kept and of each step

    @cached_property
    def placed(self) -> tuple[list[str], DataFrame]:
        """The relations that lost facts, and all their facts with the step at which each goes (null: kept), written
        once to the shared folder by relation: a level is a filter that the scan applies, without a join. What the run of
        rules has written already, step by step, is read as it is: other steps are left out of the plan."""
        spark = self.kb.spark
        if self.parts:
            return [*self.parts], reduce(DataFrame.unionByName, (df for some in self.parts.values() for df in some))
        lost = [r.rel for r in self.deleted.select("rel").distinct().collect()]  # relations
        path = f"{shared_folder(spark)}/compressed/{uuid.uuid4().hex}"
        if lost:
            both = self.kb.facts(*lost).join(self.deleted, ["rel", "s", "o"], "left")
            both.repartition("rel", F.pmod(F.xxhash64("s"), F.lit(64))).sortWithinPartitions("rel", "s", "o").write.partitionBy("rel").parquet(path)
        return lost, spark.read.schema(f"{FACTS}, step int").parquet(path) if lost else self.deleted

    def at_level(self, k: int | None = None) -> KnowledgeBase:
        """The facts kept after the first k rules."""
        lost, whole = ([], None) if k == 0 else self.placed
        if not lost:
            return self.kb
        kept = whole.where(F.col("step").isNull() if k is None else F.col("step").isNull() | (F.col("step") > k)).select("rel", "s", "o")
        return self.kb._with({n: kept.where(F.col("rel") == n).select("s", "o") for n in lost}, kept)

    def rewritten(self, q: CQ, k: int | None = None) -> UCQ:
        """The union for q at level k, without members that read an emptied relation (one stays)."""
        union = rewrite(q, self.rules[:k])
        gone = {rel for rel, step in self.emptied.items() if k is None or step <= k}
        return tuple(m for m in union if not any(a.rel in gone for a in m.atoms)) or union[:1]

    def answer(self, q: CQ, k: int | None = None, semi: bool = True) -> DataFrame:
        """The query's answers over the original facts. A rewriting beyond its bounds gives way to layers."""
        try:
            union = self.rewritten(q, k)
        except NotRewritable:
            return answer_derived(self.at_level(k), q, self.rules[:k])
        return answer(self.at_level(k), union, semi)

    def updated(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> CompressedKB:
        """The base with facts (rel, s, o) added and removed; see ``update``."""
        from corollary.operators.update import updated

        return updated(self, added, removed)

    def recover(self, k: int | None = None) -> DataFrame:
        """rel, s, o: everything that the kept facts derive."""
        return closure(self.at_level(k), self.rules[:k])

    def levels(self) -> DataFrame:
        """step, rule, deleted, total_deleted, cr (kept / all)."""
        spark = self.kb.spark
        names = spark.createDataFrame([(i, str(r)) for i, r in enumerate(self.rules, 1)], "step int, rule string")
        n = self.deleted.groupBy("step").agg(F.count("*").alias("deleted"))
        all_facts = self.kb.facts().agg(F.count("*").alias("all"))
        both = names.join(n, "step", "left").withColumn("deleted", F.coalesce("deleted", F.lit(0)))
        upto = both.alias("a").join(both.alias("b"), F.col("b.step") <= F.col("a.step")).groupBy("a.step", "a.rule", "a.deleted").agg(F.sum("b.deleted").alias("total_deleted"))
        return upto.join(F.broadcast(all_facts)).select("step", "rule", "deleted", "total_deleted", (1 - F.col("total_deleted") / F.col("all")).alias("cr"))

    def save(self, path: str) -> None:
        self.at_level().save(f"{path}/kept")
        self.deleted.write.mode("overwrite").partitionBy("step").parquet(f"{path}/deleted")
        spark = self.kb.spark
        spark.createDataFrame([(i, str(r)) for i, r in enumerate(self.rules)], "i int, rule string").write.mode("overwrite").parquet(f"{path}/rules")
        spark.createDataFrame([*self.emptied.items()], "rel string, step int").write.mode("overwrite").parquet(f"{path}/emptied")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CompressedKB:
        """A saved base; the original is the kept and the deleted facts together."""
        kept = KnowledgeBase.load(spark, f"{path}/kept")
        deleted = spark.read.schema(f"{FACTS}, step int").parquet(f"{path}/deleted")
        gone = deleted.select("rel", "s", "o")
        whole = KnowledgeBase(spark, {n: kept.relation(n).unionByName(gone.where(F.col("rel") == n).select("s", "o")) for n in kept.names}, kept.dictionary)
        rules = [parse_rule(r.rule) for r in spark.read.parquet(f"{path}/rules").orderBy("i").collect()]
        out = cls(whole, rules, deleted, {r.rel: r.step for r in spark.read.parquet(f"{path}/emptied").collect()})
        lost = [r.rel for r in deleted.select("rel").distinct().collect()]  # relations
        step = F.lit(None).cast("int").alias("step")
        out.placed = lost, kept.facts(*lost).select("rel", "s", "o", step).unionByName(deleted.select("rel", "s", "o", "step"))
        return out

    def write_folder(self, folder: str) -> None:
        """The kept facts, names and rules in the folder form that ``from_folder`` reads."""
        self.at_level().write_folder(folder, self.rules)

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str) -> CompressedKB:
        """A compressed base from a folder of kept facts with rules.txt. The original is what they derive; how many
        rules a fact needs is not told there, so there is one level with deleted facts, that of all rules."""
        kept = KnowledgeBase.read_folder(spark, folder)
        rules = kept.read_rules(f"{folder}/rules.txt")
        heads = sorted({r.head.rel for r in rules})
        facts = checkpoint(closure(kept, rules).where(F.col("rel").isin(heads)))
        deleted = checkpoint(facts.join(kept.facts(*heads), ["rel", "s", "o"], "left_anti").withColumn("step", F.lit(len(rules))))
        return cls(kept._with({n: facts.where(F.col("rel") == n).select("s", "o") for n in heads}), rules, deleted)


def compress(kb: KnowledgeBase, rules: list[Rule], patience: int = PATIENCE, most_rules: int = 300, check_rewritable: bool = True, verified: bool = False) -> CompressedKB:
    """Apply exact rules in order; a rule that is unsafe or has counter-examples raises. ``patience``: so
    many rules in a row without effect end the run. ``left_out`` of the result names each rule that was
    not taken. verified: the rules are known to be exact."""
    for rule in rules:
        if not rule.safe:
            raise ValueError(f"unsafe: {rule}")
    if rules and not verified:
        wrong = verify_rules(kb, rules).where("counterexamples > 0").select("rule").collect()  # one row per rule
        if wrong:
            raise ValueError(f"rules with counter-examples: {'; '.join(sorted(r.rule for r in wrong))}")
    program = Program()
    alive = KnowledgeBase(kb.spark, kb.relations)  # what is not deleted; a relation is written anew when a rule has taken of it
    alive.squares = kb.squares
    deltas: list[DataFrame] = []  # all facts deleted so far
    parts: dict[str, list[DataFrame]] = {}
    sizes: dict[str, int] = {}  # facts alive, of relations that lost some
    emptied: dict[str, int] = {}
    left_out: list[tuple[Rule, str]] = []
    idle = 0
    for i, rule in enumerate(rules):
        if idle > patience or len(program.rules) >= most_rules:
            left_out += [(r, "behind the end of the run") for r in rules[i:]]
            break
        before = program.snapshot()
        why = program.add(rule, check_rewritable)
        if why:
            left_out.append((rule, why))
            idle += 1
            continue
        rel, step = rule.head.rel, len(program.rules)
        members = [q for q in program.memo.relation(rel) if not (len(q.atoms) == 1 and q.atoms[0] == Atom(rel, q.answer))]
        members.sort(key=lambda q: (not Rule(Atom(rel, q.answer), q.atoms).symmetric, len(q.atoms)))
        own: list[DataFrame] = []
        lost, facts, rest = 0, None, None
        for q in members:
            here = alive if not own else KnowledgeBase(kb.spark, alive.relations | {rel: _left(alive.relation(rel), own)})
            square = here.square(rel) if Rule(Atom(rel, q.answer), q.atoms).symmetric else None
            if square:  # as many as the square of a class: written out when they are read
                gone = square.below()
                facts, _, n = square.counted().first()
            else:
                gone = checkpoint(deletable(here, rel, q))
                n = gone.count()
            if n:
                own.append(gone)
                lost += n
                rest = square.others() if square and len(own) == 1 else None
        if own:
            idle = 0
            placed = [df.select(F.lit(rel).alias("rel"), "s", "o", F.lit(step).alias("step")) for df in own]
            deltas += placed
            parts.setdefault(rel, []).extend(placed)
            if rel not in sizes:
                sizes[rel] = alive.relation(rel).count() if facts is None else facts
            sizes[rel] -= lost
            if not sizes[rel]:
                alive.relations[rel] = kb.spark.createDataFrame([], "s bigint, o bigint")
                emptied.setdefault(rel, step)
            else:
                if rest is None:
                    rest = _left(alive.relation(rel), own)
                    rest = checkpoint(rest) if rules[i + 1 :] else rest
                alive.relations[rel] = rest
        else:
            program.restore(before)
            left_out.append((rule, "deletes nothing"))
            idle += 1
    for rel, some in parts.items():
        if rel not in emptied:
            some.append(alive.relations[rel].select(F.lit(rel).alias("rel"), "s", "o", F.lit(None).cast("int").alias("step")))
    deleted = reduce(DataFrame.unionByName, deltas) if deltas else kb.spark.createDataFrame([], f"{FACTS}, step int")
    return CompressedKB(kb, program.rules, deleted, emptied, left_out, parts)


def _left(facts: DataFrame, gone: list[DataFrame]) -> DataFrame:
    return facts.join(reduce(DataFrame.unionByName, gone).select("s", "o"), ["s", "o"], "left_anti")


def compress_sets(kb: KnowledgeBase, rules: list[Rule]) -> CompressedKB:
    """Set at a time: all rules' heads that are no body facts of any match go, again and again until nothing
    changes. Rules that no shared relation ties together, in any number of steps, are groups of their own: a round
    is one job for all groups that still change, and one that does not is not read again. As groups share no
    relation, the end of each is the end of all. Steps are rounds; the rules all count from the first."""
    spark = kb.spark
    tied = closures(rules)
    group = {r.head.rel: min(m) for r, m in zip(rules, tied)}
    # only heads of rules can go, so only those are looked for among body facts; they are read in every round
    alive = KnowledgeBase(spark, kb.relations | {n: checkpoint(kb.relation(n)) for n in group})
    sizes = {n: alive.relation(n).count() for n in group}
    deltas: list[DataFrame] = []
    active = {*group.values()}
    while active:
        some = [r for r in rules if group[r.head.rel] in active]
        heads: dict[str, list[DataFrame]] = {}
        used: dict[str, list[DataFrame]] = {}
        for r in some:
            rel, own = r.head.rel, [i for i, a in enumerate(r.body) if a.rel in group]
            rows = max(sizes[rel], *(sizes[r.body[i].rel] for i in own)) if own else sizes[rel]
            matches = provenance(alive, r.as_query()).withColumnsRenamed({"x0": "s", "x1": "o"})
            here = dealt(alive.relation(rel), rows, "s", "o")
            heads.setdefault(rel, []).append(here.join(matches.select("s", "o"), ["s", "o"], "left_semi"))
            for i in own:
                body = matches.select("s", "o", F.col(f"b{i}_s").alias("bs"), F.col(f"b{i}_o").alias("bo"))
                used.setdefault(r.body[i].rel, []).append(dealt(body, rows, "s", "o").join(here, ["s", "o"], "left_semi").select(F.col("bs").alias("s"), F.col("bo").alias("o")))
        going = []
        for rel, parts in heads.items():
            gone = dealt(reduce(DataFrame.unionByName, parts), sizes[rel], "s", "o").distinct() if len(parts) > 1 else parts[0]
            if rel in used:
                gone = gone.join(dealt(reduce(DataFrame.unionByName, used[rel]), sizes[rel], "s", "o"), ["s", "o"], "left_anti")
            going.append(gone.select(F.lit(rel).alias("rel"), "s", "o", F.lit(len(deltas) + 1).alias("step")))
        gone = checkpoint(reduce(DataFrame.unionByName, going))
        lost = {r.rel: r.n for r in gone.groupBy("rel").agg(F.count("*").alias("n")).collect()}  # one row per relation
        active = {group[rel] for rel in lost}
        if active:
            deltas.append(gone)
        for rel, n in lost.items():
            sizes[rel] -= n
            rest = dealt(alive.relation(rel), sizes[rel] + n, "s", "o").join(gone.where(F.col("rel") == rel).select("s", "o"), ["s", "o"], "left_anti")
            alive.relations[rel] = checkpoint(rest) if sizes[rel] else spark.createDataFrame([], "s bigint, o bigint")
    deleted = reduce(DataFrame.unionByName, deltas) if deltas else spark.createDataFrame([], f"{FACTS}, step int")
    return CompressedKB(kb, list(rules), deleted)
