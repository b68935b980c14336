"""Forward chaining to the fixpoint.

Relations are closed group by group, in the order in which they depend on each other: rules that do not read
their own group are evaluated once. In a group the rest is semi-naive, a round joins only with facts that the
last one added. What a group knows lies in bucketed files of the shared folder, dealt by a hash of the fact, so a
round shuffles its own new facts to them and none of the known ones; new facts are appended.

Transitive rules are closed by doubling: with all walks of fewer than 2 ** k edges in T and the ends of walks
of exactly 2 ** k edges in Q, one round gives T, Q and T with Q behind it, and Q with Q behind it. A chain of
n edges takes log n rounds, and each pair is found once in a round, not once for every place where a walk can be
cut in two. Where edges lie one behind the other (paths: no entity has two next ones or two before it) the closure is the
square of their lengths. It is never written: entities get their place in their path, in log n rounds over
one row each, and a pair of pieces of a path gives its pairs to the reader.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corollary.functions.lineage import checkpoint, shared_folder, tasks
from corollary.plans.fus import components
from corollary.plans.query import answer
from corollary.plans.terms import CQ, Atom, Rule, Var
from corollary.sources.kb import KnowledgeBase

_NEW = "\0new"


class Known:
    """A growing set of facts (s, o) in files that are bucketed by both columns."""

    def __init__(self, spark: SparkSession, first: DataFrame):
        self.spark, self.name = spark, f"known_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(spark)}/known/{self.name}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.add(first)

    def add(self, more: DataFrame) -> None:
        dealt = more.select("s", "o").repartition(self.buckets, "s", "o")  # one file a bucket
        dealt.write.mode("append").bucketBy(self.buckets, "s", "o").option("path", self.path).format("parquet").saveAsTable(self.name)

    def facts(self) -> DataFrame:
        return self.spark.table(self.name)

    def new(self, found: DataFrame) -> DataFrame:
        """The distinct facts that are not known, from files."""
        return checkpoint(found.select("s", "o").distinct().join(self.facts(), ["s", "o"], "left_anti"))

    def done(self) -> DataFrame:
        """The facts as plain files; the table's name goes."""
        self.spark.sql(f"DROP TABLE {self.name}")
        return self.spark.read.schema("s bigint, o bigint").parquet(self.path)


def _behind(a: DataFrame, b: DataFrame) -> DataFrame:
    """(s, o) of a followed by b."""
    return a.select("s", F.col("o").alias("_mid")).join(b.select(F.col("s").alias("_mid"), "o"), "_mid").select("s", "o")


#: Entities of a piece of a path, as they are shuffled, and of the two parts of pieces whose pairs are written out at once.
PIECE, PARTS = 2048, (32, 512)
#: Pairs of a task, about.
PAIRS = 1 << 28


def _paths(edges: DataFrame) -> tuple[DataFrame, int] | None:
    """path, place, entity, and the rounds; None if edges branch, meet or go round."""
    twice = lambda c: not edges.groupBy(c).count().where("count > 1").isEmpty()
    if twice("s") or twice("o"):
        return None
    # (at, back, n): the entity n steps before, and whether it begins the path
    starts = edges.select(F.col("s").alias("at")).join(edges.select(F.col("o").alias("at")), "at", "left_anti")
    starts = starts.select("at", F.col("at").alias("back"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("done"))
    place = checkpoint(starts.unionByName(edges.select(F.col("o").alias("at"), F.col("s").alias("back"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("done"))))
    rounds, left, n = 0, place.where("NOT done").count(), place.count()
    longest, parts = n.bit_length() + 1, tasks(edges.sparkSession, n)
    while left:
        if rounds > longest:
            return None  # what has no start goes round
        before = place.select(F.col("at").alias("back"), F.col("back").alias("_b"), F.col("n").alias("_n"), F.col("done").alias("_d"))
        more = place.where("NOT done").join(before, "back").select("at", F.col("_b").alias("back"), (F.col("n") + F.col("_n")).alias("n"), F.col("_d").alias("done"))
        place = checkpoint(place.where("done").unionByName(more).coalesce(parts))  # as many files in every round
        rounds, left = rounds + 1, place.where("NOT done").count()
    return place.select(F.col("back").alias("path"), F.col("n").alias("place"), F.col("at").alias("entity")), rounds


def _along(paths: DataFrame) -> DataFrame:
    """(s, o): every entity with all behind it in its path, from pairs of pieces."""
    piece = F.floor(F.col("place") / PIECE).alias("piece")
    pieces = checkpoint(paths.groupBy("path", piece).agg(F.sort_array(F.collect_list(F.struct("place", "entity")))["entity"].alias("some")))
    pairs = paths.agg(F.coalesce(F.sum("place"), F.lit(0)).alias("n")).first().n  # an entity at place n has n before it
    parts = tasks(paths.sparkSession, pairs, PAIRS)
    # each piece goes to its pairs, with those behind it and those before it, and meets the other there
    last = pieces.groupBy("path").agg(F.max("piece").alias("_last"))
    here = pieces.join(last, "path").select("path", "piece", F.explode(F.sequence("piece", "_last")).alias("_p"), "some")
    behind = pieces.select("path", F.explode(F.sequence(F.lit(0).cast("long"), "piece")).alias("piece"), F.col("piece").alias("_p"), F.col("some").alias("_behind"))
    keys = ["path", "piece", "_p"]
    both = here.repartition(parts, *keys).join(behind.repartition(parts, *keys).hint("merge"), keys)
    # generated code holds all that an input row gives before it hands out the first: these are parts, not all of two pieces
    cut = [F.explode(F.sequence(F.lit(0), F.size(c) - 1, F.lit(n))).alias(at) for c, n, at in zip(("some", "_behind"), PARTS, ("_i", "_j"))]
    few = both.select("*", cut[0]).select("*", cut[1]).where((F.col("piece") < F.col("_p")) | (F.col("_j") + PARTS[1] > F.col("_i") + 1))
    few = few.select(F.slice("some", F.col("_i") + 1, PARTS[0]).alias("some"), F.slice("_behind", F.col("_j") + 1, PARTS[1]).alias("_behind"), F.when(F.col("piece") == F.col("_p"), F.col("_i") - F.col("_j")).alias("_ahead"))
    one = few.coalesce(parts).select(F.posexplode("some").alias("_n", "s"), "_behind", "_ahead")
    after = F.slice("_behind", F.greatest(F.col("_ahead") + F.col("_n") + 2, F.lit(1)), PARTS[1])
    return one.select("s", F.explode(F.when(F.col("_ahead") > -PARTS[0], after).otherwise(F.col("_behind"))).alias("o")).hint("merge")


def transitive(edges: DataFrame) -> tuple[DataFrame, int]:
    """The transitive closure of (s, o), and the rounds that it took."""
    edges = checkpoint(edges.select("s", "o").distinct())
    found = _paths(edges)
    if found:
        return _along(found[0]), found[1]
    known = Known(edges.sparkSession, edges)
    step, rounds = checkpoint(_behind(known.facts(), known.facts()).distinct()), 0
    while True:
        new = known.new(step.unionByName(_behind(known.facts(), step)))
        if new.isEmpty():
            return known.done(), rounds
        rounds += 1
        known.add(new)
        step = checkpoint(_behind(step, step).distinct())


def _chained(rule: Rule) -> tuple[str, str] | None:
    """The relations a and b of a rule h(X,Y) :- a(X,Z), b(Z,Y)."""
    if len(rule.body) != 2 or len(rule.head.variables) != 2:
        return None
    x, y = rule.head.terms
    for a, b in (rule.body, rule.body[::-1]):
        if len(a.variables) == len(b.variables) == 2 and a.terms[0] == x and b.terms[1] == y and a.terms[1] == b.terms[0] and a.terms[1] not in (x, y):
            return a.rel, b.rel
    return None


def groups(rules: list[Rule]) -> list[tuple[set[str], list[Rule]]]:
    """Relations that depend on each other, with the rules for them, each group behind those that it reads."""
    names = sorted({a.rel for r in rules for a in (r.head, *r.body)})
    place = {n: i for i, n in enumerate(names)}
    uses: list[set[int]] = [set() for _ in names]
    for r in rules:
        uses[place[r.head.rel]] |= {place[a.rel] for a in r.body}
    out, done = [], set()
    parts = components(uses)
    while parts:
        part = next(p for p in parts if all(uses[i] <= done | set(p) for i in p))
        parts.remove(part)
        done |= set(part)
        mine = {names[i] for i in part}
        some = [r for r in rules if r.head.rel in mine]
        if some:
            out.append((mine, some))
    return out


def closure(kb: KnowledgeBase, rules: list[Rule]) -> DataFrame:
    """rel, s, o: the facts and all that the rules derive from them. Ends on cyclic data, as facts are
    sets over the base's entities."""
    known = KnowledgeBase(kb.spark, kb.relations)
    changed: set[str] = set()
    for names, own in groups(rules):
        changed |= {r.head.rel for r in own}
        once = [r for r in own if not names & {a.rel for a in r.body}]
        again = [r for r in own if r not in once]
        for rel in sorted({r.head.rel for r in once}):
            heads = reduce(DataFrame.unionByName, (_heads(known, r) for r in once if r.head.rel == rel))
            known.relations[rel] = checkpoint(known.relation(rel).unionByName(heads).distinct())
        if again and not _doubled(known, names, once, again, not names & set(kb.names)):
            _rounds(known, again)
    same = [n for n in kb.names if n not in changed]
    parts = [kb.facts(*same)] if same else []
    return reduce(DataFrame.unionByName, parts + [known.facts(*sorted(changed))]) if changed else kb.facts()


def _heads(kb: KnowledgeBase, rule: Rule) -> DataFrame:
    return answer(kb, rule.as_query()).select(F.col("x0").alias("s"), F.col("x1").alias("o"))


def _doubled(known: KnowledgeBase, names: set[str], once: list[Rule], again: list[Rule], derived: bool) -> bool:
    """Close a relation whose rules are transitive, if they all are: t :- t, t, or t :- t, e and t :- e, t where
    t :- e is a rule, so that the closure of e is no more than t's. derived: it has no facts but what rules derive."""
    if len(names) != 1:
        return False
    (t,) = names
    ways = [_chained(r) for r in again]
    if any(w is None for w in ways):
        return False
    if all(w == (t, t) for w in ways):
        known.relations[t] = transitive(known.relation(t))[0]
        return True
    x, y = Var("X"), Var("Y")
    ends = {a.rel for r in once for a in r.body if len(r.body) == 1 and r.head.put(_names(r)) == Atom(t, (x, y)) and a.put(_names(r)).terms == (x, y)}
    sides = {side: sorted({w[side] for w in ways if w[1 - side] == t}) for side in (0, 1)}
    if any(w == (t, t) for w in ways) or not {e for es in sides.values() for e in es} <= ends:
        return False
    for side, es in sides.items():
        if es:
            walks = transitive(reduce(DataFrame.unionByName, map(known.relation, es)))[0]
            if derived and set(es) == ends and len(once) == len(ends):
                known.relations[t] = walks  # all that t has is walks, of one edge at least
                return True
            here = known.relation(t)
            more = _behind(here, walks) if side else _behind(walks, here)
            known.relations[t] = checkpoint(here.unionByName(more).distinct())
    return True


def _names(r: Rule) -> dict:
    return dict(zip(r.head.terms, (Var("X"), Var("Y"))))


def _rounds(known: KnowledgeBase, rules: list[Rule]) -> None:
    """Semi-naive rounds of rules that read each other's heads."""
    state = {n: Known(known.spark, known.relation(n)) for n in sorted({r.head.rel for r in rules})}
    delta = {n: known.relation(n) for n in state}  # in the first round everything is new
    while delta:
        here = KnowledgeBase(known.spark, known.relations | {n: k.facts() for n, k in state.items()})
        derived: dict[str, list[DataFrame]] = {}
        for r in rules:
            for i, a in enumerate(r.body):
                if a.rel in delta:
                    body = (*r.body[:i], Atom(a.rel + _NEW, a.terms), *r.body[i + 1 :])
                    both = KnowledgeBase(known.spark, here.relations | {a.rel + _NEW: delta[a.rel]})
                    derived.setdefault(r.head.rel, []).append(answer(both, CQ(r.head.terms, body)).select(F.col("x0").alias("s"), F.col("x1").alias("o")))
        delta = {}
        for rel, parts in derived.items():
            new = state[rel].new(reduce(DataFrame.unionByName, parts))
            if not new.isEmpty():
                delta[rel] = new
        for rel, new in delta.items():
            state[rel].add(new)
    known.relations |= {n: k.done() for n, k in state.items()}
