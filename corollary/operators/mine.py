"""Exact path rules from the facts.

A path of length n is a chain of facts, each walked forwards or backwards; its signature is the list of
steps. A rule ``h(X,Y) :- path(X,Y)`` is exact if all end pairs of its path are facts of h.

Steps are numbers, and so are signatures, as every pair carries one. All facts meet once by their ends: that tells
which step's pairs are all pairs of another, which are the rules of one step. Steps with the same pairs (a relation
and its inverse, walked the other way) are then one step, and a path and its reverse one path; the rules of the others
are written down from theirs.

Paths through a node with many facts would be as many as the square of its degree, so no signature's paths
are joined before it is known that its rule can be exact:

1. per node and step, how many facts go there; the product of what comes in at one end and goes out at the
   other end of a path's middle is a number of end pairs that the path has for certain. A signature with
   more than the largest relation has facts can have no exact rule and goes;
2. of each signature left, one end pair (a witness): only relations with that fact, and with no fewer facts than
   the path has pairs, can be the head;
3. the signatures that have such a head are joined, in one job, and held against it. Of three steps the
   two whose join has fewer rows come first, and what their distinct pairs say about the number of end
   pairs is asked as in 1 before the third step.

All three are exact: no rule is lost. How many rows a join makes is counted before it, and they are dealt to as many tasks.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from corollary.functions.lineage import checkpoint, dealt
from corollary.operators.ruleset import SMALL, Facts
from corollary.plans.terms import Atom, Rule, Var

#: Steps in a word of bits.
WORD = 62


def _light(df: DataFrame) -> DataFrame:
    """A table of signatures, written once and broadcast if it is small."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= SMALL else df


class _Steps:
    """Relation i walked forwards is step 2 i, backwards 2 i + 1."""

    def __init__(self, kb):
        self.spark, self.names, self.number = kb.spark, kb.names, 2 * len(kb.names)
        self.facts = checkpoint(Facts(kb, set(kb.names)).plain)
        self.size = {r.rel: r.n for r in self.facts.groupBy("rel").agg(F.count("*").alias("n")).collect()}  # one row per relation
        self.size |= {r + 1: n for r, n in self.size.items()}
        self.rows = sum(self.size.values()) // 2
        #: Steps with the number of the first step that has the same pairs.
        self.first = {t: min([t, *(u for u in self.within.get(t, ()) if t in self.within.get(u, ()))]) for t in self.size}

    @cached_property
    def within(self) -> dict[int, set[int]]:
        """The other steps that have all pairs of a step."""
        own = F.when(F.col("s") <= F.col("o"), F.col("rel")).otherwise(F.col("rel") + 1)
        pair = self.facts.select(F.least("s", "o").alias("lo"), F.greatest("s", "o").alias("hi"), own.alias("step"))
        words = [f"w{w}" for w in range(-(-self.number // WORD))]
        bits = F.call_function("shiftleft", F.when(F.col("lo") == F.col("hi"), F.lit(3)).otherwise(F.lit(1)).cast("long"), (F.col("step") % WORD).cast("int"))
        here = [F.bit_or(F.when(F.floor(F.col("step") / WORD) == i, bits).otherwise(F.lit(0).cast("long"))).alias(w) for i, w in enumerate(words)]
        held = dealt(pair, self.rows, "lo", "hi").groupBy("lo", "hi").agg(*here)
        kinds = checkpoint(held.groupBy(*words, (F.col("lo") == F.col("hi")).alias("level")).agg(F.count("*").alias("n")))
        ends = [(w, i * WORD, min(self.number, (i + 1) * WORD) - 1) for i, w in enumerate(words)]
        some = F.concat(*(F.expr(f"filter(sequence({a}, {b}), t -> getbit({w}, t - {a}) = 1)") for w, a, b in ends))
        both = kinds.select("level", "n", some.alias("some")).where(F.size("some") > 1).select("level", "n", "some", F.explode("some").alias("a")).select("level", "n", "a", F.explode("some").alias("b")).where("a <> b")
        # the same pairs walked the other way; pairs of an entity with itself are their own reverse
        other = both.where("not level").select("level", "n", F.col("a").bitwiseXOR(F.lit(1)).alias("a"), F.col("b").bitwiseXOR(F.lit(1)).alias("b"))
        met = both.unionByName(other).groupBy("a", "b").agg(F.sum("n").alias("n"))
        sizes = self.spark.createDataFrame([*self.size.items()], "a int, size long")
        out: dict[int, set[int]] = {}
        for r in met.join(F.broadcast(sizes), "a").where("n = size").collect():  # one row per rule of one step
            out.setdefault(r.a, set()).add(r.b)
        return out

    @cached_property
    def steps(self) -> DataFrame:
        """step, s, o: each fact walked forwards and backwards, of steps with the same pairs the first."""
        firsts = sorted({*self.first.values()})
        ways = F.array(F.struct(F.col("rel").alias("step"), "s", "o"), F.struct((F.col("rel") + 1).alias("step"), F.col("o").alias("s"), F.col("s").alias("o")))
        return self.facts.where(F.col("rel").isin([t for t in firsts if t % 2 == 0] + [t - 1 for t in firsts if t % 2])).select(F.inline(ways)).where(F.col("step").isin(firsts))

    def turned(self, step: Column) -> Column:
        """The step walked the other way."""
        symmetric = [t for t in {*self.first.values()} if self.first[t ^ 1] == t]
        other = step.bitwiseXOR(F.lit(1).cast("long"))
        return F.when(step.isin(symmetric), step).otherwise(other) if symmetric else other

    def sig(self, steps: list[Column]) -> Column:
        return reduce(lambda a, b: a * self.number + b, (s.cast("long") for s in steps))

    def at(self, k: int, n: int, sig: str = "sig") -> Column:
        """The k-th of the signature's n steps."""
        return F.expr(f"({sig} div {self.number ** (n - 1 - k)}L) % {self.number}L")

    def reverse(self, n: int, sig: str = "sig") -> Column:
        return self.sig([self.turned(self.at(k, n, sig)) for k in range(n - 1, -1, -1)])

    def numbered(self, sigs: DataFrame) -> DataFrame:
        """The signatures as numbers instead of lists of names."""
        step = F.create_map(*(F.lit(x) for t in self.size for x in (self.name(t), t)))
        return sigs.withColumn("sig", F.aggregate(F.transform("sig", lambda s: step[s].cast("long")), F.lit(0).cast("long"), lambda a, s: a * self.number + s))

    def name(self, t: int) -> str:
        return f"{'+-'[t % 2]}{self.names[t // 2]}"

    def named(self, found: DataFrame, n: int) -> DataFrame:
        """head, sig, body_len, body_pairs, support with the names of all steps that have the same pairs."""
        rows = [(u, t % 2, self.names[t // 2]) for t, u in self.first.items()]
        table = self.spark.createDataFrame(rows, "first long, back int, name string")
        heads = F.broadcast(table.where("back = 0").select(F.col("first").alias("head"), "name"))
        out = found.join(heads, "head").select("sig", F.col("name").alias("head"), "pairs")
        for k in range(n):
            step = table.select(F.col("first").alias(f"_{k}"), F.concat(F.when(F.col("back") == 0, "+").otherwise("-"), "name").alias(f"s{k}"))
            out = out.withColumn(f"_{k}", self.at(k, n)).join(F.broadcast(step), f"_{k}")
        return out.select("head", F.array(*(f"s{k}" for k in range(n))).alias("sig"), F.lit(n).alias("body_len"), F.col("pairs").alias("body_pairs"), F.col("pairs").alias("support"))


class _Ends:
    """How many facts go into a node by a step, and out of it, with one far end of each."""

    def __init__(self, steps: _Steps):
        self.of = steps
        self.into = checkpoint(dealt(steps.steps, 2 * steps.rows, "o").groupBy("step", F.col("o").alias("at")).agg(F.count("*").alias("n"), F.min("s").alias("s")))
        self.out = self.into.select(steps.turned(F.col("step").cast("long")).alias("last"), F.col("at").alias("end"), F.col("n").alias("m"), F.col("s").alias("o"))

    @cached_property
    def volumes(self) -> DataFrame:
        """two, rows: the rows of the join of two steps, by their signature."""
        joined = dealt(self.into, self.of.rows, "at").join(self.out, F.col("at") == F.col("end"))
        return _light(joined.groupBy(self.of.sig([F.col("step"), F.col("last")]).alias("two")).agg(F.sum(F.col("n") * F.col("m")).alias("rows")))

    def witnessed(self, n: int, largest: int) -> DataFrame:
        """sig, pairs, s, o: signatures of n steps with a witness, whose paths have no more pairs in any middle than the
        largest relation has facts. Of three steps a signature or its reverse."""
        of = self.of
        if n == 2:
            middle = dealt(self.into, of.rows, "at").join(self.out, F.col("at") == F.col("end")).withColumn("sig", of.sig([F.col("step"), F.col("last")]))
        else:
            # walked the other way, a path's middle is the other way round: one of the two will do
            edges = of.steps.where(F.col("step") <= of.turned(F.col("step").cast("long"))).select(F.col("step").alias("mid"), F.col("s").alias("at"), F.col("o").alias("end"))
            middle = dealt(dealt(edges, of.rows, "at").join(self.into, "at"), 2 * of.rows, "end").join(self.out, "end").withColumn("sig", of.sig([F.col("step"), F.col("mid"), F.col("last")]))
        middle = middle.groupBy("sig").agg(F.max(F.col("n") * F.col("m")).alias("pairs"), F.min(F.struct("s", "o")).alias("w"))
        return _light(middle.where(F.col("pairs") <= largest).select("sig", "pairs", "w.s", "w.o"))

    def possible(self, steps: _Steps, n: int, largest: int) -> DataFrame:
        """The same with the signatures as lists of names."""
        name = F.create_map(*(F.lit(x) for t in steps.size for x in (t, steps.name(t))))
        return self.witnessed(n, largest).withColumn("sig", F.array(*(name[steps.at(k, n).cast("int")] for k in range(n))))


def _walk(steps: _Steps, sigs: DataFrame, k: int, n: int, rows: DataFrame | None = None) -> DataFrame:
    """sig, s, o: the pairs with the signature's k-th step behind them; the first step's without rows."""
    more = steps.steps.select(F.col("step").alias("_n"), F.col("s").alias("_at"), F.col("o").alias("_end"))
    if rows is None:
        return more.join(sigs.select("sig", steps.at(0, n).alias("_k")), F.col("_n") == F.col("_k")).select("sig", F.col("_at").alias("s"), F.col("_end").alias("o"))
    used = more.join(sigs.select(steps.at(k, n).alias("_n")).distinct(), "_n", "left_semi")
    return rows.withColumn("_k", steps.at(k, n)).join(used, (F.col("o") == F.col("_at")) & (F.col("_k") == F.col("_n"))).select("sig", "s", F.col("_end").alias("o"))


def _pairs(steps: _Steps, sigs: DataFrame, n: int, ends: _Ends, largest: int) -> DataFrame:
    """sig, s, o: the distinct end pairs of the paths with these signatures, with the other columns of sigs."""
    if isinstance(sigs.schema["sig"].dataType, ArrayType):
        sigs = steps.numbered(sigs)
    others = [c for c in sigs.columns if c != "sig"]
    total = lambda df: df.agg(F.sum("rows")).first()[0] or 0
    every = _light(sigs.select("sig").distinct())
    two = lambda a, b: steps.sig([steps.at(a, n), steps.at(b, n)])
    if n == 2:
        rows = total(every.join(ends.volumes, F.col("sig") == F.col("two")))
        paths = _walk(steps, every, 1, n, _walk(steps, every, 0, n))
        return dealt(paths.join(sigs, "sig"), rows, "s", "o", *others).distinct()
    # a path whose last two steps join to fewer rows is walked from its end
    sides = every.join(ends.volumes.select("two", F.col("rows").alias("left")), two(0, 1) == F.col("two")).drop("two")
    sides = sides.join(ends.volumes, two(1, 2) == F.col("two"))
    back = F.col("rows") < F.col("left")
    ways = _light(sides.select(F.when(back, steps.reverse(n)).otherwise(F.col("sig")).alias("sig"), F.col("sig").alias("of"), back.alias("back"), F.least("rows", "left").alias("rows")))
    begun = _light(ways.groupBy("sig").agg(F.max("rows").alias("rows")))
    inner = checkpoint(dealt(_walk(steps, begun, 1, n, _walk(steps, begun, 0, n)), total(begun), "sig", "s", "o").distinct())
    # from a node that so many pairs reach, the last step's facts make so many end pairs at least
    reached = inner.groupBy("sig", F.col("o").alias("at")).agg(F.count("*").alias("k")).withColumn("_k", steps.at(2, n))
    known = reached.join(ends.out, (F.col("at") == F.col("end")) & (F.col("_k") == F.col("last"))).groupBy("sig").agg(F.max(F.col("k") * F.col("m")).alias("pairs"), F.sum(F.col("k") * F.col("m")).alias("rows"))
    few = _light(known.where(F.col("pairs") <= largest).select("sig", "rows"))
    found = _walk(steps, few, 2, n, inner.join(few, "sig", "left_semi")).join(ways.select("sig", "of", "back"), "sig")
    found = found.select(F.col("of").alias("sig"), F.when(F.col("back"), F.col("o")).otherwise(F.col("s")).alias("s"), F.when(F.col("back"), F.col("s")).otherwise(F.col("o")).alias("o"))
    return dealt(found.join(sigs, "sig"), total(few.join(ways.select("sig"), "sig")), "s", "o", *others).distinct()


def _exact(steps: _Steps, n: int, ends: _Ends, largest: int, least: int) -> DataFrame:
    """sig, head, pairs: the signatures of n steps all of whose pairs the head has, with their reverses."""
    # a rule's head has the witness, and no fewer facts than its path has pairs
    sizes = F.broadcast(steps.spark.createDataFrame([(t, steps.size[t]) for t in {*steps.first.values()} if steps.size[t] >= least], "head int, size long"))
    found = steps.steps.withColumnRenamed("step", "head").join(ends.witnessed(n, largest), ["s", "o"]).join(sizes, "head").where("pairs <= size")
    one = F.least(F.struct("sig", F.col("head").cast("long").alias("head")), F.struct(steps.reverse(n).alias("sig"), steps.turned(F.col("head").cast("long")).alias("head")))
    heads = _light(found.select(one.alias("one")).select("one.sig", "one.head").distinct())
    pairs = _pairs(steps, heads, n, ends, largest)
    there = steps.steps.select(F.col("step").cast("long").alias("head"), "s", "o", F.lit(1).alias("there")).join(heads.select("head").distinct(), "head", "left_semi")
    counted = pairs.join(there, ["s", "o", "head"], "left").groupBy("sig", "head").agg(F.count("*").alias("pairs"), F.count("there").alias("hits"))
    right = checkpoint(counted.where((F.col("pairs") == F.col("hits")) & (F.col("pairs") >= least)).select("sig", "head", "pairs"))
    return right.unionByName(right.select(steps.reverse(n).alias("sig"), steps.turned(F.col("head")).alias("head"), "pairs")).distinct()


def _steps(kb) -> _Steps:
    return _Steps(kb)


def mined(kb, max_len: int = 3, min_support: int = 30) -> DataFrame:
    """head, sig, body_len, body_pairs, support: every path rule of max_len steps (3 at most) with
    confidence 1 and enough support."""
    if not 1 <= max_len <= 3:
        raise ValueError("paths have one to three steps")
    schema = "head string, sig array<string>, body_len int, body_pairs long, support long"
    steps = _steps(kb)
    one = [(steps.name(h)[1:], [steps.name(t)], 1, steps.size[t], steps.size[t]) for t, hs in steps.within.items() for h in sorted(hs) if h % 2 == 0 and steps.size[t] >= min_support]
    found = [kb.spark.createDataFrame(one, schema)]  # p(X,Y) :- p(X,Y) is not among them
    largest = max(steps.size.values(), default=0)
    if max_len > 1 and largest >= max(min_support, 1):
        ends = _Ends(steps)
        found += [steps.named(_exact(steps, n, ends, largest, min_support), n) for n in range(2, max_len + 1)]
    return reduce(DataFrame.unionByName, found)


def rule_of(head: str, sig: list[str]) -> Rule:
    names = [Var("X"), *(Var(f"Z{i}") for i in range(1, len(sig))), Var("Y")]
    body = [Atom(s[1:], (a, b) if s[0] == "+" else (b, a)) for s, a, b in zip(sig, names, names[1:])]
    return Rule(Atom(head, (Var("X"), Var("Y"))), tuple(body))


def mine_rules(kb, max_len: int = 3, min_support: int = 30) -> list[tuple[Rule, int]]:
    """Rules with their support, by support, body length and text."""
    rows = mined(kb, max_len, min_support).collect()  # one row per rule
    out = [(rule_of(r.head, r.sig), r.support) for r in rows]
    return sorted(out, key=lambda x: (-x[1], len(x[0].body), str(x[0])))
