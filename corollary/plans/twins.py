"""Entities that no fact tells apart, worked on once.

Twins have the same facts in every relation, up to their own names: the customers of a nation, if nothing else is known
of them. Whatever a body says of one it says of the others, so bodies are evaluated over one entity of a class and count
as often as the class is large, or are written out for its members at the end. Answers that are the square of a class then
cost no join, no shuffle and no memory of that size: the rows go from pieces of two member lists to the reader.

Classes are exact: only entities with at most two facts of a kind and direction are put together, as their number, smallest and
largest neighbour say which facts these are. Other entities stand alone, and so do those that are named as constants.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corollary.functions.lineage import checkpoint
from corollary.sources.kb import KnowledgeBase

#: Members of a piece of a class, about.
PIECE = 512


class Twins:
    """The classes of the entities in these relations. written: classes and facts go to the shared folder, as they are
    read often; else they stay part of their reader's plan."""

    def __init__(self, kb: KnowledgeBase, names: Iterable[str], apart: Iterable[int] = (), written: bool = True):
        keep = checkpoint if written else lambda df: df
        names, apart = sorted(names), sorted(apart)
        facts = kb.facts(*names)
        step = lambda sign: F.concat(F.lit(sign), "rel").alias("step")
        ways = F.array(F.struct(F.col("s").alias("at"), step("+"), F.col("o").alias("end")), F.struct(F.col("o").alias("at"), step("-"), F.col("s").alias("end")))
        per_step = facts.select(F.inline(ways)).groupBy("at", "step").agg(F.count("*").alias("n"), F.min("end").alias("low"), F.max("end").alias("high"))
        told = per_step.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("step", "n", "low", "high"))).alias("told"), F.max("n").alias("most"))
        told = told.where((F.col("most") <= 2) & ~F.col("at").isin(apart)) if apart else told.where("most <= 2")
        classes = told.groupBy("told").agg(F.min("at").alias("first"), F.count("*").alias("size")).where("size > 1")
        #: entity, first (of its class), size: of classes of two and more.
        self.members = keep(told.join(classes, "told").select(F.col("at").alias("entity"), "first", "size"))
        others = self.members.where("entity <> first").select("entity")
        for end in ("s", "o"):
            facts = facts.join(others.withColumnRenamed("entity", end), end, "left_anti")
        #: The facts between the first entities of all classes.
        self.kb = KnowledgeBase.from_facts(kb.spark, keep(facts.select("rel", "s", "o")), names)

    def weighed(self, rows: DataFrame, *columns: str) -> DataFrame:
        """The rows with the sizes of their entities' classes, as columns with _n behind."""
        sizes = self.members.where("entity = first").select("entity", "size")
        for c in columns:
            rows = rows.join(sizes.select(F.col("entity").alias(c), F.col("size").alias(f"{c}_n")), c, "left").withColumn(f"{c}_n", F.coalesce(f"{c}_n", F.lit(1)))
        return rows

    def pairs(self, rows: DataFrame) -> DataFrame:
        """Distinct pairs of first entities, written out for all members of both classes."""
        x, y = rows.columns
        piece = F.pmod(F.xxhash64("entity"), F.ceil(F.col("size") / PIECE)).alias("piece")
        pieces = self.members.groupBy("first", piece).agg(F.collect_list("entity").alias("some"))
        for i, c in enumerate((x, y)):
            own = pieces.select(F.col("first").alias(c), F.col("piece").alias(f"_p{i}"), F.col("some").alias(f"_m{i}"))
            rows = rows.join(own, c, "left").withColumn(f"_m{i}", F.coalesce(f"_m{i}", F.array(c)))
        # each pair of pieces makes as many rows: they are dealt one by one, not by their class
        dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), x, y, "_p0", "_p1")
        # Spark takes the pairs to be as few as the pieces: they must not be broadcast
        return dealt.select(F.explode("_m0").alias(x), "_m1").select(x, F.explode("_m1").alias(y)).hint("merge")


class Squares:
    """A relation that is known as pairs of classes: distinct pairs (s, o) of first entities, each for all pairs of members
    of both. Classes do not overlap, so a fact's reverse is there if the reverse of its pair of classes is: what a symmetric
    rule counts and takes is told by the pairs of classes, and its facts are written out as they are read, never stored."""

    def __init__(self, twins: Twins, rows: DataFrame):
        self.twins, self.rows = twins, rows.toDF("s", "o")

    def facts(self) -> DataFrame:
        return self.twins.pairs(self.rows)

    @cached_property
    def _told(self) -> DataFrame:
        """s, o, s_n, o_n and both: whether the reverse is there; written once, as the classes are from now on."""
        self.twins.members = checkpoint(self.twins.members)
        rows = checkpoint(self.rows)
        reverse = rows.select(F.col("o").alias("s"), F.col("s").alias("o"), F.lit(True).alias("both"))
        told = rows.join(reverse, ["s", "o"], "left").withColumn("both", F.coalesce("both", F.lit(False)))
        return checkpoint(self.twins.weighed(told, "s", "o"))

    def counted(self) -> DataFrame:
        """One row: support (the facts), hits (those whose reverse is there), below (of these, those with s > o)."""
        n = F.col("s_n") * F.col("o_n")
        # a class with itself has a diagonal; of two classes the pairs of both ways are as many above it as below
        below = F.when(F.col("s") == F.col("o"), F.expr("s_n * (s_n - 1) div 2")).when(F.col("s") < F.col("o"), n)
        total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
        return self._told.agg(total(n, "support"), total(F.when(F.col("both"), n), "hits"), total(F.when(F.col("both"), below), "below"))

    def below(self) -> DataFrame:
        """The facts with s > o whose reverse is there."""
        return self.twins.pairs(self._told.where("both").select("s", "o")).where("s > o")

    def others(self) -> DataFrame:
        """All other facts."""
        one_way = self.twins.pairs(self._told.where("NOT both").select("s", "o"))
        return self.twins.pairs(self._told.where("both").select("s", "o")).where("s <= o").unionByName(one_way)
