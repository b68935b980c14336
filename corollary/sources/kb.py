"""A knowledge base: one set of facts (rel, s, o) over numbered entities.

Facts live in DataFrames; the driver holds names of relations only. A saved base is Parquet partitioned
by relation and sorted by (s, o) inside a partition, so a query reads its own relations' files and
row-group statistics skip most of them for constants. Facts are sets: loaders remove repeated rows and
rows with nulls, which are no facts.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corollary.plans.fus import Program
from corollary.plans.rewrite import NotRewritable
from corollary.plans.terms import CQ, Const, Rule, named, names_in, numbered, parse_rule

if TYPE_CHECKING:
    from corollary.plans.twins import Squares

FACTS = "rel string, s bigint, o bigint"


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FACTS)


def as_relation(df: DataFrame) -> DataFrame:
    """The first two columns as a set of (s, o)."""
    a, b = df.columns[:2]
    return df.select(F.col(a).cast("long").alias("s"), F.col(b).cast("long").alias("o")).dropna().distinct()


class RelationSize(NamedTuple):
    """Facts, and distinct subjects and objects (estimates)."""

    rows: int
    subjects: int
    objects: int


class KnowledgeBase:
    def __init__(self, spark: SparkSession, relations: dict[str, DataFrame], dictionary: DataFrame | None = None, every: DataFrame | None = None):
        """relations: name -> DataFrame (s, o) without repeated rows; every: all facts in one DataFrame
        (rel, s, o), if there is one."""
        self.spark, self.relations, self.dictionary, self.every = spark, dict(relations), dictionary, every
        self.sizes: dict[str, RelationSize] | None = None
        #: Relation: its DataFrame and the same facts, some of them more than once.
        self.bags: dict[str, tuple[DataFrame, DataFrame]] = {}
        #: Relation: its DataFrame and the same facts as pairs of classes.
        self.squares: dict[str, tuple[DataFrame, Squares]] = {}

    # ---- loading --------------------------------------------------------------------------------

    @classmethod
    def from_tables(cls, spark: SparkSession, tables: dict[str, DataFrame], dictionary: DataFrame | None = None) -> KnowledgeBase:
        """Tables with two columns are relations; a table with one column is a class: its members x
        become facts type(x, id) with the id of the class' name in the dictionary."""
        out, members = {}, []
        for name, df in tables.items():
            if len(df.columns) == 1:
                if dictionary is None:
                    raise ValueError(f"{name} is a class: its name needs a dictionary")
                number = dictionary.where(F.col("name") == name).select(F.col("id").alias("o"))
                members.append(df.select(F.col(df.columns[0]).cast("long").alias("s")).crossJoin(F.broadcast(number.limit(1))))
            elif len(df.columns) == 2:
                out[name] = as_relation(df)
            else:
                raise ValueError(f"{name} has {len(df.columns)} columns")
        if members:
            both = members + ([out["type"]] if "type" in out else [])
            out["type"] = as_relation(reduce(DataFrame.unionByName, both))
        return cls(spark, out, dictionary)

    @classmethod
    def from_facts(cls, spark: SparkSession, facts: DataFrame, names: list[str] | None = None, dictionary: DataFrame | None = None) -> KnowledgeBase:
        """Facts (rel, s, o) that are already distinct; names: the relations, read once if not given."""
        some = names is not None
        if names is None:
            names = [r.rel for r in facts.select("rel").distinct().collect()]
        return cls(spark, {n: facts.where(F.col("rel") == n).select("s", "o") for n in sorted(names)}, dictionary, (facts.where(F.col("rel").isin(names)) if some else facts).select("rel", "s", "o"))

    @classmethod
    def read_csv(cls, spark: SparkSession, folder: str, meta: str | None = None, dictionary: DataFrame | None = None) -> KnowledgeBase:
        """A folder of <relation>.csv files with a catalog meta.txt (relation, arity, records; tabs)."""
        catalog = spark.read.csv(meta or f"{folder}/meta.txt", sep="\t", schema="rel string, arity int, records bigint")
        tables = {}
        for r in catalog.collect():
            if r.arity == 2:
                tables[r.rel] = spark.read.csv(f"{folder}/{r.rel}.csv", header=True, schema="s bigint, o bigint")
            elif r.arity == 1:  # lines that are no number are skipped
                lines = spark.read.text(f"{folder}/{r.rel}.csv").select(F.expr("try_cast(trim(value) as bigint)").alias("s"))
                tables[r.rel] = lines.dropna()
            else:
                raise ValueError(f"{r.rel} has arity {r.arity}")
        return cls.from_tables(spark, tables, dictionary)

    @classmethod
    def read_folder(cls, spark: SparkSession, folder: str) -> KnowledgeBase:
        """A folder with meta.txt, <relation>.csv files and, if there are names, mapping.txt."""
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/mapping.txt")
        named = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        return cls.read_csv(spark, folder, dictionary=read_mapping(spark, f"{folder}/mapping.txt") if named else None)

    @classmethod
    def read_triples(cls, spark: SparkSession, path: str) -> KnowledgeBase:
        """Named triples (subject, predicate, object; tabs): entities and relations get numbers and
        names; a predicate's name is its IRI's part behind the last # or /."""
        return cls.from_names(spark, spark.read.csv(path, sep="\t", schema="a string, p string, b string"))

    @classmethod
    def read_ntriples(cls, spark: SparkSession, path: str, local: bool = True) -> KnowledgeBase:
        """N-Triples files; local: entities are named by what stands behind the last # of their IRIs."""
        from corollary.sources.rdf import read_ntriples

        return cls.from_names(spark, read_ntriples(spark, path, local))

    @classmethod
    def read_rdf_xml(cls, spark: SparkSession, path: str, local: bool = True) -> KnowledgeBase:
        """RDF/XML files, likewise."""
        from corollary.sources.rdf import read_rdf_xml

        return cls.from_names(spark, read_rdf_xml(spark, path, local))

    @classmethod
    def from_names(cls, spark: SparkSession, triples: DataFrame) -> KnowledgeBase:
        """Named triples (a, p, b), numbered."""
        raw = triples.dropna().distinct()
        local = F.regexp_extract(F.regexp_replace("p", "[<>]", ""), r"([^#/]+)$", 1)
        raw = raw.withColumn("rel", F.when(local == "type", "t").otherwise(local))
        names = number(raw.select(F.explode(F.array("a", "b")).alias("name")))
        one = raw.join(names.select(F.col("name").alias("a"), F.col("id").alias("s")), "a")
        both = one.join(names.select(F.col("name").alias("b"), F.col("id").alias("o")), "b")
        return cls.from_facts(spark, both.select("rel", "s", "o").distinct(), dictionary=names)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KnowledgeBase:
        names = [r.rel for r in spark.read.parquet(f"{path}/catalog").collect()]
        facts = spark.read.schema(FACTS).parquet(f"{path}/facts")
        out = cls.from_facts(spark, facts, names)
        if spark.read.parquet(f"{path}/info").first().dictionary:
            out.dictionary = spark.read.parquet(f"{path}/entity")
        return out

    # ---- saving ---------------------------------------------------------------------------------

    def save(self, path: str) -> None:
        """Facts by relation, the catalog, and the dictionary if there is one."""
        self.facts().repartition("rel", F.pmod(F.xxhash64("s"), F.lit(64))).sortWithinPartitions("rel", "s", "o").write.mode("overwrite").partitionBy("rel").parquet(f"{path}/facts")
        names = self.spark.createDataFrame([(n,) for n in self.names], "rel string")
        saved = self.spark.read.schema(FACTS).parquet(f"{path}/facts").groupBy("rel").agg(F.count("*").alias("records"))
        names.join(saved, "rel", "left").select("rel", F.lit(2).alias("arity"), F.coalesce("records", F.lit(0)).cast("long").alias("records")).write.mode("overwrite").parquet(f"{path}/catalog")
        self.spark.createDataFrame([(self.dictionary is not None,)], "dictionary boolean").write.mode("overwrite").parquet(f"{path}/info")
        if self.dictionary is not None:
            self.dictionary.write.mode("overwrite").parquet(f"{path}/entity")

    def write_folder(self, folder: str, rules: list[Rule] | None = None) -> None:
        """What ``read_folder`` reads: meta.txt, <relation>.csv with a header and, if there are a dictionary and
        rules, mapping.txt (name and number) and rules.txt. Each is a folder of Spark's files."""
        for n in self.names:
            self.relation(n).select(F.col("s").alias(f"{n}_1"), F.col("o").alias(f"{n}_2")).write.mode("overwrite").csv(f"{folder}/{n}.csv", header=True)
        self.counts().select("rel", F.lit(2), "n").write.mode("overwrite").csv(f"{folder}/meta.txt", sep="\t")
        if self.dictionary is not None:
            self.dictionary.select(F.concat_ws(" ", "name", F.col("id").cast("string")).alias("value")).write.mode("overwrite").text(f"{folder}/mapping.txt")
        if rules is not None:
            self.write_rules(rules, f"{folder}/rules.txt")

    def write_triples(self, path: str) -> None:
        self.triples().write.mode("overwrite").csv(path, sep="\t")

    # ---- reading --------------------------------------------------------------------------------

    @property
    def names(self) -> list[str]:
        return sorted(self.relations)

    def relation(self, rel: str) -> DataFrame:
        """(s, o); a relation without facts is empty."""
        return self.relations.get(rel, _empty(self.spark).select("s", "o"))

    def bag(self, rel: str) -> DataFrame:
        """(s, o), perhaps with repeated rows: for readers that take a part of the columns and remove repeats anyway."""
        here, bag = self.bags.get(rel, (None, None))
        return bag if here is not None and here is self.relations.get(rel) else self.relation(rel)

    def square(self, rel: str) -> Squares | None:
        """The relation as pairs of classes, if it is known so."""
        here, square = self.squares.get(rel, (None, None))
        return square if here is not None and here is self.relations.get(rel) else None

    def facts(self, *names: str) -> DataFrame:
        if self.every is not None and set(names) <= set(self.names):  # one scan, not one per relation
            return self.every.where(F.col("rel").isin(*names)) if names else self.every
        parts = [self.relation(n).select(F.lit(n).alias("rel"), "s", "o") for n in names or self.names]
        return reduce(DataFrame.unionByName, parts) if parts else _empty(self.spark)

    def triples(self) -> DataFrame:
        return self.facts().select("s", "rel", "o")

    def numbered(self, *items: CQ | Rule) -> list:
        """Queries or rules with the dictionary's numbers for the names in them."""
        names = sorted(names_in(*items))
        if not names or self.dictionary is None:
            return [numbered(x, {}) for x in items]
        ids = {r.name: r.id for r in self.dictionary.where(F.col("name").isin(names)).collect()}  # no more than the items name
        return [numbered(x, ids) for x in items]

    def with_names(self, rules: list[Rule]) -> list[Rule]:
        """Rules with the dictionary's names for the numbers in them."""
        ids = sorted({t.value for r in rules for a in (r.head, *r.body) for t in a.terms if isinstance(t, Const) and isinstance(t.value, int)})
        if not ids or self.dictionary is None:
            return list(rules)
        names = {r.id: r.name for r in self.dictionary.where(F.col("id").isin(ids)).collect()}  # no more than the rules name
        return [named(r, names) for r in rules]

    def read_rules(self, path: str, names: bool = False) -> list[Rule]:
        """A rule file, a rule a line. Rules that are unsafe, or read or give a relation that the base
        does not have, are left out, as the format asks; a set that is not rewritable raises."""
        lines = self.spark.read.text(path).where("trim(value) <> ''").collect()  # one row per rule
        rules = [parse_rule(r.value) for r in lines]
        rules = self.numbered(*rules) if names else rules
        rules = [r for r in rules if r.safe and all(a.rel in self.relations for a in (r.head, *r.body))]
        program = Program()
        for r in rules:
            if why := program.add(r):
                raise NotRewritable(f"{r}: {why}")
        return rules

    def write_rules(self, rules: list[Rule], path: str, names: bool = False) -> None:
        """A rule a line, with numbers or with entities' names."""
        lines = [(i, str(r)) for i, r in enumerate(self.with_names(rules) if names else rules)]
        self.spark.createDataFrame(lines, "i int, value string").coalesce(1).orderBy("i").select("value").write.mode("overwrite").text(path)

    def counts(self) -> DataFrame:
        """rel, n; relations without facts have 0."""
        names = self.spark.createDataFrame([(n,) for n in self.names], "rel string")
        n = self.facts().groupBy("rel").agg(F.count("*").alias("n"))
        return names.join(n, "rel", "left").select("rel", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    def measure(self) -> KnowledgeBase:
        """The same base, whose queries are planned by sizes: one pass over the facts, a row per relation. Bases
        made from it (``plus``, ``without``) are measured anew."""
        if self.sizes is None:
            some = self.facts().groupBy("rel").agg(F.count("*").alias("rows"), F.approx_count_distinct("s").alias("subjects"), F.approx_count_distinct("o").alias("objects"))
            self.sizes = {r.rel: RelationSize(r.rows, r.subjects, r.objects) for r in some.collect()}  # one row per relation
        return self

    def register_views(self) -> None:
        """A view per relation, with columns <relation>_1 and <relation>_2."""
        for n, df in self.relations.items():
            df.select(F.col("s").alias(f"{n}_1"), F.col("o").alias(f"{n}_2")).createOrReplaceTempView(n)

    # ---- changing: a new base ---------------------------------------------------------------------

    def without(self, deleted: DataFrame, names: set[str] | None = None) -> KnowledgeBase:
        """The base without the facts (rel, s, o) in deleted; names: the relations that they are of."""
        lost = self._touched(deleted, names) & self.relations.keys()
        return self._with({n: self.relations[n].join(deleted.where(F.col("rel") == n).select("s", "o"), ["s", "o"], "left_anti") for n in lost})

    def plus(self, added: DataFrame, names: set[str] | None = None) -> KnowledgeBase:
        """The base with more facts; names: the relations that they are of."""
        return self._with({n: self.relation(n).unionByName(added.where(F.col("rel") == n).select("s", "o")).distinct() for n in self._touched(added, names)})

    def _touched(self, facts: DataFrame, names: set[str] | None) -> set[str]:
        return {r.rel for r in facts.select("rel").distinct().collect()} if names is None else set(names)  # relations

    def _with(self, changed: dict[str, DataFrame], facts: DataFrame | None = None) -> KnowledgeBase:
        """The base with these relations in place of its own; facts: theirs in one DataFrame, if there is one. What
        is not changed stays one scan."""
        every = None
        if self.every is not None:
            parts = [facts] if facts is not None else [df.select(F.lit(n).alias("rel"), "s", "o") for n, df in sorted(changed.items())]
            every = reduce(DataFrame.unionByName, [self.every.where(~F.col("rel").isin(sorted(changed))) if changed else self.every, *parts])
        return KnowledgeBase(self.spark, self.relations | changed, self.dictionary, every)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The entity dictionary (name, id) of a mapping file: lines ``name id``, or ``name``, whose number is
    then its place, from 1; ``null`` has 0."""
    from pyspark.sql import Window

    from corollary.functions.lineage import checkpoint

    both = r"^(.*) (-?[0-9]+)$"  # a name may have spaces
    words = F.when(F.col("value").rlike(both), F.array(F.regexp_extract("value", both, 1), F.regexp_extract("value", both, 2))).otherwise(F.array("value"))
    lines = spark.read.text(path).select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), words.alias("words"))
    lines = checkpoint(lines.where(F.col("words")[0] != ""))
    # one row per partition of the scan
    before = lines.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("row"))
    told = lines.join(F.broadcast(before.select("part", "before")), "part").select(F.col("words")[0].alias("name"), F.when(F.size("words") == 2, F.col("words")[1].cast("long")).otherwise(place).alias("id"))
    return told.where("name <> 'null'").unionByName(spark.createDataFrame([("null", 0)], "name string, id bigint"))


def number(names: DataFrame, column: str = "name", first: int = 1) -> DataFrame:
    """The entity dictionary (name, id): distinct names in order, numbered from ``first`` on without
    gaps. Ranges of names are numbered by themselves; a small table of the ranges' sizes shifts them."""
    from pyspark.sql import Window

    from corollary.functions.lineage import checkpoint

    distinct = names.select(F.col(column).alias("name")).dropna().distinct()
    parts = checkpoint(distinct.repartitionByRange("name").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    # one row per partition of the exchange
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("name"))
    return parts.withColumn("place", place).join(F.broadcast(before), "part").select("name", (F.col("before") + F.col("place") + (first - 1)).cast("long").alias("id"))
