"""The star schema as a knowledge base: keys become entities of one number space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corollary.plans.terms import Rule, parse_rule
from corollary.sources.kb import KnowledgeBase

#: An entity's number is its type's tag times SPACE plus its key.
SPACE = 10_000_000_000
TAGS = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order": 6, "event": 7, "brand": 8, "type": 9, "segment": 10, "kind": 11}

#: Relation: table, subject tag and column, object tag and column.
BASE = {
    "nation_region": ("nation", "nation", "n_nationkey", "region", "n_regionkey"),
    "customer_nation": ("customer", "customer", "c_custkey", "nation", "c_nationkey"),
    "supplier_nation": ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
    "order_customer": ("orders", "order", "o_orderkey", "customer", "o_custkey"),
    "order_supplier": ("lineitem", "order", "l_orderkey", "supplier", "l_suppkey"),
    "order_part": ("lineitem", "order", "l_orderkey", "part", "l_partkey"),
    "event_user": ("events", "event", "event_id", "customer", "user_id"),
}
#: Relation: table, subject tag and column, object tag and column of strings, numbered in their order.
NAMED = {
    "part_brand": ("part", "part", "p_partkey", "brand", "p_brand"),
    "part_type": ("part", "part", "p_partkey", "type", "p_type"),
    "customer_segment": ("customer", "customer", "c_custkey", "segment", "c_mktsegment"),
    "event_kind": ("events", "event", "event_id", "kind", "event_type"),
}
#: Relations that follow from others, and how.
DERIVED = {
    "customer_region": "customer_region(X,Y) :- customer_nation(X,Z), nation_region(Z,Y)",
    "order_nation": "order_nation(X,Y) :- order_customer(X,Z), customer_nation(Z,Y)",
    "order_region": "order_region(X,Y) :- order_nation(X,Z), nation_region(Z,Y)",
    "customer_order": "customer_order(X,Y) :- order_customer(Y,X)",
    "supplier_place": "supplier_place(X,Y) :- supplier_nation(X,Z), nation_region(Z,Y)",
    "region_nation": "region_nation(X,Y) :- nation_region(Y,X)",
    "same_nation": "same_nation(X,Y) :- supplier_nation(X,Z), supplier_nation(Y,Z)",
}


def rules(*names: str) -> list[Rule]:
    return [parse_rule(DERIVED[n]) for n in names or DERIVED]


def entity(tag: str, key: str | Column) -> Column:
    return (F.lit(TAGS[tag] * SPACE) + (F.col(key) if isinstance(key, str) else key).cast("long")).cast("long")


def _strings(df: DataFrame, column: str) -> DataFrame:
    """_value, n: the distinct strings in order, from 1 (a handful: brands, kinds, segments)."""
    values = df.select(F.col(column).alias("_value")).dropna().distinct()
    return values.withColumn("n", F.row_number().over(Window.orderBy("_value")))


def _bag(spark: SparkSession, sf_dir: str, n: str) -> DataFrame:
    name, a, s, b, o = BASE[n]
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(entity(a, s).alias("s"), entity(b, o).alias("o")).dropna()


def base(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    out = {}
    for n in names or (*BASE, *NAMED):
        name, a, s, b, o = BASE.get(n) or NAMED[n]
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if n in BASE:
            out[n] = _bag(spark, sf_dir, n).distinct()
        else:
            out[n] = df.join(_strings(df, o), F.col(o) == F.col("_value")).select(entity(a, s).alias("s"), entity(b, "n").alias("o")).dropna().distinct()
    return out


def star(spark: SparkSession, sf_dir: str, *names: str) -> KnowledgeBase:
    """The named relations, base or derived (all, without names). ``order_place`` is the union of
    order_nation and order_region; ``located`` the transitive closure of places."""
    from corollary.plans.query import answer, squares

    every = names or (*BASE, *NAMED, *(n for n in DERIVED if n not in ("supplier_place", "region_nation")))
    asked, todo = set(), list(every)
    while todo:  # what derived relations are made of
        n = todo.pop()
        if n not in asked:
            asked.add(n)
            parts = {"order_place": ["order_nation", "order_region"], "located": ["customer_nation", "nation_region", "customer_region"]}.get(n)
            todo += parts if parts else [a.rel for a in parse_rule(DERIVED[n]).body] if n in DERIVED else []
    kb = KnowledgeBase(spark, base(spark, sf_dir, *(n for n in (*BASE, *NAMED) if n in asked)))
    for n in DERIVED:
        if n in asked:
            q = parse_rule(DERIVED[n]).as_query()
            if square := squares(kb, q):
                kb.relations[n] = square.facts()
                kb.squares[n] = kb.relations[n], square
            else:
                kb.relations[n] = answer(kb, q).select(F.col("x0").alias("s"), F.col("x1").alias("o"))
    for n, parts in (("order_place", ("order_nation", "order_region")), ("located", ("customer_nation", "nation_region", "customer_region"))):
        if n in asked:
            a, *rest = (kb.relation(p) for p in parts)
            for b in rest:
                a = a.unionByName(b)
            kb.relations[n] = a.distinct()
    out = KnowledgeBase(spark, {n: kb.relations[n] for n in every})
    out.squares = kb.squares
    for n in every:
        if n in BASE:
            out.bags[n] = out.relations[n], _bag(spark, sf_dir, n)
    return out
