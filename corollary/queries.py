"""The engine's registered queries over the star schema as a knowledge base, with their SQL.

Each query runs one operator over whole relations. The SQL derives the same relations from the same
tables, and says what the operator's result must be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corollary.functions import setops
from corollary.operators import verify
from corollary.operators.compress import CompressedKB, compress, compress_sets
from corollary.operators.fit import filter_rules
from corollary.operators.mine import mine_rules, mined
from corollary.operators.recover import closure
from corollary.operators.tune import tune
from corollary.plans.layers import answer_derived
from corollary.plans.query import answer, full_body, provenance
from corollary.plans.rewrite import Memo, rewrite
from corollary.plans.share import answer_shared
from corollary.plans.terms import Rule, parse_query, parse_rule
from corollary.sources.encode import BASE, DERIVED, NAMED, SPACE, TAGS, rules, star
from corollary.sources.kb import KnowledgeBase, number

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- SQL of the relations --------------------------------------------------------------------------

_JOINS = {
    "customer_region": "SELECT DISTINCT a.s, b.o FROM customer_nation a JOIN nation_region b ON a.o = b.s",
    "order_nation": "SELECT DISTINCT a.s, b.o FROM order_customer a JOIN customer_nation b ON a.o = b.s",
    "order_region": "SELECT DISTINCT a.s, b.o FROM order_nation a JOIN nation_region b ON a.o = b.s",
    "customer_order": "SELECT o AS s, s AS o FROM order_customer",
    "supplier_place": "SELECT DISTINCT a.s, b.o FROM supplier_nation a JOIN nation_region b ON a.o = b.s",
    "region_nation": "SELECT o AS s, s AS o FROM nation_region",
    "same_nation": "SELECT DISTINCT a.s, b.s AS o FROM supplier_nation a JOIN supplier_nation b ON a.o = b.o",
    "order_place": "SELECT * FROM order_nation UNION SELECT * FROM order_region",
    "located": "SELECT * FROM customer_nation UNION SELECT * FROM nation_region UNION SELECT * FROM customer_region",
}


def _relation_sql(n: str) -> str:
    if n in BASE:
        t, a, s, b, o = BASE[n]
        return f"SELECT DISTINCT {TAGS[a] * SPACE} + {s} AS s, {TAGS[b] * SPACE} + {o} AS o FROM {t} WHERE {s} IS NOT NULL AND {o} IS NOT NULL"
    if n in NAMED:
        t, a, s, b, o = NAMED[n]
        return f"SELECT DISTINCT {TAGS[a] * SPACE} + {s} AS s, {TAGS[b] * SPACE} + n AS o FROM {t} JOIN (SELECT DISTINCT {o} AS v, dense_rank() OVER (ORDER BY {o}) AS n FROM {t} WHERE {o} IS NOT NULL) ON {o} = v WHERE {s} IS NOT NULL"
    return _JOINS[n]


def _with(*names: str, recursive: bool = False) -> str:
    """WITH clause of the named relations and of those that they are made of."""
    made_of = {"customer_region": ["customer_nation", "nation_region"], "order_nation": ["order_customer", "customer_nation"], "order_region": ["order_nation", "nation_region"], "customer_order": ["order_customer"], "supplier_place": ["supplier_nation", "nation_region"], "region_nation": ["nation_region"], "same_nation": ["supplier_nation"], "order_place": ["order_nation", "order_region"], "located": ["customer_nation", "nation_region", "customer_region"]}
    order: list[str] = []

    def add(n: str) -> None:
        for m in made_of.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    # sums of integer keys and bigint tags are bigint
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({_relation_sql(n)})" for n in order) + " "


def _facts_sql(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS rel, s, o FROM {n}" for n in names)


def register(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


EVERY = (*BASE, *NAMED, *(n for n in DERIVED if n not in ("supplier_place", "region_nation")))
STAR = ("order_part", "order_supplier", "order_customer")

# ---- scans -----------------------------------------------------------------------------------------


@register("kb_counts", _with(*EVERY) + f"SELECT rel, count(*)::BIGINT AS n FROM ({_facts_sql(*EVERY)}) GROUP BY rel")
def kb_counts(spark, d):
    return star(spark, d).counts()


@register("scan_relation", _with("customer_nation") + "SELECT s AS x0, o AS x1 FROM customer_nation")
def scan_relation(spark, d):
    return answer(star(spark, d, "customer_nation"), parse_query("customer_nation(X0, X1)"))


@register("inverse_relation", _with("order_customer") + "SELECT o AS x0, s AS x1 FROM order_customer")
def inverse_relation(spark, d):
    return answer(star(spark, d, "order_customer"), parse_query("?(Y,X) :- order_customer(X,Y)"))


@register("triples_dump", _with(*EVERY) + f"SELECT s, rel, o FROM ({_facts_sql(*EVERY)})")
def triples_dump(spark, d):
    return star(spark, d).triples()


@register("dictionary_encode", "SELECT name, dense_rank() OVER (ORDER BY name)::BIGINT AS id FROM (SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT DISTINCT p_name FROM part)")
def dictionary_encode(spark, d):
    a = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("name"))
    return number(a.unionByName(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("name"))))


@register("unary_to_type", "SELECT s_suppkey::BIGINT AS s, 2::BIGINT AS o FROM supplier UNION SELECT p_partkey, 1::BIGINT FROM part WHERE p_size > 25")
def unary_to_type(spark, d):
    dictionary = number(spark.createDataFrame([("a_supplier",), ("a_large_part",)], "name string"))
    large = spark.read.parquet(f"{d}/part.parquet").where("p_size > 25").select("p_partkey")
    classes = {"a_supplier": spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey"), "a_large_part": large}
    return KnowledgeBase.from_tables(spark, classes, dictionary).relation("type")


@register("append_delete", _with("supplier_nation", "customer_nation") + "SELECT s, o FROM supplier_nation UNION SELECT s, o FROM customer_nation WHERE o % 2 = 0")
def append_delete(spark, d):
    kb = star(spark, d, "supplier_nation", "customer_nation")
    both = kb.plus(kb.facts("customer_nation").withColumn("rel", F.lit("supplier_nation")))
    odd = kb.facts("customer_nation").where("o % 2 <> 0").withColumn("rel", F.lit("supplier_nation"))
    return both.without(odd).relation("supplier_nation")


# ---- conjunctive queries -----------------------------------------------------------------------------


def _cq(name: str, text: str, sql: str, *names: str, semi: bool = True) -> None:
    @register(name, _with(*names) + sql)
    def run(spark, d):
        return answer(star(spark, d, *names), parse_query(text), reduce_by_semi_joins=semi)


_cq("cq_star2", "order_part(X0, X1), order_customer(X0, X2)", "SELECT DISTINCT a.s AS x0 FROM order_part a, order_customer b WHERE a.s = b.s", *STAR[::2])
_cq("cq_star3", "order_part(X0, X1), order_supplier(X0, X2), order_customer(X0, X3)", "SELECT DISTINCT a.s AS x0 FROM order_part a, order_supplier b, order_customer c WHERE a.s = b.s AND a.s = c.s", *STAR, semi=False)
_cq("cq_star3_semi", "order_part(X0, X1), order_supplier(X0, X2), order_customer(X0, X3)", "SELECT DISTINCT s AS x0 FROM order_part a WHERE EXISTS (SELECT 1 FROM order_supplier b WHERE b.s = a.s) AND EXISTS (SELECT 1 FROM order_customer c WHERE c.s = a.s)", *STAR)
_cq("cq_path2", "?(X,Y) :- order_customer(X,Z), customer_nation(Z,Y)", "SELECT DISTINCT a.s AS x0, b.o AS x1 FROM order_customer a JOIN customer_nation b ON a.o = b.s", "order_customer", "customer_nation")
_cq("cq_path3", "?(X,Y) :- order_customer(X,Z), customer_nation(Z,W), nation_region(W,Y)", "SELECT DISTINCT a.s AS x0, c.o AS x1 FROM order_customer a JOIN customer_nation b ON a.o = b.s JOIN nation_region c ON b.o = c.s", "order_customer", "customer_nation", "nation_region")
_cq("cq_constant", f"?(X) :- customer_nation(X,{TAGS['nation'] * SPACE + 7})", f"SELECT s AS x0 FROM customer_nation WHERE o = {TAGS['nation'] * SPACE + 7}", "customer_nation")
_cq("cq_head_constant", "?(7,X) :- nation_region(X,Y)", "SELECT DISTINCT 7::BIGINT AS x0, s AS x1 FROM nation_region", "nation_region")
_cq("cq_selfjoin", "?(X,Y) :- supplier_nation(X,Z), supplier_nation(Y,Z)", "SELECT DISTINCT a.s AS x0, b.s AS x1 FROM supplier_nation a JOIN supplier_nation b ON a.o = b.o", "supplier_nation")
_cq("cq_intra_eq", "?(X) :- same_nation(X,X)", "SELECT s AS x0 FROM same_nation WHERE s = o", "same_nation")
_cq("cq_cross", "?(X,Y) :- nation_region(X,Z), customer_segment(W,Y)", "SELECT DISTINCT a.s AS x0, b.o AS x1 FROM nation_region a, customer_segment b", "nation_region", "customer_segment")
_cq("cq_boolean", "?() :- customer_nation(X,Y), nation_region(Y,Z)", "SELECT 1 AS holds FROM customer_nation a JOIN nation_region b ON a.o = b.s LIMIT 1", "customer_nation", "nation_region")

_BODY = "?(X,Y) :- customer_nation(X,Z), nation_region(Z,Y)"


@register("cq_full_body", _with("customer_nation", "nation_region") + "SELECT DISTINCT a.s AS b0_s, a.o AS b0_o, b.s AS b1_s, b.o AS b1_o FROM customer_nation a JOIN nation_region b ON a.o = b.s")
def cq_full_body(spark, d):
    return full_body(star(spark, d, "customer_nation", "nation_region"), parse_query(_BODY))


@register("rule_provenance", _with("customer_nation", "nation_region") + "SELECT a.s AS x0, b.o AS x1, a.s AS b0_s, a.o AS b0_o, b.s AS b1_s, b.o AS b1_o FROM customer_nation a JOIN nation_region b ON a.o = b.s")
def rule_provenance(spark, d):
    return provenance(star(spark, d, "customer_nation", "nation_region"), parse_query(_BODY))


@register("materialized_cte", _with("order_customer", "customer_nation") + ", m AS MATERIALIZED (SELECT DISTINCT a.s, b.o FROM order_customer a JOIN customer_nation b ON a.o = b.s) SELECT DISTINCT x.s AS x0, y.s AS x1 FROM m x JOIN m y ON x.s = y.s")
def materialized_cte(spark, d):
    from corollary.functions.lineage import checkpoint

    kb = star(spark, d, "order_customer", "customer_nation")
    m = checkpoint(answer(kb, parse_query("?(X,Y) :- order_customer(X,Z), customer_nation(Z,Y)")).toDF("s", "o"))
    return answer(KnowledgeBase(spark, {"m": m}), parse_query("?(X,X) :- m(X,Y), m(X,Z)"))


# ---- cyclic bodies, and bodies whose joins would grow ---------------------------------------------------

_cq("cq_triangle", "?(X,S,N) :- order_supplier(X,S), supplier_nation(S,N), order_nation(X,N)", "SELECT a.s AS x0, b.s AS x1, b.o AS x2 FROM order_supplier a JOIN supplier_nation b ON a.o = b.s JOIN order_nation c ON c.s = a.s AND c.o = b.o", "order_supplier", "supplier_nation", "order_nation")
_cq("cq_square", "?(X,N) :- order_customer(X,C), customer_nation(C,N), order_supplier(X,S), supplier_nation(S,N)", "SELECT DISTINCT a.s AS x0, b.o AS x1 FROM order_customer a JOIN customer_nation b ON a.o = b.s JOIN order_supplier c ON c.s = a.s JOIN supplier_nation d ON c.o = d.s AND d.o = b.o", "order_customer", "customer_nation", "order_supplier", "supplier_nation")


@register("cq_path_reduced", _with("order_part", "order_nation") + f"SELECT DISTINCT a.s AS x0, b.s AS x1 FROM order_part a JOIN order_part b ON a.o = b.o JOIN order_nation c ON c.s = b.s WHERE c.o = {TAGS['nation'] * SPACE + 3}")
def cq_path_reduced(spark, d):
    """Orders that share a part, one of them of a nation: planned by sizes, from the nation on."""
    kb = star(spark, d, "order_part", "order_nation").measure()
    return answer(kb, parse_query(f"?(X,Y) :- order_part(X,P), order_part(Y,P), order_nation(Y,{TAGS['nation'] * SPACE + 3})"))


# ---- rules ---------------------------------------------------------------------------------------------

_WRONG = "customer_region(X,Y) :- customer_nation(X,Z), nation_region(W,Y)"
_CHECKED = [DERIVED["customer_region"], DERIVED["customer_order"], "customer_nation(X,Y) :- customer_region(X,Z), nation_region(Y,Z)"]
_CHECKED_NAMES = ("customer_region", "customer_order", "order_customer", "customer_nation", "nation_region")
_INFERRED_SQL = """, i AS (
  SELECT DISTINCT 0 AS rule_id, 'customer_region' AS rel, a.s, b.o FROM customer_nation a JOIN nation_region b ON a.o = b.s
  UNION ALL SELECT 1, 'customer_order', o, s FROM order_customer
  UNION ALL SELECT DISTINCT 2, 'customer_nation', a.s, b.s FROM customer_region a JOIN nation_region b ON a.o = b.o
), f AS (SELECT 'customer_region' AS rel, s, o FROM customer_region UNION ALL SELECT 'customer_order', s, o FROM customer_order UNION ALL SELECT 'customer_nation', s, o FROM customer_nation) """


@register("rule_support", _with(*_CHECKED_NAMES) + _INFERRED_SQL + "SELECT rule_id, count(*)::BIGINT AS support, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.rel = i.rel AND f.s = i.s AND f.o = i.o))::BIGINT AS counterexamples FROM i GROUP BY rule_id")
def rule_support(spark, d):
    kb = star(spark, d, *_CHECKED_NAMES)
    return verify.verify_rules(kb, [parse_rule(r) for r in _CHECKED]).select("rule_id", "support", "counterexamples")


_MANY = ("supplier_nation", "nation_region", "supplier_place", "region_nation", "customer_nation")


@register("rule_support_many", _with(*_MANY) + f""", f AS ({_facts_sql(*_MANY)}),
e AS (SELECT '+' || rel AS sig, s, o FROM f UNION ALL SELECT '-' || rel, o, s FROM f),
p2 AS (SELECT DISTINCT a.sig || ',' || b.sig AS sig, a.s, b.o FROM e a JOIN e b ON a.o = b.s),
p AS (SELECT sig, s, o FROM e UNION ALL SELECT * FROM p2 UNION ALL SELECT DISTINCT a.sig || ',' || b.sig, a.s, b.o FROM p2 a JOIN e b ON a.o = b.s),
n AS (SELECT sig, count(*) AS support FROM p GROUP BY sig), h AS (SELECT p.sig, rel AS head, count(*) AS hits FROM p JOIN f ON p.s = f.s AND p.o = f.o GROUP BY p.sig, rel)
SELECT r.head, n.sig, support::BIGINT AS support, (support - coalesce(hits, 0))::BIGINT AS counterexamples FROM n CROSS JOIN (SELECT DISTINCT rel AS head FROM f) r LEFT JOIN h ON h.sig = n.sig AND h.head = r.head""")
def rule_support_many(spark, d):
    """Every path rule of up to three atoms over five relations, 5550 of them, in one job."""
    from itertools import product

    from corollary.functions.lineage import checkpoint
    from corollary.operators.mine import rule_of

    facts = checkpoint(star(spark, d, *_MANY).facts())  # as a loaded base has them
    kb = KnowledgeBase.from_facts(spark, facts, list(_MANY))
    sigs = [s for n in (1, 2, 3) for s in product([sign + n for n in _MANY for sign in "+-"], repeat=n)]
    every = [(h, ",".join(s), rule_of(h, list(s))) for s in sigs for h in _MANY]
    names = spark.createDataFrame([(i, h, s) for i, (h, s, _) in enumerate(every)], "rule_id int, head string, sig string")
    found = verify.verify_rules(kb, [r for _, _, r in every]).where("support > 0")
    return names.join(found, "rule_id").select("head", "sig", "support", "counterexamples")


@register("rule_counterexamples", _with(*_CHECKED_NAMES) + _INFERRED_SQL + "SELECT rule_id, rel, s, o FROM i WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.rel = i.rel AND f.s = i.s AND f.o = i.o)")
def rule_counterexamples(spark, d):
    return verify.counter_examples(star(spark, d, *_CHECKED_NAMES), [parse_rule(r) for r in _CHECKED])


@register("rule_exact", _with("customer_region", "customer_nation", "nation_region") + """SELECT 'customer_region' AS rule, NOT EXISTS (SELECT a.s, b.o FROM customer_nation a JOIN nation_region b ON a.o = b.s EXCEPT SELECT s, o FROM customer_region) AS is_exact
UNION ALL SELECT 'wrong', NOT EXISTS (SELECT a.s, b.o FROM customer_nation a, nation_region b EXCEPT SELECT s, o FROM customer_region)""")
def rule_exact(spark, d):
    kb = star(spark, d, "customer_region", "customer_nation", "nation_region")
    return spark.createDataFrame([("customer_region", verify.exact(kb, parse_rule(DERIVED["customer_region"]))), ("wrong", verify.exact(kb, parse_rule(_WRONG)))], "rule string, is_exact boolean")


@register("rule_estimate", _with("customer_region", "customer_nation", "nation_region") + "SELECT count(*)::BIGINT AS hits FROM (SELECT DISTINCT a.s, b.o FROM customer_nation a JOIN nation_region b ON a.o = b.s JOIN customer_region h ON h.s = a.s AND h.o = b.o)")
def rule_estimate(spark, d):
    kb = star(spark, d, "customer_region", "customer_nation", "nation_region")
    return verify.hits(kb, parse_rule(DERIVED["customer_region"])).agg(F.count("*").alias("hits"))


@register("rule_head_semijoin", _with("customer_nation", "customer_region", "nation_region") + "SELECT s, o FROM customer_nation h WHERE EXISTS (SELECT 1 FROM customer_region a JOIN nation_region b ON a.o = b.o WHERE a.s = h.s AND b.s = h.o)")
def rule_head_semijoin(spark, d):
    return verify.hits(star(spark, d, *_CHECKED_NAMES), parse_rule(_CHECKED[2]))


@register("rule_filter", _with(*_CHECKED_NAMES) + """, i AS (
  SELECT DISTINCT 'customer_region(X,Y) :- customer_nation(X,Z), nation_region(Z,Y)' AS rule, 'customer_region' AS rel, a.s, b.o FROM customer_nation a JOIN nation_region b ON a.o = b.s
  UNION ALL SELECT DISTINCT 'customer_region(X,Y) :- customer_nation(X,Z), nation_region(Z,Y), customer_nation(X,W)', 'customer_region', a.s, b.o FROM customer_nation a JOIN nation_region b ON a.o = b.s JOIN customer_nation c ON c.s = a.s
  UNION ALL SELECT 'customer_order(X,Y) :- order_customer(Y,X)', 'customer_order', o, s FROM order_customer
  UNION ALL SELECT DISTINCT 'customer_nation(X,Y) :- customer_region(X,Z), nation_region(Y,Z)', 'customer_nation', a.s, b.s FROM customer_region a JOIN nation_region b ON a.o = b.o
), f AS (SELECT 'customer_region' AS rel, s, o FROM customer_region UNION ALL SELECT 'customer_order', s, o FROM customer_order UNION ALL SELECT 'customer_nation', s, o FROM customer_nation),
n AS (SELECT rule, count(*) AS support FROM i GROUP BY rule HAVING count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.rel = i.rel AND f.s = i.s AND f.o = i.o)) = 0)
SELECT rule FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.support = n.support AND m.rule <> n.rule AND starts_with(n.rule, m.rule))""")
def rule_filter(spark, d):
    kb = star(spark, d, *_CHECKED_NAMES)
    longer = "customer_region(X,Y) :- customer_nation(X,Z), nation_region(Z,Y), customer_nation(X,W)"
    kept = filter_rules(kb, [parse_rule(r) for r in (_CHECKED[0], longer, _CHECKED[1], _CHECKED[2])])
    return spark.createDataFrame([(str(r),) for r in kept], "rule string")


@register("mine_inverse", _with("order_customer", "customer_order") + """, f AS (SELECT 'order_customer' AS rel, s, o FROM order_customer UNION ALL SELECT 'customer_order', s, o FROM customer_order),
e AS (SELECT '+' || rel AS sig, s, o FROM f UNION ALL SELECT '-' || rel, o, s FROM f),
n AS (SELECT sig, count(*) AS body_pairs FROM e GROUP BY sig)
SELECT head, e.sig, body_pairs::BIGINT AS body_pairs, count(*)::BIGINT AS support FROM e JOIN (SELECT rel AS head, s, o FROM f) h ON e.s = h.s AND e.o = h.o JOIN n ON n.sig = e.sig
WHERE e.sig <> '+' || head GROUP BY head, e.sig, body_pairs HAVING count(*) = body_pairs AND count(*) >= 30""")
def mine_inverse(spark, d):
    found = mined(star(spark, d, "order_customer", "customer_order"), max_len=1)
    return found.select("head", F.concat_ws(",", "sig").alias("sig"), "body_pairs", "support")


_MINED = ("customer_nation", "nation_region", "customer_region")
_CHAIN_MINED = ("supplier_nation", "nation_region", "supplier_place", "region_nation")


@register("mine_path2", _with(*_MINED) + f""", f AS ({_facts_sql(*_MINED)}),
e AS (SELECT '+' || rel AS sig, s, o FROM f UNION ALL SELECT '-' || rel, o, s FROM f),
p AS (SELECT sig, s, o FROM e UNION ALL SELECT DISTINCT a.sig || ',' || b.sig, a.s, b.o FROM e a JOIN e b ON a.o = b.s),
n AS (SELECT sig, count(*) AS body_pairs FROM p GROUP BY sig)
SELECT head, p.sig, body_pairs::BIGINT AS body_pairs, count(*)::BIGINT AS support FROM p JOIN (SELECT rel AS head, s, o FROM f) h ON p.s = h.s AND p.o = h.o JOIN n ON n.sig = p.sig
WHERE p.sig <> '+' || head GROUP BY head, p.sig, body_pairs HAVING count(*) = body_pairs AND count(*) >= 30""")
def mine_path2(spark, d):
    found = mined(star(spark, d, *_MINED), max_len=2)
    return found.select("head", F.concat_ws(",", "sig").alias("sig"), "body_pairs", "support")


@register("mine_path3", _with(*_CHAIN_MINED) + f""", f AS ({_facts_sql(*_CHAIN_MINED)}),
e AS (SELECT '+' || rel AS sig, s, o FROM f UNION ALL SELECT '-' || rel, o, s FROM f),
p2 AS (SELECT DISTINCT a.sig || ',' || b.sig AS sig, a.s, b.o FROM e a JOIN e b ON a.o = b.s),
p AS (SELECT sig, s, o FROM e UNION ALL SELECT * FROM p2 UNION ALL SELECT DISTINCT a.sig || ',' || b.sig, a.s, b.o FROM p2 a JOIN e b ON a.o = b.s),
n AS (SELECT sig, count(*) AS body_pairs FROM p GROUP BY sig)
SELECT head, p.sig, body_pairs::BIGINT AS body_pairs, count(*)::BIGINT AS support FROM p JOIN (SELECT rel AS head, s, o FROM f) h ON p.s = h.s AND p.o = h.o JOIN n ON n.sig = p.sig
WHERE p.sig <> '+' || head GROUP BY head, p.sig, body_pairs HAVING count(*) = body_pairs AND count(*) >= 5""")
def mine_path3(spark, d):
    found = mined(star(spark, d, *_CHAIN_MINED), max_len=3, min_support=5)
    return found.select("head", F.concat_ws(",", "sig").alias("sig"), "body_pairs", "support")


@register("rule_argmax", _with(*_CHECKED_NAMES) + _INFERRED_SQL + """, u AS (
  SELECT 'customer_nation' AS rel, a.s, a.o FROM customer_nation a JOIN nation_region b ON a.o = b.s UNION SELECT 'nation_region', b.s, b.o FROM customer_nation a JOIN nation_region b ON a.o = b.s
  UNION SELECT 'order_customer', s, o FROM order_customer
), c AS (SELECT rule_id, count(*)::BIGINT AS removable FROM i SEMI JOIN f USING (rel, s, o) ANTI JOIN u USING (rel, s, o) WHERE rule_id < 2 GROUP BY rule_id HAVING count(*) > 10)
SELECT * FROM c ORDER BY removable DESC, rule_id LIMIT 1""")
def rule_argmax(spark, d):
    return verify.most_removable(star(spark, d, *_CHECKED_NAMES), [parse_rule(r) for r in _CHECKED[:2]], threshold=10)


# ---- rewriting -----------------------------------------------------------------------------------------


def _only(kb: KnowledgeBase, *gone: str) -> KnowledgeBase:
    return KnowledgeBase(kb.spark, {n: df for n, df in kb.relations.items() if n not in gone})


@register("ucq_union", _with("order_nation", "order_region") + "SELECT s AS x0, o AS x1 FROM order_nation UNION SELECT s, o FROM order_region")
def ucq_union(spark, d):
    kb = star(spark, d, "order_nation", "order_region")
    return answer(kb, (parse_query("order_nation(X,Y)"), parse_query("order_region(X,Y)")))


@register("ucq_order_place", _with("order_place") + "SELECT s AS x0, o AS x1 FROM order_place")
def ucq_order_place(spark, d):
    kb = star(spark, d, "order_customer", "customer_nation", "nation_region")
    both = [parse_rule("order_place(X,Y) :- order_nation(X,Y)"), parse_rule("order_place(X,Y) :- order_region(X,Y)")]
    return answer(kb, rewrite(parse_query("order_place(X,Y)"), both + rules("order_nation", "order_region")))


@register("ucq_shared", _with("order_region", "order_part", "order_supplier") + "SELECT a.s AS x0, a.o AS x1 FROM order_region a WHERE EXISTS (SELECT 1 FROM order_part b WHERE b.s = a.s) UNION SELECT a.s, a.o FROM order_region a WHERE EXISTS (SELECT 1 FROM order_supplier b WHERE b.s = a.s)")
def ucq_shared(spark, d):
    """Both members join orders with regions in the same way: that is made once."""
    kb = star(spark, d, "order_customer", "customer_nation", "nation_region", "order_part", "order_supplier")
    path = "order_customer(X,A), customer_nation(A,B), nation_region(B,Y)"
    return answer_shared(kb, (parse_query(f"?(X,Y) :- {path}, order_part(X,P)"), parse_query(f"?(X,Y) :- {path}, order_supplier(X,S)")))


_FRENCH = f"customer_nation(C,{TAGS['nation'] * SPACE + 6}), customer_segment(C,{TAGS['segment'] * SPACE + 2})"


@register("ucq_shared_star", _with("order_customer", "event_user", "customer_nation", "customer_segment") + f""", c AS (SELECT a.s FROM customer_nation a JOIN customer_segment b ON a.s = b.s WHERE a.o = {TAGS['nation'] * SPACE + 6} AND b.o = {TAGS['segment'] * SPACE + 2})
SELECT s AS x0, o AS x1 FROM order_customer SEMI JOIN c ON order_customer.o = c.s UNION SELECT s, o FROM event_user SEMI JOIN c ON event_user.o = c.s""")
def ucq_shared_star(spark, d):
    """Orders and events of the customers of one nation and segment: who these are is made once."""
    kb = star(spark, d, "order_customer", "event_user", "customer_nation", "customer_segment").measure()
    return answer_shared(kb, (parse_query(f"?(X,C) :- order_customer(X,C), {_FRENCH}"), parse_query(f"?(X,C) :- event_user(X,C), {_FRENCH}")))


@register("rewrite_through_deleted", _with("order_region", "order_part") + "SELECT DISTINCT a.s AS x0, a.o AS x1 FROM order_region a JOIN order_part b ON a.s = b.s")
def rewrite_through_deleted(spark, d):
    kb = _only(star(spark, d, "order_customer", "customer_nation", "nation_region", "order_part"))
    return answer(kb, rewrite(parse_query("?(X,Y) :- order_region(X,Y), order_part(X,Z)"), rules("order_nation", "order_region")))


@register("rewrite_constant", _with("order_region") + f"SELECT s AS x0 FROM order_region WHERE o = {TAGS['region'] * SPACE + 1}")
def rewrite_constant(spark, d):
    kb = star(spark, d, "order_customer", "customer_nation", "nation_region")
    memo = Memo(rules("order_nation", "order_region"))
    return answer(kb, memo.atom(parse_query(f"order_region(X,{TAGS['region'] * SPACE + 1})").atoms[0]))


@register("cq_named_constant", _with("customer_segment") + "SELECT s AS x0 FROM customer_segment WHERE o = " + str(TAGS["segment"] * SPACE) + " + (SELECT n FROM (SELECT DISTINCT c_mktsegment AS v, dense_rank() OVER (ORDER BY c_mktsegment) AS n FROM customer WHERE c_mktsegment IS NOT NULL) WHERE v = 'BUILDING')")
def cq_named_constant(spark, d):
    kb = star(spark, d, "customer_segment")
    names = number(spark.read.parquet(f"{d}/customer.parquet").select("c_mktsegment"), "c_mktsegment", TAGS["segment"] * SPACE + 1)
    kb = KnowledgeBase(spark, kb.relations, names)
    return answer(kb, kb.numbered(parse_query("?(X0) :- customer_segment(X0, BUILDING)"))[0])


# ---- compression ---------------------------------------------------------------------------------------

_CHAIN = ("order_customer", "customer_nation", "nation_region", "order_nation", "order_region")


def _deleted(spark, d, names, rule_names) -> DataFrame:
    return compress(star(spark, d, *names), rules(*rule_names)).deleted


@register("compress_path_deleted", _with("customer_region") + "SELECT 'customer_region' AS rel, s, o FROM customer_region")
def compress_path_deleted(spark, d):
    return _deleted(spark, d, ("customer_region", "customer_nation", "nation_region"), ["customer_region"]).select("rel", "s", "o")


@register("compress_inverse_deleted", _with("customer_order") + "SELECT 'customer_order' AS rel, s, o FROM customer_order")
def compress_inverse_deleted(spark, d):
    return _deleted(spark, d, ("customer_order", "order_customer"), ["customer_order"]).select("rel", "s", "o")


@register("compress_symmetric_deleted", _with("same_nation") + "SELECT 'same_nation' AS rel, s, o FROM same_nation WHERE s > o")
def compress_symmetric_deleted(spark, d):
    return compress(star(spark, d, "same_nation"), [parse_rule("same_nation(X,Y) :- same_nation(Y,X)")]).deleted.select("rel", "s", "o")


@register("compress_part_deleted", _with("order_place", "order_nation") + "SELECT 'order_place' AS rel, s, o FROM order_nation")
def compress_part_deleted(spark, d):
    """Regions of orders stay: no rule gives them."""
    return compress(star(spark, d, "order_place", "order_nation"), [parse_rule("order_place(X,Y) :- order_nation(X,Y)")]).deleted.select("rel", "s", "o")


@register("compress_part_kept", _with("order_place", "order_nation") + "SELECT 'order_place' AS rel, s, o FROM order_place EXCEPT SELECT 'order_place', s, o FROM order_nation")
def compress_part_kept(spark, d):
    return compress(star(spark, d, "order_place", "order_nation"), [parse_rule("order_place(X,Y) :- order_nation(X,Y)")]).at_level().facts("order_place")


@register("compress_part_answer", _with("order_place", "order_part") + "SELECT DISTINCT a.s AS x0, a.o AS x1 FROM order_place a JOIN order_part b ON a.s = b.s")
def compress_part_answer(spark, d):
    small = compress(star(spark, d, "order_place", "order_nation", "order_part"), [parse_rule("order_place(X,Y) :- order_nation(X,Y)")])
    return small.answer(parse_query("?(X,Y) :- order_place(X,Y), order_part(X,Z)"))


@register("compress_refused", _with("supplier_nation", "customer_nation") + "SELECT 'customer_nation(X,Y) :- supplier_nation(X,Y)' AS rule WHERE EXISTS (SELECT s, o FROM supplier_nation EXCEPT SELECT s, o FROM customer_nation)")
def compress_refused(spark, d):
    """A rule with counter-examples is refused before anything is deleted."""
    rule = parse_rule("customer_nation(X,Y) :- supplier_nation(X,Y)")
    try:
        compress(star(spark, d, "supplier_nation", "customer_nation"), [rule])
        refused = []
    except ValueError:
        refused = [(str(rule),)]
    return spark.createDataFrame(refused, "rule string")


@register("compress_chain_deltas", _with("order_nation", "order_region") + "SELECT 1 AS step, count(*)::BIGINT AS deleted FROM order_nation UNION ALL SELECT 2, count(*) FROM order_region")
def compress_chain_deltas(spark, d):
    return _deleted(spark, d, _CHAIN, ["order_nation", "order_region"]).groupBy("step").agg(F.count("*").alias("deleted"))


@register("compress_ratio_by_level", _with(*_CHAIN) + f""", n AS (SELECT rel, count(*) AS n FROM ({_facts_sql(*_CHAIN)}) GROUP BY rel), a AS (SELECT sum(n) AS al FROM n)
SELECT 1 AS step, (SELECT n FROM n WHERE rel = 'order_nation')::BIGINT AS total_deleted, round(1 - (SELECT n FROM n WHERE rel = 'order_nation') / al, 9)::DOUBLE AS cr FROM a
UNION ALL SELECT 2, (SELECT sum(n) FROM n WHERE rel IN ('order_nation', 'order_region'))::BIGINT, round(1 - (SELECT sum(n) FROM n WHERE rel IN ('order_nation', 'order_region')) / al, 9)::DOUBLE FROM a""")
def compress_ratio_by_level(spark, d):
    levels = compress(star(spark, d, *_CHAIN), rules("order_nation", "order_region")).levels()
    return levels.select("step", "total_deleted", F.round("cr", 9).alias("cr"))


@register("compress_set_fixpoint", _with("order_nation", "order_region") + "SELECT 'order_region' AS rel, s, o FROM order_region UNION ALL SELECT 'order_nation', s, o FROM order_nation")
def compress_set_fixpoint(spark, d):
    small = compress_sets(star(spark, d, *_CHAIN), rules("order_region", "order_nation"))
    return small.deleted.select("rel", "s", "o")


@register("answer_compressed", _with("order_region", "order_supplier") + "SELECT DISTINCT a.s AS x0, a.o AS x1 FROM order_region a JOIN order_supplier b ON a.s = b.s")
def answer_compressed(spark, d):
    small = compress(star(spark, d, *_CHAIN, "order_supplier"), rules("order_nation", "order_region"))
    return small.answer(parse_query("?(X,Y) :- order_region(X,Y), order_supplier(X,Z)"))


@register("answer_at_level", _with("order_region") + "SELECT s AS x0, o AS x1 FROM order_region")
def answer_at_level(spark, d):
    small = compress(star(spark, d, *_CHAIN), rules("order_nation", "order_region"))
    return small.answer(parse_query("order_region(X,Y)"), k=1)


@register("recover_all", _with(*_CHAIN) + _facts_sql(*_CHAIN))
def recover_all(spark, d):
    return compress(star(spark, d, *_CHAIN), rules("order_nation", "order_region")).recover()


@register("recover_located", _with("customer_nation", "nation_region", recursive=True) + ", t AS (SELECT s, o FROM customer_nation UNION SELECT s, o FROM nation_region UNION SELECT t.s, e.o FROM t JOIN (SELECT * FROM customer_nation UNION SELECT * FROM nation_region) e ON t.o = e.s) SELECT s, o FROM t")
def recover_located(spark, d):
    kb = star(spark, d, "customer_nation", "nation_region")
    closing = [parse_rule(r) for r in ("located(X,Y) :- customer_nation(X,Y)", "located(X,Y) :- nation_region(X,Y)", "located(X,Y) :- located(X,Z), located(Z,Y)")]
    return closure(kb, closing).where(F.col("rel") == "located").select("s", "o")


#: The next customer of the same nation, by key: one chain a nation.
_NEXT_SQL = f"WITH c AS (SELECT {TAGS['customer'] * SPACE} + c_custkey AS e, c_nationkey AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer WHERE c_nationkey IS NOT NULL) "


def _next(spark, d) -> DataFrame:
    from corollary.sources.encode import entity

    c = spark.read.parquet(f"{d}/customer.parquet").dropna(subset=["c_nationkey"]).select(entity("customer", "c_custkey").alias("s"), "c_nationkey")
    return c.withColumn("o", F.lead("s").over(Window.partitionBy("c_nationkey").orderBy("s"))).dropna().select("s", "o")


@register("recover_doubling", _NEXT_SQL + "SELECT a.e AS s, b.e AS o FROM c a JOIN c b ON a.n = b.n AND a.place < b.place")
def recover_doubling(spark, d):
    """A chain's closure under a rule that adds one step at a time, in rounds that double."""
    kb = KnowledgeBase(spark, {"next": _next(spark, d)})
    closing = [parse_rule("after(X,Y) :- next(X,Y)"), parse_rule("after(X,Y) :- after(X,Z), next(Z,Y)")]
    return closure(kb, closing).where(F.col("rel") == "after").select("s", "o")


@register("layered_chain", _NEXT_SQL + "SELECT a.e AS x0, b.e AS x1 FROM c a JOIN c b ON a.n = b.n AND b.place - a.place BETWEEN 1 AND 16")
def layered_chain(spark, d):
    """Fifteen derived relations with two rules each: a union of 2 ** 15 members, answered layer by layer."""
    kb = KnowledgeBase(spark, {"r0": _next(spark, d), "next": _next(spark, d)})
    both = [parse_rule(r) for i in range(1, 16) for r in (f"r{i}(X,Y) :- r{i - 1}(X,Y)", f"r{i}(X,Y) :- r{i - 1}(X,Z), next(Z,Y)")]
    return answer_derived(kb, parse_query("?(X,Y) :- r15(X,Y)"), both, most=200)


# ---- changes of a compressed base, and its files ---------------------------------------------------------


@register("update_compressed", _with("order_region", "order_customer") + "SELECT a.s AS x0, a.o AS x1 FROM order_region a WHERE EXISTS (SELECT 1 FROM order_customer b WHERE b.s = a.s AND b.s % 7 <> 0) OR a.s % 11 = 0")
def update_compressed(spark, d):
    """Customers of some orders go, whose nations and regions are facts still, and others come: facts that lost
    their derivation are put back, rules stay."""
    kb = star(spark, d, *_CHAIN)
    small = compress(kb, rules("order_nation", "order_region"))
    orders = kb.facts("order_customer")
    gone = orders.where("s % 7 = 0")
    small = small.updated(removed=gone).updated(added=gone.where("s % 11 = 0"))
    small = small.updated(added=orders.where("s % 11 = 0"))  # most of them are there
    return small.answer(parse_query("?(X,Y) :- order_region(X,Y), order_customer(X,Z)"))


@register("update_takes_back", _with("order_nation", "order_region") + "SELECT a.s AS x0, a.o AS x1, b.o AS x2 FROM order_nation a JOIN order_region b ON a.s = b.s WHERE a.s % 5 <> 0 AND NOT (b.s % 3 = 0 AND b.o % 2 = 0)")
def update_takes_back(spark, d):
    """Nations of some orders are no facts any more although their customers are: a rule is taken back, with what it
    deleted; regions go too, which takes the other rule back."""
    kb = star(spark, d, *_CHAIN)
    small = compress(kb, rules("order_nation", "order_region"))
    gone = kb.facts("order_nation").where("s % 5 = 0").unionByName(kb.facts("order_region").where("s % 3 = 0 AND o % 2 = 0"))
    return small.updated(removed=gone).answer(parse_query("?(X,Y,Z) :- order_nation(X,Y), order_region(X,Z)"))


@register("compress_set_closures", _with("order_nation", "order_region", "part_brand") + "SELECT 'order_region' AS rel, s, o FROM order_region UNION ALL SELECT 'order_nation', s, o FROM order_nation UNION ALL SELECT 'brand_part', o, s FROM part_brand")
def compress_set_closures(spark, d):
    """Two groups of rules that share no relation: the second is done after one round, the first takes two."""
    kb = star(spark, d, *_CHAIN, "part_brand")
    kb.relations["brand_part"] = kb.relation("part_brand").select(F.col("o").alias("s"), F.col("s").alias("o"))
    small = compress_sets(kb, [*rules("order_region", "order_nation"), parse_rule("brand_part(X,Y) :- part_brand(Y,X)")])
    return small.deleted.select("rel", "s", "o")


def _scratch(spark) -> str:
    import uuid

    from corollary.functions.lineage import shared_folder

    return f"{shared_folder(spark)}/dump/{uuid.uuid4().hex}"


@register("dump_round_trip", _with(*_CHAIN) + _facts_sql(*_CHAIN))
def dump_round_trip(spark, d):
    """Kept facts, names and rules written as a folder, read again, and all facts recovered from it."""
    folder = _scratch(spark)
    compress(star(spark, d, *_CHAIN), rules("order_nation", "order_region")).write_folder(folder)
    return CompressedKB.from_folder(spark, folder).recover()


@register("ntriples_round_trip", """SELECT 'Customer ' || c_custkey || ' é' AS s, 'segment' AS rel, c_mktsegment AS o FROM customer WHERE c_custkey IS NOT NULL AND c_mktsegment IS NOT NULL
UNION SELECT 'Customer ' || c_custkey || ' é', 'nation', 'N' || c_nationkey FROM customer WHERE c_custkey IS NOT NULL AND c_nationkey IS NOT NULL""")
def ntriples_round_trip(spark, d):
    """Customers as N-Triples with escapes, language tags and datatypes, read into a base of numbers and named again."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    subject = F.concat(F.lit("<http://kb.example/c#Customer\\u0020"), F.col("c_custkey").cast("string"), F.lit("\\u0020\\u00E9> <http://kb.example/v#"))
    segment = F.concat(subject, F.lit('segment> "'), "c_mktsegment", F.lit('"@en .'))
    nation = F.concat(subject, F.lit("nation> <http://kb.example/n#N"), F.col("c_nationkey").cast("string"), F.lit("> . # a nation"))
    folder = _scratch(spark)
    c.select(F.explode(F.array(segment, nation)).alias("value")).dropna().write.text(folder)
    kb = KnowledgeBase.read_ntriples(spark, folder)
    name = lambda c: kb.dictionary.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    return kb.facts().join(name("s"), "s").join(name("o"), "o").select(F.col("s_name").alias("s"), "rel", F.col("o_name").alias("o"))


# ---- sets ----------------------------------------------------------------------------------------------


@register("setop_difference", _with("order_place", "order_nation") + "SELECT s, o FROM order_place EXCEPT SELECT s, o FROM order_nation")
def setop_difference(spark, d):
    kb = star(spark, d, "order_place", "order_nation")
    return setops.difference(kb.relation("order_place"), kb.relation("order_nation"))


@register("setop_containment", _with("order_place", "order_nation") + "SELECT NOT EXISTS (SELECT s, o FROM order_nation EXCEPT SELECT s, o FROM order_place) AS contained, NOT EXISTS (SELECT s, o FROM order_nation EXCEPT SELECT s, o FROM order_place) AND NOT EXISTS (SELECT s, o FROM order_place EXCEPT SELECT s, o FROM order_nation) AS equal")
def setop_containment(spark, d):
    kb = star(spark, d, "order_place", "order_nation")
    a, b = kb.relation("order_place"), kb.relation("order_nation")
    return spark.createDataFrame([(setops.contains(a, b), setops.equal(a, b))], "contained boolean, equal boolean")


@register("setop_union", _with("order_nation", "order_region") + "SELECT s, o FROM order_nation UNION SELECT s, o FROM order_region")
def setop_union(spark, d):
    kb = star(spark, d, "order_nation", "order_region")
    return setops.union(kb.relation("order_nation"), kb.relation("order_region"))


# ---- all together ----------------------------------------------------------------------------------------


@register("tune_level", _with(*_CHAIN) + f""", n AS (SELECT rel, count(*) AS n FROM ({_facts_sql(*_CHAIN)}) GROUP BY rel), a AS (SELECT sum(n) AS al FROM n),
l AS (
  SELECT 1 AS level, (SELECT n FROM n WHERE rel = 'order_nation') AS gone, (SELECT sum(n) FROM n WHERE rel IN ('order_customer', 'customer_nation', 'order_region')) AS reads
  UNION ALL SELECT 2, (SELECT sum(n) FROM n WHERE rel IN ('order_nation', 'order_region')), (SELECT sum(n) FROM n WHERE rel IN ('order_customer', 'customer_nation')) + (SELECT sum(n) FROM n WHERE rel IN ('order_customer', 'customer_nation', 'nation_region'))
), y AS (
  SELECT level, 1 - gone / al AS cr, reads / (SELECT sum(n) FROM n WHERE rel IN ('order_nation', 'order_region')) AS latency FROM l, a
), o AS (SELECT *, 1 / cr - min(1 / cr) OVER () AS u, min(latency) OVER () / latency - min(latency) OVER () / max(latency) OVER () AS v FROM y),
b AS (SELECT *, CASE WHEN u > 0 AND v > 0 THEN u * v END AS box FROM o)
SELECT level, round(cr, 9) AS cr, round(latency, 9) AS latency, row_number() OVER (ORDER BY box DESC NULLS LAST, u * u + v * v, level) = 1 AS chosen FROM b""")
def tune_level(spark, d):
    """Levels of the chain; a level's latency is the number of facts that its rewritings of two queries
    read, in place of the clock, relative to the original base."""
    kb = star(spark, d, *_CHAIN)
    small = compress(kb, rules("order_nation", "order_region"))
    cr = [r.cr for r in small.levels().orderBy("step").collect()]
    size = {r.rel: r.n for r in kb.counts().collect()}  # one row per relation
    workload = [parse_query("order_nation(X,Y)"), parse_query("order_region(X,Y)")]
    reads = lambda k: sum(size[a.rel] for q in workload for m in small.rewritten(q, k) for a in m.atoms)
    got = tune(cr, lambda k: reads(k) / reads(0), initial=2, rounds=2)
    return spark.createDataFrame([(k, round(c, 9), round(t, 9), k == got.level) for k, c, t in got.samples], "level int, cr double, latency double, chosen boolean")


@register("mine_and_compress", _with("customer_region", "customer_order") + "SELECT 'customer_region' AS rel, s, o FROM customer_region UNION ALL SELECT 'customer_order', s, o FROM customer_order")
def mine_and_compress(spark, d):
    kb = star(spark, d, "customer_nation", "nation_region", "customer_region", "customer_order", "order_customer")
    wanted = {"customer_region", "customer_order"}
    support = dict(mine_rules(kb))
    found: list[Rule] = [r for r in support if r.head.rel in wanted and not wanted & {a.rel for a in r.body}]
    return compress(kb, filter_rules(kb, found, mined=support), verified=True).deleted.select("rel", "s", "o")
