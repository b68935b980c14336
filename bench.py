"""Times headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    out = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    return out


def timed(make, best_of: int) -> float:
    times = []
    for _ in range(best_of):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    return round(min(times), 4)


def main() -> None:
    from corollary.operators.compress import compress
    from corollary.plans.query import answer
    from corollary.plans.terms import parse_query
    from corollary.sources.encode import rules, star
    from corollary.sources.kb import KnowledgeBase

    spark = session()
    seconds: dict[str, float] = {}
    # relations are loaded once, as a knowledge base is; queries then run on cached relations
    names = ("order_part", "order_supplier", "order_customer", "customer_nation", "supplier_nation", "nation_region", "order_nation", "order_region")
    began = time.perf_counter()
    kb = star(spark, SF_DIR, *names)
    kb = KnowledgeBase(spark, {n: df.cache() for n, df in kb.relations.items()})
    for df in kb.relations.values():
        df.count()
    kb.measure()
    seconds["load"] = round(time.perf_counter() - began, 4)
    texts = {
        "cq_star3": ("order_part(X0, X1), order_supplier(X0, X2), order_customer(X0, X3)", False),
        "cq_star3_semi": ("order_part(X0, X1), order_supplier(X0, X2), order_customer(X0, X3)", True),
        "cq_path2": ("?(X,Y) :- order_customer(X,Z), customer_nation(Z,Y)", True),
        "cq_path3": ("?(X,Y) :- order_customer(X,Z), customer_nation(Z,W), nation_region(W,Y)", True),
        "cq_selfjoin": ("?(X) :- order_part(X,Z), order_part(Y,Z)", True),
        "cyclic_square": ("?(X,N) :- order_customer(X,C), customer_nation(C,N), order_supplier(X,S), supplier_nation(S,N)", True),
    }
    for name, (text, semi) in texts.items():
        seconds[name] = timed(lambda: answer(kb, parse_query(text), semi), 3)
    began = time.perf_counter()
    small = compress(kb, rules("order_nation", "order_region"))
    seconds["compress_chain"] = round(time.perf_counter() - began, 4)
    kept = small.at_level()
    q = parse_query("?(X,Y) :- order_region(X,Y), order_supplier(X,Z)")
    seconds["compressed_files"] = timed(lambda: small.answer(q), 3)  # the level as a filter of its files
    kept = KnowledgeBase(spark, {n: df.cache() for n, df in kept.relations.items()})
    for df in kept.relations.values():
        df.count()
    kept.measure()
    seconds["answer_original"] = timed(lambda: answer(kb, q), 3)
    seconds["answer_compressed"] = timed(lambda: answer(kept, small.rewritten(q)), 3)
    seconds["recover"] = timed(small.recover, 1)
    from corollary.queries import QUERIES as ENGINE

    seconds["rule_support_many"] = timed(lambda: ENGINE["rule_support_many"](spark, SF_DIR), 1)
    spark.catalog.clearCache()
    try:
        from corollary.llm.queries import QUERIES
    except ModuleNotFoundError:
        QUERIES = {}
    for name, query in QUERIES.items():
        seconds[name] = timed(lambda: query(spark, SF_DIR), 1)
    headline = [n for n in seconds if n.startswith(("cq_", "answer_"))]
    print(json.dumps({"metric": "sum of conjunctive-query times", "value": round(sum(seconds[n] for n in headline), 4), "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
