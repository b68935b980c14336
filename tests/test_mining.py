import random
from itertools import product

from corollary.operators import mine
from corollary.sources.kb import KnowledgeBase


def _base(spark, facts):
    return KnowledgeBase(spark, {n: spark.createDataFrame(sorted(f), "s bigint, o bigint") for n, f in facts.items()})


def test_inverse_copied_and_symmetric_relations_give_all_their_rules(spark):
    """Steps with the same pairs are walked once; the rules of each are there."""
    rng = random.Random(11)
    a = {(rng.randint(1, 4), rng.randint(1, 4)) for _ in range(4)}
    sym = {(x, y) for p in [(1, 2), (3, 3)] for x, y in (p, p[::-1])}
    base = {"a": a, "inv": {(y, x) for x, y in a}, "copy": a, "sym": sym}
    walk = {s + n: f if s == "+" else {(o, x) for x, o in f} for n, f in base.items() for s in "+-"}
    want = {}
    for n in (1, 2, 3):
        for sig in product(walk, repeat=n):
            pairs = walk[sig[0]]
            for s in sig[1:]:
                pairs = {(x, y) for x, z in pairs for w, y in walk[s] if z == w}
            want |= {(h, sig): len(pairs) for h, f in base.items() if pairs and pairs <= f and sig != ("+" + h,)}
    got = mine.mined(_base(spark, base), 3, 1).collect()
    assert {(r.head, tuple(r.sig)): r.support for r in got} == want and len(got) == len(want)
    assert all(r.body_len == len(r.sig) and r.body_pairs == r.support for r in got)


def test_a_relation_and_its_inverse_are_walked_once(spark, monkeypatch):
    """Mining writes a few rows a fact, not the pairs of each of eight ways to say the same path, and each row is of numbers."""
    h = {(i, 100_000 + i // 10) for i in range(2000)}
    kb = _base(spark, {"h": h, "inv": {(y, x) for x, y in h}})
    written = []

    def spied(df, put=mine.checkpoint):
        out = put(df)
        written.append((out.count(), "string" in str(out.dtypes)))
        return out

    monkeypatch.setattr(mine, "checkpoint", spied)
    rules = mine.mined(kb, 3).collect()
    assert sum(r.body_len == 3 and r.head == "h" for r in rules) == 8 and sum(r.body_len == 3 and r.head == "inv" for r in rules) == 8
    assert sum(n for n, _ in written) <= 4 * 4000 and not any(text for n, text in written if n > 100)
