"""Fill-in-the-middle, licence notices and hard negatives: against plain Python, at their edges and as registered."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corollary.llm import fim, hard_negatives, licenses
from corollary.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
UNIT = re.compile(r"[\x20\t-\r]*[^\x20\t-\r]+|[\x20\t-\r]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill-in-the-middle -------------------------------------------------------------------------


def plain_fim(doc_id, text, percent=50):
    t = text or ""
    units = [m.group() for m in UNIT.finditer(t)]
    n, d = len(units), sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(d[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return doc_id, n, "plain", None, None, t
    form = "spm" if h4 % 100 < 80 else "psm"
    return doc_id, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\x0b\x85　\x00é😀<>PSM"), max_size=60), st.integers(0, 2**32), st.integers(0, 2**32), st.integers(1, 30))
def test_cuts_are_those_of_the_pattern(text, first, second, size):
    starts = [m.start() for m in UNIT.finditer(text)] + [len(text)]
    n = len(starts) - 1
    a, b = sorted((first % (n + 1), second % (n + 1)))
    assert fim.cuts(text, first, second, size) == (n, starts[a], starts[b])


def test_long_runs_are_one_unit():
    for text in (" " * 2_000_000, "x" * 2_000_000, "a" + " " * 2_000_000, " " * 1_000_000 + "x" * 1_000_000):
        n = len(UNIT.findall(text))
        assert fim.cuts(text, n, 0) == (n, 0, len(text))


def test_fim_rows(spark):
    rng = random.Random(2)
    texts = ["", None, " ", "one", "  lead and trail  ", "holds <P> here", "a<S>b", "<M>", "<<P", "a < P > b", "x <S <M", "ü 😀　z\x85 q"]
    texts += [" ".join("".join(rng.choices("abc<>PSM\n", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 40))) for _ in range(60)] + ["word " * 100_000]
    rows = [(i if i != 7 else None, t, "kept", -i, "c") for i, t in enumerate(texts)]
    rows += [rows[3], (3, "another text of this id", "kept", 0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string, n int, `a.b` string")
    got = fim.transformed(df, percent=90)
    assert set(got.columns) == {"doc_id", "text", "extra", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"}
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    found = sorted(map(tuple, got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=key)
    assert found == sorted((plain_fim(r[0], r[1], 90) for r in rows), key=key)
    assert {f[2] for f in found} == {"plain", "psm", "spm"}
    back = got.select(F.coalesce("text", F.lit("")).alias("text"), fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r.text == r.back for r in back)
    assert fim.transformed(df.limit(0)).count() == 0


@tables
def test_op11(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op11_fim"](spark, DATA).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        *want, output = plain_fim(i, t)
        r = rows[i]
        assert [r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256] == [*want, sha(output), sha(t or "")]


# ---- licence notices ----------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_scan(text, templates=licenses.TEMPLATES, percent=licenses.PERCENT, phrases=licenses.PHRASES):
    words = plain_words(text)
    places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    met = []
    for block in re.split(r"[.!?;:]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n", low):
        b = set(plain_words(block))
        for label, t in templates:
            t = set(plain_words(t))
            if t and 100 * len(b & t) >= percent * len(t):
                met.append((label, len(b & t) / len(t)))
    at = [i for i, _ in places]
    base = sorted({label for _, label in places})
    score = 1.0 if places else max((s for _, s in met), default=0.0)
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *(label for label, _ in met)})), score


def test_licence_rows(spark):
    rng = random.Random(3)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.split()}) + ["mit", "Kelvin", "K", "İ", "straße", "9"]
    texts = ["", None, "...", "CC BY cc by CC-BY", "cc bye", "All rights reserved. all\nrights reserved", "The GNU General Public License", "Released under the MIT License.", "Lizenz: RELEASED under\nthe mit licenseß", "Licensed under CC BY-NC 4.0."]
    for _ in range(150):
        text = []
        for _ in range(rng.randint(1, 6)):
            words = rng.choice(licenses.TEMPLATES)[1].split() if rng.random() < 0.5 else rng.choices(vocabulary, k=rng.randint(1, 30))
            words = [w for w in words if rng.random() > 0.06] + rng.choices(vocabulary, k=rng.randint(0, 3))
            rng.shuffle(words) if rng.random() < 0.3 else None
            text.append(rng.choice([" ", "-", ", "]).join(w.title() if rng.random() < 0.2 else w for w in words) + rng.choice([". ", "\n\n", "\n", "; ", ""]))
        texts.append("".join(text))
    texts.append("no notice here " * 60_000 + "released under the mit license")
    rows = [(i if i != 8 else None, t, "x", i) for i, t in enumerate(texts)] + [(7, texts[7], "x", 0), (7, "another text, this one cc by", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, key int")
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted((tuple(r[c] for c in ("doc_id", *names)) for r in licenses.scanned(df).collect()), key=order)
    want = sorted(((r[0], *plain_scan(r[1])) for r in rows), key=order)
    assert got == want and {label for r in got for label in r[6].split(",")} > {"mit", "cc-by-nc", "gpl", "bsd"}
    assert licenses.scanned(df.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [30, 60, 100])
def test_the_join_finds_every_pair(spark, percent):
    """Random sets over few words, so that filters are tight; templates dealt in parts give the same pairs."""
    rng = random.Random(percent)
    draw = lambda n: " ".join("w%d" % int(rng.paretovariate(0.6)) for _ in range(n))
    templates = [(f"t{i}", draw(rng.randint(1, 12))) for i in range(25)] + [("none", "..."), ("t0", "w1"), ("again", "w1")]
    rows = [(i, ". ".join(draw(rng.randint(1, 25)) for _ in range(4))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = set()
    for i, text in rows:
        for b, block in enumerate(text.split(". ")):
            for t, (label, words) in enumerate(templates):
                both, size = len(set(block.split()) & set(plain_words(words))), len(set(plain_words(words)))
                if size and 100 * both >= percent * size:
                    want.add((i, b, t, label, both, size))
    for largest in (licenses.LARGEST, 20):
        got = [(r.doc_id, r.block, r.template, r.label, r.overlap, r.template_size) for r in licenses.found(df, templates, percent, largest=largest).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    with pytest.raises(ValueError):
        licenses.found(df, [("a", "-")])
    with pytest.raises(ValueError):
        licenses.found(df, templates, 0)


@tables
def test_op12(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op12_licenses"](spark, DATA).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == plain_scan(t), i


# ---- hard negatives -----------------------------------------------------------------------------


def plain_mine(rows, anchor, positives=5, negatives=3, scale=256):
    """rows: (id, vector, label); ids of the anchors' rows by ``anchor``."""
    good = [(i, tuple(int(np.floor(float(x) * scale)) for x in v), label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, label in dict.fromkeys(r for r in good if anchor(r[0])):
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, k) for j, w, k in good if j != i and len(w) == len(v)), key=lambda s: s[:2])
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            near = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(i, j, rank, k, -p, -n) for rank, (n, k, _) in enumerate(near, 1)]
    return sorted(out)


def mined(df, **options):
    got = hard_negatives.mined(df, F.col("vec_id") % 3 == 0, F.col("label"), **options)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


SCHEMA = "vec_id long, embedding array<double>, label int, id string, goals int"


@pytest.mark.parametrize("cells", [None, 60])
def test_negatives_against_brute_force(spark, cells):
    rng = np.random.default_rng(1)
    center = rng.normal(size=(4, 8))
    rows = [(i, (center[k] + rng.normal(size=8) * (0.4 if i % 2 else 1.0)).tolist(), k) for i, k in enumerate(rng.integers(0, 4, 160).tolist())]
    rows += [(200 + i, [float(x) for x in rng.integers(-1, 2, 8)], i % 3) for i in range(40)]  # ties
    rows += [(300, [1.0, 2.0], 0), (301, [1.0, 1.0], 0), (302, [0.5, 1.5], 1), (303, [2.0, 1.0], 0)]  # another dimension
    rows += [(400, None, 1), (401, [None] * 8, 1), (402, [float("nan")] * 8, 1), (403, [float("inf")] * 8, 0), (404, [0.0] * 8, None), (None, [1.0] * 8, 1), (405, [], 1)]
    rows += [rows[3], rows[7], (9, [0.25] * 8, 2)]  # repeated rows, two rows of one id
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    want = plain_mine(rows, lambda i: i % 3 == 0)
    assert want and mined(df, cells=cells) == want


def test_hard_negatives_at_the_edges(spark):
    # one label takes nearly all rows; all vectors alike; scores of any size; negative products; no rows
    alike = [(i, [1.0, 2.0, 3.0], 0 if i < 50 else 1) for i in range(60)]
    huge = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(np.random.default_rng(2).integers(1, 6_000_000, (20, 4)).tolist())]
    away = [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [-1.0, 0.5], 1), (3, [0.0, 0.0], 1), (6, [0.0, 1.0], 0)]
    alone = [(0, [1.0], 0)]
    for rows in (alike, huge, away, alone):
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
        assert mined(df, cells=30) == plain_mine(rows, lambda i: i % 3 == 0)
    assert mined(df.limit(0)) == []


def test_early_discards_keep_what_counts():
    """One block against all its rows, with few survivors; the rotation may be any orthogonal one."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    v = (rng.normal(size=(400, 32)) * np.geomspace(300, 1, 32)).astype("<i8")
    side = lambda v: pa.table({"ids": [np.arange(len(v), dtype="<i8").tobytes()], "labels": [np.zeros(len(v), "<i8").tobytes()], "vectors": [b"<i8" + v.tobytes()], "goals": [b""]})
    for basis in (np.eye(32), np.linalg.qr(rng.normal(size=(32, 32)))[0], np.linalg.qr(rng.normal(size=(32, 32)))[0][:, :8]):
        x = hard_negatives.Side(side(v), np.ascontiguousarray(basis))
        none = np.full((400, 1), np.inf)
        i, j, scores = hard_negatives.search(x, np.arange(400), x, range(400), hard_negatives.slack(basis), 3, -none, none, True)
        keep = hard_negatives.best(i, j, scores, 3)
        exact = v @ v.T
        want = [(a, b) for a in range(400) for b in sorted((b for b in range(400) if b != a), key=lambda b: (-exact[a, b], b))[:3]]
        assert list(zip(i[keep].tolist(), j[keep].tolist())) == want
        if basis.shape[1] == 32 and basis[0, 0] == 1:
            assert len(i) < 40_000  # of 160,000 pairs


@tables
def test_op13(spark):
    rows = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in QUERIES["op13_hard_negatives"](spark, DATA).collect())
    assert got == plain_mine(rows, lambda i: i % 50 == 0)


def test_empty_tables_as_registered(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op5_packing", "op7_topk", "op1_pii", "op11_fim", "op12_licenses", "op13_hard_negatives"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0, name
