"""Near duplicates, repeated passages, quality, pages, vectors and the pipeline."""

import hashlib
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corollary.llm import common, html_text, near_dup, quality, substring, topk

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed, n, words=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(0, words))] for _ in range(n // 3)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(rng.choice([" ", "\n", "  ", "\t"]).join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return [*enumerate(out, 1), (n + 1, None), (n + 2, ""), (n + 3, " \n"), (n + 4, "one"), (n + 5, "ONE")]


def test_words():
    texts = ["a  b\x0bc", None, "", "é\x85d\xa0e", "x" * 5000, " lead and trail "]
    w = common.Words(texts)
    got = [[bytes(w.buf[a:b]).decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])] for i in range(len(texts))]
    assert got == [SPLIT.findall(t or "") for t in texts]


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = SPLIT.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    component = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and component[a] != component[b]:
                x, y = sorted((component[a], component[b]))
                component = {i: x if c == y else c for i, c in component.items()}
    return {(i, len(sets[i]), component[i], component[i] == i) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rows = corpus(k, 240)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    assert {tuple(r) for r in near_dup.linked(df, k=k).collect()} == brute_components(rows, k, 80)


def test_near_duplicate_edges(spark):
    df = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (3, "A B C"), (3, "A B C")], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dup.linked(df, k=2).collect()), key=str)
    assert got == sorted([(None, 2, 3, None), (7, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True)], key=str)
    assert near_dup.linked(df.limit(0), k=2).count() == 0


def test_near_duplicates_among_repeated_ids_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(12)
    long = [f"w{rng.randrange(9999)}" for _ in range(60_000)]
    rows = [(i, " ".join(long[: 59_000 + i])) for i in (5, 3, 900)] + [(7, "a b c d e f g h")] * 6 + [(8, "a b c d e f g x")] * 5 + [(20 + i, f"one of many pages with a common text and number {i}") for i in range(40)]
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, component long")
    got = {r.doc_id: r.component_id for r in near_dup.linked(df, k=2).collect()}
    assert got == {i: c for i, _, c, _ in brute_components(rows, 2, 80)} and got[900] == 3
    pairs = spark.createDataFrame([(7, 8), (3, 5)], "a long, b long")
    assert near_dup._confirmed(pairs, df, "doc_id", "text", 2, 60).count() == 2  # one row a pair, however many rows have an id


def test_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, near_dup.components(links).collect()))
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == 100


def brute_removed(rows, k):
    first, words = {}, {}
    for i, t in rows:
        words[i] = SPLIT.findall(t or "")
        for j in range(len(words[i]) - k + 1):
            w = tuple(words[i][j : j + k])
            first[w] = min(first.get(w, i), i)
    out = set()
    for i, w in words.items():
        gone = {p for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for p in range(j, j + k)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.add((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("slice_chars", [200, 2_000_000])
def test_repeated_passages(spark, slice_chars, monkeypatch):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "cé", "dd", "e"])
    passages = [[word() for _ in range(rng.randint(4, 20))] for _ in range(6)] + [["a"] * 30]
    rows = [(i, " ".join(sum((rng.choice([[word()], rng.choice(passages)]) for _ in range(rng.randint(0, 9))), []))) for i in rng.sample(range(1000), 60)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(5)
    monkeypatch.setattr(common, "SLICE_CHARS", slice_chars)
    assert {tuple(r) for r in substring.removed(df, k=5).collect()} == brute_removed(rows, 5)


def test_hot_lines_and_colliding_hashes(spark, monkeypatch):
    """A line that most documents have between different words; hashes of 8 bits; very long texts."""
    rng = random.Random(9)
    line = "this line stands in nearly all of them".split()
    other = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = [(i, " ".join(other(9) + line + other(9) + (other(3) + line if i % 3 else []))) for i in range(150)] + [(500, None), (501, " \n ")]
    rows += [(600, " ".join(other(20_000))), (601, rows[3][1] + " \u00e9 " + rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_removed(rows, 6)
    for name, v in (("HOT", 1e-3), ("LOCAL", 1e-4), ("LEAST", 2)):
        monkeypatch.setattr(substring, name, v)
    assert len(substring._hot(df.select("doc_id", "text"), 6)[1]) > 0
    assert {tuple(r) for r in substring.removed(df, k=6).collect()} == want
    assert {tuple(r) for r in substring.removed(df, k=6, bits=8).collect()} == want


def test_spans_and_cut(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"x y\n{passage} z"), (2, f"begin {passage}\n\nend here"), (3, "clean  text\nstays"), (4, None)]
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, _starts int")
    got = {r.doc_id: r.text for r in substring.cut(df).collect()}
    assert got == {1: rows[0][1], 2: "begin end here", 3: "clean  text\nstays", 4: None}
    found = common.checkpoint(substring.paths(df))
    spans = substring.compacted(found)
    assert [tuple(r) for r in spans.collect()] == [(2, 1, 48, 1, 2)] and found.count() > 1  # joined across buckets
    keyed = substring._keyed(df, "doc_id", "text")
    assert substring.with_digests(spans, keyed, "doc_id", "text", 13).first().digests == [hashlib.sha256(passage.encode()).digest()]
    wrong = substring.with_digests(spans.withColumn("src_start", F.col("src_start") - 1), keyed, "doc_id", "text", 13)
    kept = {r.doc_id: r for r in substring._removed(keyed, wrong, "doc_id", "text", 13, 64).collect()}
    assert kept[2].n_removed == 0 and len(kept[2].ask) == 48  # other words than the source's stay, and are asked again
    assert substring.removed(df.limit(0)).count() == 0 and substring.cut(df.limit(0)).count() == 0


def test_quality_learns_bytes(spark):
    rng = random.Random(6)
    text = lambda bad: " ".join("".join(rng.choice("etaoin") for _ in range(4)) + ("***" if bad else "") for _ in range(rng.randint(4, 90)))
    rows = [(i, text(i % 3 == 0), int(i % 3 > 0)) for i in range(600)] + [(1000, None, None), (1001, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    net = quality.fit(df, df.where("quality is not null").select("doc_id", "quality"), rows=150)
    got = {r.doc_id: r for r in quality.scored(df, net).collect()}
    test = [r for r in rows if r[2] is not None]
    assert np.mean([got[i].predicted == q for i, _, q in test]) > 0.97 and 0 <= got[1000].score <= 1 and got[1000].score == got[1001].score
    assert {r.doc_id for r in quality.kept(df, net).collect()} == {i for i, r in got.items() if r.predicted}
    one_class = quality.fit(df, df.where("quality = 1").select("doc_id", "quality"))
    assert one_class.score([b"x"]).tolist() == [1.0] and quality.fit(df, df.limit(0).select("doc_id", "quality")).score([b""]).tolist() == [0.5]
    assert quality.scored(df.limit(0), net).count() == 0


def test_scores_are_the_texts_alone(spark, monkeypatch):
    """Bit by bit the same score alone, in a batch, in the reversed batch, in other parts and slices."""
    rng = random.Random(8)
    net = quality.Network(5)
    texts = [bytes(rng.choice(b"etaoin shrdlu") for _ in range(n)) for n in [0, 1, 4, 5, 123, 124, 125, 127, 128, 129, 252, 256, 1000, *rng.sample(range(5000), 80)]]
    alone = [net.score([t])[0] for t in texts]
    assert net.score(texts).tolist() == alone and net.score(texts[::-1]).tolist() == alone[::-1]
    monkeypatch.setattr(quality, "BLOCK", 512)
    assert net.score(texts).tolist() == alone
    long = "long text \u00e9 " * 200_000
    rows = [(i, t.decode(), i) for i, t in enumerate(texts)] + [(i, t.decode(), -i) for i, t in enumerate(texts)] + [(9000, long, 0), (9001, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score long")
    one, two = ({r.doc_id: r.score for r in quality.scored(d, net).collect()} for d in (df.coalesce(1), df.orderBy(F.desc("doc_id")).repartition(7)))
    assert one == two and [one[i] for i in range(len(texts))] == alone and one[9001] == alone[0] and one[9000] == net.score([long.encode()])[0]


def test_quality_training_windows(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_CHARS", 50)
    df = spark.createDataFrame([(1, "é" * 500, 1), (1, "é" * 500, 1), (2, "short", 0), (3, None, 1), (5, "no label", None)], "doc_id long, text string, quality int")
    data, counts = quality.sample(df, df.select("doc_id", "quality"))
    assert sorted(data) == sorted([("é".encode() * 50, 1), (b"short", 0), (b"", 1)]) and counts == {1: 2, 0: 1}


def test_gradients_are_right():
    net, texts, y = quality.Network(3), [b"abcdefgh" * 40, b"zz", b""], np.array([1.0, 0.0, 1.0], np.float32)
    loss = lambda: -np.mean(np.log(np.where(y == 1, p := net.score(texts), 1 - p)))
    grad = net._gradients(texts, y)
    for name, index in (("out", (3,)), ("out", (24,)), ("bias", (2,)), ("tables", (1, ord("z"), 4)), ("tables", (0, ord("a"), 2))):
        x = getattr(net, name)
        was, eps = x[index], 1e-2
        x[index] = was + eps
        up = loss()
        x[index] = was - eps
        down = loss()
        x[index] = was
        assert abs((up - down) / (2 * eps) - grad[name][index]) < 5e-3


def test_scores_are_those_of_a_plain_convolution():
    """Filters at every byte, maxima of overlapping chunks, mean and maximum of those: said byte by byte."""
    net, rng = quality.Network(3), random.Random(8)
    net.bias[...] = np.linspace(-0.5, 0.5, quality.FILTERS)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 4, 120, 124, 125, 128, 252, 253, 700)]
    table = net.tables.astype(float)
    for text, score in zip(texts, net.score(texts)):
        blocks = -(-(len(text) + quality.WIDTH - 1) // quality.HALF)
        data = text + bytes(blocks * quality.HALF - len(text))
        at = [sum(table[w][data[i + w]] for w in range(quality.WIDTH)) for i in range(len(data) - quality.WIDTH + 1)]
        half = [np.max(at[k * quality.HALF : (k + 1) * quality.HALF], axis=0) for k in range(blocks)]
        chunks = [np.maximum(a, b) for a, b in zip(half, half[1:])] or half
        chunks = [np.maximum(c + net.bias, 0) for c in chunks]
        logit = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), [1]]) @ net.out.astype(float)
        assert abs(score - 1 / (1 + np.exp(-logit))) < 1e-4, len(text)


def test_rows_without_an_id_are_spread(spark):
    """Half of the rows have no id: they meet in no group of the joins, and repeats among them stay as they are."""
    line = " ".join(f"w{i}" for i in range(15))
    rows = [(i if i % 2 else None, f"{line} only {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = substring._keyed(df, "doc_id", "text")
    assert not keyed.schema["key"].nullable  # else one join filters nulls, and does not read the other one's exchange
    keys = keyed.groupBy("key").count()
    assert keys.agg(F.max("count")).first()[0] <= 4 and keys.count() > 380
    got = substring.removed(df)
    assert got.where("doc_id is null").agg(F.max("n_removed")).first()[0] == 0
    assert {r.n_removed for r in got.where("doc_id > 1").collect()} == {16} and got.count() == 400
    ids = substring.cut(df).where("doc_id is null").select("text")
    assert {r.text for r in ids.collect()} == {t for i, t in rows if i is None}


def test_rows_with_one_id_are_packed_in_many_groups(spark):
    from corollary.llm import packing

    df = spark.createDataFrame([(None if i % 2 else 7, f"text {i} " * (i % 9)) for i in range(300)], "doc_id long, text string")
    got = packing.packed(df, group=20).collect()
    assert len(got) == 300 and len({r.sequence_id >> 32 for r in got}) > 8


def test_held_out_matches_crc(spark):
    import zlib

    ids = spark.range(50).withColumnRenamed("id", "doc_id")
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in ids.withColumn("h", quality.held_out()).collect())


PAGE = '<!DOCTYPE html><html><head><title>t</title><script>var a="</p><article>";</script></head><body class="x"><nav><a href="/">menu {i}</a></nav><div class="cookie-notice">We use cookies</div><div id="sidebar"><p>links</p></div>{body}<div class="comments"><p>I agree {i}</p></div><form>name <input></form><footer>&copy; f</footer></body></html>'


def role(*names):
    return html_text.role_ids([(-1, "", 0), *((i, n, 0) for i, n in enumerate(names))])[-1]


def test_pages(spark):
    rows = []
    for i in range(12):
        body = f"<article><h1>Title &amp;  {i}</h1><p>First\n line {i} <b>bold</b>.<p>Second &lt;p&gt;<ul><li>a<li>b</ul></article>"
        if i % 3 == 1:
            body = body.replace("article>", "div>").replace("<div>", '<div class="post-content">')
        rows.append((i, f"https://H{i % 3}.example.com/{i}?q", PAGE.replace("{body}", body).replace("{i}", str(i)), 1))
    rows += [(50, None, None, 1), (51, "", "", 1), (52, "x", "no tags at all", 1), (53, "http://one.org", rows[0][2], 1), (54, "http://two.org", "<p>a<p>b", 1)]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()}
    for i in range(12):
        assert got[i].text == f"Title & {i}\nFirst line {i} bold.\nSecond <p>\na\nb", got[i].text
    assert (got[50].text, got[51].text, got[52].text, got[54].text) == ("", "", "no tags at all", "a\nb") and got[53].text == got[0].text and got[0].n_chars == len(got[0].text)
    found = html_text.templates(spark.createDataFrame(rows, "page_id long, url string, html string, host int"))
    assert {r.slot for r in html_text.main_slots(found).collect()} >= {role("html", "body.x", "article"), role("html", "body.x", "div.post-content")}
    sizes = Counter((r.host, r["class"]) for r in found.collect())
    assert max(sizes.values()) >= 6  # roles that stand once in each page share a vector


def test_template_text_goes_without_names(spark):
    """Containers that no element or class gives away: the same text in all pages, or links."""
    page = "<html><body><div id=c1>We are a site about things and nothing else at all, always the same words here</div><div id=c2><ul><li><a href=x>Story {i}</a><li><a href=y>Other {i}</a></ul></div><div id=c3><h1>Head {i}</h1><p>Text {i} of page {i} with some words.</p></div></body></html>"
    df = spark.createDataFrame([(i, "http://h.org/", page.replace("{i}", str(i))) for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in html_text.main_text(df).collect()} == {f"Head {i}\nText {i} of page {i} with some words." for i in range(6)}


NEUTRAL = "<html><body><div class=k1><ul><li><a href=a>First {0}</a><li><a href=b>Second {0}</a></ul></div><div class=k2>All rights of this site are with its owners, as they always were</div><div class=k3><h1>{1}</h1><p>{2}</p><p>{3}</p></div><div class=k4>{4}</div></body></html>"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."


def neutral_pages(n=8):
    rng = random.Random(11)
    out = []
    for i in range(n):
        parts = sentence(rng, 4), sentence(rng, 40), sentence(rng, 30)
        comments = "".join(f"<div class=m1>{sentence(rng, 15)}</div>" for _ in range(rng.randint(2, 5)))
        out.append((i, "http://n.org/", NEUTRAL.format(sentence(rng, 2), *parts, comments), "\n".join(parts)))
    return out


def test_classes_decide(spark):
    """Neutral names, no article element: menu, template text and readers' comments are told by what the
    host's pages have in their slots, and by nothing else."""
    rows = neutral_pages()
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert [got[i] for i in range(len(rows))] == [r[3] for r in rows]
    without = {r.page_id: r.text for r in html_text.main_text(df, support=2.0).collect()}
    assert all(without[i] != got[i] for i in got)
    joined = {r.page_id: r.text for r in html_text.main_text(df.union(df), small=-1).collect()}
    assert joined == got and html_text.main_text(df.union(df), small=-1).count() == 2 * len(rows)  # repeated rows, the other join


def test_names_take_nothing_from_an_article(spark):
    """Words in names inside of the main slot, and headings in an article's header, stay."""
    body = "<nav>menu</nav><article><header><h1>Head {0}</h1></header><p>Text {0} has several words in it.</p><ul class=social-history><li>Born {0}</ul><section id=notices><p>Legal notices {0}.</p></section><div class=ad>Buy {0}!</div><aside>More {0}</aside></article><footer>f</footer>"
    df = spark.createDataFrame([(i, f"http://{h}.org/", f"<html><body>{body.format(i)}</body></html>") for i, h in enumerate(["a", "a", "a", "a", "a", "b"])], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got == {i: f"Head {i}\nText {i} has several words in it.\nBorn {i}\nLegal notices {i}." for i in range(6)}


def test_pages_at_the_edges(spark):
    df = spark.createDataFrame([(1, "http://l.org", "<body><p>" + "word and more " * 200_000 + "</p></body>"), (None, None, None), (2, "http://l.org", "<body><p>other</p></body>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.main_text(df.withColumn("slot", F.lit(1)).withColumn("host", F.lit("x"))).collect()}
    assert got[1].text == ("word and more " * 200_000).strip() and got[1].n_chars == len(got[1].text) and got[2].text == "other" and got[None].text == ""
    assert html_text.main_text(df.limit(0)).count() == 0


def test_own_containers_are_no_template(spark):
    """Text containers with names of their own: two layouts, ids per page, copies of one page."""
    page = "<html><body><div {0}><p>{1}</p></div></body></html>".format
    text = [f"Article {i} tells of {w} and of nothing else." for i, w in enumerate(["hills", "lakes", "roads", "boats"])]
    rows = [(0, "http://two.org/", page("class=plain", text[0])), (1, "http://two.org/", page("class=wide", text[1]))]
    rows += [(2 + i, "http://ids.org/", page(f'id="post-{i}"', text[i])) for i in range(2)]
    rows += [(4 + i, "http://copies.org/", page("class=old", text[0]) if i < 3 else page(f"class=n{i}", text[i - 2])) for i in range(6)]
    rows += [(10 + i, "http://moved.org/", page("class=old", text[0]).replace("</body>", f"<p>Seen {i}</p></body>") if i < 2 else page(f"class=n{i}", text[i])) for i in range(4)]
    want = [*text[:2], *text[:2], text[0], text[0], text[0], *text[1:4], f"{text[0]}\nSeen 0", f"{text[0]}\nSeen 1", *text[2:]]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(14)] == want
    assert html_text.extract(rows[0][2], role("html", "body"), [role("html", "body", "div.plain")]) == text[0]  # roles left out never take all


def test_embedded_elements_end():
    """A self-closed or unclosed element takes no text with it, a closed one all inside it."""
    page = "<html><body><p>One {0} two.</p><p>Three</p></body></html>".format
    for t in html_text.EMBEDDED:
        for tag in (f"<{t} class=icon/>", f'<{t} a=">"/>', f"<{t.upper()} />", f"<{t}>", f"<{t} x='1'>", f"</{t}>", f"<{t}/></{t}>"):
            assert html_text.extract(page(tag), None) == "One two.\nThree", tag
            assert html_text.extract(page(f"{tag} and <{t}>no</{t}>"), None) == "One and two.\nThree", tag
        assert html_text.extract(page(f"<{t} a='</{t}>'>no <{t}>no</{t}> <b>no</b> <{t}/> </p></{t}>"), None) == "One two.\nThree"
    began = time.perf_counter()
    html_text.extract("<svg>" * 50_000 + "text" + "<object>a</object><video>" * 20_000, None)
    assert time.perf_counter() - began < 20
    for t in html_text.RAW:
        assert html_text.extract(page(f"<{t}>no"), None) == "One"


def test_odd_markup_takes_linear_time():
    n = 20_000
    odd = ["<a" * n, '<a "' * n, "<!--" * n, "<div>" * n, "<div>text" * n, "<li>" * n, "<div><li>text" * n, "<div>" * n + "<li>text" * n, "<div>text" * n + "</section>" * n, "&amp" * n]
    odd += ["<table>" + "<tr><td>cell text" * n, "<table><td>cell text" * n, "<article>text" * n, "".join(f"<div class=c{i}>text" for i in range(n))]
    for t in odd:
        began = time.perf_counter()
        html_text.extract(f"<html><body>{t}", None)
        assert time.perf_counter() - began < 4, t[:30]  # 0.3 to 0.8 s here; twice the depth took eight times as long once


def test_end_tags_may_be_left_out():
    """Cells, rows and items end where the next one begins, but not over the table or list that they are in."""
    for page in ("<table><tr><td>a<td>b<tr><th>c<td>d</table>", "<table><tbody><tr><td>a</td><td>b</td></tr></tbody><tbody><tr><th>c</th><td>d</td></tr></tbody></table>"):
        found, nodes = html_text.blocks(page)
        assert [t for _, t, _ in found] == list("abcd")
        rows = [nodes[node][0] for node, _, _ in found]
        assert rows[0] == rows[1] != rows[2] == rows[3]
    found, nodes = html_text.blocks("<ul><li>a<ul><li>b<li>c</ul>d<li><table><tr><td><table><td>e</table>f</td></table>g</ul>")
    parent = {t: node for node, t, _ in found}
    assert list(parent) == list("abcdefg") and parent["a"] == parent["d"] and nodes[parent["b"]][0] == nodes[parent["c"]][0] and nodes[nodes[parent["b"]][0]][0] == parent["a"]
    assert nodes[parent["g"]][0] == nodes[parent["a"]][0] and parent["e"] != parent["f"]


def test_only_what_is_no_article_goes_from_inside(spark):
    body = "<article><h1>Head {0}</h1><p>Text {0} has several words in it.</p><div class=popup>A note {0}</div><div class=share>Shared {0} times</div><p><button>Press {0}</button></p><div class=comments><p>I agree {0}</p></div></article>"
    df = spark.createDataFrame([(i, f"http://{'a' if i < 5 else 'b'}.org/", f"<html><body><nav>menu</nav>{body.format(i)}</body></html>") for i in range(6)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got == {i: f"Head {i}\nText {i} has several words in it.\nA note {i}\nShared {i} times\nPress {i}" for i in range(6)}



def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(300)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(8)]  # ties
    vectors += [(2000, None), (2001, [0.1] * 7 + [float("nan")]), (2002, [0.1] * 7 + [float("inf")]), (2003, [0.1] * 7 + [None]), (2050, [0.1] * 3), (2100, [0.2] * 3), (2150, []), (None, [0.1] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, block int")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5, block=40, group=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(np.float64)).astype(int) for i, v in vectors if i is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v)}
    for q in [i for i in whole if i % 50 == 0]:
        scores = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        assert sorted(got.get(q, [])) == [(k, i, -s) for k, (s, i) in enumerate(scores, 1)], q
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_scores_are_exact_whatever_their_size(spark):
    """Components beyond 2 ** 26 on one side, on both, and sums beyond 53 bits."""
    big = [(1, [1e10, 3.0]), (2, [1e10, 1.0]), (3, [1e10, 2.0]), (50, [1e4, 1e-2]), (100, [1.3e4, 5.0]), (100, [1.3e4, 5.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 2).collect()
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in big}
    for q in (50, 100):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i, _ in big if i != q)[:2]
        assert sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q) == [(k, i, -s) for k, (s, i) in enumerate(scores, 1)]


def test_threshold_stops_early():
    x = np.zeros((2000, 4), np.int64)
    x[:, 0] = np.arange(2000)
    lists = topk.Lists(np.arange(2000), x)
    seen = []
    real = lists.x
    lists.x = type("Spy", (), {"__getitem__": lambda _, rows: (seen.append(len(rows)), real[rows])[1], "dtype": real.dtype})()
    assert lists.top(np.array([3, 0, 0, 0]), -1, 2) == [(5997, 1999), (5994, 1998)] and sum(seen) < 100


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.checkpoint(stage(spark, docs, DATA))
        assert docs.columns == before.columns and docs.dtypes == before.dtypes, name
    assert 0.5 * n < docs.count() < n
    pieces = corpus_pipeline.run(spark, DATA)
    assert pieces.select("doc_id").distinct().count() == docs.count() and pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["op3_near_dup", "op7_topk", "op9_substring"])
def test_queries_against_sql(spark, name):
    import duckdb

    from corollary.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    columns = ", ".join(sorted(got.columns))
    want = con.execute(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(want)
