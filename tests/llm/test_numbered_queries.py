"""The numbered queries as they are registered, on the smallest tables, against the contract said plainly."""

import hashlib
import os
import re
import zlib

import pytest

from corollary.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spans(kind, pattern, text, keep, flags=0):
    return [(kind, m.start(), m.end()) for m in re.finditer(pattern, text, flags) if keep(m)]


def digits(m):
    return re.sub("[^0-9]", "", m.group())


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def test_op1(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op1_pii"](spark, DATA).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        kinds = [
            spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t, lambda m: True),
            spans("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t, lambda m: all(int(p) <= 255 for p in m.group().split("."))),
            spans("card", r"[0-9]([\x20-]?[0-9])+", t, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
            spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", t, lambda m: 9 <= len(digits(m)) <= 15),
        ]
        base = [f"{k}:{a}:{b}" for kind in kinds for k, a, b in kind]
        r = rows[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == list(map(len, kinds)) and r.base_sha256 == sha(",".join(base)), i
        assert set(base) <= set(r.spans.split(",")) | ({""} if not base else set())


def test_op2(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op2_secrets"](spark, DATA).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        kinds = [
            spans("assign", r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, lambda m: len(m[1]) >= 8),
            spans("access", r"AKIA[A-Z0-9]+", t, lambda m: len(m.group()) >= 16),
            spans("hex", r"[0-9a-f]+", t, lambda m: len(m.group()) >= 32),
        ]
        order = {"assign": 0, "access": 1, "hex": 2}
        base = [f"{k}:{a}:{b}" for k, a, b in sorted((s for kind in kinds for s in kind), key=lambda s: (s[1], order[s[0]]))]
        r = rows[i]
        assert [r.n_assign, r.n_access, r.n_hex] == list(map(len, kinds)) and r.base_sha256 == sha(",".join(base)), i
        assert set(base) <= set(r.spans.split(",")) | ({""} if not base else set())


def test_op4(spark):
    """The tables' articles are all that is between an article's tags, without markup."""
    import html

    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = {r.page_id: r for r in QUERIES["op4_html"](spark, DATA).collect()}
    assert rows.keys() == pages.keys()
    for i, p in pages.items():
        (article,) = re.findall(r"<article>(.*)</article>", p.html, re.S)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", article))
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
        r = rows[i]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text) and r.url == p.url, i


def test_op5(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in QUERIES["op5_packing"](spark, DATA).collect():
        pieces.setdefault(r.doc_id, {})[r.piece] = r
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for i, t in texts.items():
        ids, at = model.encode(t, add_special_tokens=False).ids + [2], 0
        for k in range(len(pieces[i])):
            r = pieces[i][k]
            part = ids[at : at + r.length]
            assert r.start == at and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) and r.length <= 1024 and (k == 0 or r.length == 1024)
            at += r.length
        assert at == len(ids) and len(pieces[i]) == -(-len(ids) // 1024)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(n for parts in sequences.values() for _, n in parts)
    assert len(sequences) <= -(-total // 1024) + 1


def test_op6(spark, texts):
    rows = QUERIES["op6_quality"](spark, DATA).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert {r.doc_id for r in rows} == texts.keys()
    score = {}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert score.setdefault(texts[r.doc_id], r.score) == r.score  # equal texts, equal scores
    unseen = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [s for s, q in unseen if q == 1], [s for s, q in unseen if q == 0]
    if len(good) > 3 and len(bad) > 3:
        assert sum(g > b for g in good for b in bad) > 0.8 * len(good) * len(bad)


def test_op8(spark, texts):
    seen = {}
    rows = QUERIES["op8_media"](spark, DATA).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        data = texts[r.doc_id].encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert seen.setdefault(data, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_op10(spark, texts):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rows = QUERIES["op10_bpe"](spark, DATA).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        ids = encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r.doc_id]))


def test_bpe_with_clashing_columns(spark):
    from corollary.llm import bpe

    df = spark.createDataFrame([(1, "a b", 7, "x"), (1, "a b", 7, "x")], "doc_id long, text string, n_tokens long, ids string")
    assert [(r.doc_id, r.n_tokens, bytes(r.bytes)) for r in bpe.round_trip(df).collect()] == [(1, 2, b"a b")] * 2


def test_pipeline_at_the_edges(spark, tmp_path):
    """Null ids, texts and other columns, repeated rows, extra columns, and empty tables."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, group int"
    good = " ".join(f"word{i} and" for i in range(60))
    rows = [(1, good, None, None, None, "a", 1), (1, good, "en", "s", 3, "b", 2), (2, None, None, "s", None, None, None), (None, "no id here", "en", None, 1, "c", 3), (3, "", "en", "s", 0, "d", 4), (4, good + " more", "en", "s", 5, "e", 5)]
    for name, some in (("full", rows), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 0, 0), (4, 1, None)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            assert f(spark, docs, folder).columns == docs.columns, stage
        got = corpus_pipeline.run(spark, folder)
        assert {"doc_id", "piece", "sequence_id"} <= set(got.columns) and (got.count() > 0) == bool(some)
