"""Byte-pair encoding and packing."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corollary.llm import bpe, packing

PARTS = st.lists(st.sampled_from(["a", "the", "'s", "'ll", "'", " ", "  ", "\n", "\r\n", "1", "é", "語", "!", "́", "\x1c", "\xa0", "²", "<|endoftext|>", "ontion,", "x\ny"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(PARTS, st.integers(1, 9))
def test_tree_gives_the_ids_of_one_pass(parts, leaf):
    c, t = bpe.codec(bpe.default_path()), "".join(parts)
    ids = bpe.encode(t, c, leaf)
    assert ids == c.leaf(t) and bpe.decode(ids, c, leaf=3) == t.encode()


@pytest.mark.parametrize("t", ["a" * 30_000, " " * 20_000 + "x", "ab 1" * 9000, "語" * 9000, "'s" * 9000, "á" * 9000])
def test_long_matches(t):
    c = bpe.codec(bpe.default_path())
    assert bpe.encode(t, c) == c.leaf(t)


def test_bpe_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    assert bytes(rows[1].bytes) == b"a b" and rows[2].n_tokens == rows[3].n_tokens == 0 and bytes(rows[2].bytes) == b""
    two = {r.doc_id: r for r in bpe.decoded(bpe.encoded(df)).collect()}
    assert two[1].ids_sha256 == rows[1].ids_sha256 and bpe.round_trip(df.limit(0)).count() == 0


def ids_of(w, texts):
    order, ids, begin = w.encode(texts)
    out = {i: ids[a:b].tolist() for i, a, b in zip(order, begin, begin[1:])}
    return [out[i] for i in range(len(texts))]


def wanted(w, texts):
    return [e.ids + [2] for e in w.model.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=4))
def test_words_give_the_tokenizers_ids(parts):
    w, texts = packing.tokenizer(packing.default_path()), ["".join(p) for p in parts]
    assert ids_of(w, texts) == wanted(w, texts)


def test_merging_by_rank_is_the_tokenizers_merging():
    """Every token of letters, and words of two such tokens, alone and behind a space."""
    w = packing.WordTokenizer(packing.default_path())
    assert w.merge is not None
    letters = [t for i in range(50_256) if (t := w.model.decode([i]).strip()).isalpha() and "\ufffd" not in t]
    rng = random.Random(5)
    words = [*letters, *(rng.choice(letters) + rng.choice(letters) for _ in range(20_000))]
    texts = [*words, *(f"x {t}" for t in words)]
    assert ids_of(w, texts) == wanted(w, texts)
    w.clear()
    assert ids_of(w, texts[-9:]) == wanted(w, texts[-9:])


def dominates(g, f):
    """Whether the pieces of f fit into places as large as the pieces of g and the slack stays."""
    if not f:
        return True
    return any(room >= f[0] and dominates((*g[:i], room - f[0], *g[i + 1 :]), f[1:]) for i, room in enumerate(g))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=7), st.integers(0, 14))
def test_fillings_left_out_are_dominated(items, room):
    counts = Counter(items)
    got = list(packing.fillings(counts, room, room))
    assert len({tuple(sorted(f)) for f in got}) == len(got)
    every = {tuple(sorted(c, reverse=True)) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room}
    assert {tuple(sorted(f, reverse=True)) for f in got} <= every
    assert all(any(dominates(g, f) for g in got) for f in every)


def best_of(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= items[i] and bins[k] not in bins[:k]:
                bins[k] -= items[i]
                go(i + 1, bins)
                bins[k] += items[i]
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=10))
def test_bins_are_as_few_as_can_be(items):
    bins = packing.complete(Counter(items), 20)
    assert Counter(x for b in bins for x in b) == Counter(items) and all(sum(b) <= 20 for b in bins)
    assert packing.lower_bound(Counter(items), 20) <= len(bins) == best_of(items, 20)


def test_search_beats_best_fit():
    sizes = Counter([6, 4, 4, 3, 3, 2, 2, 6, 5, 5])  # total 40
    assert len(packing.complete(sizes, 10)) == 4
    rng, better = random.Random(1), 0
    for _ in range(200):
        c = Counter(rng.randint(20, 60) for _ in range(24))
        better += len(packing.complete(c, 100)) < len(packing.best_fit(c, 100))
    assert better > 0 and packing.complete(Counter(), 10) == []


def test_packed_rows(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["tree", "of", "longer,", "wörds\n"]) for _ in range(rng.choice([0, 3, 50, 400, 2500]))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, group int")
    w = packing.tokenizer(packing.default_path())
    rows = packing.packed(df, group=20, keep_ids=True).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.length == len(bytes(r.ids)) // 4 <= 1024
    for i, t in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert np.frombuffer(b"".join(bytes(p.ids) for p in parts), "<u4").tolist() == wanted(w, [t])[0] and [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        assert all(p.length == 1024 for p in parts[1:])
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.packed(df.limit(0)).count() == 0
