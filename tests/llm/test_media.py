"""AVI columns: exact round trips, damaged files, shots."""

import hashlib
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corollary.llm import media


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=4000), max_size=4))
def test_payloads_come_back(data):
    payloads = [media.padded(d) for d in data]
    files = media.write_avi(payloads)
    assert [media.payload_of(i) for i in media.read_avi(files)] == payloads


def test_extremes():
    data = [b"", b"\xff" * 5000, b"\0\xff" * 3000, bytes(range(256)) * 40, b"x" * 192, b"x" * 193, b" " * 100_000]
    files = media.write_avi([media.padded(d) for d in data])
    infos = media.read_avi(files)
    assert all(media.payload_of(i) == media.padded(d) for i, d in zip(infos, data))
    assert [len(media.padded(d)) for d in data[:1]] == [192] and infos[4]["size"] == (1, 192)
    assert media.write_avi([media.padded(d) for d in data]) == files


def test_damaged_files():
    (good,) = media.write_avi([media.padded(b"abc" * 1000)])
    for bad in (b"", b"RIFF" + b"\0" * 20, good[:200], good.replace(b"idx1", b"xxxx"), good.replace(b"\xff\xc3", b"\xff\xc0", 1)):
        with pytest.raises(ValueError):
            media.read_avi([bad])
    rng = np.random.default_rng(3)
    for at in [*range(0, 700), *rng.integers(700, len(good), 300)]:  # one flipped byte: an error or other samples, never another exception
        bad = bytearray(good)
        bad[at] ^= int(rng.integers(1, 256))
        (info,) = media.read_avi([bytes(bad)], strict=False)
        assert info.get("error") or media.clips(info) is not None
    for n in range(0, len(good), 37):
        assert "error" in media.read_avi([good[:n]], strict=False)[0]


def test_no_damaged_byte_takes_long():
    """Every byte of a small file, and every value of the size bytes of a larger one."""
    (small,) = media.write_avi([media.padded(b"some text in two rows of samples " * 8)])
    (large,) = media.write_avi([media.padded(b"abc" * 3000)])
    rng = np.random.default_rng(4)
    size = large.index(b"\xff\xc3") + 5
    cases = [(small, at, int(x)) for at, x in enumerate(rng.integers(1, 256, len(small)))] + [(large, at, x) for at in range(size, size + 4) for x in range(1, 256)]
    errors = 0
    for data, at, x in cases:
        bad = bytearray(data)
        bad[at] ^= x
        began = time.perf_counter()
        (info,) = media.read_avi([bytes(bad)], strict=False)
        assert time.perf_counter() - began < 0.5, (at, x)  # 0.01 s here
        errors += data is large and bool(info.get("error"))
    assert errors == 4 * 255


def test_shots_against_a_plain_count():
    """Histograms, thresholds and the feature string, said without numpy."""
    rng = np.random.default_rng(5)
    data = b"".join(bytes(rng.integers(a, b, int(n), dtype=np.uint8)) for a, b, n in [(0, 60, 9000), (100, 255, 5000), (90, 255, 7000), (10, 20, 3100)])
    (info,) = media.read_avi(media.write_avi([media.padded(data)]))
    frames = [bytes(f) for f in info["samples_of"]]
    hists = [[sum(b // 16 == k for b in f) for k in range(16)] for f in frames]
    diffs = [sum(abs(x - y) for x, y in zip(p, q)) / (2 * len(frames[0])) for p, q in zip(hists, hists[1:])]
    starts = [0]
    for i, d in enumerate(diffs):
        last = diffs[max(0, i - 8) : i]
        if last:
            mean = sum(last) / len(last)
            if d > mean + 3 * sum(abs(x - mean) for x in last) / len(last) + 0.05:
                starts.append(i + 1)
    assert media.cuts(info["samples_of"]) == starts and len(starts) > 2
    bins = [sum(b // 32 == k for f in frames for b in f) for k in range(8)]
    shots = "/".join(f"{a}+{b - a}@{40000 * a}" for a, b in zip(starts, [*starts[1:], len(frames)]))
    assert media.feature(info) == f"192x8;frames={len(frames)};shots={shots};hist={'/'.join(map(str, bins))}"


def test_damaged_rows_do_not_end_the_job(spark):
    good, long = media.write_avi([media.padded(b"abc" * 1000), media.padded(b"x" * 400_000)])
    df = spark.createDataFrame([(1, bytearray(good), "a"), (2, bytearray(good[:300]), "b"), (3, None, "c"), (4, bytearray(b"no file"), "d"), (5, bytearray(long), "e")], "doc_id long, media binary, error string")
    rows = {r.doc_id: r for r in media.described(df).collect()}
    assert rows[1].error is None and rows[1].payload_bytes == 3072 and rows[5].payload_bytes == 400_128
    assert rows[2].error and rows[2].payload_bytes is None and rows[2].media_bytes == 300 and rows[4].error and rows[3].error is None
    assert {r.doc_id for r in media.clip_rows(df).collect()} == {1, 5} and media.described(df.limit(0)).count() == 0


def test_shots():
    dark, light = np.full((6, 192 * 8), 10, np.uint8), np.full((5, 192 * 8), 240, np.uint8)
    frames = np.vstack([dark, light, dark])
    assert media.cuts(frames) == [0, 6, 11]
    (f,) = media.write_avi([frames.tobytes()])
    (info,) = media.read_avi([f])
    assert media.clips(info) == [(0, 6, 0, 240000), (6, 5, 240000, 440000), (11, 6, 440000, 680000)] and media.cuts(frames[:0]) == []


def test_rows(spark):
    df = spark.createDataFrame([(1, "aé" * 900, 1), (2, None, 2), (3, "", 3), (4, "aé" * 900, 4)], "doc_id long, text string, media int")
    files = media.stored(df)
    rows = {r.doc_id: r for r in media.described(files, keep=["n_bytes"]).collect()}
    want = media.padded(("aé" * 900).encode())
    assert rows[1].n_bytes == 2700 and rows[1].payload_bytes == len(want) and rows[1].payload_sha256 == hashlib.sha256(want).hexdigest() and rows[1].tail_crc32 == zlib.crc32(want[-16:])
    assert rows[2].payload_bytes == rows[3].payload_bytes == 192 and rows[1].media_sha256 == rows[4].media_sha256 and rows[1].feature == rows[4].feature
    assert media.clip_rows(files).where("doc_id = 1").first().first_frame == 0
    nulls = media.described(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first()
    assert nulls.payload_bytes is None and media.stored(df.limit(0)).count() == 0
