"""Media columns: AVI files of motion JPEG as binary values, decoded into timed clips.

A file is RIFF: header lists, a ``movi`` list with one JPEG image per frame and an ``idx1`` index
with each frame's place. Frames here are lossless JPEG (ITU T.81, process 14: SOF3, predictor 1,
8-bit samples, Huffman coded differences), so a payload written as samples is read back bit by bit.
A frame must have the size that the file's header tells, and a bit of data for each sample at least: so no
damaged size makes a reader allocate or decode more than the file's bytes stand for. Decoding works on all frames of many files at once: every numpy step advances each frame's bit
stream by one sample, so the cost is a few vector operations per sample of the *longest* frame.

Shots: each frame has a histogram of BINS bins; the difference of neighbours is compared with an
adaptive threshold, the mean of the last SPAN differences plus FACTOR times their mean deviation and
FLOOR. A cut starts a new clip; clips carry their first frame, number of frames and times.

Null and empty payloads become one unit of padding. Values are whole: nothing is cut or sampled.
Bytes that are no such AVI file raise ValueError in ``read_avi``; in columns they give a row with an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corollary.llm.common import map_rows

UNIT = 192  # a row of samples
ROWS = 8  # rows of a frame, fewer if the payload has fewer
FPS = 25
BINS, SPAN, FACTOR, FLOOR = 16, 8, 3.0, 0.05
#: A frame with more samples than this is taken for damaged.
LARGEST = 1 << 26
#: Files are handled in groups of about this many samples.
GROUP = 3_000_000

#: Huffman code of the difference categories 0..8 (counts of codes by length 1..16, then symbols):
#: text has mostly differences of 4 to 6 bits.
LENGTHS = {5: 2, 6: 2, 4: 3, 3: 3, 0: 4, 7: 4, 2: 5, 1: 6, 8: 7}


def _table() -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """DHT payload, code and length by category, and category and total length by 16-bit prefix."""
    symbols = sorted(LENGTHS, key=lambda s: LENGTHS[s])  # stable: canonical order
    counts = [sum(n == k for n in LENGTHS.values()) for k in range(1, 17)]
    code, last, codes = 0, 0, np.zeros(9, np.int64)
    for s in symbols:
        code <<= LENGTHS[s] - last
        last = LENGTHS[s]
        codes[s] = code
        code += 1
    lengths = np.array([LENGTHS[s] for s in range(9)])
    return bytes([0, *counts, *symbols]), codes, lengths, *_lookup(counts, symbols)


def _lookup(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    category, length = np.full(1 << 16, 255, np.uint8), np.zeros(1 << 16, np.uint8)
    code, at = 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            low = code << (16 - bits)
            category[low : low + (1 << (16 - bits))] = symbols[at]
            length[low : low + (1 << (16 - bits))] = bits
            code, at = code + 1, at + 1
        code <<= 1
    return category, length


DHT, CODES, CODE_BITS, CATEGORY, PREFIX_BITS = _table()
_DIFF = np.arange(-255, 256)
_CAT = np.array([abs(int(d)).bit_length() for d in _DIFF])
#: For each difference + 255: all its bits (code, then value), and how many.
_BITS = np.array([(int(CODES[c]) << int(c)) | (int(d) if d >= 0 else int(d) + (1 << int(c)) - 1) for d, c in zip(_DIFF, _CAT)], dtype=np.uint32)
_NBITS = np.array([int(CODE_BITS[c]) + int(c) for c in _CAT], dtype=np.int64)


# ---- writing ------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(height: int, width: int) -> bytes:
    return b"\xff\xd8" + _segment(0xC3, struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0)) + _segment(0xC4, DHT) + _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))


def _scans(frames: np.ndarray, height: int) -> list[bytes]:
    """The entropy-coded data of frames (one row each, height x UNIT samples)."""
    n = len(frames)
    x = frames.reshape(n, height, UNIT).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    d = d.reshape(n, -1) + 255
    bits, count = _BITS[d], _NBITS[d]
    total = count.sum(axis=1)
    pad = -total % 8
    bits = np.concatenate([bits, ((1 << pad) - 1).astype(np.uint32)[:, None]], axis=1).ravel()
    count = np.concatenate([count, pad[:, None]], axis=1).ravel()
    # codes have under 32 bits, so a code that starts in a 32-bit word ends in it or in the next,
    # and some code starts in each word
    at = np.cumsum(count) - count
    word = at >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    both = np.add.reduceat(bits.astype(np.uint64) << (64 - (at & 31) - count).astype(np.uint64) % np.uint64(64), first)
    words = np.append(both >> np.uint64(32), np.uint64(0))
    words[1:] += both & np.uint64(0xFFFFFFFF)
    stream = np.frombuffer(words.astype(">u4").tobytes(), np.uint8)[: int(total.sum() + pad.sum()) // 8]
    ends = np.cumsum((total + pad) // 8)
    # after each FF comes a stuffed 00
    full = stream == 255
    ends += np.concatenate([[0], np.cumsum(full)])[ends]
    stuffed = np.zeros(len(stream) + int(full.sum()), np.uint8)
    stuffed[np.arange(len(stream)) + np.concatenate([[0], np.cumsum(full)[:-1]])] = stream
    data = stuffed.tobytes()
    return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _avi(jpegs: list[bytes], height: int, length: int) -> bytes:
    """length: the payload's samples; the last frame may hold more."""
    n, largest = len(jpegs), max(map(len, jpegs))
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, UNIT, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, UNIT, height)
    form = struct.pack("<IiiHH4sIiiII", 40, UNIT, height, 1, 8, b"MJPG", UNIT * height, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"samples=%d\0" % length))
    places, at, body = [], 4, []
    for j in jpegs:
        body.append(_chunk(b"00dc", j))
        places.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(j)))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + head + info + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(places)))


def padded(data: bytes) -> bytes:
    """data with bytes 32 up to a positive multiple of UNIT."""
    return data + b" " * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def write_avi(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, whose length is a positive multiple of UNIT."""
    heights = [min(ROWS, len(p) // UNIT) for p in payloads]
    scans: dict[int, list[bytes]] = {}
    counts = []
    frames: dict[int, list[bytes]] = {}
    for p, h in zip(payloads, heights):
        size = h * UNIT
        n = -(-len(p) // size)
        counts.append(n)
        frames.setdefault(h, []).append(p + b" " * (n * size - len(p)))
    for h, parts in frames.items():
        data = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, h * UNIT)
        step = max(1, 200_000 // (h * UNIT))
        scans[h] = [s for i in range(0, len(data), step) for s in _scans(data[i : i + step], h)]
    at = dict.fromkeys(scans, 0)
    out = []
    for p, h, n in zip(payloads, heights, counts):
        head = _jpeg_head(h, UNIT)
        out.append(_avi([head + s + b"\xff\xd9" for s in scans[h][at[h] : at[h] + n]], h, len(p)))
        at[h] += n
    return out


# ---- reading ------------------------------------------------------------------------------------


def _chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """kind, start and end of each chunk's body; a list's kind is LIST and its type."""
    while start + 8 <= end:
        kind, n = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        if start + 8 + n > end:
            raise ValueError("a chunk ends beyond its list")
        if kind in (b"LIST", b"RIFF"):
            yield kind + data[start + 8 : start + 12], start + 12, start + 8 + n
        else:
            yield kind, start + 8, start + 8 + n
        start += 8 + n + (n & 1)


def read_index(data: bytes) -> dict:
    """The index of an AVI file: frames as (start, end), microseconds of a frame, samples (or None), and the
    frames' size as the header tells it."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found = {k: (a, b) for k, a, b in _chunks(data, 12, len(data))}
    if not {b"LISThdrl", b"LISTmovi", b"idx1"} <= found.keys():
        raise ValueError("an AVI file without header, frames or index")
    head = {k: (a, b) for k, a, b in _chunks(data, *found[b"LISThdrl"])}
    period = struct.unpack_from("<I", data, head[b"avih"][0])[0]
    samples = None
    if b"LISTINFO" in found:
        info = {k: data[a:b] for k, a, b in _chunks(data, *found[b"LISTINFO"])}
        if info.get(b"ICMT", b"").startswith(b"samples="):
            samples = int(info[b"ICMT"][8:].rstrip(b"\0"))
    base = found[b"LISTmovi"][0] - 4  # places count from the list's type
    a, b = found[b"idx1"]
    frames = []
    for kind, _, at, n in struct.iter_unpack("<4sIII", data[a:b]):
        if kind[2:] in (b"dc", b"db"):
            if data[base + at : base + at + 4] != kind:
                raise ValueError("the index names a place without a frame")
            frames.append((base + at + 8, base + at + 8 + n))
    if b"LISTstrl" not in head:
        raise ValueError("an AVI file without a stream")
    form = {k: a for k, a, _ in _chunks(data, *head[b"LISTstrl"])}[b"strf"]
    width, height = struct.unpack_from("<ii", data, form + 4)
    return {"frames": frames, "period": period, "samples": samples, "told": (abs(height), width)}


def read_jpeg(data: bytes, start: int, end: int) -> tuple[int, int, bytes, int, int]:
    """height, width, Huffman table, start and end of the scan of a lossless JPEG."""
    if data[start : start + 2] != b"\xff\xd8":
        raise ValueError("a frame that is no JPEG")
    at, size, table = start + 2, None, None
    while True:
        if data[at] != 0xFF or at + 4 > end:
            raise ValueError("a damaged JPEG")
        marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = at + 4
        if marker == 0xC3:
            precision, height, width, parts = struct.unpack_from(">BHHB", data, body)
            if precision != 8 or parts != 1:
                raise ValueError("only 8-bit frames of one component are read")
            size = height, width
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only lossless frames (SOF3) are read")
        elif marker == 0xC4:
            table = data[body : body + n - 2]
        elif marker == 0xDA:
            if data[body + n - 5] != 1:
                raise ValueError("only predictor 1 is read")
            stop = data.rfind(b"\xff\xd9", body, end)
            return *size, table, at + 2 + n, stop if stop >= 0 else end
        at += 2 + n


def _decode(scans: list[bytes], height: int, width: int, category: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The samples of frames, one row each, and whether each stream held them; all frames' streams
    advance together. A damaged stream runs into the next ones, or into the zeros behind all."""
    data = b"".join(s + b"\0\0\0\0" for s in scans) + bytes(height * width * 4 + 8)
    raw = np.frombuffer(data, np.uint8)
    sizes = np.array([len(s) + 4 for s in scans])
    ends = np.cumsum(sizes)
    holes = bool((category == 255).any())  # prefixes that are no code
    keep = np.ones(len(raw), bool)
    keep[1:] = ~((raw[:-1] == 255) & (raw[1:] == 0))
    starts = np.concatenate([[0], ends[:-1]])
    stuffed = np.concatenate([[0], np.cumsum(~keep)])
    starts, limit = starts - stuffed[starts], (ends - 4 - stuffed[ends - 4]) * 8
    good = np.ones(len(scans), bool)
    b = raw[keep].astype(np.uint32)
    # the 32 bits from each byte on: a code of up to 16 bits and its value fit behind 7 bits
    word = (b << 24) | (np.append(b[1:], 0).astype(np.uint32) << 16) | (np.append(b[2:], [0, 0]).astype(np.uint32) << 8) | np.append(b[3:], [0, 0, 0]).astype(np.uint32)
    at = starts.astype(np.int64) * 8
    n = height * width
    diffs = np.empty((n, len(scans)), np.int16)
    # by 16-bit prefix: category in the low byte, code bits in the high byte
    fused = category.astype(np.int64) | (prefix.astype(np.int64) << 8)
    ones = (1 << np.arange(17, dtype=np.int64)) - 1
    half = np.concatenate([[0], 1 << np.arange(16, dtype=np.int64)])
    for i in range(n):
        w = word[at >> 3].astype(np.int64) << (at & 7) & 0xFFFFFFFF
        f = fused[w >> 16]
        c, p = f & 255, f >> 8
        if holes:
            good &= c <= 16
            c = np.minimum(c, 16)
        v = (w >> (32 - p - c)) & ones[c]
        diffs[i] = np.where(v < half[c], v - ones[c], v)
        at += p + c
    d = diffs.T.reshape(len(scans), height, width).astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)  # a row's first sample follows the one above
    return (np.cumsum(d, axis=2) & 0xFF).astype(np.uint8).reshape(len(scans), n), good & (at <= limit)


def _frames_of(data: bytes) -> tuple[dict, list[tuple[int, int, bytes, bytes]]]:
    """A file's index, and height, width, Huffman table and scan of each frame."""
    try:
        info, frames = read_index(data), []
        for a, b in info["frames"]:
            height, width, table, start, stop = read_jpeg(data, a, b)
            if frames and (height, width) != info["size"]:
                raise ValueError("frames of two sizes")
            if (height, width) != info["told"]:
                raise ValueError("a frame of another size than its file tells")
            if height * width > 8 * (stop - start):  # a sample takes a bit at least
                raise ValueError("a frame with less data than samples")
            if not height or not width or height * width > LARGEST or table is None or len(table) < 17 + sum(table[1:17]) or sum(n << (16 - k) for k, n in enumerate(table[1:17], 1)) > 1 << 16 or max(table[17 : 17 + sum(table[1:17])], default=0) > 16:
                raise ValueError("a frame without samples, or with a wrong Huffman table")
            info["size"] = height, width
            frames.append((height, width, table, data[start:stop]))
    except (IndexError, KeyError, TypeError, struct.error) as e:
        raise ValueError(f"a damaged AVI file: {e}") from e
    return info, frames


def read_avi(files: list[bytes], strict: bool = True) -> list[dict]:
    """For each file its index, the decoded frames (one row of samples each), height and width. A file
    that is damaged raises ValueError, or has an ``error`` only if not strict."""
    out: list[dict] = []
    groups: dict[tuple, list] = {}
    for i, data in enumerate(files):
        try:
            info, frames = _frames_of(data)
        except ValueError as e:
            if strict:
                raise
            out.append({"error": str(e)})
            continue
        h, w = info.setdefault("size", (0, 0))
        info["samples_of"] = np.empty((len(frames), h * w), np.uint8)
        out.append(info)
        for k, (height, width, table, scan) in enumerate(frames):
            groups.setdefault((height, width, table), []).append((i, k, scan))
    for (height, width, table), members in groups.items():
        counts = list(table[1:17])
        got, good = _decode([m[2] for m in members], height, width, *_lookup(counts, list(table[17 : 17 + sum(counts)])))
        for (i, k, _), row, ok in zip(members, got, good.tolist()):
            if ok:
                out[i]["samples_of"][k] = row
            elif strict:
                raise ValueError("a frame whose samples do not end where its scan does")
            else:
                out[i]["error"] = "a frame whose samples do not end where its scan does"
    return out


def payload_of(info: dict) -> bytes:
    data = info["samples_of"].tobytes()
    return data if info["samples"] is None else data[: info["samples"]]


# ---- shots --------------------------------------------------------------------------------------


def cuts(frames: np.ndarray) -> list[int]:
    """The frames that start a shot, 0 first (none if there are no frames)."""
    if not len(frames):
        return []
    n, size = frames.shape
    flat = np.bincount(((np.arange(n) * BINS)[:, None] + (frames >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(flat, axis=0)).sum(axis=1) / (2 * size)
    out, recent = [0], []
    for i, d in enumerate(diff.tolist(), 1):
        if recent:
            mean = sum(recent) / len(recent)
            spread = sum(abs(r - mean) for r in recent) / len(recent)
            if d > mean + FACTOR * spread + FLOOR:
                out.append(i)
        recent = [*recent, d][-SPAN:]
    return out


def clips(info: dict) -> list[tuple[int, int, int, int]]:
    """(first frame, frames, start and end in microseconds) of each shot."""
    n = len(info["frames"])
    first = cuts(info["samples_of"])
    return [(a, b - a, a * info["period"], b * info["period"]) for a, b in zip(first, [*first[1:], n])]


def feature(info: dict) -> str:
    """Size, shots and a coarse histogram, as text."""
    h, w = info["size"]
    bins = np.bincount(info["samples_of"].ravel() >> 5, minlength=8).tolist()
    return f"{w}x{h};frames={len(info['frames'])};shots={'/'.join(f'{a}+{n}@{t}' for a, n, t, _ in clips(info))};hist={'/'.join(map(str, bins))}"


# ---- columns ------------------------------------------------------------------------------------


def _grouped(values: list[bytes]) -> Iterator[slice]:
    start, total = 0, 0
    for i, v in enumerate(values):
        if total and total + len(v) > GROUP:
            yield slice(start, i)
            start, total = i, 0
        total += len(v)
    if values:
        yield slice(start, len(values))


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as an AVI file: id, n_bytes, media."""

    def rows(keys, texts):
        data = [(t or "").encode() for t in texts]
        media = [m for s in _grouped(data) for m in write_avi([padded(d) for d in data[s]])]
        return {id_col: keys, "n_bytes": [len(d) for d in data], "media": media}

    return map_rows(df.withColumn(id_col, F.col(id_col).cast("long")), [id_col, text_col], f"{id_col} long,n_bytes long,media binary", rows, by=text_col)


def described(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: list[str] = ()) -> DataFrame:
    """What a media column's files hold: id, the long columns in ``keep``, the payload's size, SHA-256
    and CRC-32 of its last 16 bytes, the file's size and SHA-256, and the feature string. A null
    value gives nulls; a damaged file its size, SHA-256 and what is wrong as ``error``."""

    def rows(keys, media, *more):
        out = {k: [None] * len(keys) for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")}
        there = [i for i, m in enumerate(media) if m is not None]
        for s in _grouped([media[i] for i in there]):
            for i, info in zip(there[s], read_avi([media[j] for j in there[s]], strict=False)):
                out["media_bytes"][i], out["media_sha256"][i] = len(media[i]), hashlib.sha256(media[i]).hexdigest()
                if error := info.get("error"):
                    out["error"][i] = error
                    continue
                p = payload_of(info)
                for k, v in (("payload_bytes", len(p)), ("payload_sha256", hashlib.sha256(p).hexdigest()), ("tail_crc32", zlib.crc32(p[-16:])), ("feature", feature(info))):
                    out[k][i] = v
        return {id_col: keys, **dict(zip(keep, more)), **out}

    return map_rows(df, [id_col, media_col, *keep], f"{id_col} long,{''.join(f'{c} long,' for c in keep)}payload_bytes long,payload_sha256 string,tail_crc32 long,media_bytes long,media_sha256 string,feature string,error string", rows, by=media_col)


def clip_rows(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each shot of each file: id, clip, first_frame, frames, start_us, end_us. Damaged files
    have none (``described`` names them)."""

    def rows(keys, media):
        out = {k: [] for k in (id_col, "clip", "first_frame", "frames", "start_us", "end_us")}
        there = [i for i, m in enumerate(media) if m is not None]
        for s in _grouped([media[i] for i in there]):
            for i, info in zip(there[s], read_avi([media[j] for j in there[s]], strict=False)):
                for n, (a, count, t, u) in enumerate(clips(info) if "error" not in info else ()):
                    for k, v in zip(out, (keys[i], n, a, count, t, u)):
                        out[k].append(v)
        return out

    return map_rows(df, [id_col, media_col], f"{id_col} long,clip int,first_frame int,frames int,start_us long,end_us long", rows, by=media_col)
