"""Byte-level BPE as a monoid: a text's encoding is the product of the encodings of its halves.

``encode`` splits a text in the middle until a leaf has LEAF characters or fewer, encodes leaves
directly, and joins neighbours. A join re-encodes a window round the seam and keeps the tokens
outside it. The window's ends must be places where the pattern always has a boundary, whatever
stands farther away; such places are provable from the characters on both sides (``is_seam``), and
both halves then have a token boundary there too. If a window finds none it grows, up to the whole
node. The join is associative, so any tree over a text's pieces gives the same ids, and the ids are
those of one left-to-right encoding. Decoding concatenates the bytes up the same tree.

Spark deals the texts out; a text is never cut or shortened, and a task holds one slice of texts.
Null and empty texts have no ids. The vocabulary file's path is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corollary.llm.common import map_rows

LEAF = 4096
WINDOW = 32


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Codec:
    """A rank file with its pattern: leaf encoder, byte table and the seam test."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.leaf = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        size = max(ranks.values()) + 1
        self.bytes, self.size, self.decimal = [b""] * size, [0] * size, [""] * size
        for token, rank in ranks.items():
            self.bytes[rank], self.size[rank], self.decimal[rank] = token, len(token), str(rank)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=4096)
def _kind(c: str) -> str:
    """L letter, N number, S white space, P the rest, as the pattern has them."""
    if c.isspace():
        return "?" if "\x1c" <= c <= "\x1f" else "S"
    k = unicodedata.category(c)
    return k[0] if k[0] in "LN" else "?" if k == "Cn" else "P"


def is_seam(before: str, after: str) -> bool:
    """Whether the pattern has a boundary between two neighbouring characters in every text.

    No match holds white space after anything else, and none goes on from a letter or a number to a
    character of another kind (a contraction ends in letters). Characters on whose kind Unicode
    versions may differ are never seams."""
    a, b = _kind(before), _kind(after)
    if "?" in (a, b):
        return False
    return (b == "S" and a != "S") or (a in "LN" and b != a)


def _tail(ids: list[int], nbytes: int, size: list[int]) -> int:
    """How many tokens at the end of ids have nbytes bytes; -1 if none do."""
    n = 0
    while nbytes > 0:
        n += 1
        nbytes -= size[ids[-n]]
    return n if nbytes == 0 else -1


def _head(ids: list[int], nbytes: int, size: list[int]) -> int:
    n = 0
    while nbytes > 0:
        nbytes -= size[ids[n]]
        n += 1
    return n if nbytes == 0 else -1


def _seam_left(text: str, low: int, high: int) -> int | None:
    """The last seam in low < i < high."""
    for i in range(high - 1, low, -1):
        if is_seam(text[i - 1], text[i]):
            return i
    return None


def _seam_right(text: str, low: int, high: int) -> int | None:
    for i in range(low + 1, high):
        if is_seam(text[i - 1], text[i]):
            return i
    return None


def join(text: str, start: int, middle: int, end: int, left: list[int], right: list[int], c: Codec) -> list[int]:
    """The ids of text[start:end] from those of its two parts."""
    if start == middle or middle == end:
        return left or right
    if is_seam(text[middle - 1], text[middle]):
        return left + right  # the window is empty: nothing crosses
    width = WINDOW
    while True:
        a = start if middle - width <= start else _seam_left(text, middle - width, middle)
        b = end if middle + width >= end else _seam_right(text, middle, middle + width)
        if a is not None and b is not None:
            cut, skip = _tail(left, len(text[a:middle].encode()), c.size), _head(right, len(text[middle:b].encode()), c.size)
            if cut >= 0 and skip >= 0:
                return left[: len(left) - cut] + c.leaf(text[a:b]) + right[skip:]
        if middle - width <= start and middle + width >= end:
            return c.leaf(text[start:end])
        width *= 4


def encode(text: str | None, c: Codec, leaf: int = LEAF) -> list[int]:
    def node(start: int, end: int) -> list[int]:
        if end - start <= leaf:
            return c.leaf(text[start:end])
        middle = (start + end) // 2
        return join(text, start, middle, end, node(start, middle), node(middle, end), c)

    return node(0, len(text)) if text else []


def decode(ids: list[int], c: Codec, leaf: int = LEAF) -> bytes:
    """Concatenation up the tree over the ids."""
    if len(ids) <= leaf:
        return b"".join(map(c.bytes.__getitem__, ids))
    half = len(ids) // 2
    return decode(ids[:half], c, leaf) + decode(ids[half:], c, leaf)


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: id and the ids of its text."""
    path = path or default_path()

    def rows(keys, texts):
        c = codec(path)
        return {id_col: keys, "ids": [encode(t, c) for t in texts]}

    return map_rows(df.withColumn(id_col, F.col(id_col).cast("long")), [id_col, text_col], f"{id_col} long,ids array<int>", rows, by=text_col)


def decoded(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """One row per input row: id, the number of ids, a digest of the ids in decimal, and the bytes."""
    path = path or default_path()

    def rows(keys, ids):
        c = codec(path)
        digests = [hashlib.sha256(",".join(map(c.decimal.__getitem__, x)).encode()).hexdigest() for x in ids]
        return {id_col: keys, "n_tokens": [len(x) for x in ids], "ids_sha256": digests, "bytes": [decode(x, c) for x in ids]}

    return map_rows(df, [id_col, ids_col], f"{id_col} long,n_tokens long,ids_sha256 string,bytes binary", rows)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode, then decode, in one pass over the texts: id, n_tokens, ids_sha256, bytes."""
    path = path or default_path()

    def rows(keys, texts):
        c = codec(path)
        ids = [encode(t, c) for t in texts]
        digests = [hashlib.sha256(",".join(map(c.decimal.__getitem__, x)).encode()).hexdigest() for x in ids]
        return {id_col: keys, "n_tokens": [len(x) for x in ids], "ids_sha256": digests, "bytes": [decode(x, c) for x in ids]}

    return map_rows(df.withColumn(id_col, F.col(id_col).cast("long")), [id_col, text_col], f"{id_col} long,n_tokens long,ids_sha256 string,bytes binary", rows, by=text_col)
