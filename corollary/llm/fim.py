"""Fill-in-the-middle: texts cut in three at word boundaries and put together in another order.

A text's units are the words with the white space before them, ``WS* NONWS+``, and white space at its end,
``WS+``, where WS is ``[\\x20\\x09-\\x0D]``. The Split pre-tokenizer of the tokenizers library isolates each
match of that pattern and tells its code-point offsets; nothing is trained. The number of offsets is n, and
the offsets at the two ranks that the document's draws name are the cuts. Only the three numbers leave
Python: draws (SHA-256 of seed and id), forms, outputs and the way back are column expressions.

Long texts go through the pre-tokenizer in pieces that end where a unit ends, so a task holds one batch of
texts and the offsets of one piece.

A null text counts as empty; empty texts, those that hold a sentinel and those that are not drawn stay plain
(their cuts are null). A null id is drawn as the empty text. Rows with the same id are drawn alike, each row
is cut by its own text, and repeated rows give repeated rows. An empty table gives no rows. Columns of the
table stay, unless they bear the name of a result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units; the first run is possessive: it never gives back, so a long run of white space is read once.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Characters that the pre-tokenizer is handed at a time, about.
PIECE = 1 << 16
_END = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")


@cache
def _splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(UNIT), "isolated")


def _pieces(text: str, size: int) -> Iterator[tuple[int, str]]:
    """(place, piece): the text in pieces of about size code points, cut only between units."""
    at = 0
    while at < len(text):
        end = _END.search(text, at + size) if len(text) - at > size else None
        to = end.start() if end else len(text)
        yield at, text[at:to]
        at = to


def cuts(text: str, first: int, second: int, size: int = PIECE) -> tuple[int, int, int]:
    """n, and the code points before the smaller and the larger of first % (n + 1) and second % (n + 1)
    units. Counted in one pass; in a second one only the pieces that hold the two ranks are read again."""
    counts, places = [], []
    spans: list = []
    for at, piece in _pieces(text, size):
        spans = _splitter().pre_tokenize_str(piece)
        counts.append((counts[-1] if counts else 0) + len(spans))
        places.append(at)
    n = counts[-1] if counts else 0

    def start(rank: int) -> int:
        if rank == n:
            return len(text)
        k = bisect_left(counts, rank + 1)
        last = k == len(counts) - 1
        to = len(text) if last else places[k + 1]
        own = spans if last else _splitter().pre_tokenize_str(text[places[k] : to])
        return places[k] + own[rank - (counts[k - 1] if k else 0)][1][0]

    a, b = sorted((first % (n + 1), second % (n + 1)))
    return n, start(a), start(b)


def _cuts_of(size: int):
    kind = StructType([StructField(name, LongType()) for name in ("n", "a", "b")])

    @F.pandas_udf(kind)
    def cut(text: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cuts(*row, size) for row in zip(text, first, second)], columns=["n", "a", "b"])

    return cut


def draw(seed: int, id_col: str, k: int) -> Column:
    """The k-th (from 1) of eight draws of 32 bits of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transformed(df: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """The table's columns with n, form (plain, psm, spm), prefix_chars, middle_chars and output. ``percent`` of
    the documents are cut, ``spm_percent`` of those have the suffix first."""
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in names))
    text = F.coalesce(F.col(text_col), F.lit(""))
    got = df.select(row.alias("row"), text.alias("text"), *(draw(seed, id_col, k).alias(f"h{k}") for k in (1, 2, 3, 4)))
    got = got.withColumn("cut", _cuts_of(piece)("text", "h1", "h2"))
    text, a, b = F.col("text"), F.col("cut.a"), F.col("cut.b")
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (F.col("h3") % 100 >= percent)
    got = got.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    cut = lambda c: F.when(F.col("form") != "plain", c)
    prefix, middle = F.substring(text, F.lit(1), a.cast("int")), F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    suffix = F.substring(text, (b + 1).cast("int"), F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm)
    return got.select("row.*", F.col("cut.n").alias("n"), "form", cut(a).alias("prefix_chars"), cut(b - a).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone. A cut text holds no sentinel, so the first of each kind is the
    one that was put there."""
    rest = F.substring(output, F.lit(4), F.length(output))
    inner = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    two = F.split(rest, inner, 2)
    first, tail = two[0], F.split(two[1], MIDDLE, 2)
    second, middle = tail[0], tail[1]
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))
