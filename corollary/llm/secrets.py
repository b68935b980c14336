"""Secrets: rules, and sliding-window entropy over candidate strings.

* base rules: ``assign`` (a keyword, then : or =, then a value of 8 characters or more), ``access``
  (AKIA..., 16 or more), ``hex`` (32 or more), leftmost and non-overlapping per kind;
* the method: over each candidate string (a run of key characters, MIN_LENGTH or longer) a window of
  WINDOW characters slides; for each character class (lower case, upper case, digits, other) the
  counts of its characters are kept incrementally, and with them the Shannon entropy of the class
  and of the window. A window whose total entropy is high and in which two classes each have enough
  entropy of their own is hot; a candidate with a hot window is a span of kind ``entropy``, whole. Of a candidate the
  parts that no base span covers count, each for itself. Those that fit the allow-list (paths, plain
  words, UUIDs, version and date strings, repeated units, ...) are suppressed; words are of one case
  or of capitalised pieces. Base spans always stay.

Null and empty texts have no spans; texts are never cut; equal texts have equal spans.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corollary.llm.common import Covered, map_rows

KINDS = ("assign", "access", "hex", "entropy")
WINDOW, MIN_LENGTH, TOTAL_BITS, CLASS_BITS = 20, 20, 3.6, 1.0

_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CUE = re.compile(r"[:=]")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
#: Shapes that are no secrets.
ALLOWED = tuple(re.compile(p) for p in (
    r"[A-Za-z]+(?:[_/-][A-Za-z]+)*",  # words joined by separators
    r"[0-9]+(?:[-_/][0-9]+)*",  # numbers, dates
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"[=_+/-]+",  # rules
    r"[_/-]*(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,4})(?:[_/-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,4}))*[_/-]*",  # paths and identifiers with short numbers
))
#: Of these, the ones of letters, which must be words.
OF_WORDS = (ALLOWED[0], ALLOWED[-1])
_LETTERS = re.compile(r"[A-Za-z]+")
#: One case, or capitalised pieces; an abbreviation may stand before or after them.
_WORD = re.compile(r"[a-z]+|[A-Z]+|(?:[A-Z]{1,4}(?=[A-Z][a-z]))?[a-z]*(?:[A-Z][a-z]+)*[A-Z]{0,5}")

Span = tuple[str, int, int]


def base_spans(text: str | None) -> list[Span]:
    """By start, then by kind as listed."""
    if not text:
        return []
    out = []
    if _CUE.search(text):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # a match of [0-9a-f]+ is a whole run, so the runs of 32 or more are the matches that pass
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def char_class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


_XLOG = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def hot_windows(s: str, width: int = WINDOW) -> list[tuple[int, float]]:
    """Start and entropy of each window of s that looks random. A step changes two counts: with
    n log n summed over the counts of a class, its entropy is log n - sum / n."""
    counts: dict[str, int] = {}
    size, total = [0, 0, 0, 0], [0.0, 0.0, 0.0, 0.0]

    def change(c: str, by: int) -> None:
        k, n = char_class(c), counts.get(c, 0)
        total[k] += _XLOG[n + by] - _XLOG[n]
        size[k] += by
        counts[c] = n + by

    out = []
    for i, c in enumerate(s):
        change(c, 1)
        if i >= width:
            change(s[i - width], -1)
        if i >= width - 1:
            whole = math.log2(width) - sum(total) / width
            rich = sum(n >= 3 and math.log2(n) - t / n >= CLASS_BITS for n, t in zip(size[:3], total))
            if whole >= TOTAL_BITS and rich >= 2:
                out.append((i - width + 1, whole))
    return out


def allowed(s: str) -> bool:
    for p in ALLOWED:
        if p.fullmatch(s) and (p not in OF_WORDS or all(_WORD.fullmatch(w) for w in _LETTERS.findall(s))):
            return True
    period = (s + s).find(s, 1)
    return period < len(s)  # a repeated unit


def entropy_spans(text: str | None, base: list[Span]) -> list[Span]:
    if not text:
        return []
    out, covered = [], Covered((a, b) for _, a, b in base)
    for m in _CANDIDATE.finditer(text):
        for at, end in covered.gaps(m.start(), m.end()):
            if end - at < MIN_LENGTH or allowed(text[at:end]):
                continue
            if hot_windows(text[at:end]):  # a window tells that there is a secret, the candidate where it ends
                out.append((at, end))
    return [("entropy", a, b) for a, b in out]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts of base spans by kind, base_spans and spans as text."""

    def rows(ids, texts):
        base = [base_spans(t) for t in texts]
        every = [sorted([*b, *entropy_spans(t, b)], key=lambda s: (s[1], KINDS.index(s[0]))) for t, b in zip(texts, base)]
        return {id_col: ids, **{f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in KINDS[:3]}, "base_spans": [joined(b) for b in base], "spans": [joined(s) for s in every]}

    return map_rows(df.withColumn(id_col, F.col(id_col).cast("long")), [id_col, text_col], f"{id_col} long,n_assign long,n_access long,n_hex long,base_spans string,spans string", rows, by=text_col)
