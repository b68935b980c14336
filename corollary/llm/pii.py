"""Personal data: candidates scored by gradient boosting.

Two layers find spans of a text (code points, end exclusive):

* base rules: email, IP address, payment card, phone number, leftmost and non-overlapping per kind;
  what matches a rule's pattern but fails its check (parts over 255, Luhn, digit count) is dropped;
* the method: high-recall generators propose overlapping candidates (numbers with any separators,
  anything round an @ or a spelled-out "at"), boosted trees score each from its format and context,
  the scores are calibrated on held-out candidates, and a threshold per kind chosen for precision there
  selects spans that no base span overlaps. Base spans always stay.

The trees are trained here on generated candidates (TRAIN_CANDIDATES of them, a fixed seed), so no
row of the corpus is a training row. Null and empty texts have no spans; a text is never cut; equal
texts have equal spans; columns other than those named are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corollary.llm.common import Covered, map_rows

KINDS = ("email", "ip", "card", "phone")
TRAIN_CANDIDATES = 6000
PRECISION = 0.995

# The patterns of the base rules, in forms that take linear time: an email is found from its "@"
# backwards, and a number is only tried from its first digit.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        # the run of local-part characters that ends at the @, in steps that double
        reach, start = 32, at
        while True:
            low = max(last, at - reach)
            tail = _LOCAL.match(text[low:at][::-1]).end()
            start = at - tail
            if start > low or low == last:
                break
            reach *= 4
        if start < at:
            out.append(("email", start, m.end()))
            last = m.end()
    return out


def base_spans(text: str | None) -> list[Span]:
    """The base rules' spans, by kind as listed in KINDS, then by start."""
    if not text:
        return []
    out = _emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---- candidates ---------------------------------------------------------------------------------

#: Addresses, also spelled out: a sign between local part and domain, the characters of a local part, a domain.
_SIGN = re.compile(r" ?(?:@|\(at\)|\[at\]| at ) ?")
_LOCAL_CHARACTERS = frozenset("_.+-")
_SPELLED_DOMAIN = re.compile(r"[\w-]++(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[\w-]++)++")
#: Generators of numbers: kind and pattern, with bounds on both sides, as such numbers have.
GENERATORS = (
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,4}(?:[.,][0-9]{1,4}){2,5}(?![\w])")),
    ("card", re.compile(r"(?<![\w.])[0-9]{3,6}(?:[ ./-]?[0-9]{2,6}){2,6}(?![\w])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+|00|\()?[0-9]{1,5}(?:[ ().\/-]{1,2}[0-9]{2,5}){1,5}(?![\w])")),
)
#: Words that come before personal data of each kind.
CUES = {"email": ("mail", "email", "e-mail", "contact", "write", "schreiben", "correo"), "ip": ("ip", "host", "address", "server", "from"), "card": ("card", "visa", "mastercard", "karte", "carte", "tarjeta", "pay"), "phone": ("tel", "phone", "call", "mobile", "fax", "fon", "llamar", "cell")}
#: Words that come before an "at" in prose, endings of domains.
PROSE = frozenset("a all an and are arrive arrived arrives available be been begin begins best both bought but buy close closed closes code details docs documents eat end ended ends few find first found free game good he held her here him hold hosted i information is it later laugh listed listen live lived lives look looked looking looks made me meet meeting meets met more much news not now one online only open opened opens or out page people posted priced published read run runs sat see seen sell set she shop shown sign sit site sits sold stand stands start started starts stay stayed stays stood stop stopped stops study that them there they this those time up us visit was we website were while work worked working works yet you".split())
ENDINGS = frozenset("ac at au be biz br ca ch cl cn co com cz de dk edu es eu fi fr gov ie info int io jp kr mil mx net nl nz org pl pt ro ru se uk us".split())
_LOCAL_PART = re.compile(r"[\w.+-]+")
FEATURES = ("kind_email", "kind_ip", "kind_card", "kind_phone", "length", "digits", "separators", "kinds_of_separator", "groups", "longest_group", "shortest_group", "luhn", "largest_part", "plus", "bracket", "letters", "last_label", "has_at", "spelled_at", "cue", "digit_near", "sentence_number", "date_like", "domain_ending", "prose_before_at", "marks_in_local")
_WORD_BEFORE = re.compile(r"([^\W\d_][\w-]*)\W*$")


def candidates(text: str) -> list[Span]:
    """Every generator's matches; they may overlap each other and the base spans."""
    out = []
    last = 0
    for m in _SIGN.finditer(text):
        if m.start() < last or not (domain := _SPELLED_DOMAIN.match(text, m.end())):
            continue
        start = m.start()
        while start > last and (text[start - 1].isalnum() or text[start - 1] in _LOCAL_CHARACTERS):
            start -= 1
        if start < m.start():
            out.append(("email", start, domain.end()))
            last = domain.end()
    if _DIGIT.search(text):
        for kind, pattern in GENERATORS:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    body, before, after = text[a:b], text[max(0, a - 24) : a], text[b : b + 8]
    digits = _NOT_DIGIT.sub("", body)
    groups = re.findall(r"[0-9]+", body)
    seps = re.findall(r"[^0-9A-Za-z]+", body)
    labels = re.split(r"\W+", body)
    word = _WORD_BEFORE.search(before)
    cue = bool(word) and word.group(1).lower() in CUES[kind]
    date = bool(re.fullmatch(r"(?:19|20)?[0-9]{2}([-/.])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([-/.])[01]?[0-9]\2(?:19|20)[0-9]{2}", body))
    local = _LOCAL_PART.match(body).group() if kind == "email" else ""
    return [
        *(float(kind == k) for k in KINDS), b - a, len(digits), len(seps), len(set(seps)), len(groups),
        max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(13 <= len(digits) <= 19 and luhn(digits)), max((int(g[:9]) for g in groups), default=0),
        float("+" in body), float("(" in body and ")" in body), sum(c.isalpha() for c in body),
        len(labels[-1]) if labels[-1].isalpha() else 0, float("@" in body), float(" at " in body or "(at)" in body or "[at]" in body),
        float(cue), float(bool(re.search(r"[0-9]\W*$", before[-3:])) or bool(re.match(r"\W*[0-9]", after[:3]))), float(bool(re.match(r"[%€$]|\s*(?:%|€|EUR|USD|km|kg)", after))), float(date),
        float(kind == "email" and labels[-1].lower() in ENDINGS), float(local.lower() in PROSE), float(bool(re.search(r"[\d_.+-]", local))),
    ]


# ---- boosted trees ------------------------------------------------------------------------------


class BoostedTrees:
    """Gradient boosting with the logistic loss: trees of a small depth over quantile cuts, each
    leaf a Newton step."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, least: int = 20):
        self.n, self.depth, self.rate, self.least = trees, depth, rate, least
        self.trees: list[dict] = []
        self.slope, self.offset, self.thresholds = 1.0, 0.0, np.full(len(KINDS), 0.5)

    def _grow(self, bins, g, h, rows, depth) -> dict:
        """bins: for each feature the number of cuts that a value is over. Sums of a node's gradients per
        feature and bin, one behind another, tell all splits at once."""
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = {"value": -total_g / (total_h + 1.0)}
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        wide = self.wide
        at = (bins[rows] + np.arange(bins.shape[1]) * wide).ravel()
        sums = lambda w: np.bincount(at, w, bins.shape[1] * wide).reshape(-1, wide).cumsum(axis=1)
        n = sums(None)
        gl, hl = sums(np.repeat(g[rows], bins.shape[1])), sums(np.repeat(h[rows], bins.shape[1]))
        gain = gl**2 / (hl + 1.0) + (total_g - gl) ** 2 / (total_h - hl + 1.0) - total_g**2 / (total_h + 1.0)
        gain = np.where((n >= self.least) & (n <= len(rows) - self.least), gain, -np.inf)
        j, c = divmod(int(gain.argmax()), wide)
        if gain[j, c] <= 1e-6:
            return leaf
        left = bins[rows, j] <= c
        return {"j": j, "cut": self.cuts[j][c], "yes": self._grow(bins, g, h, rows[left], depth - 1), "no": self._grow(bins, g, h, rows[~left], depth - 1)}

    def _value(self, tree, x) -> np.ndarray:
        if "value" in tree:
            return np.full(len(x), tree["value"])
        left = x[:, tree["j"]] <= tree["cut"]
        return np.where(left, self._value(tree["yes"], x), self._value(tree["no"], x))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, 12))) for j in range(x.shape[1])]
        self.wide = max(map(len, self.cuts)) + 1
        bins = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)], axis=1)
        f = np.zeros(len(y))
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(bins, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self.rate * self._value(tree, x)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.rate * sum(self._value(t, x) for t in self.trees)

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> BoostedTrees:
        """Platt scaling by Newton steps, then for each kind the lowest threshold that has the precision."""
        r = self.raw(x)
        a, b = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-(a * r + b)))
            w = p * (1 - p) + 1e-6
            grad = np.array([((p - y) * r).sum() + 1e-2 * (a - 1), (p - y).sum()])
            hess = np.array([[(w * r * r).sum() + 1e-2, (w * r).sum()], [(w * r).sum(), w.sum()]])
            a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
        self.slope, self.offset = float(a), float(b)
        p = self.predict(x)
        for k in range(len(KINDS)):  # the first features tell a candidate's kind
            mine = np.flatnonzero(x[:, k] == 1)
            order = mine[np.argsort(-p[mine], kind="stable")]
            hit = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
            good = np.flatnonzero(hit >= precision)
            # halfway to the first that would be one too many
            self.thresholds[k] = (p[order[good[-1]]] + p[order[min(good[-1] + 1, len(order) - 1)]]) / 2 if len(good) else 2.0
        return self

    def selects(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Which candidates are over their kind's threshold."""
        return p >= x[:, : len(KINDS)] @ self.thresholds

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.offset)))


_LETTERS, _PROSE, _NO_ENDINGS = (np.array(sorted(x)) for x in ("abcdefghilmnoprstuv", PROSE, PROSE - ENDINGS))


def _example(rng: np.random.Generator) -> tuple[str, str, bool]:
    """Text before a value, the value, and whether it is personal data."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(_LETTERS, rng.integers(3, 9)))
    kind = KINDS[rng.integers(4)]
    real = rng.random() < 0.5
    if real:
        before = str(rng.choice(CUES[kind])) + ": " if rng.random() < 0.4 else word() + " "
        if kind == "email":
            at = ["@", "(at)", "[at]", " (at) ", " [at] ", *[" at "] * 5][rng.integers(10)]
            dot = [" dot ", "(dot)", "[dot]", " (dot) ", " [dot] ", *["."] * 5][rng.integers(10)]
            local = [f"{word()}.{d(2)}", f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}{d(2)}", *[word()] * 4][rng.integers(8)]
            return before, f"{local}{at}{word() + dot if rng.random() < 0.2 else ''}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}", True
        if kind == "ip":
            return before, ".".join(str(v) for v in rng.integers(0, 256, 4)), True
        if kind == "card":
            body = str(rng.integers(3, 7)) + d(14)
            full = next(body + str(c) for c in range(10) if luhn(body + str(c)))
            sep = ["", " ", "-", "."][rng.integers(4)]
            return before, sep.join(full[i : i + 4] for i in range(0, 16, 4)), True
        style = rng.integers(5)
        return before, [f"+{d(2)} {d(3)} {d(7)}", f"({rng.integers(2, 10)}{d(2)}) {d(3)}-{d(4)}", f"{rng.integers(2, 10)}{d(2)}-{d(3)}-{d(4)}", f"0{d(3)}/{d(7)}"[:12], f"{rng.integers(2, 10)}{d(2)}.{d(3)}.{d(4)}"][style], True
    style = rng.integers(15)
    before = word() + " " if rng.random() < 0.8 else str(rng.choice(["version", "section", "page", "no", "order", "isbn", "look", "meet"])) + " "
    if style > 10:  # an "at" in prose
        name, said = str(rng.choice(_PROSE)), word() if rng.random() < 0.5 else str(rng.choice(_PROSE))
        return before, [
            f"{name} at {word()}{'.' if rng.random() < 0.7 else ' dot '}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}", f"{said} at {rng.integers(1, 24)}.{d(2)}",
            f"{said} at {word()[: rng.integers(1, 6)]}.{d(rng.integers(1, 3))}", f"{said} at {word()}.{word().capitalize() if rng.random() < 0.5 else rng.choice(_NO_ENDINGS)}",
        ][style - 11], False
    year = f"{rng.integers(1950, 2030)}"
    return before, [
        f"{d(1)}.{d(1)}.{d(1)}", f"{rng.integers(1, 40)}.{d(2)}.{d(1)}.{d(3)}1.{d(2)}", f"{year}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{year}",
        f"{rng.integers(1, 1000)},{d(3)},{d(3)}", f"{year}-{int(year[:4]) + 1}", f"{d(3)} {d(2)} {d(2)}", next(s for s in iter(lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", "") if not luhn(s.replace(" ", ""))),
        f"{word()} at {word()}.{word()[:3]}ing", f"{d(2)}/{d(2)}", f"{rng.integers(256, 1000)}.{rng.integers(256, 1000)}.{d(3)}.{d(3)}",
    ][style], False


@lru_cache(maxsize=4)
def trained(n: int = TRAIN_CANDIDATES, precision: float = PRECISION, seed: int = 7) -> BoostedTrees:
    """Trees fitted to two thirds of n generated candidates and calibrated on the rest."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    while len(y) < n:
        before, value, real = _example(rng)
        text = f"{before}{value} {'ondthe' if rng.random() < 0.7 else 'the'}"
        for c in candidates(text):
            # a candidate is personal data if it has most of a real value
            inside = max(0, min(c[2], len(before) + len(value)) - max(c[1], len(before)))
            x.append(features(text, c))
            y.append(float(real and inside >= 0.9 * len(value) and c[2] - c[1] <= 1.2 * len(value)))
    x, y = np.array(x[:n]), np.array(y[:n])
    cut = 2 * n // 3
    return BoostedTrees().fit(x[:cut], y[:cut]).calibrate(x[cut:], y[cut:], precision)


def scored_spans(texts: list[str | None], model: BoostedTrees) -> list[list[tuple[str, int, int, float]]]:
    """For each text the added spans with their calibrated scores: the best-scoring candidates over
    the threshold first, then those that overlap none chosen before and no base span."""
    found, rows = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        base = Covered((a, b) for _, a, b in base_spans(text))
        for c in candidates(text):
            if not base.meets(c[1], c[2]):
                found.append((i, c))
                rows.append(features(text, c))
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    if not rows:
        return out
    x = np.array(rows)
    p = model.predict(x)
    good = model.selects(x, p)
    chosen: dict[int, Covered] = {}
    for k in np.argsort(-p, kind="stable"):
        if not good[k]:
            continue
        i, (kind, a, b) = found[k]
        taken = chosen.setdefault(i, Covered())
        if not taken.meets(a, b):
            taken.add(a, b)
            out[i].append((kind, a, b, float(p[k])))
    return out


def _all_spans(texts, model) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans), each by kind, then start."""
    added = scored_spans(texts, model)
    out = []
    for text, more in zip(texts, added):
        base = base_spans(text)
        out.append((base, sorted({*base, *((k, a, b) for k, a, b, _ in more)}, key=lambda s: (KINDS.index(s[0]), *s[1:]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: BoostedTrees | None = None) -> DataFrame:
    """One row per input row: id, counts of base spans by kind, base_spans and spans as text."""
    model = model or trained()

    def rows(ids, texts):
        got = _all_spans(texts, model)
        return {id_col: ids, **{f"n_{k}": [sum(s[0] == k for s in b) for b, _ in got] for k in KINDS}, "base_spans": [joined(b) for b, _ in got], "spans": [joined(s) for _, s in got]}

    return map_rows(df.withColumn(id_col, F.col(id_col).cast("long")), [id_col, text_col], f"{id_col} long,n_email long,n_ip long,n_card long,n_phone long,base_spans string,spans string", rows, by=text_col)


def redact(df: DataFrame, text_col: str = "text", model: BoostedTrees | None = None) -> DataFrame:
    """The same rows with each span replaced by its kind in brackets; overlapping spans become one.
    Other columns pass unchanged; a null text stays null."""
    model = model or trained()
    fields, names = df.schema, df.columns

    def one(text, spans):
        out, at = [], 0
        for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        return "".join(out) + text[at:]

    def run(batches):
        import pyarrow as pa

        from corollary.llm.common import slices

        at = names.index(text_col)
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                new = [t if not s else one(t, s) for t, (_, s) in zip(texts, _all_spans(texts, model))]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return df.mapInArrow(run, fields)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
