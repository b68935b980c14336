"""Repeated passages, by compacting the graph of repeated word k-mers.

Nodes are runs of k - 1 words, edges runs of k words (windows). Only edges that occur in several
documents matter. They are found without a row per window:

1. each slice of documents cuts its windows into runs that share a minimizer (the least hash of the
   shorter word runs inside a window), as neighbouring windows mostly do. Inside a slice a window
   keeps its first place in the smallest document only; later documents of the slice are already
   known to repeat it. The runs go to the bucket of their minimizer, as packed arrays. A minimizer that
   has more than its share of all windows (a line that very many documents have) does not fill one
   bucket: its windows go to buckets by their own hashes (``_hot``, counted over all documents);
2. a bucket meets all windows with its minimizers, from all documents, and finds for each the place
   in the smallest document: the edge's source. An occurrence in a larger document is a repeat;
3. consecutive edges whose places and sources advance together form a nonbranching path (a branch
   would change the source). Paths leave buckets as rows: document, start, edges, source document and
   source start; ``compacted`` joins them to whole paths: those that none precedes with those that none
   follows;
4. source coordinates verify: a join with the sources' documents gives the SHA-256 of each path's words
   there, a join with its own document compares it with the words here and cuts what is equal.

Up to there windows are compared by hashes (HASH bits). A path whose words differ from its source's
stays in the text; ``removed`` then asks the hashes of its windows again, by SHA-256 of their words over all
documents, so its result does not depend on the hashes. ``cut`` does not ask again: with 56 bits inside of
a bucket such a path is not to be expected, and if there is one no word goes that it should not.

Buckets grow in number with the documents. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A null text has
none. Repeated rows with one id never repeat each other. Where rows with one id differ, they count as one
document, whose windows stand at their first places: a passage that another of its rows has elsewhere stays
there. Rows without an id are neither sources nor cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corollary.llm.common import SPACE, U64, Words, checkpoint, mix, runs_hash, slices

K = 13
DOCS_PER_BUCKET = 1024
LEAST_BUCKETS = 256
#: Bits of a window's hash.
HASH = 64
#: A minimizer with this share of all windows is hot, so there are at most 1 / HOT of them; a slice reports
#: minimizers with the share LOCAL (and LEAST windows) of its own.
HOT, LOCAL, LEAST = 1 / 8192, 1 / 2048, 32
SALTS = 64
_PATH = "doc long,start int,edges int,src_doc long,src_start int"
_NAMES = [f.split()[0] for f in _PATH.split(",")]


def _windows(words: Words, k: int, bits: int = HASH) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of each window that lies inside one text."""
    h = runs_hash(words.hash, k) & U64((1 << bits) - 1)
    if not len(h):
        return np.zeros(0, np.int64), h
    last = words.first[1:][words.doc[: len(h)]] - k
    at = np.flatnonzero(np.arange(len(h)) <= last)
    return at, h[at]


def _minimizers(words: Words, k: int) -> np.ndarray:
    """For each run of k words the least hash of the shorter runs inside."""
    short = (k + 1) // 2
    g = runs_hash(words.hash, short)
    n = len(words.hash) - k + 1
    out = g[:n].copy()
    for i in range(1, k - short + 1):
        np.minimum(out, g[i : n + i], out=out)
    return out


def _runs(*advance: np.ndarray, same: tuple[np.ndarray, ...] = ()) -> np.ndarray:
    """Where a new run starts: some of ``advance`` does not go up by one, or some of ``same`` differs."""
    n = len((*advance, *same)[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for a in advance:
            new[1:] |= a[1:] != a[:-1] + 1
        for s in same:
            new[1:] |= s[1:] != s[:-1]
    return np.flatnonzero(new)


def _paths(doc, start, src_doc, src_start) -> dict[str, np.ndarray]:
    """Single edges, ordered by document and start, as paths."""
    first = _runs(start, src_start, same=(doc, src_doc))
    edges = np.diff(np.append(first, len(doc)))
    return {"doc": doc[first], "start": start[first].astype(np.int32), "edges": edges.astype(np.int32), "src_doc": src_doc[first], "src_start": src_start[first].astype(np.int32)}


def _frequent(texts: list[str | None], k: int) -> tuple[list[int], list[int], int]:
    """Minimizers that many of the texts' windows have, with their windows; and the number of windows."""
    words = Words(texts)
    at, h = _windows(words, k)
    if not len(at):
        return [], [], 0
    least, count = np.unique(_minimizers(words, k)[at], return_counts=True)
    much = count >= max(LEAST, LOCAL * len(at))
    return least[much].astype(np.int64).tolist(), count[much].tolist(), len(at)


def _hot(docs: DataFrame, k: int) -> tuple[int, np.ndarray]:
    """The number of rows of docs (id, text), and the hot minimizers: at most 1 / HOT."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                least, count, total = _frequent([t if i is not None else None for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())], k)
                yield pa.RecordBatch.from_arrays([pa.array([*least, None], pa.int64()), pa.array([*count, total], pa.int64()), pa.array([0] * len(least) + [part.num_rows], pa.int64())], names=["least", "windows", "rows"])

    counted = checkpoint(docs.mapInArrow(run, "least long,windows long,rows long").groupBy("least").agg(F.sum("windows").alias("windows"), F.sum("rows").alias("rows")))
    total = counted.where("least is null").first()
    if total is None:
        return 0, np.zeros(0, np.uint64)
    hot = counted.where(F.col("least").isNotNull() & (F.col("windows") >= max(LEAST, HOT * total.windows))).select("least").collect()  # at most 1 / HOT rows
    return total.rows, np.sort(np.array([r.least for r in hot], np.int64).astype(np.uint64))


def _slice(ids: list[int], texts: list[str | None], k: int, buckets: int, hot: np.ndarray, bits: int = HASH):
    """(paths known inside the slice, {bucket: packed runs})."""
    words = Words([t if i is not None else None for i, t in zip(ids, texts)])
    at, h = _windows(words, k, bits)
    number = np.array([0 if i is None else i for i in ids], np.int64)
    if not len(at):
        return None, {}
    row = words.doc[at]
    doc, start = number[row], at - words.first[row]
    order = np.lexsort((start, doc, h))
    sh, sd, ss = h[order], doc[order], start[order]
    new = np.ones(len(sh), bool)
    new[1:] = sh[1:] != sh[:-1]
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    # repeats of a smaller document of this slice; of a window that a document has several times, the first
    own = new.copy()
    own[1:] |= sd[1:] != sd[:-1]
    later = own & (sd != sd[head][group])
    r = order[later]
    back = np.argsort(r, kind="stable")
    r = r[back]
    paths = _paths(doc[r], start[r], sd[head][group][later][back], ss[head][group][later][back])
    # first places, in text order, by minimizer
    keep = np.sort(order[head])
    least = _minimizers(words, k)[at[keep]]
    if len(hot):
        least = np.where(hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least, h[keep], least)
    bucket = (mix(least) % U64(buckets)).astype(np.int64)
    doc, start, h = doc[keep], start[keep], h[keep]
    first = _runs(start, same=(doc, row[keep], bucket))
    length = np.diff(np.append(first, len(h)))
    by = np.argsort(bucket[first], kind="stable")
    out, edges = {}, np.flatnonzero(np.diff(bucket[first][by], prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(by))):
        f, n = first[by[a:b]], length[by[a:b]]
        pick = np.repeat(f - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        w = h[pick] & U64((1 << 56) - 1)
        out[int(bucket[f[0]])] = b"".join((np.array([len(f), len(w)], "<i8").tobytes(), doc[f].astype("<i8").tobytes(), start[f].astype("<i4").tobytes(), n.astype("<i4").tobytes(), (w & U64(0xFFFFFFFF)).astype("<u4").tobytes(), (w >> U64(32) & U64(0xFFFF)).astype("<u2").tobytes(), (w >> U64(48)).astype("u1").tobytes()))
    return paths, out


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and hash of each window of packed runs."""
    runs, n = np.frombuffer(data, "<i8", 2)
    at, parts = 16, []
    for kind, size, count in (("<i8", 8, runs), ("<i4", 4, runs), ("<i4", 4, runs), ("<u4", 4, n), ("<u2", 2, n), ("u1", 1, n)):
        parts.append(np.frombuffer(data, kind, int(count), at))
        at += size * int(count)
    doc, start, length, low, mid, high = parts
    inside = np.arange(n) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(doc, length), np.repeat(start, length) + inside, low.astype(np.uint64) | mid.astype(np.uint64) << U64(32) | high.astype(np.uint64) << U64(48)


def paths(df: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", bits: int = HASH) -> DataFrame:
    """doc, start, edges, src_doc, src_start: runs of windows that repeat a smaller document's. A
    window that a document holds several times is named once, so a text of one repeated word or line is
    few rows; what cuts the text finds its other places there (``_covered``)."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n, hot = _hot(docs, k)
    buckets = max(LEAST_BUCKETS, 1 << max(0, (n // DOCS_PER_BUCKET).bit_length()))
    kinds = {"doc": pa.int64(), "start": pa.int32(), "edges": pa.int32(), "src_doc": pa.int64(), "src_start": pa.int32()}

    def cut(batches):
        for batch in batches:
            for part in slices(batch, 1):
                known, runs = _slice(part.column(0).to_pylist(), part.column(1).to_pylist(), k, buckets, hot, bits)
                rows, data = [*runs], [*runs.values()]
                if known is not None and len(known["doc"]):  # known paths go to any bucket
                    rows.append(int(known["doc"][0]) % buckets)
                    data.append(b"".join((np.array([-len(known["doc"])], "<i8").tobytes(), *(known[n].astype("<i8" if n in ("doc", "src_doc") else "<i4").tobytes() for n in _NAMES))))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "runs"])

    def meet(t: pa.Table) -> pa.Table:
        known, fresh = [], []
        for data in t.column("runs").to_pylist():
            n = int(np.frombuffer(data, "<i8", 1)[0])
            if n >= 0:
                fresh.append(_unpack(data))
                continue
            at, one = 8, {}
            for name in _NAMES:
                kind = "<i8" if name in ("doc", "src_doc") else "<i4"
                one[name] = np.frombuffer(data, kind, -n, at)
                at += -n * int(kind[2])
            known.append(one)
        if fresh:
            doc, start, h = (np.concatenate(x) for x in zip(*fresh))
            order = np.lexsort((start, doc, h))
            sh, sd, ss = h[order], doc[order], start[order]
            new = np.ones(len(sh), bool)
            new[1:] = sh[1:] != sh[:-1]
            head = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            own = new.copy()
            own[1:] |= sd[1:] != sd[:-1]
            later = own & (sd != sd[head][group])
            d, s, x, y = sd[later], ss[later], sd[head][group][later], ss[head][group][later]
            back = np.lexsort((s, d))
            known.append(_paths(d[back], s[back], x[back], y[back]))
        return pa.table({n: pa.array(np.concatenate([p[n] for p in known]) if known else [], kinds[n]) for n in _NAMES})

    return docs.mapInArrow(cut, "bucket int,runs binary").groupBy("bucket").applyInArrow(meet, _PATH)


def compacted(found: DataFrame) -> DataFrame:
    """doc, start, edges, src_doc, src_start: whole nonbranching paths. In the paths between two documents
    with one distance of places, the n-th that none precedes begins the path that the n-th that none
    follows ends."""
    line = ["doc", "src_doc", "shift"]
    every = found.distinct().select("doc", "src_doc", (F.col("src_start") - F.col("start")).alias("shift"), "start", (F.col("start") + F.col("edges")).alias("end"))
    number = lambda c: F.row_number().over(Window.partitionBy(*line).orderBy(c)).alias("n")
    heads = every.join(every.select(*line, F.col("end").alias("start")), [*line, "start"], "left_anti").select(*line, "start", number("start"))
    tails = every.join(every.select(*line, F.col("start").alias("end")), [*line, "end"], "left_anti").select(*line, "end", number("end"))
    return heads.join(tails, [*line, "n"]).select("doc", "start", (F.col("end") - F.col("start")).alias("edges"), "src_doc", (F.col("start") + F.col("shift")).alias("src_start"))


class Canonical:
    """A text's words with one space between them, and where each begins."""

    def __init__(self, text: str | None):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        self.words = words
        self.data = b" ".join(words)
        self.at = [0, *accumulate(len(w) + 1 for w in words)]

    def part(self, start: int, words: int) -> bytes:
        return self.data[self.at[start] : self.at[start + words] - 1]

    def digest(self, start: int, words: int) -> bytes:
        return hashlib.sha256(self.part(start, words)).digest()


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, row: rows whole. Rows without an id get one of as many keys below all ids as hashes of their texts tell,
    so they meet in no group. The key is never null (nor, for Spark, can it be), so both joins read one exchange.
    Such a row takes no part in either."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long") + F.shiftrightunsigned(F.xxhash64(text_col), 32))
    return df.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


_PLACE = ["src_doc", "src_start", "edges"]


def with_digests(found: DataFrame, keyed: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """The paths with the SHA-256 of their source's words (found: written already). A source answers each
    place and length once, however many documents repeat it; the answers to those that more than the share
    HOT of all paths repeat (1 / HOT at most) go to SALTS parts."""
    hot = found.groupBy(*_PLACE).agg(F.count("*").alias("n")).where(F.col("n") >= max(LEAST, HOT * found.count())).select(*_PLACE, F.lit(True).alias("hot"))
    hot = F.broadcast(checkpoint(hot))
    asked = found.groupBy(F.col("src_doc").alias("key")).agg(F.collect_set(F.struct("src_start", "edges")).alias("asked"))

    def run(batches):
        for batch in batches:
            ids, texts = (pa.compute.struct_field(batch.column("row"), c).to_pylist() for c in (id_col, text_col))
            out: list[tuple] = []
            for own, key, text, want in zip(ids, batch.column("key").to_pylist(), texts, batch.column("asked").to_pylist()):
                if own is None:
                    continue
                c = Canonical(text)
                out += [(key, w["src_start"], w["edges"], c.digest(w["src_start"], w["edges"] + k - 1)) for w in want if w["src_start"] + w["edges"] + k - 1 <= len(c.words)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["src_doc", "src_start", "edges", "digest"])

    told = keyed.join(asked, "key").mapInArrow(run, "src_doc long,src_start int,edges int,digest binary")
    # an id that stands in several rows may give several answers
    told = told.groupBy(*_PLACE).agg(F.collect_set("digest").alias("digests")).join(hot, _PLACE, "left")
    told = told.select(*_PLACE, "digests", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    salted = found.join(hot, _PLACE, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).otherwise(0))
    digests = F.coalesce("digests", F.array().cast("array<binary>"))
    return salted.join(told, [*_PLACE, "salt"], "left").select("doc", "start", "edges", digests.alias("digests"))


def _covered(c: Canonical, own: np.ndarray, starts: list[int], edges: list[int], digests: list, k: int) -> tuple[np.ndarray, list[int]]:
    """For each word of a text whether a repeated window covers it, and the windows of paths whose words
    are not those of their source. own: the hashes of the text's windows."""
    n = len(c.words)
    hit, wrong = np.zeros(n, bool), []
    for a, m, d in zip(starts, edges, digests):
        if d is None or a + m + k - 1 <= n and c.digest(a, m + k - 1) in d:  # None: known to repeat
            hit[a : a + m] = True
        else:
            wrong += range(a, min(a + m, len(own)))
    if len(np.unique(own)) < len(own):  # other places of the same windows in this text
        there = hit[: len(own)]
        places = np.flatnonzero(np.isin(own, own[there])).tolist()
        same = {c.part(i, k) for i in places if there[i]}
        for i in places:
            hit[i] = hit[i] or c.part(i, k) in same
    step = np.zeros(n + k, np.int32)
    w = np.flatnonzero(hit)
    np.add.at(step, w, 1)
    np.add.at(step, w + k, -1)
    return np.cumsum(step)[:n] > 0, wrong


def _covers(texts: list[str | None], spans: list[list[dict] | None], k: int, bits: int) -> Iterator[tuple[int, Canonical, np.ndarray, list[int]]]:
    """For each text with paths: its index, words, what is covered, and the hashes of windows to ask again."""
    there = [i for i, s in enumerate(spans) if s]
    words = Words([texts[i] for i in there])
    at, h = _windows(words, k, bits)
    edge = np.searchsorted(at, words.first)
    for j, i in enumerate(there):
        own, c = h[edge[j] : edge[j + 1]], Canonical(texts[i])
        cover, wrong = _covered(c, own, *([s[x] for s in spans[i]] for x in ("start", "edges", "digests")), k)
        yield i, c, cover, own[wrong].astype(np.int64).tolist()


def _with_spans(keyed: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """key, row, spans: the rows with their paths (a document has at most one per word)."""
    spans = found.groupBy(F.col("doc").alias("key")).agg(F.sort_array(F.collect_list(F.struct("start", "edges", "digests"))).alias("spans"))
    return keyed.join(spans, "key", "left").withColumn("spans", F.when(F.col("row").getField(id_col).isNotNull(), F.col("spans")))


def _removed(keyed: DataFrame, found: DataFrame, id_col: str, text_col: str, k: int, bits: int) -> DataFrame:
    """id, n_words, n_removed, kept_sha256, ask (hashes of windows to ask again)."""

    def run(batches):
        for batch in batches:
            flat = pa.RecordBatch.from_arrays([batch.column("key"), pa.compute.struct_field(batch.column("row"), text_col), batch.column("spans"), pa.compute.struct_field(batch.column("row"), id_col)], names=["key", "text", "spans", "id"])
            for part in slices(flat, 1):
                keys, texts, spans, _ = (c.to_pylist() for c in part.columns)
                words: list = [None] * len(keys)
                removed, ask = [0] * len(keys), [[] for _ in keys]
                for i, c, cover, again in _covers(texts, spans, k, bits):
                    words[i] = len(c.words), [w for w, g in zip(c.words, cover.tolist()) if not g]
                    removed[i], ask[i] = int(cover.sum()), again
                for i, w in enumerate(words):
                    if w is None:
                        w = (texts[i] or "").encode().split()
                        words[i] = len(w), w
                yield pa.RecordBatch.from_arrays(
                    [part.column(3), pa.array([n for n, _ in words], pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for _, w in words], pa.string()), pa.array(ask, pa.list_(pa.int64()))],
                    names=[id_col, "n_words", "n_removed", "kept_sha256", "ask"],
                )

    return _with_spans(keyed, found, id_col).mapInArrow(run, f"{id_col} long,n_words long,n_removed long,kept_sha256 string,ask array<long>")


def _asked_again(df: DataFrame, hashes: DataFrame, id_col: str, text_col: str, k: int, bits: int) -> DataFrame:
    """doc, start, edges (1), digests (null): all repeats among the windows with these hashes (h), told by
    the SHA-256 of their words over all documents."""

    def places(batches):
        for batch in batches:
            for part in slices(batch, 1):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                words = Words(texts)
                at, h = _windows(words, k, bits)
                row = words.doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(np.array(ids, np.int64)[row], pa.int64()), pa.array((at - words.first[row]).astype(np.int32))], names=["h", "key", "start"])

    docs = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).where("key is not null")
    found = docs.mapInArrow(places, "h long,key long,start int").join(hashes, "h", "left_semi").groupBy("key").agg(F.collect_set("start").alias("starts"))

    def digests(batches):
        for batch in batches:
            out = []
            for key, text, starts in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "starts"))):
                c = Canonical(text)
                out += [(key, i, c.digest(i, k)) for i in starts if i + k <= len(c.words)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 3, (pa.int64(), pa.int32(), pa.binary()))], names=["doc", "start", "digest"])

    told = docs.join(found, "key").mapInArrow(digests, "doc long,start int,digest binary")
    least = told.groupBy("digest").agg(F.min("doc").alias("least"))
    return told.join(least, "digest").where("least < doc").select("doc", "start", F.lit(1).alias("edges"), F.lit(None).cast("array<binary>").alias("digests"))


def removed(df: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", bits: int = HASH) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 (kept words joined by a space)."""
    docs = df.select(F.col(id_col).cast("long").alias(id_col), text_col)
    keyed = _keyed(docs, id_col, text_col)
    found = with_digests(checkpoint(compacted(checkpoint(paths(docs, k, id_col, text_col, bits)))), keyed, id_col, text_col, k)
    out = checkpoint(_removed(keyed, found, id_col, text_col, k, bits))
    hashes = out.select(F.explode("ask").alias("h")).distinct()
    if not hashes.isEmpty():
        again = _asked_again(docs, checkpoint(hashes), id_col, text_col, k, bits)
        out = _removed(keyed, found.unionByName(checkpoint(again)), id_col, text_col, k, bits)
    return out.drop("ask")


def cut(df: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", bits: int = HASH) -> DataFrame:
    """The same rows with covered words, and the white space behind them, cut out of the texts; texts
    without repeats stay as they are. Other columns pass unchanged."""
    names, schema = df.columns, df.schema
    keyed = _keyed(df, id_col, text_col)
    found = with_digests(checkpoint(compacted(checkpoint(paths(df, k, id_col, text_col, bits)))), keyed, id_col, text_col, k)

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            flat = pa.RecordBatch.from_arrays([pa.compute.struct_field(row, text_col), row, batch.column("spans")], names=["text", "row", "spans"])
            for part in slices(flat, 0):
                texts, spans = part.column(0).to_pylist(), part.column(2).to_pylist()
                for i, c, cover, _ in _covers(texts, spans, k, bits):
                    if cover.any():
                        raw = np.frombuffer(texts[i].encode("utf-8", "surrogatepass"), np.uint8)
                        word = np.diff((~SPACE[raw]).astype(np.int8), prepend=0) == 1
                        begin = np.flatnonzero(word)
                        until = np.append(begin[1:], len(raw))
                        drop = np.repeat(cover, until - begin)  # from a word's start to the next one's
                        texts[i] = np.concatenate([raw[: begin[0]], raw[begin[0] :][~drop]]).tobytes().decode("utf-8", "surrogatepass").rstrip(" \t\n\x0b\x0c\r")
                columns = part.column(1).flatten()
                columns[names.index(text_col)] = pa.array(texts, columns[names.index(text_col)].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return _with_spans(keyed, found, id_col).mapInArrow(run, schema)
