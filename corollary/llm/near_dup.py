"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, and exact confirmation.

A document's set holds the hashes (64 bits) of its distinct runs of k words. SLOTS min-wise hash values
of b = 16 bits each are its signature; the distance of two signatures is the number of slots that differ.

Multi-index: the slots are split into CHUNKS chunks of WIDE slots. Two signatures within RADIUS =
2 * CHUNKS - 1 have, by the pigeonhole, a chunk with one error at most; the allowed error is
enumerated by leaving out each slot of a chunk in turn, so such a pair shares one of SLOTS keys for
certain. Pairs beyond the radius may be found as well and are not turned away before distance FAR.

A sketch of BITS parities goes with a signature: each element of the set flips one bit. Two sketches
differ in at most as many bits as the sets have elements that are not common, so a pair whose sketches
differ in more bits than a link allows is no link for certain; where the sets are large against BITS
the expected count and six deviations take that bound's place (``_allowed``).

What can miss a link, for a pair of similarity 0.8, the lowest that can be linked (less above it): that
its signatures share no key, (1 - p) ** CHUNKS with p = s ** WIDE + WIDE * s ** (WIDE - 1) * (1 - s), 3e-6;
that they are farther apart than FAR though they share one, 7e-7 (the binomial's tail); that the sketches of
large sets differ by more than six deviations, 1e-9. Together under 4e-6. Pairs within RADIUS share a key
and are within FAR for certain.

Work that copies would make quadratic is avoided in steps, none of which loses a link that the keys find:

1. documents with equal sets are one class from the start (a hash aggregate);
2. in each bucket of a key all classes are compared with one pivot, the class that shares most keys
   with others; confirmed links give components;
3. only buckets that still hold several components are searched for pairs of different components,
   in blocks of BLOCK classes whose sketches meet as matrices; pairs that pass go on;
4. every candidate is confirmed on the full sets, 100 * intersection >= percent * union.

Components grow by rounds of the smallest neighbour's label and pointer jumping in Spark; no link,
label or set is sent to the driver. Null texts and texts without words have empty sets and are linked
with nothing. Repeated rows have equal sets; those with one id are one document, so all of them are kept
or none. Rows without an id keep a null component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corollary.llm.common import U64, Words, checkpoint, map_rows, mix, runs_hash

CHUNKS, WIDE = 12, 6
SLOTS = CHUNKS * WIDE
RADIUS = 2 * CHUNKS - 1
FAR = 32
BLOCK = 2048
BITS = 1024

_rng = np.random.default_rng(20)
_FLIP = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_FACTOR = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, each text's sorted, and where each text's begin."""
    words = Words(texts, lower=True)
    n = len(texts)
    count = np.diff(words.first)
    all_runs = runs_hash(words.hash, k)
    last = np.full(len(words.hash), -1)
    if len(words.hash):
        last = words.first[1:][words.doc] - k  # a run may start here at the latest
    at = np.flatnonzero(np.arange(len(words.hash)) <= last)
    doc, h = words.doc[at], all_runs[at]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):  # the whole sequence as one
        extra = np.array([mix(np.array([_fold(words.hash[words.first[i] : words.first[i + 1]])], np.uint64))[0] for i in short], np.uint64)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, extra])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(n + 1))


def _fold(h: np.ndarray) -> int:
    out = len(h)
    for x in h.tolist():
        out = (out * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
    return out


def _signatures(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """SLOTS values of 16 bits for each non-empty set, zeros for the others."""
    out = np.zeros((len(start) - 1, SLOTS), "<u2")
    there = np.flatnonzero(np.diff(start))
    if len(there):
        for j in range(SLOTS):
            least = np.minimum.reduceat((h ^ _FLIP[j]) * _FACTOR[j], start[there])
            out[there, j] = (mix(least) & U64(0xFFFF)).astype("<u2")
    return out


def _parities(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """BITS / 8 bytes for each set."""
    n = len(start) - 1
    out = np.zeros((n, BITS // 8), np.uint8)
    for i in range(0, n, 512):
        j = min(n, i + 512)
        part = mix(h[start[i] : start[j]])
        doc = np.repeat(np.arange(j - i), np.diff(start[i : j + 1]))
        count = np.bincount(doc * BITS + (part % U64(BITS)).astype(np.int64), minlength=(j - i) * BITS)
        out[i:j] = np.packbits((count & 1).astype(np.uint8).reshape(j - i, BITS), axis=1)
    return out


def _allowed(n: np.ndarray, percent: int) -> np.ndarray:
    """The most bits in which the sketches of linked sets, of n elements together, differ: what is
    not common are (100 - percent) / (100 + percent) of n at most."""
    most = np.floor(n * (100 - percent) / (100 + percent))
    odd = (1 - np.exp(-2 * most / BITS)) / 2
    return np.minimum(most, BITS * odd + 6 * np.sqrt(BITS * odd * (1 - odd)) + 1)


def _split(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and sketches (as 64-bit words)."""
    both = np.frombuffer(b"".join(column), np.uint8).reshape(-1, 2 * SLOTS + BITS // 8)
    return np.ascontiguousarray(both[:, : 2 * SLOTS]).view("<u2"), np.ascontiguousarray(both[:, 2 * SLOTS :]).view("<u8")


def signatures(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, n (size of the set), set_a, set_b (128 bits of the set), sig (signature and sketch)."""

    def rows(ids, texts):
        h, start = shingle_sets(texts, k)
        sums = [np.concatenate([[U64(0)], np.cumsum(mix(h ^ U64(s)), dtype=np.uint64)]) for s in (0x51, 0xA7)]
        a, b = (np.asarray(s[start[1:]] - s[start[:-1]]).astype(np.int64) for s in sums)
        return {"id": ids, "n": np.diff(start).tolist(), "set_a": a.tolist(), "set_b": b.tolist(), "sig": [s.tobytes() + p.tobytes() for s, p in zip(_signatures(h, start), _parities(h, start))]}

    return map_rows(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ["id", "text"], "id long,n long,set_a long,set_b long,sig binary", rows, by="text")


def keys(classes: DataFrame) -> DataFrame:
    """key, id: SLOTS rows for each class."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            for i in range(0, len(ids), 4096):
                sig = _split(batch.column("sig").slice(i, 4096).to_pylist())[0].reshape(-1, CHUNKS, WIDE).astype(np.uint64)
                out = np.empty((len(sig), CHUNKS, WIDE), np.uint64)
                for w in range(WIDE):
                    h = np.zeros((len(sig), CHUNKS), np.uint64) + (np.arange(CHUNKS, dtype=np.uint64) * U64(WIDE) + U64(w + 1))
                    for j in range(WIDE):
                        if j != w:
                            h = mix(h * U64(0x9E3779B97F4A7C15) + sig[:, :, j])
                    out[:, :, w] = h
                yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).astype(np.int64)), pa.array(np.repeat(ids[i : i + 4096], SLOTS))], names=["key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long,id long")


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow a link."""
    one = classes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("s_a"))
    two = classes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("s_b"))
    both = pairs.join(one, "a").join(two, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                (x, p), (y, q) = (_split(batch.column(c).to_pylist()) for c in ("s_a", "s_b"))
                n = np.asarray(batch.column("n_a")) + np.asarray(batch.column("n_b"))
                ok = ((x != y).sum(axis=1) <= FAR) & (np.bitwise_count(p ^ q).sum(axis=1) <= _allowed(n, percent))
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long,b long")


def _confirmed(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(asked, "id")

    def rows(ids, texts):
        h, start = shingle_sets(texts, k)
        return {"id": ids, "set": [h[a:b].view(np.int64) for a, b in zip(start, start[1:])]}

    # an id that stands in several rows has one of their sets; the sets of a class are equal
    sets = map_rows(texts, ["id", "text"], "id long,set array<long>", rows, by="text").dropDuplicates(["id"])
    first = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    both = first.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id in a link (a, b)."""
    both = checkpoint(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("least"))
        step = labels.join(near, "id").select("id", F.least("component", "least").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("next"))
        moved = checkpoint(step.join(jump, "to").select("id", F.least("to", "next").alias("component"), "was"))
        labels = moved.select("id", "component")
        if moved.where("component <> was").isEmpty():
            return labels


def _between(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in a bucket, within FAR. members: key, id, component, size (of
    the bucket). A bucket is dealt into blocks; each two blocks of it meet in one group."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = members.join(classes.select("id", "n", "sig"), "id").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "n", "sig")

    def meet(t: pa.Table) -> pa.Table:
        own, ids, comp, n = (np.asarray(t.column(c)) for c in ("own", "id", "component", "n"))
        sig, bits = _split(t.column("sig").to_pylist())
        one_block = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        names, count = np.unique(comp, return_counts=True)
        large = comp == names[count.argmax()]  # pairs are sought from the other components' side
        a, b = [], []
        for x in np.flatnonzero(~large):
            ok = (comp != comp[x]) & (large | (ids > ids[x]))
            y = np.flatnonzero(ok if one_block else ok & (own != own[x]))
            y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
            y = y[np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1) <= _allowed(n[y] + n[x], percent)]
            y = y[(sig[y] != sig[x]).sum(axis=1) <= FAR]
            a.append(np.minimum(ids[y], ids[x]))
            b.append(np.maximum(ids[y], ids[x]))
        cat = lambda v: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64())
        return pa.table({"a": cat(a), "b": cat(b)})

    return rows.groupBy("key", "i", "j").applyInArrow(meet, "a long,b long").distinct()


def linked(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept."""
    sigs = checkpoint(signatures(df, id_col, text_col, k))
    full = sigs.where("n > 0 and id is not null")
    classes = checkpoint(full.groupBy("n", "set_a", "set_b").agg(F.min("id").alias("id"), F.min("sig").alias("sig")))
    keyed = keys(classes)
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    bucket = checkpoint(keyed.join(shared, "key"))
    weight = bucket.groupBy("id").agg(F.sum("size").alias("weight"))
    pivots = bucket.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("top")).select("key", (-F.col("top.id")).alias("pivot"))
    tried = bucket.join(pivots, "key").where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    near = checkpoint(_near(tried, classes, percent))
    links = checkpoint(_confirmed(near, df, id_col, text_col, k, percent))
    found = components(links)
    member = bucket.join(found, "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("component"))
    open_keys = member.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    more = checkpoint(_between(member.join(open_keys, "key"), classes, percent).join(near, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        again = checkpoint(_confirmed(more, df, id_col, text_col, k, percent))
        if not again.isEmpty():
            # links between components, with the components themselves as links
            ends = found.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
            found = components(again.unionByName(ends))
    first = classes.join(found, "id", "left").select("n", "set_a", "set_b", F.coalesce("component", "id").alias("component"))
    out = sigs.join(first, ["n", "set_a", "set_b"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
