"""Helpers shared by the training-data operators: Arrow batches in, Arrow batches out.

Every helper works on one Arrow batch at a time, so a task holds a few thousand rows however large
its partition is. Hashes are 64 bit and depend on nothing but the bytes, so a task that is run again
on another executor gives the same rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from corollary.functions.lineage import checkpoint, shared_folder  # noqa: F401

U64 = np.uint64
#: Rows are handed to a batch function in slices of about this many characters.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, columns: list[str], schema: str, rows: Callable[..., dict], by: str | None = None) -> DataFrame:
    """Apply ``rows(*lists) -> {column: list}`` to slices of ``df[columns]``; ``by`` names the text
    column whose length bounds a slice."""
    at = columns.index(by) if by else None
    fields = [x.split() for x in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "tinyint": pa.int8(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    out = pa.schema([(n, kinds[k]) for n, k in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                got = rows(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, at: int | None) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that column ``at`` has about SLICE_CHARS bytes in each cut, one row at least."""
    if at is None or batch.num_rows == 0:
        yield batch
        return
    sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0), dtype=np.int64)
    group = np.cumsum(sizes) // SLICE_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix: a bijection whose output bits all depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Multiplier of the polynomial hash, odd so that it has an inverse; a random value for each byte.
BASE = 0x9E3779B97F4A7C15
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95))
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the next slice."""
    if len(_powers.get(base, ())) < n:
        out = np.full(n + n // 4 + 1, base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of many texts at once.

    buf: the bytes of all texts; start, end: byte places of each word in buf; doc: the index of the
    word's text; hash: 64 bits of its bytes; first: for each text the index of its first word, with
    one more entry at the end.
    """

    def __init__(self, texts: list[str | None], lower: bool = False):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = b" ".join(raw) + b" "
        if lower:
            data = data.lower()
        self.buf = buf = np.frombuffer(data, dtype=np.uint8)
        lengths = np.array([len(r) for r in raw], dtype=np.int64) + 1
        self.offset = np.concatenate([[0], np.cumsum(lengths)])
        word = ~SPACE[buf]
        edge = np.diff(word.astype(np.int8), prepend=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.offset)
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))
        up = powers(BASE, len(buf) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[buf] * up[:-1], dtype=np.uint64)])
        down = powers(pow(BASE, -1, 1 << 64), len(buf) + 1)
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def runs_hash(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive entries of h (empty if h is shorter)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * U64(BASE) + h[i : i + n]
    return mix(out)


class Covered:
    """Places of a text that spans cover, as disjoint intervals: whether a span meets one is told by a
    search, so a long text with many spans stays cheap."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.ends) and self.starts[i] < b

    def gaps(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """The parts of a:b that no span covers."""
        i = bisect_right(self.ends, a)
        while i < len(self.ends) and self.starts[i] < b:
            if a < self.starts[i]:
                yield a, self.starts[i]
            a = self.ends[i]
            i += 1
        if a < b:
            yield a, b

    def add(self, a: int, b: int) -> None:
        """a:b must meet nothing so far."""
        i = bisect_right(self.ends, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of an earlier step that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
