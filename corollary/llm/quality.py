"""Quality of texts by a byte-level convolutional network, in numpy.

A text's bytes are covered whole by overlapping chunks of two half-blocks of HALF bytes. FILTERS
learned filters of WIDTH bytes slide over them (a filter is a table of one weight per offset and byte
value, so a position's response is WIDTH look-ups); responses pass a ReLU and are max-pooled over
each chunk. A text's mean and maximum over its chunks go into one logistic unit: the probability that
the text is good. An empty or null text is one chunk without bytes and gets the score of that.

Behind each text stand WIDTH - 1 zero bytes at least, and positions from which a filter would reach
beyond its half-blocks do not count: a score is a function of the text alone, bit by bit, whatever
stands beside it in a batch.

Training (``fit``) runs on the driver with Adam on a bounded sample: at most TRAIN_ROWS labelled texts
of each class, the first by a hash of their id, and of a text with more than TRAIN_CHARS characters so
many, from a place that its id's hash names. Gradients pass the
max-pool only to the winning positions. Half of the training texts are cut to short pieces, anew in
each epoch, for short texts to be known. Label, language, source and id are never inputs. Without
labels, or with labels of one class only, the score is that class' share (0.5 without labels).

Scoring is a map over rows: memory is bounded by BLOCK beside the text itself, no text is cut, and
equal texts have equal scores. Repeated rows are scored like any other; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corollary.llm.common import map_rows

HALF, WIDTH, FILTERS = 128, 5, 12
BLOCK = 1 << 18
TRAIN_ROWS, TRAIN_CHARS, EPOCHS, BATCH, RATE = 1200, 16_384, 10, 32, 0.01
THRESHOLD = 0.7


class Network:
    """tables: WIDTH x 256 x FILTERS; bias: FILTERS; out: 2 FILTERS weights and a constant."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS + 1).astype(np.float32)
        self.constant: float | None = None

    def _responses(self, data: np.ndarray) -> np.ndarray:
        """The filters' sums at each position that has WIDTH bytes from it on."""
        n = len(data) - WIDTH + 1
        z = self.tables[0][data[:n]]
        for w in range(1, WIDTH):
            z += self.tables[w][data[w : w + n]]
        return z

    @staticmethod
    def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes in half-blocks (with one more of zeros at the end), and each text's first
        half-block (with one more at the end)."""
        blocks = [-(-(len(t) + WIDTH - 1) // HALF) for t in texts]
        first = np.concatenate([[0], np.cumsum(blocks)])
        return np.frombuffer(b"".join(t.ljust(n * HALF, b"\0") for t, n in zip(texts, blocks)) + b"\0" * HALF, np.uint8), first

    def halves(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each half-block, and each text's first half-block
        (with one more at the end)."""
        data, first = self._laid(texts)
        out = np.empty((int(first[-1]), FILTERS), np.float32)
        step = BLOCK // HALF
        for i in range(0, len(out), step):
            j = min(len(out), i + step)
            z = self._responses(data[i * HALF : j * HALF + WIDTH - 1]).reshape(j - i, HALF, FILTERS)
            last = first[1:] - 1 - i
            z[last[(last >= 0) & (last < j - i)], 1 - WIDTH :] = -np.inf  # they reach into the next text
            out[i:j] = z.max(axis=1)
        return out, first

    def _pooled(self, half: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunk maxima (two neighbouring half-blocks of a text) after bias and ReLU, and each text's
        first chunk."""
        n = np.diff(first)
        chunks = np.maximum(n - 1, 1)
        start = np.concatenate([[0], np.cumsum(chunks)])
        left = np.arange(start[-1]) - np.repeat(start[:-1], chunks) + np.repeat(first[:-1], chunks)
        right = np.minimum(left + 1, np.repeat(first[1:], chunks) - 1)
        return np.maximum(np.maximum(half[left], half[right]) + self.bias, 0), start

    def _features(self, chunk: np.ndarray, start: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(chunk, start[:-1], axis=0) / np.diff(start)[:, None]
        return np.concatenate([mean, np.maximum.reduceat(chunk, start[:-1], axis=0), np.ones((len(start) - 1, 1), np.float32)], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.zeros(0)
        # a sum of its own for each row: a matrix product may add in another order in another batch
        logit = (self._features(*self._pooled(*self.halves(texts))).astype(np.float64) * self.out).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    # ---- training -------------------------------------------------------------------------------

    def _gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        data, first = self._laid(texts)
        z = self._responses(data[: first[-1] * HALF + WIDTH - 1]).reshape(-1, HALF, FILTERS)
        z[first[1:] - 1, 1 - WIDTH :] = -np.inf
        where = z.argmax(axis=1)
        half = np.take_along_axis(z, where[:, None, :], axis=1)[:, 0]
        chunk, start = self._pooled(half, first)
        x = self._features(chunk, start)
        p = 1 / (1 + np.exp(-np.clip(x @ self.out, -40, 40)))
        d = ((p - y) / len(y)).astype(np.float32)
        grad = {"out": d @ x}
        # to the chunks: the mean reaches each, the maximum the first one that has it
        n = np.diff(start)
        doc = np.repeat(np.arange(len(n)), n)
        back = d[:, None] * self.out[None, :-1]
        to = back[doc, :FILTERS] / n[doc, None]
        for i in range(len(n)):
            part = chunk[start[i] : start[i + 1]]
            to[start[i] + part.argmax(axis=0), np.arange(FILTERS)] += back[i, FILTERS:]
        to *= chunk > 0
        grad["bias"] = to.sum(axis=0)
        # to the winning half-block and position of each chunk
        left = np.arange(start[-1]) - np.repeat(start[:-1], n) + np.repeat(first[:-1], n)
        right = np.minimum(left + 1, np.repeat(first[1:], n) - 1)
        block = np.where(half[left] >= half[right], left[:, None], right[:, None])
        f = np.broadcast_to(np.arange(FILTERS), block.shape)
        at = block * HALF + where[block, f]
        grad["tables"] = np.zeros_like(self.tables)
        for w in range(WIDTH):
            np.add.at(grad["tables"][w], (data[at + w], f), to)
        return grad

    def train(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(getattr(self, k)) for k in ("tables", "bias", "out")}
        v = {k: np.zeros_like(x) for k, x in m.items()}
        t, steps = 0, epochs * -(-len(y) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                pick = order[i : i + BATCH]
                grad = self._gradients([_cut(texts[k], rng) for k in pick], y[pick])
                t += 1
                rate = RATE * (1 - 0.9 * t / steps)
                for k, g in grad.items():
                    if k == "tables":
                        g = g + 1e-5 * self.tables
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    getattr(self, k)[...] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self


def _cut(text: bytes, rng: np.random.Generator) -> bytes:
    """Half of the time a short piece of a training text, so that short texts are learned too."""
    if rng.random() < 0.5 or len(text) <= 16:
        return text
    n = int(rng.integers(12, 160))
    at = text.find(b" ", int(rng.integers(0, max(1, len(text) - n)))) + 1
    return text[at : at + n]


def held_out(id_col: str = "doc_id"):
    """Rows that never give a label to the training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """At most ``rows`` labelled texts of each class, by the hash of their id; and how many labels of
    each class there are."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r.quality: r["count"] for r in marked.groupBy("quality").count().collect()}
    first = [marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (0, 1)]
    # both limits together bound what is broadcast
    picked = F.broadcast(first[0].unionByName(first[1]))
    length = F.length(F.coalesce("text", F.lit("")))
    window = F.substring("text", (F.pmod(F.xxhash64("doc_id"), length - TRAIN_CHARS) + 1).cast("int"), F.lit(TRAIN_CHARS))
    texts = docs.select("doc_id", "text").join(picked, "doc_id").select("doc_id", F.when(length > TRAIN_CHARS, window).otherwise(F.coalesce("text", F.lit(""))).alias("text"), "quality")
    got = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).collect()
    return [(r.text.encode(), r.quality) for r in sorted(got, key=lambda r: r.doc_id)], counts


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network:
    data, counts = sample(docs, labels, rows)
    y = np.array([q for _, q in data], dtype=np.float32)
    net = Network()
    if len(set(y.tolist())) < 2:
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    net.train([t for t, _ in data], y)
    # the sample has the classes in other shares than the labels have
    net.out[-1] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (1 - y).sum())
    return net


def scored(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, score, predicted."""

    def rows(keys, texts):
        p = net.score([(t or "").encode() for t in texts])
        return {id_col: keys, "score": p.tolist(), "predicted": (p >= threshold).astype(int).tolist()}

    return map_rows(df.withColumn(id_col, F.col(id_col).cast("long")), [id_col, text_col], f"{id_col} long,score double,predicted int", rows, by=text_col)


def kept(df: DataFrame, net: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    names = df.columns

    def run(batches):
        import pyarrow as pa

        from corollary.llm.common import slices

        at = names.index(text_col)
        for batch in batches:
            for part in slices(batch, at):
                p = net.score([(t or "").encode() for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(p >= threshold))

    return df.mapInArrow(run, df.schema)
