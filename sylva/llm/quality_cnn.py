"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and cut into overlapping chunks that cover the whole document.
Learned filters slide over each chunk and are max-pooled within it; a document's chunk maxima are
pooled again (greatest, mean and least over its chunks), and a small hidden layer combines these
with the text's log length into one probability.  Training is plain back-propagation with Adam.

Scale.  Training takes a bounded sample of labelled rows: at most ``max_rows`` with the least hashes
of their id, and no more than ``max_bytes`` of text, taken in that order (documented parameters),
fetched in one scan of the documents.
The model is some tens of kilobytes and goes with the function.  Scoring, and leaving out what scores
too low, is one pass without an exchange; a document is scored in strips, so its length does not bound memory.

Edge cases: null and empty texts have no chunk and get the score of an all-zero document; texts
shorter than a window are padded; repeated rows get equal scores; with labels of one class only,
scores are that class's prior; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text


@dataclass(frozen=True)
class Shape:
    embedding: int = 4
    window: int = 16
    stride: int = 4
    filters: int = 32
    hidden: int = 16
    chunk: int = 64  # windows in a chunk
    step: int = 48  # windows from chunk to chunk


class ByteConvNet:
    def __init__(self, shape: Shape = Shape(), seed: int = 0):
        r = np.random.default_rng(seed)
        s = self.shape = shape
        normal = lambda *n, scale: (r.standard_normal(n) * scale).astype(np.float32)
        self.p = {
            "E": normal(256, s.embedding, scale=0.5), "W": normal(s.window * s.embedding, s.filters, scale=1 / np.sqrt(s.window * s.embedding)), "b": np.zeros(s.filters, np.float32),
            "H": normal(3 * s.filters + 1, s.hidden, scale=1 / np.sqrt(3 * s.filters)), "c": np.zeros(s.hidden, np.float32), "o": normal(s.hidden, scale=0.3), "d": np.zeros(1, np.float32),
        }

    def _windows(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(padded bytes, embedded windows) with a window at each stride, the last one reaching the end."""
        s = self.shape
        n = max(1, -(-max(0, len(buf) - s.window) // s.stride) + 1)
        padded = np.zeros((n - 1) * s.stride + s.window, np.uint8)
        padded[: len(buf)] = buf
        flat = self.p["E"][padded].reshape(-1)
        view = np.lib.stride_tricks.as_strided(flat, (n, s.window * s.embedding), (s.stride * s.embedding * flat.itemsize, flat.itemsize))
        return padded, view

    def _chunks(self, n: int) -> list[tuple[int, int]]:
        """Overlapping chunks of windows that cover all n."""
        s = self.shape
        return [(a, min(n, a + s.chunk)) for a in range(0, max(1, n - (s.chunk - s.step)), s.step)]

    def pooled(self, buf: np.ndarray, strip: int = 1 << 18) -> np.ndarray:
        """The document's 3 * filters pooled values and log length; strips overlap as chunks do."""
        s = self.shape
        if not len(buf):
            return np.zeros(3 * s.filters + 1, np.float32)
        most, least, total, count = np.full(s.filters, -np.inf, np.float32), np.full(s.filters, np.inf, np.float32), np.zeros(s.filters, np.float64), 0
        per = max(1, strip // (s.step * s.stride)) * s.step
        n = max(1, -(-max(0, len(buf) - s.window) // s.stride) + 1)
        for first in range(0, max(1, n - (s.chunk - s.step)), per):
            last = min(n, first + per + s.chunk - s.step)
            _, view = self._windows(buf[first * s.stride : (last - 1) * s.stride + s.window])
            a = np.maximum(view @ self.p["W"] + self.p["b"], 0)
            starts = np.arange(0, max(1, len(a) - (s.chunk - s.step)), s.step)
            head = np.maximum.reduceat(a, starts, axis=0)  # from a start up to the next one
            tails = np.array([a[x + s.step : x + s.chunk].max(axis=0, initial=0) for x in starts])
            m = np.maximum(head, tails)
            most, least, total, count = np.maximum(most, m.max(0)), np.minimum(least, m.min(0)), total + m.sum(0), count + len(m)
        return np.concatenate((most, total / count, least, [np.log1p(len(buf)) / 8])).astype(self.p["W"].dtype)

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        p = self.p
        z = np.maximum(pooled @ p["H"] + p["c"], 0) @ p["o"] + p["d"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def _backward(self, bufs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        s, p = self.shape, self.p
        f = s.filters
        kept, rows = [], []
        for buf in bufs:
            if not len(buf):
                kept.append(None)
                rows.append(np.zeros(3 * f + 1, p["W"].dtype))
                continue
            padded, view = self._windows(buf)
            a = view @ p["W"] + p["b"]
            chunks = self._chunks(len(a))
            at = np.array([x + a[x:y].argmax(0) for x, y in chunks])
            m = np.maximum(np.take_along_axis(a, at, 0), 0)
            top, low = m.argmax(0), m.argmin(0)
            rows.append(np.concatenate((m[top, range(f)], m.mean(0), m[low, range(f)], [np.log1p(len(buf)) / 8])).astype(p["W"].dtype))
            kept.append((padded, view, at, m, top, low))
        x = np.array(rows)
        h = np.maximum(x @ p["H"] + p["c"], 0)
        z = h @ p["o"] + p["d"]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weights / len(bufs)).astype(p["W"].dtype)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"], g["d"] = h.T @ dz, dz.sum(keepdims=True)
        dh = np.outer(dz, p["o"]) * (h > 0)
        g["H"], g["c"] = x.T @ dh, dh.sum(0)
        dx = dh @ p["H"].T
        for i, k in enumerate(kept):
            if k is None:
                continue
            padded, view, at, m, top, low = k
            dm = np.tile(dx[i, f : 2 * f] / len(m), (len(m), 1))
            np.add.at(dm, (top, np.arange(f)), dx[i, :f])
            np.add.at(dm, (low, np.arange(f)), dx[i, 2 * f : 3 * f])
            dm *= m > 0
            places, back = np.unique(at, return_inverse=True)
            da = np.zeros((len(places), f), p["W"].dtype)
            np.add.at(da, (back.reshape(at.shape), np.arange(f)), dm)
            g["W"] += view[places].T @ da
            g["b"] += da.sum(0)
            de = (da @ p["W"].T).reshape(-1, s.embedding)
            np.add.at(g["E"], padded[(places[:, None] * s.stride + np.arange(s.window)).reshape(-1)], de)
        return g

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = 6, least_steps: int = 400, batch: int = 32, rate: float = 4e-3, seed: int = 0) -> ByteConvNet:
        """Adam on class-balanced cross-entropy, more epochs where rows are few; one class only: its prior."""
        y = np.asarray(labels, np.float32)
        if len(y) == 0 or y.min() == y.max():
            self.p["o"][:] = 0
            self.p["d"][:] = 0 if len(y) == 0 else (4.0 if y[0] else -4.0)
            return self
        share = y.mean()
        weights = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        bufs, r = [np.frombuffer(t, np.uint8) for t in texts], np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        steps = -(-len(y) // batch)
        epochs = max(epochs, -(-least_steps // steps))
        total = epochs * steps
        for _ in range(epochs):
            order = r.permutation(len(y))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                g = self._backward([bufs[i] for i in own], y[own], weights[own])
                t += 1
                now = rate * min(1, 2 * (1 - (t - 1) / total))
                for k, x in self.p.items():
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.01 * (g[k] ** 2 - v[k])
                    x -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 4000, max_bytes: int = 12 << 20, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape(), **options) -> ByteConvNet:
    """Train on labels (doc_id, label 0 or 1).

    The documents of the first max_rows labels by hash are read once; rows alike in id, text and label count as
    one, and of the others the first max_rows by hash are taken as long as max_bytes allow."""
    spark = documents.sparkSession
    clean = labels.select(F.col("doc_id").cast("long").alias("_label_id"), F.col("label").cast("int").alias("_label")).filter("_label_id is not null and _label is not null")
    some = clean.orderBy(F.xxhash64("_label_id"), "_label_id", "_label").limit(max_rows)  # at most max_rows small rows: broadcast
    docs = documents.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    joined = docs.join(F.broadcast(some), F.col("_id") == F.col("_label_id")).select(F.xxhash64("_id").alias("_h"), "_id", F.xxhash64("_text").alias("_digest"), "_label", F.octet_length("_text").alias("_size"), "_text")
    joined = _store.saved(joined, f"{_store.work_dir(spark, 'labelled')}/rows")
    # sizes first, so that no more than max_bytes of text come to the driver
    key = ["_h", "_id", "_digest", "_label"]
    sizes = joined.groupBy(*key).agg(F.max("_size").alias("_size")).orderBy(*key).limit(max_rows).collect()
    chosen, used = [], 0
    for r in sizes:
        if used + r._size <= max_bytes:
            chosen.append((r._h, r._id, r._digest, r._label))
            used += r._size
    chosen = spark.createDataFrame(chosen, "_h long, _id long, _digest long, _label int")
    rows = sorted(joined.join(F.broadcast(chosen), key, "left_semi").dropDuplicates(key).select(*key, "_text").collect())
    return ByteConvNet(shape).fit([r._text.encode() for r in rows], [r._label for r in rows], **options)


def score(documents: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score), a row for each row of documents."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch, scores in _scored(net, batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def _scored(net: ByteConvNet, batches, text_col: str):
    """(rows, their scores), some rows at a time."""
    for whole in batches:
        for batch in _text.pieces(whole, text_col):
            buf, at = _text.utf8(batch.column(text_col))
            pooled = np.array([net.pooled(buf[a:b]) for a, b in zip(at, at[1:])]).reshape(batch.num_rows, -1)
            yield batch, pa.array(net.scores(pooled) if batch.num_rows else np.zeros(0))


def keep_good(documents: DataFrame, net: ByteConvNet, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that score threshold or more; each row by its own text, in the pass that scores it."""
    names = documents.columns
    plain = documents.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for batch, scores in _scored(net, batches, "text"):
            yield batch.select([f"c{i}" for i in range(len(names))]).filter(pc.greater_equal(scores, threshold))

    schema = plain.select(*[f"c{i}" for i in range(len(names))]).schema
    kept = plain.mapInArrow(run, schema)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
