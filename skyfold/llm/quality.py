"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte becomes a learned vector; learned
filters run over each chunk; the largest response of each filter in a chunk is kept (max-pooling), the chunks' responses
are averaged, and one linear unit makes a probability of them. The network sees bytes alone.

Fitting takes at most ``fit_rows`` labelled rows a class (those with the smallest hash of the id) and every chunk of
them; the unit's bias then gets the log odds of all labelled rows. Scoring covers every chunk of every row, inside a
task and without a shuffle.

Defined results: null and empty texts are one chunk of zero bytes, and get that chunk's score; null and repeated ids
are rows of their own (a repeated id is fitted once, on the least of its texts); labels without a quality or without a document are left out; without labels of both classes
every score is the share of label 1 (0.5 where there are none); an empty table gives no rows. Columns of the input
other than id and text are ignored by ``score`` and kept by ``accept``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import small_batches, text_bytes

CHUNK, HOP = 512, 448
DIM, WIDTH, STRIDE, FILTERS = 8, 8, 4, 32
THRESHOLD = 0.7


@dataclass
class Network:
    table: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH*DIM x FILTERS
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    constant: float | None = None

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """chunks x positions x FILTERS: two products, as a filter is two strides wide."""
        x = self.table[chunks].reshape(len(chunks), CHUNK // STRIDE, STRIDE * DIM)
        half = STRIDE * DIM
        first, second = x @ self.filters[:half], x @ self.filters[half:]
        return first[:, :-1] + second[:, 1:]

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        return np.maximum(self.responses(chunks).max(axis=1) + self.bias, 0)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    def score(self, texts: list[bytes], block: int = 512) -> np.ndarray:
        """One probability a text; memory is bounded by ``block`` chunks however long a text is."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        counts = np.array([n_chunks(len(t)) for t in texts], np.int64)
        sums = np.zeros(len(texts))
        held, owners = [], []
        for k, text in enumerate(texts):
            for c in range(counts[k]):
                held.append(chunk(text, c))
                owners.append(k)
                if len(held) == block:
                    self._add(sums, held, owners)
                    held, owners = [], []
        if held:
            self._add(sums, held, owners)
        return self.probability(sums / np.maximum(counts, 1) + self.offset)

    def _add(self, sums: np.ndarray, held: list[bytes], owners: list[int]) -> None:
        chunks = np.frombuffer(b"".join(held), np.uint8).reshape(-1, CHUNK)
        np.add.at(sums, owners, (self.pooled(chunks) @ self.weights).astype(float))


def n_chunks(n_bytes: int) -> int:
    return 1 + max(0, -(-(n_bytes - CHUNK) // HOP))


def chunk(text: bytes, c: int) -> bytes:
    """Chunk number c. The last one ends with the text; a text shorter than a chunk is repeated, an empty one is zeros."""
    if len(text) < CHUNK:
        return ((text + b"\n") * (CHUNK // (len(text) + 1) + 1))[:CHUNK] if text else bytes(CHUNK)
    at = min(c * HOP, len(text) - CHUNK)
    return text[at : at + CHUNK]


def fit(chunks: np.ndarray, owners: np.ndarray, labels: np.ndarray, seed: int = 7, epochs: int = 10, rate: float = 0.01, batch: int = 48) -> Network:
    """Adam on the log loss of whole rows; ``owners`` gives the row of each chunk, rows in order."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (256, DIM)).astype(np.float32), rng.normal(0, 0.15, (WIDTH * DIM, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, FILTERS).astype(np.float32), 0.0)
    offset = np.zeros(1, np.float32)
    held = [net.table, net.filters, net.bias, net.weights, offset]
    means, squares, step = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    starts = np.searchsorted(owners, np.arange(len(labels) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            own = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
            row_of = np.repeat(np.arange(len(rows)), starts[rows + 1] - starts[rows])
            share = (1 / (starts[rows + 1] - starts[rows]))[row_of].astype(np.float32)
            x = chunks[own]
            out = net.responses(x)
            best = out.argmax(axis=1)  # chunks x FILTERS
            top = np.take_along_axis(out, best[:, None], 1)[:, 0] + net.bias
            act = np.maximum(top, 0)
            logits = np.bincount(row_of, (act @ net.weights) * share, len(rows)) + offset[0]
            slope = ((net.probability(logits) - labels[rows]) / len(rows)).astype(np.float32)
            chunk_slope = slope[row_of] * share
            grad_act = chunk_slope[:, None] * net.weights * (top > 0)
            windows = x[np.arange(len(x))[:, None, None], (best * STRIDE)[:, :, None] + np.arange(WIDTH)]  # bytes of the best windows
            vectors = net.table[windows].reshape(len(x), FILTERS, WIDTH * DIM)
            grad_filters = np.einsum("cf,cfk->kf", grad_act, vectors)
            grad_vectors = (grad_act[:, :, None] * net.filters.T[None]).reshape(-1, DIM)
            grad_table = np.stack([np.bincount(windows.ravel(), grad_vectors[:, d], 256) for d in range(DIM)], 1)
            grads = [grad_table, grad_filters, grad_act.sum(0), act.T @ chunk_slope, slope.sum(keepdims=True)]
            step += 1
            for p, g, m, s in zip(held, grads, means, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.offset = float(offset[0])
    return net


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[chunk(text, c) for c in range(n_chunks(len(text)))] for text in text_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.binary()))], ["doc_id", "label", "chunks"])


def train(docs: DataFrame, labels: DataFrame, label_column: str = "quality", fit_rows: int = 1500, id_column: str = "doc_id", text_column: str = "text") -> Network:
    """Fits on at most fit_rows labelled rows a class. ``labels`` holds the rows to learn from, and no others."""
    known = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    order = [F.xxhash64("doc_id"), "doc_id"]
    counts = dict(known.groupBy("label").count().collect())
    chosen = known.filter("label = 0").orderBy(*order).limit(fit_rows).union(known.filter("label = 1").orderBy(*order).limit(fit_rows))
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # 2 * fit_rows rows at most
    rows = found.mapInArrow(_chunk_rows, "doc_id long, label int, chunks array<binary>").toArrow()
    rows = sorted(zip(rows["doc_id"].to_pylist(), rows["label"].to_pylist(), rows["chunks"].to_pylist(), strict=True), key=lambda r: (r[0], r[1], r[2]))
    target = np.array([r[1] for r in rows], np.float32)
    if not 0 < target.sum() < len(target):
        total = sum(counts.values())
        return Network(*[np.zeros(0)] * 4, 0.0, constant=counts.get(1, 0) / total if total else 0.5)
    chunks = np.frombuffer(b"".join(c for r in rows for c in r[2]), np.uint8).reshape(-1, CHUNK)
    net = fit(chunks, np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows]), target)
    net.offset += float(np.log(counts[1] / counts[0]) - np.log(target.sum() / (len(target) - target.sum())))
    return net


def _scores(net: Network, column: pa.Array) -> pa.Array:
    return pa.array(net.score(text_bytes(column)), pa.float64())


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score and predicted (1 from the threshold on) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _scores(net, batch.column(1))], ["doc_id", "score"])

    rows = small_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accept(docs: DataFrame, net: Network, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with their own columns."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(net.score(text_bytes(batch.column(at))) >= threshold))

    return small_batches(docs).mapInArrow(run, docs.schema)


def learnable(labels: DataFrame, id_column: str = "doc_id", fold: int = 2, folds: int = 4) -> DataFrame:
    """Labels of rows outside the held-out fold: crc32 of the id's decimal digits, modulo folds."""
    return labels.filter(held_out(F.col(id_column), fold, folds) == F.lit(False))


def held_out(doc_id, fold: int = 2, folds: int = 4):
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold
