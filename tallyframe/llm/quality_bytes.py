"""Quality by a convolutional network over bytes, trained in numpy.

A document's UTF-8 bytes are cut in chunks of ``CELLS`` cells of ``CELL`` bytes, each chunk sharing half of its cells
with the next, over the whole text. A byte has an embedding (it starts from its character class), learned filters of
``WIDTH`` bytes run over every place, and each chunk keeps each filter's largest value. The document's vector is the
mean and the maximum of its chunks' values, and a logistic output makes it one probability. All of it is trained from
random filters by Adam steps on the logistic loss.

The network is fitted on at most ``most_each`` labelled documents of each kind outside the held-out fold, chosen by a
hash of the id, and on at most ``most_chunks`` chunks of each, evenly spaced over its whole text (a documented bound:
what the driver holds does not grow). In a third of its turns a document is stood for by one of its chunks, cut behind
a random place, so that short texts are learned too. The output's bias moves from the kinds' shares in the sample to
those among all labelled documents. Every document is scored over all its chunks.

Cases: null or empty text is one chunk of padding; without labels of both kinds every score is 0.5; a document of
several labels counts as good if all say so; null labels are ignored; repeated documents get the same score (in
training, of rows with one id the one with the least chunks' bytes counts); equal outputs get equal scores; a null
doc_id is scored, with a null held_out; texts of any length are scored whole, in slices; other columns are ignored,
whatever their names; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, hand_back, in_small_batches, tidied

CELL, CELLS, WIDTH, FILTERS, SIZE = 64, 4, 8, 16, 10
CHUNK, STRIDE = CELL * CELLS, CELL * CELLS // 2
FOLDS, HELD = 3, 1
SLICE = 1 << 18


def classes() -> np.ndarray:
    """How a byte's embedding starts: lower case, capital, digit, space, line end, mark, part of a longer character, padding."""
    b = np.arange(256)
    within = lambda a, z: (b >= ord(a)) & (b <= ord(z))
    lower, upper, digit, space, line, high = within("a", "z"), within("A", "Z"), within("0", "9"), (b == 32) | (b == 9), (b == 10) | (b == 13), b >= 128
    rest = ~(lower | upper | digit | space | line | high | (b == 0))
    out = np.random.default_rng(3).normal(0, 0.3, (256, SIZE))
    out[:, :8] += np.stack([lower, upper, digit, space, line, rest, high, b == 0], axis=1)
    return out


class ByteNet:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = {"e": classes(), "w": r.normal(0, 0.25, (WIDTH, SIZE, FILTERS)), "b": np.zeros(FILTERS), "o": r.normal(0, 0.2, 2 * FILTERS), "c": np.zeros(1)}
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def tops(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's largest filter values, and where they are. chunks: rows of CHUNK + WIDTH - 1 bytes."""
        x = self.p["e"][chunks].astype(np.float32)
        windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, :CHUNK].transpose(0, 1, 3, 2)
        h = windows.reshape(-1, WIDTH * SIZE) @ self.p["w"].astype(np.float32).reshape(-1, FILTERS)
        h = h.reshape(len(chunks), CHUNK, FILTERS)
        where = h.argmax(1)
        return np.take_along_axis(h, where[:, None], 1)[:, 0] + self.p["b"], where

    def combined(self, tops: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The documents' vectors from their chunks' values. start: each document's first chunk."""
        some = np.maximum(tops, 0)
        n = np.diff(np.append(start, len(tops)))[:, None]
        return np.concatenate([np.add.reduceat(some, start) / n, np.maximum.reduceat(some, start)], axis=1)

    def step(self, chunks: np.ndarray, start: np.ndarray, y: np.ndarray, rate: float, decay: float = 1e-4) -> None:
        tops, where = self.tops(chunks)
        v = self.combined(tops, start)
        n = np.diff(np.append(start, len(chunks)))
        d = (1 / (1 + np.exp(-(v @ self.p["o"] + self.p["c"]))) - y) / len(y)
        of = np.repeat(np.arange(len(y)), n)
        most = np.maximum(tops, 0) == v[of, FILTERS:]
        g = (d[of, None] * (self.p["o"][:FILTERS] / n[of, None] + self.p["o"][FILTERS:] * most)) * (tops > 0)
        bytes_ = np.take_along_axis(chunks[:, None, :], where[:, :, None] + np.arange(WIDTH), 2)  # chunk, filter, place
        gw = np.einsum("kf,kfws->wsf", g, self.p["e"][bytes_], optimize=True)
        to = g[:, :, None, None] * self.p["w"].transpose(2, 0, 1)  # chunk, filter, place, size
        ge = np.stack([np.bincount(bytes_.ravel(), to[..., s].ravel(), 256) for s in range(SIZE)], axis=1)
        self.t += 1
        for k, x in {"e": ge, "w": gw, "b": g.sum(0), "o": v.T @ d, "c": d.sum(keepdims=True)}.items():
            x = x + decay * self.p[k]
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def chunks_of(data: bytes, most: int | None = None) -> np.ndarray:
    """A document's chunks, or ``most`` of them evenly spaced, as rows; padded with zeros behind the text."""
    n = max(1, -(-(len(data) - CHUNK) // STRIDE) + 1)
    at = np.arange(n) if most is None or n <= most else np.linspace(0, n - 1, most).astype(np.int64)
    x = np.zeros(n * STRIDE + CHUNK + WIDTH, dtype=np.uint8)
    x[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return x[at[:, None] * STRIDE + np.arange(CHUNK + WIDTH - 1)]


def cut_short(chunks: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """One of a document's chunks, with nothing behind a random place."""
    out = chunks[r.integers(len(chunks))][None].copy()
    out[:, r.integers(4, CHUNK) :] = 0
    return out


def fit(docs: list[np.ndarray], y: np.ndarray, epochs: int = 14, batch: int = 24) -> ByteNet:
    net, r = ByteNet(), np.random.default_rng(2)
    steps = max(epochs * -(-len(docs) // batch), 300)
    order: list[int] = []
    for s in range(steps):
        if len(order) < batch:
            order = [*order, *r.permutation(len(docs)).tolist()]
        some, order = order[:batch], order[batch:]
        seen = [docs[i] if r.random() > 1 / 3 else cut_short(docs[i], r) for i in some]
        sizes = [len(x) for x in seen]
        net.step(np.concatenate(seen), np.cumsum(sizes) - sizes, y[some], 0.01 * (1 - s / steps) + 0.0005)
    return net


def scorer(p: dict[str, np.ndarray]):
    """A function of texts: their raw outputs. Filters are summed from tables over pairs of bytes, and chunks put together from their cells."""
    taps = np.einsum("bs,wsf->wbf", p["e"], p["w"]).astype(np.float32)
    pairs = [(taps[j][:, None] + taps[j + 1][None]).reshape(-1, FILTERS) for j in range(0, WIDTH, 2)]

    def cells(x: np.ndarray) -> np.ndarray:
        """Largest filter values of each cell; x has WIDTH bytes more than its cells."""
        n = len(x) - WIDTH
        code = x[:-1].astype(np.int32) << 8 | x[1:]
        h = pairs[0][code[:n]]
        for j in range(1, len(pairs)):
            h += pairs[j][code[2 * j : 2 * j + n]]
        return h.reshape(-1, CELL, FILTERS).max(1)

    def outputs(texts: list[str | None]) -> np.ndarray:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        n = np.array([max(1, -(-(len(b) - CHUNK) // STRIDE) + 1) for b in raw], dtype=np.int64)
        halves = n + 2  # half chunks of each text, and one of padding behind it
        x = np.zeros(int(halves.sum()) * STRIDE + WIDTH, dtype=np.uint8)
        first = np.cumsum(halves) - halves
        for b, k in zip(raw, first.tolist()):
            x[k * STRIDE : k * STRIDE + len(b)] = np.frombuffer(b, dtype=np.uint8)
        top = np.concatenate([cells(x[a : min(a + SLICE, len(x) - WIDTH) + WIDTH]) for a in range(0, len(x) - WIDTH, SLICE)])
        half = np.maximum(top[::2], top[1::2])
        chunk = np.maximum(half[:-1], half[1:])
        at = np.concatenate([np.arange(a, a + k) for a, k in zip(first.tolist(), n.tolist())])
        some = np.maximum(chunk[at] + p["b"], 0)
        start = np.cumsum(n) - n
        vectors = np.concatenate([np.add.reduceat(some, start) / n[:, None], np.maximum.reduceat(some, start)], axis=1)
        return (vectors * p["o"]).sum(1) + p["c"]  # row by row, so that equal texts get equal scores

    return outputs


def marks_of(labels: DataFrame) -> DataFrame:
    """doc_id, quality of the labelled documents outside the held-out fold."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD))
    return marks.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("quality"))


def _sampled(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = [chunks_of((t or "").encode("utf-8", "surrogatepass"), most).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(chunks, pa.binary())], names=["doc_id", "quality", "chunks"])

    return run


def train(docs: DataFrame, labels: DataFrame, most_each: int = 1000, most_chunks: int = 40) -> dict[str, np.ndarray] | None:
    """The fitted network, or None without labelled documents of both kinds."""
    marks, key = marks_of(labels), F.xxhash64("doc_id", F.lit(5))
    n = {r["quality"]: r["count"] for r in marks.groupBy("quality").count().collect()}
    chosen = marks.where("quality = 1").orderBy(key).limit(most_each).union(marks.where("quality = 0").orderBy(key).limit(most_each))
    got = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most twice most_each ids
    sampled = got.select("doc_id", "quality", "text").mapInArrow(_sampled(most_chunks), "doc_id bigint, quality int, chunks binary")
    rows = sampled.groupBy("doc_id", "quality").agg(F.min("chunks").alias("chunks")).orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id").collect()
    if len({r["quality"] for r in rows}) < 2:
        return None
    y = np.array([r["quality"] for r in rows], dtype=float)
    x = [np.frombuffer(r["chunks"], dtype=np.uint8).reshape(-1, CHUNK + WIDTH - 1) for r in rows]
    net = fit(x, y)
    net.p["c"] = net.p["c"] + np.log(n[1] / n[0]) - np.log(y.sum() / (y == 0).sum())
    hand_back()
    return net.p


def score_quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Trains outside the held-out fold and scores every document: doc_id, held_out, score, predicted."""
    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = fold_of(F.col("doc_id"), FOLDS) == HELD
    model = train(docs, labels, **how)
    if model is None:
        return rows.select("doc_id", held.alias("held_out"), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outputs = scorer(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                some = batch.slice(a, 64)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(1 / (1 + np.exp(-np.clip(outputs(some.column(1).to_pylist()), -500, 500))))], names=["doc_id", "score"])

    scored = rows.mapInArrow(tidied(run), "doc_id bigint, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
