"""Toxicity by a convolutional text classifier, trained in numpy.

A word (lower-cased, outer punctuation off) and its first 3, 5 and 7 letters are hashed to buckets with an embedding
each, and their sum is the word's vector; filters of several widths run over the word sequence, and each filter's
largest value in the text goes to a logistic output. Buckets met in fewer than ``least_docs`` training documents share one zero embedding, so rare words
can't be learned by heart. The threshold is calibrated for each language, which is guessed from the text's words,
never read; a score is the logistic of the raw output less its language's threshold, so 0.5 is every language's
threshold.

The classifier is fitted on at most ``most_toxic`` and ``most_clean`` labelled documents outside fold 0 (a bounded
sample, chosen by a hash of the id; documents of over ``longest`` characters are left out of it). Thresholds are chosen
on every labelled document outside fold 0 that was not fitted on, from counts by language and ``STEP`` of the raw
output; a language with fewer than ``least_calibration`` documents of either kind takes the threshold of all languages,
and with fewer than ``least_toxic`` toxic ones in all there is nothing to choose by: scores then keep their order, but
stay under 0.5. Every document is scored, over its whole text.

Cases: null or empty text gets the score of no words; without labels of both kinds every score is 0; texts of any
length are scored whole; a document with several labels counts as toxic if one says so; repeated documents get the same
score; a null doc_id is scored, with a null held_out; null labels are ignored; other columns are ignored, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, fresh, hand_back, in_small_batches, materialise, small, tidied
from .lang_mixture import BUCKETS as GRAMS
from .lang_mixture import _trigrams, count_grams, log_shares
from .words import WORD, WordTable

WIDTHS, FILTERS, SIZE, BUCKETS = (1, 2, 3), 12, 16, 1 << 17
STARTS = (3, 5, 7)
#: The width of the bins of raw output that thresholds are chosen by.
STEP = 1 / 64
_OUTER = "\"'.,;:!?()[]{}<>#*$%&|"


def buckets_of(word: str) -> list[int]:
    """The buckets of a word and of its beginnings."""
    w = word.lower().strip(_OUTER)
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (w, *(f"{k} {w[:k]}" for k in STARTS))]


class Cnn:
    """Embeddings, filters and output weights, with Adam steps on the logistic loss."""

    def __init__(self, n_embeddings: int, seed: int = 7):
        r, places = np.random.default_rng(seed), sum(WIDTHS)
        self.p = {"e": r.normal(0, 0.05, (n_embeddings, SIZE)), "w": r.normal(0, 0.3, (SIZE, places, FILTERS)), "b": np.zeros(len(WIDTHS) * FILTERS), "o": r.normal(0, 0.1, len(WIDTHS) * FILTERS), "c": np.zeros(1)}
        self.p["e"][0] = 0
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def taps(self, ids: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each of its places, of all widths: (word, place * filter)."""
        return self.p["e"][ids].sum(1) @ self.p["w"].reshape(SIZE, -1)

    def pooled(self, taps: np.ndarray, start: np.ndarray, places: bool = False):
        """Each text's greatest filter values, and where they are. taps: of the texts' words, each text followed by zeros enough for the widest filter."""
        tops, where, at = [], [], 0
        ends = np.append(start[1:], len(taps))
        for j, w in enumerate(WIDTHS):
            h = taps[:, at : at + FILTERS].copy()
            for k in range(1, w):
                h[:-k] += taps[k:, at + k * FILTERS : at + (k + 1) * FILTERS]
            for k in range(1, w):
                h[ends - k] = 0  # these would reach into the next text
            at += w * FILTERS
            top = np.maximum.reduceat(h, start)
            tops.append(np.maximum(top + self.p["b"][j * FILTERS : (j + 1) * FILTERS], 0))
            if places:
                who = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(taps))))
                back = np.arange(len(taps), 0, -1)[:, None]
                where.append(len(taps) - np.maximum.reduceat(np.where(h == top[who], back, 0), start))
        return np.concatenate(tops, axis=1), where

    def raw(self, taps: np.ndarray, start: np.ndarray) -> np.ndarray:
        return self.pooled(taps, start)[0] @ self.p["o"] + self.p["c"]

    def step(self, ids: np.ndarray, start: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float, decay: float) -> None:
        top, where = self.pooled(self.taps(ids), start, places=True)
        d = weight * (1 / (1 + np.exp(-(top @ self.p["o"] + self.p["c"]))) - y) / len(y)
        g = {"o": top.T @ d, "c": d.sum(keepdims=True)} | {k: np.zeros_like(self.p[k]) for k in ("e", "w", "b")}
        dt = d[:, None] * self.p["o"] * (top > 0)
        for j, w in enumerate(WIDTHS):
            first = sum(WIDTHS[:j])
            dw = dt[:, j * FILTERS : (j + 1) * FILTERS]
            here = ids[np.minimum(where[j][:, :, None] + np.arange(w), len(ids) - 1)]  # text, filter, place, bucket
            vectors = self.p["e"][here].sum(3)
            g["w"][:, first : first + w] += np.einsum("nf,nfps->spf", dw, vectors)
            g["b"][j * FILTERS :][:FILTERS] += dw.sum(0)
            to_words = np.einsum("nf,spf->nfps", dw, self.p["w"][:, first : first + w])
            np.add.at(g["e"], here, np.broadcast_to(to_words[:, :, :, None], (*here.shape, SIZE)))
        self.t += 1
        for k, v in g.items():
            v = v + decay * self.p[k]
            self.m[k] += 0.1 * (v - self.m[k])
            self.v[k] += 0.001 * (v * v - self.v[k])
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
        self.p["e"][0] = 0


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' rows of buckets one after another, with gaps between texts, and where each text starts."""
    gap = np.zeros((max(WIDTHS), 1 + len(STARTS)), dtype=np.int32)
    flat = [y for x in texts for y in (x, gap)]
    start = np.concatenate([[0], np.cumsum([len(x) + len(gap) for x in texts])[:-1]]).astype(np.int64)
    return np.concatenate(flat), start


def threshold(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap at which F1 is greatest."""
    order = np.argsort(-raw, kind="stable")
    r, hit, w = raw[order], y[order] > 0, weight[order]
    good, all_ = np.cumsum(w * hit), np.cumsum(w)
    f1 = 2 * good / (all_ + (w * hit).sum())
    f1[:-1][r[1:] == r[:-1]] = -1
    k = int(f1.argmax())
    return float((r[k] + r[k + 1]) / 2) if k + 1 < len(r) else float(r[k] - 1)


def weight_of_evidence(texts: list[np.ndarray], y: np.ndarray, active: np.ndarray) -> np.ndarray:
    """How surely each active bucket goes with toxic documents: its log odds ratio in standard errors, less 2, from 0 up."""
    toxic, every = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for t, k in zip(texts, y):
        u = np.unique(t)
        every[u] += 1
        toxic[u] += k
    a, n1, n0 = toxic[active], y.sum(), (y == 0).sum()
    c = every[active] - a
    odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((c + 0.5) / (n0 - c + 0.5))
    return np.maximum(odds / np.sqrt(1 / (a + 0.5) + 1 / (c + 0.5)) - 2, 0)


def fit(texts: list[np.ndarray], y: np.ndarray, least_docs: int = 4, epochs: int = 10) -> tuple[Cnn, np.ndarray]:
    """The network fitted on texts (rows of buckets) and their marks, and the embedding of each bucket.

    The first value of an embedding starts as the bucket's weight of evidence and the first filter as its reader, so
    that a few dozen toxic documents suffice; all are trained from there.
    """
    df = np.zeros(BUCKETS, dtype=np.int64)
    for t in texts:
        df[np.unique(t)] += 1
    active = np.flatnonzero(df >= least_docs)
    index = np.zeros(BUCKETS, dtype=np.int32)
    index[active] = np.arange(1, len(active) + 1)
    rows = [index[t] for t in texts]
    net, r = Cnn(len(active) + 1), np.random.default_rng(5)
    net.p["e"][1:, 0] += weight_of_evidence(texts, y, active)
    net.p["w"][:, 0, 0] = np.eye(SIZE)[0]
    net.p["o"][0] = 1
    net.p["c"][:] = -1
    at = np.arange(len(y))
    balance = np.where(y > 0, (y == 0).sum() / max(1, (y > 0).sum()), 1.0) ** 0.5
    per = -(-len(at) // 32)
    steps = max(epochs * per, 300)
    for s in range(steps):
        if s % per == 0:
            r.shuffle(at)
        some = at[(s % per) * 32 :][:32]
        net.step(*laid_out([rows[i] for i in some]), y[some], balance[some], 0.002 * (1 - s / steps) + 0.0001, 1e-4)
    return net, index


def marks_of(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labelled documents outside fold 0."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    return marks.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def train(docs: DataFrame, marks: DataFrame, most_toxic: int = 1200, most_clean: int = 2000, longest: int = 50_000) -> dict | None:
    """The fitted model, or None without marked documents of both kinds."""
    key = F.xxhash64("doc_id", F.lit(11))
    chosen = marks.where(F.col("toxic") == 1).orderBy(key).limit(most_toxic).union(marks.where(F.col("toxic") == 0).orderBy(key).limit(most_clean))
    got = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).join(F.broadcast(chosen), "doc_id").where("text is not null")  # at most most_toxic + most_clean ids
    rows = got.where(F.length("text") <= longest).select("doc_id", "text", "toxic").orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id", "text").collect()
    if len({r["toxic"] for r in rows}) < 2:
        return None
    names, langs = log_shares(count_grams(got.where(F.col("lang").isNotNull())))
    if not names:
        langs = np.zeros((GRAMS, 1), dtype=np.float32)
    texts = [np.array([buckets_of(w) for w in WORD.findall(r["text"])], dtype=np.int32).reshape(-1, 1 + len(STARTS)) for r in rows]
    y = np.array([r["toxic"] for r in rows], dtype=float)
    held = np.arange(len(y)) % 4 == 0
    if len(set(y[~held])) < 2:
        held = np.zeros(len(y), dtype=bool)
    net, index = fit([t for t, h in zip(texts, held) if not h], y[~held])
    fitted = sorted({int(r["doc_id"]) for r, h in zip(rows, held) if not h})
    del rows, texts
    hand_back()  # the driver goes on with what follows
    return {"net": net.p, "index": index, "langs": langs, "fitted": fitted}


def raw_outputs(docs: DataFrame, model: dict, raw: str, lang: str) -> DataFrame:
    """docs, which have a column text, with the network's output and the guessed language (its number) of each row; texts come out empty (null stays null)."""
    place = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(raw, T.DoubleType()), T.StructField(lang, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outputs = scorer(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 80):
                some = batch.slice(a, 80)
                texts = some.column(place).to_pylist()
                out, which = outputs(texts)
                columns = [pa.array([None if t is None else "" for t in texts], pa.string()) if k == place else c for k, c in enumerate(some.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out.astype(float)), pa.array(which.astype(np.int32))], names=[*some.schema.names, raw, lang])

    return docs.mapInArrow(tidied(run), schema)


def calibration_counts(outputs: DataFrame, marks: DataFrame, fitted: list[int], raw: str = "raw", lang: str = "which") -> np.ndarray:
    """Language, bin of raw output, toxic, number of documents (rows): all marked documents with a text but the fitted ones."""
    spark = outputs.sparkSession
    marks = marks.join(F.broadcast(spark.createDataFrame([(i,) for i in fitted], "doc_id bigint")), "doc_id", "left_anti")
    rows = outputs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(lang).alias("lang"), F.floor(F.col(raw) / STEP).alias("bin"))
    return np.array([tuple(r) for r in rows.join(marks, "doc_id").groupBy("lang", "bin", "toxic").count().collect()], dtype=np.int64).reshape(-1, 4)


def cut_column(cuts: np.ndarray | None, raw: Column, lang: Column) -> Column:
    """The score: the logistic of what an output is over its language's threshold; under 0.5 without thresholds."""
    if cuts is None:
        return 0.49 / (1 + F.exp(-raw))
    return 1 / (1 + F.exp(F.get(F.array(*[F.lit(float(c)) for c in cuts]), lang) - raw))


def cuts_of(counts: np.ndarray, n: dict[int, int], n_langs: int, least_calibration: int = 20, least_toxic: int = 5) -> np.ndarray | None:
    """Each language's threshold, or None with too few toxic documents to choose any. n: all labelled documents of each kind, whose proportion the counts are weighted to."""
    lang, at, y, count = counts.T
    if count[y > 0].sum() < least_toxic or not (y == 0).any():
        return None
    middle = (at + 0.5) * STEP
    weight = count * np.where(y > 0, n[1] / count[y > 0].sum(), n[0] / count[y == 0].sum())
    cuts = np.full(n_langs, threshold(middle, y, weight))
    for k in range(n_langs):
        here = lang == k
        if min(count[here & (y > 0)].sum(), count[here & (y == 0)].sum()) >= least_calibration:
            cuts[k] = threshold(middle[here], y[here], weight[here])
    return cuts


def lang_rows(words: list[str], langs: np.ndarray) -> np.ndarray:
    """The log-likelihood of each word under each language."""
    grams, starts = _trigrams(words)
    return np.add.reduceat(langs[grams[: starts[-1] + len(words[-1].lower().encode("utf-8", "surrogatepass"))]], starts)


def scorer(model: dict):
    """A function of texts: their raw outputs and languages."""
    net = Cnn(1)
    net.p = model["net"]
    langs, n_taps, gap = model["langs"], sum(WIDTHS) * FILTERS, max(WIDTHS)

    def rows_of(new: list[str]) -> np.ndarray:
        if not new:
            return np.zeros((0, n_taps + langs.shape[1]), dtype=np.float32)
        ids = model["index"][np.array([buckets_of(w) for w in new])]
        return np.concatenate([net.taps(ids), lang_rows(new, langs)], axis=1).astype(np.float32)

    known = WordTable(rows_of, 80_000)

    def outputs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words = [WORD.findall(t or "") for t in texts]
        at = known.look(words)
        counts = np.array([len(w) for w in words], dtype=np.int64)
        first = np.cumsum(counts) - counts
        x = np.zeros((len(at) + gap * len(words), n_taps), dtype=np.float32)
        sums = np.zeros((len(words), langs.shape[1]))
        if len(at):
            rows_here = known.rows[at]
            x[np.arange(len(at)) + gap * np.repeat(np.arange(len(words)), counts)] = rows_here[:, :n_taps]
            full = counts > 0
            sums[full] = np.add.reduceat(rows_here[:, n_taps:], first[full])
        return net.raw(x, first + gap * np.arange(len(words))), sums.argmax(1)

    return outputs


def keep_civil(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents, all columns, that are not scored as toxic. A narrow table of outputs is written between scoring and choosing; rows are told apart by 128 bits of hash."""
    in_small_batches(docs.sparkSession)
    marks = materialise(marks_of(labels), "marks")
    model = train(docs, marks, **how)
    if model is None:
        return docs
    text, one, two = F.col("text").cast("string"), fresh("one"), fresh("two")
    hashes = F.xxhash64("doc_id", text), F.xxhash64(F.lit(7), text, "doc_id")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), hashes[0].alias(one), hashes[1].alias(two))
    outputs = materialise(raw_outputs(rows, model, "raw", "which"), "outputs")
    score = cut_column(calibrated(outputs, marks, model), F.col("raw"), F.col("which"))
    toxic = materialise(outputs.where(score >= 0.5).select(one, two).distinct(), "toxic")
    return docs.join(small(toxic), (hashes[0] == F.col(one)) & (hashes[1] == F.col(two)), "left_anti")


def calibrated(outputs: DataFrame, marks: DataFrame, model: dict, raw: str = "raw", which: str = "which", least_calibration: int = 20, least_toxic: int = 5) -> np.ndarray | None:
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    return cuts_of(calibration_counts(outputs, marks, model["fitted"], raw, which), n, model["langs"].shape[1], least_calibration, least_toxic)


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Trains outside fold 0 and scores every document: doc_id, held_out, score, predicted."""
    in_small_batches(docs.sparkSession)
    marks = materialise(marks_of(labels), "marks")
    model = train(docs, marks, **how)
    ids = F.col("doc_id").cast("bigint")
    if model is None:
        return docs.select(ids.alias("doc_id"), (fold_of(ids) == 0).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    texts = docs.select(ids.alias("doc_id"), F.col("text").cast("string").alias("text"))
    outputs = materialise(raw_outputs(texts, model, "raw", "which"), "outputs")
    score = cut_column(calibrated(outputs, marks, model), F.col("raw"), F.col("which"))
    return outputs.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
