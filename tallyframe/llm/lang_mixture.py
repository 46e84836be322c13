"""Language identification by a mixture of languages, estimated for each document.

Byte trigrams inside words, counted for each language over a bounded sample of labelled training documents, give every
word a log-likelihood under each language. Blocks of a few words are a document's observations; expectation-
maximisation estimates the languages' proportions. Languages enter the document's set in order of proportion as long
as the likelihood, refitted on the set, gains more than the penalty (sets of two and three are always tried); the
set may hold every language.

Cases: a text that is null, empty or without a letter is ``und`` with score 0; with no training language all are
``und``; whole texts of any length are read; ties go to the alphabetically first language; repeated rows get the same
answer; a null doc_id is kept, with a null held_out; other columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, in_small_batches, tidied
from .words import WORD, WordTable, joined_bytes

_LETTER = re.compile(r"[^\W\d_]")
BUCKETS = 1 << 16


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all words (marked at both ends) and where each word's begin."""
    b, starts = joined_bytes([w.lower() for w in words])
    x = b.astype(np.uint32)
    return ((x[:-2] * 65599 + x[1:-1]) * 65599 + x[2:] ^ x[1:-1] * 40503) % BUCKETS, starts


def count_grams(docs: DataFrame) -> DataFrame:
    """Trigram counts by language: lang, bucket, n. A task adds up its own counts, so it sends a row at most for each language and bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if words := WORD.findall(text):
                    grams, _ = _trigrams(words)
                    c = total.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    np.add.at(c, grams, 1)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

    partial = docs.select("text", "lang").mapInArrow(tidied(count), "lang string, bucket int, n bigint")
    return partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def log_shares(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of count_grams, in alphabetical order, and the log-probabilities (bucket, language) of trigrams."""
    table = counts.toArrow()  # at most the languages times BUCKETS
    langs = sorted(set(table["lang"].to_pylist()))
    total = np.full((BUCKETS, len(langs)), 0.05)
    place = {x: k for k, x in enumerate(langs)}
    total[table["bucket"].to_numpy(), [place[x] for x in table["lang"].to_pylist()]] += table["n"].to_numpy()
    return langs, np.log(total / total.sum(0)).astype(np.float32)


def train(docs: DataFrame, sample: int = 6000) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (bucket, language), from about ``sample`` labelled documents of folds 1 to 4."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where((fold_of(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    by_lang = rows.groupBy("lang").count().collect()
    if not by_lang:
        return [], np.zeros((BUCKETS, 0))
    each = max(1, sample // len(by_lang))
    step = F.create_map(*[F.lit(x) for r in by_lang for x in (r["lang"], max(1, r["count"] // each))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), step[F.col("lang")]) == 0)
    return log_shares(count_grams(chosen))


def fit_mixtures(blocks: np.ndarray, weight: np.ndarray, start: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once: proportions (document, language) and log-likelihoods.

    blocks: log-likelihoods (block, language), weight: words in each block, start: each document's first block. A
    language with -inf in all of a document's blocks stays out of its mixture.
    """
    top = blocks.max(1, keepdims=True)
    like = np.exp(blocks - top)
    allowed = np.add.reduceat(like, start) > 0
    mix = allowed / allowed.sum(1, keepdims=True)
    sizes = np.diff(np.append(start, len(blocks)))
    total = np.add.reduceat(weight, start)[:, None]
    for k in range(rounds + 1):
        joint = like * np.repeat(mix, sizes, axis=0)
        norm = joint.sum(1, keepdims=True)
        if k == rounds:
            return mix, np.add.reduceat((np.log(np.maximum(norm, 1e-300)) + top)[:, 0], start)
        mix = np.add.reduceat(joint / np.maximum(norm, 1e-300) * weight[:, None], start) / total


def choose(blocks: np.ndarray, weight: np.ndarray, start: np.ndarray, penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's best language, its proportion, and the size of the chosen set."""
    mix, _ = fit_mixtures(blocks, weight, start)
    rank = np.argsort(np.argsort(-mix, axis=1, kind="stable"), axis=1)
    sizes = np.diff(np.append(start, len(blocks)))
    cost = penalty * np.log(sizes + 1.0)
    chosen = np.ones(len(start), dtype=np.int64)
    best, value = np.full(len(start), -np.inf), mix
    growing = np.arange(len(start))  # documents whose last language gained
    for j in range(1, mix.shape[1] + 1):
        n = sizes[growing]
        if not len(growing):
            break
        first = np.cumsum(n) - n
        rows = np.repeat(start[growing] - first, n) + np.arange(n.sum())
        few = np.where(np.repeat(rank[growing], n, axis=0) < j, blocks[rows], -np.inf)
        part, like = fit_mixtures(few, weight[rows], first, 1 if j == 1 else 10)
        gain = like - cost[growing] * (j - 1)
        better = gain > best[growing]
        # a second language may gain only together with a third, so a set of one is always tried with both
        best[growing[better]], chosen[growing[better]], value[growing[better]] = gain[better], j, part[better]
        growing = growing[better] if j > 2 else growing
    return value.argmax(1), value.max(1), chosen


def predictor(model: tuple[list[str], np.ndarray], block_words: int = 8):
    """A function of texts: their languages, scores and sizes of the chosen sets."""
    langs, logp = model

    def rows_of(words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(langs)), dtype=np.float32)
        grams, starts = _trigrams(words)
        return np.add.reduceat(logp[grams[: starts[-1] + len(words[-1].lower().encode("utf-8", "surrogatepass"))]], starts).astype(np.float32)

    table = WordTable(rows_of, 150_000)

    def predict(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        n = len(texts)
        known = np.array([bool(t and langs and _LETTER.search(t)) for t in texts], dtype=bool)
        pred, score, size = ["und"] * n, np.zeros(n), np.zeros(n, dtype=np.int64)
        if known.any():
            words = [WORD.findall(texts[i]) for i in np.flatnonzero(known)]
            at = table.look(words)
            counts = np.array([len(w) for w in words])
            n_blocks = -(-counts // block_words)
            start = np.concatenate([[0], np.cumsum(n_blocks)[:-1]])
            inside = np.arange(n_blocks.sum()) - np.repeat(start, n_blocks)
            cuts = np.repeat(np.cumsum(counts) - counts, n_blocks) + inside * block_words
            blocks = np.add.reduceat(table.rows[at], cuts).astype(np.float64)
            weight = np.diff(np.append(cuts, len(at))).astype(np.float64)
            k, s, j = choose(blocks, weight, start)
            for i, x in zip(np.flatnonzero(known), k):
                pred[i] = langs[x]
            score[known], size[known] = np.clip(s, 0, 1), j
        return pred, score, size

    return predict


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, n_langs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 400):
                some = batch.slice(a, 400)
                pred, score, size = predict(some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(pred, pa.string()), pa.array(score), pa.array(size)], names=["doc_id", "held_out", "lang_pred", "score", "n_langs"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold_of(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id bigint, held_out boolean, lang_pred string, score double, n_langs bigint")


def keep_identified(docs: DataFrame, least_score: float = 0.4) -> DataFrame:
    """The documents, all columns, whose text has a language that makes up least_score of it or more."""
    in_small_batches(docs.sparkSession)
    model, place = train(docs), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 400):
                some = batch.slice(a, 400)
                pred, score, _ = predict(some.column(place).to_pylist())
                yield some.filter(pa.array([p != "und" and s >= least_score for p, s in zip(pred, score)]))

    return docs.mapInArrow(tidied(run), docs.schema)


def identify_languages(docs: DataFrame) -> DataFrame:
    """Trains on the labelled documents outside fold 0 and predicts for every document."""
    in_small_batches(docs.sparkSession)
    return identify(docs, train(docs))
