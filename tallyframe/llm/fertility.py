"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback tokenises each word by itself; per document that gives characters per token,
the share of byte-fallback tokens and the token entropy as a share of the most that so many tokens can have. Over all
documents of a language (of a script, where the language is null) and of one size class (powers of two of the word
count: both the level and the scatter of the measures depend on it) exact quartiles of each measure give a rejection
band, quartiles +- ``width`` interquartile ranges; a document outside a band is rejected, as is one that breaks the
base rules. Classes of under ``least_docs`` documents take the band of their language over all sizes, if that has as many.

Cases: null or empty text has no words, fails the base rules and has null measures; short documents of under
``least_tokens`` tokens are judged by the base rules only; whole texts of any length are read; ties and repeated rows
each count; a null doc_id is kept; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, materialise, small, tidied
from .tokens import vocabulary
from .words import WORD, WordTable

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ("chars_per_token", "byte_share", "entropy_share")
#: Ends of the blocks that decide a text's script, first match wins; anything else with letters is "other".
SCRIPTS = (("latin", 0x24F), ("greek", 0x3FF), ("cyrillic", 0x52F), ("hebrew", 0x5FF), ("arabic", 0x77F), ("indic", 0xDFF), ("thai", 0xE7F))
_FIELDS = [("doc_id", pa.int64()), ("group", pa.string()), *((x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")), *((x, pa.float64()) for x in MEASURES)]
_SPARK = "doc_id bigint, `group` string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, " + ", ".join(f"{m} double" for m in MEASURES)
_POWERS = np.array([pow(6364136223846793005, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[str]) -> int:
    """Words inside some run of 8 words that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    w = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        w += h[k : k + n] * _POWERS[k]
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    ends = np.zeros(len(words) + 1, dtype=np.int64)
    ends[np.flatnonzero(twice)] += 1
    ends[np.flatnonzero(twice) + WINDOW] -= 1
    return int((np.cumsum(ends)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script of most letters; ties go to the first in SCRIPTS."""
    if text.isascii():
        return "latin"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = codes[(codes >= 0x41) & ((codes > 0x7A) | (codes < 0x5B) | (codes > 0x60)) & (codes != 0xD7) & (codes != 0xF7)]
    if not len(codes):
        return "latin"
    kind = np.searchsorted(np.array([e for _, e in SCRIPTS]), codes)
    return [*(n for n, _ in SCRIPTS), "other"][int(np.bincount(kind, minlength=len(SCRIPTS) + 1).argmax())]


def _pieces(path: str):
    """Rows of (tokens, byte-fallback tokens, where the word's ids begin) and the ids themselves, for new words."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    store: list[np.ndarray] = [np.zeros(0, np.int32)]

    def rows_of(words: list[str]) -> np.ndarray:
        ids = model.encode(words, num_threads=1) if words else []
        n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(n.sum()))
        ends = np.cumsum(n)
        byte = np.diff(np.concatenate([[0], np.cumsum(is_byte[flat])])[np.concatenate([[0], ends])]) if len(ids) else n
        store[0] = np.concatenate([store[0], flat])
        return np.stack([n, byte, len(store[0]) - len(flat) + ends - n], axis=1)

    return rows_of, store


def measures(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """One row per document: the base counts and the fertility measures (null without tokens)."""
    path = vocab or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of, store = _pieces(path)
        table = WordTable(rows_of, 300_000)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                ids, texts, langs = (some.column(k).to_pylist() for k in range(3))
                texts = [t or "" for t in texts]
                words = [WORD.findall(t) for t in texts]
                if len(table.place) > table.most:
                    store[0] = store[0][:0]
                at = table.look(words)
                out, k = [], 0
                for doc_id, text, lang, ws in zip(ids, texts, langs, words):
                    rows = table.rows[at[k : k + len(ws)]]
                    k += len(ws)
                    n = int(rows[:, 0].sum())
                    chars = sum(map(len, ws))
                    fertility = (None, None, None)
                    if n:
                        first = np.repeat(rows[:, 2] - np.cumsum(rows[:, 0]) + rows[:, 0], rows[:, 0])
                        tokens = np.sort(store[0][first + np.arange(n)])
                        edges = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
                        p = np.diff(edges) / n
                        bits = float(-(p * np.log2(p)).sum()) + 0.0
                        fertility = (chars / n, float(rows[:, 1].sum()) / n, bits / np.log2(n) if n > 1 else 1.0)
                    out.append((doc_id, lang if lang is not None else script_of(text), len(ws), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(ws), n, *fertility))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _FIELDS)], schema=pa.schema(_FIELDS))

    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(tidied(run), _SPARK)


def size_class() -> Column:
    return F.floor(F.log2("n_words")).cast("int")


ALL_SIZES = -1


def bands(rows: DataFrame, width: float = 4.0, least_tokens: int = 50, least_docs: int = 30) -> DataFrame:
    """Rejection bands: group, size (ALL_SIZES for a whole group), then low and high of each measure, from exact quartiles of values rounded to 0.001."""
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(m, 3).alias("x")) for m in MEASURES])
    each = rows.where(F.col("n_tokens") >= least_tokens).select("group", size_class().alias("size"), F.explode(values).alias("m"))
    counts = each.groupBy("group", "size", "m.measure", "m.x").agg(F.count("*").alias("n"))
    counts = counts.unionByName(counts.groupBy("group", F.lit(ALL_SIZES).alias("size"), "measure", "x").agg(F.sum("n").alias("n")))
    q = F.expr("percentile(x, array(0.25, 0.75), n)")
    quartiles = counts.groupBy("group", "size", "measure").agg(q.alias("q"), F.sum("n").alias("docs")).where(F.col("docs") >= least_docs)
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(0.01))
    edges = quartiles.select("group", "size", "measure", (F.col("q")[0] - width * spread).alias("low"), (F.col("q")[1] + width * spread).alias("high"))
    return edges.groupBy("group", "size").pivot("measure", list(MEASURES)).agg(F.first("low").alias("low"), F.first("high").alias("high"))


def judge(docs: DataFrame, width: float = 4.0, least_tokens: int = 50, least_docs: int = 30) -> DataFrame:
    """Per document: the base counts, base_failed, the measures and kept."""
    rows = materialise(measures(docs), "fertility")
    limits = materialise(bands(rows, width, least_tokens, least_docs), "bands")  # a few rows for each language
    ends = [f"{m}_{e}" for m in MEASURES for e in ("low", "high")]
    of_size = limits.where(F.col("size") != ALL_SIZES).select(F.col("group").alias("g"), F.col("size").alias("s"), *ends)
    of_all = limits.where(F.col("size") == ALL_SIZES).select(F.col("group").alias("h"), *(F.col(e).alias(f"all_{e}") for e in ends))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    inside = F.lit(True)
    for m in MEASURES:
        low, high = (F.coalesce(f"{m}_{e}", f"all_{m}_{e}") for e in ("low", "high"))
        inside &= F.coalesce(F.col(m).between(low - 0.001, high + 0.001), F.lit(True))
    out = rows.join(small(of_size), (F.col("group") == F.col("g")) & (size_class() == F.col("s")), "left").join(small(of_all), F.col("group") == F.col("h"), "left")
    kept = ~failed & ((F.col("n_tokens") < least_tokens) | inside)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "n_tokens", *MEASURES)
