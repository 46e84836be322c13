"""Packing documents into sequences by cutting-stock column generation.

A document is cut into whole sequences and one rest. Rests are counted by length class (``grain`` tokens wide); the
histogram has at most ``capacity / grain`` rows whatever the corpus' size, and is all that the driver sees. A linear
program over patterns (how many rests of each class share a sequence) is solved by column generation: the simplex
duals price classes and an unbounded-knapsack dynamic program finds the best new pattern. Pattern counts are rounded
down, what is left over is packed first-fit decreasing, and documents, ranked within their class, take their slots
from the patterns by arithmetic on their rank.

Cases: null text is empty and is the end id alone; an empty table gives an empty result; ties in length are ranked
by task and order of reading; repeated rows are packed each; very long texts fill sequences of their own and one rest;
a null doc_id is kept; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc, in_small_batches, materialise, tidied
from .tokens import encoder, vocabulary

PIECE = "part int, class int, local bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
_SCHEMA = pa.schema([("part", pa.int32()), ("class", pa.int32()), *((x, pa.int64()) for x in ("local", "doc_id", "start", "length", "ids_crc32", "doc_tokens"))])


def best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of the greatest value. sizes: ascending."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            v = best[c - sizes[:n]] + value[:n]
            if v[k := int(v.argmax())] > best[c] + 1e-12:
                best[c], pick[c] = v[k], k
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Patterns (count of each size) and how often each is used; together they hold exactly the demand."""
    order = np.argsort(sizes)
    sizes, demand = np.asarray(sizes, dtype=np.int64)[order], np.asarray(demand, dtype=np.float64)[order]
    m, back = len(sizes), np.argsort(order)
    if not m:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    inverse, x = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    for _ in range(rounds):
        duals = inverse.sum(0)
        value, pattern = best_pattern(sizes, np.maximum(duals, 0), capacity)
        if value <= 1 + 1e-7:
            break
        d = inverse @ pattern
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * d, 0)
        x[out] = ratio[out]
        basis[:, out] = pattern
        inverse[out] /= d[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(d[others], inverse[out])
    left, used = demand.astype(np.int64), []
    for k in np.argsort(-x, kind="stable"):
        p = basis[:, k].astype(np.int64)
        n = min(int(x[k] + 1e-6), *(int(left[i] // p[i]) for i in np.flatnonzero(p)))
        if n > 0:
            used.append((p, n))
            left -= p * n
    while left.any():  # what rounding left: largest first into one more sequence, used as often as it can be
        p, room = np.zeros(m, dtype=np.int64), capacity
        for i in range(m - 1, -1, -1):
            if left[i] and sizes[i] <= room:
                p[i] = min(left[i], room // sizes[i])
                room -= p[i] * sizes[i]
        n = min(int(left[i] // p[i]) for i in np.flatnonzero(p))
        used.append((p, n))
        left -= p * n
    return [(p[back], n) for p, n in used]


def pieces_of(docs: DataFrame, vocab: str, capacity: int, grain: int, end_id: int) -> DataFrame:
    """The pieces of each document, each with its length class and its place among its task's pieces of that class."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, end = TaskContext.get().partitionId(), Counter(), struct.pack("<I", end_id)
        for batch in batches:
            for a in range(0, batch.num_rows, 400):
                some, out = batch.slice(a, 400), []
                for doc_id, raw in zip(some.column(0).to_pylist(), encoder(vocab, "byte").encode(some.column(1).to_pylist())):
                    raw += end
                    n = len(raw) // 4
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        k = 0 if length == capacity else -(-length // grain)
                        out.append((part, k, seen[k], doc_id, start, length, crc(raw[4 * start : 4 * (start + length)]), n))
                        seen[k] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(cut), PIECE)


def pack_documents(docs: DataFrame, capacity: int = 2048, grain: int = 8, end_id: int = 1, vocab: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = materialise(pieces_of(docs, vocab or vocabulary("byte_bpe_50k.json"), capacity, grain, end_id), "pieces")
    counts = pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
    by_class = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # capacity / grain + 1 rows at most
    classes = np.array(sorted(k for k in by_class if k), dtype=np.int64)
    plan = cutting_stock(classes, np.array([by_class[k] for k in classes.tolist()]), capacity // grain)
    slots: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in classes.tolist()}
    taken, base = Counter(), 0
    for pattern, times in plan:
        slot = 0
        for i in np.flatnonzero(pattern):
            k, each = int(classes[i]), int(pattern[i])
            slots[k].append((taken[k], each, base, slot))
            taken[k] += each * times
            slot += each
        base += times
    first = {k: tuple(np.array(c) for c in zip(*v)) for k, v in slots.items()}
    whole = base

    def place(batches):
        for pdf in batches:
            seq, slot = np.empty(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            rank, kind = pdf["rank"].to_numpy(), pdf["class"].to_numpy()
            for k in np.unique(kind):
                here = np.flatnonzero(kind == k)
                if k == 0:
                    seq[here] = whole + rank[here]
                    continue
                start, each, at, lead = first[int(k)]
                j = np.searchsorted(start, rank[here], side="right") - 1
                t = rank[here] - start[j]
                seq[here], slot[here] = at[j] + t // each[j], lead[j] + t % each[j]
            yield pdf.assign(sequence_id=seq, slot=slot).drop(columns=["class", "rank"])

    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lead = counts.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lead"))
    ranked = pieces.join(lead, ["class", "part"]).select("class", (F.col("local") + F.col("lead")).alias("rank"), "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    placed = ranked.mapInPandas(place, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, slot bigint")
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("bigint")
    return placed.withColumn("offset", offset).drop("slot")
