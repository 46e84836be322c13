"""Token files of directly addressable codes.

Each id is split into chunks of ``bits`` bits, low chunk first. Level 0 holds the low chunk of every id and a bitmap
that says which ids go on; level k+1 holds only the ids that went on, in order, so the place of an id's next chunk
is the rank of its bit. A rank directory (a count before each 512-bit block and, in it, before each 64-bit word)
gives that rank at once: any token is read without decoding those around it.

Cases: null text is empty and yields the end id alone; an empty table gives an empty result; repeated ids and rows
each keep their own entry (equal doc_ids in no fixed order among themselves); a null doc_id sorts first; a very long
text is one entry of one segment, which has to fit in one row (2 GB of codes); columns other than doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc, in_small_batches, materialise, tasks_for, tidied
from .tokens import encoder, vocabulary

MAGIC = b"TFDAC1\0\0"
SEGMENT = "part int, seq int, doc_ids array<bigint>, ends array<bigint>, n_tokens bigint, payload binary"


def pack(ids: np.ndarray, bits: int = 8) -> bytes:
    """The file format: MAGIC, bits, levels, then for each level n, chunks, bitmap words, block and word counts."""
    rest, levels = ids.astype(np.uint32), []
    kind = np.uint8 if bits <= 8 else np.uint16
    while True:
        low, rest = rest & np.uint32((1 << bits) - 1), rest >> np.uint32(bits)
        on = rest > 0
        words = np.packbits(np.pad(on, (0, -len(on) % 512)), bitorder="little").view("<u8")
        each = np.bitwise_count(words).astype(np.uint64).reshape(-1, 8)
        blocks = np.concatenate([[0], np.cumsum(each.sum(1))])[:-1].astype("<u8")
        inside = (np.cumsum(each, axis=1) - each).astype("<u2")
        levels.append(struct.pack("<Q", len(low)) + low.astype(kind).tobytes() + words.tobytes() + blocks.tobytes() + inside.tobytes())
        rest = rest[on]
        if not len(rest):
            return MAGIC + struct.pack("<BB", bits, len(levels)) + b"".join(levels)


class Packed:
    """Random access to the ids of one packed segment."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.bits, n_levels = struct.unpack_from("<BB", raw, 8)
        kind, at, self.levels = np.dtype(np.uint8 if self.bits <= 8 else "<u2"), 10, []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            at += 8
            n_words = -(-n // 512) * 8
            arrays = []
            for dtype, count in ((kind, n), (np.dtype("<u8"), n_words), (np.dtype("<u8"), n_words // 8), (np.dtype("<u2"), n_words)):
                arrays.append(np.frombuffer(raw, dtype, count, at))
                at += dtype.itemsize * count
            self.levels.append(arrays)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places, in any order."""
        where, out = np.asarray(places, dtype=np.int64), np.zeros(len(places), dtype=np.uint32)
        who = None
        for k, (chunks, words, blocks, inside) in enumerate(self.levels):
            part = chunks[where].astype(np.uint32) << np.uint32(self.bits * k)
            if who is None:
                out |= part
            else:
                out[who] |= part
            if k + 1 == len(self.levels):
                break
            w = words[where >> 6]
            bit = (where & 63).astype(np.uint64)
            on = (w >> bit) & np.uint64(1) > 0
            w, bit, where = w[on], bit[on], where[on]
            below = np.bitwise_count(w & ((np.uint64(1) << bit) - np.uint64(1)))
            where = (blocks[where >> 9] + inside[where >> 6] + below).astype(np.int64)
            who = np.flatnonzero(on) if who is None else who[on]
        return out


def write_segments(docs: DataFrame, vocab: str | None = None, kind: str = "word", end_id: int = 1, bits: int = 8, segment_tokens: int = 1 << 20) -> DataFrame:
    """Encodes docs(doc_id, text) in ascending doc_id order and writes the packed segments as a shared table."""
    path = vocab or vocabulary("word_bpe_49k.json")
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("payload", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, end = TaskContext.get().partitionId(), 0, struct.pack("<I", end_id)
        ids, raw, size = [], [], 0

        def segment() -> pa.RecordBatch:
            ends = np.cumsum([len(x) // 4 for x in raw])
            tokens = np.frombuffer(b"".join(raw), dtype="<u4")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([len(tokens)], pa.int64()), pa.array([pack(tokens, bits)], pa.binary())], schema=schema)

        for batch in batches:
            for a in range(0, batch.num_rows, 400):
                some = batch.slice(a, 400)
                for i, x in zip(some.column(0).to_pylist(), encoder(path, kind).encode(some.column(1).to_pylist())):
                    ids.append(i)
                    raw.append(x + end)
                    size += len(raw[-1]) // 4
                    if size >= segment_tokens:
                        yield segment()
                        ids, raw, size, seq = [], [], 0, seq + 1
        if raw:
            yield segment()

    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(tasks_for(rows, 6), "doc_id").sortWithinPartitions("doc_id")
    return materialise(rows.mapInArrow(tidied(encode), SEGMENT), "dac")


def read_segments(segments: DataFrame) -> DataFrame:
    """Per document, read from the packed segments: doc_id, start, n_tokens, ids_crc32."""
    fields = [("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("inner", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, seq, ids, ends, _, raw = (batch.column(c)[k].as_py() for c in range(6))
                packed, starts = Packed(raw), [0, *ends[:-1]]
                tokens = packed.get(np.arange(len(packed))).astype("<u4")
                sums = [crc(tokens[a:b].tobytes()) for a, b in zip(starts, ends)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(np.subtract(ends, starts), pa.int64()), pa.array(sums, pa.int64())], schema=pa.schema(fields))

    each = segments.mapInArrow(tidied(decode), "part int, seq int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each writing task
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    starts = segments.select("part", "seq", "n_tokens").withColumn("seq_start", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.join(parts, F.col("part") == F.col("p")).select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("base"))
    return each.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(doc_id, place): the token id at each place of each document, by random access; places outside give none."""
    held = segments.select("part", "seq", F.posexplode("doc_ids").alias("k", "doc_id"))
    asked = wanted.select("doc_id", "place").join(held, "doc_id").groupBy("part", "seq").agg(F.collect_list(F.struct("k", "doc_id", "place")).alias("asked"))
    rows = segments.select("part", "seq", "ends", "payload").join(asked, ["part", "seq"])

    def look(batches):
        for pdf in batches:
            for ends, raw, asked_here in zip(pdf["ends"], pdf["payload"], pdf["asked"]):
                packed, first = Packed(raw), np.concatenate([[0], ends])
                k = np.array([x["k"] for x in asked_here])
                place = np.array([x["place"] for x in asked_here])
                ok = (place >= 0) & (place < first[k + 1] - first[k])
                import pandas as pd

                yield pd.DataFrame({"doc_id": [x["doc_id"] for x, y in zip(asked_here, ok) if y], "place": place[ok], "token": packed.get((first[k] + place)[ok]).astype(np.int64)})

    return rows.select("ends", "payload", "asked").mapInPandas(look, "doc_id bigint, place bigint, token bigint")
