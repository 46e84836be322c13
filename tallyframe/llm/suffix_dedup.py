"""Removal of long repeated passages, over all documents, by merged Burrows-Wheeler transforms of shards.

Every window of ``length`` bytes has an anchor, the substring of ``gram`` bytes with the least hash in it, and a
document's windows with one anchor form one context. Equal windows have equal anchors, so contexts are dealt out by
anchor and only contexts with the same anchor can share a window:

1. Contexts go by anchor to buckets as packed arrays of numbers, each with a 128-bit digest of its bytes. Contexts of
   one digest repeat as a whole; a task sends no more than two of them. A context that nobody equals, with an anchor
   that others have too, is undecided.
2. Undecided contexts, and one witness of each repeated context with the same anchor, get their bytes and are sharded
   within parts of bounded size; the shards' transforms are merged, and the repeated intervals of the merge say which
   windows start elsewhere too. An anchor with more than ``most`` different contexts would make too large a part: its
   contexts are cut again by the next, longer gram of ``grams``. The last gram is a whole window, which has one context.
3. Each document's repeated windows are joined to runs and its bytes outside them are kept.

Rows are told apart by a hash of doc_id and text. Cases: null text is empty; texts under ``length`` bytes lose
nothing; texts of any length are cut into pieces that overlap; a passage repeated inside one text counts; equal rows
repeat each other; a null doc_id is kept; columns other than doc_id and text are kept or ignored, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt_merge import repeated_starts
from .common import fresh, hand_back, in_small_batches, materialise, tasks_for, tidied

_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 19
_INDEX = 21  # bits for a place in a slice of up to two pieces
_PACKED = "kind int, bucket int, rows binary"
_COLUMNS = ["kind", "bucket", "rows"]
#: Kinds of packed rows: contexts; repeated windows; undecided contexts; their bytes.
_CONTEXT, _SPAN, _OPEN, _BYTES = range(4)
_CONTEXT_T = np.dtype([("anchor", "<u8"), ("same", "<u8"), ("same2", "<u8"), ("key", "<i8"), ("lo", "<u4"), ("hi", "<u4"), ("many", "u1")])
_SPAN_T = np.dtype([("key", "<i8"), ("lo", "<u4"), ("hi", "<u4")])
_OPEN_T = np.dtype([("key", "<i8"), ("lo", "<u4"), ("hi", "<u4"), ("anchor", "<u8"), ("flags", "u1")])  # flags: 1 undecided, 2 to be cut again
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(20, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _POWERS[size] = both[0], both[1]
    return _POWERS[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any substrings of a buffer."""

    def __init__(self, raw: bytes):
        b = np.frombuffer(raw, dtype=np.uint8)
        up, self.down = _powers(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * self.down[start])


def contexts_of(keys: np.ndarray, bases: np.ndarray, texts: list[bytes], length: int, gram: int, bits: int = 64) -> np.ndarray:
    """The contexts of these pieces of texts (each of ``length`` bytes at least), as rows of _CONTEXT_T. bits: how many of an anchor's hash are kept."""
    raw = b"".join(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    h = Hashes(raw)
    grams = h.of(np.arange(len(raw) - gram + 1), gram)
    least = (grams >> np.uint64(_INDEX) << np.uint64(_INDEX)) | np.arange(len(grams), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    n = sizes - length + 1
    window = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - starts, n)
    anchor = (least[window] & np.uint64((1 << _INDEX) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.append(first[1:], len(window)) - 1
    out = np.zeros(len(first), dtype=_CONTEXT_T)
    lo, hi, own = window[first], window[last], owner[first]
    view, digest = memoryview(raw), xxhash.xxh3_128_digest
    same = np.frombuffer(b"".join([digest(view[x:y]) for x, y in zip(lo.tolist(), (hi + length).tolist())]), dtype="<u8").reshape(-1, 2)
    out["anchor"], out["same"], out["same2"] = grams[anchor[first]] >> np.uint64(64 - bits), same[:, 0], same[:, 1]
    out["key"], out["lo"], out["hi"] = keys[own], lo - starts[own] + bases[own], hi - starts[own] + bases[own]
    return out


def _packed(kind: int, where: np.ndarray, rows: np.ndarray) -> list[tuple]:
    order = np.argsort(where, kind="stable")
    where, rows = where[order], rows[order]
    cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else []
    return [(kind, int(where[a]), rows[a:b].tobytes()) for a, b in zip(cuts, np.append(cuts[1:], len(where)))]


def _rows(pdf: pd.DataFrame, kind: int, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(pdf.loc[pdf["kind"] == kind, "rows"]), dtype=dtype)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary())
    columns = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=_COLUMNS)


def _to(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys.astype(np.int64).view(np.uint64) % np.uint64(buckets)).astype(np.int64)


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by the keys, where each distinct combination begins in it, and how many there are of it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


class Sent:
    """What a task has sent, as far as a table of fixed size holds it: 0 not known, 1 sent once, 2 sent as repeated."""

    def __init__(self, bits: int = 18):
        self.one, self.two, self.state = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint8)

    def look(self, c: np.ndarray) -> np.ndarray:
        """The states of different contexts, which are noted as sent."""
        at = (c["same"] % np.uint64(len(self.one))).astype(np.int64)
        known = np.where((self.one[at] == c["same"]) & (self.two[at] == c["same2"]), self.state[at], 0)
        self.one[at], self.two[at], self.state[at] = c["same"], c["same2"], np.where((known > 0) | (c["many"] > 0), 2, 1)
        return known


def find_contexts(rows: DataFrame, buckets: int, length: int, gram: int, bits: int = 64) -> DataFrame:
    """Packed _CONTEXT rows by anchor, and _SPAN rows by key for what repeats within a task. rows(key, base, raw)."""

    def emit(keys: list, bases: list, texts: list, sent: Sent) -> pa.RecordBatch:
        c = contexts_of(np.array(keys, dtype=np.int64), np.array(bases, dtype=np.int64), texts, length, gram, bits)
        order, first, times = _grouped(c["anchor"], c["same"], c["same2"])
        again = np.zeros(len(c), dtype=bool)
        again[order] = np.repeat(times > 1, times)
        one = c[order[first]]
        one["many"] = times > 1
        known = sent.look(one)
        again[order[first[known == 2]]] = True  # the bucket knows already that it repeats
        one["many"] |= known > 0
        one = one[known < 2]
        spans = np.zeros(int(again.sum()), dtype=_SPAN_T)
        for f in _SPAN_T.names:
            spans[f] = c[f][again]
        return _record(_packed(_CONTEXT, _to(one["anchor"], buckets), one) + _packed(_SPAN, _to(spans["key"], buckets), spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bases, texts, size, sent = [], [], [], 0, Sent()
        for batch in batches:
            for i in range(batch.num_rows):
                key, base, raw = (batch.column(k)[i].as_py() for k in range(3))
                for at in range(0, max(1, len(raw) - length + 1), _PIECE):
                    piece = raw[at : at + _PIECE + length - 1]
                    if len(piece) < length:
                        continue
                    keys.append(key)
                    bases.append(base + at)
                    texts.append(piece)
                    size += len(piece)
                    if size >= _PIECE:
                        yield emit(keys, bases, texts, sent)
                        keys, bases, texts, size = [], [], [], 0
        if texts:
            yield emit(keys, bases, texts, sent)

    return rows.select("key", "base", "raw").mapInArrow(tidied(run), _PACKED)


def decide(packed: DataFrame, buckets: int, most: int) -> DataFrame:
    """_SPAN rows of contexts that repeat, _OPEN rows of those whose bytes must be compared; both by key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        passed, c = pdf[pdf["kind"] == _SPAN], _rows(pdf, _CONTEXT, _CONTEXT_T)
        if not len(c):
            return passed
        order, first, times = _grouped(c["anchor"], c["same"], c["same2"])
        c = c[order]
        many = np.maximum.reduceat(c["many"], first) > 0
        again = np.repeat((times > 1) | many, times)
        spans = np.zeros(int(again.sum()), dtype=_SPAN_T)
        for f in _SPAN_T.names:
            spans[f] = c[f][again]
        one, undecided = c[first], ~((times > 1) | many)
        start = np.flatnonzero(np.concatenate([[True], one["anchor"][1:] != one["anchor"][:-1]]))
        different = np.diff(np.append(start, len(one)))
        wanted = np.repeat((different > 1) & (np.add.reduceat(undecided.astype(np.int64), start) > 0), different)
        hot = np.repeat(different > most, different)
        rows = np.zeros(int(wanted.sum()), dtype=_OPEN_T)
        for f in ("key", "lo", "hi", "anchor"):
            rows[f] = one[f][wanted]
        rows["flags"] = undecided[wanted] + 2 * hot[wanted]
        out = _packed(_SPAN, _to(spans["key"], buckets), spans) + _packed(_OPEN, _to(rows["key"], buckets), rows)
        return pd.concat([passed, pd.DataFrame(out, columns=_COLUMNS)])

    return packed.groupBy("bucket").applyInPandas(run, _PACKED)


def _by_key(kind: int, dtype: np.dtype, merge: int = 0):
    """Rows of one kind, gathered for each key; merge: join the spans and make them ends of bytes, for this length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _rows(pdf, kind, dtype)
        rows = rows[np.lexsort((rows["lo"], rows["key"]))]
        if merge and len(rows):
            new, keys, lo, hi = [], rows["key"], rows["lo"].astype(np.int64), rows["hi"].astype(np.int64) + merge
            which = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
            shift = which * (np.int64(1) << 33)
            top = np.maximum.accumulate(hi + shift) - shift
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (lo[1:] > top[:-1])])
            at = np.flatnonzero(new)
            joined = np.zeros(len(at), dtype=_SPAN_T)
            joined["key"], joined["lo"], joined["hi"] = keys[at], lo[at], np.maximum.reduceat(hi, at)
            rows = joined
        cuts = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])) if len(rows) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(rows))
        return pd.DataFrame({"k": rows["key"][cuts].astype(np.int64), "found": [rows[a:b].tobytes() for a, b in zip(cuts, ends)]})

    return run


def asked_of(open_: DataFrame, flags: str) -> DataFrame:
    """k, found: the packed _OPEN rows of each key whose flags are as asked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _rows(pdf, _OPEN, _OPEN_T)
        rows = rows[(rows["flags"] >= 2) == (flags == "hot")]
        return gather(pd.DataFrame({"kind": [_OPEN], "rows": [rows.tobytes()]}))

    gather = _by_key(_OPEN, _OPEN_T)
    return open_.where(f"kind = {_OPEN}").groupBy("bucket").applyInPandas(run, "k bigint, found binary")


def hot_pieces(rows: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """key, base, raw: the bytes of the contexts that are to be cut again."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                c = np.frombuffer(batch.column(2)[i].as_py(), dtype=_OPEN_T)
                pieces = [raw[a:b] for a, b in zip(c["lo"].tolist(), (c["hi"].astype(np.int64) + length).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(c), pa.int64()), pa.array(c["lo"].astype(np.int64)), pa.array(pieces, pa.binary())], names=["key", "base", "raw"])

    held = rows.join(asked_of(open_, "hot"), F.col("key") == F.col("k")).select("key", "raw", "found")
    return held.mapInArrow(tidied(cut), "key bigint, base bigint, raw binary")


def compare(rows: DataFrame, open_: DataFrame, parts: int, buckets: int, length: int) -> DataFrame:
    """_SPAN rows, by key, of the repeated windows of undecided contexts."""
    held = rows.join(asked_of(open_, "open"), F.col("key") == F.col("k")).select("key", "raw", "found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                contexts, raws = [], []
                for i in range(a, min(a + 500, batch.num_rows)):
                    raw = batch.column(1)[i].as_py()
                    for c in np.frombuffer(batch.column(2)[i].as_py(), dtype=_OPEN_T):
                        contexts.append(c)
                        raws.append(raw[c["lo"] : int(c["hi"]) + length])
                out = []
                if contexts:
                    c = np.array(contexts, dtype=_OPEN_T)
                    part = _to(c["anchor"], parts)
                    for p in np.unique(part):
                        here = np.flatnonzero(part == p)
                        out.append((_BYTES, int(p), len(here).to_bytes(8, "little") + c[here].tobytes() + b"".join(raws[j] for j in here)))
                yield _record(out)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        contexts, raws = [np.zeros(0, _OPEN_T)], []
        for x in pdf["rows"]:
            n = int.from_bytes(x[:8], "little")
            c = np.frombuffer(x, _OPEN_T, n, 8)
            ends = 8 + n * _OPEN_T.itemsize + np.cumsum(c["hi"].astype(np.int64) - c["lo"] + length)
            contexts.append(c)
            raws += [x[i:j] for i, j in zip([8 + n * _OPEN_T.itemsize, *ends[:-1]], ends)]
        c = np.concatenate(contexts)
        order = np.argsort(c["anchor"], kind="stable").tolist()  # contexts that can match are in the same shards, as far as they go
        starts = repeated_starts([raws[j] for j in order], length) if raws else []
        spans = [np.zeros(0, _SPAN_T)]
        for j, s in zip(order, starts):
            if len(s) and c["flags"][j] & 1:
                edges = np.flatnonzero(np.diff(s) > 1)
                x = np.zeros(len(edges) + 1, dtype=_SPAN_T)
                x["key"], x["lo"], x["hi"] = c["key"][j], c["lo"][j] + s[np.append(0, edges + 1)], c["lo"][j] + s[np.append(edges, len(s) - 1)]
                spans.append(x)
        found = np.concatenate(spans)
        del raws, c, starts
        hand_back()
        return pd.DataFrame(_packed(_SPAN, _to(found["key"], buckets), found), columns=_COLUMNS)

    return held.mapInArrow(tidied(cut), _PACKED).groupBy("bucket").applyInPandas(run, _PACKED)


def repeated_spans(rows: DataFrame, length: int = 200, grams: tuple[int, ...] = (48, 120), part_bytes: int = 1_000_000, most: int = 4000, bits: int = 64) -> DataFrame:
    """k, found: per key of rows(key, raw) the byte runs to remove, packed as _SPAN_T."""
    buckets = tasks_for(rows, 6, 16)
    level, spans = rows.withColumn("base", F.lit(0).cast("bigint")), []
    for gram in (*grams, length):
        decided = materialise(decide(find_contexts(level, buckets, length, gram, bits), buckets, most if gram < length else 1 << 62), "contexts")
        spans.append(decided.where(f"kind = {_SPAN}"))
        size = decided.where(f"kind = {_OPEN}").agg(F.sum(F.length("rows"))).first()[0]
        if not size:
            break
        parts = max(8, int(size / _OPEN_T.itemsize * (length + 80) / part_bytes) + 1)
        spans.append(compare(rows, decided, parts, buckets, length))
        level = materialise(hot_pieces(rows, decided, length), "hot")
        if level.isEmpty():
            break
    found = spans[0]
    for x in spans[1:]:
        found = found.unionByName(x)
    return found.groupBy("bucket").applyInPandas(_by_key(_SPAN, _SPAN_T, length), "k bigint, found binary")


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """docs with its texts, null as empty, and a key of each row."""
    in_small_batches(docs.sparkSession)
    return docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn(key, F.xxhash64("doc_id", F.col(text)))


def _spans_of(raw: bytes | None) -> list[tuple[int, int]]:
    x = np.frombuffer(raw or b"", dtype=_SPAN_T)
    return list(zip(x["lo"].tolist(), x["hi"].tolist()))


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def digest_removed(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = _keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "text", "key").select("doc_id", "key", F.col("text").cast("binary").alias("raw"))
    spans = repeated_spans(rows.select("key", "raw"), **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, runs, sums = [], [], [], []
            for data, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                s = _spans_of(raw)
                n.append(len(data))
                gone.append(sum(b - a for a, b in s))
                runs.append(len(s))
                sums.append(hashlib.sha256(without(data, s)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(sums, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    both = rows.join(spans, F.col("key") == F.col("k"), "left").select("doc_id", "raw", "found")
    return both.mapInArrow(tidied(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, **how) -> DataFrame:
    """The documents, all columns, with the repeated passages cut out of text; bytes that a cut left half a character are dropped."""
    text, key, spans_key, spans = (fresh(x) for x in ("text", "key", "k", "spans"))
    rows = _keyed(docs, text, key)
    found = repeated_spans(rows.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("raw")), **how).toDF(spans_key, spans)

    @F.pandas_udf("string")
    def cut(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([without(t.encode("utf-8", "surrogatepass"), _spans_of(f)).decode("utf-8", "ignore") for t, f in zip(text, found)])

    out = rows.join(found, F.col(key) == F.col(spans_key), "left")
    return out.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(cut(text, spans))).select(*docs.columns)
