"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation of the centred, PCA-projected vectors is learned on a bounded sample so that the signs of the rotated
coordinates make balanced binary codes. Each table takes some of a code's bits; vectors with the same label that agree
on all bits of a table meet in its bucket, where pairs within a Hamming radius are compared by the original vectors.
The tables
are as many as it takes for a pair at the threshold to share one with probability ``recall``, measured on pairs planted
in the sample, and their width is the one of least estimated work for the counted groups, so that recall does not
depend on the size. A pair counts in the first of its tables only. Buckets over ``block`` vectors are cut into blocks and compared in
pairs of blocks, so nothing is capped; each task gives back counts and a star for each connected part, never pairs.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or vec_id,
link with nothing; equal vectors are put together first and link with each other; vectors of different lengths are
not compared; ties at the threshold link; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_by_key, materialise
from .components import components


def train_rotation(x: np.ndarray, bits: int, rounds: int = 40, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Projection (dimension, bits) and thresholds (bits): PCA, then the rotation nearest to its own signs."""
    mean = x.mean(0)
    _, vectors = np.linalg.eigh(np.cov((x - mean).T) if len(x) > 1 else np.eye(x.shape[1]))
    base = vectors[:, ::-1][:, : min(bits, x.shape[1])]
    r = np.random.default_rng(seed)
    v = (x - mean) @ base
    rotation, _ = np.linalg.qr(r.normal(size=(base.shape[1], base.shape[1])))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (u @ w).T
    p = base @ rotation
    return p, np.median(x @ p, axis=0)


def codes_of(x: np.ndarray, model: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """One 64-bit code for each vector; 0 without a model, so that such vectors are all compared."""
    if model is None:
        return np.zeros(len(x), dtype=np.uint64)
    on = x @ model[0] >= model[1]
    return (on.astype(np.uint64) << np.arange(on.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)


def table_masks(bits: int, width: int, tables: int, seed: int = 9) -> list[int]:
    """The bits of each table: disjoint ones while they last, then the same of another order of the bits."""
    r, out = np.random.default_rng(seed), []
    while len(out) < tables:
        order = r.permutation(bits)
        out += [sum(1 << int(b) for b in order[a : a + width]) for a in range(0, bits - width + 1, width)]
    return out[:tables]


def planted_differences(x: np.ndarray, model: tuple[np.ndarray, np.ndarray], least: float, pairs: int = 4000, seed: int = 7) -> list[np.ndarray]:
    """Differing code bits (pair, bit) of pairs at cosine ``least``: isotropic ones, and ones along differences of x."""
    r, out = np.random.default_rng(seed), []
    one = x[r.integers(0, len(x), pairs)]
    for kind in ("isotropic", "data"):
        side = r.normal(size=one.shape)
        if kind == "data":
            side = x[r.integers(0, len(x), pairs)] - x[r.integers(0, len(x), pairs)] + 1e-6 * side
        side -= (side * one).sum(1, keepdims=True) * one
        side /= np.maximum(np.sqrt((side * side).sum(1, keepdims=True)), 1e-300)
        two = least * one + np.sqrt(max(0.0, 1 - least * least)) * side
        out.append((one @ model[0] >= model[1]) != (two @ model[0] >= model[1]))
    return out


def tables_needed(differ: list[np.ndarray], width: int, recall: float, tables: int, most: int = 1024) -> list[int] | None:
    """The masks of the fewest tables, ``tables`` or more, that ``recall`` of each kind of planted pairs share one of; None over ``most``."""
    if width == 0:
        return [0]  # one bucket for all
    masks = table_masks(differ[0].shape[1], width, most)
    bits = np.array([[m >> b & 1 for b in range(differ[0].shape[1])] for m in masks], dtype=np.float32)
    first = [np.where((miss := d.astype(np.float32) @ bits.T == 0).any(1), miss.argmax(1), most) for d in differ]
    need = max(int(np.sort(f)[int(np.ceil(recall * len(f))) - 1]) + 1 for f in first)
    return masks[: max(need, tables)] if need <= most else None


def plan_tables(x: np.ndarray, model: tuple[np.ndarray, np.ndarray], least: float, recall: float, tables: int, largest: int, width: int | None = None, row_cost: float = 2000.0) -> list[int]:
    """The tables' masks, of the width from 8 to 16 (if not given) with the least work; row_cost: a row's cost in comparisons.

    Where no number of tables of these widths has the recall (few bits), tables are narrower.
    """
    differ, bits = planted_differences(x, model, least), model[0].shape[1]
    widths = range(8, min(16, bits) + 1) if width is None else [min(width, bits)]
    plans = [(w, m) for w in widths if (m := tables_needed(differ, w, recall, tables)) is not None]
    if plans:
        return min(plans, key=lambda p: len(p[1]) * (row_cost + largest / 2.0 ** p[0]))[1]
    return next(m for w in range(min([*widths, bits]), -1, -1) if (m := tables_needed(differ, w, recall, tables)) is not None)


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, dim, digest, vector (little-endian numbers) of the rows that can link."""
    kind = "<f4" if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, cell in enumerate(batch.column(2)):
                if ids[i] is None or labels[i] is None or not cell.is_valid:
                    continue
                v = cell.values.to_numpy(zero_copy_only=False).astype(kind)
                if len(v) and np.isfinite(v).all() and v.any():
                    raw = v.tobytes()
                    out.append((ids[i], labels[i], len(v), xxhash.xxh3_128_digest(raw), raw))
            columns = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["vec_id", "label", "dim", "digest", "vector"])

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, "vec_id bigint, label bigint, dim int, digest binary, vector binary")


def unit(raws, kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(r, dtype=kind) for r in raws]).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_classes(embeddings: DataFrame, least: float = 0.93, sample: int = 5000, bits: int = 64, tables: int = 12, radius: int = 24, block: int = 512, recall: float = 0.995, width: int | None = None) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    kind = "<f4" if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    valid = materialise(valid_vectors(rows), "vectors")
    groups = valid.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    groups = materialise(groups, "distinct-vectors")
    some = groups.orderBy(F.xxhash64("rep", F.lit(5))).limit(sample).select("dim", "vector").collect()  # a bounded sample
    models, masks = {}, {}
    largest = groups.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    for d in {r["dim"] for r in some}:
        x = unit([r["vector"] for r in some if r["dim"] == d], kind)
        models[d] = train_rotation(x, bits)
        masks[d] = plan_tables(x, models[d], least, recall, tables, largest, width)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, raws = np.array(batch.column(1).to_pylist()), batch.column(4).to_pylist()
            code = np.zeros(len(dims), dtype=np.uint64)
            for d in np.unique(dims):
                here = np.flatnonzero(dims == d)
                code[here] = codes_of(unit([raws[i] for i in here], kind), models.get(int(d)))
            keys = [(c & np.array(masks.get(int(d), [0]), dtype=np.uint64)).view(np.int64) for c, d in zip(code, dims)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 3, 4)), pa.array(code.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["label", "dim", "rep", "weight", "vector", "code", "keys"])

    coded = groups.select("label", "dim", "rep", "weight", "vector").mapInArrow(encode, "label bigint, dim int, rep bigint, weight bigint, vector binary, code bigint, keys array<bigint>")
    coded = materialise(coded, "codes")
    spread = coded.select("label", "dim", "rep", F.posexplode("keys").alias("t", "key"))
    bucket = ["label", "dim", "t", "key"]
    sizes = materialise(spread.groupBy(bucket).agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    full = coded.select("label", "dim", "rep", "weight", "vector", "code", F.posexplode("keys").alias("t", "key"))
    full = join_by_key(full, sizes, bucket, "n", heavy=block)
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    full = full.select("label", "dim", "t", "key", "rep", "weight", "vector", "code", mine.alias("mine"), F.explode(pairs).alias("p")).select("*", "p.i", "p.j").drop("p")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame({"rep": [], "n": [], "root": []}).astype("int64")
        ids, weight, code = pdf["rep"].to_numpy(), pdf["weight"].to_numpy(), pdf["code"].to_numpy().view(np.uint64)
        x, t = unit(pdf["vector"], kind), int(pdf["t"].iloc[0])
        one, two = (np.flatnonzero(pdf["mine"] == pdf[c].iloc[0]) for c in ("i", "j"))
        differ = code[one, None] ^ code[None, two]
        a, b = np.nonzero((np.bitwise_count(differ) <= radius) & (x[one] @ x[two].T >= least - 1e-9))
        differ, a, b = differ[a, b], one[a], two[b]
        use = a < b if pdf["i"].iloc[0] == pdf["j"].iloc[0] else a != b
        for m in masks.get(int(pdf["dim"].iloc[0]), [0])[:t]:
            use &= differ & np.uint64(m) != 0
        a, b = a[use], b[use]
        exact = np.einsum("ij,ij->i", x[a], x[b]) >= least
        a, b = a[exact], b[exact]
        n = np.bincount(a, weights=weight[b], minlength=len(ids)) + np.bincount(b, weights=weight[a], minlength=len(ids))
        root = ids.copy()
        while len(a):  # hand the least id along the links until nothing changes
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, low[a])
            if (low == root).all():
                break
            root = low
        return pd.DataFrame({"rep": ids, "n": n.astype(np.int64), "root": root})[n > 0]

    found = materialise(full.groupBy("label", "dim", "t", "key", "i", "j").applyInPandas(compare, "rep bigint, n bigint, root bigint"), "near")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    linked = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = groups.select("label", "dim", "digest", "rep", "weight").join(counts, "rep", "left").join(linked, F.col("rep") == F.col("node"), "left")
    classes = classes.select("label", "dim", "digest", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    member = join_by_key(valid.select("vec_id", "label", "dim", "digest"), materialise(classes, "classes"), ["label", "dim", "digest"], "weight")
    member = member.groupBy(F.col("vec_id").alias("v")).agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(member, F.col("vec_id") == F.col("v"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
