"""The byte network: fast scoring against plain chunks, held-out accuracy, hard cases."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import quality_bytes as q
from tallyframe.llm.common import fold_of

from .corpus import documents, empty


def plain_output(net: q.ByteNet, text: str | None) -> float:
    """A raw output from each chunk's windows, one by one."""
    data = (text or "").encode()
    n = max(1, -(-(len(data) - q.CHUNK) // q.STRIDE) + 1)
    padded = data + bytes(n * q.STRIDE + q.CHUNK + q.WIDTH)
    tops = []
    for k in range(n):
        part = padded[k * q.STRIDE :][: q.CHUNK + q.WIDTH - 1]
        values = [sum(net.p["e"][part[i + j]] @ net.p["w"][j] for j in range(q.WIDTH)) for i in range(q.CHUNK)]
        tops.append(np.maximum(np.max(values, axis=0) + net.p["b"], 0))
    return float(np.concatenate([np.mean(tops, axis=0), np.max(tops, axis=0)]) @ net.p["o"] + net.p["c"][0])


def test_scores_equal_plain_chunks():
    net, r = q.ByteNet(), random.Random(1)
    net.p["b"] += 0.1
    texts = [None, "", "a", "été " * 90, "x" * 255, "x" * 256, "x" * 257, "".join(r.choice("ab !\n") for _ in range(1500))]
    got = q.scorer(net.p)(texts)
    assert np.allclose(got, [plain_output(net, t) for t in texts], atol=1e-4)
    long = "".join(r.choice("abc DEF.\n") for _ in range(700_000))  # over several slices
    whole = q.chunks_of(long.encode())
    assert np.allclose(q.scorer(net.p)([long, "a"])[0], (net.combined(net.tops(whole)[0], np.zeros(1, dtype=int)) @ net.p["o"] + net.p["c"])[0], atol=1e-3)


def test_gradients():
    net, r = q.ByteNet(), np.random.default_rng(0)
    chunks, start, y = r.integers(60, 70, (5, q.CHUNK + q.WIDTH - 1)).astype(np.uint8), np.array([0, 2]), np.array([1.0, 0.0])

    def loss() -> float:
        z = net.combined(net.tops(chunks)[0], start) @ net.p["o"] + net.p["c"]
        return float(np.mean(np.log1p(np.exp(-z * (2 * y - 1)))))

    before = {k: v.copy() for k, v in net.p.items()}
    numeric = {}
    for k, at in (("o", (3,)), ("w", (2, 1, 4)), ("b", (5,)), ("e", (65, 2))):
        for sign in (1, -1):
            net.p[k] = before[k].copy()
            net.p[k][at] += sign * 1e-3
            numeric[k] = numeric.get(k, 0) + sign * loss() / 2e-3
        net.p[k] = before[k]
    net.step(chunks, start, y, 0.0, decay=0.0)
    for k, at in (("o", (3,)), ("w", (2, 1, 4)), ("b", (5,)), ("e", (65, 2))):
        assert abs(net.m[k][at] / 0.1 - numeric[k]) < 2e-3 + 0.05 * abs(numeric[k])


def labelled(spark, n=150):
    r, rows = random.Random(2), {}
    for i in range(n):
        words = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(r.randint(20, 300))]
        rows[i] = " ".join(w + r.choice(["%%%", "$$$"]) if i % 3 == 0 else w for w in words)
    return documents(spark, rows)


def test_held_out_accuracy_and_hard_cases(spark):
    docs = labelled(spark)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    odd = documents(spark, {1000: None, 1001: "", 1002: "y" * 60_000})
    got = q.score_quality(docs.unionByName(odd).unionByName(docs.where("doc_id < 3")), labels.union(labels.limit(3)), most_each=60)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 156 and len({(r["doc_id"], r["score"]) for r in rows}) == 153 and all(0 <= r["score"] <= 1 for r in rows)
    held = {r["doc_id"] for r in docs.where(fold_of(F.col("doc_id"), 3) == 1).collect()}
    assert {r["doc_id"] for r in rows if r["held_out"]} & set(range(150)) == held
    told = [r["predicted"] == int(r["doc_id"] % 3 != 0) for r in rows if r["doc_id"] in held]
    assert sum(told) >= 0.95 * len(told)
    assert q.score_quality(empty(spark), labels).count() == 0
    assert {r["score"] for r in q.score_quality(docs, labels.where("quality = 1")).collect()} == {0.5}
