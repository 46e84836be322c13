import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm.bwt_merge import repeated_starts
from tallyframe.llm.components import components
from tallyframe.llm.itq_dedup import near_classes, table_masks, train_rotation
from tallyframe.llm.ngram_join import Shingler, connecting_links, jaccard_classes, linked, matches, one_of_each, open_links, prefix_lists, prefix_size, prefixes_of
from tallyframe.llm.suffix_dedup import digest_removed, remove_repeats

from .corpus import by_id, documents, empty, texts


def union(nodes, links):
    up = {i: i for i in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in nodes}


def test_merged_transforms_find_what_repeats():
    r = random.Random(1)
    for _ in range(60):
        base = bytes(r.choice(b"ab") for _ in range(120))
        length, strings = r.choice([16, 24, 40]), []
        for _ in range(r.randint(1, 8)):
            x = bytearray()
            for _ in range(r.randint(0, 4)):
                i = r.randrange(100)
                x += base[i : i + r.randint(0, 60)] + bytes(r.choice(b"abc") for _ in range(r.randint(0, 5)))
            strings.append(bytes(x))
        count = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[i for i in range(len(s) - length + 1) if count[s[i : i + length]] > 1] for s in strings]
        assert [x.tolist() for x in repeated_starts(strings, length, r.choice([1, 20, 1000]))] == want


def removed(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        cover, end = [], 0
        for k in range(len(b)):
            if k <= len(b) - length and count[b[k : k + length]] > 1:
                end = k + length
            cover.append(k < end)
        runs = sum(c and not p for c, p in zip(cover, [False, *cover]))
        out.append((i, len(b), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    return sorted(out, key=str)


def test_repeated_passages_against_all_windows(spark):
    rows = list(texts().items()) + [(3, texts()[3]), (None, texts()[6])]
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for how in ({}, {"most": 1}, {"most": 1, "bits": 2}, {"grams": (120,), "part_bytes": 2000, "bits": 2}):  # few bits: anchors of different grams collide
        got = sorted((tuple(r[c] for c in cols) for r in digest_removed(documents(spark, rows), **how).collect()), key=str)
        assert got == removed(rows)
    assert digest_removed(empty(spark)).count() == 0
    docs = documents(spark, rows).withColumn("_key", F.lit("mine"))
    out = remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and {r["_key"] for r in out.collect()} == {"mine"}


def test_a_task_sends_a_repeated_context_twice_at_most():
    from tallyframe.llm.suffix_dedup import Sent, contexts_of

    raw, sent = (b"some words that come again and again in one text after another " * 40)[:400], Sent()
    states = []
    for _ in range(4):
        c = contexts_of(np.array([1]), np.array([0]), [raw], 200, 48)[:1]
        states.append(int(sent.look(c)[0]))
    assert states == [0, 1, 2, 2]


def shingles(t):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def classes(rows):
    sets = {i: shingles(t) for i, t in rows.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    top = union(ids, links)
    return {i: (len(sets[i]), top[i]) for i in ids}


def test_jaccard_classes_against_all_pairs(spark):
    for seed in (3, 5):
        rows = texts(seed, 60)
        assert by_id(jaccard_classes(documents(spark, rows)), "n_shingles", "component_id") == classes(rows)
    rows = list(texts().items()) + [(3, texts()[3]), (None, "a b c d e f g")]
    got = jaccard_classes(documents(spark, rows)).collect()
    assert len(got) == len(rows) and [(r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None] == [(3, None)]
    assert jaccard_classes(empty(spark)).count() == 0


def near_copies(n=90, seed=8):
    r = random.Random(seed)
    base, rows = [f"w{i}" for i in range(60)], {}
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(1, 2)):
            w[r.randrange(60)] = f"x{i}"
        rows[i] = " ".join(w)
    return rows


def sets_of(spark, rows):
    s = Shingler()
    return spark.createDataFrame([(i, bytearray(s.set_of(t).tobytes())) for i, t in rows.items()], "doc_id bigint, tokens binary")


def test_near_copies_by_stars_and_blocks(spark):
    rows = near_copies()
    want = {i: c for i, (_, c) in classes(rows).items()}
    assert len(set(want.values())) > 1 and max(Counter(want.values()).values()) > 10
    for block in (512, 20):
        got = {x["node"]: x["component"] for x in connecting_links(sets_of(spark, rows), 75, block).collect()}
        assert {i: got.get(i, i) for i in rows} == want
    kept = one_of_each(documents(spark, rows))
    assert {x["doc_id"] for x in kept.collect()} == set(want.values())


def test_blocks_of_all_sizes_meet(spark):
    r, rows = random.Random(5), {}
    for i in range(60):
        n = r.choice([20, 26, 34, 45, 60])
        rows[i] = " ".join(f"w{k}" for k in range(n)) + f" x{i}"
    lists = prefix_lists(sets_of(spark, rows), 8, 75)
    groups = spark.range(60).select(F.col("id").alias("node"), F.lit(0).cast("bigint").alias("g"), F.col("id").alias("c"))
    links = [(x["a"], x["b"]) for x in open_links(sets_of(spark, rows), groups, lists, 75, block=7).collect()]
    assert union(rows, links) == {i: c for i, (_, c) in classes(rows).items()}


def test_each_order_prunes_and_keeps_every_link():
    r, s = random.Random(4), Shingler()
    base = [f"w{i}" for i in range(80)]
    texts_ = []
    for k in range(200):
        cut = r.randrange(80) if k % 2 else r.randrange(4, 16)
        at = r.randrange(81 - cut)
        texts_.append(" ".join(base[at : at + cut] + [f"y{k}_{j}" for j in range(80 - cut)]))
    hub, others = s.set_of(" ".join(base)), [s.set_of(t) for t in texts_]
    yes, passed = matches(hub, others, 75)
    true = [100 * len(set(hub) & set(o)) >= 75 * len(set(hub) | set(o)) for o in others]
    assert yes.tolist() == true and any(true)
    assert 200 >= passed[0] > passed[1] > passed[2] >= sum(true) and len(passed) == 3


def test_three_orders_within_a_block():
    rows = near_copies(60)
    sets = [Shingler().set_of(t) for t in rows.values()] + [Shingler().set_of(" ".join(f"w{k}" for k in range(a, a + 60))) for a in range(5, 55, 5)]
    held = Counter(x for s in sets for x in s.tolist())
    prefixes = [np.array(sorted(s.tolist(), key=lambda x: (held[x], x))[: prefix_size(len(s), 75)], dtype=np.uint64) for s in sets]
    ids = np.arange(len(sets))
    links, passed = linked(ids, ids.copy(), sets, prefixes, 75)
    true = [(a, b) for a in ids for b in ids[:a] if 100 * len(set(sets[a].tolist()) & set(sets[b].tolist())) >= 75 * len(set(sets[a].tolist()) | set(sets[b].tolist()))]
    assert union(ids.tolist(), links) == union(ids.tolist(), true) and len(passed) == 4
    assert passed[0] > passed[1] >= passed[2] >= passed[3] >= len(true)


def test_prefixes_are_the_rarest_shingles_of_all_sets(spark):
    rows = near_copies(40)
    held = Counter(x for t in rows.values() for x in set(Shingler().set_of(t).tolist()))
    posted = {x["p_doc"]: len(x["prefix"]) // 8 for x in prefixes_of(prefix_lists(sets_of(spark, rows), 8, 75)).collect()}
    for i, t in rows.items():
        some = Shingler().set_of(t).tolist()
        alone = sum(held[x] == 1 for x in some)
        assert posted.get(i, 0) == max(0, prefix_size(len(some), 75) - alone)


def test_rows_of_one_id(spark):
    docs = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (2, "A b c d e f"), (3, "q r s t u v"), (None, "a b c d e f")])
    assert sorted(((x["doc_id"], x["component_id"]) for x in jaccard_classes(docs).collect()), key=str) == sorted([(1, 1)] * 3 + [(2, 1), (3, 1), (None, None)], key=str)
    assert sorted((str(x["doc_id"]), x["text"]) for x in one_of_each(docs).collect()) == [("1", "a b c d e f"), ("1", "q r s t u v"), ("None", "a b c d e f")]


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (5, 5), (200, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")).collect()}
    nodes = {x for a, b in links for x in (a, b)}
    assert got == union(nodes, links)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_embeddings_against_all_cosines(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(120, 32))
    x[40:80] = x[:40] + r.normal(size=(40, 32)) * 0.15
    x[80:90] = x[0] + r.normal(size=(10, 32)) * 0.1
    x[90:95] = x[1]
    rows = [(i, v.tolist(), i % 2 if i < 40 else (i - 40) % 2) for i, v in enumerate(x)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 32, 1), (503, [None] * 32, 1), (504, [float("nan")] * 32, 0), (505, x[1].tolist(), None), (506, [1.0, 2.0], 1), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame([(*a, 5) for a in rows], "vec_id bigint, embedding array<float>, label int, code int")
    got = {a["vec_id"]: (a["n_links"], a["component_id"], a["kept"]) for a in near_classes(df, block=16).collect()}
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = [(i, j) for i in range(120) for j in range(i) if rows[i][2] == rows[j][2] and y[i] @ y[j] >= 0.93]
    n, top = defaultdict(int), union(range(120), links)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    found = sum(got[i][0] for i in range(120))
    assert found >= 0.9 * 2 * len(links) and all(got[i][0] <= n[i] for i in range(120))
    assert sum(got[i][1] == top[i] for i in range(120)) >= 115
    assert all(got[i] == (0, i, True) for i in range(500, 507)) and got[None] == (0, None, None)
    assert near_classes(df.limit(0)).count() == 0


def test_rotation_balances_the_codes():
    x = np.random.default_rng(1).normal(size=(500, 16)) * np.arange(1, 17)
    p, cut = train_rotation(x, 16)
    on = (x @ p >= cut).mean(0)
    assert (np.abs(on - 0.5) < 0.02).all()
    masks = table_masks(64, 12, 12)
    assert len(masks) == 12 and all(m.bit_count() == 12 for m in masks) and sum(masks[:5]).bit_count() == 60


def test_recall_does_not_fall_with_wider_tables(spark):
    r = np.random.default_rng(12)
    one, side = r.normal(size=(600, 64)), r.normal(size=(600, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    side -= (side * one).sum(1, keepdims=True) * one
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = r.uniform(0.931, 0.935, size=(600, 1))
    two = c * one + np.sqrt(1 - c * c) * side
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([one, two]))], "vec_id bigint, embedding array<double>, label int")
    for width in (12, 16):
        got = {a["vec_id"]: a["component_id"] for a in near_classes(df, width=width).collect()}
        assert sum(got[600 + i] == i for i in range(600)) >= 0.98 * 600


def test_more_tables_for_more_vectors():
    from tallyframe.llm.itq_dedup import plan_tables

    x = np.random.default_rng(4).normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = train_rotation(x, 64)
    few, many = (plan_tables(x, model, 0.93, 0.995, 12, n) for n in (200, 10**8))
    assert few[0].bit_count() == 8 < many[0].bit_count() and len(many) > len(few) >= 12
    assert plan_tables(x[:, :2], train_rotation(x[:, :2], 2), 0.93, 0.995, 12, 10)
