import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyframe.llm.dac import Packed, pack, read_segments, tokens_at, write_segments
from tallyframe.llm.packing import best_pattern, cutting_stock, pack_documents
from tallyframe.llm.tokens import encoder, vocabulary

from .corpus import documents, empty, texts

ODD = ["", "a", "a  b", " a b ", "x\n y", "it's  the\t's", "é́ ́x", "<|endoftext|> hi", "ΑΣ ΣΑΣ'S", "İx", "1234 5 67", "\x1c a\x1d \x1eb", " " * 5, "ab " * 3 + "\n\n c", "日本語 テキスト 😀 x", "w" * 300]


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_cached_ids_equal_the_librarys(name, kind):
    lib = Tokenizer.from_file(vocabulary(name))
    lib.encode_special_tokens = True
    some = ODD + [t or "" for t in texts().values()]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in lib.encode_batch(some, add_special_tokens=False)]
    assert encoder(vocabulary(name), kind).encode(some) == want
    assert encoder(vocabulary(name), kind).encode([None]) == [b""]


@pytest.mark.parametrize("bits", [4, 8, 12])
def test_packed_ids_round_trip_and_give_random_access(bits):
    r = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 512, 513, 5000):
        ids = np.where(r.random(n) < 0.5, r.integers(0, 200, n), r.integers(0, 1 << 20, n)).astype(np.uint32)
        p = Packed(pack(ids, bits))
        assert len(p) == n and (p.get(np.arange(n)) == ids).all()
        at = r.integers(0, n, 50) if n else np.zeros(0, int)
        assert (p.get(at) == ids[at]).all()


def test_segments_hold_every_document_in_order(spark):
    rows = list(texts().items()) + [(3, "again"), (None, "no id")]
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    segments = write_segments(documents(spark, rows), segment_tokens=500)
    got = {(r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_segments(segments).collect()}
    ids = lambda t: np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
    assert sorted(n for _, _, n, _ in got) == sorted(len(ids(t)) for _, t in rows)
    start = 0
    for s, i, n, _ in sorted(got):
        assert s == start
        start += n
    order = [i for _, i, _, _ in sorted(got) if i is not None]
    assert order == sorted(order)
    assert {(i, c) for _, i, _, c in got} == {(i, zlib.crc32(ids(t).tobytes())) for i, t in rows}
    asked = spark.createDataFrame([(6, 0), (6, 2), (206, 10), (206, 10**6)], "doc_id bigint, place bigint")
    seen = {(r["doc_id"], r["place"]): r["token"] for r in tokens_at(segments, asked).collect()}
    assert seen == {(i, p): int(ids(texts()[i])[p]) for i, p in ((6, 0), (6, 2), (206, 10))}


def least_rolls(sizes, demand, capacity):
    """A lower bound: pieces that can't lie together need a roll each, and small ones what is left beside them and more."""
    best = 0
    for k in range(capacity // 2 + 1):
        huge, large = demand[sizes > capacity - k].sum(), demand[(sizes > capacity // 2) & (sizes <= capacity - k)].sum()
        beside = large * capacity - (sizes * demand)[(sizes > capacity // 2) & (sizes <= capacity - k)].sum()
        rest = (sizes * demand)[(sizes >= k) & (sizes <= capacity // 2)].sum()
        best = max(best, huge + large + max(0, -(-(rest - beside) // capacity)))
    return best


def test_column_generation_meets_the_demand_with_few_patterns():
    r = np.random.default_rng(4)
    for _ in range(5):
        sizes = np.unique(r.integers(1, 64, 25))
        demand = r.integers(1, 200, len(sizes))
        plan = cutting_stock(sizes, demand, 64)
        assert (sum(p * n for p, n in plan) == demand).all()
        assert all((p * sizes).sum() <= 64 for p, _ in plan)
        used = sum(n for _, n in plan)
        assert least_rolls(sizes, demand, 64) <= used <= least_rolls(sizes, demand, 64) * 1.02 + 2
    assert cutting_stock(np.zeros(0, int), np.zeros(0, int), 64) == []
    value, pattern = best_pattern(np.array([3, 5]), np.array([1.0, 2.0]), 11)
    assert value == 4.0 and (pattern * [3, 5]).sum() <= 11


def test_pieces_cover_every_id_once_and_fit(spark):
    rows = {**texts(), 300: "word " * 5000}
    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = pack_documents(documents(spark, rows), capacity=256).toPandas()
    for i, t in rows.items():
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for p in got[got["doc_id"] == i].sort_values("start").itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.cumsum(s["length"]) - s["length"].to_numpy()).all() and s["length"].sum() <= 256
    assert got["length"].sum() / 256 / got["sequence_id"].nunique() > 0.9


def test_empty_tables(spark):
    assert read_segments(write_segments(empty(spark))).count() == 0
    assert pack_documents(empty(spark)).count() == 0
