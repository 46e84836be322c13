import random

import numpy as np

from tallyframe.llm.sentencepiece_nbest import Pieces, TextEncoder, normalised, segment
from tallyframe.llm.tokens import vocabulary

from .corpus import by_id, documents, empty, texts


def every(pieces, t):
    out = []

    def go(i, s, ps):
        if i == len(t):
            out.append((s, tuple(ps)))
        for j in range(i + 1, min(len(t), i + pieces.longest) + 1):
            x = pieces.score(t[i:j])
            if x is not None:
                go(j, s + x, ps + [t[i:j]])

    go(0, 0.0, [])
    return out


def test_n_best_against_all_segmentations():
    r = random.Random(2)
    for _ in range(150):
        vocab = {}
        for _ in range(r.randint(3, 12)):
            vocab.setdefault("".join(r.choice("ab▁") for _ in range(r.randint(1, 4))), (300 + len(vocab), -float(r.randint(1, 9))))
        p = Pieces(vocab, list(range(256)), 400)
        t = "".join(r.choice("ab c") for _ in range(r.randint(1, 8)))
        want = sorted((s for s, _ in every(p, normalised(t))), reverse=True)[:5]
        ((ids, scores),) = TextEncoder(p, 5).encode([t])
        found = p.n_best(normalised(t), 5)
        assert scores == want == [s for s, _ in found] and len({tuple(x) for _, x in found}) == len(found)
        assert [i for x in found[0][1] for i in p.ids_of(x)] == np.frombuffer(ids, "<u4").tolist()
        assert p.decode(np.frombuffer(ids, "<u4").tolist()) == t


def test_small_caches_change_nothing():
    p = Pieces.load(vocabulary("piece_bpe_32k.model"))
    some = [t for t in texts().values() if t]
    assert TextEncoder(p, 4).encode(some) == [TextEncoder(p, 4, most=3).encode([t])[0] for t in some]


def test_every_document_decodes_to_itself(spark):
    rows = texts()
    got = by_id(segment(documents(spark, rows)), "n_pieces", "scores", "round_trip")
    assert set(got) == set(rows) and all(ok for _, _, ok in got.values())
    assert got[203] == (0, [0.0], True) and got[202] == (0, [0.0], True)
    assert all(list(s) == sorted(s, reverse=True) and len(s) <= 4 for _, s, _ in got.values())
    assert segment(empty(spark)).count() == 0


def test_each_of_the_n_best_against_all_segmentations():
    r = random.Random(6)
    for _ in range(150):
        vocab = {}
        for _ in range(r.randint(3, 12)):
            vocab.setdefault("".join(r.choice("ab▁") for _ in range(r.randint(1, 4))), (300 + len(vocab), -float(r.randint(1, 9))))
        p = Pieces(vocab, list(range(256)), 400)
        t = "".join(r.choice("ab c") for _ in range(r.randint(1, 8)))
        score_of = {tuple(i for x in ps for i in p.ids_of(x)): s for s, ps in every(p, normalised(t))}
        ((ids, scores, _),) = TextEncoder(p, 5).encode_all([t])
        found = [tuple(np.frombuffer(x, "<u4").tolist()) for x in ids]
        assert len(set(found)) == len(found) == min(5, len(score_of)) and [score_of[x] for x in found] == scores
        assert all(p.decode(x) == t for x in found)


def test_checksums_and_round_trips_of_each(spark):
    got = segment(documents(spark, {1: "some words here", 2: ""})).collect()
    assert all(len(r["crc32s"]) == len(r["round_trips"]) == len(r["scores"]) and all(r["round_trips"]) and r["crc32s"][0] == r["ids_crc32"] for r in got)
    assert {len(set(r["crc32s"])) for r in got} == {1, 4}
