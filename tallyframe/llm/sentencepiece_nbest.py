"""SentencePiece encoding with the N best segmentations, and decoding.

A text (spaces as U+2581, one put in front) spans a lattice of vocabulary pieces; a segmentation's score is the sum of
its pieces' scores, and a character without a piece becomes its UTF-8 byte pieces at a penalty. Forward Viterbi scores
are the exact cost of the best way to each place, so they serve as the heuristic of an A* search from the end, which
yields segmentations best first. No piece crosses two characters that are adjacent in no piece: there the lattice has
a cut, and texts are put together from their parts' lists without loss. New parts of one length go through Viterbi
together in numpy, which gives the best segmentation and the gap to the second best; only the parts with a text's
smallest gaps can matter to its N best, and those go through A*.

Ties prefer the segmentation whose pieces, from the end, start earlier. Scores are those that the vocabulary holds; in
a vocabulary of merges these are ranks, so the best sum need not be the segmentation that merging gives.

Cases: null and empty texts have no pieces, score 0 and one (empty) segmentation; whole texts of any length are
encoded, and words without a cut are searched as a whole, with n states kept for each character; U+2581 in a text
decodes to a space, so such a text does not round-trip; repeated rows get the same answer; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc, in_small_batches, tidied
from .tokens import vocabulary

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
    return h


class Places:
    """Where each of some hashes is, by open addressing in a sparse table, for whole arrays of hashes at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(8 * max(1, len(keys)) - 1).bit_length())
        size = 1 << self.bits
        self.keys, self.at = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(left):
            free = self.at[slot] < 0
            _, one = np.unique(np.where(free, slot, size + np.arange(len(slot))), return_index=True)
            one = one[free[one]]
            self.keys[slot[one]], self.at[slot[one]] = keys[left[one]], left[one]
            rest = np.ones(len(left), dtype=bool)
            rest[one] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)

    def _first(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the keys, -1 for others."""
        slot = self._first(hashes)
        out = self.at[slot]
        odd = np.flatnonzero((self.keys[slot] != hashes) & (out >= 0))
        out[(self.keys[slot] != hashes)] = -1
        slot, h = slot[odd], hashes[odd]
        while len(odd):
            slot = (slot + 1) & (len(self.at) - 1)
            got = self.at[slot]
            hit = (got >= 0) & (self.keys[slot] == h)
            out[odd[hit]] = got[hit]
            go = (got >= 0) & ~hit
            odd, slot, h = odd[go], slot[go], h[go]
        return out


class Pieces:
    """A vocabulary: the scores of pieces, the byte pieces, and what each id decodes to."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int], size: int, penalty: float = 10.0):
        self.ids = {p: i for p, (i, _) in scores.items()}
        self.scores = {p: s for p, (_, s) in scores.items()}
        self.longest = max(map(len, scores), default=1)
        self.unknown = min((s for s in self.scores.values() if s > -1e8), default=0.0) - penalty  # some vocabularies bar pieces by a score of -1e9
        self.byte_ids = byte_ids
        self.inside = np.array(sorted({ord(p[k]) << 21 | ord(p[k + 1]) for p in scores for k in range(len(p) - 1)} | {0}), dtype=np.int64)
        self.by_length = []
        for n in range(1, self.longest + 1):
            found = sorted((_hash(p), i, s) for p, (i, s) in scores.items() if len(p) == n) or [(0, -1, -np.inf)]
            # one row more, for what is no piece
            ids, score = np.array([*(i for _, i, _ in found), -1]), np.array([*(s for _, _, s in found), -np.inf])
            if n == 1:
                score[-1] = self.unknown
            self.by_length.append((Places(np.array([h for h, _, _ in found], dtype=np.uint64)), ids, score))
        self.whole = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in scores)  # words are no chunks then
        self._flat = None
        self.plain: list[bytes] = [b""] * size
        for p, (i, _) in scores.items():
            self.plain[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(byte_ids):
            self.plain[i] = bytes([b])

    @classmethod
    def load(cls, path: str) -> "Pieces":
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        normal = [i for i in range(n) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
        return cls({m.id_to_piece(i): (i, m.get_score(i)) for i in normal}, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], n)

    def score(self, piece: str) -> float | None:
        s = self.scores.get(piece)
        return self.unknown if s is None and len(piece) == 1 else s

    def ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]

    def parts(self, texts: list[str]) -> list[list[str]]:
        """Each text cut wherever no piece can cross."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        pair = codes[:-1] << 21 | codes[1:]
        cuts = np.flatnonzero(self.inside[np.minimum(np.searchsorted(self.inside, pair), len(self.inside) - 1)] != pair) + 1
        ends = np.cumsum([len(t) for t in texts])
        first = np.searchsorted(cuts, np.append(0, ends[:-1]), side="right")
        last = np.searchsorted(cuts, ends, side="left")
        out, cuts, base = [], cuts.tolist(), 0
        for t, a, b in zip(texts, first.tolist(), last.tolist()):
            if a == b:
                out.append([t])
            else:
                at = [0, *(c - base for c in cuts[a:b]), len(t)]
                out.append([t[x:y] for x, y in zip(at, at[1:])])
            base += len(t)
        return out

    def forward(self, text: str) -> list[float]:
        best = [0.0] + [-np.inf] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - self.longest), j):
                s = self.score(text[i:j])
                if s is not None and best[i] + s > best[j]:
                    best[j] = best[i] + s
        return best

    def n_best(self, text: str, n: int) -> list[tuple[float, list[str]]]:
        """Up to n segmentations of a text, best first: (score, pieces).

        A state is a place and the pieces from there to the end, kept as a link to the state it came from. No more than
        the n best states of a place can be part of the n best segmentations, so only these are kept, which bounds
        the heap by n for each character.
        """
        best = self.forward(text)
        states: list[tuple[int, int]] = [(len(text), -1)]  # place, the state it came from
        heap, out = [(-best[-1], len(text), 0, 0.0)], []
        tried, popped = [[] for _ in range(len(text) + 1)], [0] * (len(text) + 1)
        while heap and len(out) < n:
            _, at, k, done = heapq.heappop(heap)  # ties: the earlier place
            popped[at] += 1
            if at == 0:
                starts = []
                while k >= 0:
                    starts.append(states[k][0])
                    k = states[k][1]
                out.append((done, [text[a:b] for a, b in zip(starts, starts[1:])]))
                continue
            if popped[at] > n:
                continue
            for i in range(max(0, at - self.longest), at):
                s = self.score(text[i:at])
                if s is None or popped[i] >= n:
                    continue
                total, kept = s + done, tried[i]
                if len(kept) >= n and total <= kept[0]:
                    continue
                (heapq.heappushpop if len(kept) >= n else heapq.heappush)(kept, total)
                states.append((i, k))
                heapq.heappush(heap, (-(best[i] + total), i, len(states) - 1, total))
        return out

    def best_of(self, parts: list[str]) -> list[tuple[float, float, bytes]]:
        """For each part its best score, the gap to the second best (inf without one) and the best ids; Viterbi for all of a length at once."""
        out: list = [None] * len(parts)
        by_length = defaultdict(list)
        for k, p in enumerate(parts):
            by_length[len(p)].append(k)
        for length, all_here in by_length.items():
            step = max(1, 400_000 // (length * min(length, self.longest)))
            for a in range(0, len(all_here), step):
                here = all_here[a : a + step]
                for k, found in zip(here, self._viterbi([parts[k] for k in here], length)):
                    out[k] = found
        return out

    def _viterbi(self, parts: list[str], length: int) -> list[tuple[float, float, bytes]]:
        n, widest = len(parts), min(length, self.longest)
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64).reshape(n, length).T
        hashes, score, ids = np.zeros((length, n), dtype=np.uint64), [], []
        for w in range(1, widest + 1):  # substrings of w characters, by where they start
            hashes = hashes[: length - w + 1] * _BASE + codes[w - 1 :] + np.uint64(1)
            places, id_of, score_of = self.by_length[w - 1]
            at = places.find(hashes.ravel()).reshape(hashes.shape)
            score.append(score_of[at])
            ids.append(id_of[at])
        fore, back = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
        fore[0] = back[length] = 0
        width = np.zeros((length + 1, n), dtype=np.int64)
        for j in range(1, length + 1):
            for w in range(min(j, widest), 0, -1):  # ties: the earlier start
                v = fore[j - w] + score[w - 1][j - w]
                better = v > fore[j]
                fore[j][better], width[j][better] = v[better], w
        for i in range(length - 1, -1, -1):
            for w in range(1, min(length - i, widest) + 1):
                np.maximum(back[i], back[i + w] + score[w - 1][i], out=back[i])
        rows, end, found = np.arange(n), np.full(n, length), []
        used = [np.zeros(x.shape, dtype=bool) for x in score]
        while rows.size:
            w = width[end, rows]
            start, got = end - w, np.empty(len(rows), dtype=np.int64)
            for k in np.unique(w):
                m = w == k
                used[k - 1][start[m], rows[m]] = True
                got[m] = ids[k - 1][start[m], rows[m]]
            found.append((rows, start, got))
            rows, end = rows[start > 0], start[start > 0]
        second = np.full(n, -np.inf)
        for w in range(1, widest + 1):
            through = fore[: length - w + 1] + score[w - 1] + back[w:]
            np.maximum(second, np.where(used[w - 1], -np.inf, through).max(0), out=second)
        rows, start, got = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((start, rows))
        rows, start, got = rows[order], start[order], got[order]
        cuts = np.searchsorted(rows, np.arange(n + 1))
        raw, odd = got.astype("<u4").tobytes(), np.unique(rows[got < 0])
        best = [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for r in odd.tolist():  # characters without a piece
            some = [[i] if i >= 0 else self.ids_of(parts[r][x]) for x, i in zip(start[cuts[r] : cuts[r + 1]].tolist(), got[cuts[r] : cuts[r + 1]].tolist())]
            best[r] = np.array([i for x in some for i in x], dtype="<u4").tobytes()
        return list(zip(fore[length].tolist(), (fore[length] - second).tolist(), best))

    def decode(self, ids) -> str:
        """The text of ids: byte pieces as UTF-8, the first space taken off."""
        text = b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes that the ids of many texts stand for (counts: ids of each text), with the space put in front."""
        if self._flat is None:
            sizes = np.array([len(x) for x in self.plain], dtype=np.int64)
            self._flat = np.frombuffer(b"".join(self.plain), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes
        flat, first, sizes = self._flat
        n = sizes[ids]
        ends = np.cumsum(n)
        raw = flat[np.arange(int(n.sum())) + np.repeat(first[ids] - ends + n, n)].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def least_sums(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n least sums of one number from each list, with the chosen places; each list is sorted and starts with 0."""
    sums: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for x in lists:
        sums = heapq.nsmallest(n, ((a + b, (*c, k)) for a, c in sums for k, b in enumerate(x)))
    return sums


class TextEncoder:
    """Encodes whole texts; keeps chunks it has met, up to ``most``."""

    def __init__(self, pieces: Pieces, n: int, most: int = 300_000, whole: int = 24):
        self.pieces, self.n, self.most, self.whole = pieces, n, most, whole  # chunks of up to ``whole`` characters are searched uncut
        self.place: dict[str, int] = {}  # of a chunk in the lists below
        self.score: list[float] = []
        self.gap: list[float] = []
        self.ids: list[bytes] = []
        self.parts: dict[str, tuple[float, float, bytes]] = {}
        self.lists: dict[str, tuple[list[float], list[bytes], list[bool]]] = {}

    def _learn(self, chunks: list[str]) -> None:
        short = [c for c in chunks if len(c) <= self.whole]
        long = [c for c in chunks if len(c) > self.whole]
        self.place.update(zip(short + long, range(len(self.place), len(self.place) + len(chunks))))
        found = self.pieces.best_of(short)
        for ps in self._cut(long):
            scores, gaps, every = zip(*[self.parts[p] for p in ps])
            found.append((sum(scores), min(gaps), b"".join(every)))
        if found:
            score, gap, ids = zip(*found)
            self.score += score
            self.gap += gap
            self.ids += ids

    def _cut(self, chunks: list[str]) -> list[list[str]]:
        """The parts of chunks, which are searched if they are new."""
        cut = self.pieces.parts(chunks) if chunks else []
        new = list({p for ps in cut for p in ps}.difference(self.parts))
        self.parts.update(zip(new, self.pieces.best_of(new)))
        return cut

    def _ranked(self, part: str) -> tuple[list[float], list[bytes], list[bool]]:
        """A part's n best: gaps to its best, ids, and whether these stand for the same bytes as the best ids."""
        if part not in self.lists:
            if len(self.lists) > self.most:
                self.lists = {}
            found = self.pieces.n_best(part, self.n)
            ids = [np.array([i for x in xs for i in self.pieces.ids_of(x)], dtype="<u4") for _, xs in found]
            plain = [b"".join(map(self.pieces.plain.__getitem__, x.tolist())) for x in ids]
            self.lists[part] = [found[0][0] - s for s, _ in found], [x.tobytes() for x in ids], [x == plain[0] for x in plain]
        return self.lists[part]

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, list[float]]]:
        """For each text the best ids (little-endian 32-bit) and the scores of the n best segmentations."""
        return [(ids[0], scores) for ids, scores, _ in self.encode_all(texts)]

    def encode_all(self, texts: list[str | None]) -> list[tuple[list[bytes], list[float], list[bool]]]:
        """For each text its n best segmentations: ids, scores, and whether the ids stand for the same bytes as the best ones."""
        split = [([normalised(t)] if self.pieces.whole else _CHUNK.findall(normalised(t))) if t else [] for t in texts]
        if max(len(self.place), len(self.parts)) > self.most:
            self.place, self.score, self.gap, self.ids, self.parts = {}, [], [], [], {}
        if new := set().union(*split).difference(self.place):
            self._learn(list(new))
        score, gap = np.array(self.score), np.array(self.gap)
        get, ids_of, few = self.place.__getitem__, self.ids.__getitem__, self.n - 1
        rows, close = [], set()
        for chunks in split:
            at = list(map(get, chunks))
            places = np.array(at, dtype=np.int64)
            gaps, total = gap[places], float(score[places].sum())
            limit = np.partition(gaps, few - 1)[few - 1] if few and len(gaps) > few else np.inf
            near = np.flatnonzero(gaps <= limit)
            least = near[np.argsort(gaps[near], kind="stable")[:few]].tolist()
            rows.append((at, total, least))
            close.update(chunks[k] for k in least)
        cut, out = dict(zip(close, self._cut(list(close)))), []
        for chunks, (at, total, least) in zip(split, rows):
            near = heapq.nsmallest(few, ((self.parts[p][1], k, j, p) for k in least for j, p in enumerate(cut[chunks[k]])))
            ranked = [self._ranked(p) for _, _, _, p in near]
            sums, best = least_sums([x[0] for x in ranked], self.n), list(map(ids_of, at))
            ids, same = [], []
            for _, choice in sums:
                new = {(k, j): x[1][c] for (_, k, j, _), x, c in zip(near, ranked, choice) if c}
                here = best.copy() if new else best
                for k in {k for k, _ in new}:
                    here[k] = b"".join([new.get((k, j)) or self.parts[p][2] for j, p in enumerate(cut[chunks[k]])])
                ids.append(b"".join(here))
                same.append(all(x[2][c] for x, c in zip(ranked, choice)))
            out.append((ids, [total - s for s, _ in sums], same))
        return out


@functools.lru_cache(maxsize=1)
def _encoder(path: str, n: int) -> TextEncoder:
    """A worker's encoder, which stays from task to task."""
    return TextEncoder(Pieces.load(path), n)


def _lists(raws: list[bytes]) -> pa.ListArray:
    """Little-endian 32-bit numbers as a list of numbers for each of raws."""
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raws])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raws), dtype="<i4")))


def segment(docs: DataFrame, n: int = 4, vocab: str | None = None, every: bool = False) -> DataFrame:
    """Per document: doc_id, n_pieces, n_byte_pieces, scores (of the n best, best first), ids_crc32, round_trip, ids (of the best), crc32s, round_trips (of each of the n); with every also segmentations (the ids of each of the n)."""
    path = vocab or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, n)
        pieces = encoder.pieces
        is_byte = np.zeros(len(pieces.plain), dtype=bool)
        is_byte[pieces.byte_ids] = True
        for batch in batches:
            for a in range(0, batch.num_rows, 400):
                some = batch.slice(a, 400)
                texts = [t or "" for t in some.column(1).to_pylist()]
                got = encoder.encode_all(texts)
                best = [x[0] for x, _, _ in got]
                ids = np.frombuffer(b"".join(best), dtype="<u4").astype(np.int64)
                counts = np.array([len(x) // 4 for x in best], dtype=np.int64)
                bytes_of = np.concatenate([[0], np.cumsum(is_byte[ids])])[np.concatenate([[0], np.cumsum(counts)])]
                ok = [x == (b" " + t.encode("utf-8", "surrogatepass") if t else b"") for x, t in zip(pieces.decoded(ids, counts), texts)]
                # ids of the same bytes decode to the same text
                trips = [[good if same else pieces.decode(np.frombuffer(x, dtype="<u4").tolist()) == t for x, same in zip(xs, sames)] for t, good, (xs, _, sames) in zip(texts, ok, got)]
                crcs = [[crc(x) for x in xs] for xs, _, _ in got]
                columns = [some.column(0), pa.array(counts), pa.array(np.diff(bytes_of)), pa.array([s for _, s, _ in got], pa.list_(pa.float64())), pa.array([c[0] for c in crcs], pa.int64()), pa.array(ok, pa.bool_()), _lists(best), pa.array(crcs, pa.list_(pa.int64())), pa.array(trips, pa.list_(pa.bool_()))]
                if every:
                    ends = np.concatenate([[0], np.cumsum([len(xs) for xs, _, _ in got])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), _lists([x for xs, _, _ in got for x in xs])))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, n_pieces bigint, n_byte_pieces bigint, scores array<double>, ids_crc32 bigint, round_trip boolean, ids array<int>, crc32s array<bigint>, round_trips array<boolean>" + (", segmentations array<array<int>>" if every else "")
    names = [x.split()[0] for x in schema.split(", ")]
    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), schema)
