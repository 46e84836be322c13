"""Merging Burrows-Wheeler transforms of shards by iterative interleave refinement.

A collection of byte strings is read as strings over 8-byte words, one string for each of the 8 phases of each byte
string, so that a match of 200 bytes is a match of 25 words from the same start. Each shard is sorted once, by itself,
and is known by its Burrows-Wheeler transform from then on. The shards' transforms are then interleaved: in round k the
suffixes of all shards are in the order of their first k words, and one backward step through every transform gives
the order by k + 1 words as a merge of already sorted runs, one for each shard; no suffix is sorted again. A boundary
that first shows in round k between neighbours means that they share exactly k - 1 words; classes without a boundary
after the last round are the repeated intervals.
"""

from __future__ import annotations

import numpy as np

WORD = 8


class Words:
    """The words at every byte of these strings, named by rank over the whole collection; 0 is the end of a string."""

    def __init__(self, strings: list[bytes]):
        buffer = np.frombuffer(b"".join(strings) + bytes(WORD), dtype=np.uint8)
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        n = np.maximum(sizes - WORD + 1, 0)
        self.owner = np.repeat(np.arange(len(strings), dtype=np.int32), n)
        self.at = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)  # the byte in its string
        self.left = np.repeat(n.astype(np.int32), n) - self.at  # places up to the last one with a whole word
        place = starts[self.owner] + self.at
        word = np.zeros(len(place), dtype=np.uint64)
        for k in range(WORD):
            word = word << np.uint64(8) | buffer[place + k]
        self.name = np.unique(word, return_inverse=True)[1].astype(np.int32) + 1


class Shard:
    """One shard's transform: for its sorted suffixes the word before each, and where a backward step leads.

    Only the transform is used after construction: ``source`` lists the suffixes by the word before them, which is
    the order of the longer suffixes that begin with that word.
    """

    def __init__(self, words: Words, a: int, b: int, depth: int):
        name, left = words.name[a:b], words.left[a:b]
        n = b - a
        rank, have = np.append(name, 0).astype(np.int64), 1
        while have < depth:
            step = min(have, depth - have)
            after = np.where(left > WORD * step, np.arange(n) + WORD * step, n)
            key = rank[:n] * (int(rank.max()) + 1) + rank[after]
            rank = np.append(np.unique(key, return_inverse=True)[1] + 1, 0)
            have += step
        order = np.argsort(rank[:n], kind="stable")
        self.suffix = (order + a).astype(np.int32)
        at = words.at[a:b]
        ends = np.flatnonzero(left <= WORD)  # the last words: each is before an end of string
        before = np.where(at >= WORD, name[np.maximum(np.arange(n) - WORD, 0)], 0)
        self.transform = np.concatenate([name[ends], before[order]])
        self.ends = len(ends)
        self.first = name[order]
        self.source = np.argsort(self.transform, kind="stable")[np.count_nonzero(self.transform == 0) :]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of all shards in merged order, the words each shares with the one before (up to depth), the transform."""
    sizes = [len(s.suffix) for s in shards]
    total, cuts = sum(sizes), np.cumsum([0, *sizes])
    shared = np.full(total, depth, dtype=np.int16)
    known = np.zeros(total, dtype=bool)
    classes = [np.zeros(n, dtype=np.int64) for n in sizes]
    order, count = np.arange(total), 0
    for k in range(depth):
        keys = np.concatenate([s.first.astype(np.int64) << np.int64(32) | np.concatenate([np.zeros(s.ends, np.int64), c])[s.source] for s, c in zip(shards, classes)]) if total else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")  # merges one sorted run for each shard
        sorted_keys = keys[order]
        edge = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])[:total]
        shared[edge & ~known] = k
        known |= edge
        number = np.empty(total, dtype=np.int64)
        number[order] = np.cumsum(edge)
        classes = [number[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        if int(edge.sum()) == count:
            break
        count = int(edge.sum())
    suffix = np.concatenate([s.suffix for s in shards])[order] if total else order
    transform = np.concatenate([s.transform[s.ends :] for s in shards])[order] if total else order
    return suffix, shared, transform


def repeated_starts(strings: list[bytes], length: int, shard_bytes: int = 1 << 19) -> list[np.ndarray]:
    """For each string, where in it a substring of this length (a multiple of 8) starts that starts elsewhere too."""
    depth, words = length // WORD, Words(strings)
    counts = np.bincount(words.owner, minlength=len(strings))
    ends, shards, a = np.cumsum(counts), [], 0
    for b in ends.tolist():
        if b - a >= shard_bytes or b == ends[-1]:
            if b > a:
                shards.append(Shard(words, a, b, depth))
            a = b
    if not shards:
        return [np.zeros(0, np.int64) for _ in strings]
    suffix, shared, _ = merge(shards, depth)
    same = shared >= depth
    twice = same.copy()
    twice[:-1] |= same[1:]
    found = np.sort(suffix[twice])
    found = found[words.left[found] > WORD * (depth - 1)]  # the whole length lies in its string
    cut = np.searchsorted(words.owner[found], np.arange(len(strings) + 1))
    return [words.at[found[i:j]] for i, j in zip(cut[:-1], cut[1:])]
