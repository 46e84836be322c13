"""Words of texts and a bounded table of numbers for each word met, kept by each Python worker."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: A word is a run of characters other than the space and the control white space U+0009 to U+000D.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class WordTable:
    """Rows of numbers by word. ``rows_of`` gives the rows of new words; a table of more than ``most`` words starts afresh."""

    def __init__(self, rows_of: Callable[[list[str]], np.ndarray], most: int = 500_000):
        self.rows_of, self.most, self.place = rows_of, most, {}
        self.rows: np.ndarray | None = None

    def look(self, words_by_text: list[list[str]]) -> np.ndarray:
        """The place in self.rows of every word of these texts, one after another."""
        if len(self.place) > self.most:
            self.place, self.rows = {}, None
        place = self.place
        new = list(set().union(*words_by_text).difference(place))
        if new or self.rows is None:
            got, n = self.rows_of(new), len(place)
            if self.rows is None or n + len(got) > len(self.rows):
                grown = np.empty((max(1024, 2 * (n + len(got))), *got.shape[1:]), dtype=got.dtype)
                if n:
                    grown[:n] = self.rows[:n]
                self.rows = grown
            self.rows[n : n + len(got)] = got
            place.update(zip(new, range(n, n + len(new))))
        get = place.__getitem__
        return np.fromiter((get(w) for ws in words_by_text for w in ws), dtype=np.int64, count=sum(map(len, words_by_text)))


def joined_bytes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the words with a 0 before, between and after, and each word's start among them."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    buffer = np.frombuffer(b"\0" + b"\0".join(raw) + b"\0\0", dtype=np.uint8)
    return buffer, np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(raw) else np.zeros(0, np.int64)
