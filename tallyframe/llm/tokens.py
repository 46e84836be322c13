"""Tokenisation with a public vocabulary, cached by pre-token.

Both vocabularies first cut a text with a fixed pattern and never merge across the cuts, so a text's ids are its
pre-tokens' ids put together. Words repeat, so each Python worker keeps the ids of pre-tokens it has met (a bounded
cache) and gives only new ones to the tokenizers library, many at a time.
"""

from __future__ import annotations

import os
import re

import numpy as np
import regex

#: The patterns by which the vocabularies cut texts; fixed values of those vocabularies.
CUTS = {
    "byte": r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
    "word": r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""",
}
#: Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: b for b in _PLAIN} | {b: 0x100 + k for k, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}
_SPACE = chr(_BYTES[0x20])
_ENCODERS: dict[tuple[str, str], "CachedEncoder"] = {}


class CachedEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes."""

    #: Pre-tokens in each of the cache's two generations; longer ones are not kept; how many the library gets at once.
    CACHE, LONGEST, AT_ONCE = 220_000, 48, 2_000

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.pieces = self.library.model.tokenize  # of one pre-token, without the library's bookkeeping of places in texts
        self.cut = regex.compile(CUTS[kind]).findall
        # the same pattern for ASCII texts, in which these are all letters, numbers and white space there are
        self.cut_ascii = re.compile(CUTS[kind].replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace(" ?a-zA-Z+", " ?[a-zA-Z]+").replace(" ?0-9+", " ?[0-9]+"), re.ASCII).findall
        self.lower = kind == "word"
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pre_tokens(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self.lower:
            return self.cut_ascii(text) if text.isascii() else self.cut(text)
        # the library composes and lower-cases each character by itself; a capital sigma would depend on what follows
        if text.isascii():
            return self.cut_ascii(text.lower())
        text = self.library.normalizer.normalize_str(text) if "Σ" in text or "İ" in text else _composed(text).lower()
        return self.cut(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.CACHE:
            self.older, self.known = self.known, {}
        known, older, out = self.known, self.older, []
        parts = [self.pre_tokens(t) for t in texts]
        new = set().union(*parts).difference(known)
        if older:
            back = new.intersection(older)
            known.update({k: older[k] for k in back})
            new -= back
        long_ones = [c for c in new if len(c) > self.LONGEST]
        fresh = list(new)
        for i in range(0, len(fresh), self.AT_ONCE):
            some = fresh[i : i + self.AT_ONCE]
            ids, ends = [], [0]
            for c in some:
                ids += [x.id for x in self.pieces(c.replace(" ", _SPACE) if c.isascii() and c.isprintable() else c.encode().decode("latin1").translate(_BYTES))]
                ends.append(4 * len(ids))
            raw = np.array(ids, dtype="<u4").tobytes()
            known.update(zip(some, [raw[a:b] for a, b in zip(ends, ends[1:])]))
        get = known.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        for c in long_ones:
            del known[c]
        return out


def _composed(text: str) -> str:
    import unicodedata

    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def encoder(path: str, kind: str) -> CachedEncoder:
    """One encoder for each vocabulary and Python worker. kind: a key of CUTS."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = CachedEncoder(path, kind)
    return _ENCODERS[path, kind]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
