"""Patterns of many alternatives, written so that little is tried at each place of a text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def escaped(word: str) -> str:
    return re.sub(r"([.()\[\]{}+*?^$|\\])", r"\\\1", word)


def prefixes(words, shortest: bool = False) -> str:
    """A pattern of plain words, each first letter tried once. At each place it finds the longest word; with ``shortest`` any, where only the finding counts."""
    heads: dict[str, list[str]] = {}
    for w in dict.fromkeys(words):
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = []
    for c, tails in heads.items():
        more = "" if shortest and "" in tails else prefixes(tails, shortest)
        several = len({x[:1] for x in tails}) > 1
        parts.append(escaped(c) + (f"(?:{more})?" if more and "" in tails else f"(?:{more})" if more and several else more))
    return "|".join(parts)


def ahead(words) -> str:
    """A look at the next letters (three at most) that lets all places pass where one of these words can begin, and few others."""
    sets = ("".join(sorted({w[k] for w in words})) for k in range(min(3, *map(len, words))))
    return "(?=" + "".join("[" + re.sub(r"([\[\]\\^&-])", r"\\\1", s) + "]" for s in sets) + ")"


def any_of(words: tuple[str, ...]) -> str:
    """A pattern that is found wherever one of these plain words is; a word with another one inside is left out."""
    least = [w for w in words if not any(x != w and x in w for x in words)]
    return f"{ahead(least)}(?:{prefixes(least, shortest=True)})"


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, those in groups left together."""
    out, depth = [""], 0
    for t in re.findall(r"\\.|\[[^\]]*\]|.", pattern):
        depth += (t == "(") - (t == ")")
        out = [*out, ""] if t == "|" and depth == 0 else [*out[:-1], out[-1] + t]
    return out


def literal(alternative: str) -> str:
    """The longest run of letters that every match of it has, '' if none is known."""
    s = re.sub(r"\[[^\]]*\]", "\0", re.sub(r"\\.", "\0", alternative))
    while s != (s := re.sub(r"\([^()]*\)", "\0", s)):
        pass
    return max(re.findall(r"[^\W_]+", re.sub(r".(?:[?*]|\{[^}]*\})", "\0", s)), key=len, default="")


def says(text: Column, pattern: str, low: Column | None = None) -> Column:
    """regexp_like, but an alternative is only tried where its letters are in the text. low: the text in lower case, for a pattern of (?i)."""
    any_case = pattern.startswith("(?i)")
    if any_case and low is None:
        low = F.lower(text)

    def one(alternative: str) -> Column:
        letters, found = literal(alternative), F.regexp_like(text, F.lit("(?i)" * any_case + alternative))
        there = F.contains(low if any_case else text, F.lit(letters.lower() if any_case else letters))
        if not letters:
            return found
        return there if letters == alternative and not any_case else there & found

    return reduce(lambda a, b: a | b, map(one, alternatives(pattern.removeprefix("(?i)"))))
