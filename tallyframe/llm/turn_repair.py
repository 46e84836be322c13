"""Conversation structure repair: the cheapest edits that give a conversation the role pattern ``(s?(ua)+)?``.

A conversation is a path of rows through the automaton of that pattern (states: nothing yet, after system, after user,
after assistant). Arcs are edits: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or assistant
turn 3; an undeleted truncated row adds 3, blank and duplicate rows are deleted. Forward and backward minimum costs say
of every arc whether it is tight, that is on a cheapest path; a set of states then walks along tight arcs only, always
by the least letter, so the audit is the ASCII-least of all cheapest ones. Roles follow from it: an odd number of
turns begins with system.

Rows are dealt by range of conversation and turn and sorted. A conversation that lies within one task and has at most
``BLOCK_ROWS`` rows is repaired on the way. Others, of any length, are cut in blocks: each block is a (min, +) matrix
over the four states, costs at block borders come from scanning the matrices, each block then tells for every set of
states it may be entered with the set it leaves, the sets are chained over blocks, and blocks write their letters and
turns side by side. One task only streams a conversation's finished pieces through its SHA-256, which has no other way.

Cases: rows with one turn come by role and then text; nulls in role, text, and in conv_id and turn as they enter the
checksum, are one space; rows of a null conv_id are one conversation of their own; texts of any length are hashed whole
(128 bits tell texts apart); repeated rows are duplicates of their first; a conversation without rows after damage has
zeros, an empty audit and the hash of nothing; no rows give an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, join_by_key, materialise, tasks_for, tidied

#: Costs, states (nothing, after s, after u, after a) and where a kept role or an inserted one leads.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, S, U, A = range(4)
FAR = 1 << 50
_TO_USER, _TO_ASSISTANT = (START, S, A), (U,)
#: Faults of a row.
SOUND, BLANK, REPEATED, CUT, DROPPED = range(5)
BLOCK_ROWS, BLOCK_BYTES = 1024, 8_000_000


def arcs_of(initial: str, fault: int) -> list[tuple[str, int, int, int]]:
    """What a row allows: (letter, cost, from, to)."""
    out = [("D", DELETE, s, s) for s in range(4)]
    if fault in (SOUND, CUT):
        more = TRUNCATED if fault == CUT else 0
        kept = {"s": ((START, S),), "u": tuple((s, U) for s in _TO_USER), "a": tuple((s, A) for s in _TO_ASSISTANT)}.get(initial, ())
        out += [("K", KEEP + more, s, t) for s, t in kept]
        out += [("R", REROLE + more, s, U) for s in _TO_USER] + [("R", REROLE + more, s, A) for s in _TO_ASSISTANT]
    return out


#: Arcs by class of row (initial s, u, a or another; fault), and those that stay between rows.
CLASSES = {(i, f): k for k, (i, f) in enumerate((i, f) for i in "sua?" for f in (SOUND, BLANK, REPEATED, CUT))}
ARCS = [arcs_of(i, f) for i, f in CLASSES]
INSERTS = [("I", INSERT, s, U) for s in _TO_USER] + [("I", INSERT, s, A) for s in _TO_ASSISTANT]


def class_of(role: str, fault: int) -> int:
    return CLASSES[role[:1] if role[:1] in ("s", "u", "a") else "?", fault]


def _inserted(cost: list[int], back: bool = False) -> list[int]:
    """Costs with insertions before the next row; twice, since an inserted user may be followed by an inserted assistant."""
    for _ in range(2):
        for _, w, s, t in INSERTS:
            a, b = (t, s) if back else (s, t)
            cost[b] = min(cost[b], cost[a] + w)
    return cost


def forward(codes: bytes, entry: list[int]) -> list[list[int]]:
    """Least costs to each state before each row and after the last; entry: before insertions."""
    rows = [_inserted(list(entry))]
    for c in codes:
        here, then = rows[-1], [FAR] * 4
        for _, w, s, t in ARCS[c]:
            then[t] = min(then[t], here[s] + w)
        rows.append(_inserted(then))
    return rows


def backward(codes: bytes, after: list[int]) -> list[list[int]]:
    """Least costs from each state before each row, and after the last, to the end; after: the costs behind the last row."""
    rows = [list(after)]
    for c in reversed(codes):
        then, here = rows[-1], [FAR] * 4
        for _, w, s, t in ARCS[c]:
            here[s] = min(here[s], then[t] + w)
        rows.append(_inserted(here, back=True))
    return rows[::-1]


#: Costs to the end from behind the last row: a conversation may end with nothing or after an assistant.
AT_END = _inserted([0, FAR, FAR, 0], back=True)


def walk(codes: bytes, entry: frozenset[int], before: list[list[int]], after: list[list[int]], last: bool) -> tuple[str, frozenset[int]]:
    """The least letters along tight arcs from a set of states, and the states they lead to; the last block also inserts behind its rows."""
    total = min(f + b for f, b in zip(before[0], after[0]))
    at, states, letters = 0, entry, []
    while True:
        ended = at == len(codes)
        if ended and (not last or any(s in (START, A) and before[at][s] == total for s in states)):
            return "".join(letters), states
        found: dict[str, set[int]] = {}
        for letter, w, s, t in INSERTS:
            if s in states and before[at][s] + w + after[at][t] == total:
                found.setdefault(letter, set()).add(t)
        if not ended:
            for letter, w, s, t in ARCS[codes[at]]:
                if s in states and before[at][s] + w + after[at + 1][t] == total:
                    found.setdefault(letter, set()).add(t)
        least = min(found)
        letters.append(least)
        states = frozenset(found[least])
        at += least != "I"


def repaired(letters: str, roles: list[str], texts: list[str], place: int) -> tuple[list[str], int]:
    """The turns that letters leave of rows, as role:text. place: of the next turn within its pair, or -1 where system comes first."""
    out, k = [], 0
    for x in letters:
        if x == "D":
            k += 1
            continue
        role = ("user", "assistant")[place % 2] if place >= 0 else "system"
        place += 1
        if x == "I":
            out.append(f"{role}:")
        else:
            out.append(f"{roles[k] if x == 'K' else role}:{texts[k]}")
            k += 1
    return out, place


def matrix(codes: bytes) -> list[int]:
    """Least costs from each state before a block to each state before the next one (insertions in front of each row counted)."""
    out = []
    for s in range(4):
        entry = [FAR] * 4
        entry[s] = 0
        cost = entry
        for c in codes:
            cost, then = _inserted(cost), [FAR] * 4
            for _, w, a, b in ARCS[c]:
                then[b] = min(then[b], cost[a] + w)
            cost = then
        out += cost
    return out


_STATS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, tmin bigint, tmax bigint, turns bigint, first string, last string, n bigint"
_BLOCK = f"absent boolean, conv bigint, part int, blk int, whole boolean, gaps bigint, cost bigint, audit string, sha string, {_STATS}, codes binary, matrix array<bigint>, roles array<string>, texts array<string>"


class _Run:
    """Rows of one conversation, in order, as far as one task has met them."""

    def __init__(self, key):
        self.key, self.bytes, self.prev, self.blk = key, 0, None, 0
        self.clear()

    def clear(self):
        self.roles, self.texts, self.turns, self.faults, self.bytes = [], [], [], [], 0

    def add(self, turn, role, text, fault):
        same = (turn, role, text)
        if fault != BLANK and same == self.prev:
            fault = REPEATED  # repeated rows stand side by side
        self.prev = same
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.faults.append(fault)
        self.bytes += len(text) + len(role)

    def stats(self) -> dict:
        turns, marks = [t for t in self.turns if t is not None], [r[:1] for r in self.roles]
        count = lambda f: self.faults.count(f)
        return {
            "blank": count(BLANK), "duplicate": count(REPEATED), "truncated": count(CUT), "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:])),
            "tmin": turns[0] if turns else None, "tmax": turns[-1] if turns else None, "turns": len(set(turns)), "first": marks[0] if marks else None, "last": marks[-1] if marks else None, "n": len(marks),
        }

    def row(self, part: int, whole: bool) -> dict:
        stats, codes = self.stats(), bytes(class_of(r, f) for r, f in zip(self.roles, self.faults))
        out = {"absent": self.key[0], "conv": self.key[1], "part": part, "blk": self.blk, "whole": whole, **stats}
        self.blk += 1
        if whole:
            before, after = forward(codes, [0, FAR, FAR, FAR]), backward(codes, AT_END)
            letters, _ = walk(codes, frozenset([START]), before, after, True)
            turns, _ = repaired(letters, self.roles, self.texts, _first_place(letters))
            gaps = stats["tmax"] - stats["tmin"] + 1 - stats["turns"] if stats["turns"] else 0
            out |= {"gaps": gaps, "cost": min(a + b for a, b in zip(before[0], after[0])), "audit": letters, "sha": _sha("\n".join(turns))}
        else:
            out |= {"codes": codes, "matrix": matrix(codes), "roles": self.roles, "texts": self.texts}
        self.clear()
        return out


def _first_place(letters: str) -> int:
    """-1 where an odd number of turns is left: only a kept system turn makes it odd."""
    return -((len(letters) - letters.count("D")) % 2)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _blocks(schema: pa.Schema):
    """Sorted rows to repaired conversations, and to blocks of those that may go on in other tasks or are long."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, first, out = TaskContext.get().partitionId(), None, True, []

        def emitted(rows):
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for absent, conv, turn, role, text, fault in zip(*(batch.column(k).to_pylist() for k in ("absent", "conv", "turn", "role", "text", "fault"))):
                if now is None or now.key != (absent, conv):
                    if now is not None:
                        out.append(now.row(part, not first and now.blk == 0))
                        first = False
                    now = _Run((absent, conv))
                if fault == DROPPED:
                    continue
                if len(now.roles) >= BLOCK_ROWS or now.bytes >= BLOCK_BYTES:
                    out.append(now.row(part, False))
                now.add(turn, role, text, fault)
                if len(out) >= 500 or (out and not out[-1]["whole"]):
                    yield emitted(out)
                    out = []
        if now is not None:
            out.append(now.row(part, False))
        if out:
            yield emitted(out)

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, with their key (absent: of a null conv_id), and their fault; rows that damage drops stay as such, so that their conversations do.

    A row is marked as repeated where an earlier turn has its role and text; the same within one turn is seen in order.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = rows.select(F.col("conv_id").isNull().alias("absent"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "turn", "role", "text", kind.alias("kind"))
    rows = rows.select(
        "absent", "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        "kind", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
    one, two = F.xxhash64("absent", "role", "text"), F.xxhash64(F.lit(7), "text", "role", "absent")
    order = F.struct(F.col("turn").isNotNull().alias("dated"), F.coalesce("turn", F.lit(0)).alias("turn"))  # nulls first
    rows = rows.withColumns({"h1": one, "h2": two, "order": order})
    seen = rows.where("kind <> 0").groupBy("conv", "h1", "h2").agg(F.min("order").alias("earliest"), F.count("*").alias("weight")).where("weight > 1")
    seen = materialise(seen, "repair-seen")
    rows = join_by_key(rows, seen, ["conv", "h1", "h2"], "weight", how="left")
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    ends = F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    fault = F.when(F.col("kind") == 0, DROPPED).when(blank, BLANK).when(F.col("order") > F.col("earliest"), REPEATED).when(~ends, CUT).otherwise(SOUND)
    return rows.select("absent", "conv", "turn", "role", "text", fault.alias("fault"))


def _scanned(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's blocks: costs at their borders, and (on the first) the conversation's counts."""
    pdf = pdf.sort_values(["part", "blk"], ignore_index=True)
    mats = np.array(pdf["matrix"].tolist(), dtype=np.int64).reshape(-1, 4, 4)
    f, fs = np.array([0, FAR, FAR, FAR]), []
    for m in mats:
        fs.append(f.tolist())
        f = np.minimum((f[:, None] + m).min(0), FAR)
    b, bs = np.array(AT_END), []
    for m in mats[::-1]:
        bs.append(b.tolist())
        b = np.array(_inserted(np.minimum((m + b[None, :]).min(1), FAR).tolist(), back=True))
    n = len(pdf)
    some = pdf[pdf["n"] > 0]
    marks = list(zip(some["first"], some["last"]))
    between = sum(a[1] + c[0] not in ("su", "ua", "au") for a, c in zip(marks, marks[1:]))
    dated = pdf[pdf["turns"] > 0]
    lo, hi = dated["tmin"].astype("int64").tolist(), dated["tmax"].astype("int64").tolist()
    turns = int(dated["turns"].sum()) - sum(x == y for x, y in zip(hi, lo[1:]))
    whole = {"gaps": hi[-1] - lo[0] + 1 - turns if lo else 0, "blank": pdf["blank"].sum(), "duplicate": pdf["duplicate"].sum(), "truncated": pdf["truncated"].sum(), "illegal": pdf["illegal"].sum() + between, "cost": b[START]}
    out = pdf[["absent", "conv", "part", "blk"]].assign(entry=fs, leave=bs[::-1], last=[k == n - 1 for k in range(n)])
    for k, v in whole.items():
        out[k] = int(v)
    return out


def _subset(states) -> int:
    return sum(1 << s for s in states)


def _of(mask: int) -> frozenset[int]:
    return frozenset(s for s in range(4) if mask >> s & 1)


def _exits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each set of states with cheapest paths through a block: the states it leaves, and how many turns it writes."""
    for pdf in frames:
        rows = []
        for r in pdf.itertuples(index=False):
            before, after = forward(r.codes, list(r.entry)), backward(r.codes, list(r.leave))
            total = min(a + b for a, b in zip(before[0], after[0]))
            tight = [s for s in range(4) if r.entry[s] + after[0][s] == total]
            exits, turns = [-1] * 16, [0] * 16
            for mask in range(1, 16):
                if set(_of(mask)) <= set(tight):
                    letters, states = walk(r.codes, _of(mask), before, after, r.last)
                    exits[mask], turns[mask] = _subset(states), len(letters) - letters.count("D")
            rows.append((r.absent, r.conv, r.part, r.blk, exits, turns))
        yield pd.DataFrame(rows, columns=["absent", "conv", "part", "blk", "exits", "turns"])


def _chained(pdf: pd.DataFrame) -> pd.DataFrame:
    """The set of states that each block of one conversation is entered with, and the place of its first turn."""
    pdf = pdf.sort_values(["part", "blk"], ignore_index=True)
    mask, masks, before, places = 1 << START, [], 0, []
    for exits, turns in zip(pdf["exits"], pdf["turns"]):
        masks.append(mask)
        places.append(before)
        before += int(turns[mask])
        mask = int(exits[mask])
    odd = before % 2
    return pdf[["absent", "conv", "part", "blk"]].assign(mask=masks, place=[p - odd for p in places])


def _written(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each block's letters and repaired turns."""
    for pdf in frames:
        rows = []
        for r in pdf.itertuples(index=False):
            before, after = forward(r.codes, list(r.entry)), backward(r.codes, list(r.leave))
            letters, _ = walk(r.codes, _of(r.mask), before, after, r.last)
            turns, _ = repaired(letters, r.roles, r.texts, r.place)
            rows.append((r.absent, r.conv, r.part, r.blk, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, letters, "\n".join(turns), len(turns)))
        yield pd.DataFrame(rows, columns=["absent", "conv", "part", "blk", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "letters", "piece", "turns"])


_RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _joined(schema: pa.Schema):
    """Sorted pieces to conversations: letters put together, turns streamed through the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, letters, sha, any_turn = None, None, [], None, False

        def done():
            return pa.RecordBatch.from_pylist([row | {"audit": "".join(letters), "repaired_sha256": sha.hexdigest()}], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if (r["absent"], r["conv"]) != key:
                    if key is not None:
                        yield done()
                    key, letters, sha, any_turn = (r["absent"], r["conv"]), [], hashlib.sha256(), False
                    row = {"conv_id": None if r["absent"] else r["conv"]} | {k: r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
                letters.append(r["letters"])
                if r["turns"]:
                    sha.update((("\n" if any_turn else "") + r["piece"]).encode("utf-8", "surrogatepass"))
                    any_turn = True
        if key is not None:
            yield done()

    return run


def repair(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text), damaged and repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = conversations.sparkSession
    in_small_batches(spark)
    rows, n = damaged(conversations), tasks_for(conversations)
    near = lambda c: F.substring(c, 1, 32)  # noqa: E731  beginnings deal as the whole would, and are small where borders are chosen
    keys = ["absent", "conv", F.col("turn").asc_nulls_first()]
    rows = rows.repartitionByRange(n, *keys, near("role"), near("text")).sortWithinPartitions(*keys, "role", "text")
    blocks = materialise(rows.mapInArrow(_blocks(_arrow(_BLOCK)), _BLOCK), "repair-blocks")
    whole = blocks.where("whole").select(F.when(~F.col("absent"), F.col("conv")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.col("audit"), F.col("sha").alias("repaired_sha256"))
    cut, key = blocks.where("not whole"), ["absent", "conv", "part", "blk"]
    stats = [x.split()[0] for x in _STATS.split(", ")]
    costs = cut.select(*key, "matrix", *stats).groupBy("absent", "conv").applyInPandas(_scanned, "absent boolean, conv bigint, part int, blk int, entry array<bigint>, leave array<bigint>, last boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint")
    costs = materialise(costs, "repair-costs")
    exits = cut.select(*key, "codes").join(costs.select(*key, "entry", "leave", "last"), key).mapInPandas(_exits, "absent boolean, conv bigint, part int, blk int, exits array<int>, turns array<int>")
    entered = exits.groupBy("absent", "conv").applyInPandas(_chained, "absent boolean, conv bigint, part int, blk int, mask int, place bigint")
    pieces = cut.select(*key, "codes", "roles", "texts").join(costs, key).join(entered, key).mapInPandas(_written, "absent boolean, conv bigint, part int, blk int, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, letters string, piece string, turns bigint")
    joined = pieces.repartition("absent", "conv").sortWithinPartitions(*key).mapInArrow(_joined(_arrow(_RESULT)), _RESULT)
    return whole.unionByName(joined)


def _arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string of the few types used here."""
    plain = {"boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(x.split()[0], plain[x.split()[1]]) for x in ddl.split(", ")])
