"""The prefix trie of conversations: a Cartesian tree over the LCP array of the sorted conversations.

Every conversation is a key, 16 bytes of digest for each turn. The keys are sorted over all tasks; each task packs its
stretch of the sorted list (a block) with the LCP, in turns, of each key and the one before. A trie node with several
children, or where a conversation ends that others go on from, is an interval of that list between the nearest smaller
LCP values to its left and right, and all positions of one LCP value within it are the same node. Nearest smaller values
are found by a stack within a block; where a block has none, the block minima tell which block has it, and that block is
asked once for each (block, value). Depths between a node and its parent, and the tail of a key behind its longest LCP,
are nodes of one child with the same members: they are filled in last. Members, leaves and saved tokens of an interval
come from running sums over the list, so no subtree is ever walked.

The driver sees a few numbers for each block, at any size of the table. One conversation's digests (24 bytes a turn)
must fit in a task; its texts need not. The conv_ids of equal conversations are streamed through the hash.

Cases: rows with one turn come by role and then by text (its first 64 characters, then its digest); null role or text is
empty; rows of a null conv_id are no conversation and are ignored; texts of any length are digested whole; repeated rows
are turns of their own; a conversation may end up without turns; no conversations give no nodes, not even a root; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small, tasks_for, tidied

#: How many ids share an opening, how many turns of it at most.
FAMILY, OPENINGS = 100, 6
DIGEST = 16
NOTHING = hashlib.sha256(b"").hexdigest()
_LEAST = -1  # the LCP in front of the list and behind it


_OWN = "conv_id bigint, key binary, chars array<bigint>"


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, key (the digests of the rebuilt turns), chars (their code points)."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    rows = rows.select("conv_id", "turn", "role", F.substring("text", 1, 64).alias("begins"), digest.alias("digest"), F.length("text").cast("bigint").alias("chars"))
    n = max(tasks_for(conversations), int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "begins", "digest").select("conv_id", "digest", "chars")
    own = materialise(rows.mapInArrow(_gathered(_schema(_OWN)), _OWN), "trie-own")
    first = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("head"), F.substring("key", 1, (OPENINGS - 1) * DIGEST).alias("k"), F.slice("chars", 1, OPENINGS - 1).alias("c"))
    own = own.withColumns({"head": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS).cast("int")})
    both = own.join(first, "head", "left")
    key = F.concat(F.when(F.col("k").isNull(), F.lit(b"")).otherwise(F.expr(f"substring(k, 1, h * {DIGEST})")), F.expr(f"substring(key, h * {DIGEST} + 1)"))
    chars = F.concat(F.when(F.col("c").isNull(), F.array().cast("array<bigint>")).otherwise(F.expr("slice(c, 1, h)")), F.expr("slice(chars, h + 1, greatest(size(chars) - h, 0))"))
    return both.select("conv_id", key.alias("key"), chars.alias("chars"))


def _gathered(schema: pa.Schema):
    """Sorted turns to conversations."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, digests, chars = [], None, [], []
        for batch in batches:
            for conv, digest, n in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != now:
                    if now is not None:
                        out.append((now, b"".join(digests), chars))
                    now, digests, chars = conv, [], []
                digests.append(digest)
                chars.append(n)
            if len(out) >= 1000:
                yield _batch(out, schema)
                out = []
        if now is not None:
            out.append((now, b"".join(digests), chars))
            yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


#: One block: the list's keys, each once. lcp: with the key before (the first one's is -1 here); size: of turns; n: conversations; least: conv_id; chars: of all turns, with
#: 0 in front of each key's; ends: hashes of the conversations' ids. ids: of the first and last key, which may go on in other blocks.
_BLOCK = "part int, m int, front binary, back binary, lcp binary, size binary, n binary, least binary, chars binary, ends array<string>, front_ids string, back_ids string"


def _common(a: bytes, b: bytes) -> int:
    """The LCP of two keys in turns."""
    n = min(len(a), len(b)) // DIGEST * DIGEST
    if a[:n] == b[:n]:
        return n // DIGEST
    x = np.frombuffer(a, dtype=np.uint8, count=n) != np.frombuffer(b, dtype=np.uint8, count=n)
    return int(x.argmax()) // DIGEST


def _packed(schema: pa.Schema):
    """One task's stretch of the sorted list as one row."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, ids = TaskContext.get().partitionId(), None, []
        lcp, size, n, least, chars, ends, front, front_ids = [], [], [], [], [], [], None, None

        def ended() -> str:
            text = ",".join(ids)
            ends.append(hashlib.sha256(text.encode()).hexdigest())
            n.append(len(ids))
            return text

        for batch in batches:
            for conv, key, c in zip(*(x.to_pylist() for x in batch.columns)):
                if key == now:
                    ids.append(str(conv))
                    continue
                if now is not None:
                    text = ended()
                    front_ids = text if front_ids is None else front_ids
                lcp.append(-1 if now is None else _common(now, key))
                front, now, ids = key if front is None else front, key, [str(conv)]
                size.append(len(key) // DIGEST)
                least.append(conv)
                chars.append(np.array([0, *c], dtype=np.int64))
        if now is not None:
            text = ended()
            longs = lambda x: np.array(x, dtype=np.int64).tobytes()
            row = (part, len(n), front, now, longs(lcp), longs(size), longs(n), longs(least), np.concatenate(chars).tobytes(), ends, text if front_ids is None else front_ids, text)
            yield _batch([row], schema)

    return run


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _each(ddl: str, rows_of):
    """A function of Arrow batches from one of a row, which gives a list of rows of the columns of ddl."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out = rows_of(SimpleNamespace(**r))
                for k in range(0, len(out), 5000):
                    yield pa.RecordBatch.from_pylist(out[k : k + 5000], schema=_schema(ddl))

    return run


def _longs(x) -> np.ndarray:
    return np.frombuffer(x, dtype=np.int64)


class _Block:
    """A block with what its nodes need. first: the LCP of its first key with the block before; then: of the next block's first."""

    def __init__(self, r, first: int, then: int):
        self.part, self.m = int(r.part), int(r.m)
        self.lcp, self.size, self.n, self.least = _longs(r.lcp).copy(), _longs(r.size), _longs(r.n), _longs(r.least)
        self.lcp[0] = first
        self.next = np.append(self.lcp[1:], then)
        self.at = np.concatenate([[0], np.cumsum(self.size + 1)])
        total = np.cumsum(_longs(r.chars))
        self.pre = total - np.repeat(total[self.at[:-1]], self.size + 1)  # code points of the first 0, 1, ... turns of each key
        self.whole = self.pre[self.at[1:] - 1]
        self.own = self.whole - self.pre[self.at[:-1] + np.maximum(self.lcp, 0)]
        # sums in front of each key: conversations, leaves, code points of conversations, code points of turns not shared with the key before
        self.sums = np.zeros((self.m + 1, 4), dtype=np.int64)
        self.sums[1:] = np.cumsum(np.stack([self.n, self.size > self.next, self.n * self.whole, self.own], axis=1), axis=0)

    def opening(self, i: int, low: int, high: int) -> list[int]:
        """Code points of the first low, ..., high - 1 turns of key i; those of -1 turns count as 0."""
        return [0] * (low < 0) + self.pre[self.at[i] + max(low, 0) : self.at[i] + high].tolist()


def nearest_smaller(values: list[int]) -> tuple[list[int], list[int]]:
    """For each place the nearest places of a smaller value, to the left (or -1) and to the right (or the length)."""
    left, right, stack = [-1] * len(values), [len(values)] * len(values), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = i
        # equal values stay on the stack: both have the same smaller one to their left
        left[i] = (left[stack[-1]] if values[stack[-1]] == v else stack[-1]) if stack else -1
        stack.append(i)
    return left, right


class RangeMin:
    """Least values of ranges, by a table of the ranges of powers of two."""

    def __init__(self, values):
        self.t = [np.asarray(values, dtype=np.int64)]
        while 2 << len(self.t) - 1 <= len(self.t[0]):
            k = 1 << len(self.t) - 1
            self.t.append(np.minimum(self.t[-1][:-k], self.t[-1][k:]))

    def of(self, a: int, b: int) -> int:
        """Of the places from a to b - 1."""
        k = (b - a).bit_length() - 1
        return int(min(self.t[k][a], self.t[k][b - (1 << k)]))


#: A node at the end of an edge, which covers the depths above ``top`` up to ``depth``. ask, ask_left: where to find a parent that reaches beyond its block; kids: children;
#: base, pre: the tokens saved from depth x on are base - (n - 1) * pre of x, the code points of the turns before x. piece: key whose ids lie in several blocks.
_EDGE = "conv_id bigint, parent_conv bigint, ask int, ask_left boolean, top bigint, depth bigint, n bigint, leaves bigint, kids bigint, base bigint, pre array<bigint>, ends string, piece string"
#: A value of a block whose node reaches beyond it, to the left (at_left) or the right (at_right) or both; same: how many places; pieces: keys that go on from the block before and end at that depth.
_OPEN = "part int, value bigint, at_left boolean, at_right boolean, same bigint, pieces bigint"
_MADE = f"kind string, {_EDGE}, {_OPEN}, totals array<bigint>"


_PLACED = f"{_OPEN}, begins int, stops int"
_STOPPED = "begins int, value bigint, low bigint, upto array<bigint>, least bigint"


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _edge(b: _Block, left: int, top: int, depth: int, sums, least: int, kids: int, ends: str | None) -> dict:
    """sums: over the node's keys, the first one's own turns included."""
    n, leaves, texts, own = (int(x) for x in sums)
    base = texts - (own - int(b.own[left])) - int(b.whole[left])
    return {"conv_id": least, "top": top, "depth": depth, "n": n, "leaves": leaves, "kids": kids, "base": base, "pre": b.opening(left, top, depth), "ends": ends}


def _nodes_of(b: _Block, ends: list[str], behind: int | None) -> list[dict]:
    """Edges that end in the block, and its open values. behind: the next block."""
    lcp = b.lcp.tolist()
    left, right = nearest_smaller(lcp)
    least = RangeMin(b.least)
    closed, opened = {}, {}
    for i, v in enumerate(lcp):
        if v < 0:
            continue  # the front of the list
        if left[i] >= 0 and right[i] < b.m:
            closed.setdefault((left[i], v), [right[i], 0])[1] += 1
        else:
            o = opened.setdefault((v, left[i] < 0), {"kind": "open", "part": b.part, "value": v, "at_left": left[i] < 0, "at_right": right[i] == b.m, "same": 0, "pieces": 0})
            o["same"] += 1
            o["pieces"] += int(v == b.size[i])
    convs = {(a, v): least.of(a, z) for (a, v), (z, _) in closed.items()}

    def parent(i: int, e: int) -> dict:
        """Of an edge whose parent has its value e at place i."""
        if e < 0:
            return {}
        if i == b.m:
            return {"ask": behind, "ask_left": True}
        return {"parent_conv": convs[left[i], e]} if (left[i], e) in convs and right[i] < b.m else {"ask": b.part, "ask_left": left[i] < 0}

    rows = list(opened.values())
    for (a, v), (z, same) in closed.items():
        e = max(lcp[a], lcp[z])
        own = b.size[a] == v
        rows.append({"kind": "edge"} | _edge(b, a, e, v, b.sums[z] - b.sums[a], convs[a, v], same + 1 - int(own), ends[a] if own else NOTHING) | parent(a if lcp[a] == e else z, e))
    for i, (v, w, size) in enumerate(zip(lcp, b.next.tolist(), b.size.tolist())):
        e = max(v, w)
        if size > e:  # a tail: turns that neither neighbour shares
            rows.append({"kind": "edge"} | _edge(b, i, e, size, b.sums[i + 1] - b.sums[i], int(b.least[i]), 0, ends[i]) | parent(i if v == e else i + 1, e))
    return rows


def _local(firsts: dict[int, tuple[int, int, int | None]]):
    """A block's edges, open values and totals. firsts: by block, the first LCP, the next block's first LCP, the next block."""

    def rows_of(r) -> list[dict]:
        first, then, behind = firsts[r.part]
        b = _Block(r, first, then)
        return [{"kind": "total", "part": b.part, "totals": [*b.sums[-1].tolist(), int(b.lcp.min()), int(b.least.min())]}, *_nodes_of(b, r.ends, behind)]

    return _each(_MADE, rows_of)


class Blocks:
    """Few numbers of each block, in order."""

    def __init__(self, totals: list[tuple[int, list[int]]], firsts: dict):
        totals = sorted(totals)
        self.parts, self.firsts = [p for p, _ in totals], firsts
        self.at = {p: k for k, p in enumerate(self.parts)}
        t = np.array([x for _, x in totals], dtype=np.int64).reshape(-1, 6)
        self.sums = np.concatenate([np.zeros((1, 4), dtype=np.int64), np.cumsum(t[:, :4], axis=0)])
        self.lows, self.least = t[:, 4].tolist(), RangeMin(t[:, 5])
        self.left, self.right = nearest_smaller(self.lows)

    def ends(self, part: int, value: int, at_left: bool, at_right: bool) -> tuple[int, int | None]:
        """The blocks in which a value's node begins and ends; None: at the end of the list."""
        p = z = self.at[part]
        if at_left:
            p -= 1
            while self.lows[p] >= value:
                p = self.left[p]
        if at_right:
            z += 1
            while z < len(self.lows) and self.lows[z] >= value:
                z = self.right[z]
        return self.parts[p], self.parts[z] if z < len(self.parts) else None


def _placed(blocks: Blocks):
    """An open value with the blocks in which its node begins and ends."""

    def rows_of(r) -> list[dict]:
        begins, stops = blocks.ends(r.part, r.value, r.at_left, r.at_right)
        return [vars(r) | {"begins": begins, "stops": stops}]

    return _each(_PLACED, rows_of)


def _stopped(blocks: Blocks):
    """Of nodes that end in a block: the LCP there, the sums and the least conv_id of the keys before."""

    def rows_of(r) -> list[dict]:
        b, out = _Block(r, *blocks.firsts[r.part][:2]), []
        for x in r.asks:
            k = int(np.argmax(b.lcp < x["value"]))
            out.append({"begins": x["begins"], "value": x["value"], "low": int(b.lcp[k]), "upto": b.sums[k].tolist(), "least": int(b.least[:k].min()) if k else None})
        return out

    return _each(_STOPPED, rows_of)


def _begun(blocks: Blocks):
    """Edges of the nodes that begin in a block and end in another."""

    def rows_of(r) -> list[dict]:
        b, p, out = _Block(r, *blocks.firsts[r.part][:2]), blocks.at[r.part], []
        left, _ = nearest_smaller(b.lcp.tolist())
        for x in r.asks:
            v, at_end = x["value"], x["stops"] is None
            a = int(np.flatnonzero(b.lcp < v)[-1])
            z = len(blocks.parts) if at_end else blocks.at[x["stops"]]
            sums = blocks.sums[z] - blocks.sums[p] - b.sums[a] + (0 if at_end else np.array(x["upto"]))
            least = [int(b.least[a:].min())] + ([blocks.least.of(p + 1, z)] if z > p + 1 else []) + ([x["least"]] if x["least"] is not None else [])
            e, own = max(int(b.lcp[a]), _LEAST if at_end else x["low"]), int(b.size[a] == v)
            row = _edge(b, a, e, v, sums, min(least), x["same"] + 1 - own - x["pieces"], r.ends[a] if own else NOTHING)
            if x["pieces"]:
                row["piece"] = hashlib.md5(r.back).hexdigest()
            if e >= 0:
                row |= {"ask": r.part, "ask_left": left[a] < 0} if b.lcp[a] == e else {"ask": x["stops"], "ask_left": True}
            out.append(row | {"begins": r.part})
        return out

    return _each(f"begins int, {_EDGE}", rows_of)


def _hashed(schema: pa.Schema):
    """Sorted pieces of lists of ids to the hash of each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now:
                    if now is not None:
                        yield _batch([(now, sha.hexdigest())], schema)
                    now, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
        if now is not None:
            yield _batch([(now, sha.hexdigest())], schema)

    return run


def _first_lcps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pd.DataFrame({"part": pdf["part"], "first": [_LEAST if a is None else _common(a, b) for a, b in zip(pdf["before"], pdf["front"])]}).astype({"part": "int32", "first": "int64"})


def trie(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text), rebuilt; one row for each node of their trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    n = tasks_for(conversations)
    sorted_ = sequences(conversations).repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    blocks = materialise(sorted_.mapInArrow(_packed(_schema(_BLOCK)), _BLOCK), "trie-blocks")
    before = F.lag("back").over(Window.orderBy("part"))  # one row for each block
    firsts = sorted(map(tuple, blocks.select("part", "front", before.alias("before")).mapInPandas(_first_lcps, "part int, first bigint").collect()))
    firsts = {p: (f, g, q) for (p, f), (q, g) in zip(firsts, [*firsts[1:], (None, _LEAST)])}
    made = materialise(blocks.mapInArrow(_local(firsts), _MADE), "trie-made")
    few = Blocks([(r["part"], r["totals"]) for r in made.where("kind = 'total'").select("part", "totals").collect()], firsts)

    opened = materialise(made.where("kind = 'open'").select(*_names(_OPEN)).mapInArrow(_placed(few), _PLACED), "trie-open")
    nodes = opened.groupBy("begins", "stops", "value").agg(F.sum("same").alias("same"), F.sum("pieces").alias("pieces"))
    asks = nodes.where("stops is not null").groupBy(F.col("stops").alias("part")).agg(F.collect_list(F.struct("begins", "value")).alias("asks"))
    stops = blocks.join(asks, "part").mapInArrow(_stopped(few), _STOPPED)
    asks = nodes.join(stops, ["begins", "value"], "left").groupBy(F.col("begins").alias("part")).agg(F.collect_list(F.struct("value", "stops", "same", "pieces", "low", "upto", "least")).alias("asks"))
    wide = materialise(blocks.join(asks, "part").mapInArrow(_begun(few), f"begins int, {_EDGE}"), "trie-wide")

    name = F.md5("front"), F.md5("back")
    pieces = blocks.select("part", F.lit(0).alias("pos"), name[0].alias("piece"), F.col("front_ids").alias("ids")).union(blocks.where("m > 1").select("part", F.lit(1), name[1], "back_ids"))
    hashed = pieces.repartition("piece").sortWithinPartitions("piece", "part", "pos").select("piece", "ids").mapInArrow(_hashed(_schema("piece string, list string")), "piece string, list string")
    wide = wide.join(hashed, "piece", "left").withColumn("ends", F.coalesce("list", "ends"))

    edges = made.where("kind = 'edge'").select(*_names(_EDGE)).unionByName(wide.select(*_names(_EDGE)))
    where = opened.join(wide.select("begins", F.col("depth").alias("value"), F.col("conv_id").alias("of")), ["begins", "value"]).select(F.col("part").alias("ask"), F.col("at_left").alias("ask_left"), F.col("value").alias("top"), "of")
    asking = edges.where("ask is not null").join(small(where), ["ask", "ask_left", "top"]).withColumn("parent_conv", F.col("of")).select(*_names(_EDGE))
    edges = edges.where("ask is null").unionByName(asking)
    out = edges.select("*", F.posexplode("pre").alias("k", "upto")).withColumn("at", F.col("top") + 1 + F.col("k"))
    bottom = F.col("at") == F.col("depth")
    return out.select(
        "conv_id", F.col("at").alias("depth"), F.when(F.col("at") == 0, None).when(F.col("k") == 0, F.col("parent_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(bottom, F.col("kids")).otherwise(1).cast("bigint").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("base") - (F.col("n") - 1) * F.col("upto")).alias("saved_tokens"), F.when(bottom, F.col("ends")).otherwise(NOTHING).alias("ends_sha256"),
    )
