"""Self-join of documents on the Jaccard similarity of their 5-word shingles, by prefix filters under several orders.

Under any total order of the shingles two sets with enough in common share one of their first
``size - ceil(threshold * size) + 1`` shingles. Three global orders are used: by how many documents hold a shingle,
rarest first, which makes the candidates, and by two hashes, which candidates have to pass as well:

1. Every document's shingles are counted over all documents, as packed arrays by hash bucket. A document whose prefix
   is all shingles that nobody else has links with nothing.
2. The others' sets are built, equal sets are put together, and the sets that differ are counted again.
3. Sets that share a prefix shingle make a star around the least of them, never all pairs. A star's pairs that share
   prefix shingles under the other two orders as well are verified on the whole sets; the links make components.
4. Connected stars bound the groups that can link. A group that its verified links connect is done. In any other, pairs
   of different components must share prefix shingles under all three orders before they are verified; large groups are
   dealt out in pairs of blocks of sets that are near enough in size.

Cases: null text and text without words has an empty set and links with nothing; fewer than five words are one
shingle; texts of any length are read whole; equal texts link; rows of one doc_id get its least class; a null doc_id
keeps its count and links with nothing; columns other than doc_id and text are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, in_small_batches, join_by_key, materialise, small, tasks_for, tidied, tidied_group
from .components import components

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_M = np.uint64(0x9E3779B97F4A7C15)
_PACKED = "kind int, bucket int, docs binary, counts binary, tokens binary"
_PACKED_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *((x, pa.binary()) for x in ("docs", "counts", "tokens"))])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes, with a bounded cache of word hashes."""

    def __init__(self, size: int = 5, most: int = 100_000):
        self.size, self.most, self.known = size, most, {}

    def set_of(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []  # bytes: A-Z only
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words).difference(known))
            h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(1, len(words) - self.size + 1)
        s = np.full(n, min(len(words), self.size), dtype=np.uint64)
        for k in range(min(len(words), self.size)):
            s = mixed(s * _M + h[k : k + n])
        return np.unique(s)


def prefix_size(n, percent: int):
    """How many of its first shingles a set of n must be indexed by."""
    return n - (n * percent + 99) // 100 + 1


def _runs(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sequence of ids as runs: the ids and how long each runs."""
    at = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    return docs[at], np.diff(np.append(at, len(docs))).astype(np.uint32)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKED_SCHEMA)], schema=_PACKED_SCHEMA)


def _arrays(pdf: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed rows of one kind as whole arrays: docs (one for each token, where there are tokens), counts, tokens."""
    rows = pdf[pdf["kind"] == kind]
    read = lambda c, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(x, dtype=t) for x in rows[c])])
    docs, counts, tokens = read("docs", np.int64), read("counts", np.uint32).astype(np.int64), read("tokens", np.uint32)
    return (np.repeat(docs, counts) if len(tokens) else docs), counts, tokens


def _split(kind: int, where: np.ndarray, docs: np.ndarray, values: np.ndarray, tokens: np.ndarray | None = None) -> list[tuple]:
    """Packed rows by bucket; values: a number for each doc, or with tokens None for runs of docs."""
    order = np.lexsort((docs, where))
    where, docs = where[order], docs[order]
    out = []
    for b in np.unique(where):
        i, j = np.searchsorted(where, [b, b + 1])
        if tokens is None:
            out.append((kind, int(b), docs[i:j].astype(np.int64).tobytes(), values[order[i:j]].astype(np.uint32).tobytes(), b""))
        else:
            ids, runs = _runs(docs[i:j])
            out.append((kind, int(b), ids.astype(np.int64).tobytes(), runs.astype(np.uint32).tobytes(), tokens[order[i:j]].astype(np.uint32).tobytes()))
    return out


_COLUMNS = ["kind", "bucket", "docs", "counts", "tokens"]
#: Kinds of packed rows: sizes of sets; shingles to count; shingles met several times in a task, with how often; results.
_SIZES, _TOKENS, _MANY, _OWN, _SHARED, _HOT, _PREFIX = range(7)


def _batches_of_sets(batches, from_text: bool, size: int):
    shingler = Shingler(size)
    for batch in batches:
        for a in range(0, batch.num_rows, 600):
            some = batch.slice(a, 600)
            ids, values = np.array(some.column(0).to_pylist(), dtype=np.int64), some.column(1).to_pylist()
            yield ids, [shingler.set_of(x) if from_text else np.frombuffer(x, dtype=np.uint64) for x in values]


def _alike(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted tokens: where each distinct one begins, and how many of it there are."""
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(tokens)))


def sizes_and_own(docs: DataFrame, buckets: int, size: int) -> DataFrame:
    """Per document of docs(doc_id, text): doc_id, n (its shingles), own (those that no other document has).

    Shingles go to their bucket as 32-bit remainders; one that a task meets twice goes once for all of its documents.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, each in _batches_of_sets(batches, True, size):
            n = np.array([len(x) for x in each])
            tokens, owner = np.concatenate(each), np.repeat(ids, n)
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            first, times = _alike(tokens)
            tokens, owner = tokens[first], owner[first]
            where, one = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), times == 1
            out = _split(_SIZES, ids % buckets, ids, n)
            out += _split(_TOKENS, where[one], owner[one], None, tokens[one])
            out += _split(_MANY, where[~one], np.zeros((~one).sum(), np.int64), None, tokens[~one])
            yield _record(out)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        owner, _, tokens = _arrays(pdf, _TOKENS)
        _, _, many = _arrays(pdf, _MANY)
        order = np.argsort(tokens)
        first, times = _alike(tokens[order])
        alone = order[first[times == 1]]
        alone = alone[~np.isin(tokens[alone], many)]
        ids, n = np.unique(owner[alone], return_counts=True)
        out = pd.DataFrame(_split(_OWN, ids % buckets, ids, n), columns=_COLUMNS)
        return pd.concat([pdf[pdf["kind"] == _SIZES], out])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, n, _ = _arrays(pdf, _SIZES)
        owner, own, _ = _arrays(pdf, _OWN)
        uniq, at = np.unique(ids, return_inverse=True)
        total = np.bincount(np.searchsorted(uniq, owner), weights=own, minlength=len(uniq)).astype(np.int64)
        return pd.DataFrame({"doc_id": ids, "n": n, "own": total[at]})

    counted = docs.select("doc_id", "text").mapInArrow(tidied(send), _PACKED).groupBy("bucket").applyInPandas(tidied_group(count), _PACKED)
    return counted.groupBy("bucket").applyInPandas(add, "doc_id bigint, n bigint, own bigint")


def prefix_lists(sets: DataFrame, buckets: int, percent: int, most: int = 32) -> DataFrame:
    """Prefix shingles that several of sets(doc_id, tokens) hold, packed: _TOKENS by the shingle's bucket, _PREFIX by document.

    The order is by how many sets hold a shingle (``most`` or more count alike), then by a hash. A shingle that a task
    meets ``most`` times goes once, with its count, and its documents learn nothing new from the others.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, each in _batches_of_sets(batches, False, 0):
            n = np.array([len(x) for x in each])
            tokens, owner = np.concatenate(each), np.repeat(ids, n)
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            first, times = _alike(tokens)
            hot = np.repeat(times >= most, times)
            where = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            lead = first[times >= most]
            out = _split(_SIZES, ids % buckets, ids, n)
            out += _split(_TOKENS, where[~hot], owner[~hot], None, tokens[~hot])
            out += _split(_MANY, where[lead], np.zeros(len(lead), np.int64), None, tokens[lead])
            # the hot ones go to their documents' buckets at once: two numbers of 32 bits, bucket and remainder
            out += _pairs(_HOT, owner[hot] % buckets, owner[hot], where[hot], tokens[hot], most)
            yield _record(out)

    def _pairs(kind, to, owner, where, tokens, times):
        """For each token: its bucket, remainder and count, as three numbers one after another."""
        if not len(owner):
            return []
        three = np.stack([where.astype(np.uint32), tokens.astype(np.uint32), np.broadcast_to(np.asarray(times, dtype=np.uint32), where.shape)], axis=1)
        order = np.lexsort((owner, to))
        to, out = to[order], []
        for b in np.unique(to):
            i, j = np.searchsorted(to, [b, b + 1])
            out.append((kind, int(b), owner[order[i:j]].astype(np.int64).tobytes(), b"", three[order[i:j]].tobytes()))
        return out

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        passed, out = pdf[(pdf["kind"] == _SIZES) | (pdf["kind"] == _HOT)], []
        owner, _, tokens = _arrays(pdf, _TOKENS)
        _, _, many = _arrays(pdf, _MANY)
        if len(tokens):
            here = int(pdf["bucket"].iloc[0])
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            first, times = _alike(tokens)
            times = np.repeat(np.where(np.isin(tokens[first], many), most, np.minimum(times, most)), times)
            ids, n = np.unique(owner[times == 1], return_counts=True)
            out += _split(_OWN, ids % buckets, ids, n)
            some = times > 1
            out += _pairs(_SHARED, owner[some] % buckets, owner[some], np.full(some.sum(), here), tokens[some], times[some])
        return pd.concat([passed, pd.DataFrame(out, columns=_COLUMNS)])

    def prefixes(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, n, _ = _arrays(pdf, _SIZES)
        owner, own, _ = _arrays(pdf, _OWN)
        order = np.argsort(ids)
        ids, n = ids[order], n[order]
        room = prefix_size(n, percent) - np.bincount(np.searchsorted(ids, owner), weights=own, minlength=len(ids)).astype(np.int64)
        rows = pdf[(pdf["kind"] == _SHARED) | (pdf["kind"] == _HOT)]
        if not len(rows):
            return pd.DataFrame(columns=_COLUMNS)
        who = np.searchsorted(ids, np.concatenate([np.frombuffer(x, dtype=np.int64) for x in rows["docs"]]))
        three = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in rows["tokens"]]).reshape(-1, 3)
        token = three[:, 0].astype(np.uint64) << np.uint64(32) | three[:, 1]
        order = np.lexsort((mixed(token), three[:, 2], who))
        who, three, token = who[order], three[order], token[order]
        first, times = _alike(who)
        inside = np.arange(len(who)) - np.repeat(first, times) < room[who]
        out = _split(_TOKENS, three[inside, 0].astype(np.int64), ids[who[inside]], None, three[inside, 1])
        docs, runs = _runs(ids[who[inside]])
        out.append((_PREFIX, int(pdf["bucket"].iloc[0]), docs.astype(np.int64).tobytes(), runs.astype(np.uint32).tobytes(), token[inside].tobytes()))
        return pd.DataFrame(out, columns=_COLUMNS)

    counted = sets.select("doc_id", "tokens").mapInArrow(tidied(send), _PACKED).groupBy("bucket").applyInPandas(tidied_group(count), _PACKED)
    return counted.groupBy("bucket").applyInPandas(tidied_group(prefixes), _PACKED)


def star_pairs(lists: DataFrame) -> DataFrame:
    """a, b for each b that shares a prefix shingle with a, the least document that has it."""

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        owner, _, tokens = _arrays(pdf, _TOKENS)
        order = np.lexsort((owner, tokens))
        tokens, owner = tokens[order], owner[order]
        first, times = _alike(tokens)
        pairs = np.unique(np.stack([np.repeat(owner[first], times), owner], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return lists.where(f"kind = {_TOKENS}").groupBy("bucket").applyInPandas(stars, "a bigint, b bigint").distinct()


def prefixes_of(lists: DataFrame) -> DataFrame:
    """p_doc, prefix: each document's packed prefix shingles under the order by frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, runs, tokens in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids, ends = np.frombuffer(docs, dtype=np.int64), 8 * np.cumsum(np.frombuffer(runs, dtype=np.uint32).astype(np.int64))
                parts = [tokens[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(parts, pa.binary())], names=["p_doc", "prefix"])

    return lists.where(f"kind = {_PREFIX}").select("docs", "counts", "tokens").mapInArrow(run, "p_doc bigint, prefix binary")


def in_prefix(tokens: np.ndarray, owner: np.ndarray, n: np.ndarray, percent: int, order: int) -> np.ndarray:
    """Which tokens are in their set's prefix under a hash order. owner: the set of each token, ascending; n: sizes of the sets."""
    rank = np.lexsort((mixed(tokens ^ np.uint64(order * 0x9E3779B97F4A7C15 % (1 << 64))), owner))
    ends = np.cumsum(n)
    out = np.zeros(len(tokens), dtype=bool)
    out[rank] = np.arange(len(tokens)) - np.repeat(ends - n, n) < np.repeat(prefix_size(n, percent), n)
    return out


def matches(hub: np.ndarray, others: list[np.ndarray], percent: int, orders: int = 2) -> tuple[np.ndarray, list[int]]:
    """Which others link with hub, and how many passed each filter: size, prefixes under each hash order."""
    n, size = np.array([len(x) for x in others], dtype=np.int64), len(hub)
    at = np.flatnonzero(100 * np.minimum(n, size) >= percent * np.maximum(n, size))
    passed = [len(at)]
    for order in range(1, orders + 1):
        if not len(at):
            break
        flat, owner = np.concatenate([others[i] for i in at]), np.repeat(np.arange(len(at)), n[at])
        first = np.sort(hub[in_prefix(hub, np.zeros(size, np.int64), np.array([size]), percent, order)])
        hit = in_prefix(flat, owner, n[at], percent, order) & (first[np.minimum(np.searchsorted(first, flat), len(first) - 1)] == flat)
        at = at[np.bincount(owner[hit], minlength=len(at)) > 0]
        passed.append(len(at))
    out = np.zeros(len(others), dtype=bool)
    if len(at):
        flat = np.concatenate([others[i] for i in at])
        hit = hub[np.minimum(np.searchsorted(hub, flat), size - 1)] == flat
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(n[at]) - n[at])
        out[at] = 100 * common >= percent * (n[at] + size - common)
    return out, passed


def verified(pairs: DataFrame, sets: DataFrame, percent: int, mb_each: float = 4.0, salts: int = 256) -> DataFrame:
    """The pairs (a, b) of sets(doc_id, tokens) that link. A hub a is dealt in ``salts`` parts by its partners, so that none is a hot group."""
    pairs = materialise(pairs.distinct(), "pairs")
    mean = sets.agg(F.avg(F.length("tokens"))).first()[0] or 0
    buckets = max(8, int(pairs.count() * mean / (mb_each * 1e6)) + 1)
    to = F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(salts))), F.lit(buckets)).cast("int")
    dealt = pairs.select("a", "b", to.alias("bucket"))
    members = dealt.join(sets, F.col("b") == F.col("doc_id")).select("bucket", "a", "b", "tokens")
    hubs = dealt.select("bucket", "a").distinct().join(sets, F.col("a") == F.col("doc_id")).select("bucket", "a", F.lit(None).cast("bigint").alias("b"), "tokens")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        hub = {a: np.frombuffer(x, dtype=np.uint64) for a, x in zip(pdf.loc[pdf["b"].isna(), "a"], pdf.loc[pdf["b"].isna(), "tokens"])}
        for a, some in pdf[pdf["b"].notna()].groupby("a"):
            b, each = some["b"].to_numpy().astype(np.int64), [np.frombuffer(x, dtype=np.uint64) for x in some["tokens"]]
            step = max(1, 400_000 // max(map(len, each)))
            for k in range(0, len(b), step):
                yes, _ = matches(hub[a], each[k : k + step], percent)
                out += [(a, x) for x in b[k : k + step][yes]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return members.union(hubs).groupBy("bucket").applyInPandas(tidied_group(check), "a bigint, b bigint")


def sharing(prefixes: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets share a prefix shingle."""
    flat, owner = np.concatenate(prefixes), np.repeat(np.arange(len(prefixes)), [len(x) for x in prefixes])
    names, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    some = times[at] > 1
    names, at = np.unique(at[some], return_inverse=True)
    owner, share = owner[some], np.zeros((len(prefixes), len(prefixes)), dtype=bool)
    for a in range(0, len(names), 4096):
        here = (at >= a) & (at < a + 4096)
        x = np.zeros((len(prefixes), min(4096, len(names) - a)), dtype=np.float32)
        x[owner[here], at[here] - a] = 1
        share |= x @ x.T > 0
    return share


def linked(ids: np.ndarray, known: np.ndarray, sets: list[np.ndarray], prefixes: list[np.ndarray], percent: int, side: np.ndarray | None = None, orders: int = 2) -> tuple[list[tuple[int, int]], list[int]]:
    """Links (a, b) that join sets of different components, and how many pairs passed each order. known: the components so far.

    prefixes: those under the order by frequency; side: 0 or 1 for each set when only pairs of different sides are to be compared.
    """
    n, owner = np.array([len(x) for x in sets], dtype=np.int64), None
    able = (known[:, None] != known[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
    if side is not None:
        able &= side[:, None] != side[None, :]
    able = np.triu(able, 1)
    passed = [int(able.sum())]
    if able.any():
        able &= sharing(prefixes)
        passed.append(int(able.sum()))
    if able.any():
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        for order in range(1, orders + 1):
            inside = in_prefix(flat, owner, n, percent, order)
            able &= sharing(np.split(flat[inside], np.cumsum(np.bincount(owner[inside], minlength=len(sets)))[:-1]))
            passed.append(int(able.sum()))
    root, out = known.copy(), []
    for i in np.flatnonzero(able.any(1)):
        others = [j for j in np.flatnonzero(able[i]) if root[j] != root[i]]
        if not others:
            continue
        flat = np.concatenate([sets[j] for j in others])
        hit = sets[i][np.minimum(np.searchsorted(sets[i], flat), n[i] - 1)] == flat
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(n[others]) - n[others])
        for j, k in zip(others, common.tolist()):
            if 100 * k >= percent * (n[i] + n[j] - k):
                out.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    return out, passed


def open_links(sets: DataFrame, groups: DataFrame, lists: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """Links a, b between different components of each group. groups(node, g, c): the group and the component so far of each set."""
    size_class = F.when(F.col("members") > block, F.floor(F.log(F.col("n")) / np.log(100 / percent) + 1e-9)).otherwise(0).cast("int")
    counts = groups.groupBy("g").agg(F.count("*").alias("members"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("g", "members")
    rows = join_by_key(groups, materialise(counts, "groups"), ["g"], "members")
    sizes = sets.select(F.col("doc_id").alias("node"), (F.length("tokens") / 8).cast("bigint").alias("n"))
    rows = materialise(rows.join(sizes, "node").withColumn("k", size_class), "grouped")
    blocks = rows.groupBy("g", "k").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("weight"))
    near = lambda step, name: blocks.select("g", (F.col("k") + step).alias("k"), F.col("blocks").alias(name))
    blocks = blocks.join(near(1, "before"), ["g", "k"], "left").join(near(-1, "after"), ["g", "k"], "left").na.fill(0, ["before", "after"])
    rows = join_by_key(rows, materialise(blocks, "blocks"), ["g", "k"], "weight")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda j: j < n)
    one = F.col("k").alias("k1"), F.col("k").alias("k2")
    same = F.transform(upto(F.col("blocks")), lambda j: F.struct(*one, F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j"), (F.greatest(mine, j) == mine).cast("int").alias("side")))
    up = F.transform(upto(F.col("after")), lambda j: F.struct(one[0], (F.col("k") + 1).alias("k2"), mine.alias("i"), j.alias("j"), F.lit(0).alias("side")))
    down = F.transform(upto(F.col("before")), lambda j: F.struct((F.col("k") - 1).alias("k1"), one[1], j.alias("i"), mine.alias("j"), F.lit(1).alias("side")))
    dealt = rows.select("node", "g", "c", F.explode(F.concat(same, up, down)).alias("p")).select("node", "g", "c", "p.*")
    dealt = dealt.join(sets, F.col("node") == F.col("doc_id")).join(prefixes_of(lists), F.col("node") == F.col("p_doc")).select("node", "g", "c", "k1", "k2", "i", "j", "side", "tokens", "prefix")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["c"].nunique() < 2:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        pdf = pdf.sort_values("node")
        whole = pdf["k1"].iloc[0] == pdf["k2"].iloc[0] and pdf["i"].iloc[0] == pdf["j"].iloc[0]
        read = lambda c: [np.frombuffer(x, dtype=np.uint64) for x in pdf[c]]
        found, _ = linked(pdf["node"].to_numpy(), pdf["c"].to_numpy(), read("tokens"), read("prefix"), percent, None if whole else pdf["side"].to_numpy())
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("g", "k1", "k2", "i", "j").applyInPandas(verify, "a bigint, b bigint")


def connecting_links(sets: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """node, component of the sets(doc_id, tokens) that link with another."""
    lists = materialise(prefix_lists(sets, tasks_for(sets, 3, 16), percent), "prefixes")
    stars = materialise(star_pairs(lists), "stars")
    links = materialise(verified(stars, sets, percent), "verified")
    known = components(links).select(F.col("node").alias("v"), "component")
    groups = components(stars).select("node", F.col("component").alias("g"))
    groups = materialise(groups.join(small(known), F.col("node") == F.col("v"), "left").select("node", "g", F.coalesce("component", "node").alias("c")), "candidates")
    more = open_links(sets, groups, lists, percent, block)
    # the components so far stand for their links
    out = components(materialise(more.union(known.select(F.col("component").alias("a"), F.col("v").alias("b"))), "links"))
    discard(lists)
    return out


def jaccard_classes(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    in_small_batches(docs.sparkSession)
    buckets = tasks_for(rows, 3, 16)
    stats = materialise(sizes_and_own(rows.where("doc_id is not null"), buckets, size), "sizes")
    near = stats.where((F.col("n") > 0) & (F.col("own") < F.expr(f"n - ceil(n * {percent} / 100.0d) + 1"))).select(F.col("doc_id").alias("d")).distinct()
    near = small(materialise(near, "near"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            sets = [shingler.set_of(x).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "digest", "tokens"])

    sets = materialise(rows.join(near, F.col("doc_id") == F.col("d"), "left_semi").mapInArrow(tidied(build), "doc_id bigint, digest binary, tokens binary"), "sets")
    least = materialise(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "least")
    member = materialise(join_by_key(sets.select("doc_id", "digest"), least, ["digest"], "copies").select("doc_id", "rep").distinct(), "members")
    firsts = materialise(sets.join(small(member.where("doc_id = rep").select("rep")), F.col("doc_id") == F.col("rep"), "left_semi").select("doc_id", "tokens").dropDuplicates(["doc_id"]), "firsts")
    discard(sets)
    links = connecting_links(firsts, percent)
    discard(firsts)
    classes = member.join(links, F.col("rep") == F.col("node"), "left").groupBy(F.col("doc_id").alias("d")).agg(F.min(F.coalesce("component", "rep")).alias("c"))
    out = stats.join(classes, F.col("doc_id") == F.col("d"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))

    def only_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(shingler.set_of(x)) for x in batch.column(1).to_pylist()], pa.int64()), batch.column(0)], names=["doc_id", "n_shingles", "component_id"])

    return out.union(rows.where("doc_id is null").mapInArrow(only_sizes, "doc_id bigint, n_shingles bigint, component_id bigint"))


def one_of_each(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """The documents, all columns, without those linked to a document of a lower id; of rows with one doc_id and text one stays."""
    classes = jaccard_classes(docs.select("doc_id", "text"), percent, size)
    away = fresh("gone")
    gone = materialise(classes.where("doc_id <> component_id").select(F.col("doc_id").alias(away)).distinct(), "gone")
    kept = docs.join(small(gone), F.col("doc_id") == F.col(away), "left_anti")
    again = materialise(docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").select(F.col("doc_id").alias(away)), "again")
    if again.isEmpty():
        return kept
    same = F.col("doc_id") == F.col(away)
    return kept.join(small(again), same, "left_anti").union(kept.join(small(again), same, "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns))
