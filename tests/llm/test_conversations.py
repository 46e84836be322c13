"""Conversation repair and the prefix trie against plain versions, on the given tables and on hard cases."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tallyframe.llm import turn_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, note string"


def conversations(seed: int, n_convs: int, longest: int = 9) -> list[tuple]:
    """Rows with every case: nulls, ties, repeated and blank rows, truncated texts, long texts, odd roles, copies."""
    r, rows = random.Random(seed), []
    for c in range(n_convs):
        turns = r.randrange(0, longest)
        for t in range(turns):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            text = r.choice(["Hello there.", "No end", "", "  ", None, "a.b!c?", "été… ok.", "x" * 3000 + ".", f"{r.random()}."])
            turn = None if r.random() < 0.1 else t + (r.random() < 0.1) * 3 - (r.random() < 0.1)
            rows += [(c * 3 - 5, turn, role, text, "n")] * (1 + (r.random() < 0.08))
    return rows


def repaired_plainly(rows: list[tuple]) -> dict:
    """Each conversation's result by trying every edit of every row."""
    space = lambda x: " " if x is None else str(x)
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        convs[conv]
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, got in convs.items():
        got.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        faults, seen = [], set()
        for _, role, text in got:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))

        @functools.cache
        def best(i: int, state: str, inserted: int) -> tuple[int, str, tuple]:
            ways = [(0, "", ())] if i == len(got) and state in ("", "a") else []

            def go(letter, cost, i2, state2, turn, inserted2=0):
                c, s, turns = best(i2, state2, inserted2)
                ways.append((cost + c, letter + s, (turn, *turns) if turn is not None else turns))

            steps = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[state]
            if inserted < 2:
                for x in steps:
                    if x != "s":
                        go("I", 3, i, x, {"u": "user:", "a": "assistant:"}[x], inserted + 1)
            if i < len(got):
                _, role, text = got[i]
                go("D", 4, i + 1, state, None)
                if faults[i] in ("", "truncated"):
                    more = 3 if faults[i] else 0
                    for x in steps:
                        if role[:1] == x:
                            go("K", more, i + 1, x, f"{role}:{text}")
                        if x != "s":
                            go("R", 3 + more, i + 1, x, {"u": "user", "a": "assistant"}[x] + f":{text}")
            return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

        cost, audit, turns = best(0, "", 0)
        marks, dated = [x[1][:1] for x in got], [x[0] for x in got if x[0] is not None]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        gaps = max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())
    return out


def repaired_by_spark(spark, rows) -> dict:
    got = turn_repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("block", [1024, 3])
def test_repair_equals_every_edit_tried(spark, monkeypatch, block):
    rows = conversations(4, 150) + [(None, 1, "user", "Lost.", "n"), (None, 2, "assistant", "Found.", "n")]
    monkeypatch.setattr(turn_repair, "BLOCK_ROWS", block)
    assert repaired_by_spark(spark, rows) == repaired_plainly(rows)


def trie_plainly(rows: list[tuple]) -> set:
    """Every node, by a dictionary of prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + v[h:])
    nodes = defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] += children[p] == 0
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(c for c in nodes[p] if len(rebuilt[c]) == len(p))).encode()).hexdigest()
    out = [(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in nodes.items()]
    assert len(set(out)) == len(out)
    return set(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_by_spark(spark, df) -> set:
    from tallyframe.llm import prefix_trie

    got = prefix_trie.trie(df)
    assert got.columns == COLUMNS
    rows = [tuple(r) for r in got.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def copies(seed: int, n_convs: int) -> list[tuple]:
    """Conversations of few distinct turns: many copies, prefixes of each other, empty ones after rebuilding."""
    r, rows = random.Random(seed), []
    for c in range(n_convs):
        for t in range(r.choice([0, 1, 1, 2, 3, 3, 5, 12])):
            rows.append((c + (c // 150) * 1000 - 30, t if r.random() < 0.95 else None, r.choice(["user", None]), r.choice(["a", "bé", None, "a"]), "n"))
    return rows


@pytest.mark.parametrize("tasks", [1, 5, 40])
def test_trie_equals_a_dictionary_of_prefixes(spark, monkeypatch, tasks):
    from tallyframe.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "tasks_for", lambda df, *_: tasks)
    rows = copies(tasks, 400) + [(None, 0, "user", "nobody", "n")]
    assert trie_by_spark(spark, spark.createDataFrame(rows, SCHEMA)) == trie_plainly(rows)


def test_trie_of_longer_conversations(spark):
    rows = conversations(8, 120)
    assert trie_by_spark(spark, spark.createDataFrame(rows, SCHEMA)) == trie_plainly(rows)


def test_nothing_gives_nothing(spark):
    from tallyframe.llm import prefix_trie

    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(none).count() == 0 and turn_repair.repair(none).count() == 0
    one = spark.createDataFrame([(7, None, None, None, "n")], SCHEMA)
    assert trie_by_spark(spark, one) == trie_plainly([(7, None, None, None)])


def test_the_sql_of_both(tmp_path):
    import duckdb

    from tallyframe.llm.queries import oracle_sql

    rows = conversations(11, 90) + copies(3, 60)
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR, note VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?, ?)", rows)
    sql = oracle_sql()
    assert set(c.execute(sql["op11_conversation_trie"]).fetchall()) == trie_plainly(rows)
    assert {r[0]: tuple(r[1:]) for r in c.execute(sql["op13_turn_repair"]).fetchall()} == repaired_plainly(rows)
