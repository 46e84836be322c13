"""The deletion index against all pairs, questions and answers, truth documents: hard cases."""

import random

from pyspark.sql import functions as F

from tallyframe.operators import asking, corrections
from tallyframe.sources import truth


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_nearest_terms_equal_all_pairs(spark):
    r = random.Random(5)
    make = lambda n: "".join(r.choice("abcé") for _ in range(n))
    terms = sorted({make(r.randint(1, 14)) for _ in range(150)} | {"a" * 300, "ab"})
    words = sorted({make(r.randint(1, 14)) for _ in range(150)} | {t[1:] + "z" for t in terms[:60]} | {"zz" + t for t in terms[60:100]} | {"a" * 299 + "b", "", "ab"})
    got = corrections.nearest_terms(spark.createDataFrame([(w,) for w in words * 2], "word string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()
    want = {}
    for w in words:
        if len(w) >= 3 and w not in terms:
            near = [(edits(w, t), t) for t in terms if edits(w, t) <= (2 if len(w) >= 5 else 1)]
            if near:
                want[w] = min(near)[1]
    assert {x["word"]: x["term"] for x in got} == want and len(got) == len(want) > 40


STATE = "doc_id bigint, vendors array<string>, addresses array<string>, net decimal(18,2), total decimal(18,2), n_items int, met decimal(18,2), semantics boolean"


def test_questions_and_honoured_answers(spark):
    docs = spark.createDataFrame([(1, ["A", "B"], ["x"], None, None, None, None, None), (2, ["A", "B"], ["x"], None, None, 0, None, False), (3, None, None, None, None, None, None, None), (4, ["A"], ["x", "y"], None, None, 3, None, True)], STATE)
    docs = docs.unionByName(docs.where("doc_id = 3").select(F.lit(5).cast("bigint").alias("doc_id"), "vendors", "addresses", F.lit(12).cast("decimal(18,2)").alias("net"), F.lit(10).cast("decimal(18,2)").alias("total"), "n_items", "met", "semantics"))
    asked = asking.questions(docs)
    rows = {r["doc_id"]: r for r in asked.collect()}
    assert set(rows) == {1, 2, 4, 5} and rows[1]["key"] == rows[2]["key"] != rows[4]["key"]  # equal questions are asked once
    assert rows[1]["addresses"] == [] and rows[4]["vendors"] == [] and rows[5]["subtotal"] and not rows[1]["subtotal"]
    answers = spark.createDataFrame([(rows[1]["key"], " B ", "x", "7"), (rows[4]["key"], "A", "z", None), (rows[5]["key"], None, None, "9.5"), (rows[5]["key"], None, None, "9.7")], "key string, vendor string, address string, subtotal string")
    got = {r["doc_id"]: tuple(r)[1:] for r in asking.honoured(asked, answers).collect()}
    assert got == {1: ("B", None, None), 2: ("B", None, None), 5: (None, None, 9.5)}
    assert asking.honoured(asked, answers.where("false")).count() == 0 and asking.questions(docs.where("false")).count() == 0


def test_batches_are_taken_whole_or_not_at_all(spark):
    rows = [(1, i, n) for i, n in enumerate(["pen", "ink", "DRD PEV-CUT EP025G", "cup", None, ""])] + [(2, i, n) for i, n in enumerate(["pen", "ink"])] + [(3, i, n) for i, n in enumerate(["a b", "c d", "e f"] + ["DRD PEV-CUT EP025G"] * 4)] + [(4, i, "pot") for i in range(3)]
    items = spark.createDataFrame(rows, "doc_id bigint, ord int, name string")
    batches = asking.name_batches(items)
    keys = {r["doc_id"]: r["key"] for r in batches.collect()}
    assert set(keys) == {1, 4}
    answers = spark.createDataFrame([(keys[1], ["Pen!", "INK", " "]), (keys[4], ["x", "y"])], "key string, names array<string>")
    got = {(r["doc_id"], r["ord"]): r["name"] for r in asking.renamed(items, batches, answers).collect()}
    assert len(got) == len(rows) and got[1, 0] == "Pen!" and got[1, 1] == "ink" and got[1, 3] == " " and got[1, 4] is None and got[4, 0] == "pot"


def test_truth_documents(spark):
    texts = ['{"image": "a", "expected": {"x": null, "y": "1", "a b": 2}, "unknown": ["y"], "mine": {"deep": [1, null]}, "odd.key": null}', "{}", "no json", None, '{"expected": null, "expected_items": []}']
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, document string")
    rows = truth.parsed(docs)
    got = {r["id"]: r for r in rows.drop("v").collect()}
    assert got[0]["extra"] == {"mine": '{"deep":[1,null]}', "odd.key": "null"} and got[0]["source"] == "real_sample" and got[1]["extra"] is None and got[3]["image"] is None
    assert [got[i]["n_expected_items"] for i in range(5)] == [None, None, None, None, 0]
    states = {(r["id"], r["field"]): (r["state"], r["value"]) for r in truth.field_states(rows, ("x", "y", "z", "a b")).collect()}
    assert states[0, "x"] == ("null", None) and states[0, "y"] == ("unknown", "1") and states[0, "z"] == ("missing", None) and states[0, "a b"] == ("value", "2")
    assert all(states[i, "x"] == ("missing", None) for i in range(1, 5))
