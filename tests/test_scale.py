"""What keeps the queries' cost in step with their input: exchanges, passes and tasks of their plans, dates without parsing."""

import re

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.dates import appears, day_of, first_numeric_date
from tallyframe.operators import choices, evaluation, layout
from tallyframe.plans import documents
from tallyframe.plans.queries import QUERIES
from tallyframe.sources import receipts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|Round|Single)", plan_of(df)))


@pytest.mark.parametrize("name", ["tax_find_ids", "dat_find_dates", "inv_document_number", "str_legible", "tax_classify"])
def test_lines_of_a_document_are_not_moved_again(spark, sf, name):
    assert exchanges(QUERIES[name](spark, sf)) == 1


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(receipts, "TASK", 10)
    assert receipts.spread(spark.range(205).withColumnRenamed("id", "o_orderkey")).rdd.getNumPartitions() == 21


def test_vendors_read_the_lines_once(spark, sf):
    assert len(re.findall(r"Scan parquet", plan_of(QUERIES["ven_ranked"](spark, sf)))) == 1


def test_items_are_matched_after_one_exchange(spark):
    rows = spark.createDataFrame([(1, 1, "Rice", 2.0), (1, 2, "rice ", 3.0), (1, 3, None, 5.0), (2, 1, "Tea", 1.0)], "doc_id bigint, ord bigint, name string, price double")
    got = spark.createDataFrame([(1, 7, "RICE", 9.0), (1, 8, "zz", 3.005), (1, 9, None, 5.0), (3, 1, "Tea", 1.0)], "doc_id bigint, ord bigint, name string, price double")
    out = evaluation.greedy_items(rows, got)
    assert exchanges(out) == 1 and "CoGroups" not in plan_of(out)
    assert {tuple(r) for r in out.collect()} == {(1, 1, 7, "name"), (1, 2, 8, "price"), (1, 3, 9, "price")}


def test_dates_are_found_without_parsing(spark):
    cases = {"2000-02-29": "2000-02-29", "1900-02-29": None, "x 31/12/98 y": "2098-12-31", "13/12/1998": "1998-12-13", "2001-00-05": None, "0000-01-01": None, "no 12": None, "30.02.2000": None, "2001-13-01 and 04/05/2001": "2001-04-05"}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", first_numeric_date(F.col("t"), F.lit("US")).cast("string").alias("d"))
    assert {r["t"]: r["d"] for r in df.collect()} == cases and "gettimestamp" not in plan_of(df).lower()
    assert spark.range(1).select(day_of(F.lit(2023), F.lit(2), F.lit(29)).alias("d")).first()["d"] is None


def test_mean_confidence_of_a_line_is_exact_in_any_order(spark):
    ks = [96, 39, 29, 17, 35, 40, 18, 41, 100, 7, 14, 28, 55, 57, 58, 69]
    rows = lambda doc, xs: [(doc, 0, 0, 0, 0, i, f"w{i}", k / 100, i, 0) for i, k in enumerate(xs)]
    groups = [sorted(ks[i:] + ks[:i])[j : j + 8] for i in range(8) for j in range(8)]
    groups = [g for xs in groups for g in (xs, xs[::-1], xs[::2] + xs[1::2])]
    df = spark.createDataFrame([x for doc, xs in enumerate(groups) for x in rows(doc, xs)], "doc_id bigint, page int, block int, par int, line int, word_id bigint, text string, confidence double, left int, top int").coalesce(1)
    got = {r["doc_id"]: int(r["e4"]) for r in layout.lines_of_words(df).select("doc_id", F.round(F.col("confidence") * 10000).alias("e4")).collect()}
    want = {doc: (sum(round(x) for x in xs) * 200 + len(xs)) // (2 * len(xs)) for doc, xs in enumerate(groups)}
    assert got == want


def test_values_are_verified_in_their_document_s_row(spark, sf):
    df = QUERIES["ver_verified"](spark, sf)
    assert exchanges(df) == 1 and "Join" not in plan_of(df)


def test_a_date_is_formatted_and_a_text_reduced_to_digits_once(spark):
    df = spark.createDataFrame([("1998-05-04", "paid 5/4/98"), ("1998-05-04", "May 4th"), ("1998-05-04", "1998"), (None, "x")], "d string, t string")
    out = df.select(appears(F.col("d").cast("date"), F.col("t")).alias("a"))
    assert plan_of(out).count("date_format") <= 2 and [r["a"] for r in out.collect()] == [True, True, False, None]


def test_an_answer_is_parsed_once(spark):
    df = spark.createDataFrame([('{"tax_basis":"inclusive","confidence":0.9,"evidence":["VAT inclusive"]}', "vat inclusive"), ("[1, 2]", "x"), ('"{}"', "x"), ("so {not} json", "x"), ('[{"tax_basis":"exclusive"}]', "x"), (None, "x")], "a string, t string")
    out = df.select(choices.validated_semantics(F.col("a"), F.col("t")).alias("s"))
    assert [r["s"] and (r["s"]["tax_basis"], r["s"]["confidence"]) for r in out.collect()] == [("inclusive", 0.9), None, ("unknown", 0.0), None, ("unknown", 0.0), None]
    assert plan_of(out).count("parse_json") + plan_of(out).count("parseJson") <= 20


def test_a_line_that_both_readings_have_is_read_once(spark):
    df = spark.createDataFrame([(1, 1, 0, "a", 0.5)], "doc_id bigint, rank int, line_no int, text string, confidence double")
    plan = plan_of(documents.extract_documents(df, "2002-01-01"))
    assert re.search(r"array_distinct\(transform\(lines#\d+, lambdafunction\(lambda x_\d+#\d+\.text", plan)
