"""Items of pages: the same as of lines, found in their document's row, with hard regions."""

import re

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import money
from tallyframe.functions import text as T
from tallyframe.operators import headers, itemlines, readings
from tallyframe.plans.queries import QUERIES
from tallyframe.sources import slips

CASES = {  # lines, items
    ("Details", "Pens 1.00", "Subtotal 1.00", "Ink 9.00"): [("Pens", 1, 1.0)],
    ("Green tea 2.00", "Particulars", "Total 2.00"): [("Green tea Particulars", 1, 2.0)],  # nothing behind the opening line, so from the top
    ("Total due", "Qty Item", "Total", "3  Rice 6.00", "with\tsoup", "Total 6.00", "Salt 1.00"): [("Rice with soup", 3, 6.0)],
    ("Item", "Green tea 2.00", "Milk 3.00", "Food 5.00", "Salt 1.00"): [("Green tea", 1, 2.0), ("Milk", 1, 3.0)],  # up to the sum
    ("Item", "|Blue_Pen, 4.00", "64.00 V", "2 x 64.00", "4800016522533 DRD PEV-CUT EP025G", "Balance 1.00"): [("Blue Pen", 1, 4.0), ("DRD PEV-CUT EP025G", 2, 64.0)],
    ("Item", "Cash 4.00", "", "0.00"): [],
}


def exchanges(plan):
    return len(re.findall(r"Exchange (?:hash|range|Round|Single)", plan))


def test_items_of_pages_and_of_lines(spark):
    pages = [(1, [(r, list(ls)) for r, ls in enumerate(CASES)] + [(9, ["", "  "])]), (2, [(0, list(next(iter(CASES))))])]
    df = spark.createDataFrame(pages, "doc_id bigint, pages array<struct<reading:int,lines:array<string>>>")
    rows = lambda out: {(r["doc_id"], r["reading"]): [(x["name"], x["quantity"], float(x["price"])) for x in r["i"]] for r in out.select("doc_id", "reading", itemlines.named(F.col("items")).alias("i")).collect()}
    want = {(1, r): items for r, items in enumerate(CASES.values())} | {(2, 0): next(iter(CASES.values()))}
    assert rows(itemlines.parse_pages(df)) == want
    lines = df.select("doc_id", F.inline("pages")).select("doc_id", "reading", F.posexplode("lines").alias("line_no", "text"))
    assert rows(itemlines.parse_items(lines.repartition(3))) == want


@pytest.mark.parametrize("name", ["itm_regions", "win_best_items"])
def test_items_are_found_in_their_document_s_row(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert exchanges(plan) == 1 and "collect_list" not in plan and "Join" not in plan and plan.count("Scan parquet") == 1


def test_names_and_counts_at_the_edges(spark):
    cases = {"2 x": ("x", 2), " 3  Rice": ("Rice", 3), "Rice x4 ": ("Rice", 4), "Rice 12": ("Rice", 12), "0 Rice": ("Rice", 1), "7UP can": ("7UP can", 1), "x 3": ("x", 3), "12": ("12", 1), "A4 paper": ("A4 paper", 1), "1234 Rice 1234": ("1234 Rice 1234", 1)}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.without_quantity(F.col("t")).alias("n"), T.item_quantity(F.col("t")).alias("q"))
    assert {r["t"]: (r["n"].strip(), r["q"]) for r in df.collect()} == cases
    odd = spark.createDataFrame([(" a\t\tb  c \n",), ("",), (None,)], "t string").select(T.squeezed(F.col("t")).alias("s"), T.letters(F.col("t")).alias("n"))
    assert [tuple(r) for r in odd.collect()] == [("a b c", 3), ("", 0), (None, None)]


@pytest.mark.parametrize("name", ["ven_ranked", "ext_documents", "str_item_names"])
def test_documents_come_as_rows(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert exchanges(plan) == 1 and "collect_list" not in plan and plan.count("Scan parquet") == 1


def test_lines_are_listed_once_with_all_their_places(spark):
    pages = [(0, ["a", "b", None, "c"]), (4, ["a", "x", None]), (7, ["b", "b", "y", "c", "d"])]
    df = spark.createDataFrame([(1, pages)], "doc_id bigint, pages array<struct<reading:int,lines:array<string>>>")
    got = df.select(F.inline(readings.lines_at(F.col("pages")))).collect()
    assert sorted((x["reading"], x["line_no"], str(r["text"])) for r in got for x in r["at"]) == sorted((r, n, str(t)) for r, ts in pages for n, t in enumerate(ts))
    assert sum(r["text"] == "c" for r in got) == 1


def test_documents_of_slips_are_their_lines(spark, sf):
    docs = slips.slip_documents(spark, sf).select("doc_id", F.inline("lines"))
    lines = slips.slip_lines(spark, sf).select(*docs.columns)
    assert docs.dtypes == lines.dtypes and docs.exceptAll(lines).count() == 0 == lines.exceptAll(docs).count()


def test_headings_and_codes(spark):
    texts = {"Qty Description Unit Price": True, "No. 1 - Item x": True, "Items": True, "Itemsy": False, "Unit Price\nRef": True, "a b": False, "": False, "Netto total": False, "12": False, "Amount of": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", headers.is_heading(F.col("t")).alias("h"))
    assert {r["t"]: r["h"] for r in df.collect()} == texts
    codes = {"DRD EP025G": True, "A4 PAPER": False, "3PCS": True, "3pcs": False, "1 A": False, "É 3PCS": True, "é 3PCS": False}
    df = spark.createDataFrame([(t,) for t in codes], "t string").select("t", T.looks_like_store_code(F.col("t")).alias("c"))
    assert {r["t"]: r["c"] for r in df.collect()} == codes


def test_a_receipt_s_anchors_are_scored_once(spark, sf):
    plan = QUERIES["ext_extract"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?s)(.*?)") == 1


def test_names_of_lines_step_by_step(spark):
    texts = [t for ls in CASES for t in ls] + ["2 x", " 3  Rice", "Rice x4 ", "0 Rice", "12", "1x Bond  Paper $29 .99", "|_A__b| 7.50 V", "4800016522533 DRD PEV-CUT EP025G", "ci cr } UM SDR 20.00", "1.234.56 x", "\t a \n", "É 3PCS 1,234.50", None, "", "12345678 x 3", "x3", "3 x 4 5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rest = money.rest_of(money.words_of(F.col("text")))
    name = T.clean_name(T.without_quantity(rest))
    want = df.select("i", "text", name.alias("name"), T.item_quantity(rest).alias("quantity"), T.looks_like_store_code(name).alias("code"), T.plausible_description(F.col("text")).alias("describes"), T.is_count_only(rest).alias("count_only"), T.looks_like_item_name(name).alias("like_item"), T.readable(name).alias("shown"))
    assert sorted(map(str, itemlines.with_names(df).select(*want.columns).collect())) == sorted(map(str, want.collect()))
