import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import dates, money, text, vectors
from tallyframe.operators import category, evaluation, items, layout, locale, readings, similarity, tax
from tallyframe.operators.confidence import cap_of, confidence
from tallyframe.operators.reconcile import resolve
from tallyframe.sources import receipts
from tallyframe.streaming import jobs


def one(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    return spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, country, want",
    [("$32.50", None, "32.50"), ("$32,50", None, "32.50"), ("1.234,50", "DE", "1234.50"), ("1,234.50", "PH", "1234.50"), ("12.00-", None, "-12.00"), ("abc", None, None), (None, None, None), ("1.2.3", None, None), ("7", "US", "7.00"), ("1,5", "DE", "1.50")],
)
def test_money(spark, raw, country, want):
    assert one(spark, money.normalize, raw, country) == (None if want is None else Decimal(want))


def test_amount_words(spark):
    assert [one(spark, money.printed, x) for x in ("$15.8", "1,234.50", "0015", "306.", "P12.00-")] == ["15.8", "1,234.50", "", "", "12.00"]
    assert one(spark, money.plausible, "$1.8") and not one(spark, money.plausible, "7")


@pytest.mark.parametrize("line, country, want", [("Date: 2025-05-24", None, (2025, 5, 24)), ("05/24/2025", "US", (2025, 5, 24)), ("24/05/2025", "US", (2025, 5, 24)), ("04/05/25", "MY", (2025, 5, 4)), ("99/99/2025", "US", None), ("none", None, None)])
def test_line_dates(spark, line, country, want):
    assert one(spark, dates.first_numeric_date, line, country) == (want and datetime.date(*want))


def test_date_values(spark):
    for x in ("2025-05-24", "05-24-2025", "24/05/2025", "May 24, 2025", "24 May 2025", "at 2025-05-24 10:00"):
        assert one(spark, dates.parse_value, x) == datetime.date(2025, 5, 24), x
    assert one(spark, dates.parse_value, "n/a") is None


def test_words(spark):
    good = ("Ent rek (B) Sdn.Bhd.", "JOLLY GRILL", "Harbour")
    bad = ("a b c", "12 34 56", "aBcDe fGhIj", "", "== OI")
    assert all(one(spark, text.looks_like_words, x) for x in good) and not any(one(spark, text.looks_like_words, x) for x in bad)
    assert one(spark, lambda x: text.bounded(x, 10, 4, 3, "|"), "abcdefghijkl") == "abcd|jkl"
    assert one(spark, text.blank_to_null, "  ") is None


def test_labels(spark):
    best = lambda x: one(spark, layout.best_label, x)
    assert best("SUBTOTAL 1.00")["field"] == "net_sales" and best("Total Amount Due")["label"] == "total amount due"
    assert best("Total Sales (VAT Inclusive)")["field"] == "total_sales" and best("COLGATE TOTAL 5.00") is None and best("totally") is None
    assert one(spark, layout.is_noise, "BIR Permit No. 12") and not one(spark, layout.is_noise, "Total 12.00")


def test_words_make_lines_and_pairs(spark):
    w = [(1, 0, "e", "raw", 3, i, t, 0.9, x, y, 30, 12, 1, 1, n) for i, (t, x, y, n) in enumerate([("Total", 0, 40, 2), ("5.00", 90, 41, 2), ("Shop", 0, 0, 1), ("A", 40, 1, 1)])]
    lines = layout.lines_of_words(spark.createDataFrame(w, receipts.WORDS)).orderBy("line_no").collect()
    assert [r["text"] for r in lines] == ["Shop A", "Total 5.00"]


def test_locale(spark):
    got = one(spark, locale.detect, "Bandar Seri Begawan Ent Rek (B) Sdn Bhd GST")
    assert (got["country"], got["currency"]) == ("BN", "BND")
    assert one(spark, locale.detect, "$ 5 and $ 6")["country"] == "US" and one(spark, locale.detect, "nothing")["country"] is None
    assert one(spark, locale.tax_basis, "price before tax", "PH") == "exclusive" and one(spark, locale.tax_basis, "x", "PH") == "inclusive"


def test_tax(spark):
    assert one(spark, tax.valid_tin, "303-124-202-00000") and one(spark, tax.valid_tin, "000-774-47 1-025V") and not one(spark, tax.valid_tin, "12-34")
    assert one(spark, tax.format_tin, "30312420200000") == "303-124-202-00000"
    assert [one(spark, tax.vat_class, x) for x in ("NON-VAT REG TIN", "VAT REG TIN", "VAT-Exempt Sales", "VATable", "")] == ["non-vat", "vat", "non-vat", "vat", "non-vat"]


CASES = [
    # country, basis, registered, net, tax, sales, service, total, printed | net, tax, total, reconciled, status
    (("PH", "inclusive", True, None, None, "112.00", None, "112.00", ["112.00"]), ("100.00", "12.00", "112.00", True, "reconciled")),
    (("PH", "inclusive", True, "100.00", "12.00", None, None, "112.00", []), ("100.00", "12.00", "112.00", True, "reconciled")),
    (("US", "exclusive", True, "100.00", "8.00", None, None, None, []), ("100.00", "8.00", "108.00", True, "computed")),
    (("US", "exclusive", True, "100.00", "8.00", None, None, "108.01", []), ("100.00", "8.00", "108.01", True, "reported")),
    (("US", "exclusive", True, "100.00", "8.00", None, None, "120.00", []), ("100.00", "8.00", "120.00", False, "reported_conflict")),
    ((None, "unknown", True, "50.00", None, None, None, "50.00", []), ("50.00", None, "50.00", True, "reconciled")),
    ((None, "unknown", True, None, None, None, None, "50.00", []), (None, None, "50.00", False, "unresolved")),
    (("PH", "inclusive", False, None, None, "80.00", None, "80.00", []), ("80.00", None, "80.00", True, "reconciled")),
]


@pytest.mark.parametrize("given, want", CASES)
def test_reconcile(spark, given, want):
    d = lambda x: None if x is None else Decimal(x)
    row = (*given[:3], *map(d, given[3:8]), [Decimal(x) for x in given[8]])
    schema = "country string, basis string, vat_registered boolean, net decimal(18,2), tax decimal(18,2), sales decimal(18,2), service decimal(18,2), total decimal(18,2), printed array<decimal(18,2)>"
    got = resolve(spark.createDataFrame([row], schema)).first()
    assert (got["net_out"], got["tax_out"], got["total_out"], got["reconciled"], got["status"]) == (d(want[0]), d(want[1]), d(want[2]), want[3], want[4])


def test_confidence(spark):
    df = spark.range(1).select(confidence(F.lit(7.0), F.lit(0.9), F.lit(1.0), F.lit(True), F.lit(1.0), cap_of(F.array(F.lit("no_total")), {"no_total": 0.55})).alias("c")).first()["c"]
    assert (df["ocr_quality"], df["score"], df["flagged"]) == (0.97, 0.55, True)


def test_readings(spark):
    r = [(1, 1, "a", 8.0, 0.5, "raw"), (1, 2, "b", 9.0, 0.1, "raw"), (1, 3, "b", 8.5, 0.9, "flat"), (1, 4, " ", 10.0, 0.9, "flat"), (1, 5, "c", 4.0, 0.9, "flat"), (1, 6, "d", 5.0, 0.9, "clean")]
    df = spark.createDataFrame(r, "doc_id int, reading_id int, text string, anchor double, confidence double, variant string")
    role = {x["reading_id"]: x["role"] for x in readings.with_support(df).collect()}
    assert role == {2: "primary", 3: "other", 1: "support", 5: "other", 6: "support"}
    assert readings.combined_text(df).first()["combined"] == "b\nd\na"
    tokens = spark.createDataFrame([(1, "b")], "doc_id int, token string")
    assert readings.agreement(df, tokens).first()["readings"] == 2


def test_items(spark):
    df = spark.createDataFrame([(1, i, Decimal(p), 1) for i, p in enumerate(("1.00", "2.00", "3.00", "9.00"))], "doc_id int, ord int, price decimal(18,2), quantity int")
    assert [r["ord"] for r in items.cut_at_subtotal(df).orderBy("ord").collect()] == [0, 1]
    assert [one(spark, items.quantity, x) for x in ("2 x Cola", "3pcs Bread", "Cola x4", "Cola")] == [2, 3, 4, 1]


def test_similarity_and_vectors(spark):
    rows = [(1, "s", [1.0, 0.0], "2024-01-01"), (2, "s", [0.9, 0.1], "2024-01-01"), (3, "t", [1.0, 0.0], "2024-01-01"), (4, "s", [1.0, 0.0], "2023-01-01"), (5, "s", [0.0, 0.0], "2024-01-01")]
    df = spark.createDataFrame(rows, "receipt_id int, source_service string, embedding array<double>, at string").withColumn("created_at", F.col("at").cast("timestamp"))
    got = similarity.similar(df.where("receipt_id = 1"), df, "2024-01-15").collect()
    assert [r["receipt_id"] for r in got] == [2]
    verdict = {r["query_id"]: r["is_duplicate"] for r in similarity.verdicts(df, similarity.similar(df, df, "2024-01-15")).collect()}
    assert verdict == {1: True, 2: True, 3: False, 4: True, 5: False}
    assert spark.range(1).select(vectors.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0), F.lit(2.0))).alias("c")).first()["c"] == 0.0


def test_category(spark):
    assert one(spark, category.by_lexicon, "City Taxi")["category"] == "Transportation" and one(spark, category.by_lexicon, "Zed")["method"] == "default"
    assert [one(spark, category.coerce, x) for x in ("meals", "travel costs", "?")] == ["Meals", "Travel", "Others"]


def test_items_match_by_price_after_names(spark):
    schema = "doc_id int, ord int, name string, price decimal(18,2)"
    e = spark.createDataFrame([(1, 0, "Cola", Decimal(2)), (1, 1, "Bread", Decimal(3)), (1, 2, "Salt", Decimal(4))], schema)
    p = spark.createDataFrame([(1, 0, "cola ", Decimal(9)), (1, 1, "Brd", Decimal(3))], schema)
    assert sorted((r["ord"], r["p_ord"], r["how"]) for r in evaluation.greedy_items(e, p).collect()) == [(0, 0, "name"), (1, 1, "price")]


def test_value_matching(spark):
    m = lambda k, a, b: one(spark, evaluation.matches, k, a, b)
    assert m("money", "1.00", "1.01") and not m("money", "1.00", "1.02") and m("digits", "1-2", "12") and m("date", "2024-01-02", "2024-01-02") and not m("exact", "a", None)


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"image": "a.jpg", "expected": {"total_amount": None}, "unknown": ["items"]}))
    row = receipts.read_truth(spark, str(tmp_path)).first()
    assert row["expected"] == {"total_amount": None} and row["unknown"] == ["items"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.PDF").write_bytes(b"1")
    (tmp_path / "f" / "y.png").write_bytes(b"22")
    assert sorted((r["kind"], r["length"]) for r in receipts.read_files(spark, str(tmp_path / "f")).collect()) == [("image", 2), ("pdf", 1)]


def test_streaming_intake_and_metrics(spark, tmp_path):
    data = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "job_id long, url string")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = jobs.intake(stream, lambda df: df.withColumn("done", F.lit(True)), str(tmp_path / "out"), str(tmp_path / "check"))
    assert q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    log = spark.createDataFrame([(1, 0, "queued", "2024-01-01 00:00:00"), (1, 1, "processing", "2024-01-01 00:00:01"), (1, 2, "completed", "2024-01-01 00:00:03"), (2, 0, "queued", "2023-01-01 00:00:00")], "job_id long, seq long, status string, t string")
    log = log.select("job_id", "seq", "status", F.col("t").cast("timestamp").alias("updated_at"), F.create_map(F.lit("k"), F.col("status")).alias("patch"))
    m = jobs.metrics(jobs.latest(log), "2024-01-01 12:00:00").first()
    assert (m["jobs"], m["last_day"], m["avg_ms"], m["success_rate"], m["queue_depth"]) == (2, 1, 3000.0, 1.0, 1)
    assert jobs.broken_steps(log).count() == 0


def test_items_match_by_likeness_and_adjacent_cents(spark, sf):
    schema = "doc_id int, ord int, name string, price decimal(18,2)"
    e = spark.createDataFrame([(1, 0, "Brown bread", Decimal(1)), (1, 1, "Salt", Decimal("4.00")), (1, 2, "Oil", Decimal("4.01")), (1, 3, "Tea", Decimal(9)), (1, 4, "Jam", None)], schema)
    p = spark.createDataFrame([(1, 0, "Brwn bread", Decimal(7)), (1, 1, "?", Decimal("4.01")), (1, 2, "??", Decimal("4.02")), (1, 3, "???", Decimal("9.02")), (1, 4, "????", None)], schema)
    got = sorted((r["ord"], r["p_ord"], r["how"]) for r in evaluation.greedy_items(e, p).collect())
    assert got == [(0, 0, "name"), (1, 1, "price"), (2, 2, "price")]
    assert evaluation.likeness("a b", "b a c") == 100.0 and evaluation.likeness("a", "z") == 0.0
    from __spark_entry__ import queries

    assert {r["how"] for r in queries()["joi_match_items"](spark, sf).select("how").distinct().collect()} == {"name", "price"}
