import datetime
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import fuzzy, money
from tallyframe.functions import text as T
from tallyframe.operators import category, choices, corrections, dated, evaluation, geometry, headers, itemlines, payloads, reports, taxids, verification
from tallyframe.plans.queries import BEYOND_SQL
from tallyframe.sources import receipts
from tallyframe.streaming import jobs


def one(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    return spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("x")).first()["x"]


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_likeness_against_tables():
    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choice("abc d") for _ in range(r.randint(0, 14))) for _ in range(2))
        assert fuzzy.common(a, b) == longest_common(a, b)
        want = 100.0 if not a and not b else 200 * longest_common(a, b) / (len(a) + len(b))
        assert fuzzy.ratio(a, b) == want
        s, t = sorted((a, b), key=len)
        parts = {t[max(0, k) : max(0, k + len(s))] for k in range(-len(s) + 1, len(t))} - {""}
        if s:
            assert fuzzy.partial(a, b) == pytest.approx(max((200 * longest_common(s, p) / (len(s) + len(p)) for p in parts), default=0))
    assert fuzzy.token_set("jollibee las vegas", "jollibee") == 100 and fuzzy.token_set("", "a") == 0
    assert fuzzy.token_set("acme trading corp", "acme trading inc") == pytest.approx(100 * 2 * len("acme trading") / (2 * len("acme trading") + 4))
    assert fuzzy.normalised("  Çà  Straße\tÉ ") == "ca strasse e"


def lines(spark, texts, doc=1, reading=0):
    return spark.createDataFrame([(doc, reading, reading + 1, i, t, 0.9) for i, t in enumerate(texts)], "doc_id bigint, reading int, rank int, line_no int, text string, confidence double")


def items_of(spark, *texts):
    got = itemlines.parse_items(lines(spark, texts)).select(itemlines.named(F.col("items")).alias("i")).first()
    return [(x["name"], x["quantity"], float(x["price"])) for x in got["i"]] if got else []


def test_item_regions(spark):
    assert items_of(spark, "Details", "1 Family bundle--10pcs $29 ,99", "Chickenjoy bucket + 3 large sides", "Subtotal 29.99") == [("Family bundle--10pcs Chickenjoy bucket + 3 large sides", 1, 29.99)]
    assert items_of(spark, "SALAD 5.00", "Cash 20.00", "SODA 2.50", "Total 7.50", "FRIES 3.00") == [("SALAD", 1, 5.0), ("SODA", 1, 2.5)]
    assert items_of(spark, "Qty Item", "64.00 V", "2 x 64.00", "4800016522533 DRD PEV-CUT EP025G", "Total 128.00") == [("DRD PEV-CUT EP025G", 2, 64.0)]
    assert items_of(spark, "particulars", "64.00 V", "Total 64.00") == [("Unreadable item", 1, 64.0)]
    assert items_of(spark, "Bond Paper 2 490.00", "ci cr } UM SDR \\ 20.00", "12.00", "FOOD 510.00") == [("Bond Paper", 2, 490.0), ("Unreadable item", 1, 20.0)]
    assert items_of(spark, "Discount 3.00", "Details", "Pens 1.00") == [("Pens", 1, 1.0)]
    assert items_of(spark, "", "  ") == [] and itemlines.parse_items(lines(spark, ["x"]).limit(0)).count() == 0


def test_item_targets(spark):
    d = lambda x: F.lit(x).cast("decimal(18,2)")
    t = lambda basis, derived=(): [x["name"] for x in spark.range(1).select(itemlines.targets(F.lit(basis), d("10"), d("11.2"), d("12.2"), d("1.2"), d("1"), F.array(*map(F.lit, derived)).cast("array<string>")).alias("t")).first()["t"]]
    assert t("exclusive") == ["net_sales", "total_amount", "total_less_tax_and_charges"] and t("inclusive") == ["total_sales", "total_amount", "total_less_tax_and_charges"]
    assert t("unknown") == ["net_sales", "total_sales"] and t("unknown", ("net_sales",)) == ["total_sales"]


def test_tax_ids(spark):
    found = lambda *t: [(r["formatted"], r["role"]) for r in taxids.find_tax_ids(lines(spark, t)).orderBy("rank").collect()]
    assert found("VAT REG TIN 000-774-47 1-025") == [("000-774-471-025", "vendor")]
    assert found("Registered Name", "987-654-321-000", "x", "VAT Reg. TIN 303-124-202-00000") == [("303-124-202-00000", "vendor"), ("987-654-321-000", "customer")]
    assert found("223 2890 223 2891", "62845289260246240685C") == [] and found("TIN 000774471025") == [("000-774-471-025", "unknown")]
    both = taxids.vendor_tax_id(taxids.find_tax_ids(lines(spark, ["111-222-333-444", "555-666-777-888"]))).first()
    assert (both["tax_id"], both["ambiguous"]) == ("111-222-333-444", True)


def test_dates_and_numbers(spark):
    def best(*t, country=None):
        rows = dated.find_dates(lines(spark, t).withColumn("country", F.lit(country).cast("string")), "2026-01-01")
        got = dated.transaction_date(rows).first()
        return got and got["date"]

    day = datetime.date
    assert best("Date: 05/24/2025") == day(2025, 5, 24) and best("Date: 04/05/2025", country="MY") == day(2025, 5, 4)
    assert best("Date/time 11/20/2019 card", "Date: 5/24/2025") == day(2025, 5, 24) and best("ATP valid until 01/02/2025") is None
    assert best("Date 20250524") == day(2025, 5, 24) and best("20250524") is None and best("24th May 25") == day(2025, 5, 24) and best("May 24, 2025") == day(2025, 5, 24)
    number = lambda *t: (dated.document_number(lines(spark, t)).first() or {"number": None})["number"]
    assert number("Sales Invoice No. 000123") == "000123" and number("Permit No. 123456", "No. 038MP2014") is None and number("OR No: 4455", "No.: 99999") == "4455"


def test_vendors(spark):
    tidy = lambda x: one(spark, headers.tidied_line, x)
    assert tidy("<aauanvor we| DETOXICARE LABORATORY, INC") == "DETOXICARE LABORATORY, INC" and tidy("G DOLLAR TREE") == "Dollar Tree" and tidy(" ** SFWY 12 ") == "Safeway"
    rows = lines(spark, ["Scientific Biotech Specialties, Inc.", "UNITED DAILY PRESS INC", "12/F Tower, Makati City", "Received from Scientific Biotech Specialties, Inc.  today"])
    ranked = headers.ranked_vendors(rows).orderBy("rank").collect()
    assert ranked[0]["name"] == "UNITED DAILY PRESS INC" and [r["name"] for r in ranked if r["score"] < 1] != []
    choose = lambda c: headers.choose_vendor(headers.shortlists(headers.ranked_vendors(rows)).withColumn("choice", F.lit(c).cast("string"))).first()
    assert choose(None)["method"] == "deterministic" and choose("united daily press")["method"] == "llm_selection" and choose("Nobody")["method"] == "llm_rejected_off_shortlist"
    assert not one(spark, headers.is_candidate, "Description Amount") and not one(spark, headers.is_candidate, "OFFICIAL RECEIpr 12") and one(spark, headers.is_candidate, "Bayan Telecommunications, Inc.")
    assert [r["address"] for r in headers.ranked_addresses(lines(spark, ["ACME CORP", "Ever Building Quezon City", "2/F Ever Hall"])).orderBy("rank").collect()] == ["Ever Building Quezon City", "2/F Ever Hall"]


def test_verification(spark):
    docs = spark.createDataFrame([(1, "ACME TRADING\nTotal 39.93\nMay 24, 2025", False, True, 0.9, False), (2, "", True, False, 0.0, True), (3, "Total 50\nПрайс few words stand here", True, True, 0.9, False)], "doc_id bigint, text string, reconciled boolean, located boolean, confidence double, ambiguous boolean")
    fields = spark.createDataFrame([(1, "net_sales", "39.93", False), (1, "tax_amount", "4.07", False), (1, "vendor_name", "Acme Tradlng", False), (1, "transaction_date", "2025-05-24", False), (1, "tax_rate", "0.12", False), (3, "total_amount", "50.00", False), (3, "net_sales", "44.64", True), (3, "location", None, False)], "doc_id bigint, field string, value string, derived boolean")
    got = {r["doc_id"]: r for r in verification.verify(docs, fields).collect()}
    assert set(got[1]["fields"]) == {"vendor_name", "transaction_date", "tax_rate"} and set(got[1]["rejected"]) == {"tax_amount", "net_sales (unreconciled)"}
    assert got[1]["reasons"] == ["ungrounded_values_rejected", "total_amount_missing", "reconciliation_failed"]
    assert got[2]["reasons"] == ["total_amount_missing", "locale_unresolved", "tax_id_ambiguous", "handwriting_or_illegible"] and got[2]["populated"] == 0
    assert set(got[3]["fields"]) == {"total_amount", "net_sales"} and got[3]["reasons"] == ["non_latin_script"]


def test_currencies_and_semantics(spark):
    assert one(spark, choices.explicit_currency, "USD 5\nTotal PHP 12.00") == "PHP" and one(spark, choices.explicit_currency, "Acme Sdn. Bhd.\nRM 5.00") == "MYR" and one(spark, choices.explicit_currency, "plain") is None
    say = lambda a, t: one(spark, choices.validated_semantics, a, t)
    assert say('{"tax_basis":"inclusive","confidence":0.9,"evidence":["VAT incl"]}', "a vat incl b")["tax_basis"] == "inclusive"
    assert say('{"tax_basis":"inclusive","confidence":0.9,"evidence":[]}', "a vat incl b")["tax_basis"] == "unknown" and say("[1]", "x") is None


def test_payloads(spark):
    fields = F.create_map(F.lit("vendor_name"), F.lit("x" * 300), F.lit("currency"), F.lit("zzz"), F.lit("tax_basis"), F.lit("odd"))
    p = spark.range(1).select(payloads.callback(fields, F.lit(-1.0), F.lit(False), F.lit(None).cast("double"), F.lit(True)).alias("p")).first()["p"]
    assert len(p["vendor_name"]) == 255 and p["currency"] is None and "tax_basis" not in p and p["ocr_confidence_score"] == "0.0" and p["status"] == "completed"


def test_corrections(spark):
    terms = spark.createDataFrame([("coffee",), ("red",)], "term string")
    phrases = spark.createDataFrame([(1, 0, "REB Cofee, tea"), (1, 1, "PEV-CUT EP025G COFFE"), (2, 0, "Coffe")], "doc_id bigint, ord int, phrase string")
    read = spark.createDataFrame([(2, "coffe", 0.99)], "doc_id bigint, text string, confidence double")
    got = {(r["doc_id"], r["ord"]): r["corrected"] for r in corrections.corrected(phrases, read, terms).collect()}
    assert got == {(1, 0): "RED Coffee, tea", (1, 1): "PEV-CUT EP025G COFFE", (2, 0): "Coffe"}


def test_truth_files(spark, tmp_path):
    doc = {"image": "b.jpg", "expected": {"total_amount": "5", "country": None}, "unknown": ["items"], "template": "us_pos", "amount_in_words_only": True}
    (tmp_path / "b.json").write_text(json.dumps(doc))
    (tmp_path / "a.json").write_text(json.dumps({"image": "a.jpg"}))
    rows = receipts.read_truth(spark, f"{tmp_path}/*.json").collect()
    assert [r["image"] for r in rows] == ["a.jpg", "b.jpg"] and rows[1]["expected"] == {"total_amount": "5", "country": None} and rows[1]["extra"] == {"template": "us_pos", "amount_in_words_only": "true"}
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        receipts.read_truth(spark, f"{tmp_path}/none")


def test_words_without_boxes(spark):
    rows = spark.createDataFrame([(1, 0, " ab  cde ", 1.4, 10, 5, 80, 15)], "doc_id bigint, line int, text string, confidence double, left int, top int, right int, bottom int")
    got = [(r["text"], r["left"], r["width"], r["confidence"]) for r in geometry.spread_words(rows).orderBy("word_id").collect()]
    assert got == [("ab", 10, 20, 1.0), ("cde", 50, 30, 1.0)]
    assert one(spark, lambda x: money.rest_of(money.words_of(x)), "1 Family $29 ,99") == "1 Family"
    assert one(spark, T.looks_like_store_code, "JNJ MRCHPSN / CHS24G") and not one(spark, T.looks_like_store_code, "CHICKEN")


def test_segments_of_a_document(spark):
    rows = spark.createDataFrame([(1, ["a", "b"])], "doc_id bigint, urls array<string>")
    assert [(r["segment"], r["url"]) for r in geometry.segments(rows).collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(Exception, match="5 segments"):
        geometry.segments(rows.withColumn("urls", F.array(*[F.lit("x")] * 5))).collect()


def test_look_back_of_a_stream(spark, tmp_path):
    store = spark.createDataFrame([(7, "a", [1.0, 0.0], datetime.datetime(2026, 1, 1)), (8, "a", [1.0, 0.0], datetime.datetime(2025, 1, 1))], "receipt_id bigint, source_service string, embedding array<double>, created_at timestamp")
    spark.createDataFrame([(1, 1, "a", [0.99, 0.1]), (2, 2, "a", [0.0, 1.0]), (1, 1, "a", [0.99, 0.1])], "job_id bigint, receipt_id bigint, source_service string, embedding array<double>").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("job_id bigint, receipt_id bigint, source_service string, embedding array<double>").parquet(f"{tmp_path}/in")
    jobs.lookback_verdicts(stream, store, "2026-02-01", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = {r["query_id"]: r["is_duplicate"] for r in spark.read.parquet(f"{tmp_path}/out/batch=*").collect()}
    assert got == {1: True, 2: False}


def test_reports_and_gates(spark):
    t = spark.createDataFrame([("vendor_name", 10, 9), ("total_amount", 10, 9)], "field string, scored bigint, passed bigint")
    met = {r["field"]: r["met"] for r in reports.gated(t, reports.specs(spark)).collect()}
    assert met["vendor_name"] is True and met["total_amount"] is False and met["country"] is None and len(met) == 16
    names = spark.createDataFrame([(1, 0, "a", Decimal("1.00"))], "doc_id bigint, ord bigint, name string, price decimal(18,2)")
    assert evaluation.greedy_items(names, names.withColumn("name", F.lit("zz")).withColumn("price", F.lit("1.01").cast("decimal(18,2)"))).first()["how"] == "price"
    with pytest.raises(ValueError):
        category.by_vector(spark.range(1).withColumn("embedding", F.array(F.lit(1.0))), spark.range(5).select(F.col("id").cast("string").alias("category"), F.array(F.lit(1.0)).alias("embedding")), most=4)


@pytest.mark.parametrize("name", sorted(BEYOND_SQL))
def test_queries_without_sql_run(spark, sf, name):
    assert BEYOND_SQL[name](spark, sf).limit(5).count() >= 0
