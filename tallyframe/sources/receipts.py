"""Receipts as rows: schemas of the word and ground-truth inputs, readers, and receipts rendered from an order book.

The rendered receipts carry their own truth (net, tax and total in cents, country, date), so accuracy operators have
something to be measured against; every 17th total is wrong on purpose.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "doc_id bigint, page int, engine string, variant string, psm int, word_id int, text string, confidence double, `left` int, top int, width int, height int, block int, par int, line int"
READINGS = "doc_id bigint, page int, engine string, variant string, psm int, text string, confidence double, anchor double"
TRUTH = "image string, source string, script string, print_type string, truth_source string, notes string, expect_manual_review boolean, expected map<string,string>, expected_items array<struct<name:string,quantity:int,price:decimal(18,2)>>, unknown array<string>, not_expected_values map<string,array<string>>, also_acceptable map<string,array<string>>"


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORDS).parquet(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth documents, one JSON object a file, by name; a missing key of ``expected`` is a missing map entry, not a null.

    Keys that are not known are kept as JSON in ``extra``. No file is an error.
    """
    files = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_name").alias("name"))
    if files.isEmpty():
        raise FileNotFoundError(f"no ground truth in {path}")
    known = ", ".join(f"'{x.split()[0]}'" for x in re.split(r", (?=\w+ (?:string|boolean|map|array))", TRUTH))
    extra = F.expr(f"map_from_entries(transform(filter(json_object_keys(value), k -> k NOT IN ({known})), k -> struct(k, get_json_object(value, concat('$.', k)))))")
    return files.select("name", F.from_json("value", TRUTH).alias("t"), extra.alias("extra")).select("name", "t.*", "extra").orderBy("name")


def kind(path: Column) -> Column:
    """pdf or image, by the end of a path or address; a query string after it is not part of it."""
    return F.when(F.lower(F.regexp_replace(path, r"\?.*$", "")).endswith(".pdf"), "pdf").otherwise("image")


def read_files(spark: SparkSession, path: str, most_pages: int = 5) -> DataFrame:
    """Input files with their kind and how many of their pages are read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content", kind(F.col("path")).alias("kind"), F.when(kind(F.col("path")) == "pdf", most_pages).otherwise(1).alias("most_pages"))


def money_text(cents: str) -> str:
    """SQL for cents as printed, with a comma before the last three whole digits."""
    whole, part = f"CAST(floor({cents} / 100) AS BIGINT)", f"lpad(CAST({cents} % 100 AS STRING), 2, '0')"
    return f"CASE WHEN {cents} < 100000 THEN concat(CAST({whole} AS STRING), '.', {part}) ELSE concat(CAST(CAST(floor({cents} / 100000) AS BIGINT) AS STRING), ',', lpad(CAST({whole} % 1000 AS STRING), 3, '0'), '.', {part}) END"


#: Column expressions, in SQL that any engine reads, over orders; each line may use the ones before it.
STEPS: tuple[tuple[str, ...], ...] = (
    ("o_orderkey AS doc_id", "CAST(o_orderdate AS DATE) AS d", "CAST(round(o_totalprice * 100) AS BIGINT) AS net_cents", "o_orderpriority AS priority", "o_orderstatus AS status", "o_custkey AS cust"),
    ("*", "CAST(floor((net_cents * 12 + 50) / 100) AS BIGINT) AS tax_cents", "CASE doc_id % 5 WHEN 0 THEN 'PH' WHEN 1 THEN 'US' WHEN 2 THEN 'MY' WHEN 3 THEN 'BN' ELSE 'XX' END AS true_country"),
    ("*", "net_cents + tax_cents AS true_total_cents", "net_cents + tax_cents + CASE WHEN doc_id % 17 = 0 THEN 300 ELSE 0 END AS printed_cents"),
    (
        "*",
        "CASE doc_id % 6 WHEN 0 THEN 'JOLLY GRILL RESTAURANT' WHEN 1 THEN 'HARBOUR HOTEL' WHEN 2 THEN 'City Taxi Cooperative' WHEN 3 THEN 'NORTH HARDWARE TRADING' WHEN 4 THEN 'Lakeside Dental Clinic' ELSE 'Unnamed Vendor' END AS vendor_line",
        "CASE true_country WHEN 'PH' THEN concat('VAT REG TIN 123-456-789-00', lpad(CAST(doc_id % 1000 AS STRING), 3, '0'), ' Makati City') WHEN 'US' THEN concat('Springfield, IL 62704 (217) 555-0', lpad(CAST(doc_id % 1000 AS STRING), 3, '0')) WHEN 'MY' THEN 'Jalan Besar Kuala Lumpur Malaysia' WHEN 'BN' THEN 'Bandar Seri Begawan Ent Rek (B) Sdn Bhd' ELSE 'Unit 5 Main Road' END AS place_line",
        "CASE doc_id % 4 WHEN 0 THEN concat('Date: ', CAST(d AS STRING)) WHEN 1 THEN concat('Date: ', lpad(CAST(month(d) AS STRING), 2, '0'), '/', lpad(CAST(day(d) AS STRING), 2, '0'), '/', CAST(year(d) AS STRING)) WHEN 2 THEN concat('Issued ', CAST(day(d) AS STRING), '-', CAST(month(d) AS STRING), '-', CAST(year(d) AS STRING)) ELSE concat('Printed ', CAST(year(d) AS STRING), '/', CAST(month(d) AS STRING), '/', CAST(day(d) AS STRING)) END AS date_line",
        "CASE WHEN doc_id % 2 = 0 THEN concat('Sales Invoice No. ', lpad(CAST(doc_id % 1000000 AS STRING), 6, '0')) ELSE 'Official Receipt' END AS number_line",
        f"concat('Subtotal ', {money_text('net_cents')}) AS net_line",
        f"concat(CASE true_country WHEN 'PH' THEN 'VAT 12% ' WHEN 'US' THEN 'Sales Tax ' WHEN 'MY' THEN 'SST ' ELSE 'Tax ' END, {money_text('tax_cents')}) AS tax_line",
        f"concat('Total Amount Due ', {money_text('printed_cents')}) AS total_line",
        "CASE doc_id % 3 WHEN 0 THEN 'Prices are VAT inclusive' WHEN 1 THEN 'Prices before tax' ELSE 'Thank you' END AS note_line",
    ),
    ("*", "concat(vendor_line, '\n', place_line, '\n', date_line, '\n', number_line, '\n', net_line, '\n', tax_line, '\n', total_line, '\n', note_line) AS text", "CAST(60 + doc_id % 40 AS DOUBLE) / 100 AS confidence"),
)


#: Fixed value: orders in a task. A task holds and sorts all lines of its documents, so their number bounds its time and memory.
TASK = 25_000


def spread(df: DataFrame, key: str = "o_orderkey") -> DataFrame:
    """df dealt by key into tasks of one size, however large it is: a document's lines are then together wherever they are grouped by it, without being moved.

    The count reads the files' footers only.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK))
    return df.repartition(n, key)


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One receipt for each order: its text, the reading's confidence, and the truth."""
    df = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_custkey"))
    for step in STEPS[:-1]:
        df = df.selectExpr(*step)
    # a generator, so that what uses the text does not write its expression out again
    texts = [x for x in STEPS[-1] if x.endswith(" AS text")]
    return df.selectExpr(*(f"explode(array({x[: -len(' AS text')]})) AS text" if x in texts else x for x in STEPS[-1]))


def rendered_sql() -> str:
    """The same receipts as a common table expression named receipts."""
    inner = "orders"
    for k, step in enumerate(STEPS):
        inner = f"(SELECT {', '.join(step)} FROM {inner}) s{k}"
    return f"WITH receipts AS (SELECT * FROM {inner})"
