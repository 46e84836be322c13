"""Queries of questions, answers and truth documents, each with the same query as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asking
from ..sources import truth
from .registry import query, table

_TRUTH = """concat('{"image": "e', CAST(event_id AS STRING), '.jpg", "print_type": "', event_type, '"', CASE WHEN event_id % 3 = 0 THEN ', "source": "synthetic"' ELSE '' END, CASE WHEN event_id % 4 = 0 THEN ', "expect_manual_review": true' ELSE '' END,
  ', "expected": {"user": ', CAST(user_id AS STRING), CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 5 = 0 THEN ', "total_amount": null' ELSE concat(', "total_amount": "', CAST(user_id * 3 AS STRING), '.50"') END, '}', CASE WHEN event_id % 6 = 0 THEN ', "unknown": ["total_amount"]' ELSE '' END,
  CASE WHEN event_id % 9 = 0 THEN ', "expected_items": [{"name": "a"}, {"name": "b"}]' WHEN event_id % 9 = 1 THEN ', "expected_items": null' ELSE '' END, ', ', substr(props, 2))"""


@query(f"""WITH d AS (SELECT event_id, event_type, user_id, {_TRUTH} AS j FROM events)
  SELECT event_id, json_extract_string(j, '$.image') AS image, coalesce(json_extract_string(j, '$.source'), 'real_sample') AS source, 'latin' AS script, json_extract_string(j, '$.print_type') AS print_type, event_id % 4 = 0 AS review,
    CAST(CASE WHEN json_type(j, '$.expected_items') = 'ARRAY' THEN json_array_length(j, '$.expected_items') END AS INT) AS n_items, json_extract_string(j, '$.k') AS k, len([x for x in json_keys(j) if x NOT IN ('image', 'print_type', 'source', 'expect_manual_review', 'expected', 'unknown', 'expected_items')]) AS n_extra, f AS field,
    CASE WHEN f = 'total_amount' AND event_id % 6 = 0 THEN 'unknown' WHEN NOT json_exists(j, concat('$.expected.', f)) THEN 'missing' WHEN json_type(j, concat('$.expected.', f)) = 'NULL' THEN 'null' ELSE 'value' END AS state, json_extract_string(j, concat('$.expected.', f)) AS value
  FROM d, (SELECT unnest(['total_amount', 'user', 'vendor_name']) AS f)""")
def src_truth_documents(spark, sf):
    """SRC-08, FLT-12: documents of known and unknown keys, whose fields are missing, null, unknown or there; props gives the unknown ones."""
    docs = table(spark, sf, "events").select("event_id", F.expr(_TRUTH).alias("document"))
    rows = truth.field_states(truth.parsed(docs), ("total_amount", "user", "vendor_name"))
    return rows.select("event_id", "image", "source", "script", "print_type", F.col("expect_manual_review").alias("review"), F.col("n_expected_items").alias("n_items"), F.col("extra")["k"].alias("k"), F.coalesce(F.size("extra"), F.lit(0)).cast("bigint").alias("n_extra"), "field", "state", "value")


#: Documents with up to three vendors and addresses, a net, a total and what their items came to; a third of the answers keep to the lists.
_STATE = """SELECT o_orderkey AS doc_id, o_custkey, list_slice(['Acme', concat('Shop ', CAST(o_custkey % 50 AS STRING)), 'Depot'], 1, CAST(o_orderkey % 4 AS INT)) AS vendors, list_slice(['1 Main Road', '2 High Street'], 1, CAST(o_orderkey % 3 AS INT)) AS addresses,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(round(o_totalprice * CASE WHEN o_orderkey % 7 = 0 THEN 120 ELSE 90 END) AS BIGINT) END AS net, CAST(round(o_totalprice * 100) AS BIGINT) AS total, o_orderkey % 2 AS n_items, CASE WHEN o_orderkey % 3 = 0 THEN CAST(round(o_totalprice * 90) AS BIGINT) END AS met, o_orderkey % 11 = 0 AS semantics FROM orders"""


@query(f"""WITH d AS ({_STATE}), q AS (SELECT *, CASE WHEN len(vendors) >= 2 THEN vendors ELSE [] END AS vs, CASE WHEN len(addresses) >= 2 THEN addresses ELSE [] END AS ads, net IS NOT NULL AND (coalesce(net > total + 5, false) OR (n_items > 0 AND NOT coalesce(met = net, false))) AS sub FROM d)
  SELECT doc_id, array_to_string(vs, ';') AS vendors, array_to_string(ads, ';') AS addresses, sub AS subtotal, semantics, CASE WHEN len(vs) > 0 AND o_custkey % 3 <> 1 THEN 'Acme' END AS vendor, CASE WHEN len(ads) > 0 AND o_custkey % 3 = 0 THEN '2 High Street' END AS address, CASE WHEN sub AND o_custkey % 2 = 0 THEN 12.5 END AS stated
  FROM q WHERE len(vs) > 0 OR len(ads) > 0 OR sub OR semantics""")
def udf_questions(spark, sf):
    """UDF-07: which documents have a question, what it offers, and which answers are honoured."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    cents = lambda f: (F.round(F.col("o_totalprice") * f).cast("bigint") / 100).cast("decimal(18,2)")
    docs = o.select(
        k.alias("doc_id"), F.slice(F.array(F.lit("Acme"), F.concat(F.lit("Shop "), (F.col("o_custkey") % 50).cast("string")), F.lit("Depot")), F.lit(1), (k % 4).cast("int")).alias("vendors"), F.slice(F.array(F.lit("1 Main Road"), F.lit("2 High Street")), F.lit(1), (k % 3).cast("int")).alias("addresses"),
        F.when(k % 5 != 0, F.when(k % 7 == 0, cents(120)).otherwise(cents(90))).alias("net"), cents(100).alias("total"), (k % 2).cast("int").alias("n_items"), F.when(k % 3 == 0, cents(90)).alias("met"), (k % 11 == 0).alias("semantics"), "o_custkey",
    )
    asked = asking.questions(docs)
    # an answer for each document's own key, so that the answers can be told apart
    asked = asked.withColumn("key", F.concat("key", F.lit("/"), F.col("doc_id").cast("string")))
    c = F.col("o_custkey")
    answers = asked.select("key", "doc_id").join(docs.select("doc_id", "o_custkey"), "doc_id").select("key", F.when(c % 3 != 1, " Acme ").otherwise("Nobody").alias("vendor"), F.when(c % 3 == 0, "2 High Street").alias("address"), F.when(c % 2 == 0, "12.5").otherwise("n/a").alias("subtotal"))
    got = asking.honoured(asked, answers).withColumnRenamed("subtotal", "stated")
    return asked.join(got, "doc_id", "left").select("doc_id", F.array_join("vendors", ";").alias("vendors"), F.array_join("addresses", ";").alias("addresses"), "subtotal", "semantics", "vendor", "address", "stated")


_NAME = "CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'DRD PEV-CUT EP025G' WHEN 1 THEN CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE concat('pen ', l_returnflag) END ELSE concat('Item ', CAST(l_partkey AS STRING)) END"
_ORD = "l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey"


@query(f"""WITH i AS (SELECT l_orderkey AS doc_id, {_ORD} AS ord, {_NAME} AS name FROM lineitem), v AS (SELECT *, name = 'DRD PEV-CUT EP025G' AS code FROM i WHERE name <> ''),
  g AS (SELECT doc_id FROM v GROUP BY 1 HAVING count(*) FILTER (NOT code) >= 3 AND count(*) FILTER (NOT code) >= 0.5 * count(*)), n AS (SELECT v.*, row_number() OVER (PARTITION BY v.doc_id ORDER BY ord) AS k FROM v JOIN g USING (doc_id) WHERE NOT code)
  SELECT i.doc_id, i.ord, CASE WHEN n.k IS NOT NULL AND i.doc_id % 3 <> 0 AND n.k % 2 = 1 THEN concat('Good ', i.name) ELSE i.name END AS name FROM i LEFT JOIN n ON i.doc_id = n.doc_id AND i.ord = n.ord""")
def nrm_renamed_items(spark, sf):
    """NRM-02: names go out in batches of a document; a third of the answers have a name too few and are refused whole, every second name comes back in capitals only."""
    items = table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", f"{_ORD} AS ord", f"{_NAME} AS name")
    batches = asking.name_batches(items)
    keyed = batches.withColumn("key", F.concat("key", F.lit("/"), F.col("doc_id").cast("string")))
    given = F.transform("names", lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("Good "), x)).otherwise(F.upper(x)))
    answers = keyed.select("key", F.when(F.col("doc_id") % 3 == 0, F.slice(given, 1, F.size(given) - 1)).otherwise(given).alias("names"))
    return asking.renamed(items, keyed, answers)
