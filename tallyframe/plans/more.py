"""Further queries of the receipt operators, each with the same query as DuckDB SQL, in its own words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, fuzzy, money
from ..functions.binding import held
from ..operators import category, choices, corrections, evaluation, geometry, itemlines, layout, locale, payloads, readings, reconcile, reports, verification
from ..sources import corpus
from ..sources.receipts import kind, rendered, rendered_sql
from ..streaming import jobs
from . import receipts as plan
from .queries import LOC, MONEY_SQL, _log
from .registry import query, table

R = rendered_sql()
_ORD = "l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey"


@query("""WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN concat(CAST(event_id % 40 AS STRING), '.5') WHEN 2 THEN 'abc' WHEN 3 THEN '-3' ELSE '' END AS raw FROM events)
  SELECT event_id, CAST(TRY_CAST(raw AS DOUBLE) * 10 AS BIGINT) AS number_x10, CAST(greatest(1, coalesce(round_even(TRY_CAST(raw AS DOUBLE), 0), 1)) AS INT) AS quantity, CASE WHEN TRY_CAST(raw AS DOUBLE) IS NOT NULL THEN CAST(round_even(10 * greatest(0.0, least(TRY_CAST(raw AS DOUBLE) / 20, 1.0)), 0) AS BIGINT) END AS unit_x10, format('{:,.2f}', event_id * 12.5) AS shown FROM x""")
def num_scalars(spark, sf):
    """NUM-03, NUM-04, NUM-05, NUM-08."""
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN concat(CAST(event_id % 40 AS STRING), '.5') WHEN 2 THEN 'abc' WHEN 3 THEN '-3' ELSE '' END")
    x = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    number = money.number_or_null(F.col("raw"))
    return x.select("event_id", F.round(number * 10).cast("bigint").alias("number_x10"), money.whole_quantity(F.col("raw")).alias("quantity"), F.when(number.isNotNull(), F.bround(10 * money.clamped(number / 20)).cast("bigint")).alias("unit_x10"), money.with_separators(F.col("event_id") * 12.5).alias("shown"))


@query(R + """, s AS (SELECT *, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM receipts)
  SELECT doc_id, contains(digits, CAST(printed_cents AS STRING)) AS total, contains(digits, CAST(printed_cents + 7 AS STRING)) OR ((printed_cents + 7) % 100 = 0 AND contains(digits, CAST(CAST(floor((printed_cents + 7) / 100) AS BIGINT) AS STRING))) AS other FROM s""")
def num_money_on_page(spark, sf):
    """NUM-09: the printed total, and one seven cents off."""
    amount = lambda c: (c / 100).cast("decimal(18,2)")
    digits = money.digits_only(F.col("text"))
    return rendered(spark, sf).select("doc_id", money.stands_in(amount(F.col("printed_cents")), digits).alias("total"), money.stands_in(amount(F.col("printed_cents") + 7), digits).alias("other"))


@query("SELECT c_custkey, trim(regexp_replace(lower(strip_accents(concat(c_name, '  Çà  É ', c_mktsegment))), '\\s+', ' ', 'g')) AS plain FROM customer")
def str_normalised(spark, sf):
    """STR-01."""
    return table(spark, sf, "customer").select("c_custkey", fuzzy.normalised_text(F.concat("c_name", F.lit("  Çà  É "), "c_mktsegment")).alias("plain"))


@query()
def str_likeness(spark, sf):
    """STR-14: likenesses of part names with others of their brand's words."""
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower(F.concat_ws(" ", "p_type", F.reverse(F.split("p_name", " ")).getItem(0))).alias("b"))
    return p.select("p_partkey", F.round(fuzzy.ratio_of("a", "b"), 4).alias("ratio"), F.round(fuzzy.token_set_of("a", "b"), 4).alias("token_set"), F.round(fuzzy.partial_of("a", "b"), 4).alias("partial"))


_ANSWERS = (
    '{"tax_basis":"inclusive","confidence":0.9,"evidence":["VAT inclusive"]}',
    'Sure: {"tax_basis":"exclusive","tax_basis_confidence":0.8,"tax_basis_evidence":"before tax","currency":"usd","currency_confidence":0.95,"currency_evidence":[" total amount due ",""]} ok',
    "[1, 2]", "not json", '{"tax_basis":"weird","confidence":"0.7","evidence":[]}', '{"tax_basis":"inclusive","confidence":0.5,"evidence":["VAT inclusive"]}',
)


@query(R + """ SELECT doc_id, CASE WHEN doc_id % 6 IN (2, 3) THEN NULL WHEN doc_id % 6 = 0 AND contains(lower(text), 'vat inclusive') THEN 'inclusive' WHEN doc_id % 6 = 1 AND contains(lower(text), 'before tax') THEN 'exclusive' ELSE 'unknown' END AS basis,
  CASE WHEN doc_id % 6 IN (2, 3) THEN NULL WHEN doc_id % 6 = 0 AND contains(lower(text), 'vat inclusive') THEN 90 WHEN doc_id % 6 = 1 AND contains(lower(text), 'before tax') THEN 80 WHEN doc_id % 6 = 4 THEN 70 ELSE 0 END AS sure_e2,
  CASE WHEN doc_id % 6 IN (2, 3) THEN NULL WHEN doc_id % 6 = 1 THEN 'USD' ELSE 'unknown' END AS currency, doc_id % 7 = 0 OR regexp_matches(lower(text), '\\b(vat|tax|gst|sst|inclusive|exclusive)\\b') AS asked FROM receipts""")
def sem_validated(spark, sf):
    """SEM-02, SEM-03, JSN-01, JSN-02: six answers of a model."""
    answer = F.element_at(F.array(*map(F.lit, _ANSWERS)), (F.col("doc_id") % 6 + 1).cast("int"))
    df = held(rendered(spark, sf), s=choices.validated_semantics(answer, F.col("text")))
    return df.select("doc_id", "s.tax_basis", F.round(F.col("s.confidence") * 100).cast("int").alias("sure_e2"), "s.currency", choices.semantics_asked(F.col("text"), F.col("doc_id") % 7 == 0).alias("asked")).withColumnRenamed("tax_basis", "basis")


@query(R + """ SELECT doc_id, NOT regexp_matches(lower(text), 'vat\\s*inclusive') AND doc_id % 13 <> 0 AND printed_cents = net_cents + tax_cents AS exclusive FROM receipts""")
def sem_printed_exclusive(spark, sf):
    """SEM-04: every 13th total is derived, every 17th does not add up."""
    amount = lambda c: (F.col(c) / 100).cast("decimal(18,2)")
    derived = F.when(F.col("doc_id") % 13 == 0, F.array(F.lit("total_amount"))).otherwise(F.array().cast("array<string>"))
    return rendered(spark, sf).select("doc_id", choices.printed_exclusive(F.col("text"), amount("net_cents"), amount("tax_cents"), F.lit(None).cast("decimal(18,2)"), amount("printed_cents"), derived).alias("exclusive"))


@query("""WITH q AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN ' ph ' WHEN 1 THEN 'USA' WHEN 2 THEN 'u1' WHEN 3 THEN 'SG' END AS country, CASE o_orderkey % 4 WHEN 0 THEN 'usd' WHEN 1 THEN 'XXX' WHEN 2 THEN ' Eur ' END AS currency, CASE o_orderkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' Kuala Lumpur, Malaysia ' END AS location FROM orders)
  SELECT doc_id, CASE WHEN regexp_full_match(upper(trim(country)), '[A-Z]{2}') THEN upper(trim(country)) END AS country, CASE WHEN upper(trim(currency)) IN ('USD', 'EUR') THEN upper(trim(currency)) END AS currency, nullif(trim(location), '') AS location FROM q""")
def con_request(spark, sf):
    """CON-01, JOI-12."""
    return _requests(spark, sf).select("doc_id", payloads.request(F.col("country"), F.col("currency"), F.col("location")).alias("r")).select("doc_id", "r.*")


def _requests(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS doc_id", "CASE o_orderkey % 5 WHEN 0 THEN ' ph ' WHEN 1 THEN 'USA' WHEN 2 THEN 'u1' WHEN 3 THEN 'SG' END AS country", "CASE o_orderkey % 4 WHEN 0 THEN 'usd' WHEN 1 THEN 'XXX' WHEN 2 THEN ' Eur ' END AS currency", "CASE o_orderkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' Kuala Lumpur, Malaysia ' END AS location")


@query(LOC + """, q AS (SELECT r.doc_id, l.country AS found, l.currency AS found_currency, l.score, CASE r.doc_id % 5 WHEN 0 THEN 'PH' WHEN 3 THEN 'SG' END AS country, CASE r.doc_id % 4 WHEN 0 THEN 'USD' END AS currency, CASE r.doc_id % 3 WHEN 1 THEN 'Kuala Lumpur, Malaysia' END AS location, CASE WHEN r.doc_id % 2 = 0 THEN 'THB' END AS model FROM receipts r JOIN loc l USING (doc_id))
  SELECT doc_id, coalesce(country, CASE WHEN location IS NOT NULL THEN 'MY' END, found) AS country, coalesce(currency, CASE coalesce(country, CASE WHEN location IS NOT NULL THEN 'MY' END, found) WHEN 'PH' THEN 'PHP' WHEN 'SG' THEN 'SGD' WHEN 'MY' THEN 'MYR' WHEN 'US' THEN 'USD' WHEN 'BN' THEN 'BND' END, found_currency, model) AS currency,
  CAST(round(10 * CASE WHEN country IS NOT NULL OR location IS NOT NULL THEN greatest(score, 3.0) ELSE score END) AS BIGINT) AS score_e1 FROM q""")
def loc_resolved(spark, sf):
    """LOC-03: callers who give a country, a currency, a place or nothing."""
    k = F.col("doc_id")
    df = rendered(spark, sf).select("doc_id", "text", locale.detect(F.col("text")).alias("found"))
    got = choices.resolve_locale(F.col("text"), F.col("found"), F.when(k % 5 == 0, "PH").when(k % 5 == 3, "SG"), F.when(k % 4 == 0, "USD"), F.when(k % 3 == 1, "Kuala Lumpur, Malaysia"), F.when(k % 2 == 0, "THB"))
    return df.select("doc_id", got.alias("g")).select("doc_id", "g.country", "g.currency", F.round(F.col("g.score") * 10).cast("bigint").alias("score_e1"))


@query("""WITH q AS (SELECT o_orderkey AS k, o_orderkey % 9 = 0 AS dup FROM orders)
  SELECT k AS doc_id, CASE WHEN k % 4 = 0 THEN NULL ELSE concat('Vendor ', CAST(k AS STRING)) END AS vendor, CASE k % 3 WHEN 0 THEN 'vat' WHEN 1 THEN 'non-vat' END AS vat, CASE WHEN k % 5 = 0 THEN 'PHP' WHEN k % 5 = 1 THEN 'EUR' END AS currency, CASE k % 4 WHEN 0 THEN 'Meals' WHEN 1 THEN 'Supplies' WHEN 2 THEN 'Others' END AS category,
   CASE WHEN dup THEN 'rejected' ELSE 'completed' END AS status, CASE WHEN k % 2 = 0 THEN 'inclusive' END AS basis, 15 + CASE WHEN k % 2 = 0 THEN 1 + CAST(k % 3 <> 0 AS INT) + 1 ELSE 0 END AS n_keys, 2 AS n_items, CASE WHEN k % 7 = 1 THEN 2 ELSE 3 END AS quantities FROM q""")
def con_callback(spark, sf):
    """CON-02, CON-03, CON-04, SNK-05, JSN-03, PRJ-01, STR-16, MAP-01, ARR-01: even documents have their semantics from a model."""
    k = F.col("o_orderkey")
    fields = F.map_from_arrays(
        F.array(*map(F.lit, ("vendor_name", "total_amount", "vat_classification", "currency", "expense_category", "tax_basis", "financial_reconciliation_status", "needs_manual_review"))),
        F.array(F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit(" Vendor "), k.cast("string"))), F.lit("12.50"), F.when(k % 3 == 0, "vat").when(k % 3 == 1, "non-vat").otherwise("exempt"), F.when(k % 5 == 0, " php").when(k % 5 == 1, "EUR").otherwise("ZAR"), F.when(k % 4 == 0, "meals").when(k % 4 == 1, "Office Supplies").when(k % 4 == 2, "Novel").otherwise(""), F.lit("inclusive"), F.when(k % 3 == 0, "odd").otherwise("reported"), F.lit("true")),
    )
    item = lambda n, q, p: F.struct(F.lit(n).alias("name"), q.alias("quantity"), p.alias("price"))
    items = F.array(item("a", F.lit("0.5"), F.lit("3.0")), item("", F.lit("2.4"), F.when(k % 7 == 1, "-1").otherwise("4")), item("b", F.lit("1"), F.when(k % 7 == 1, "5").otherwise("many")))
    df = table(spark, sf, "orders").select(k.alias("doc_id"), payloads.callback(fields, F.lit(1.4), k % 9 == 0, F.lit(0.91234567), k % 2 == 0).alias("p"), payloads.valid_items(items).alias("items"))
    p = lambda n, c: F.col("p")[n].alias(c)
    quantities = F.aggregate("items", F.lit(0), lambda a, x: a + x["quantity"])
    return df.select("doc_id", p("vendor_name", "vendor"), p("vat_classification", "vat"), p("currency", "currency"), p("expense_category", "category"), p("status", "status"), p("tax_basis", "basis"), F.size("p").alias("n_keys"), F.size("items").alias("n_items"), quantities.alias("quantities"))


_SCANS = f"WITH s AS (SELECT l_orderkey AS doc_id, {_ORD} AS reading, l_partkey % 7 = 0 AS reconciled, l_suppkey % 4 AS labels, l_partkey % 2 = 0 AS has_total, (l_partkey % 40) / 4.0 AS anchor, l_suppkey % 9 = 0 AS failed, CASE WHEN l_partkey % 2 = 0 THEN 1.5 END AS total FROM lineitem)"


def _scans(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", f"{_ORD} AS reading", "l_partkey % 7 = 0 AS reconciled", "l_suppkey % 4 AS labels", "l_partkey % 2 = 0 AS has_total", "(l_partkey % 40) / 4.0D AS anchor", "l_suppkey % 9 = 0 AS failed", "CASE WHEN l_partkey % 2 = 0 THEN 1.5D END AS total")


@query(_SCANS + " SELECT doc_id, CAST(arg_max(reading, (CAST(reconciled AS INT), labels, CAST(has_total AS INT), -reading)) AS BIGINT) AS reading FROM s GROUP BY 1")
def win_best_layout(spark, sf):
    """WIN-08."""
    return choices.best_layout(_scans(spark, sf)).select("doc_id", "reading")


@query(_SCANS + " SELECT doc_id, CAST(arg_max(reading, (CAST(reconciled AS INT), CAST(has_total AS INT), anchor, -reading)) AS BIGINT) AS page FROM s WHERE NOT failed GROUP BY 1")
def win_best_page(spark, sf):
    """WIN-10, OCR-05's choice."""
    return choices.best_page(_scans(spark, sf).withColumnRenamed("reading", "page")).select("doc_id", "page")


@query(_SCANS + " SELECT doc_id, CAST(reading AS BIGINT) AS page, CASE WHEN anchor >= 6.0 AND reconciled AND total IS NOT NULL THEN 'fast' ELSE 'pooled' END AS path FROM s")
def flt_fast_path(spark, sf):
    """FLT-08, FLT-09, OCR-05's escalation."""
    return choices.read_further(_scans(spark, sf).withColumnRenamed("reading", "page")).select("doc_id", "page", "path")


_W = "l_orderkey AS doc_id, 0 AS page, CAST(l_linenumber % 2 AS INT) AS block, 0 AS par, CAST(l_linenumber AS INT) AS line, {o} AS word_id, CASE WHEN l_partkey % 11 = 0 THEN ' ' ELSE concat('w', CAST(l_partkey % 50 AS STRING)) END AS text, CAST(l_suppkey % 120 - 10 AS DOUBLE) AS confidence, CAST(l_partkey % 400 AS INT) AS {l}, CAST(l_suppkey % 40 AS INT) AS top, 30 AS width, 12 AS height".replace("{o}", _ORD)
WORDS_SQL = "WITH w AS (SELECT " + _W.replace("{l}", '"left"') + " FROM lineitem)"


def _words(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*(x.strip() for x in _split_columns(_W.replace("{l}", "`left`"))))


def _split_columns(text: str) -> list[str]:
    """A select list at its top-level commas."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


@query(WORDS_SQL + """, n AS (SELECT *, greatest(confidence, 0) / 100 AS c FROM w WHERE trim(text) <> ''), l AS (SELECT doc_id, block, par, line, string_agg(text, ' ' ORDER BY "left", word_id) AS text, avg(c) AS c, arg_min(top, ("left", word_id)) AS top, min("left") AS x FROM n GROUP BY 1, 2, 3, 4)
  SELECT doc_id, text, CAST(round(c * 10000) AS BIGINT) AS conf_e4, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY top, x, block, par, line) - 1 AS INT) AS line_no FROM l""")
def agg_lines_of_words(spark, sf):
    """AGG-01, PRJ-04, SRC-05."""
    df = layout.lines_of_words(geometry.normalised_words(_words(spark, sf)))
    return df.select("doc_id", "text", F.round(F.col("confidence") * 10000).cast("bigint").alias("conf_e4"), "line_no")


@query(WORDS_SQL + " SELECT doc_id, CAST((200 * coalesce(sum(CAST(confidence AS BIGINT)) FILTER (confidence >= 0), 0) + greatest(1, count(*) FILTER (confidence >= 0))) // (2 * greatest(1, count(*) FILTER (confidence >= 0))) AS BIGINT) AS conf_e4 FROM w GROUP BY 1")
def agg_mean_confidence(spark, sf):
    """AGG-02."""
    return geometry.mean_confidence(_words(spark, sf), "doc_id").select("doc_id", F.round(F.col("confidence") * 10000).cast("bigint").alias("conf_e4"))


@query(WORDS_SQL + """ SELECT word_id, doc_id, "left" + width AS "right", top + height AS bottom, CAST((top + height / 2.0) * 2 AS INT) AS center_x2, concat(CAST(block AS STRING), '-', CAST(par AS STRING), '-', CAST(line AS STRING)) AS line_key, concat('engine/v', CAST(line % 3 AS STRING), '/psm', CAST(line AS STRING)) AS label FROM w""")
def prj_places(spark, sf):
    """PRJ-05, PRJ-06."""
    df = geometry.placed(_words(spark, sf))
    key = F.concat_ws("-", F.col("line_key.block").cast("string"), F.col("line_key.par").cast("string"), F.col("line_key.line").cast("string"))
    return df.select("word_id", "doc_id", "right", "bottom", (F.col("center_y") * 2).cast("int").alias("center_x2"), key.alias("line_key"), geometry.label(F.lit("engine"), F.concat(F.lit("v"), (F.col("line") % 3).cast("string")), F.col("line")).alias("label"))


@query("""WITH l AS (SELECT p_partkey AS doc_id, trim(p_name) AS t, CAST(p_partkey % 90 AS INT) AS x, CAST(p_partkey % 90 + 60 + p_partkey % 300 AS INT) AS r FROM part),
  w AS (SELECT doc_id, t, x, r, unnest(string_split(t, ' ')) AS word, generate_subscripts(string_split(t, ' '), 1) - 1 AS i FROM l), s AS (SELECT *, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS pos FROM w)
  SELECT doc_id, CAST(i AS INT) AS word_id, word AS text, CAST(x + round_even((r - x) * pos / CAST(length(t) AS DOUBLE), 0) AS INT) AS "left", CAST(greatest(1, round_even((r - x) * (pos + length(word)) / CAST(length(t) AS DOUBLE), 0) - round_even((r - x) * pos / CAST(length(t) AS DOUBLE), 0)) AS INT) AS width FROM s""")
def src_spread_words(spark, sf):
    """SRC-07: a part's name as a line, with the polygon it was found in."""
    p = table(spark, sf, "part")
    x, y = (F.col("p_partkey") % 90).cast("double"), (F.col("p_partkey") % 90 + 60 + F.col("p_partkey") % 300).cast("double")
    corner = lambda a, b: F.array(a, F.lit(float(b)))
    lines = p.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("line"), F.col("p_name").alias("text"), F.lit(0.9).alias("confidence"), geometry.bounds(F.array(corner(y, 3), corner(x, 5), corner(x, 17), corner(y, 15))).alias("b")).select("*", "b.*")
    return geometry.spread_words(lines).select("doc_id", "word_id", "text", "left", "width")


_FIELDS = ("total_amount", "net_sales", "transaction_date", "vendor_name", "vendor_tax_id", "invoice_number", "country", "expense_category")


@query(R + """, f AS (SELECT doc_id, text, confidence, doc_id % 17 <> 0 AS ok, true_country <> 'XX' AS located, doc_id % 19 = 0 AS ambiguous, regexp_replace(text, '[^0-9]', '', 'g') AS digits, CASE WHEN doc_id % 17 = 0 THEN true_total_cents ELSE printed_cents END AS total_c, net_cents AS net_c, CASE WHEN doc_id % 8 = 0 THEN 'Zq' ELSE vendor_line END AS vendor, CASE WHEN doc_id % 6 = 0 THEN '999-999-999-999' WHEN true_country = 'PH' THEN concat('123 456 789-00', lpad(CAST(doc_id % 1000 AS STRING), 3, '0')) END AS tin, CASE WHEN doc_id % 2 = 0 THEN lpad(CAST(doc_id % 1000000 AS STRING), 6, '0') ELSE 'OFFICIAL  receipt' END AS number FROM receipts),
  g AS (SELECT *, contains(digits, CAST(total_c AS STRING)) OR (total_c % 100 = 0 AND contains(digits, CAST(CAST(floor(total_c / 100) AS BIGINT) AS STRING))) AS total_ok, vendor <> 'Zq' AS vendor_ok, tin IS NULL OR contains(digits, regexp_replace(tin, '[^0-9]', '', 'g')) AS tin_ok, contains(lower(text), lower(regexp_replace(number, '\\s+', ' ', 'g'))) AS number_ok FROM f),
  h AS (SELECT *, NOT ok AND NOT total_ok AS dropped FROM g)
  SELECT doc_id, CASE WHEN total_ok AND NOT dropped THEN CAST(total_c AS STRING) END AS total, CASE WHEN NOT dropped THEN CAST(net_c AS STRING) END AS net, CASE WHEN vendor_ok THEN vendor END AS vendor, CASE WHEN tin_ok THEN tin END AS tin, CASE WHEN number_ok THEN number END AS number,
    CAST(CASE WHEN doc_id % 3 = 0 THEN 'Meals' ELSE 'Others' END AS STRING) AS category, CAST(3 + CAST(total_ok AS INT) + CAST(NOT dropped AS INT) + CAST(vendor_ok AS INT) + CAST(tin IS NOT NULL AND tin_ok AS INT) + CAST(number_ok AS INT) AS BIGINT) AS populated,
    array_to_string([x for x in [CASE WHEN dropped OR NOT (total_ok AND vendor_ok AND tin_ok AND number_ok) THEN 'ungrounded_values_rejected' END, CASE WHEN NOT total_ok THEN 'total_amount_missing' END, CASE WHEN NOT ok THEN 'reconciliation_failed' END, CASE WHEN NOT located THEN 'locale_unresolved' END, CASE WHEN ambiguous THEN 'tax_id_ambiguous' END,
      CASE WHEN (confidence <> 0 AND confidence < 0.45) OR len(regexp_extract_all(text, '[A-Za-z]{2,}')) / CAST(len(regexp_extract_all(text, '\\S+')) AS DOUBLE) < 0.55 THEN 'handwriting_or_illegible' END] if x IS NOT NULL], ';') AS reasons FROM h""")
def ver_verified(spark, sf):
    """VER-01, VER-02, VER-03, VER-04, AGG-09, EVL-03: eight fields, some of them not on the page."""
    k = F.col("doc_id")
    amount = lambda c: (c / 100).cast("decimal(18,2)").cast("string")
    df = rendered(spark, sf)
    values = {
        "total_amount": amount(F.when(k % 17 == 0, F.col("true_total_cents")).otherwise(F.col("printed_cents"))), "net_sales": amount(F.col("net_cents")), "transaction_date": F.col("d").cast("string"), "vendor_name": F.when(k % 8 == 0, "Zq").otherwise(F.col("vendor_line")),
        "vendor_tax_id": F.when(k % 6 == 0, "999-999-999-999").when(F.col("true_country") == "PH", F.concat(F.lit("123 456 789-00"), F.lpad((k % 1000).cast("string"), 3, "0"))), "invoice_number": F.when(k % 2 == 0, F.lpad((k % 1000000).cast("string"), 6, "0")).otherwise("OFFICIAL  receipt"),
        "country": F.lit("ZZ"), "expense_category": F.when(k % 3 == 0, "meals").otherwise("Novel"),
    }
    listed = F.array(*(F.struct(F.lit(n).alias("field"), v.alias("value"), F.lit(False).alias("derived")) for n, v in values.items()))
    out = verification.verified(df.select("doc_id", "text", (k % 17 != 0).alias("reconciled"), (F.col("true_country") != "XX").alias("located"), "confidence", (k % 19 == 0).alias("ambiguous"), listed.alias("values")))
    cents = lambda n: F.regexp_replace(F.col("fields")[n], r"\.", "").cast("bigint").cast("string")
    f = lambda n, c: F.col("fields")[n].alias(c)
    return out.select("doc_id", cents("total_amount").alias("total"), cents("net_sales").alias("net"), f("vendor_name", "vendor"), f("vendor_tax_id", "tin"), f("invoice_number", "number"), f("expense_category", "category"), F.col("populated").cast("bigint").alias("populated"), F.array_join("reasons", ";").alias("reasons"))


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN concat('role=vendor line=', CAST(o_orderkey % 9 AS STRING)) END AS tax_id, CASE WHEN o_orderkey % 2 = 0 THEN concat('''5/24/1998'' score=', format('{:.2f}', (o_orderkey % 50) / 4.0)) END AS date, CASE WHEN o_orderkey % 4 = 0 THEN 'No. 123' END AS number, concat('deterministic from [A, B, C]') AS vendor, 2 + CAST(o_orderkey % 3 = 0 AS INT) + CAST(o_orderkey % 2 = 0 AS INT) + CAST(o_orderkey % 4 = 0 AS INT) AS n FROM orders""")
def prj_evidence(spark, sf):
    """PRJ-02."""
    k = F.col("o_orderkey")
    df = table(spark, sf, "orders").select(k.alias("doc_id"), F.when(k % 3 == 0, "vendor").alias("tax_id_role"), (k % 9).cast("int").alias("tax_id_line"), F.when(k % 2 == 0, "5/24/1998").alias("date_raw"), ((k % 50) / 4.0).alias("date_score"), F.when(k % 4 == 0, "No. 123").alias("number_line"), F.lit(None).cast("string").alias("address"), F.lit("deterministic").alias("vendor_method"), F.array(*map(F.lit, "ABCD")).alias("shortlist"), F.lit("lexicon").alias("category_method"))
    e = lambda n, c: F.col("evidence")[n].alias(c)
    return payloads.evidence(df).select("doc_id", e("vendor_tax_id", "tax_id"), e("transaction_date", "date"), e("invoice_number", "number"), e("vendor_name", "vendor"), F.size("evidence").alias("n"))


@query(f"""WITH r AS (SELECT l_orderkey AS doc_id, {_ORD} AS reading_id, concat('text ', l_partkey % 3) AS text, (l_partkey % 40) / 4.0 AS anchor, (l_suppkey % 100) / 100.0 AS confidence, concat('v', l_linenumber % 3) AS variant, l_linenumber AS psm FROM lineitem),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY anchor DESC, confidence DESC, length(text) DESC, reading_id) AS rank FROM r)
  SELECT doc_id, max(concat('e/', variant, '/psm', CAST(psm AS STRING))) FILTER (rank = 1) AS label, CAST(round(100 * coalesce(max(anchor) FILTER (rank = 1) - max(anchor) FILTER (rank = 2), 0)) AS BIGINT) AS margin_e2, string_agg(concat('e/', variant, '/psm', CAST(psm AS STRING)), ';' ORDER BY rank) FILTER (rank <= 5) AS top, count(*) AS candidates FROM k GROUP BY 1""")
def prj_selection(spark, sf):
    """PRJ-03, SRT-05, WIN-03."""
    li = table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", f"{_ORD} AS reading_id", "concat('text ', CAST(l_partkey % 3 AS STRING)) AS text", "(l_partkey % 40) / 4.0D AS anchor", "(l_suppkey % 100) / 100.0D AS confidence", "concat('v', CAST(l_linenumber % 3 AS STRING)) AS variant", "'e' AS engine", "l_linenumber AS psm")
    out = payloads.selection(readings.ranked(li))
    return out.select("doc_id", "label", F.round(F.col("margin") * 100).cast("bigint").alias("margin_e2"), F.array_join(F.col("top").getField("label"), ";").alias("top"), "candidates")


@query("""WITH t AS (SELECT o_orderkey AS doc_id, unnest(['total_amount', 'tax_rate', 'vendor_name', 'currency']) AS field, unnest([CAST(o_custkey AS STRING), '0.12', CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'x' END, 'PHP']) AS value FROM orders)
  SELECT doc_id, field, value FROM t WHERE field <> 'tax_rate' AND NOT (doc_id % 5 = 0 AND field = 'total_amount')""")
def flt_scored_fields(spark, sf):
    """FLT-12, SET-04: a key with a null is scored, a key in the unknown set is not."""
    k = F.col("o_orderkey")
    expected = F.map_from_arrays(F.array(*map(F.lit, ("total_amount", "tax_rate", "vendor_name", "currency"))), F.array(F.col("o_custkey").cast("string"), F.lit("0.12"), F.when(k % 3 != 0, "x"), F.lit("PHP")))
    unknown = F.array_union(F.array(F.lit("tax_rate")), F.when(k % 5 == 0, F.array(F.lit("total_amount"))).otherwise(F.array().cast("array<string>")))
    return reports.scored_fields(table(spark, sf, "orders").select(k.alias("doc_id"), expected.alias("expected"), unknown.alias("unknown")))


@query("""WITH d AS (SELECT l_orderkey AS doc_id, count(*) AS expected, count(*) FILTER (l_partkey % 5 <> 0) AS produced, l_orderkey % 3 = 0 AS reconciled FROM lineitem GROUP BY 1), m AS (SELECT l_suppkey % 4 <> 0 AS q, l_suppkey % 6 <> 0 AS p, l_partkey % 10 = 1 AS bad, l_partkey % 3 <> 0 AS alike FROM lineitem WHERE l_partkey % 5 <> 0)
  SELECT receipts, expected_rows, row_count_exact, reconciled_receipts, suppressed_receipts, matched_rows, quantity_correct, price_correct, name_unreadable, name_correct, CAST(round(10000.0 * matched_rows / expected_rows) AS BIGINT) AS recall_e4, CAST(round(10000.0 * name_correct / matched_rows) AS BIGINT) AS name_e4 FROM
  (SELECT count(*) AS receipts, CAST(sum(expected) AS BIGINT) AS expected_rows, count(*) FILTER (expected = produced) AS row_count_exact, count(*) FILTER (reconciled) AS reconciled_receipts, count(*) FILTER (produced = 0) AS suppressed_receipts FROM d),
  (SELECT count(*) AS matched_rows, count(*) FILTER (q) AS quantity_correct, count(*) FILTER (p) AS price_correct, count(*) FILTER (bad) AS name_unreadable, count(*) FILTER (NOT bad AND alike) AS name_correct FROM m)""")
def agg_item_tallies(spark, sf):
    """AGG-12."""
    li = table(spark, sf, "lineitem")
    docs = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("expected"), F.count_if(F.col("l_partkey") % 5 != 0).alias("produced")).withColumn("reconciled", F.col("doc_id") % 3 == 0)
    matched = li.where("l_partkey % 5 <> 0").select((F.col("l_suppkey") % 4 != 0).alias("quantity_ok"), (F.col("l_suppkey") % 6 != 0).alias("price_ok"), F.when(F.col("l_partkey") % 10 == 1, reports.UNREADABLE).otherwise("name").alias("name"), (F.col("l_partkey") % 3 != 0).alias("alike"))
    t = reports.item_tallies(docs, matched)
    counts = ("receipts", "expected_rows", "row_count_exact", "reconciled_receipts", "suppressed_receipts", "matched_rows", "quantity_correct", "price_correct", "name_unreadable", "name_correct")
    return t.select(*counts, F.round(F.col("recall") * 10000).cast("bigint").alias("recall_e4"), F.round(F.col("name_accuracy") * 10000).cast("bigint").alias("name_e4"))


_PRESENT = "WITH p AS (SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 4 = 0 THEN 'handwritten_form' ELSE 'machine_printed' END AS print_type, concat('f', CAST(l_linenumber AS STRING)) AS field, concat('v', CAST(l_suppkey % 3 AS STRING)) AS variant, l_partkey % 3 <> 0 AS present FROM lineitem)"


def _present(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", "CASE WHEN l_orderkey % 4 = 0 THEN 'handwritten_form' ELSE 'machine_printed' END AS print_type", "concat('f', CAST(l_linenumber AS STRING)) AS field", "concat('v', CAST(l_suppkey % 3 AS STRING)) AS variant", "l_partkey % 3 <> 0 AS present")


@query(_PRESENT + " SELECT print_type, doc_id, count(*) FILTER (present) AS recoverable, count(*) AS total FROM p GROUP BY ROLLUP (print_type, doc_id)")
def agg_recoverability(spark, sf):
    """AGG-14."""
    return reports.recoverability(_present(spark, sf))


@query(_PRESENT + " SELECT doc_id, count(*) FILTER (present AND variant = 'v0') AS v0, count(*) FILTER (present AND variant = 'v1') AS v1, count(*) FILTER (present AND variant = 'v2') AS v2, CAST(count(DISTINCT field) FILTER (present) AS INT) AS best_of FROM p GROUP BY 1")
def agg_variant_sweep(spark, sf):
    """AGG-15, SET-05."""
    return reports.variant_sweep(_present(spark, sf), ["v0", "v1", "v2"])


@query("""WITH t AS (SELECT unnest(['vendor_name', 'vendor_tax_id', 'transaction_date', 'total_amount', 'expense_category']) AS field, unnest([90, 95, 94, 100, 10]) AS pass), n AS (SELECT t.field, count(*) AS scored, count(*) FILTER (o_orderkey % 100 < pass) AS passed FROM orders, t GROUP BY 1),
  g AS (SELECT unnest(['vendor_name', 'country', 'currency', 'vendor_tax_id', 'vendor_tax_id_type', 'transaction_date', 'net_sales', 'tax_amount', 'tax_type', 'tax_rate', 'total_sales', 'service_charge', 'total_amount', 'vat_classification', 'invoice_number', 'expense_category']) AS field, unnest(['standard', 'standard', 'standard', 'critical', 'standard', 'critical', 'standard', 'standard', 'standard', 'untracked', 'standard', 'standard', 'critical', 'standard', 'standard', 'untracked']) AS gate)
  SELECT g.field, gate, scored, passed, CASE gate WHEN 'critical' THEN passed / CAST(scored AS DOUBLE) >= 0.95 WHEN 'standard' THEN passed / CAST(scored AS DOUBLE) >= 0.90 END AS met FROM g LEFT JOIN n ON g.field = n.field""")
def evl_gates(spark, sf):
    """EVL-04, EVL-05: five fields that pass in so many of a hundred documents."""
    rates = spark.createDataFrame([("vendor_name", 90), ("vendor_tax_id", 95), ("transaction_date", 94), ("total_amount", 100), ("expense_category", 10)], "field string, pass int")
    rows = table(spark, sf, "orders").select("o_orderkey").join(F.broadcast(rates))  # five rows
    tallies = rows.groupBy("field").agg(F.count("*").alias("scored"), F.count_if(F.col("o_orderkey") % 100 < F.col("pass")).alias("passed"))
    return reports.gated(tallies, reports.specs(spark).drop("transcribed"))


@query("SELECT o_orderkey AS doc_id, CAST(round(10000 * (0.30 * greatest(0.0, least((o_orderkey % 130) / 100.0, 1.0)) + CASE WHEN o_orderkey % 3 = 0 THEN 0.35 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 0.25 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 0.10 ELSE 0 END)) AS BIGINT) AS score_e4 FROM orders")
def cnf_composite(spark, sf):
    """CNF-02."""
    k = F.col("o_orderkey")
    s = reports.composite((k % 130) / 100.0, F.when(k % 3 == 0, 1.0), F.when(k % 5 == 0, "PH"), k % 2 == 0)
    return table(spark, sf, "orders").select(k.alias("doc_id"), F.round(s * 10000).cast("bigint").alias("score_e4"))


@query("SELECT c_name AS name FROM customer WHERE c_custkey % 7 <> 0 AND c_mktsegment = 'BUILDING' ORDER BY c_name LIMIT 25")
def flt_fixtures(spark, sf):
    """FLT-10: a corpus, the first 25 by name, without the absent ones."""
    f = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("corpus"), F.col("c_name").alias("name"), (F.col("c_custkey") % 7 != 0).alias("exists"))
    return reports.chosen(f, "BUILDING", most=25).select("name")


_DRAW = "(CAST(concat('0x', substr(md5(concat('1:', CAST(i AS STRING), ':{w}')), 1, 7)) AS BIGINT) % {n})"
SPEC_SQL = (
    "WITH n AS (SELECT CAST(i AS BIGINT) AS i, i < 3000 AS sound, CASE WHEN i < 3000 THEN i / 3000.0 ELSE (i - 3000) / 500.0 END AS place FROM range(0, 3500) t(i)), a AS (SELECT i, NOT sound AS corrupt, CASE WHEN sound THEN ['ph_vat_or', 'ph_vat_pos', 'ph_nonvat_si', 'us_pos', 'my_pos'][" + _DRAW.format(w="template", n=5)
    + " + 1] ELSE 'ph_vat_or' END AS template, CASE WHEN place < 0.4 THEN 'clean' WHEN place < 0.8 THEN 'moderate' ELSE 'severe' END AS tier, DATE '1999-01-01' - CAST(" + _DRAW.format(w="date", n=900) + " + 1 AS INT) AS date, " + _DRAW.format(w="items", n=4) + " + 1 AS n_items, " + " + ".join(f"CASE WHEN {j} <= {_DRAW.format(w='items', n=4)} THEN ({_DRAW.format(w=f'quantity{j}', n=3)} + 1) * ({_DRAW.format(w=f'price{j}', n=60000)} + 500) ELSE 0 END" for j in range(4)) + " AS gross, [625, 725, 800, 875][" + _DRAW.format(w="rate", n=4) + " + 1] AS rate, "
    + _DRAW.format(w="service", n=100) + " AS sv FROM n), b AS (SELECT *, CASE WHEN template IN ('ph_vat_or', 'ph_vat_pos') THEN (gross * 100 + 56) // 112 ELSE gross END AS net FROM a), c AS (SELECT *, CASE WHEN template = 'ph_nonvat_si' THEN NULL WHEN starts_with(template, 'ph_') THEN gross - net WHEN template = 'us_pos' THEN CAST(floor((net * rate + 5000) / 10000) AS BIGINT) ELSE CAST(floor((net * 6 + 50) / 100) AS BIGINT) END AS tax FROM b),"
    " d AS (SELECT *, CASE WHEN starts_with(template, 'ph_') THEN gross ELSE net + tax END AS sales, CASE WHEN template = 'ph_vat_or' AND sv < 45 THEN CAST(floor((net + 5) / 10) AS BIGINT) END AS service FROM c)"
)


@query(SPEC_SQL + " SELECT i AS index, template, tier, CAST(date AS STRING) AS date, net AS net_c, tax AS tax_c, sales AS sales_c, service AS service_c, sales + coalesce(service, 0) AS total_c, CASE WHEN corrupt THEN CAST(floor((tax * 175 + 30000 + 50) / 100) AS BIGINT) ELSE tax END AS printed_c FROM d")
def syn_specs(spark, sf):
    """SYN-01, SYN-02: 3000 sound receipts and 500 corrupted ones."""
    c = lambda a, b: F.round(F.col(a) * 100).cast("bigint").alias(b)
    return corpus.corpus(spark, 3000, 500).select("index", "template", "tier", F.col("date").cast("string").alias("date"), c("net_sales", "net_c"), c("tax_amount", "tax_c"), c("total_sales", "sales_c"), c("service_charge", "service_c"), c("total_amount", "total_c"), c("printed_tax", "printed_c"))


@query(SPEC_SQL + " SELECT template, tier, count(*) AS n, count(*) FILTER (corrupt) AS corrupted FROM d GROUP BY 1, 2")
def agg_corpus(spark, sf):
    """AGG-20."""
    return corpus.corpus(spark, 3000, 500).groupBy("template", "tier").agg(F.count("*").alias("n"), F.count_if("corrupt").alias("corrupted"))


@query(SPEC_SQL + """ SELECT i AS index, CAST(n_items AS INT) AS n_items, concat('syn-', lpad(CAST(i AS STRING), 4, '0'), '-', template, '-', tier, '.jpg') AS image, corrupt AS review, CASE WHEN corrupt THEN 6 ELSE 1 END AS n_unknown, CASE WHEN tax IS NULL THEN NULL ELSE concat(CAST(CAST(floor(tax / 100) AS BIGINT) AS STRING), '.', lpad(CAST(tax % 100 AS STRING), 2, '0')) END AS tax, template, tier FROM d""")
def syn_truth(spark, sf):
    """SYN-03, SNK-06: the documents, read back from their JSON."""
    docs = corpus.truth(corpus.corpus(spark, 3000, 500)).withColumn("v", F.parse_json("document"))
    get = lambda p, t, n: F.try_variant_get("v", p, t).alias(n)
    return docs.select("index", "image", F.size(F.try_variant_get("v", "$.expected_items", "array<variant>")).alias("n_items"), get("$.expect_manual_review", "boolean", "review"), F.size(F.try_variant_get("v", "$.unknown", "array<string>")).alias("n_unknown"), get("$.expected.tax_amount", "string", "tax"), get("$.template", "string", "template"), get("$.degradation", "string", "tier"))


@query("""WITH w AS (SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part)), ph AS (SELECT p_partkey AS doc_id, unnest(string_split(t, ' ')) AS word, generate_subscripts(string_split(t, ' '), 1) AS n FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_type, 'A', 'O') WHEN 1 THEN concat(replace(p_type, 'E', ''), ',') WHEN 2 THEN lower(replace(p_type, 'N', 'M')) ELSE p_type END AS t FROM part)),
  c AS (SELECT *, lower(regexp_replace(word, '[^\\w\\s]', '', 'g')) AS clean FROM ph), k AS (SELECT DISTINCT clean FROM c WHERE length(clean) >= 3 AND clean NOT IN (SELECT term FROM w)),
  near AS (SELECT clean, min_by(term, (levenshtein(clean, term), term)) AS term FROM k, w WHERE levenshtein(clean, term) <= CASE WHEN length(clean) >= 5 THEN 2 ELSE 1 END GROUP BY 1),
  o AS (SELECT c.*, near.term, CASE WHEN near.term IS NOT NULL AND NOT (doc_id % 6 = 0 AND n = 1) THEN concat(left(word, position(c.clean IN lower(word)) - 1), CASE WHEN upper(word) = word THEN upper(near.term) ELSE near.term END, substr(word, position(c.clean IN lower(word)) + length(c.clean))) ELSE word END AS out FROM c LEFT JOIN near ON c.clean = near.clean)
  SELECT doc_id, string_agg(out, ' ' ORDER BY n) AS corrected FROM o GROUP BY 1""")
def nrm_corrected(spark, sf):
    """STR-17, JOI-05, JOI-11, SET-03, NRM-01: misspelt part types against the words of part types; the first words of every sixth were read too surely to be touched."""
    p = table(spark, sf, "part")
    terms = corrections.vocabulary(p.select(F.explode(F.split("p_type", " ")).alias("word")))
    phrase = F.expr("CASE p_partkey % 4 WHEN 0 THEN replace(p_type, 'A', 'O') WHEN 1 THEN concat(replace(p_type, 'E', ''), ',') WHEN 2 THEN lower(replace(p_type, 'N', 'M')) ELSE p_type END")
    phrases = p.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("ord"), phrase.alias("phrase"))
    read = phrases.where("doc_id % 6 = 0").select("doc_id", F.split("phrase", " ").getItem(0).alias("text"), F.lit(0.95).alias("confidence"))
    return corrections.corrected(phrases, read, terms).select("doc_id", "corrected")


@query("SELECT event_id, coalesce(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) >= ts - INTERVAL 90 DAY, false) AS is_repeat FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id) AS nth FROM events) WHERE nth = 1")
def stm_lookback(spark, sf):
    """STM-04, DAT-06: whether a user had an event of the same kind in the 90 days before; events of one instant count once."""
    e = table(spark, sf, "events").groupBy("user_id", "event_type", "ts").agg(F.min("event_id").alias("event_id"))
    return jobs.seen_within(e, ["user_id", "event_type"], "ts", 90).select("event_id", "is_repeat")


@query("SELECT vec_id AS receipt_id, label AS source_service FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 5 <> 0")
def snk_stored_vectors(spark, sf):
    """SNK-03: blank texts and failed embeddings stay out."""
    v = F.col("vec_id")
    rows = table(spark, sf, "embeddings").select(v.alias("receipt_id"), F.col("label").alias("source_service"), F.when(v % 3 == 0, "  ").otherwise("text").alias("receipt_text"), F.when(v % 5 != 0, F.col("embedding")).alias("embedding"))
    return jobs.stored_vectors(rows).select("receipt_id", "source_service")


@query("SELECT o_orderkey AS job_id, 'queued' AS status, CAST(0 AS BIGINT) AS seq, CAST(epoch(TIMESTAMP '1999-01-01 00:00:00') AS BIGINT) AS at FROM orders")
def snk_inserted_jobs(spark, sf):
    """SNK-01, STM-01: requests as first entries of the log."""
    return jobs.inserted(table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id")), "1999-01-01").select("job_id", "status", "seq", F.unix_timestamp("updated_at").alias("at"))


@query("WITH g AS (SELECT event_id // 4 AS job_id, event_id % 4 AS seq, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, ts + to_seconds(CAST(event_id % 4 AS INT)) AS updated_at FROM events) SELECT job_id, max_by(status, (updated_at, seq)) AS status FROM g WHERE job_id = 7 GROUP BY 1")
def src_job_by_id(spark, sf):
    """SRC-09, STM-03: one job's latest entry."""
    return jobs.entry(_log(spark, sf), 7).select("job_id", "status")


@query("WITH g AS (SELECT event_id // 4 AS job_id, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, event_id % 4 AS seq, ts + to_seconds(CAST(event_id % 4 AS INT)) AS updated_at FROM events), l AS (SELECT job_id, max_by(status, (updated_at, seq)) AS status, max(updated_at) AS u FROM g GROUP BY 1) SELECT count(*) AS jobs, count(*) FILTER (u >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS last_day, count(*) FILTER (status = 'queued') AS queue_depth, CAST(round(10000.0 * count(*) FILTER (status = 'completed') / count(*) FILTER (status IN ('completed', 'failed'))) AS BIGINT) AS success_e4 FROM l")
def agg_job_metrics(spark, sf):
    """AGG-21: a day back from the last event."""
    now = table(spark, sf, "events").agg(F.max("ts").cast("string")).first()[0]
    return jobs.metrics(jobs.latest(_log(spark, sf)), now).select("jobs", "last_day", "queue_depth", F.round(F.col("success_rate") * 10000).cast("bigint").alias("success_e4"))


@query(f"""WITH r AS (SELECT l_orderkey AS doc_id, concat('text ', l_partkey % 3) AS text FROM lineitem), t AS (SELECT DISTINCT l_orderkey AS doc_id, concat('t ', l_suppkey % 4) AS token FROM lineitem)
  SELECT t.doc_id, t.token, count(*) FILTER (contains(r.text, t.token)) AS readings FROM t JOIN r ON t.doc_id = r.doc_id GROUP BY 1, 2""")
def agg_agreement(spark, sf):
    """AGG-07."""
    li = table(spark, sf, "lineitem")
    r = li.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("text "), (F.col("l_partkey") % 3).cast("string")).alias("text"))
    t = li.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("t "), (F.col("l_suppkey") % 4).cast("string")).alias("token")).distinct()
    return readings.agreement(r, t)


@query("""WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS ord, CASE WHEN l_partkey % 3 = 0 THEN 'tax_amount' ELSE 'net_sales' END AS field, l_returnflag AS label, CAST(l_extendedprice AS DECIMAL(18, 2)) AS amount FROM lineitem)
  SELECT doc_id, CAST(sum(amount) * 100 AS BIGINT) AS tax_c, CASE WHEN count(*) > 1 THEN string_agg(concat(label, '=', CAST(CAST(amount * 100 AS BIGINT) AS STRING)), ';' ORDER BY ord) END AS breakdown FROM f WHERE field = 'tax_amount' GROUP BY 1""")
def agg_tax_breakdown(spark, sf):
    """AGG-04."""
    f = table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", f"{_ORD} AS ord", "CASE WHEN l_partkey % 3 = 0 THEN 'tax_amount' ELSE 'net_sales' END AS field", "l_returnflag AS label", "CAST(l_extendedprice AS DECIMAL(18, 2)) AS amount")
    told = F.array_join(F.transform("breakdown", lambda x: F.concat(x["label"], F.lit("="), (x["amount"] * 100).cast("bigint").cast("string"))), ";")
    return reconcile.tax_totals(f).select("doc_id", (F.col("tax") * 100).cast("bigint").alias("tax_c"), told.alias("breakdown"))


@query("SELECT l_orderkey AS doc_id, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS ord, bool_or(abs(b.p - CAST(a.l_extendedprice AS DECIMAL(18, 2)) - 0.02) <= 0.02) AS present FROM lineitem a JOIN (SELECT l_orderkey AS k, CAST(l_extendedprice AS DECIMAL(18, 2)) AS p FROM lineitem) b ON a.l_orderkey = b.k GROUP BY 1, 2")
def mon_token_present(spark, sf):
    """MON-03: two cents above an amount of the page, which is present, as is anything within two cents of another."""
    li = table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", f"{_ORD} AS ord", "CAST(l_extendedprice AS DECIMAL(18, 2)) AS amount")
    pages = li.groupBy("doc_id").agg(F.collect_list("amount").alias("printed"))
    rows = li.join(pages, "doc_id").withColumn("present", reconcile.token_present(F.col("amount") + F.lit("0.02").cast("decimal(18,2)"), F.col("printed")))
    return rows.groupBy("doc_id", "ord").agg(F.bool_or("present").alias("present"))


@query(R + """, low AS (SELECT doc_id, text, lower(text) AS t FROM receipts), e AS (SELECT doc_id, list_concat([CASE WHEN regexp_matches(t, 'vat\\s*reg\\.?\\s*tin') THEN 'PH4.0' END, CASE WHEN regexp_matches(t, 'philippines|makati|quezon\\s+city|manila|pasig|cebu|davao|binondo|rizal') THEN 'PH2.5' END, CASE WHEN regexp_matches(t, 'official\\s+receipt|sales\\s+invoice') THEN 'PH1.0' END, CASE WHEN regexp_matches(t, '\\btin\\b\\s*[:#]?\\s*\\d{3}') THEN 'PH2.0' END, CASE WHEN regexp_matches(t, 'sdn\\.?\\s*bhd') THEN 'MY2.0' END, CASE WHEN regexp_matches(t, '\\bmalaysia\\b|kuala\\s+lumpur|\\bgst\\b|\\bsst\\b') THEN 'MY3.0' END, CASE WHEN regexp_matches(t, 'brunei|bandar\\s+seri|yayasan') THEN 'BN3.5' END, CASE WHEN regexp_matches(t, 'ent\\s*rek\\s*\\(\\s*b\\s*\\)') THEN 'BN2.5' END, CASE WHEN regexp_matches(t, '\\bsales\\s+tax\\b') THEN 'US3.0' END],
    [CASE WHEN regexp_matches(text, '\\bIL\\s+\\d{5}(?:-\\d{4})?\\b') THEN 'US4.0' END, CASE WHEN regexp_matches(text, '[a-zA-Z\\s]{2,25},\\s*IL\\b') THEN 'US3.0' END, CASE WHEN regexp_matches(text, '\\(\\d{3}\\)\\s*\\d{3}\\s*-\\s*\\d{4}') THEN 'US2.0' END]) AS found FROM low)
  SELECT doc_id, array_to_string([x for x in found if x IS NOT NULL], ';') AS evidence FROM e""")
def loc_evidence(spark, sf):
    """AGG-06: what speaks for which country, in order."""
    return rendered(spark, sf).select("doc_id", F.array_join(F.transform(locale.evidence(F.col("text")), lambda x: F.concat(x["country"], x["weight"].cast("string"))), ";").alias("evidence"))


@query("""WITH e AS (SELECT c_custkey AS doc_id, c_name AS value, CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN concat('the ', c_name) WHEN 2 THEN NULL WHEN 3 THEN 'Other Holdings' WHEN 4 THEN 'Acme Trap' ELSE 'Alias Company' END AS produced, c_custkey % 11 <> 0 AS grounded, c_custkey % 7 = 0 AS none FROM customer)
  SELECT doc_id, 'vendor_name' AS field, CASE WHEN produced IS NULL THEN CASE WHEN none THEN 'abstained_ok' ELSE 'missed' END WHEN NOT none AND doc_id % 6 IN (0, 1) THEN 'correct' WHEN doc_id % 6 = 5 THEN 'correct' WHEN doc_id % 6 = 4 THEN 'confused' WHEN none THEN 'fabricated' WHEN NOT grounded THEN 'ungrounded' ELSE 'wrong' END AS outcome FROM e""")
def evl_joined_names(spark, sf):
    """JOI-09, EVL-01's likeness of names, EVL-02: expected names joined to produced ones."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    expected = c.select(k.alias("doc_id"), F.lit("vendor_name").alias("field"), F.lit("fuzzy").alias("kind"), F.when(k % 7 != 0, F.col("c_name")).alias("value"), F.array(F.lit("ACME trap")).alias("traps"), F.array(F.lit("company alias")).alias("also"))
    value = F.when(k % 6 == 0, F.col("c_name")).when(k % 6 == 1, F.concat(F.lit("the "), "c_name")).when(k % 6 == 3, "Other Holdings").when(k % 6 == 4, "Acme Trap").when(k % 6 == 5, "Alias Company")
    produced = c.where("c_custkey % 6 <> 2").select(k.alias("doc_id"), F.lit("vendor_name").alias("field"), value.alias("value"), (k % 11 != 0).alias("grounded"))
    return evaluation.scored(expected, produced)


@query("""WITH d AS (SELECT label AS category, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)), p AS (SELECT v.vec_id, CAST(d.category AS STRING) AS category, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), d.e) AS s FROM embeddings v, d),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, category DESC) AS rank FROM p), w AS (SELECT vec_id, max(category) FILTER (rank = 1) AS one, max(category) FILTER (rank = 2) AS two, max(s) AS s FROM r GROUP BY 1)
  SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'Transportation' WHEN s >= 0.25 AND s < 0.30 AND vec_id % 2 = 1 THEN two WHEN s >= 0.25 THEN one ELSE 'Others' END AS category, CASE WHEN vec_id % 4 = 0 THEN 'lexicon' WHEN s >= 0.25 AND s < 0.30 AND vec_id % 2 = 1 THEN 'tiebreak' WHEN s >= 0.25 THEN 'embedding' ELSE 'default' END AS method FROM w""")
def cat_combined(spark, sf):
    """CAT-01: every fourth vendor is in the lexicon; the tiebreaker picks the runner-up of odd ones."""
    e = table(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(F.col("label").cast("string").alias("category"), "embedding")
    near = category.by_vector(e.select("vec_id", "embedding"), first)
    tie = F.when(F.col("vec_id") % 2 == 1, F.col("runner_up"))
    got = category.classify(category.by_lexicon(F.when(F.col("vec_id") % 4 == 0, "City Taxi").otherwise("Zzz")), F.col("category"), F.col("runner_up"), F.col("similarity"), tie)
    return near.select("vec_id", got.alias("g")).select("vec_id", "g.category", "g.method")


@query(MONEY_SQL + """ SELECT doc_id, reconciled, basis, country, 1 + doc_id % 3 AS candidates FROM g""")
def prj_audit(spark, sf):
    """PRJ-03: the audit document, read back from its JSON."""
    df = rendered(spark, sf)
    runs = df.select("doc_id", F.explode(F.sequence(F.lit(1), (1 + F.col("doc_id") % 3).cast("int"))).alias("psm"), F.lit("e").alias("engine"), F.lit("v").alias("variant"), "text", "confidence").withColumns({"reading_id": F.col("psm"), "anchor": F.col("psm") / 2})
    docs = payloads.audit(plan.extract(df).join(payloads.selection(readings.ranked(runs)), "doc_id")).withColumn("v", F.parse_json("document"))
    get = lambda p, t, n: F.try_variant_get("v", p, t).alias(n)
    return docs.select("doc_id", get("$.reconciliation.reconciled", "boolean", "reconciled"), get("$.reconciliation.tax_basis", "string", "basis"), get("$.locale.country", "string", "country"), get("$.ocr_selection.candidates_evaluated", "bigint", "candidates"))


_FORMATS = ("%Y-%m-%d", "%m-%d-%Y", "%d-%m-%Y", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%b %d, %Y", "%B %d, %Y", "%d %b %y", "%d %b %Y")


@query("WITH t AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(_FORMATS)) + " WHEN 10 THEN concat('paid at ', strftime(o_orderdate, '%Y-%m-%d'), ' 10:00') ELSE 'n/a' END AS x FROM orders) SELECT doc_id, CAST(coalesce(" + ", ".join(f"CAST(try_strptime(x, '{f}') AS DATE)" for f in _FORMATS) + ", TRY_CAST(nullif(regexp_extract(x, '\\d{4}-\\d{2}-\\d{2}', 0), '') AS DATE)) AS STRING) AS found FROM t")
def dat_parse_values(spark, sf):
    """DAT-04: a date in ten formats, inside other text, and none."""
    d = F.col("o_orderdate")
    forms = ("yyyy-MM-dd", "MM-dd-yyyy", "dd-MM-yyyy", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "MMM dd, yyyy", "MMMM dd, yyyy", "dd MMM yy", "dd MMM yyyy")
    shown = F.element_at(F.array(*(F.date_format(d, f) for f in forms), F.concat(F.lit("paid at "), F.date_format(d, "yyyy-MM-dd"), F.lit(" 10:00")), F.lit("n/a")), (F.col("o_orderkey") % 12 + 1).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), dates.parse_value(shown).cast("string").alias("found"))


@query("""WITH t AS (SELECT c_custkey, ['meals', ' Travel ', 'Office Supplies', 'Accom', '', 'Meals & Travel', 'zzz'][c_custkey % 7 + 1] AS x FROM customer)
  SELECT c_custkey, CASE trim(x) WHEN 'meals' THEN 'Meals' WHEN 'Travel' THEN 'Travel' WHEN 'Office Supplies' THEN 'Supplies' WHEN 'Accom' THEN 'Accommodation' WHEN 'Meals & Travel' THEN 'Meals' ELSE 'Others' END AS category FROM t""")
def cat_coerced(spark, sf):
    """CAT-02: exact, containing, contained and other categories."""
    x = F.element_at(F.array(*map(F.lit, ("meals", " Travel ", "Office Supplies", "Accom", "", "Meals & Travel", "zzz"))), (F.col("c_custkey") % 7 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", category.coerce(x).alias("category"))


@query("""WITH t AS (SELECT o_orderkey AS doc_id, ['exclusive', 'inclusive', 'unknown'][o_orderkey % 3 + 1] AS basis, o_orderkey % 5 = 0 AS net_derived, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 112 END AS total, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 12 END AS tax FROM orders)
  SELECT doc_id, array_to_string([x for x in [CASE WHEN basis = 'exclusive' OR (basis = 'unknown' AND NOT net_derived) THEN 'net_sales=100' END, CASE WHEN basis <> 'exclusive' THEN 'total_sales=112' END, CASE WHEN basis <> 'unknown' AND total IS NOT NULL THEN 'total_amount=112' END, CASE WHEN basis <> 'unknown' AND total IS NOT NULL AND tax <> 0 THEN 'total_less_tax_and_charges=100' END] if x IS NOT NULL], ';') AS targets FROM t""")
def itm_targets(spark, sf):
    """ITM-02."""
    k, d = F.col("o_orderkey"), lambda x: F.lit(x).cast("decimal(18,2)")
    basis = F.element_at(F.array(*map(F.lit, ("exclusive", "inclusive", "unknown"))), (k % 3 + 1).cast("int"))
    derived = F.when(k % 5 == 0, F.array(F.lit("net_sales"))).otherwise(F.array().cast("array<string>"))
    t = itemlines.targets(basis, d("100"), d("112"), F.when(k % 4 != 0, d("112")), F.when(k % 7 == 0, d("0")).otherwise(d("12")), F.lit(None).cast("decimal(18,2)"), derived)
    return table(spark, sf, "orders").select(k.alias("doc_id"), F.array_join(F.transform(t, lambda x: F.concat(x["name"], F.lit("="), x["value"].cast("int").cast("string"))), ";").alias("targets"))


@query("SELECT l_orderkey AS doc_id, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS ord, CASE WHEN l_partkey % 5 > 0 THEN l_suppkey % 9 / CAST(l_partkey % 5 * 5 AS DOUBLE) BETWEEN 0 AND 0.3 END AS plausible FROM lineitem")
def num_tax_rate(spark, sf):
    """NUM-07."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr(_ORD).alias("ord"), reconcile.plausible_rate(F.col("l_suppkey") % 9, F.col("l_partkey") % 5 * 5).alias("plausible"))


@query("WITH p AS (SELECT page_id, concat(coalesce(url, 'x'), CASE page_id % 6 WHEN 0 THEN '.pdf' WHEN 3 THEN '.PDF?size=1&name=a.jpg' WHEN 1 THEN '.jpg?as=b.pdf' ELSE '.png' END) AS path FROM pages) SELECT page_id, CASE WHEN lower(string_split(path, '?')[1]) LIKE '%.pdf' THEN 'pdf' ELSE 'image' END AS kind FROM p")
def src_kind(spark, sf):
    """SRC-02, SRC-11: addresses with and without a query string."""
    k = F.col("page_id") % 6
    path = F.concat(F.coalesce("url", F.lit("x")), F.when(k == 0, ".pdf").when(k == 3, ".PDF?size=1&name=a.jpg").when(k == 1, ".jpg?as=b.pdf").otherwise(".png"))
    return table(spark, sf, "pages").select("page_id", kind(path).alias("kind"))


@query(WORDS_SQL + """, s AS (SELECT word_id, doc_id, line % 3 AS segment, top FROM w) SELECT word_id, doc_id, segment, CAST(top + CASE segment WHEN 0 THEN 0 WHEN 1 THEN 100 ELSE 300 END AS INT) AS top FROM s""")
def src_stitched(spark, sf):
    """SRC-04: three segments of a document, 100, 200 and 300 high, one below the other."""
    words = _words(spark, sf).withColumn("segment", F.col("line") % 3)
    requests = words.select("doc_id").distinct().withColumn("urls", F.array(*map(F.lit, ("a", "b", "c"))))
    sizes = geometry.segments(requests).select("doc_id", "segment", ((F.col("segment") + 1) * 100).alias("height"))
    return geometry.stitched(words, sizes).select("word_id", "doc_id", "segment", F.col("top").cast("int").alias("top"))


_GAPS = """o_orderkey AS doc_id, ['PH', 'US', 'MY'][{one}] AS country, ['inclusive', 'exclusive', 'unknown', 'inclusive'][{two}] AS basis, o_orderkey % 5 <> 0 AS vat_registered,
  CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_custkey * 1.13 AS DECIMAL(18, 2)) END AS net, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey * 1.13 * CASE WHEN o_orderkey % 13 = 0 THEN 0.45 ELSE 0.12 END AS DECIMAL(18, 2)) END AS tax,
  CASE WHEN o_orderkey % 3 <> 1 THEN CAST(o_custkey * 1.13 * 1.12 AS DECIMAL(18, 2)) END AS sales, CASE WHEN o_orderkey % 6 = 0 THEN CAST(10 AS DECIMAL(18, 2)) END AS service,
  CASE WHEN o_orderkey % 11 > 1 THEN CAST(o_custkey * 1.13 * 1.12 + CASE WHEN o_orderkey % 6 = 0 THEN 10 ELSE 0 END + CASE WHEN o_orderkey % 17 = 0 THEN 5 ELSE 0 END AS DECIMAL(18, 2)) END AS total, CAST(o_custkey * 1.13 * 1.12 + CASE WHEN o_orderkey % 6 = 0 THEN 10 ELSE 0 END AS DECIMAL(18, 2)) AS shown"""


@query("WITH w AS (SELECT *, country = 'PH' AS ph, basis = 'inclusive' AS inc, basis = 'exclusive' AS exc, coalesce(service, 0) AS svc FROM (SELECT " + _GAPS.format(one="o_orderkey % 3 + 1", two="o_orderkey % 4 + 1") + """ FROM orders)),
  a AS (SELECT *, ph AND NOT vat_registered AND net IS NULL AND sales IS NOT NULL AS ns, ph AND vat_registered AND inc AND net IS NULL AND sales IS NOT NULL AS nv FROM w),
  b AS (SELECT *, CASE WHEN ns THEN sales WHEN nv THEN CAST((CAST(sales * 100 AS BIGINT) * 100 + 56) // 112 AS DECIMAL(18, 2)) / 100 ELSE net END AS net_raw FROM a), b2 AS (SELECT *, CAST(net_raw AS DECIMAL(18, 2)) AS net_out, CASE WHEN NOT ns THEN CAST(net_raw AS DECIMAL(18, 2)) END AS netx FROM b),
  c AS (SELECT *, ph AND vat_registered AND inc AND tax IS NULL AND netx IS NOT NULL AS tv FROM b2), d AS (SELECT *, CASE WHEN tv THEN CAST(round(netx * 0.12, 2) AS DECIMAL(18, 2)) ELSE tax END AS tax_out FROM c),
  e AS (SELECT *, (inc OR exc) AND sales IS NULL AND netx IS NOT NULL AND tax_out IS NOT NULL AS summed, CASE WHEN exc AND netx IS NOT NULL AND NOT nv AND tax_out IS NOT NULL AND NOT tv THEN netx + tax_out + svc END AS comp FROM d), f AS (SELECT *, CASE WHEN summed THEN netx + tax_out ELSE sales END AS sales_out FROM e),
  g AS (SELECT *, comp IS NOT NULL AND total IS NULL AS replaced, comp IS NULL AND inc AND total IS NULL AND sales_out IS NOT NULL AND abs(shown - sales_out - svc) <= 0.02 AS carried, abs(total - comp) <= 0.02 AS agrees FROM f),
  h AS (SELECT *, CASE WHEN replaced THEN comp WHEN carried THEN sales_out + svc ELSE total END AS total_out FROM g),
  i AS (SELECT *, [x for x in [CASE WHEN tax_out IS NOT NULL AND net_out > 0 AND ph AND inc AND NOT tv THEN abs(net_out * 0.12 - tax_out) <= greatest(0.02, net_out * 0.001) END, CASE WHEN tax_out IS NOT NULL AND net_out > 0 AND (NOT ph OR exc) THEN CAST(tax_out AS DOUBLE) / CAST(net_out AS DOUBLE) BETWEEN 0 AND 0.3 END,
    CASE WHEN net_out IS NOT NULL AND tax_out IS NOT NULL AND sales_out IS NOT NULL AND NOT summed AND NOT (nv AND tv) THEN abs(net_out + tax_out - sales_out) <= 0.02 END, CASE WHEN sales_out IS NOT NULL AND total_out IS NOT NULL AND NOT carried AND NOT replaced THEN abs(sales_out + svc - total_out) <= 0.02 END,
    CASE WHEN tax_out IS NULL AND net_out IS NOT NULL AND total_out IS NOT NULL AND svc = 0 AND NOT ns AND NOT nv THEN abs(net_out - total_out) <= 0.02 END] if x IS NOT NULL] AS checks FROM h)
  SELECT doc_id, CAST(net_out * 100 AS BIGINT) AS net_c, CAST(tax_out * 100 AS BIGINT) AS tax_c, CAST(sales_out * 100 AS BIGINT) AS sales_c, CAST(total_out * 100 AS BIGINT) AS total_c, len(checks) > 0 AND len([x for x in checks if NOT x]) = 0 AS reconciled,
    CASE WHEN comp IS NOT NULL THEN CASE WHEN total IS NULL THEN 'computed' WHEN agrees THEN 'reported' ELSE 'reported_conflict' END WHEN len(checks) > 0 AND len([x for x in checks if NOT x]) = 0 THEN 'reconciled' ELSE 'unresolved' END AS status,
    array_to_string([x for x in [CASE WHEN ns OR nv THEN 'net_sales' END, CASE WHEN tv THEN 'tax_amount' END, CASE WHEN summed THEN 'total_sales' END, CASE WHEN replaced OR carried THEN 'total_amount' END] if x IS NOT NULL], ';') AS derived FROM i""")
def mon_fill_gaps(spark, sf):
    """MON-02, MON-04 with sales, service charges, both kinds of registration, every basis and missing amounts of every kind."""
    pick = lambda xs, n: f"element_at({xs}, CAST({n} AS INT))"
    sql = _GAPS.format(one="ONE", two="TWO").replace("['PH', 'US', 'MY'][ONE]", pick("array('PH', 'US', 'MY')", "o_orderkey % 3 + 1")).replace("['inclusive', 'exclusive', 'unknown', 'inclusive'][TWO]", pick("array('inclusive', 'exclusive', 'unknown', 'inclusive')", "o_orderkey % 4 + 1"))
    df = table(spark, sf, "orders").selectExpr(*(x.strip() for x in _split_columns(sql))).withColumn("printed", F.array("shown"))
    c = lambda x, n: (F.col(x) * 100).cast("bigint").alias(n)
    return reconcile.resolve(df).select("doc_id", c("net_out", "net_c"), c("tax_out", "tax_c"), c("sales_out", "sales_c"), c("total_out", "total_c"), "reconciled", "status", F.array_join("derived", ";").alias("derived"))
