"""The queries of the receipt operators, each with the same query as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, money, text, vectors
from ..operators import anchors, category, confidence, evaluation, items, layout, locale, readings, reconcile, similarity, tax
from ..sources.receipts import rendered, rendered_sql
from ..streaming import jobs
from . import receipts as plan
from .registry import BEYOND_SQL, ORACLES, QUERIES, query

NOW = "1999-01-01"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")



def _ord():
    """A place in an order that no two of its line items share."""
    return F.col("l_linenumber") * F.lit(10000000000) + F.col("l_partkey") * 10000 + F.col("l_suppkey")


R = rendered_sql()

# What the SQL below looks for, written out apart from the operators.
_NEAR_WORDS = ("total", "amount due", "amt due", "grand total", "balance due", "subtotal", "balance", "vat", "tax", "sst", "gst", "vatable", "zero-rated", "vat-exempt")
_DOC_WORDS = ("receipt", "invoice", "official receipt", "sales invoice", "tin", "cashier", "change", "payment", "qty", "service charge")
_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_DATE = rf"(?i)\b\d{{1,2}}[/\-.]\d{{1,2}}[/\-.]\d{{2,4}}\b|\b\d{{4}}[/\-.]\d{{1,2}}[/\-.]\d{{1,2}}\b|\b\d{{1,2}}\s+(?:{_MONTHS})[a-z.]*\s+\d{{2,4}}\b|\b(?:{_MONTHS})[a-z.]*\s+\d{{1,2}},?\s+\d{{4}}\b"
_NOISE = r"(?i)authority\s+to\s+print|\bocn\b|permit\s+no|accreditation|booklets|valid\s+until|date\s+of\s+atp|printers?\b|bkl?ts|\batp\b|vat\s*reg|reference\s*#|card\s+number"
_INCLUSIVE = r"vat\s*inclusive|tax\s*inclusive|inclusive\s*(?:of|vat)|incl\.?\s*vat"
_EXCLUSIVE = r"vat\s*exclusive|tax\s*exclusive|exclusive\s*(?:of|vat)|net\s+of\s+vat|before\s+tax|plus\s+(?:vat|tax)|add\s*:\s*(?:vat|tax)"
_EVIDENCE = (
    ("PH", 4.0, r"vat\s*reg\.?\s*tin"), ("PH", 4.0, r"non\s*-?\s*vat\s*reg"), ("PH", 4.0, r"\bbir\b|authority\s+to\s+print|\batp\b"), ("PH", 2.5, r"philippines|makati|quezon\s+city|manila|pasig|cebu|davao|binondo|rizal"),
    ("PH", 3.0, r"sc\s*/\s*pwd|solo\s+parent|senior\s+citizen"), ("PH", 3.0, r"vatable\s+sales|zero\s*-?\s*rated\s+sales|vat\s*-?\s*exempt\s+sales"), ("PH", 1.0, r"official\s+receipt|sales\s+invoice"), ("PH", 2.0, r"\btin\b\s*[:#]?\s*\d{3}"),
    ("MY", 2.0, r"sdn\.?\s*bhd"), ("MY", 3.0, r"\bmalaysia\b|kuala\s+lumpur|\bgst\b|\bsst\b"), ("MY", 3.0, r"\brm\s*\d"), ("BN", 3.5, r"brunei|bandar\s+seri|yayasan"), ("BN", 2.5, r"sdn\.?\s*bhd.{0,12}\(\s*b\s*\)|ent\s*rek\s*\(\s*b\s*\)"),
    ("US", 3.0, r"\bsales\s+tax\b"), ("SG", 3.5, r"\bsingapore\b"), ("JP", 3.0, r"\bjapan\b|円"), ("HK", 3.0, r"\bhong\s*kong\b"), ("TH", 3.0, r"\bthailand\b|bangkok"),
)
_STATE = r"(AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC)"
_SHAPES = ((4.0, rf"\b{_STATE}\s+\d{{5}}(?:-\d{{4}})?\b"), (3.0, rf"\b[a-zA-Z\s]{{2,25}},\s*{_STATE}\b"), (2.0, r"\(\d{3}\)\s*\d{3}\s*-\s*\d{4}"))
_COUNTRIES, _CURRENCIES = ("PH", "MY", "BN", "US", "SG", "JP", "HK", "TH"), ("PHP", "MYR", "BND", "USD", "SGD", "JPY", "HKD", "THB")
_LEXICON = (
    ("Accommodation", r"hotel|inn\b|resort|lodge|pension|airbnb|apartelle"), ("Travel", r"air(lines|ways|asia)|cebu\s*pac|philippine\s*air|\bpal\b|boarding\s*pass|travel\s*agency|tours?\b"),
    ("Transportation", r"grab|uber|taxi|lalamove|angkas|jeep|bus\s*(fare|ticket)|mrt|lrt|toll|parking|shell|petron|caltex|seaoil|fuel|gasoline|petrol|diesel"),
    ("Meals", r"jollibee|mcdonald|kfc|chowking|greenwich|mang\s*inasal|starbucks|restaurant|resto|cafe|coffee|bakery|bakeshop|grill|diner|eatery|catering|pizza|food|kitchen|japanese|ramen|bbq|canteen"),
    ("Supplies", r"office\s*warehouse|national\s*book|bookstore|stationery|supplies|hardware|\bmart\b|supermarket|grocer|puregold|sm\s*market|wholesaling|trading|printing|press|photocopy"),
    ("Others", r"pharmacy|drug\s*store|mercury\s*drug|clinic|hospital|laboratory|diagnostic|medical|dental"), ("Others", r"telecom|communications|globe|smart\b|pldt|converge|electric|meralco|water|maynilad|internet|utility"),
)


@query("""SELECT o_orderkey AS doc_id, l AS kind, CAST(CASE
  WHEN l = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) WHEN l = 1 THEN CAST(round(o_totalprice * 100) AS BIGINT)
  WHEN l = 2 THEN -CAST(round(o_totalprice * 100) AS BIGINT) WHEN l = 3 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS BIGINT) AS cents,
  regexp_replace(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING), '[^0-9]', '', 'g') AS digits
  FROM orders, (SELECT unnest([0, 1, 2, 3]) AS l)""")
def num_normalize_money(spark, sf):
    """NUM-01, NUM-02: four printed forms of one amount, two of them by country, parsed back."""
    c = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole, part = (c / 100).cast("bigint").cast("string"), F.lpad((c % 100).cast("string"), 2, "0")
    whole = F.floor(c / 100).cast("string")
    forms = F.array(F.concat(F.lit("$"), whole, F.lit("."), part), F.concat(whole, F.lit(","), part), F.concat(whole, F.lit("."), part, F.lit("-")), F.concat(F.lit("EUR "), whole, F.lit(","), part))
    df = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), c.alias("c"), F.posexplode(forms).alias("kind", "raw"))
    country = F.when(F.col("kind") == 3, "PH")
    return df.select("doc_id", F.col("kind"), (money.normalize(F.col("raw"), country) * 100).cast("bigint").alias("cents"), money.digits_only(F.col("c")).alias("digits"))


@query(R + """, tok AS (SELECT doc_id, text, confidence, lower(text) AS low,
    regexp_split_to_array(text, '\\d{1,3}(?:[,.\\s]\\d{3})*[,.]\\d{2}\\b|\\b\\d+[,.]\\d{2}\\b') AS gaps,
    regexp_extract_all(text, '\\d{1,3}(?:[,.\\s]\\d{3})*[,.]\\d{2}\\b|\\b\\d+[,.]\\d{2}\\b') AS toks FROM receipts),
  pos AS (SELECT *, [CAST(list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(t) for t in toks[1:i - 1]]), 0) AS BIGINT) for i in range(1, len(toks) + 1)] AS starts,
    list_concat(""" + ", ".join(f"[[p - 1 - 60, p - 1 + {len(w)} + 60] for p in range(1, length(low) + 1) if substr(low, p, {len(w)}) = '{w}']" for w in _NEAR_WORDS).replace("list_concat(", "") + """) AS spans FROM tok),
  near AS (SELECT *, len([s for s in starts if len([x for x in spans if x[1] <= s and s <= x[2]]) > 0]) AS money_near, len(toks) AS money_tokens,
    regexp_matches(text, '\\b\\d{3}\\s*[-\\s]\\s*\\d{3}\\s*[-\\s]\\s*\\d{3}\\s*[-\\s]\\s*\\d{3,5}\\b') AS has_tax_id,
    regexp_matches(text, '""" + _DATE + """') AS has_date,
    """ + " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in _NEAR_WORDS + _DOC_WORDS) + """ AS keyword_hits FROM pos)
  SELECT doc_id, has_tax_id, has_date, CAST(money_near AS BIGINT) AS money_near, CAST(money_tokens AS BIGINT) AS money_tokens, CAST(keyword_hits AS BIGINT) AS keyword_hits,
    CAST(round(10000 * (3.0 * CAST(has_tax_id AS INT) + 3.0 * least(money_near, 4) / 4 + 2.0 * CAST(has_date AS INT) + least(keyword_hits, 10) / 10 + 0.5 * greatest(0.0, least(confidence, 1.0)) + 0.5 * least(money_tokens, 6) / 6)) AS BIGINT) AS score_e4 FROM near""")
def ocr_anchor_score(spark, sf):
    """OCR-01, JOI-02."""
    a = anchors.anchor_score(F.col("text"), F.col("confidence"))
    df = rendered(spark, sf).select("doc_id", a.alias("a"))
    return df.select("doc_id", "a.has_tax_id", "a.has_date", F.col("a.money_near").cast("bigint").alias("money_near"), F.col("a.money_tokens").cast("bigint").alias("money_tokens"), F.col("a.keyword_hits").cast("bigint").alias("keyword_hits"), F.round(F.col("a.total") * 10000).cast("bigint").alias("score_e4"))


_SIGNS = ((r"₱\s*\d", "PHP"), (r"\bphp\s*\d", "PHP"), (r"\brm\s*\d", "MYR"), (r"€\s*\d{1,3}[.,]\d{2}", "EUR"), (r"£\s*\d{1,3}[.,]\d{2}", "GBP"), (r"฿\s*\d", "THB"))


def _locale_sql() -> str:
    """loc(doc_id, country, currency, score) of receipts(doc_id, text). US by its shapes alone is met after all others."""
    of = {c: " + ".join(["0.0", *(f"CASE WHEN regexp_matches(low, '{p}') THEN {w} ELSE 0.0 END" for k, w, p in _EVIDENCE if k == c)]) for c in _COUNTRIES}
    shaped = "".join(f" + CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0.0 END" for w, p in _SHAPES)
    scored = ", ".join(f"{e} AS s_{c}" for c, e in of.items())
    entry = lambda c, e: f"{{'c': '{c}', 's': CAST({e} AS DOUBLE)}}"
    pairs = ", ".join([entry(c, "CASE WHEN s_US > 0 THEN us ELSE 0 END" if c == "US" else f"s_{c}") for c in _COUNTRIES] + [entry("US", "CASE WHEN s_US > 0 THEN 0 ELSE us END")])
    currency = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in zip(_COUNTRIES, _CURRENCIES)) + " END"
    sign = "CASE " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{c}'" for p, c in _SIGNS) + " END"
    return f""", low AS (SELECT doc_id, text, lower(text) AS low FROM receipts), ev AS (SELECT doc_id, {scored}, 0.0{shaped} AS shaped, len(regexp_extract_all(low, '\\$\\s*\\d')) AS dollars, {sign} AS sign FROM low),
      priced AS (SELECT *, CASE WHEN dollars >= 2 AND {' + '.join(f's_{c}' for c in _COUNTRIES)} + shaped = 0 THEN 3.0 WHEN dollars >= 2 AND s_US + shaped > 0 THEN s_US + shaped + 1.5 ELSE s_US + shaped END AS us FROM ev),
      best AS (SELECT doc_id, dollars, sign, [x for x in [{pairs}] if x.s > 0] AS found FROM priced),
      top AS (SELECT *, list_max([x.s for x in found]) AS m FROM best),
      pick AS (SELECT doc_id, dollars, sign, [x for x in found if x.s = m][1].c AS c0, m, coalesce([x for x in found if x.c = 'BN'][1].s, 0) AS bn FROM top),
      fin AS (SELECT doc_id, dollars, sign, c0, CASE WHEN c0 = 'MY' AND bn >= 2.5 THEN 'BN' ELSE c0 END AS c, CASE WHEN c0 = 'MY' AND bn >= 2.5 THEN bn ELSE coalesce(m, 0) END AS score FROM pick),
      loc AS (SELECT doc_id, CASE WHEN score >= 3 THEN c END AS country, CASE WHEN score >= 3 THEN coalesce({currency}, sign) WHEN c0 IS NULL AND dollars = 1 THEN NULL ELSE coalesce(sign, CASE WHEN dollars >= 2 AND c0 IS NOT NULL THEN 'USD' END) END AS currency, score FROM fin)"""


LOC = R + _locale_sql()


@query(LOC + " SELECT doc_id, country, currency, CAST(round(score * 10) AS BIGINT) AS score_e1 FROM loc")
def loc_detect_locale(spark, sf):
    """LOC-01, AGG-06."""
    return rendered(spark, sf).select("doc_id", locale.detect(F.col("text")).alias("l")).select("doc_id", "l.country", "l.currency", F.round(F.col("l.score") * 10).cast("bigint").alias("score_e1"))


BASIS_SQL = f"CASE WHEN regexp_matches(lower(text), '{_INCLUSIVE}') THEN 'inclusive' WHEN regexp_matches(lower(text), '{_EXCLUSIVE}') THEN 'exclusive' WHEN country = 'US' AND regexp_matches(lower(text), '\\b(?:sales\\s+)?tax\\b') THEN 'exclusive' WHEN country = 'MY' AND regexp_matches(lower(text), '\\b(?:sst|gst)\\b') THEN 'exclusive' WHEN country = 'PH' THEN 'inclusive' ELSE 'unknown' END"


@query(LOC + f" SELECT doc_id, {BASIS_SQL} AS basis FROM receipts JOIN loc USING (doc_id)")
def sem_tax_basis(spark, sf):
    """SEM-01."""
    return rendered(spark, sf).withColumn("country", locale.detect(F.col("text"))["country"]).select("doc_id", locale.tax_basis(F.col("text"), F.col("country")).alias("basis"))


@query(R + """ SELECT doc_id, CASE WHEN contains(upper(text), 'VAT REG') THEN 'vat' WHEN contains(upper(text), 'VAT') THEN 'vat' ELSE 'non-vat' END AS vat,
  regexp_extract(text, 'TIN ([0-9-]+)', 1) AS tin, length(regexp_replace(regexp_extract(text, 'TIN ([0-9-]+)', 1), '[^0-9]', '', 'g')) IN (12, 14) AS valid,
  CASE WHEN length(regexp_replace(regexp_extract(text, 'TIN ([0-9-]+)', 1), '[^0-9]', '', 'g')) = 14 THEN regexp_extract(text, 'TIN ([0-9-]+)', 1) END AS formatted FROM receipts""")
def tax_vat_class(spark, sf):
    """TAX-02, TAX-05, TAX-06."""
    tin = F.regexp_extract("text", "TIN ([0-9-]+)", 1)
    return rendered(spark, sf).select("doc_id", tax.vat_class(F.col("text")).alias("vat"), tin.alias("tin"), tax.valid_tin(tin).alias("valid"), tax.format_tin(tin).alias("formatted"))


AMOUNTS_SQL = R + """, ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM receipts),
  tk AS (SELECT doc_id, line_no, line, lower(line) AS low, regexp_extract(line, '(\\d{1,3}(?:,\\d{3})*\\.\\d{1,2})\\s*$', 1) AS token FROM ls WHERE NOT regexp_matches(line, '""" + _NOISE + """')),
  lb AS (SELECT *, CASE WHEN starts_with(low, 'total amount due') THEN 'total_amount' WHEN starts_with(low, 'subtotal') THEN 'net_sales' WHEN regexp_matches(low, '^(vat 12%|sales tax|sst|tax) ') THEN 'tax_amount' END AS field FROM tk WHERE token <> ''),
  la AS (SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, field, CAST(replace(token, ',', '') AS DECIMAL(18, 2)) AS amount FROM lb WHERE field IS NOT NULL)"""


@query(AMOUNTS_SQL + " SELECT doc_id, line_no, field, CAST(amount * 100 AS BIGINT) AS cents FROM la")
def lay_labelled_amounts(spark, sf):
    """STR-12, FLT-01, FLT-04, JOI-01 on lines."""
    return plan.labelled_amounts(rendered(spark, sf)).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "field", (F.col("amount") * 100).cast("bigint").alias("cents"))


@query("""SELECT l_orderkey AS doc_id, lid AS label_id, CAST(min_by(a, (-same, -x, -a)) AS BIGINT) AS amount_id, CASE WHEN max(same) = 1 THEN 'same_row' ELSE 'row_below' END AS pairing FROM (
  SELECT l.l_orderkey, l.l_linenumber * 10000000000 + l.l_partkey * 10000 + l.l_suppkey AS lid, a.l_linenumber * 10000000000 + a.l_partkey * 10000 + a.l_suppkey AS a, a.l_partkey % 400 AS x, CASE WHEN abs(a.l_suppkey % 40 - l.l_suppkey % 40) <= 0.6 * 12 AND a.l_partkey % 400 >= l.l_partkey % 300 + 40 - 12 THEN 1 ELSE 0 END AS same,
    CASE WHEN a.l_suppkey % 40 - l.l_suppkey % 40 > 0 AND a.l_suppkey % 40 - l.l_suppkey % 40 <= 2.5 * 12 THEN 1 ELSE 0 END AS below
  FROM lineitem l JOIN lineitem a ON l.l_orderkey = a.l_orderkey) WHERE same = 1 OR below = 1 GROUP BY ALL""")
def joi_pair_amounts(spark, sf):
    """JOI-01: the band join on geometry, over positions taken from the line items."""
    li = _t(spark, sf, "lineitem")
    y = (F.col("l_suppkey") % 40).cast("double")
    key = F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page")
    labels = li.select(*key, _ord().alias("label_id"), (F.col("l_partkey") % 300 + 40).alias("right"), y.alias("center_y"), F.lit(12).alias("height"))
    amounts = li.select(*key, _ord().alias("amount_id"), (F.col("l_partkey") % 400).alias("left"), y.alias("center_y"))
    return layout.pair_amounts(labels, amounts).drop("page")


RESOLVE_SQL = """, w AS (SELECT *, country = 'PH' AS ph, basis = 'inclusive' AS inc, basis = 'exclusive' AS exc FROM m),
  a AS (SELECT *, CASE WHEN ph AND inc AND net IS NULL AND sales IS NOT NULL THEN CAST(round(sales / 1.12, 2) AS DECIMAL(18, 2)) ELSE net END AS net_out, ph AND inc AND net IS NULL AND sales IS NOT NULL AS net_vat FROM w),
  b AS (SELECT *, ph AND inc AND tax IS NULL AND net_out IS NOT NULL AS tax_vat, CASE WHEN ph AND inc AND tax IS NULL AND net_out IS NOT NULL THEN CAST(round(net_out * 0.12, 2) AS DECIMAL(18, 2)) ELSE tax END AS tax_out FROM a),
  c AS (SELECT *, (inc OR exc) AND sales IS NULL AND net_out IS NOT NULL AND tax_out IS NOT NULL AS summed, CASE WHEN (inc OR exc) AND sales IS NULL THEN net_out + tax_out ELSE sales END AS sales_out FROM b),
  d AS (SELECT *, CASE WHEN exc AND net IS NOT NULL AND tax IS NOT NULL THEN net + tax END AS computed FROM c),
  e AS (SELECT *, CASE WHEN computed IS NOT NULL AND total IS NULL THEN computed ELSE total END AS total_out FROM d),
  f AS (SELECT *, CASE WHEN ph AND inc AND tax_out IS NOT NULL AND net_out > 0 AND NOT tax_vat THEN abs(net_out * 0.12 - tax_out) <= greatest(0.02, net_out * 0.001) END AS k1,
    CASE WHEN tax_out IS NOT NULL AND net_out > 0 AND (NOT coalesce(ph, false) OR exc) THEN tax_out / net_out BETWEEN 0 AND 0.3 END AS k2,
    CASE WHEN NOT summed AND net_out + tax_out IS NOT NULL AND sales_out IS NOT NULL AND NOT (net_vat AND tax_vat) THEN abs(net_out + tax_out - sales_out) <= 0.02 END AS k3,
    CASE WHEN sales_out IS NOT NULL AND total_out IS NOT NULL AND NOT (computed IS NOT NULL AND total IS NULL) THEN abs(sales_out - total_out) <= 0.02 END AS k4,
    CASE WHEN tax_out IS NULL AND net_out IS NOT NULL AND total_out IS NOT NULL THEN abs(net_out - total_out) <= 0.02 END AS k5 FROM e),
  g AS (SELECT *, coalesce(k1, k2, k3, k4, k5) IS NOT NULL AND coalesce(k1, true) AND coalesce(k2, true) AND coalesce(k3, true) AND coalesce(k4, true) AND coalesce(k5, true) AS reconciled FROM f)"""

MONEY_SQL = AMOUNTS_SQL + _locale_sql() + f""", m AS (SELECT r.doc_id, country, {BASIS_SQL} AS basis, text, confidence,
    max(amount) FILTER (field = 'net_sales') AS net, CAST(sum(amount) FILTER (field = 'tax_amount') AS DECIMAL(18, 2)) AS tax, CAST(NULL AS DECIMAL(18, 2)) AS sales, max(amount) FILTER (field = 'total_amount') AS total
    FROM receipts r JOIN loc USING (doc_id) LEFT JOIN la USING (doc_id) GROUP BY ALL)""" + RESOLVE_SQL


@query(MONEY_SQL + """ SELECT doc_id, country, basis, CAST(net_out * 100 AS BIGINT) AS net_cents, CAST(tax_out * 100 AS BIGINT) AS tax_cents, CAST(sales_out * 100 AS BIGINT) AS sales_cents, CAST(total_out * 100 AS BIGINT) AS total_cents, reconciled,
  CASE WHEN computed IS NOT NULL THEN CASE WHEN total IS NULL THEN 'computed' WHEN abs(total - computed) <= 0.02 THEN 'reported' ELSE 'reported_conflict' END WHEN reconciled THEN 'reconciled' ELSE 'unresolved' END AS status FROM g""")
def mon_resolve_money(spark, sf):
    """MON-01, MON-02, MON-04, EXT-01: the receipt plan end to end."""
    c = lambda x, n: (F.col(x) * 100).cast("bigint").alias(n)
    return plan.extract(rendered(spark, sf)).select("doc_id", "country", "basis", c("net_out", "net_cents"), c("tax_out", "tax_cents"), c("sales_out", "sales_cents"), c("total_out", "total_cents"), "reconciled", "status")


@query(R + """, ls AS (SELECT doc_id, true_country, d, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM receipts),
  p AS (SELECT *, regexp_extract(line, '\\b(\\d{4})[/.-](\\d{1,2})[/.-](\\d{1,2})\\b', ['y', 'm', 'd']) AS a, regexp_extract(line, '\\b(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{4}|\\d{2})\\b', ['x', 'z', 'y']) AS b FROM ls),
  q AS (SELECT doc_id, n, coalesce(TRY_CAST(a.y || '-' || lpad(a.m, 2, '0') || '-' || lpad(a.d, 2, '0') AS DATE),
    CASE WHEN (CASE WHEN true_country IN ('US', 'PH') THEN TRY_CAST(b.x AS INT) ELSE TRY_CAST(b.z AS INT) END) > 12
      THEN TRY_CAST(b.y || '-' || lpad(CASE WHEN true_country IN ('US', 'PH') THEN b.z ELSE b.x END, 2, '0') || '-' || lpad(CASE WHEN true_country IN ('US', 'PH') THEN b.x ELSE b.z END, 2, '0') AS DATE)
      ELSE TRY_CAST(b.y || '-' || lpad(CASE WHEN true_country IN ('US', 'PH') THEN b.x ELSE b.z END, 2, '0') || '-' || lpad(CASE WHEN true_country IN ('US', 'PH') THEN b.z ELSE b.x END, 2, '0') AS DATE) END) AS found FROM p WHERE n = 3)
  SELECT doc_id, CAST(found AS STRING) AS found FROM q""")
def dat_line_dates(spark, sf):
    """DAT-01, DAT-02: numeric dates of the date line, month or day first by country."""
    df = rendered(spark, sf)
    return df.select("doc_id", dates.first_numeric_date(F.get(F.split("text", "\n"), F.lit(2)), F.col("true_country")).cast("string").alias("found"))


@query(R + f""" SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(lower(vendor_line) || ' ', '{p}') THEN '{c}'" for c, p in _LEXICON)} ELSE 'Others' END AS category,
  CASE WHEN {' OR '.join(f"regexp_matches(lower(vendor_line) || ' ', '{p}')" for _, p in _LEXICON)} THEN 'lexicon' ELSE 'default' END AS method FROM receipts""")
def cat_lexicon(spark, sf):
    """CAT-01."""
    return rendered(spark, sf).select("doc_id", category.by_lexicon(F.col("vendor_line")).alias("c")).select("doc_id", "c.category", "c.method")


@query(MONEY_SQL + """, day AS (SELECT doc_id, min_by(found, n) AS found FROM (SELECT r.doc_id, n, coalesce(TRY_CAST(concat(a.y, '-', lpad(a.m, 2, '0'), '-', lpad(a.d, 2, '0')) AS DATE), CASE WHEN mm > 12 THEN TRY_CAST(concat(b.y, '-', lpad(CAST(dd AS STRING), 2, '0'), '-', lpad(CAST(mm AS STRING), 2, '0')) AS DATE) ELSE TRY_CAST(concat(b.y, '-', lpad(CAST(mm AS STRING), 2, '0'), '-', lpad(CAST(dd AS STRING), 2, '0')) AS DATE) END) AS found
      FROM (SELECT *, CASE WHEN country IS NULL OR country IN ('US', 'PH') THEN TRY_CAST(b.x AS INT) ELSE TRY_CAST(b.z AS INT) END AS mm, CASE WHEN country IS NULL OR country IN ('US', 'PH') THEN TRY_CAST(b.z AS INT) ELSE TRY_CAST(b.x AS INT) END AS dd FROM
      (SELECT l.doc_id, country, n, regexp_extract(line, '\\b(\\d{4})[/.-](\\d{1,2})[/.-](\\d{1,2})\\b', ['y', 'm', 'd']) AS a, regexp_extract(line, '\\b(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{4}|\\d{2})\\b', ['x', 'z', 'y']) AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM receipts) l JOIN loc USING (doc_id))) r) WHERE found IS NOT NULL GROUP BY 1),
  cat AS (""" + ORACLES["cat_lexicon"] + """), anc AS (""" + ORACLES["ocr_anchor_score"] + """),
  why AS (SELECT g.*, loc.score AS located, c.category, day.found AS date, anc.score_e4 / 10000.0 AS anchor, total_out IS NULL AS no_total, country IS NULL AS no_place, len(regexp_extract_all(text, '[A-Za-z]{2,}')) / CAST(len(regexp_extract_all(text, '\\S+')) AS DOUBLE) < 0.55 OR confidence < 0.45 AS unread FROM g JOIN cat c USING (doc_id) JOIN anc USING (doc_id) JOIN (SELECT doc_id, score FROM loc) loc USING (doc_id) LEFT JOIN day USING (doc_id)),
  sc AS (SELECT *, least(CASE WHEN no_total THEN 50000 ELSE 100000 END, CASE WHEN NOT reconciled THEN 60000 ELSE 100000 END, CASE WHEN no_place THEN 70000 ELSE 100000 END, CASE WHEN unread THEN 45000 ELSE 100000 END) AS cap_e5,
    CAST(3 * round(10000 * (0.7 * least(anchor / 7.0, 1.0) + 0.3 * confidence) + 0.000001) + 35000 + 25000 * CAST(reconciled AS INT) + CASE WHEN located >= 3 THEN round(10000 * least(located / 8.0, 1.0)) ELSE 0 END AS BIGINT) AS raw_e5 FROM why)
  SELECT doc_id, CAST(date AS STRING) AS date, category, array_to_string([x for x in [CASE WHEN no_total THEN 'total_amount_missing' END, CASE WHEN NOT reconciled THEN 'reconciliation_failed' END, CASE WHEN no_place THEN 'locale_unresolved' END, CASE WHEN unread THEN 'handwriting_or_illegible' END] if x IS NOT NULL], ';') AS reasons, (least(raw_e5, cap_e5) + 5) // 10 AS score_e4, (least(raw_e5, cap_e5) + 5) // 10 < 8000 AS flagged FROM sc""")
def ext_extract(spark, sf):
    """EXT-01, VER-04, CNF-01: date, category, reasons and score of the whole plan."""
    df = plan.extract(rendered(spark, sf), scored=True)
    return df.select("doc_id", F.col("date").cast("string").alias("date"), "category", F.array_join("reasons", ";").alias("reasons"), F.round(F.col("score") * 10000).cast("bigint").alias("score_e4"), "flagged")


@query("""SELECT event_id, ocr_e4, score_e4, score_e4 < 8000 AS flagged FROM (SELECT event_id, CAST(round(ocr * 10000) AS BIGINT) AS ocr_e4,
  CAST(round(10000 * least(0.30 * ocr + 0.35 * g + 0.25 * r + 0.10 * l, cap)) AS BIGINT) AS score_e4 FROM (SELECT event_id, round(0.7 * least(event_id % 11 / 7.0, 1.0) + 0.3 * (event_id % 101 / 100.0), 4) AS ocr,
  CASE WHEN event_id % 5 = 0 THEN 1.0 ELSE (event_id % 5 - event_id % 2) / (event_id % 5) END AS g, CAST(event_id % 3 = 0 AS INT) AS r, event_id % 9 / 8.0 AS lraw, least(event_id % 9 / 8.0, 1.0) AS l,
  CASE WHEN event_id % 4 = 1 THEN 0.50 WHEN event_id % 4 = 2 THEN 0.60 ELSE 1.0 END AS cap FROM events))""")
def cnf_confidence(spark, sf):
    """CNF-01, AGG-09, AGG-10, VER-04."""
    e = F.col("event_id")
    reasons = F.array_compact(F.array(F.when(e % 4 == 1, "total_amount_missing"), F.when(F.col("k").isin(1, 2), "reconciliation_failed")))
    df = _t(spark, sf, "events").select("event_id").withColumn("k", e % 4).withColumn("cap", confidence.cap_of(reasons, plan.CAPS))
    g = confidence.pass_rate((e % 5 - e % 2).cast("double"), (e % 5).cast("double"))
    c = confidence.confidence((e % 11).cast("double"), (e % 101) / 100.0, g, e % 3 == 0, (e % 9) / 8.0, F.col("cap"))
    df = df.select("event_id", c.alias("c"))
    e4 = lambda x: F.round(F.col(x) * 10000).cast("bigint")
    return df.select("event_id", e4("c.ocr_quality").alias("ocr_e4"), e4("c.score").alias("score_e4"), "c.flagged")


READ_SQL = """WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS reading_id, concat('text ', l_partkey % 3) AS text, (l_partkey % 40) / 4.0 AS anchor, (l_suppkey % 100) / 100.0 AS confidence, concat('v', l_linenumber % 3) AS variant FROM lineitem)"""


def _readings(spark, sf):
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), _ord().alias("reading_id"), F.concat(F.lit("text "), (F.col("l_partkey") % 3).cast("string")).alias("text"), ((F.col("l_partkey") % 40) / 4.0).alias("anchor"), ((F.col("l_suppkey") % 100) / 100.0).alias("confidence"), F.concat(F.lit("v"), (F.col("l_linenumber") % 3).cast("string")).alias("variant"))


@query(READ_SQL + """ SELECT doc_id, reading_id, CAST(row_number() OVER w AS INT) AS rank, CAST(round(100 * (anchor - lead(anchor) OVER w)) AS BIGINT) AS margin_e2 FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY anchor DESC, confidence DESC, length(text) DESC, reading_id)""")
def win_rank_readings(spark, sf):
    """WIN-01, WIN-03, SRT-06."""
    return readings.ranked(_readings(spark, sf)).select("doc_id", "reading_id", "rank", F.round(F.col("margin") * 100).cast("bigint").alias("margin_e2"))


SUPPORT_SQL = READ_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY anchor DESC, confidence DESC, length(text) DESC, reading_id) AS rank FROM r),
  p AS (SELECT k.*, b.text AS pt, b.variant AS pv, b.anchor AS pa, row_number() OVER (PARTITION BY k.doc_id, k.text ORDER BY k.rank) AS ft FROM k JOIN k b ON k.doc_id = b.doc_id AND b.rank = 1),
  c AS (SELECT *, rank > 1 AND ft = 1 AND text <> pt AND anchor >= 0.5 * pa AS can FROM p),
  v AS (SELECT *, can AND variant <> pv AND row_number() OVER (PARTITION BY doc_id, variant, can ORDER BY rank) = 1 AS nv FROM c),
  s AS (SELECT *, CASE WHEN can THEN row_number() OVER (PARTITION BY doc_id, can ORDER BY CAST(nv AS INT) DESC, rank) END AS sr FROM v)"""


@query(SUPPORT_SQL + " SELECT doc_id, reading_id, CASE WHEN rank = 1 THEN 'primary' WHEN sr <= 3 THEN 'support' ELSE 'other' END AS role FROM s")
def win_support_readings(spark, sf):
    """WIN-06."""
    return readings.with_support(_readings(spark, sf)).select("doc_id", "reading_id", "role")


@query(SUPPORT_SQL + " SELECT doc_id, string_agg(text, chr(10) ORDER BY CASE WHEN rank = 1 THEN 0 ELSE sr END) AS combined FROM s WHERE rank = 1 OR sr <= 3 GROUP BY doc_id")
def set_combined_text(spark, sf):
    """SET-01."""
    return readings.combined_text(_readings(spark, sf))


@query(READ_SQL + " SELECT doc_id, lower(trim(text)) AS line, CAST(min(reading_id) AS BIGINT) AS first_line, CAST(round(100 * max(confidence)) AS BIGINT) AS conf_e2, count(*) AS occurrences FROM r GROUP BY ALL")
def agg_line_meta(spark, sf):
    """AGG-03."""
    return readings.line_meta(_readings(spark, sf).withColumnRenamed("reading_id", "line_no")).select("doc_id", "line", F.col("first_line").cast("bigint").alias("first_line"), F.round(F.col("confidence") * 100).cast("bigint").alias("conf_e2"), "occurrences")


@query(READ_SQL + " SELECT doc_id, text, CAST(reading_id AS BIGINT) AS line_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(text)) ORDER BY reading_id) AS n FROM r) WHERE n = 1")
def win_pooled_lines(spark, sf):
    """WIN-05, SET-02."""
    return readings.pooled_lines(_readings(spark, sf).withColumnRenamed("reading_id", "line_no").withColumn("rank", F.lit(1))).select("doc_id", "text", F.col("line_no").cast("bigint").alias("line_no"))


ITEMS_SQL = """WITH it AS (SELECT l_orderkey AS doc_id, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS ord, CAST(l_quantity AS BIGINT) AS quantity, CASE WHEN l_linenumber = 4 AND l_orderkey % 2 = 0 THEN sum(CAST(l_extendedprice AS DECIMAL(18, 2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE CAST(l_extendedprice AS DECIMAL(18, 2)) END AS price FROM lineitem)"""


def _items(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(_ord()).rowsBetween(Window.unboundedPreceding, -1)
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    before = F.sum(price).over(w).cast("decimal(18,2)")
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), _ord().alias("ord"), F.col("l_quantity").cast("bigint").alias("quantity"), F.when((F.col("l_linenumber") == 4) & (F.col("l_orderkey") % 2 == 0), before).otherwise(price).alias("price"))


@query(ITEMS_SQL + """, x AS (SELECT *, row_number() OVER w - 1 AS i, sum(price) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, count(*) OVER (PARTITION BY doc_id) AS n FROM it WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
  y AS (SELECT *, min(CASE WHEN i >= 2 AND n >= 3 AND abs(price - b) <= 0.02 THEN i END) OVER (PARTITION BY doc_id) AS cut FROM x) SELECT doc_id, ord, CAST(price * 100 AS BIGINT) AS cents FROM y WHERE cut IS NULL OR i < cut""")
def win_subtotal_cut(spark, sf):
    """WIN-02."""
    return items.cut_at_subtotal(_items(spark, sf)).select("doc_id", "ord", (F.col("price") * 100).cast("bigint").alias("cents"))


@query("""WITH s AS (SELECT l_orderkey AS doc_id, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS a, sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(l_quantity AS BIGINT)) AS b FROM lineitem GROUP BY 1),
  t AS (SELECT doc_id, n, a, b, CASE doc_id % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE a + 5 END AS target FROM s)
  SELECT doc_id, CASE WHEN abs(target - a) <= greatest(0.02, 0.01 * n) THEN 'line_total' WHEN abs(target - b) <= greatest(0.02, 0.01 * n) THEN 'unit_price' END AS basis FROM t""")
def itm_met_target(spark, sf):
    """ITM-01, AGG-05."""
    li = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_quantity").cast("bigint").alias("quantity"))
    k = F.col("doc_id") % 3
    s = items.sums(li).withColumn("target", F.when(k == 0, F.col("line_total")).when(k == 1, F.col("unit_price")).otherwise(F.col("line_total") + 5))
    return s.select("doc_id", items.met_target(F.col("n"), F.col("line_total"), F.col("unit_price"), F.array("target"))["basis"].alias("basis"))


SIM_SQL = """WITH v AS (SELECT vec_id, label, TIMESTAMP '1999-01-01' - to_days(CAST(vec_id % 120 AS INT)) AS created_at, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  p AS (SELECT a.vec_id AS query_id, b.vec_id AS receipt_id, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND b.created_at >= TIMESTAMP '1999-01-01' - INTERVAL 90 DAY),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, receipt_id) AS rank FROM p WHERE s >= 0.2)"""


def _store(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("receipt_id"), F.col("label").alias("source_service"), "embedding", (F.lit(NOW).cast("timestamp") - F.make_dt_interval((F.col("vec_id") % 120).cast("int"))).alias("created_at"))


@query(SIM_SQL + " SELECT query_id, receipt_id, CAST(rank AS INT) AS rank, CAST(round(s * 100000) AS BIGINT) AS s_e5 FROM k WHERE rank <= 10")
def joi_similar_vectors(spark, sf):
    """JOI-03, FLT-07, SRT-01: the stated queries are the vectors whose id is divisible by 50."""
    s = _store(spark, sf)
    return similarity.similar(s.where("receipt_id % 50 = 0"), s, NOW, threshold=0.2).select("query_id", "receipt_id", "rank", F.round(F.col("similarity") * 100000).cast("bigint").alias("s_e5"))


@query(SIM_SQL + " SELECT q.vec_id AS query_id, count(k.s) > 0 AS is_duplicate, CAST(round(max(k.s) * 100000) AS BIGINT) AS s_e5 FROM v q LEFT JOIN k ON q.vec_id = k.query_id WHERE q.vec_id % 50 = 0 GROUP BY 1")
def dup_verdicts(spark, sf):
    """DUP-01, DUP-02."""
    s = _store(spark, sf)
    q = s.where("receipt_id % 50 = 0")
    return similarity.verdicts(q, similarity.similar(q, s, NOW, threshold=0.2)).select("query_id", "is_duplicate", F.round(F.col("score") * 100000).cast("bigint").alias("s_e5"))


@query("""WITH c AS (SELECT label AS category, list_transform(range(1, 65), i -> avg_i) AS x FROM (SELECT label, 0.0 AS avg_i FROM embeddings) LIMIT 0),
  d AS (SELECT label AS category, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
  p AS (SELECT v.vec_id, d.category, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), d.e) AS s FROM embeddings v, d)
  SELECT vec_id, CASE WHEN max(s) >= 0.25 THEN CAST(max_by(category, s) AS STRING) ELSE 'Others' END AS category, CAST(round(max(s) * 100000) AS BIGINT) AS s_e5 FROM p GROUP BY vec_id""")
def cat_nearest_description(spark, sf):
    """JOI-04, CAT-01, NUM-06: the first vector of each label stands for a category's description."""
    e = _t(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(F.col("label").cast("string").alias("category"), "embedding")
    return category.by_vector(e.select("vec_id", "embedding"), first).select("vec_id", "category", F.round(F.col("similarity") * 100000).cast("bigint").alias("s_e5"))


OUT_SQL = """WITH o AS (SELECT o_orderkey AS doc_id, o_orderpriority AS print_type, o_orderstatus AS tier, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 10 END AS e, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 99 ELSE o_orderkey % 10 END AS p, o_orderkey % 3 <> 0 AS grounded FROM orders),
  c AS (SELECT *, CASE WHEN p IS NULL THEN CASE WHEN e IS NULL THEN 'abstained_ok' ELSE 'missed' END WHEN e = p THEN 'correct' WHEN p = 99 AND doc_id % 2 = 0 THEN 'confused' WHEN e IS NULL THEN 'fabricated' WHEN NOT grounded THEN 'ungrounded' ELSE 'wrong' END AS outcome FROM o)"""


def _outcomes(spark, sf):
    k = F.col("o_orderkey")
    df = _t(spark, sf, "orders").select(k.alias("doc_id"), F.col("o_orderpriority").alias("print_type"), F.col("o_orderstatus").alias("tier"), F.when(k % 7 != 0, (k % 10).cast("string")).alias("e"), F.when(k % 5 != 0, F.when(k % 11 == 0, "99").otherwise((k % 10).cast("string"))).alias("p"), (k % 3 != 0).alias("grounded"), F.when(k % 2 == 0, F.array(F.lit("99"))).alias("traps"))
    return df.withColumn("outcome", evaluation.outcome(F.lit("exact"), F.col("e"), F.col("p"), F.col("traps"), F.lit(None).cast("array<string>"), F.col("grounded")))


@query(OUT_SQL + " SELECT doc_id, outcome FROM c")
def evl_outcomes(spark, sf):
    """EVL-01, EVL-02, JOI-09."""
    return _outcomes(spark, sf).select("doc_id", "outcome")


@query(OUT_SQL + " SELECT print_type, count(*) AS scored, count(*) FILTER (outcome IN ('correct', 'abstained_ok')) AS passed, count(*) FILTER (outcome IN ('fabricated', 'ungrounded')) AS made_up, CAST(round(10000.0 * count(*) FILTER (outcome IN ('correct', 'abstained_ok')) / count(*)) AS BIGINT) AS accuracy_e4 FROM c GROUP BY 1")
def agg_field_tallies(spark, sf):
    """AGG-11, AGG-16, AGG-18."""
    return evaluation.tallies(_outcomes(spark, sf), "print_type").select("print_type", "scored", "passed", "made_up", F.round(F.col("accuracy") * 10000).cast("bigint").alias("accuracy_e4"))


@query(OUT_SQL + " SELECT print_type, tier, count(*) AS scored, count(*) FILTER (outcome IN ('correct', 'abstained_ok')) AS passed FROM c GROUP BY GROUPING SETS ((print_type), (tier))")
def agg_by_each(spark, sf):
    """AGG-13."""
    return evaluation.by_each(_outcomes(spark, sf), "print_type", "tier")


@query(OUT_SQL + ", f AS (SELECT outcome IN ('correct', 'abstained_ok') AS ok, doc_id % 4 = 0 AS fl FROM c) SELECT count(*) FILTER (NOT fl AND ok) AS safe_accept, count(*) FILTER (fl AND NOT ok) AS correct_flag, count(*) FILTER (fl AND ok) AS cautious, count(*) FILTER (NOT fl AND NOT ok) AS false_accept FROM f")
def agg_routing(spark, sf):
    """AGG-17."""
    df = _outcomes(spark, sf).select(F.col("outcome").isin("correct", "abstained_ok").alias("correct"), (F.col("doc_id") % 4 == 0).alias("flagged"))
    return evaluation.routing(df)


@query("""WITH s AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS ms FROM events WHERE value IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM s)
  SELECT event_type, any_value(n) AS n, min(ms) AS least, max(ms) AS most, CAST(round(median(ms) * 2) AS BIGINT) AS p50_x2, max(ms) FILTER (i = least(n - 1, CAST(floor(0.95 * n) AS BIGINT))) AS p95 FROM k GROUP BY 1""")
def agg_stage_timings(spark, sf):
    """AGG-19."""
    df = _t(spark, sf, "events").where("value is not null").select("event_type", F.round(F.col("value") * 100).cast("bigint").alias("ms"))
    return evaluation.timings(df, "event_type", "ms").select("event_type", "n", "least", "most", F.round(F.col("p50") * 2).cast("bigint").alias("p50_x2"), "p95")


@query("""SELECT doc_id, ord, p_ord, how FROM (SELECT e.l_orderkey AS doc_id, e.l_linenumber * 10000000000 + e.l_partkey * 10000 + e.l_suppkey AS ord, p.l_linenumber * 10000000000 + p.l_partkey * 10000 + p.l_suppkey AS p_ord, 'name' AS how FROM
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey) AS nth FROM lineitem) e JOIN
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus_name ORDER BY l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey) AS nth FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE 'Z' END AS l_linestatus_name FROM lineitem)) p ON e.l_orderkey = p.l_orderkey AND e.l_returnflag = p.l_linestatus_name AND e.nth = p.nth)""")
def joi_match_items_by_name(spark, sf):
    """JOI-08: the part of joi_match_items that SQL can express, one-to-one matching by name."""
    return joi_match_items(spark, sf).where("how = 'name'")


_LINE_ORD = "l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey"
#: Names of one letter are alike only if they are equal, so what is left after names is matched by price: expected items in order, each with the nearest price that is not taken.
MATCH_SQL = f"""WITH RECURSIVE e AS (SELECT l_orderkey AS doc_id, {_LINE_ORD} AS ord, l_returnflag AS name, CAST(l_extendedprice AS DOUBLE) AS price FROM lineitem), p AS (SELECT l_orderkey AS doc_id, {_LINE_ORD} AS p_ord, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE 'Z' END AS name, CAST(l_extendedprice AS DOUBLE) AS price FROM lineitem),
  named AS (SELECT a.doc_id, a.ord, b.p_ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY ord) AS nth FROM e) a JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY p_ord) AS nth FROM p) b ON a.doc_id = b.doc_id AND a.name = b.name AND a.nth = b.nth),
  er AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM e WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.doc_id = e.doc_id AND n.ord = e.ord)),
  pr AS (SELECT doc_id, list({{'p': p_ord, 'price': price}}) AS ps FROM p WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.doc_id = p.doc_id AND n.p_ord = p.p_ord) GROUP BY 1),
  st AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS p_ord FROM pr
   UNION ALL SELECT doc_id, k, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, p) END, ord, p FROM (SELECT st.doc_id, er.k, st.taken, CAST(er.ord AS BIGINT) AS ord,
     CAST(list_sort([{{'d': round(abs(x.price - er.price), 6), 'p': x.p}} for x in pr.ps if abs(x.price - er.price) <= 0.01 + 1e-9 AND NOT list_contains(st.taken, x.p)])[1].p AS BIGINT) AS p FROM st JOIN er ON er.doc_id = st.doc_id AND er.k = st.k + 1 JOIN pr ON pr.doc_id = st.doc_id))"""


@query(MATCH_SQL + " SELECT doc_id, ord, p_ord, 'name' AS how FROM named UNION ALL SELECT doc_id, ord, p_ord, 'price' FROM st WHERE p_ord IS NOT NULL")
def joi_match_items(spark, sf):
    """JOI-08: one-to-one matching by name, likeness and price."""
    li = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), _ord().alias("ord"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("name"), F.col("l_extendedprice").alias("price"))
    produced = li.withColumn("name", F.when(F.col("n") % 2 == 0, F.col("name")).otherwise("Z"))
    return evaluation.greedy_items(li, produced)


LOG_SQL = "WITH g AS (SELECT event_id // 4 AS job_id, event_id % 4 AS seq, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, ts + to_seconds(CAST(event_id % 4 AS INT)) AS updated_at, event_type, user_id FROM events)"


def _log(spark, sf):
    e = F.col("event_id")
    return _t(spark, sf, "events").select(F.floor(e / 4).cast("bigint").alias("job_id"), (e % 4).alias("seq"), F.when(e % 4 == 0, "queued").when(e % 4 == 1, "processing").when(e % 4 == 2, "completed").otherwise("failed").alias("status"), (F.col("ts") + F.make_dt_interval(secs=(e % 4).cast("decimal(18,6)"))).alias("updated_at"), F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")).alias("patch"))


@query(LOG_SQL + " SELECT job_id, max_by(status, (updated_at, seq)) AS status, max_by(event_type, (updated_at, seq)) AS kind, CAST(max_by(user_id, (updated_at, seq)) AS STRING) AS user_id FROM g GROUP BY 1")
def snk_latest_jobs(spark, sf):
    """SNK-02, STM-02, STM-03."""
    return jobs.latest(_log(spark, sf)).select("job_id", "status", F.col("fields")["kind"].alias("kind"), F.col("fields")["user"].alias("user_id"))


@query(LOG_SQL + ", b AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY updated_at, seq) AS before FROM g) SELECT job_id, seq, status, before FROM b WHERE NOT CASE WHEN before IS NULL THEN status IN ('queued', 'rejected') WHEN before = 'queued' THEN status IN ('processing', 'rejected') WHEN before = 'processing' THEN status IN ('completed', 'failed') ELSE false END")
def stm_broken_steps(spark, sf):
    """STM-02."""
    return jobs.broken_steps(_log(spark, sf)).select("job_id", "seq", "status", "before")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS started_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stm_windowed_counts(spark, sf):
    """STM-04: the windowed aggregate that the streaming job runs, over the whole table."""
    return jobs.windowed_counts(_t(spark, sf, "events")).select(F.unix_micros(F.col("window.start").cast("timestamp")).alias("started_us"), "event_type", "n")


@query("SELECT c_custkey, c_mktsegment AS word, CASE WHEN levenshtein(lower(c_mktsegment), 'building') <= 2 THEN 'building' WHEN levenshtein(lower(c_mktsegment), 'machine') <= 2 THEN 'machine' END AS nearest FROM customer")
def joi_nearest_word(spark, sf):
    """JOI-05."""
    near = text.nearest(F.lower("c_mktsegment"), F.array(F.lit("building"), F.lit("machine")))
    return _t(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("word"), near["w"].alias("nearest"))


@query(R + """ SELECT doc_id, n, regexp_matches(line, '\\p{L}.*\\p{L}.*\\p{L}.*\\p{L}.*\\p{L}') AND length(regexp_replace(line, '\\P{L}', '', 'g')) >= length(line) * 0.6 AND CASE WHEN solid < 2 THEN solid = 1 AND tokens <= 2 AND length(one) >= 4 ELSE odd <= solid * 0.34 END AS words FROM (
  SELECT doc_id, n, line, len(tk) AS tokens, len([t for t in tk if length(t) >= 3]) AS solid, [t for t in tk if length(t) >= 3][1] AS one, len([t for t in tk if length(t) >= 3 and regexp_matches(t, '[a-z][A-Z]')]) AS odd FROM (
  SELECT doc_id, n, trim(line) AS line, regexp_extract_all(trim(line), '[A-Za-z][A-Za-z.''&-]*') AS tk FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS n FROM receipts)))""")
def str_looks_like_words(spark, sf):
    """STR-02."""
    return plan.lines(rendered(spark, sf)).select("doc_id", F.col("line_no").alias("n"), text.looks_like_words(F.col("line")).alias("words"))


@query(R + ", x AS (SELECT doc_id, d, text, regexp_replace(text, '[^0-9]', '', 'g') AS s FROM receipts) SELECT doc_id, " + " OR ".join(f"contains(s, strftime(d, '{f}'))" for f in [a.replace(" ", "") for m in ("%m", "%-m") for k in ("%d", "%-d") for a in (f"{m}{k}%Y", f"{m}{k}%y", f"%Y{m}{k}", f"{k}{m}%Y", f"{k}{m}%y")]) + " OR (contains(lower(text), lower(strftime(d, '%b'))) AND contains(lower(text), strftime(d, '%-d'))) AS shown FROM x")
def dat_date_appears(spark, sf):
    """DAT-05, VER-01 for dates."""
    return rendered(spark, sf).select("doc_id", dates.appears(F.col("d"), F.col("text")).alias("shown"))


from . import answers, more, slips, streams, whole  # noqa: E402, F401  (register their queries)

__all__ = ["BEYOND_SQL", "ORACLES", "QUERIES"]
