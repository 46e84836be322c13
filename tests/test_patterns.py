"""Patterns of many alternatives against the plain ones, and what a query does not pay for."""

import random
import re

from pyspark.sql import functions as F

from tallyframe.functions.patterns import alternatives, any_of, literal, prefixes, says
from tallyframe.operators import anchors, headers, layout, locale
from tallyframe.plans.queries import QUERIES


def texts(words, n=2000):
    r = random.Random(7)
    bits = [w[: r.randint(1, len(w))] for w in words] + list(words) + [" ", "-", "x", ".", "1"]
    return ["".join(r.choices(bits, k=r.randint(0, 6))) for _ in range(n)]


def test_words_are_found_where_plain_alternatives_find_them():
    for words in (headers.ADDRESS, headers.EXCLUDED, headers.OWNER, ("a", "ab"), ("[x]", "x-y")):
        plain, quick = re.compile("|".join(map(re.escape, words))), re.compile(any_of(words))
        assert all(bool(plain.search(t)) == bool(quick.search(t)) for t in texts(words))
    words = [k for ks in layout.LABELS.values() for k in ks]
    plain, quick = re.compile("|".join(map(re.escape, sorted(words, key=len, reverse=True)))), re.compile(prefixes(words))
    assert all(plain.findall(t) == quick.findall(t) for t in texts(words))


def test_letters_that_every_match_has():
    assert [literal(a) for a in alternatives(r"sdn\.?\s*bhd|(?:a|b)cd|[ab|]x?y*z|\$\s*\d")] == ["sdn", "cd", "z", ""]


def test_evidence_is_found_as_by_its_patterns(spark):
    ps = [p for p, *_ in locale.EVIDENCE] + [locale.INCLUSIVE, locale.EXCLUSIVE, r"(?i)total due|\bTIN\b"]
    words = [literal(a) for p in ps for a in alternatives(p)] + [" ", "vat", " reg", " tax", "of", "(b)", "ın", "İ", "CITY", "Tin"]
    df = spark.createDataFrame([(t,) for t in [*texts(words, 300), None]], "t string")
    assert df.select(*(F.count_if(~says(F.col("t"), p).eqNullSafe(F.regexp_like("t", F.lit(p)))).alias(f"p{k}") for k, p in enumerate(ps))).first() == tuple(0 for _ in ps)
    shapes = spark.createDataFrame([("Springfield, IL 62704 (217) 555-0142",), ("IL 62704",), (", IL",), ("x, ILL",), ("(217) 555",), (None,)], "t string")
    assert shapes.where(~F.array(*(locale._shaped(F.col("t"), p) for p, _ in locale.US_SHAPES)).eqNullSafe(F.array(*(F.regexp_like("t", F.lit(p)) for p, _ in locale.US_SHAPES)))).count() == 0


def test_a_keyword_that_begins_inside_another_counts(spark):
    at = lambda n: "vatax".ljust(n) + "1.00"
    df = spark.createDataFrame([(at(65),), (at(66),), ("",), ("9.99",), (None,)], "t string").select(anchors.money_near(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [1, 0, 0, 0, None]


def test_money_does_not_pay_for_anchors(spark, sf):
    assert "cashier" not in QUERIES["mon_resolve_money"](spark, sf)._jdf.queryExecution().executedPlan().toString()
