"""A generated corpus: receipts whose printed content is their truth, drawn by hashes of a seed and a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Templates, tiers with the share of the corpus up to and with each, rates of tax.
TEMPLATES = ("ph_vat_or", "ph_vat_pos", "ph_nonvat_si", "us_pos", "my_pos")
TIERS = (("clean", 0.4), ("moderate", 0.8), ("severe", 1.0))
VAT, SST, US_RATES = "0.12", "0.06", ("0.0625", "0.0725", "0.08", "0.0875")
MONEY = "decimal(18,2)"
#: What is sold, and how many different things at most.
GOODS, MOST_ITEMS = ("Bond Paper A4", "Chicken Meal", "Notebook", "Parking", "Room Night", "Printer Ink", "Coffee", "Taxi Fare"), 4
MONEY_FIELDS = ("net_sales", "tax_amount", "total_sales", "service_charge", "total_amount")


def draw(seed: Column, number: Column, what: str, size: int) -> Column:
    """A whole number under size, the same for the same seed, number and purpose in any engine that has MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), number.cast("string"), F.lit(what)).cast("binary")), 1, 7), 16, 10).cast("bigint") % size).cast("int")


def items_of(seed: Column, index: Column) -> Column:
    """One to four items: (name, quantity, price of one)."""
    d = lambda what, size: draw(seed, index, what, size)
    one = lambda j: F.struct(F.element_at(F.array(*map(F.lit, GOODS)), d(f"name{j}", len(GOODS)) + 1).alias("name"), (d(f"quantity{j}", 3) + 1).alias("quantity"), ((d(f"price{j}", 60000) + 500) / 100).cast(MONEY).alias("price"))
    return F.slice(F.array(*map(one, range(MOST_ITEMS))), F.lit(1), d("items", MOST_ITEMS) + 1)


def specs(numbers: DataFrame, count: Column, seed: int = 1, today: str = "1999-01-01", corrupt: bool = False) -> DataFrame:
    """numbers(index, at) as receipts: template, tier, date, items, and amounts that fit these and each other.

    at: the place among count receipts, which gives the tier; corrupt ones are VAT receipts whose printed tax is wrong.
    """
    s, d = F.lit(seed), lambda what, size: draw(F.lit(seed), F.col("index"), what, size)
    template = F.lit("ph_vat_or") if corrupt else F.element_at(F.array(*map(F.lit, TEMPLATES)), d("template", len(TEMPLATES)) + 1)
    place = F.col("at") / F.greatest(count, F.lit(1))
    tier = F.coalesce(*(F.when(place < share, name) for name, share in TIERS), F.lit("severe"))
    df = numbers.select("index", template.alias("template"), tier.alias("tier"), F.date_sub(F.lit(today).cast("date"), d("date", 900) + 1).alias("date"), items_of(F.lit(seed), F.col("index")).alias("items"), s.alias("seed"), d("rate", len(US_RATES)).alias("r"), d("service", 100).alias("sv"), d("customer", 100).alias("cu"), (d("number", 98999) + 1000).cast("string").alias("invoice_number"))
    df = df.withColumn("gross", F.aggregate("items", F.lit(0).cast(MONEY), lambda a, x: (a + x["quantity"] * x["price"]).cast(MONEY)))
    rate = F.element_at(F.array(*(F.lit(x).cast("decimal(6,4)") for x in US_RATES)), F.col("r") + 1)
    ph, nonvat, us = F.col("template").startswith("ph_"), F.col("template") == "ph_nonvat_si", F.col("template") == "us_pos"
    money = lambda c: F.round(c, 2).cast(MONEY)
    net = F.when(nonvat, F.col("gross")).when(ph, money(F.col("gross") / F.lit("1.12").cast("decimal(4,2)"))).otherwise(F.col("gross"))
    df = df.withColumn("net_sales", net)
    tax = F.when(nonvat, None).when(ph, F.col("gross") - F.col("net_sales")).when(us, money(F.col("net_sales") * rate)).otherwise(money(F.col("net_sales") * F.lit(SST).cast("decimal(4,2)")))
    df = df.withColumn("tax_amount", tax.cast(MONEY))
    df = df.withColumn("total_sales", F.when(ph, F.col("gross")).otherwise(F.col("net_sales") + F.col("tax_amount")).cast(MONEY))
    df = df.withColumn("service_charge", F.when((F.col("template") == "ph_vat_or") & (F.col("sv") < 45), money(F.col("net_sales") * F.lit("0.1").cast("decimal(2,1)"))))
    df = df.withColumn("total_amount", (F.col("total_sales") + F.coalesce("service_charge", F.lit(0).cast(MONEY))).cast(MONEY))
    country = F.when(ph, "PH").when(us, "US").otherwise("MY")
    df = df.withColumns({"country": country, "currency": F.when(ph, "PHP").when(us, "USD").otherwise("MYR"), "tax_type": F.when(nonvat, None).when(ph, "VAT").when(us, "SALES_TAX").otherwise("TAX"), "vat_classification": F.when(nonvat, "non-vat").when(ph, "vat"), "has_customer": ph & (F.col("cu") < 40), "corrupt": F.lit(corrupt)})
    printed = F.when(F.col("corrupt"), money(F.col("tax_amount") * F.lit("1.75").cast("decimal(3,2)") + 3)).otherwise(F.col("tax_amount"))
    return df.withColumn("printed_tax", printed.cast(MONEY)).drop("seed", "r", "sv", "cu", "gross")


def corpus(spark: SparkSession, count: int, corrupted: int = 0, seed: int = 1, today: str = "1999-01-01") -> DataFrame:
    """count sound receipts and corrupted ones whose printed tax contradicts their sales."""
    sound = specs(spark.range(count).select(F.col("id").alias("index"), F.col("id").alias("at")), F.lit(count), seed, today)
    bad = specs(spark.range(corrupted).select((F.col("id") + count).alias("index"), F.col("id").alias("at")), F.lit(corrupted), seed, today, corrupt=True)
    return sound.unionByName(bad)


def truth(spec: DataFrame) -> DataFrame:
    """The ground-truth document of each receipt as JSON with sorted keys: values, fields left out, values that must not be taken."""
    unknown = F.when(F.col("corrupt"), F.array_sort(F.array(F.lit("tax_rate"), *map(F.lit, MONEY_FIELDS)))).otherwise(F.array(F.lit("tax_rate")))
    expected = F.struct(*(F.col(c).cast("string").alias(c) for c in sorted(("country", "currency", "net_sales", "tax_amount", "tax_type", "total_sales", "service_charge", "total_amount", "vat_classification", "invoice_number")) ), F.col("date").cast("string").alias("transaction_date"))
    image = F.format_string("syn-%04d-%s-%s.jpg", F.col("index"), F.col("template"), F.col("tier"))
    doc = F.to_json(F.struct(F.col("tier").alias("degradation"), F.col("corrupt").alias("expect_manual_review"), F.col("corrupt").alias("expect_reconciliation_failure"), expected.alias("expected"), F.transform("items", lambda x: F.struct(x["name"].alias("name"), x["quantity"].alias("quantity"), (x["quantity"] * x["price"]).cast("string").alias("price"))).alias("expected_items"), image.alias("image"), F.lit("machine_printed").alias("print_type"), F.lit("synthetic").alias("source"), F.col("template").alias("template"), unknown.alias("unknown")), {"ignoreNullFields": "false"})
    return spec.select("index", image.alias("image"), doc.alias("document"))
