"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, found string, k int"


def texts(seed=3, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(2, 7)))
    passage = " ".join(word() for _ in range(70))
    base = [word() for _ in range(120)]
    out = {}
    for i in range(n):
        w = [word() for _ in range(r.randint(5, 150))]
        if i % 4 == 1:
            w = w[:20] + passage.split() + w[20:]
        if i % 4 == 2:
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
        out[i * 3] = " ".join(w) + ("\n" + word() if i % 3 else "")
    out[200] = out[201] = out[3]
    out[202] = ""
    out[203] = None
    out[204] = "one two"
    out[205] = "ONE two"
    out[206] = "x" * 5000 + " " + "ab " * 900
    out[207] = "  \n\t "
    out[208] = "día 😀 ﷺ " * 30
    out[209] = passage[:150]
    return out


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i, t, None if (i or 0) % 7 == 0 else "en", "src", None, 1, "x", 2) for i, t in (rows.items() if isinstance(rows, dict) else rows)]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return documents(spark, {}).where(F.lit(False))


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}
