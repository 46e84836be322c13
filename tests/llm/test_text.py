import random
import re

import pytest
from collections import Counter

from pyspark.sql import functions as F

from tallyframe.llm.fertility import judge, repeated_words, script_of
from tallyframe.llm.html_blocks import extract, main_text
from tallyframe.llm.lang_mixture import identify_languages, keep_identified
from tallyframe.llm.toxicity_cnn import classify, keep_civil, threshold

from .corpus import SCHEMA, by_id, documents, empty, texts

PAGE = """<html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body><nav><a href=x>Home</a></nav>
<div class="ad">Buy</div><article><h1>Title &lt;one&gt;</h1><p>First  <b>bold</b>word &amp; more<br>next<p>Second&nbsp;one</p></article><div id="comments"><p>Me too</p></div><footer>&copy; x</footer></body></html>"""


def test_article_text():
    assert main_text(PAGE) == "Title <one> First boldword & more next Second one"
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("<article><p>cut o") == "cut o"


def test_page_without_an_article():
    body = "".join(f"<p>{'long text of the story ' * 6}{k}</p>" for k in range(5))
    page = f"<body><header>Site</header><ul class='menu'><li><a href=a>A</a><li><a href=b>B</a></ul><div id=content>{body}</div><form>Find <input></form><div class='comments'><p>{'a reader says ' * 9}</p></div></body>"
    assert main_text(page) == " ".join(f"{'long text of the story ' * 6}{k}" for k in range(5))


def kept_by_hand(weights, window=3, share=0.2, most=80):
    """Surge and dive line by line: walk from each rise to the dive after it."""
    n, half = len(weights), window // 2
    sums = [sum(weights[max(0, i - half) : i + half + 1]) for i in range(n)]
    keep, i = [False] * n, 0
    while i < n:
        if sums[i] == 0:
            i += 1
            continue
        j = i
        while j < n and sums[j] > 0:
            j += 1
        if any(s > min(most, share * max(sums)) for s in sums[i:j]):
            for k in range(i, j):
                keep[k] = weights[k] > 0
        i = j
    return keep


def test_windows_against_a_walk_over_the_lines():
    from tallyframe.llm.html_blocks import kept_lines

    r = random.Random(3)
    for _ in range(500):
        w = [r.choice([0, 0, 0, r.randint(1, 30), r.randint(1, 400)]) for _ in range(r.randint(0, 25))]
        assert kept_lines(w).tolist() == kept_by_hand(w)
    assert kept_lines([0, 5, 0, 0, 0, 300, 9, 0, 0, 0, 70, 0]).tolist() == [k in (5, 6, 10) for k in range(12)]  # 5 never gets past the threshold of 61.8


def test_the_windows_find_the_article_without_its_element(sf):
    import pyarrow.parquet as pq

    plain = lambda x: re.sub(r"(</?)(article|main)\b", r"\1div", x)
    pages = [x for x in pq.read_table(f"{sf}/pages.parquet")["html"].to_pylist() if x]
    assert pages and all(main_text(plain(x)) == main_text(x) != "" for x in pages)


def test_lists_of_links_and_short_parts():
    long = "".join(f"<p>{'long text of the story ' * 9}{k}</p>" for k in range(9))
    links = "".join(f"<div><a href={k}>elsewhere {k}</a></div>" for k in range(9))
    assert main_text(f"<body>{links}<p>Foot</p>{links}{long}{links}<p>Copyright</p></body>") == main_text(long)
    assert main_text(f"<body><div>{long}</div>{'<div class=ad>Buy</div>' * 5}<p>Yes.</p></body>").endswith(" Yes.")
    assert main_text(f"<article>{long}</article><div>Something else</div>") == main_text(long)


LONG = "".join(f"<p>{'long text of the story ' * 9}{k}.</p>" for k in range(4))
LINKS = "".join(f"<div><a href={k}>elsewhere {k}</a></div>" for k in range(9))


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>Real text <span class='advert'>BUY <b>NOW</b></span> goes on.</p></article>", "Real text goes on."),
        ("<article><p>Real <span class=ad>BUY</p><p>Next one.</p></article>", "Real Next one."),
        (f"<body><form id=aspnetForm><nav>Home</nav><article>{LONG}<p>End.</p></article></form></body>", main_text(LONG) + " End."),
        (f"<body><form id=aspnetForm><div>{LONG}</div><label>Search</label></form></body>", main_text(LONG)),
        (f"<body><div>{LONG}</div><form><label>Name</label><p>Fill in your name and send.</p></form></body>", main_text(LONG)),
        (f"<body><article>{LONG}</article>{LINKS}<article><p>Short</p></article></body>", main_text(LONG) + " Short"),
        (f"<body>{LONG}{LINKS}<p>Thanks for reading.</p></body>", main_text(LONG) + " Thanks for reading."),
        (f"<body>{LONG}<p><a href=x>The whole of this is a link</a></p>{LONG}</body>", f"{main_text(LONG)} The whole of this is a link {main_text(LONG)}"),
        ("<article><p>So <math><mi>x</mi><mo>+</mo><mn>1</mn></math> holds, <object data=y>a picture</object> too.</p></article>", "So x+1 holds, a picture too."),
        ("<article><p>Seen <noscript>without scripts</noscript> here.</p></article><noscript>Turn scripts on.</noscript>", "Seen without scripts here."),
        (f"<article><p>One.</p><div class='related-work'><p>{'Others have written on this at length. ' * 3}</p></div></article>", "One. " + " ".join(["Others have written on this at length."] * 3)),
        ("<article><p>One.</p><div class='related-posts'><a href=a>Ten best cats</a> <a href=b>More</a></div><div class=comments><p>I think that all of this is wrong, and that at great length indeed.</p></div></article>", "One."),
    ],
)
def test_the_contract_of_main_text(page, text):
    assert main_text(page) == text


def test_unclosed_items_end_with_their_container():
    for items in ("<ul>" + "<li>menu" * 100 + "</ul>", "<table>" + "<tr><td>x<td>y" * 100 + "</table>", "<dl>" + "<dt>x<dd>y" * 100 + "</dl>", "<div>" * 100):
        assert main_text(f"<body><nav>{items}</nav><article><p>The story</p></article></body>") == "The story"
    assert main_text("<article><ul><li class=ad>Buy<li>one<ul><li>two</ul><li>three</ul><p class=ad>Buy<p>four</article>") == "one two three four"


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 3), (1, "u", PAGE, 3), (2, None, None, 3), (None, "v", "", 3)], "page_id bigint, url string, html string, text int")
    got = extract(df).collect()
    assert len(got) == 4 and sorted(r["n_chars"] for r in got) == [0, 0, 49, 49]
    assert extract(df.limit(0)).count() == 0


def base_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    g = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if g[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_base_counts_and_verdicts(spark):
    rows = {**texts(), 400: "a #b |c|\na #b |c|\n\n\nx", 401: "p q r s t u v w " * 4}
    got = by_id(judge(documents(spark, rows)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: base_counts(t) for i, t in rows.items()}
    assert all(not r["kept"] for r in judge(documents(spark, rows)).where("base_failed").collect())
    assert judge(empty(spark)).count() == 0
    assert repeated_words(["a"] * 9) == 9 and repeated_words(["a"] * 8) == 0
    assert script_of("abc") == "latin" and script_of("привет ab") == "cyrillic" and script_of("日本語") == "other"


def test_bands_reject_outliers_only(spark):
    r = random.Random(1)
    words = ["the", "house", "water", "people", "other", "number", "sound", "little", "place", "year", "live", "give", "most", "very"]
    rows = {i: " ".join(r.choice(words) + str(r.randrange(30)) for _ in range(300)) for i in range(60)}
    rows[99] = " ".join("".join(chr(0x1F300 + r.randrange(200)) for _ in range(3)) + str(k) for k in range(220))
    got = by_id(judge(documents(spark, [(i, t) for i, t in rows.items()]).withColumn("lang", F.lit("en"))), "base_failed", "kept")
    assert all(k for i, (_, k) in got.items() if i != 99) and got[99] == (False, False)


LANGS = {"aa": "bab cab dab fab gab".split(), "bb": "zox vox mox kox lox".split()}


def labelled(spark, n=300):
    r, data = random.Random(2), []
    for i in range(n):
        lang = "aa" if i % 2 else "bb"
        w = [r.choice(LANGS[lang]) + r.choice(LANGS[lang]) for _ in range(r.randint(20, 60))]
        if i % 5 == 0:
            w[r.randrange(len(w))] = "vile"
            w.append("vile")
        data.append((i, " ".join(w), None if i % 11 == 0 else lang, "s", 1, 1, "x", i % 5))
    return spark.createDataFrame(data, SCHEMA)


def test_languages(spark):
    docs = labelled(spark).unionByName(documents(spark, {1000: None, 1001: "", 1002: "12 34 !!", 1003: " ".join(LANGS["aa"] * 12 + LANGS["bb"] * 4)}).withColumn("lang", F.lit(None).cast("string")))
    got = by_id(identify_languages(docs), "lang_pred", "score", "held_out", "n_langs")
    assert all(got[i][0] == ("aa" if i % 2 else "bb") for i in range(300)) and {h for _, _, h, _ in got.values()} == {True, False}
    assert [got[i][:2] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003][0] == "aa" and got[1003][3] == 2 and 0.65 < got[1003][1] < 0.85
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(300)) | {1003}
    assert identify_languages(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in identify_languages(documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark):
    docs = labelled(spark)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.when(F.col("doc_id") % 17 != 0, (F.col("doc_id") % 5 == 0).cast("int")).alias("toxic"))
    more = documents(spark, {1000: None, 1001: "", 1002: "vile words vile"})
    got = by_id(classify(docs.unionByName(more), labels.union(labels)), "predicted", "score", "held_out")
    assert all(0 <= s <= 1 and p == int(s >= 0.5) for p, s, _ in got.values()) and len(got) == 303
    assert sum(got[i][0] == int(i % 5 == 0) for i in range(300) if got[i][2]) >= 0.9 * sum(got[i][2] for i in range(300))
    assert sum(r["doc_id"] % 5 == 0 for r in keep_civil(docs, labels).collect()) <= 6
    assert {r["score"] for r in classify(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert classify(empty(spark), labels).count() == 0


def test_threshold_takes_the_middle_of_the_gap():
    import numpy as np

    assert threshold(np.array([3.0, 2.0, 0.0, -1.0]), np.array([1, 1, 0, 0]), np.ones(4)) == 1.0


def test_thresholds_use_every_labelled_document(spark, monkeypatch):
    import tallyframe.llm.toxicity_cnn as t

    docs = labelled(spark, 400)
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    seen, count = [], t.calibration_counts
    monkeypatch.setattr(t, "calibration_counts", lambda *a: seen.append(count(*a)) or seen[0])
    assert t.classify(docs, labels, most_toxic=24, most_clean=40).count() == 400
    outside = labels.where(t.fold_of(F.col("doc_id")) != 0)
    assert seen[0][:, 3].sum() == outside.count() - 48  # all but the fitted three of four of 64
    assert set(seen[0][:, 0].tolist()) == {0, 1} and set(seen[0][:, 2].tolist()) == {0, 1}


def test_outputs_against_filters_by_hand():
    import numpy as np

    import tallyframe.llm.toxicity_cnn as t

    r = np.random.default_rng(2)
    texts = ["some words to score", "", None, "one", " ".join(f"w{k % 7}" for k in range(60))]
    net = t.Cnn(50)
    model = {"net": net.p, "index": r.integers(0, 50, t.BUCKETS).astype(np.int32), "langs": r.normal(size=(t.GRAMS, 3)).astype(np.float32)}
    got, _ = t.scorer(model)(texts)
    for x, y in zip(texts, got):
        vectors = [net.p["e"][model["index"][t.buckets_of(w)]].sum(0) for w in t.WORD.findall(x or "")] + [np.zeros(t.SIZE)] * max(t.WIDTHS)
        out, place = float(net.p["c"][0]), 0
        for j, w in enumerate(t.WIDTHS):
            for f in range(t.FILTERS):
                values = [sum(vectors[i + k] @ net.p["w"][:, place + k, f] for k in range(w) if i + k < len(vectors)) for i in range(len(vectors))]
                out += max(0.0, max(values) + net.p["b"][j * t.FILTERS + f]) * net.p["o"][j * t.FILTERS + f]
            place += w
        assert abs(out - y) < 1e-4


def test_few_labels_flag_nothing_and_keep_the_order():
    import numpy as np

    from tallyframe.llm.toxicity_cnn import cuts_of

    counts = np.array([[0, 5, 1, 4], [0, 1, 0, 90]])
    assert cuts_of(counts, {0: 90, 1: 4}, 2) is None
    assert cuts_of(np.array([[0, 5, 1, 5], [0, 1, 0, 90]]), {0: 90, 1: 5}, 2) is not None


def test_toxicity_of_the_smallest_tables(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = by_id(classify(docs, labels), "held_out", "predicted")
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    held = [p for i, (h, p) in got.items() if h and i in clean]
    assert sum(held) <= 0.1 * len(held)


def test_a_set_of_five_languages():
    import numpy as np

    from tallyframe.llm.lang_mixture import choose

    blocks = np.full((50, 7), -60.0)
    blocks[np.arange(50), np.arange(50) % 5] = -20.0
    one = np.full((10, 7), -60.0)
    one[:, 6] = -20.0
    best, score, size = choose(np.concatenate([blocks, one]), np.full(60, 8.0), np.array([0, 50]))
    assert size.tolist() == [5, 1] and abs(score[0] - 0.2) < 0.01 and best[1] == 6


def test_more_than_five_hundred_languages(spark):
    from tallyframe.llm.lang_mixture import train

    docs = spark.createDataFrame([(5 * i + k, f"word{i} text{i}", f"l{i:03}") for i in range(505) for k in range(5)], "doc_id bigint, text string, lang string")
    assert len(train(docs)[0]) == 505


def test_mixtures_against_em_by_hand():
    import numpy as np

    from tallyframe.llm.lang_mixture import fit_mixtures

    r = np.random.default_rng(9)
    blocks, weight, start = r.normal(-30, 6, (23, 4)), r.integers(1, 9, 23).astype(float), np.array([0, 1, 9, 15])
    mix, like = fit_mixtures(blocks, weight, start, 12)
    for d, (a, b) in enumerate(zip(start, [*start[1:], 23])):
        p = [0.25] * 4
        for _ in range(12):
            new, total = [0.0] * 4, 0.0
            for i in range(a, b):
                joint = [p[k] * np.exp(blocks[i, k]) for k in range(4)]
                for k in range(4):
                    new[k] += weight[i] * joint[k] / sum(joint)
                total += weight[i]
            p = [x / total for x in new]
        assert np.allclose(mix[d], p, atol=1e-9)
        assert np.isclose(like[d], sum(np.log(sum(p[k] * np.exp(blocks[i, k]) for k in range(4))) for i in range(a, b)))


def test_bands_against_quartiles_by_hand(spark):
    import numpy as np

    from tallyframe.llm.fertility import ALL_SIZES, bands, measures

    r, words = random.Random(3), "some house water people other number sound little place".split()
    rows = [(i, " ".join(r.choice(words) + str(r.randrange(500)) for _ in range(r.choice([70, 150])))) for i in range(80)]
    got = measures(documents(spark, rows).withColumn("lang", F.lit("en")))
    limits = {x["size"]: x.asDict() for x in bands(got, width=1.5).collect()}
    data = got.toPandas()
    assert set(limits) == {ALL_SIZES, 6, 7}
    for size, lim in limits.items():
        some = data if size == ALL_SIZES else data[np.floor(np.log2(data["n_words"])) == size]
        for m in ("chars_per_token", "byte_share", "entropy_share"):
            q1, q3 = np.quantile(some[m].round(3), [0.25, 0.75])
            spread = max(q3 - q1, 0.01)
            assert np.isclose(lim[f"{m}_low"], q1 - 1.5 * spread) and np.isclose(lim[f"{m}_high"], q3 + 1.5 * spread)
