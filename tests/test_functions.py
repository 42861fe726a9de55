"""Column functions against known facts and properties."""

import random

import pytest
from pyspark.sql import functions as F

import facts as truth
from harborlens.functions import dates, filters, money, text


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_names(spark):
    assert column(spark, [r[0] for r in truth.NAMES], text.normalise_company) == [r[1] for r in truth.NAMES]
    assert column(spark, ["Dr. José Álvarez Jr", "Ann Lee PhD", None], text.normalise_person) == ["dr jose alvarez", "ann lee", ""]
    once = column(spark, [r[0] for r in truth.NAMES], text.normalise_company)
    assert column(spark, once, text.normalise_company) == once


def test_urls_and_domains(spark):
    got = column(spark, [r[0] for r in truth.URLS] + [None], text.canonical_url)
    assert got == [r[1] for r in truth.URLS] + [None]
    assert column(spark, got, text.canonical_url) == got
    assert column(spark, ["https://www.Foo.com/bar", "Unknown", None], text.bare_domain) == ["foo.com", None, None]
    assert column(spark, ["https://www.Foo.com/bar?x", "Unknown", ""], text.normalise_domain) == ["foo.com", "unknown", None]


def test_titles(spark):
    got = column(spark, ["A deal - Big - News Wire", "No publisher", "x - ab-c"], text.split_publisher)
    assert [tuple(r) for r in got] == [("A deal - Big", "News Wire"), ("No publisher", None), ("x - ab-c", None)]
    assert column(spark, ["abc", "a", ""], text.trigrams) == [[" ab", "abc", "bc "], [" a "], []]
    terms = column(spark, ["Perplexity's raise of $1.5 billion and 30 staff at Acme in 2025", "the new plan"], text.key_terms)
    assert terms[0] == ["num:1.5b", "num:2025", "perplexity", "acme"] and terms[1] == []


def test_set_measures(spark):
    rng = random.Random(1)
    rows = [([rng.choice("abcdef") for _ in range(rng.randrange(5))], [rng.choice("abcdef") for _ in range(rng.randrange(5))]) for _ in range(40)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", text.jaccard(F.col("a"), F.col("b")).alias("j"), text.jaccard(F.col("b"), F.col("a")).alias("k"))
    for r in df.collect():
        a, b = set(r.a), set(r.b)
        assert r.j == r.k == (len(a & b) / len(a | b) if a and b else 0)


def test_cells(spark):
    assert column(spark, ["a | b||", "", None], text.pipe_list) == [["a", "b"], [], []]
    assert column(spark, ["$1,250.5", "", "x", "0"], text.million_usd) == [1251, None, None, 0]
    assert [str(d) for d in column(spark, ["2024", "2024-05", "2024-05-06", "May"], text.partial_date)] == ["2024-01-01", "2024-05-01", "2024-05-06", "None"]
    assert column(spark, [1.2e9, 350e6, 20e3, 0.0, None], text.usd_label, "double") == ["$1.2B", "$350M", "$20K", "Unknown", "Unknown"]
    assert column(spark, ["&lt;b&gt;Hi&lt;/b&gt; &amp;amp; bye"], text.clean_snippet) == ["Hi & bye"]
    assert column(spark, ["<p>a<script>x<y</script>b</p>"], text.visible_text) == ["a b"]


def test_dates(spark):
    got = column(spark, [r[0] for r in truth.EVENT_DATES], dates.date_range)
    assert [(str(g.starts_on), str(g.ends_on)) if g else (None, None) for g in got] == [r[1:] for r in truth.EVENT_DATES]
    days = ["2026-07-04", "2026-07-07", "2026-07-10", "2026-07-11"]
    assert [str(d) for d in column(spark, days, lambda c: dates.week_of(c.cast("date")))] == ["2026-07-04", "2026-07-04", "2026-07-04", "2026-07-11"]
    asof = F.lit("2026-03-01").cast("date")
    assert column(spark, ["https://x.com/show-2026/", "https://x.com/2019/id20260", "x/2031"], lambda c: dates.year_in_url(c, asof)) == [2026, None, None]
    assert column(spark, ["2026-05-01", "2026-02-01", "2027-12-01", None], lambda c: dates.in_planning_window(c.cast("date"), asof)) == [True, False, False, True]


def test_money(spark):
    got = column(spark, [r[0] for r in truth.FUNDRAISES], money.parse_fundraise)
    assert [tuple(g) if g else (None, None, None) for g in got] == [r[1:] for r in truth.FUNDRAISES]
    assert column(spark, [r[0] for r in truth.ROUNDS], money.round_stage) == [r[1] for r in truth.ROUNDS]
    assert column(spark, ["$20.8M", "€4.3 million", "$1.2B at a $10B", "none"], money.headline_raise) == [20.8, 4.3, 1200.0, None]


def test_filters(spark):
    df = spark.createDataFrame([r[:3] for r in truth.REGISTRY], "c string, r string, n int")
    got = df.select(filters.registry_match(F.col("c"), F.col("r"), F.col("n"))).collect()
    assert [g[0] for g in got] == [r[3] for r in truth.REGISTRY]
    urls = ["https://www.fool.com/x", "https://a.msn.com", "https://notfool.com", "fool.com", None]
    assert column(spark, urls, filters.blocked_domain) == ["fool.com", "msn.com", None, None, None]
    assert column(spark, ["10 Best phones", "What is AI?", "Acme opens"], filters.junk_reason) == ["listicle", "explainer", None]
    assert column(spark, ["Bloomberg", "Business Wire", "Blog", "OpenPR"], filters.source_authority) == [40, 90, 50, 10]
    m = spark.createDataFrame([("D Matrix raises", ["d-Matrix"]), ("Daré wins", ["Dare"]), ("Metabolic rate", ["Meta"]), ("x", [])], "t string, n array<string>")
    assert [r[0] for r in m.select(filters.mentions(F.col("t"), F.col("n"))).collect()] == [True, True, False, True]
    v = spark.createDataFrame([(None, 50), (3, 4), (19, 40), (20, 25), (20, 26), (40, 45)], "a int, b int")
    assert [r[0] for r in v.select(filters.volume_trigger(F.col("a"), F.col("b"))).collect()] == [False, False, False, False, True, False]


@pytest.mark.parametrize("place, country", [("Greater Tokyo", "Japan"), ("Remote, UK", "United Kingdom"), ("Nowhere", None)])
def test_countries(spark, place, country):
    assert column(spark, [place], filters.country_of) == [country]


def test_profiles(spark):
    rows = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(truth.PROFILES)], "id long, website string, headline string, url string, country string, rounds array<double>")
    got = rows.orderBy("id").select(money.profile_agrees(*(F.col(c) for c in ("website", "headline", "url", "country", "rounds")))).collect()
    assert [g[0] for g in got] == [r[5] for r in truth.PROFILES]


def brute_json(raw):
    """A reply's JSON by going through its signs one by one."""
    import re

    if raw is None:
        return None
    if fenced := re.search(r"```(?:json)?\s*([\s\S]*?)```", raw):
        return fenced[1].strip()
    start = min((i for i in (raw.find("{"), raw.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    ends, depth, said, skip = {"{": "}", "[": "]"}[raw[start]], 0, False, False
    for i in range(start, len(raw)):
        c = raw[i]
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            said = not said
        elif not said:
            depth += (c == raw[start]) - (c == ends)
            if depth == 0:
                return raw[start : i + 1]
    return None


def test_balanced_json(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice(['{', '}', '[', ']', '"', "\\", "a", "é", "\n", " ", '\\"', '"x": ']) for _ in range(rng.randrange(25))) for _ in range(400)]
    texts += ['{"a": "' + "x{" * 20_000 + '"} rest', "{" * 5_000 + "}" * 5_000 + "x", "[" * 3_000, None, "", "none", "{\\", "```\n{1}\n```", "```json [1, 2] ``` {", "a { b } c { d }"]
    assert column(spark, texts, text.balanced_json) == [brute_json(t) for t in texts]
