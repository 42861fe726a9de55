"""Guessed addresses and what their pages prove, and registries of sources."""

from pyspark.sql import functions as F

from harborlens.sources import sites


def test_candidates(spark):
    rows = spark.createDataFrame([("Bright River Labs, Inc.",), ("Daré",), ("The Co",), ("",), (None,)], "n string")
    got = [r[0] for r in rows.select(sites.candidate_domains(F.col("n"))).collect()]
    assert got[0][:7] == ["brightriverlabs.com", "brightriverlabs.ai", "brightriverlabs.io", "brightriverlabs.co", "brightriverlabs.tech", "brightriverlabs.bio", "brightriver.com"]
    assert len(got[0]) == 14 and got[1] == [f"dare.{e}" for e in sites.ENDINGS] and not got[2] and not got[3] and not got[4]


def test_verdicts(spark):
    prose = "Aslan Works makes instruments for people who measure. " * 4
    rows = [
        ("Aslan Works", "x.com", "Home", "d", prose, "verified"), ("Aslan Works", "x.com", None, None, prose, "thin"), ("Aslan Works", "x.com", " Coming soon", "d", prose, "dead"), ("Aslan Works", "x.com", "t", "Buy this domain", prose, "parked"),
        ("Aslan Works", "x.com", "t", "d", "Aslan Works", "empty"), ("Aslan Works", "x.com", "t", "d", None, "empty"), ("Aslan Moves", "x.com", "t", "d", prose, "partial"), ("Aslan", "aslan.ai", "t", "d", prose, "verified"),
        ("Aslan", "aslan-defense.com", "t", "d", prose, "verified"), ("Aslan", "myaslan.com", "t", "d", prose, "stem"), ("The Co", "x.com", "t", "d", prose, "nameless"), ("Aslanworks Inc", "x.com", "t", "d", prose, "stem"),
    ]
    df = spark.createDataFrame(rows, "n string, d string, t string, m string, x string, want string")
    assert [(r.got, r.want) for r in df.withColumn("got", sites.site_verdict(*(F.col(c) for c in "ndtmx"))).collect() if r.got != r.want] == []


def test_sources(spark):
    rows = [("b", "feed", True, ["ai"], "u"), ("a", "feed", None, None, "u"), ("c", "feed", False, None, "v"), ("d", "fund", True, ["ai"], "w"), ("e", "feed", True, ["energy"], "x"), ("f", "feed", True, [], None)]
    df = spark.createDataFrame(rows, "source string, kind string, enabled boolean, sectors array<string>, url string")
    assert [tuple(r) for r in sites.enabled_sources(df, ["feed"], ["ai"]).collect()] == [("a", "feed", "u")]
    assert sites.enabled_sources(df).count() == 3


def test_every_guess_is_tried(spark):
    """The page at the last guess counts too, and neither pages nor guesses are sent through the driver."""
    names = spark.createDataFrame([("Bright River Labs, Inc.",)], "company string")
    pages = spark.createDataFrame([("bright-river-labs.bio", "Home", "We build", "Bright River Labs builds plants. " * 12)], "domain string, title string, description string, text string")
    found = sites.resolved_sites(names, pages)
    assert [tuple(r) for r in found.collect()] == [("Bright River Labs, Inc.", "bright-river-labs.bio", "verified")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
