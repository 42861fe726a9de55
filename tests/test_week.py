"""The weekly relation on small tables, with nulls, empties and repeats."""

from datetime import date, datetime

from pyspark.sql import functions as F

from harborlens.operators import pages, reports, week


def test_weeks_of_items(spark):
    rows = [
        (1, "kept", datetime(2025, 1, 4), datetime(2025, 1, 4)),  # a Saturday, found at once
        (2, "kept", datetime(2025, 1, 3), datetime(2025, 1, 6)),  # found in the week after, published the day before it began
        (3, "kept", datetime(2024, 12, 20), datetime(2025, 1, 6)),  # found much later: its own week alone
        (4, "kept", None, datetime(2025, 1, 6)), (5, "dropped", datetime(2025, 1, 4), datetime(2025, 1, 4)), (6, "kept", None, None), (None, "kept", datetime(2025, 1, 4), None),
    ]
    df = spark.createDataFrame(rows, "company_id long, status string, published_at timestamp, fetched_at timestamp")
    got = {(r.company_id, str(r.week_of)) for r in week.weeks_of_items(df).collect()}
    assert got == {(1, "2025-01-04"), (2, "2024-12-28"), (2, "2025-01-04"), (3, "2024-12-14"), (4, "2025-01-04")}


def base(spark, which=None, **changed):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    day = datetime(2025, 1, 5)
    tables = {
        "signals": make([(1, date(2025, 1, 4), "v", 10, 3, 2, 1), (2, date(2025, 1, 4), "v", 20, 1, 1, 1), (1, date(2024, 12, 28), "v", 11, 0, 0, 0), (3, date(2025, 1, 4), "old", 30, 1, 1, 1)], "company_id long, week_of date, version string, item_id long, expansion int, momentum int, partnership int"),
        "companies": make([(1, "Acme", ["x"], None, None), (2, "Beta", None, "in_scope", "news"), (3, "C", [], None, None)], "company_id long, company_name string, sectors array<string>, scope_status string, discovered_via string"),
        "items": make([(10, 1, "kept", 10, "t", "s", day, day), (12, 1, "kept", 10, "t", "s", day, day), (20, 2, "kept", None, "u", "s", None, day), (11, 1, "kept", None, "w", "s", datetime(2024, 12, 29), day)], "item_id long, company_id long, status string, cluster_id long, title string, source string, published_at timestamp, fetched_at timestamp"),
        "assessments": make([(1, day, "low", "a"), (1, datetime(2025, 2, 1), "high", "b")], "company_id long, assessed_at timestamp, priority string, fit string"),
        "path_reviews": make([(1, "confirmed", None, "met", day), (1, "confirmed", True, "no", datetime(2026, 1, 1)), (1, "open", False, "x", day)], "company_id long, status string, do_not_use boolean, note string, confirmed_at timestamp"),
        "roles": make([(1, 5), (1, 5), (1, 6)], "company_id long, person_id long"),
        "people": make([(5, "Ann Lee", None, "p"), (6, "Our Mission", "e", None)], "person_id long, name string, email string, profile string"),
        "opportunities": make([(2, "o", "open", day, 1), (1, "x", "closed", day, 2)], "company_id long, owner string, status string, created_at timestamp, opportunity_id long"),
        "reviews": make([(2, True, day)], "company_id long, hide boolean, resolved_at timestamp"),
        "dismissals": make([(1, False, datetime(2024, 6, 1))], "company_id long, permanent boolean, dismissed_at timestamp"),
    }
    tables |= changed
    return {(r.company_id, str(r.week_of)): r for r in week.weekly_base(**tables, version="v", week=which, hidden_sectors=("funds",)).collect()}


def test_weekly_base(spark):
    got = base(spark, "latest")
    assert set(got) == {(1, "2025-01-04"), (2, "2025-01-04")}
    a, b = got[1, "2025-01-04"], got[2, "2025-01-04"]
    assert (a.priority, a.fit, a.cluster_size, a.warm_path, [c.name for c in a.contacts], a.opportunity_owner) == ("high", "b", 2, "met", ["Ann Lee"], None)
    assert (b.priority, b.cluster_size, b.warm_path, b.contacts, b.opportunity_owner) == (None, 0, None, None, "o")
    assert set(base(spark)) == {(1, "2025-01-04"), (2, "2025-01-04"), (1, "2024-12-28")}
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    assert set(base(spark, "latest", reviews=one([(2, True, None)], "company_id long, hide boolean, resolved_at timestamp"))) == {(1, "2025-01-04")}
    gone = "company_id long, permanent boolean, dismissed_at timestamp"
    assert set(base(spark, "latest", dismissals=one([(1, True, datetime(2020, 1, 1))], gone))) == {(2, "2025-01-04")}
    assert set(base(spark, "latest", dismissals=one([(1, False, datetime(2025, 3, 1))], gone))) == {(2, "2025-01-04")}
    firms = "company_id long, company_name string, sectors array<string>, scope_status string, discovered_via string"
    assert base(spark, "latest", companies=one([(1, "A", ["funds"], None, None), (2, "B", None, None, "portfolio")], firms)) == {}
    empty = spark.createDataFrame([], "company_id long, week_of date, version string, item_id long, expansion int, momentum int, partnership int")
    assert base(spark, "latest", signals=empty) == {} == base(spark, None, signals=empty)


def test_cascade(spark):
    rows = [
        ("https://zacks.com/a", "x", "10 best firms", "s", 1, ["Acme"], "news", None), ("u", "s", "Acme opens", None, 1, ["Acme"], "news", datetime(2025, 1, 1)), ("u", "s", "Acme opens", None, 1, None, "news", datetime(2024, 1, 1)),
        ("u", "s", "A tariff", None, None, None, "context", datetime(2025, 1, 1)), (None, None, None, None, None, None, None, None), ("u", "s", "Roles", "x", 1, ["Acme"], "ats", None),
    ]
    df = spark.createDataFrame(rows, "url string, source string, title string, snippet string, company_id long, terms array<string>, source_type string, published_at timestamp")
    got = [(r.dropped_reason, r.status) for r in week.filter_cascade(df, F.lit(datetime(2025, 1, 9))).collect()]
    assert got == [("blocked_domain:zacks.com", "dropped"), (None, "kept"), ("older_than_30d", "dropped"), (None, "context"), ("no_company_match", "dropped"), (None, "kept")]


def test_sibling_context(spark):
    day = lambda n: datetime(2025, 1, n)
    plain = "item_id long, source string, url string, source_type string, published_at timestamp, fetched_at timestamp"
    cited = spark.createDataFrame([(1, "cited", "c", "news", day(1), day(1)), (9, "cited", "c", "news", None, day(1))], plain)
    rep = spark.createDataFrame([(7, "rep", 1, "rep", "r", "filing", day(1), day(1)), (7, "rep", 2, "rep", "r", "news", None, day(9))], "company_id long, why string, " + plain)
    scored = spark.createDataFrame([(7, "sc", 1, "s", "s", "news", day(1), day(1)), (7, "sc", 3, "s", "s", "news", day(8), None), (8, "sc", 4, "s", "s", "news", None, None), (8, "sc", 5, "s", "s", "news", day(2), None)], "company_id long, why string, " + plain)
    siblings, sources = pages.sibling_context(cited, rep, scored, F.lit(day(3)), F.lit(day(9)), most=3)
    got = {(r.company_id, r.item_id): (r.why, r.source_type, r.fetched) for r in siblings.collect()}
    assert got == {(7, 1): ("rep", "filing", False), (7, 2): ("rep", "news", True), (7, 3): ("sc", "news", True), (8, 5): ("sc", "news", False)}  # 4 has no date and comes last
    assert {r.item_id: (r.source, str(r.day)) for r in sources.collect()} == {1: ("cited", "2025-01-01"), 9: ("cited", "None"), 2: ("rep", "None"), 3: ("s", "2025-01-08"), 5: ("s", "2025-01-02")}


def test_reasons_of_a_key_with_very_many(spark):
    rows = [(1, i, f"point{i} word{i % 50} thing{i % 7}", i % 2 == 0, datetime(2025, 1, 1), i == 17) for i in range(3_000)] + [(2, 5, None, False, None, False)]
    got = {r.k: r for r in reports.why_now(spark.createDataFrame(rows, "k int, item_id long, why string, job_board boolean, published_at timestamp, featured boolean"), "k").collect()}
    assert [p.item_id for p in got[1].points][0] == 17 and len(got[1].points) == 4


def test_small_rules(spark):
    row = spark.createDataFrame([(" Big ", "HQ", None, ["a"], datetime(2025, 1, 1, 23, 30))], "w string, hq string, area string, s array<string>, at timestamp")
    got = row.select(
        week.known_word(F.col("w"), ("big",)), week.known_word(F.col("hq"), ("big",), "other"), week.in_place(F.col("hq"), F.col("area"), F.col("s")),
        week.in_place(F.col("hq"), F.col("area"), F.col("s"), "HQ", "all", "a"), week.cap_day(F.col("at")),
    ).first()
    assert tuple(got) == ("big", "other", False, True, date(2025, 1, 1))
