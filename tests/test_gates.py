"""Gates, derived fields, paths, duplicates and reports on small cases."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from harborlens.functions import derive, gates, money, text
from harborlens.operators import cluster, duplicates, paths, reports
from harborlens.operators.shared import numbered
from harborlens.sources import scans


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_rounds_and_raises(spark):
    assert column(spark, ["Acme raises $50M to fuel growth", "pre seed", "Series B - II", "series c ext", "bridge", "none"], money.parse_round) == ["growth", "seed", "series_b_ext", "series_c_ext", None, None]
    got = column(spark, ["Acme raises $50M to fuel growth", "Acme raises $10M at $1.5B valuation", "Acme valued at $2bn", "raises concerns over $5M", "Acme to go public", "A fundraiser for $5M", "no money"], money.parse_fundraise)
    assert [g and tuple(g) for g in got] == [("growth", 5e7, None), (None, 1e7, 1.5e9), got[2] and tuple(got[2]), None, ("ipo", None, None), None, None]


def test_companies_from_headlines(spark):
    cases = {
        "Exclusive: Fashion startup Atorie raises $5M": "Atorie", "Acme Robotics, the maker of arms, secures $3M": "Acme Robotics", "Acme's rival raises $5M": None, "AI startup raises $5M": None,
        "The company launches": None, "Figma to go public": "Figma", "Peak Venture Partners closes fund": "Peak Venture Partners", "acme raises $1M": None, "Nothing here": None, None: None,
    }
    assert column(spark, list(cases), gates.company_from_headline) == list(cases.values())


def test_name_shapes(spark):
    people = {"Ann Lee": True, "Bob van Dyke": True, "J. R. Smith": True, "Managing Partner": False, "Stanford University": False, "Ann": False, "ann lee": False, "Dr Ann Lee": False, "Jean-Luc Picard": True, None: False}
    assert column(spark, list(people), gates.person_name) == list(people.values())
    companies = {"Acme Robotics": True, "Privacy Policy": False, "read more": False, "2024": False, "acmerobots.com": False, "A, B": False, "Four Words Title Cased Here": False, "x": False, "&quot;Acme": False, None: False}
    assert column(spark, list(companies), gates.company_name) == list(companies.values())
    assert column(spark, ["Acme Capital", "Ann Lee", "Fund LP II"], gates.entity_name) == [True, False, True]
    assert column(spark, ["AI startup", "Acme startup", "company", "Robotics"], gates.category_name) == [True, False, True, False]


def test_name_shapes_read_as_in_sql(spark):
    """Letters outside ASCII end a word, a line end isn't the end, a vertical tab is no blank, and Kelvin is a k: as RE2 has it."""
    names = ["Caf\u00e9co", "\u00c9CO", "co\u00e9", "Acme LLC\n", "Acme LLC \n", "Ann\x0bLee", "Ann  Lee", "Ann\nLee", "Acme\x0bOne\x0bTwo\x0bThree\x0bFour\x0bFive", "Acme coo\u212aies", "Acme coo\u212aie", "Soft\u00e9 seed", "Team\r\nof ours", "Ann Fund\u00e9", "\u00e9seed round.", "Press \u2028 kit"]
    q = lambda p: "'" + p.replace("'", "''") + "'"
    con = duckdb.connect()
    con.execute("create table t (i int, v varchar)")
    con.executemany("insert into t values (?, ?)", list(enumerate(names)))
    end = [r[0] for r in con.execute(f"select regexp_matches(trim(v), {q(gates.ENTITY_END)}) or regexp_matches(v, {q(gates.ENTITY_WORD)}) from t order by i").fetchall()]
    assert column(spark, names, gates.entity_name) == end and end[:2] == [True, True]
    for p in (*gates.NO_COMPANY_NAME, gates.FIRM_WORDS, gates.INSTITUTION, gates.HONORIFIC, gates.PARTICLE, gates.NAME_WORD, r"\s+", r"^.+$", r"[.!?]$"):
        want = [r[0] for r in con.execute(f"select regexp_matches(v, {q(p)}) from t order by i").fetchall()]
        assert column(spark, names, lambda c, p=p: c.rlike(text.re2(p))) == want, p


def test_places(spark):
    places = {"Singapore": (True, True), "Remote": (False, False), "Remote - Singapore": (True, True), "Austin, TX": (False, False), "London": (True, False), "": (False, False), None: (False, False)}
    got = list(zip(column(spark, list(places), gates.abroad), column(spark, list(places), gates.in_apac), strict=True))
    assert got == list(places.values())
    assert column(spark, ["CA", " ny ", "Singapore", None], gates.us_state) == [True, True, False, False]


def test_derived(spark):
    assert [tuple(x) if x else None for x in column(spark, ["$150,000 - $200,000", "S$ 5,000 to 6,000", "&amp;pound;no", "€40,000 – €50,000 hourly", "$9,000 - $1,000"], derive.salary)] == [
        (150000.0, 200000.0, "USD", "year"), (5000.0, 6000.0, "SGD", "year"), None, (40000.0, 50000.0, "EUR", "hour"), None,
    ]
    assert column(spark, ["Reg. as Acme Pte. Ltd. here", "Pte Ltd", ""], derive.sg_entity) == ["Reg. as Acme Pte. Ltd.", None, None]
    assert column(spark, ["CEO & Co-Founder", "General Partner", "nothing", "Board Member"], derive.role_in) == ["founder", "partner", None, "director"]
    assert column(spark, ["First. Second", "v1.2 is out. Yes", "One", "Why? x"], derive.first_sentence) == ["First.", "v1.2 is out.", "One", "Why?"]
    assert column(spark, ["n/a", '"makes robots."', "x" * 81, " "], derive.one_liner) == [None, "Makes robots.", None, None]
    route = column(spark, ["Oil and Gas", "REITS and Finance", "Quarry", None], lambda c: derive.industry_route(c)["disposition"])
    assert route == ["out_of_scope", "out_of_scope", "in_scope", "in_scope"]


def test_numbers_and_clusters(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k")
    assert [r.n for r in numbered(df, ["k"], "n").orderBy("k").collect()] == list(range(1000))
    items = spark.range(1, 7).withColumnRenamed("id", "i")
    pairs = spark.createDataFrame([(1, 3), (2, 3), (3, 5), (4, 5)], "left_id long, right_id long")
    # 1 takes 3, then 5 by 3; 2 and 4 come before 3 and 5 were members, and stay alone
    got = {r.i: r.cluster_id for r in cluster.greedy_clusters(items, pairs, "i").collect()}
    assert got == {1: 1, 3: 1, 5: 1, 2: 2, 4: 4, 6: 6}


def test_person_paths_split_hubs(spark):
    roles = spark.createDataFrame([(7, c, "r") for c in range(40)], "person_id long, company_id long, role string")
    links = spark.createDataFrame([("company", 3), ("person", 5)], "subject_type string, subject_id long")
    p = paths.person_paths(roles, links)
    assert p.count() == 40 * 39 and p.where("target_id = 3").select("score").distinct().count() == 1
    best = p.agg(F.max("score")).first()[0]
    assert abs(best - 1.4 / __import__("math").log2(41)) < 1e-12


def test_candidates_and_decisions(spark):
    rows = spark.createDataFrame(
        [(1, "acme robots", "a.com", "1", []), (2, "acme robots", "b.com", "2", []), (3, "acme robot", None, None, []), (4, "zeta", "a.com", None, ["acme robot"])],
        "id long, name string, domain string, cik string, aliases array<string>",
    )
    got = {(r.left_id, r.right_id): (r.signals, round(r.score, 3), r.caution) for r in duplicates.company_candidates(rows).collect()}
    assert got == {
        (1, 2): (["exact_normalized_name"], 0.5, "different_cik"), (1, 3): (["near_name"], 0.7, None), (2, 3): (["near_name"], 0.7, None), (1, 4): (["domain"], 0.95, None), (3, 4): (["alias"], 0.85, None),
    }
    decided = spark.createDataFrame([("company", 4, 1), ("person", 2, 1)], "entity_type string, kept_id long, dropped_id long")
    left = duplicates.undecided(duplicates.company_candidates(rows), decided, "company")
    assert {(r.left_id, r.right_id) for r in left.collect()} == set(got) - {(1, 4)}


def test_why_now_drops_what_is_told(spark):
    day = dt.datetime(2026, 1, 1)
    rows = [(1, 10, "Raised $360M credit facility · Opens plant", False, day, True), (1, 11, "Secured $360M revolving credit facility", False, day, False), (1, 12, "Hires country manager", True, None, False), (1, 13, "Signs deal with bank", False, day, False)]
    items = spark.createDataFrame(rows, "company long, item_id long, why string, job_board boolean, published_at timestamp, featured boolean")
    got = reports.why_now(items, "company").first()
    assert [p.text for p in got.points] == ["Raised $360M credit facility", "Opens plant", "Hires country manager", "Signs deal with bank"] and got.mixed


def test_csv_files_and_registry(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"investors_{n}.csv").write_text(f'name,city\n"{n}, Inc", x \n')
    got = scans.read_csv_files(spark, [str(tmp_path / "investors_*.csv")], ["name", "city"])
    assert {(r.name, r.city) for r in got.collect()} == {("a, Inc", "x"), ("b, Inc", "x")}
    companies = spark.createDataFrame([("Harvey",), ("Anysphere",)], "company string")
    registry = spark.createDataFrame([(i, f"HARVEY {w} PTE LTD") for i, w in enumerate(("NORMAN", "BUILD", "TRADE"))] + [(9, "ANYSPHERE SINGAPORE PTE. LTD.")], "uen long, name string")
    assert {(r.company, r.uen, r.match) for r in scans.registry_lookup(companies, registry).collect()} == {("Anysphere", 9, "confirmed")}


def test_person_strengths_are_those_of_the_paths(spark):
    """Lists of ordinary people, paths of those with many roles, and companies cut into slices: what grouping all paths says; nulls join nothing."""
    rows = [(p, (p * 7 + k * k) % 23, "r") for p in range(60) for k in range(p % 6)] + [(99, c % 40, "r") for c in range(80)] + [(5, None, "r"), (None, 3, "r"), (7, 400, "r")]
    roles = spark.createDataFrame(rows, "person_id long, company_id long, role string")
    links = spark.createDataFrame([("company", c) for c in (1, 2, 3, 3, 39)] + [("person", 4)], "subject_type string, subject_id long")
    told = lambda df: {r.company_id: (r.n, r.targets, round(r.best, 9), round(r.total, 6)) for r in df.collect()}
    wanted = told(paths.path_strengths(paths.person_paths(roles, links)))
    assert len(wanted) > 30
    for small in ({}, {"most": 10, "each": 1}, {"most": 10, "each": 1, "roles_of_company": 3}, {"most": 0, "lists": 1, "each": 1}):
        assert told(paths.person_strengths(roles, links, **small)) == wanted
