"""Operators on small tables: writes, rankings, candidates, clusters, feeds, streams."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from harborlens.operators import cluster, graph, latest, placement, resolve, shared
from harborlens.plans import catalogue
from harborlens.sources import feeds
from harborlens.sources.boards import board_jobs
from harborlens.streaming import weekly


def test_latest_and_writes(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 5, "n")], "k int, v int, x string")
    assert {(r.k, r.x) for r in latest.latest_by(df, ["k"], [F.desc("v")]).collect()} == {(1, "b"), (2, "c"), (None, "n")}
    new = spark.createDataFrame([(2, 9, "d"), (3, 1, "e"), (3, 2, "f")], "k int, v int, x string")
    put = latest.insert_ignore(df, new, ["k"], [F.col("v")])
    assert sorted((r.k or 0, r.x) for r in put.collect()) == [(0, "n"), (1, "a"), (1, "b"), (2, "c"), (3, "e")]
    up = latest.upsert(df, new, ["k"], [F.desc("v")])
    assert {(r.k, r.x) for r in up.collect()} == {(None, "n"), (1, "b"), (2, "d"), (3, "f")}


def test_interleaved_batches(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 5), ("b", 2), ("c", 1)) for i in range(n)], "g string, i int")
    got = [(r.g, r.batch) for r in latest.interleaved_batches(df, "g", ["i"], 3).orderBy("place").collect()]
    assert got == [("a", 0), ("b", 0), ("c", 0), ("a", 1), ("b", 1), ("a", 1), ("a", 2), ("a", 2)]


def test_graph(spark):
    e = spark.createDataFrame([("h", 1), ("h", 2), ("h", 2), ("g", 1)], "hub string, c int")
    assert {(r.source, r.target, r.degree) for r in graph.shared_hub_paths(e, "hub", "c").collect()} == {(1, 2, 2), (2, 1, 2)}
    told = spark.range(1).select(
        graph.edge_sentence(F.lit("A"), F.lit("acquired"), F.lit("B"), F.lit(False)), graph.edge_sentence(F.lit("A"), F.lit("co_built"), F.lit("B"), F.lit(True))
    ).first()
    assert tuple(told) == ("A was acquired by B.", "A is linked to B (co built).")


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_candidates_find_all_pairs(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abc") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    got = {(r.left_id, r.right_id) for r in resolve.edit_candidates(spark.createDataFrame(list(enumerate(names)), "i int, n string"), "i", "n").collect()}
    want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and a != b and min(len(a), len(b)) >= 6 and brute_edits(a, b) <= 2}
    assert got == want


def test_jaccard_candidates_find_all_pairs(spark):
    rng = random.Random(3)
    sets = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 7))]) for i in range(50)]
    df = spark.createDataFrame(sets, "i int, s array<string>")
    for threshold in (0.5, 0.75):
        got = {(r.left_id, r.right_id) for r in resolve.jaccard_candidates(df, "i", "s", threshold).collect()}
        want = {(i, j) for i, a in sets for j, b in sets if i < j and a and b and len({*a} & {*b}) / len({*a} | {*b}) >= threshold}
        assert got == want


def test_sets_of_common_elements_meet_in_cells(spark):
    """The pairs of a block, whether it is one chunk or cut into many, with no candidate shuffled; copies of a headline are paired after the headlines are."""
    rng = random.Random(5)
    sets = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 9))], rng.choice(["x", "x", "y"]), rng.random() < 0.4) for i in range(120)]
    df = spark.createDataFrame(sets, "i long, s array<string>, b string, f boolean")
    for threshold in (0.5, 0.7):
        want = {(i, j): len({*a} & {*b}) / len({*a} | {*b}) for i, a, x, f in sets for j, b, y, g in sets if i < j and x == y and (f or g) and a and b}
        want = {p: round(v, 9) for p, v in want.items() if v >= threshold - 1e-12}
        for most in (5, 20, 1000):
            rows = [((r.left_id, r.right_id), round(r.jaccard, 9)) for r in resolve.alike_in_cells(df, "i", "s", threshold, "b", "f", most).collect()]
            assert len(rows) == len(dict(rows)) and dict(rows) == want, most
    pairs, members = spark.createDataFrame([(1, 4)], "left_id long, right_id long"), spark.createDataFrame([(1, 1), (1, 7), (4, 4), (4, 5), (9, 9)], "key long, id long")
    assert sorted(tuple(r) for r in resolve.copies_paired(pairs, members).collect()) == [(1, 4), (1, 5), (1, 7), (4, 5), (4, 7), (5, 7)]
    made = catalogue.QUERIES["trigram_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect" not in made


def test_rows_of_a_small_file_are_dealt(spark):
    """What is made of the rows of a small file, and held to tell pairs once, is made in as many tasks as there are rows for."""
    dealt = shared.spread(spark.range(10_000), ["id"], 1_000)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.distinct().count() == 10_000
    for name in ("proposition_menu", "portfolio_pages", "landing_stories", "guessed_sites"):
        assert "REPARTITION_BY_NUM" in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString(), name


def test_clusters(spark):
    items = spark.createDataFrame([(i, "c", "") for i in range(1, 7)], "id long, company string, title string")
    pairs = spark.createDataFrame([(1, 3), (3, 2), (5, 6)], "left_id long, right_id long")
    assert {r.id: r.cluster_id for r in cluster.label_components(items, pairs, "id").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    # In one pass 2 is looked at before 3 has joined 1, and so opens its own cluster.
    assert {r.id: r.cluster_id for r in cluster.greedy_clusters(items, pairs, "id").collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5}


def test_placement_of_one_company(spark):
    cols = "item_id long, company_id long, expansion int, momentum int, partnership int, signal_type string, priority string, fit string, familiarity string, published_at timestamp, cluster_size int, round string, valuation_usd double, round_usd double, hq string"
    day = datetime(2026, 1, 1)
    rows = [
        (1, 1, 3, 3, 0, "funding", "high", "high", None, day, 1, "series_a", None, None, "Austin"), (2, 1, 3, 2, 0, "funding", "high", "high", None, day, 1, "", None, None, "Austin"),
        (3, 2, 3, 3, 0, "hiring", None, None, None, None, 1, "", None, None, "Berlin"), (4, 3, 0, 2, 0, "launch", "low", "low", "known", day, 1, "", None, None, "Oslo"),
        (5, 4, 3, 3, 3, "funding", "high", "high", None, day, 1, "", None, None, "Singapore, Singapore"), (6, 5, 1, 0, 0, "launch", "medium", None, None, day, 1, "", None, None, ""),
        (7, 6, 3, 3, 0, "funding", "medium", "low", None, day, 1, "ipo", None, None, ""), (8, 7, 3, 3, 0, "noise", "high", "high", None, day, 1, "", None, None, ""),
    ]
    got = {(r.item_id, r.section) for r in placement.place(spark.createDataFrame(rows, cols), F.lit("2026-01-05").cast("timestamp")).collect()}
    assert got == {(1, "new_on_the_radar"), (3, "awaiting_assessment"), (4, "who_we_know"), (7, "low_fit"), (6, "to_watch"), (6, "exploration")}


def test_feeds(spark, tmp_path):
    xml = """<rss><item><title><![CDATA[A &amp; B]]></title><link>http://x/1</link><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate><description>&lt;p&gt;Hi&lt;/p&gt;</description></item>
      <item><title>No link</title></item></rss><feed><entry><title>E</title><link href="http://x/2"/><updated>2026-01-06T00:00:00Z</updated></entry></feed>"""
    got = feeds.parse_feeds(spark.createDataFrame([(1, xml)], "id int, body string"), "body", "id").orderBy("link").collect()
    assert [(r.title, r.link, r.snippet, r.published.day) for r in got] == [("A & B", "http://x/1", "Hi", 5), ("E", "http://x/2", "", 6)]
    page = '<h1>News</h1><p>one</p><p>two</p><h1>More</h1><p>three</p><a href="/a"><b>T</b> x</a><img alt="Acme"><li>acme</li>'
    pages = spark.createDataFrame([(1, page)], "id int, html string")
    assert [(r.section, r.text) for r in feeds.sections(pages, "html", "id").orderBy("position").collect()][:3] == [("News", "one"), ("News", "two"), ("More", "three")]
    assert [(r.href, r.text) for r in feeds.links(pages, "html", "id").collect()] == [("/a", "T x")]
    assert [r.line for r in feeds.directory_lines(pages, "html", "id").orderBy("position").collect()] == ["News", "one", "two", "More", "three", "T x", "Acme"]
    f = tmp_path / "x.csv"
    f.write_text('a,b\n"x, ""y""\nz", 1 \nonly\n')
    assert [tuple(r) for r in feeds.read_csv(spark, str(f), ["a", "b"]).collect()] == [('x, "y"\nz', "1"), ("only", "")]
    boards = [("greenhouse", '{"jobs":[{"id":1,"title":" Eng ","location":{"name":"Tokyo"},"absolute_url":"u","departments":[{"name":"R"}]}]}'), ("lever", '[{"id":"2","text":"Ops","hostedUrl":"v","categories":{"team":"T"}}]'), ("ashby", "broken")]
    rows = [(i, v, 200, b) for i, (v, b) in enumerate(boards)]
    jobs = board_jobs(spark.createDataFrame(rows, "i int, vendor string, status int, body string"), "vendor", "status", "body", "i").collect()
    assert {(j.vendor, j.title, j.location, j.department) for j in jobs} == {("greenhouse", "Eng", "Tokyo", "R"), ("lever", "Ops", None, "T"), ("ashby", None, None, None)}


def test_streams_match_batch(spark, tmp_path):
    rows = [(i, datetime(2026, 1, 1 + i % 28, 5)) for i in range(60)] + [(3, datetime(2026, 1, 4, 6))]
    spark.createDataFrame(rows, "id int, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, ts timestamp").parquet(str(tmp_path / "in"))
    weekly.run_once(weekly.first_seen(stream, "id", "ts"), str(tmp_path / "seen"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "seen")).count() == 60
    counts = weekly.weekly_counts(stream, "ts").writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    got = {str(r.week_of): r.n for r in spark.table("weeks").collect()}
    assert sum(got.values()) == 61 and set(got) == {"2025-12-27", "2026-01-03", "2026-01-10", "2026-01-17", "2026-01-24"}


def test_story_pairs_by_signal_and_date(spark):
    """Two items of one signal need fewer shared terms, and far dates part what is alike by terms only."""
    rows = [
        (1, "Acme raises funding from Northwind partners for warehouse robots", "a", "funding", "2024-03-01 00:00:00"),
        (2, "Valuation of Acme doubles as Northwind backs logistics startup", "a", "funding", "2024-03-03 00:00:00"),
        (3, "Acme opens laboratory with Northwind in Lisbon harbour district", "a", "launch", "2024-03-03 00:00:00"),
        (4, "Acme raises funding from Northwind partners for warehouse robots", "a", "funding", "2024-08-01 00:00:00"),
        (5, "Northwind partners lead Acme funding, warehouse robots to follow", "a", "funding", "2024-08-01 00:00:00"),
        (6, "Northwind backs Acme, valuation of startup doubles", "b", "funding", None),
        (7, "Valuation of Acme doubles as backers of Northwind look at startup", "b", "", "2024-03-03 00:00:00"),
        (8, "Zenith Orbital Falcon", "c", "hiring", "2024-03-03 00:00:00"),
        (9, "Zenith Cobalt Granite", "c", "hiring", "2024-03-08 00:00:00"),
        (10, "Zenith Juniper Meridian", "c", "hiring", "2024-03-08 12:00:00"),
    ]
    items = spark.createDataFrame(rows, "id int, title string, company string, signal string, at string").withColumn("at", F.col("at").cast("timestamp"))
    f = cluster.with_features(items, "title")
    x, y = f.alias("x"), f.alias("y")
    two = lambda c: (F.col(f"x.{c}"), F.col(f"y.{c}"))
    all_pairs = x.join(y, F.expr("x.company = y.company and x.id < y.id"))
    want = {tuple(r) for r in all_pairs.where(cluster.same_story(two("_grams"), two("_terms"), two("signal"), two("at"))).select("x.id", "y.id").collect()}
    pairs = lambda *c: {tuple(r) for r in cluster.story_pairs(items, "id", "title", "company", *c).collect()}
    assert pairs("signal", "at") == want
    assert {(1, 4), (8, 9), (9, 10)} <= want and not {(1, 5), (8, 10)} & want
    assert (8, 9) not in pairs() and (1, 5) in pairs()


def test_lines_of_pages_are_dealt_by_their_number(spark, monkeypatch, tmp_path):
    """What a task sorts for the join of lines and orders doesn't grow with them, whatever the session's number of partitions."""
    import re

    from harborlens.plans import pages

    spark.range(9).selectExpr("id as o_orderkey", "id as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(9).selectExpr("id as p_partkey", "'b' as p_brand").write.parquet(f"{tmp_path}/part.parquet")
    line = "id as l_orderkey, id as l_partkey, id as l_suppkey, 1 as l_linenumber, 'A' as l_returnflag, 'F' as l_linestatus, timestamp_ntz'2001-01-01' as l_shipdate"
    spark.range(9).selectExpr(*line.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(pages, "parts_for", lambda df, most: df.count() if most == 250_000 else 1)
    monkeypatch.setattr(pages, "written", lambda df, name: df)
    lines = pages._lines(spark, str(tmp_path))
    dealt = re.findall(r"Exchange hashpartitioning\(([lo]_orderkey)#\d+L?, (\d+)\)", lines._jdf.queryExecution().executedPlan().toString())
    assert sorted(dealt) == [("l_orderkey", "9"), ("o_orderkey", "9")] and lines.count() == 9
