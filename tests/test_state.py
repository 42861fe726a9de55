"""State over runs: keys for all time, panes and slides, merges, routed and appended writes, shards, boards, pages."""

import random
import re
from datetime import date, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from harborlens.operators import outputs, pages, schema_merge, windows
from harborlens.operators.queues import discovery_candidates
from harborlens.plans import catalogue
from harborlens.sources import boards, registry
from harborlens.streaming import state, weekly


def files(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_keys_are_seen_once_for_all_time(spark, tmp_path):
    src, seen, out, mark = (str(tmp_path / n) for n in ("src", "seen", "out", "mark"))
    schema = "k string, n long, ts timestamp"
    run = lambda: state.first_ever(spark.readStream.schema(schema).parquet(src), ["k"], ["ts", "n"], seen, out, mark)
    got = lambda: sorted((r.k or "", r.n) for r in spark.read.parquet(out).collect())
    files(spark, src, [("a", 1, datetime(2024, 1, 2)), ("a", 2, datetime(2024, 1, 1)), (None, 3, datetime(2024, 1, 1)), ("b", 4, None)], schema)
    run()
    assert got() == [("", 3), ("a", 2), ("b", 4)]
    files(spark, src, [("a", 5, datetime(2025, 6, 1)), ("c", 6, datetime(2025, 6, 1)), (None, 7, datetime(2025, 6, 1))], schema)  # a key of more than a year ago
    run()  # a new start from the mark
    assert got() == [("", 3), ("a", 2), ("b", 4), ("c", 6)]
    # A batch that is sent again under its number, after a failure between the writes, gives the same rows and adds nothing.
    batch = spark.createDataFrame([("a", 5, datetime(2025, 6, 1)), ("c", 6, datetime(2025, 6, 1))], schema)
    assert [r.k for r in outputs.append_unseen(batch, ["k"], ["ts", "n"], seen, 1).collect()] == ["c"]
    assert [r.k for r in outputs.append_unseen(batch, ["k"], ["ts", "n"], seen, 1).collect()] == ["c"]
    assert outputs.append_unseen(batch, ["k"], ["ts", "n"], seen, 2).count() == 0
    assert outputs.append_unseen(batch.limit(0), ["k"], ["ts", "n"], seen, 3).count() == 0
    few = outputs.append_unseen(spark.range(500).select(F.col("id").cast("string").alias("k"), "id"), ["k"], ["id"], seen, 4, bits=64)  # a bit set that lets all through
    assert few.count() == 500
    assert outputs.append_unseen(spark.range(400, 600).select(F.col("id").cast("string").alias("k"), "id"), ["k"], ["id"], seen, 5, bits=64).count() == 100


def test_runs_are_those_of_the_sql(spark, tmp_path):
    """Times in the last half second of a day, before 1970, and none."""
    at = ["2024-01-01 23:59:59.499999", "2024-01-01 23:59:59.5", "2024-01-02 00:00:00.5", "2024-01-01 23:59:58.5", "1969-12-20 10:00:00", "1969-12-31 23:59:59.7", "1969-12-30 00:00:00.5", "1969-12-29 23:59:59.5", None]
    rows = [(i, u, "view", t) for i, (u, t) in enumerate([*enumerate(at), *((99, t) for t in at), (98, None), (98, "2024-01-03 23:59:59.75"), (98, "2024-01-03 01:00:00")])]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, t string").select("event_id", "user_id", "event_type", F.col("t").cast("timestamp_ntz").alias("ts"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLES["first_over_runs"]).fetchall()
    assert sorted(map(str, map(tuple, catalogue.QUERIES["first_over_runs"](spark, str(tmp_path)).collect()))) == sorted(map(str, want)) and len(want) == len(at) + 2


MEASURES = {"n": ("count", "1"), "total": ("sum", "v"), "top": ("max", "v")}
HOW = {k: how for k, (how, _) in MEASURES.items()}


def test_slides(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), date(2024, 1, 1) + timedelta(days=rng.randrange(90)), rng.randrange(50)) for _ in range(60)] + [("a", None, 9), (None, date(2024, 1, 5), 1)]
    panes = windows.daily_panes(spark.createDataFrame(rows, "k string, d date, v long"), ["k"], "d", MEASURES)
    got = {(r.k, r.day): (r.n, r.total, r.top) for r in windows.slides(panes, ["k"], HOW, 7).collect()}
    days = {(k, d + timedelta(days=i)) for k, d, _ in rows if d for i in (0, 7)}
    assert set(got) == days
    for k, day in days:
        own = [v for x, d, v in rows if d and x == k and day - timedelta(days=7) < d <= day]
        assert got[k, day] == (len(own), sum(own) if own else None, max(own, default=None))
    asof = date(2024, 2, 10)
    now = {r.k: r.total for r in windows.window_as_of(panes, ["k"], HOW, F.lit(asof), 7).collect()}
    assert now == {k: sum(v for x, d, v in rows if x == k and d and asof - timedelta(days=7) < d <= asof) for k in {x for x, d, _ in rows if d and asof - timedelta(days=7) < d <= asof}}


def test_panes_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(windows, "ROWS", 10)
    rows = spark.createDataFrame([(i % 7, datetime(2024, 1, 1) + timedelta(hours=i), i) for i in range(200)], "k long, ts timestamp, v long")
    panes = windows.daily_panes(rows, ["k"], "ts", MEASURES)
    slid = windows.slides(panes, ["k"], HOW, 7, parts=20)
    plan = slid._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\((.*), (\d+)\), REPARTITION_BY_NUM", plan) and plan.count("Exchange") == 2  # by pane, then by key; both in numbers that grow with the rows
    assert sorted(int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan)) == [20, 20]
    assert slid.where("panes > 0").agg(F.sum("n")).first()[0] == sum(r.n for r in windows.slides(panes, ["k"], HOW, 7).collect())


def test_panes_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    rng, src, out = random.Random(5), str(tmp_path / "src"), str(tmp_path / "panes")
    schema = "k string, ts timestamp, v long"
    rows = sorted((datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 40)), rng.choice("ab"), rng.randrange(9)) for _ in range(200))
    rows = [(k, ts, v) for ts, k, v in rows]
    for part in (rows[:90], rows[90:], [("z", datetime(2024, 4, 1), 0)]):
        files(spark, src, part, schema)
        stream = state.daily_pane_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), ["k"], "ts", "1 day", MEASURES)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    told = spark.read.parquet(out)
    panes = windows.daily_panes(spark.createDataFrame(rows, schema), ["k"], "ts", MEASURES)
    assert {tuple(r) for r in told.collect()} == {tuple(r) for r in panes.collect()}
    assert {tuple(r) for r in windows.slides(told, ["k"], HOW).collect()} == {tuple(r) for r in windows.slides(panes, ["k"], HOW).collect()}


def test_merges_lead_on(spark):
    m = spark.createDataFrame([(1, 2), (2, 3), (5, 3), (7, 8), (8, 7), (9, 8), (4, 4), (6, None), (10, 12), (10, 11)], "drop_id long, keep_id long")
    assert {r.id: r.keep_id for r in schema_merge.survivors(m).collect()} == {1: 3, 2: 3, 5: 3, 8: 7, 9: 7, 10: 11}
    child = spark.createDataFrame([(1, "x", 1), (3, "x", 9), (5, "x", 2), (2, "y", 5), (5, "y", 4), (2, None, 1), (1, None, 2), (None, "z", 0)], "c long, kind string, n long")
    out = schema_merge.merge_schema({"t": child, "other": child}, [("t", "c", ("c", "kind"))], m)
    rows = sorted(out["t"].collect(), key=str)
    assert sorted(((r.c, r.kind, r.n) for r in rows), key=str) == sorted([(3, "x", 9), (3, "y", 5), (3, None, 1), (3, None, 2), (None, "z", 0)], key=str)
    assert out["other"].count() == 8
    companies = spark.createDataFrame([(3, "Keep", None, "", ["Old"]), (1, "One", "S", "w1", None), (2, "Keep", "T", "w2", ["Two"]), (8, "Eight", None, None, None)], "id long, name string, state string, site string, aliases array<string>")
    got = {r.id: tuple(r)[1:] for r in schema_merge.merged_entities(companies, "id", schema_merge.survivors(m), ["state", "site"], "name", "aliases").collect()}
    assert got == {3: ("Keep", "S", "w1", ["Old", "One", "Two"]), 8: ("Eight", None, None, [])}  # 8 would go to 7, which has no row


def test_routed_and_appended_writes(spark, tmp_path):
    df = spark.createDataFrame([(i, ["a", "b", None][i % 3]) for i in range(30)], "i long, r string")
    path = str(tmp_path / "routes")
    for _ in range(2):
        outputs.routed_write(df, F.col("r"), path)
    assert {r: outputs.read_route(spark, path, r).count() for r in ("a", "b", "none")} == {"a": 10, "b": 10, "none": 10}
    outputs.routed_write(df.where("r = 'a'").limit(3), F.col("r"), path)
    assert outputs.read_route(spark, path, "a").count() == 3 and outputs.read_route(spark, path, "b").count() == 10
    assert "_route" in outputs.read_route(spark, path, "b")._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]
    csv = str(tmp_path / "csv")
    assert outputs.append_batch(df, csv, 0) and not outputs.append_batch(df, csv, 0)
    broken = df.select(F.when(F.col("i") > 20, F.raise_error(F.lit("broken"))).otherwise("x").alias("i"), "r")
    with pytest.raises(Exception, match="broken"):
        outputs.append_batch(broken, csv, 1)
    assert outputs.read_batches(spark, csv, "i long, r string").count() == 30  # what was finished stays, what broke off isn't there
    assert outputs.append_batch(df, csv, 1) and outputs.read_batches(spark, csv, "i long, r string").count() == 60


def test_appended_stream(spark, tmp_path):
    src, csv = str(tmp_path / "src"), str(tmp_path / "csv")
    for part in ([(1, 'a "quoted", cell\nof two lines')], [(2, None), (3, "")]):
        files(spark, src, part, "i long, s string")
        state.append_batches(spark.readStream.schema("i long, s string").parquet(src), csv, str(tmp_path / "mark"))
    got = outputs.read_batches(spark, csv, "i long, s string").collect()
    assert sorted((r.i, r.s or "", r.batch) for r in got) == [(1, 'a "quoted", cell\nof two lines', 0), (2, "", 1), (3, "", 1)]


def test_registry_shards_are_pruned(spark, tmp_path):
    path = str(tmp_path / "registry")
    names = [("Á1", "ÁLTAIR LABS PTE LTD"), ("a2", "ALTAIR PTE LTD"), ("b1", "ALTAIR BERTH PTE LTD"), ("z1", "ZEPHYR PTE LTD"), ("3", "3 ALTAIR PTE LTD"), ("n", None)]
    names += [(f"g{i:03}", f"GENERIC {i:03} PTE LTD") for i in range(90)]
    registry.write_registry(spark.createDataFrame([(u, n, "Live") for u, n in names], "uen string, name string, status string"), path)
    companies = spark.createDataFrame([("Altair Inc",), ("The Ab Co",), ("",), (None,)], "company string")
    got = registry.lookup_sharded(companies, registry.read_registry(spark, path), F.col("status") == "Live")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert {r.uen for r in got.collect()} <= {"Á1", "a2", "b1", "3"} and got.where("company = 'Altair Inc'").count() > 0
    assert [r.place for r in got.orderBy("place").collect()] == list(range(1, got.count() + 1))
    many = registry.lookup_sharded(spark.createDataFrame([("Generic",)], "company string"), registry.read_registry(spark, path), F.col("status") == "Live")
    assert many.count() == 0  # forty candidates of a short name are none


def test_boards(spark):
    rows = [
        (1, "greenhouse", 200, '{"jobs": [{"id": 7, "title": " A ", "absolute_url": "u", "updated_at": "2024-01-02T03:04:05Z"}, {"id": 8, "title": "", "absolute_url": "u"}]}'),
        (2, "greenhouse", 200, '{"meta": 1}'), (3, "greenhouse", 200, '{"jobs": "x"}'), (4, "lever", 200, '[{"id": "x", "text": "B", "applyUrl": "v", "createdAt": 1704164645000, "descriptionPlain": "p", "additionalPlain": "q"}]'),
        (5, "lever", 200, "{}"), (6, "ashby", 404, ""), (7, "ashby", 500, None), (8, "rippling", 200, '{"items": [{"uuid": "r", "name": "C", "workLocation": {"label": "X"}}, {"uuid": "r", "name": "C", "location": "Y"}, {"uuid": "r", "name": "C", "location": "X"}]}'),
        (9, "rippling", 200, '{"a": 1}'), (10, "ashby", 200, "not json"), (11, None, 200, "[]"), (12, "lever", 200, "[]"),
    ]
    df = spark.createDataFrame(rows, "i int, vendor string, status int, body string")
    got = {r.i: r for r in boards.board_jobs(df, "vendor", "status", "body", "i").collect()}
    assert {i: r.outcome for i, r in got.items()} == {1: "ok", 2: "ok", 3: "error", 4: "ok", 5: "error", 6: "not_found", 7: "error", 8: "ok", 9: "not_found", 10: "error", 11: "error", 12: "ok"}
    assert (got[1].external_id, got[1].title, got[1].posted_at) == ("7", "A", datetime(2024, 1, 2, 3, 4, 5))
    assert (got[4].url, got[4].posted_at, got[4].content) == ("v", datetime(2024, 1, 2, 3, 4, 5), "p q")
    assert (got[8].external_id, got[8].location) == ("r", "X; Y") and got[2].title is None and got[12].title is None


def test_discovery(spark):
    rows = [(1, "Acme raises $5M", 3), (2, "ACME raises $6M", 1), (3, "Known Labs Inc raises $9M", 1), (4, "Acme raises $7M weekly roundup", 0), (5, "Beta opens an office", 0), (6, None, 0)]
    h = spark.createDataFrame([(i, t, None, "s", "u", at) for i, t, at in rows], "item_id long, title string, snippet string, source string, url string, at int")
    got = discovery_candidates(h, spark.createDataFrame([("known",)], "name string"), ["at"]).collect()
    assert [(r.name, r.item_id, r.amount) for r in got] == [("ACME", 2, 6e6)]


def test_page_parts_are_shuffled_in_their_own_columns(spark):
    rows = spark.range(100).select((F.col("id") % 5).alias("k"), F.col("id").alias("n"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("name"))
    got = pages.bundles(spark.range(5).withColumnRenamed("id", "k"), "k", [pages.Part("a", rows, ["n"], [-F.col("n")], None, 3), pages.Part("b", rows.where("n < 2"), ["name"], [F.col("n")], counted=rows)])
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows_of = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows_of) == 2 and not any("_kind" in line for line in windows_of)  # no part carries the columns of another
    assert {(r.k, tuple(x.n for x in r.a), tuple(x.name for x in r.b), r.n_a, r.n_b) for r in got.collect()} == {(k, (95 + k, 90 + k, 85 + k), (f"x{k}",) if k < 2 else (), 20, 20) for k in range(5)}


@pytest.mark.parametrize("name", ["person_pages", "org_pages"])
def test_lines_of_pages_are_joined_once(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "p_partkey" not in plan  # parts of a page read the joined lines as files, not the join


def test_pages_show_so_many_and_count_all(spark):
    rows = spark.range(1_000).select(F.lit(1).alias("k"), F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("o"))
    got = pages.bundles(spark.createDataFrame([(1,), (2,)], "k int"), "k", [pages.Part("a", rows, ["n"], [F.col("o"), -F.col("n")], None, 3), pages.Part("b", rows.where("n < 2"), ["n"], [F.col("n")])])
    by = {r.k: r for r in got.collect()}
    assert ([x.n for x in by[1].a], by[1].n_a, [x.n for x in by[1].b]) == ([0, 2, 4], 1_000, [0, 1])
    assert (by[2].a, by[2].n_a, by[2].b) == ([], 0, [])
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_weeks_are_brought_up_to_date(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "k string, ts timestamp"
    run = lambda: weekly.replaced_weeks(spark.readStream.schema(schema).parquet(src), "ts", out, mark, "k")
    got = lambda: sorted((str(r.week_of), r.k, r.n) for r in spark.read.parquet(out).collect())
    files(spark, src, [("a", datetime(2025, 1, 4)), ("b", datetime(2025, 1, 10)), ("a", datetime(2025, 1, 11)), ("a", datetime(2025, 1, 10))], schema)
    run()
    assert got() == [("2025-01-04", "a", 2), ("2025-01-04", "b", 1), ("2025-01-11", "a", 1)]
    files(spark, src, [("a", datetime(2025, 1, 5)), ("c", datetime(2024, 6, 1))], schema)  # late rows: one week anew, its other keys kept
    run()
    run()
    assert got() == [("2024-06-01", "c", 1), ("2025-01-04", "a", 3), ("2025-01-04", "b", 1), ("2025-01-11", "a", 1)]
