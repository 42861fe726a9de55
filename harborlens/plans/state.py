"""Queries over state: keys seen once for all time, sliding windows, merges through a schema, routed and appended writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlens.functions.derive import industry_route
from harborlens.operators.outputs import append_batch, append_unseen, read_batches, read_route, routed_write
from harborlens.operators.schema_merge import merge_schema, merged_entities, survivors
from harborlens.operators.shared import parts_for, shared_folder
from harborlens.operators.windows import ROWS, daily_panes, slides, window_as_of
from harborlens.plans.gates import _ROUTES, INDUSTRY
from harborlens.plans.registry import query, read
from harborlens.streaming import state, weekly

RUNS = 5


@query(f"""
    select user_id, event_type, run, event_id from (select *, (epoch(ts)::bigint // 86400) % {RUNS} as run from events)
    qualify row_number() over (partition by user_id, event_type order by run, ts, event_id) = 1""")
def first_over_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that came in several runs, of which two were sent again: each key once, with the run that had it first."""
    return _first_over_runs(read(spark, sf_dir, "events"))


def _run_of(ts: Column) -> Column:
    """The run of a time, as the SQL has it: seconds are rounded, half to even, so the last half second of a day is the next day's; days before 1970 are cut towards zero."""
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")
    return F.call_function("div", F.rint(F.unix_date(F.to_date(ts)) * F.lit(86_400.0) + clock).cast("long"), F.lit(86_400).cast("long")) % RUNS


def _first_over_runs(events: DataFrame) -> DataFrame:
    spark = events.sparkSession
    events = events.select("user_id", "event_type", "ts", "event_id", _run_of(F.col("ts")).alias("run")).withColumn("batch", F.coalesce("run", F.lit(RUNS)))
    runs = sorted({*range(RUNS), *(r.batch for r in events.select("batch").distinct().collect())})  # at most 2 * RUNS; events without a time come last
    seen, out = shared_folder(spark, "seen"), shared_folder(spark, "first")
    for run in (*(r for r in runs if r < 2), *(r for r in runs if r >= 1), 2):  # a run that is sent again replaces what it gave before
        new = append_unseen(events.where(F.col("batch") == run).drop("batch"), ["user_id", "event_type"], ["ts", "event_id"], seen, run, buckets=8)
        new.withColumn("_run", F.lit(run)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("_run").parquet(out)
    return spark.read.parquet(out).select("user_id", "event_type", F.col("run").cast("long").alias("run"), "event_id")


_MEASURES = {"lines": ("count", "1"), "quantity": ("sum", "cast(l_quantity as long)"), "largest": ("max", "cast(l_quantity as long)")}
_HOW = {name: how for name, (how, _) in _MEASURES.items()}
_PANES_SQL = "panes as (select l_suppkey, l_shipdate::date as day, count(*) as lines, sum(l_quantity::bigint) as quantity, max(l_quantity::bigint) as largest from lineitem group by 1, 2)"


def _panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_panes(read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_shipdate", _MEASURES)


@query(f"""
    with {_PANES_SQL}, points as (select l_suppkey, day from panes union select l_suppkey, day + 30 from panes)
    select p.l_suppkey, p.day, count(n.day) as panes, coalesce(sum(n.lines), 0)::bigint as lines, sum(n.quantity)::bigint as quantity, max(n.largest) as largest
    from points p left join panes n on n.l_suppkey = p.l_suppkey and n.day > p.day - 30 and n.day <= p.day group by 1, 2""")
def sliding_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's last 30 days, on every day on which they change."""
    return slides(_panes(spark, sf_dir), ["l_suppkey"], _HOW, parts=parts_for(read(spark, sf_dir, "lineitem"), ROWS))


@query("""
    select l_suppkey, count(*) as lines, sum(l_quantity::bigint)::bigint as quantity, max(l_quantity::bigint) as largest from lineitem
    where l_shipdate::date > date '2001-08-02' - 30 and l_shipdate::date <= date '2001-08-02' group by 1""")
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one window that ends today, for the suppliers with activity in it."""
    return window_as_of(_panes(spark, sf_dir), ["l_suppkey"], _HOW, F.lit("2001-08-02").cast("date"))


#: Customers of one place, trade and band of balance, each merged into the next smaller id: chains as long as the groups.
_GROUPED_SQL = """grouped as (select *, c_nationkey || '/' || c_mktsegment || '/' || floor(c_acctbal / 500)::bigint as g from customer),
    roots as (select c_custkey as id, min(c_custkey) over (partition by g) as root from grouped)"""


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 500))
    before = F.lag("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment", "band").orderBy("c_custkey"))
    return c.select(F.col("c_custkey").alias("drop_id"), before.alias("keep_id")).where("keep_id is not null")


@query(f"with {_GROUPED_SQL} select id, root as keep_id from roots where id <> root")
def surviving_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where chains of merges end."""
    return survivors(_merges(spark, sf_dir))


@query(f"""
    with {_GROUPED_SQL}, n as (select root, count(*) as n from roots join orders on o_custkey = id group by 1),
    w as (select root, event_type, arg_min(event_id, (id <> root, id, event_id)) as event_id from roots join (select user_id, event_type, min(event_id) as event_id from events group by 1, 2) on user_id = id group by 1, 2),
    e as (select least(a.root, b.root) as x from (select c_custkey as l, c_custkey // 2 as r from customer) join roots a on a.id = l join roots b on b.id = r)
    select 'orders' as "table", root as company_id, '' as key, n from n union all select 'watched', root, event_type, event_id from w union all select 'edges', x, '', count(*) from e group by x""")
def merged_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three child tables after the merges: orders, watched kinds (unique by customer and kind), and edges with a customer at either end."""
    customer, events = read(spark, sf_dir, "customer"), read(spark, sf_dir, "events")
    tables = {
        "orders": read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"),
        "watched": events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")),
        "edges": customer.select(F.col("c_custkey").alias("l"), F.floor(F.col("c_custkey") / 2).alias("r")),
    }
    after = merge_schema(tables, [("orders", "o_custkey", ()), ("watched", "user_id", ("user_id", "event_type")), ("edges", "l", ()), ("edges", "r", ())], _merges(spark, sf_dir))
    row = lambda df, name, key, kind, n: df.select(F.lit(name).alias("table"), F.col(key).alias("company_id"), kind.alias("key"), n.cast("long").alias("n"))
    orders = after["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    edges = after["edges"].groupBy(F.least("l", "r").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return row(orders, "orders", "o_custkey", F.lit(""), F.col("n")).unionByName(row(after["watched"], "watched", "user_id", F.col("event_type"), F.col("event_id"))).unionByName(row(edges, "edges", "x", F.lit(""), F.col("n")))


@query(f"""
    with {_GROUPED_SQL}, c as (select *, case when c_custkey % 3 = 0 then 'c' || c_custkey || '.com' when c_custkey % 3 = 1 then '' end as website, case when c_custkey % 4 = 0 then c_custkey end as cik from customer join roots on id = c_custkey)
    select root as company_id, any_value(c_name) filter (id = root) as name, arg_min(website, (id <> root, id)) filter (website <> '') as website, arg_min(cik, (id <> root, id)) filter (cik is not null) as cik,
        coalesce(string_agg(c_name, '|' order by c_name) filter (id <> root), '') as aliases from c group by 1""")
def merged_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers that survive, with fields filled and aliases carried from those that went."""
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(
        k.alias("company_id"), F.col("c_name").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("c"), k.cast("string"), F.lit(".com"))).when(k % 3 == 1, "").alias("website"),
        F.when(k % 4 == 0, k).alias("cik"), F.array().cast("array<string>").alias("aliases"),
    )
    merged = merged_entities(rows, "company_id", survivors(_merges(spark, sf_dir)), ["website", "cik"], "name", "aliases")
    return merged.withColumn("aliases", F.array_join("aliases", "|"))


@query(f"""
    with p as (select s_suppkey, {INDUSTRY} as grp from supplier), routes(g, disposition, reason) as (values {_ROUTES}),
    j as (select s_suppkey, coalesce(r.disposition, 'in_scope') as disposition from p left join routes r on replace(trim(p.grp), ' and ', ' & ') = r.g)
    select disposition as route, count(*) as n, sum(s_suppkey)::bigint as ids from j group by 1""")
def routed_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings written to an output for each disposition in one pass, twice, and read back."""
    path, rows = shared_folder(spark, "routes"), read(spark, sf_dir, "supplier").select("s_suppkey", industry_route(F.expr(INDUSTRY)).alias("r"))
    rows = rows.select("s_suppkey", F.col("r.disposition").alias("disposition"), F.col("r.reason").alias("reason"))
    for _ in range(2):
        routed_write(rows, F.col("disposition"), path)
    out = None
    for route in ("organization", "out_of_scope", "in_scope"):
        part = read_route(spark, path, route).select(F.lit(route).alias("route"), "s_suppkey")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("ids"))


@query("select conv_id, turn, role, text, (conv_id % 4)::int as batch from conversations")
def appended_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns appended as CSV in batches, each sent twice, and read back."""
    turns, path = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), shared_folder(spark, "appended")
    for batch in (0, 1, 0, 2, 3, 3):
        append_batch(turns.where(F.pmod("conv_id", F.lit(4)) == batch), path, batch)
    return read_batches(spark, path, "conv_id long, turn long, role string, text string")


def _arrivals(spark: SparkSession, sf_dir: str, files: int = 3) -> tuple[str, object]:
    """The events as files that arrive one after another, in a folder to be read as a stream."""
    path, events = shared_folder(spark, "arrivals"), read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    for n in range(files):
        events.where(F.col("event_id") % files == n).coalesce(1).write.mode("append").parquet(path)
    return path, events.schema


@query("select (ts::date - ((isodow(ts::date) + 1) % 7)::int) as week_of, event_type, count(*) as n from events group by 1, 2")
def streamed_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by week, kept up to date over files that arrive in any order of their times."""
    path, schema = _arrivals(spark, sf_dir)
    out, mark = shared_folder(spark, "weeks"), shared_folder(spark, "mark")
    for _ in range(2):  # the second run finds nothing new
        weekly.replaced_weeks(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), "ts", out, mark, "event_type")
    return spark.read.parquet(out).select(F.col("week_of").cast("date").alias("week_of"), "event_type", "n")


@query("""
    select user_id, event_type, file, event_id from (select *, event_id % 3 as file from events) qualify row_number() over (partition by user_id, event_type order by file, ts, event_id) = 1""")
def streamed_first_ever(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's first event over all runs of a stream, whose files came one a batch."""
    path, schema = _arrivals(spark, sf_dir)
    seen, out, mark = (shared_folder(spark, n) for n in ("seen", "first", "mark"))
    state.first_ever(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), ["user_id", "event_type"], ["ts", "event_id"], seen, out, mark)
    return spark.read.parquet(out).select("user_id", "event_type", (F.col("event_id") % 3).alias("file"), "event_id")


@query("""
    with panes as (select event_type, ts::date as day, count(*) as n, sum(round(value * 100)::bigint) as cents from events group by 1, 2),
    closed as (select * from panes where day + 1 <= (select (max(ts) - interval 1 day)::date from events)), points as (select event_type, day from closed union select event_type, day + 7 from closed)
    select p.event_type, p.day, coalesce(sum(c.n), 0)::bigint as n, sum(c.cents)::bigint as cents, count(c.day) as panes from points p left join closed c on c.event_type = p.event_type and c.day > p.day - 7 and c.day <= p.day group by 1, 2""")
def streamed_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks that slide by days, from the panes that a stream has closed."""
    path, schema = _arrivals(spark, sf_dir, 1)
    out, mark = shared_folder(spark, "panes"), shared_folder(spark, "mark")
    measures = {"n": ("count", "1"), "cents": ("sum", "cents")}
    told = state.daily_pane_stream(spark.readStream.schema(schema).parquet(path), ["event_type"], "ts", "1 day", measures)
    told.writeStream.format("parquet").option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return slides(spark.read.schema(told.schema).parquet(out), ["event_type"], {n: how for n, (how, _) in measures.items()}, 7)
