"""Queries over entity pages: customers are companies, suppliers people, brands investors, orders items; events are links, snapshots and assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlens.operators.pages import Part, bundles, investor_rounds, latest_scores, newest_first, queue_sizes, related_items, sibling_context, sliding_rates
from harborlens.operators.shared import parts_for, shuffled, spread, written
from harborlens.plans.registry import query, read

_LINES_SQL = """lines as (select *, epoch(l_shipdate)::bigint // 86400 as day from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey),
    scores as (select l_orderkey as item, max((l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity)) as s from lineitem group by 1),
    items as (select o_orderkey as item, o_custkey as company, o_orderdate, o_orderstatus, coalesce((s).struct_extract(5), 0)::bigint as score from orders left join scores on item = o_orderkey)"""


def _part_sql(name: str, key: str, rows: str, order: str, shown: str, most: int = 400) -> str:
    return f"""{name}_ as (select k, string_agg(x, ';' order by n) as {name}, max(total) as n_{name} from (select {key} as k, {shown} as x, row_number() over (partition by {key} order by {order}) as n,
        count(*) over (partition by {key}) as total from ({rows}) where {key} is not null) where n <= {most} group by 1)"""


def _page_sql(entities: str, key: str, parts: list[str], names: list[str], before: str = "") -> str:
    told = ", ".join(f"coalesce({n}, '') as {n}, coalesce(n_{n}, 0)::bigint as n_{n}" for n in names)
    return f"with {_LINES_SQL}, {before}{', '.join(parts)} select e.{key}, {told} from {entities} e {' '.join(f'left join {n}_ on {n}_.k = e.{key}' for n in names)}"


def _told(page: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Each array as one string, to be compared as such."""
    kinds = {n: page.schema[n].dataType.elementType.names for n in names}
    text = lambda x, f: F.array_join(x[f], "+") if f == "round_names" else F.coalesce(x[f].cast("string"), F.lit(""))
    joined = lambda n: F.array_join(F.transform(n, lambda x: F.concat_ws("|", *(text(x, f) for f in kinds[n]))), ";")
    return page.select(key, *(c for n in names for c in (joined(n).alias(n), F.col(f"n_{n}"))))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order's customer and their part's brand, joined and written once: a page's parts read them several times. Both sides of the larger join are
    dealt by the number of lines, so that what a task sorts doesn't grow with them."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")  # noqa: E741
    l = l.withColumn("day", F.unix_date(F.to_date("l_shipdate")).cast("long")).drop("l_shipdate")  # noqa: E741
    parts = parts_for(l, 250_000)
    met = l.repartition(parts, "l_orderkey").join(shuffled(o.repartition(parts, "o_orderkey")), F.col("o_orderkey") == F.col("l_orderkey"))
    return written(met.join(p, F.col("p_partkey") == F.col("l_partkey")).drop("o_orderkey", "p_partkey"), "lines")


def _grouped(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines dealt by the keys by which they are grouped next, into parts by their number: nearly each is a group of its own, so grouping before the shuffle would hold nearly all of a task's."""
    return spread(lines, keys, 250_000)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    s = latest_scores(read(spark, sf_dir, "lineitem"), "l_orderkey", order, ["l_quantity"])
    o = read(spark, sf_dir, "orders").join(s, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return o.select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("company_id"), "o_orderdate", "o_orderstatus", F.coalesce(F.col("l_quantity"), F.lit(0)).cast("long").alias("score"))


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return read(spark, sf_dir, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("company_id"), "event_id", "ts")


def _investments(lines: DataFrame) -> DataFrame:
    return _grouped(lines.select("o_custkey", "p_brand", "l_returnflag", "l_linenumber", "day"), ["o_custkey", "p_brand"]).select(F.col("o_custkey").alias("company_id"), F.col("p_brand").alias("org"), F.col("l_returnflag").alias("round"), (F.col("l_linenumber") == 1).alias("is_lead"), F.col("day").alias("announced"))


def _roles(lines: DataFrame) -> DataFrame:
    """A row for each customer and supplier."""
    pairs = _grouped(lines.select("o_custkey", "l_suppkey", "l_returnflag", "day"), ["o_custkey", "l_suppkey"])
    return pairs.groupBy("o_custkey", "l_suppkey").agg(F.max("l_returnflag").alias("role"), F.max("day").alias("seen"))


_SNAPSHOTS = [_part_sql(n, "user_id", f"select * from events where event_type = '{kind}'", "ts desc, event_id", "event_id::varchar", most) for n, kind, most in (("links", "signup", 400), ("assessment", "purchase", 1), ("jobs", "click", 2))]
_INVESTORS_SQL = """investors as (select o_custkey, p_brand, bool_or(l_linenumber = 1) as lead, count(*) as rounds, max(day) as announced, coalesce(array_to_string(list_sort(list_distinct(list(l_returnflag) filter (l_returnflag <> 'N'))), '+'), '') as names,
    (max((day, l_returnflag)) filter (l_returnflag <> 'N')) as last from lines group by 1, 2), """
_COMPANY = ["people", "investors", "filings", "links", "assessment", "items", "jobs", "postings"]


@query(_page_sql("customer", "c_custkey", [
    _part_sql("people", "o_custkey", "select o_custkey, l_suppkey, max(l_returnflag) as role, max(day) as seen from lines group by 1, 2", "seen desc, l_suppkey::varchar", "l_suppkey || '|' || role || '|' || seen"),
    _part_sql("investors", "o_custkey", "select * from investors", "lead desc, p_brand", "p_brand || '|' || lead || '|' || rounds || '|' || announced || '|' || names"),
    _part_sql("filings", "o_custkey", "select * from orders where o_orderstatus = 'F'", "o_orderdate desc, o_orderkey", "o_orderkey || '|' || o_orderpriority"),
    *_SNAPSHOTS,
    _part_sql("items", "company", "select * from items where o_orderstatus <> 'F'", "score desc, o_orderdate desc, item", "item || '|' || score", 8),
    _part_sql("postings", "o_custkey", "select * from lines where l_returnflag in ('A', 'R')", "l_returnflag desc, day desc, (l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey)", "l_orderkey || '|' || l_returnflag"),
], _COMPANY, _INVESTORS_SQL))
def company_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every company's page: people, investors, filings, links, assessment, items, job snapshots and postings."""
    lines, orders = _lines(spark, sf_dir), read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "company_id")
    people = written(_roles(lines).withColumnRenamed("o_custkey", "company_id"), "people")
    held = written(investor_rounds(_investments(lines), "company_id", "org", ["N"]), "held")
    snapshot = lambda name, kind, most: Part(name, _events(spark, sf_dir, kind), ["event_id"], [newest_first(F.col("ts")), F.col("event_id")], None, most)
    postings = lines.where(F.col("l_returnflag").isin("A", "R")).withColumnRenamed("o_custkey", "company_id")
    page = bundles(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id")), "company_id", [
        Part("people", people, ["l_suppkey", "role", "seen"], [-F.col("seen")], F.col("l_suppkey")),
        Part("investors", held, ["org", "is_lead", "rounds", "announced", "round_names"], [-F.col("is_lead").cast("int")], F.col("org")),
        Part("filings", orders.where("o_orderstatus = 'F'"), ["o_orderkey", "o_orderpriority"], [newest_first(F.col("o_orderdate")), F.col("o_orderkey")]),
        snapshot("links", "signup", 400), snapshot("assessment", "purchase", 1),
        Part("items", _items(spark, sf_dir).where("o_orderstatus <> 'F'"), ["item_id", "score"], [-F.col("score"), newest_first(F.col("o_orderdate")), F.col("item_id")], None, 8),
        snapshot("jobs", "click", 2),
        Part("postings", postings, ["l_orderkey", "l_returnflag"], [-(F.col("l_returnflag") == "R").cast("int"), -F.col("day")], F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")),
    ])
    return _told(page, "company_id", _COMPANY).withColumnRenamed("company_id", "c_custkey")


@query(_page_sql("supplier", "s_suppkey", [
    _part_sql("roles", "l_suppkey", "select l_suppkey, o_custkey, max(l_returnflag) as role, max(day) as seen from lines group by 1, 2", "seen desc, o_custkey", "o_custkey || '|' || role || '|' || seen"),
    _part_sql("affiliations", "l_suppkey", "select l_suppkey, p_brand, max(l_linestatus) as role from lines group by 1, 2", "p_brand", "p_brand || '|' || role"),
    _part_sql("linked", "l_suppkey", "select distinct l_suppkey, o_custkey from lines join (select distinct user_id from events where event_type = 'signup') on user_id = o_custkey", "o_custkey", "o_custkey::varchar"),
], ["roles", "affiliations", "linked"]))
def person_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every person's page: roles, affiliations, and companies with a link."""
    lines = _lines(spark, sf_dir)
    roles = written(_roles(lines), "roles")
    affiliations = _grouped(lines.select("l_suppkey", "p_brand", "l_linestatus"), ["l_suppkey", "p_brand"]).groupBy("l_suppkey", "p_brand").agg(F.max("l_linestatus").alias("role"))
    linked = roles.join(_events(spark, sf_dir, "signup").select(F.col("company_id").alias("o_custkey")).distinct(), "o_custkey", "left_semi")
    page = bundles(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", [
        Part("roles", roles, ["o_custkey", "role", "seen"], [-F.col("seen"), F.col("o_custkey")]),
        Part("affiliations", affiliations, ["p_brand", "role"], [], F.col("p_brand")),
        Part("linked", linked, ["o_custkey"], [F.col("o_custkey")]),
    ])
    return _told(page, "l_suppkey", ["roles", "affiliations", "linked"]).withColumnRenamed("l_suppkey", "s_suppkey")


_STAGE = "case when l_returnflag = 'R' then 'seed' when l_returnflag = 'A' and l_linestatus = 'F' then 'series A' when l_returnflag = 'A' then 'growth' end"


@query(_page_sql("(select distinct p_brand from part)", "p_brand", [
    _part_sql("portfolio", "p_brand", "select i.*, g.user_id is not null as linked, signal from investors i left join (select distinct user_id from events where event_type = 'signup') g on g.user_id = o_custkey left join (select company, max(score) as signal from items group by 1) on company = o_custkey", "o_custkey",
        "o_custkey || '|' || lead || '|' || announced || '|' || coalesce((last).struct_extract(2), '') || '|' || linked || '|' || coalesce(signal::varchar, '')"),
    _part_sql("people", "p_brand", "select p_brand, l_suppkey, max(l_linestatus) as role from lines group by 1, 2", "l_suppkey", "l_suppkey || '|' || role"),
    _part_sql("sectors", "p_brand", "select p_brand, c_mktsegment, count(distinct o_custkey) as n from lines join customer on c_custkey = o_custkey group by 1, 2", "n desc, c_mktsegment", "c_mktsegment || '|' || n", 5),
    _part_sql("stages", "p_brand", f"select * from (select p_brand, {_STAGE} as stage, count(*) as n from lines group by 1, 2) where stage is not null", "n desc, stage", "stage || '|' || n"),
], ["portfolio", "people", "sectors", "stages"], _INVESTORS_SQL))
def org_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every investor's page: portfolio (one row a company), people, and the mix of sectors and stages."""
    lines = _lines(spark, sf_dir)
    linked = _events(spark, sf_dir, "signup").select(F.col("company_id").alias("_c")).distinct()
    signal = _items(spark, sf_dir).groupBy(F.col("company_id").alias("_s")).agg(F.max("score").alias("signal"))
    held = written(investor_rounds(_investments(lines), "company_id", "org", ["N"]).withColumnRenamed("org", "p_brand"), "held")
    # What is known of a company is joined to the companies that are shown.
    first = held.withColumn("_at", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.asc_nulls_last("company_id")))).where("_at <= 400")
    shown = first.join(linked, F.col("company_id") == F.col("_c"), "left").join(signal, F.col("company_id") == F.col("_s"), "left").withColumn("linked", F.col("_c").isNotNull())
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), "c_mktsegment")
    sectors = held.select("p_brand", "company_id").join(customer, "company_id").groupBy("p_brand", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    people = _grouped(lines.select("p_brand", "l_suppkey", "l_linestatus"), ["p_brand", "l_suppkey"]).groupBy("p_brand", "l_suppkey").agg(F.max("l_linestatus").alias("role"))
    stages = lines.withColumn("stage", F.expr(_STAGE)).where("stage is not null").groupBy("p_brand", "stage").agg(F.count(F.lit(1)).alias("n"))
    page = bundles(read(spark, sf_dir, "part").select("p_brand").distinct(), "p_brand", [
        Part("portfolio", shown, ["company_id", "is_lead", "announced", "latest_round", "linked", "signal"], [F.col("company_id")], counted=held),
        Part("people", people, ["l_suppkey", "role"], [F.col("l_suppkey")]),
        Part("sectors", sectors, ["c_mktsegment", "n"], [-F.col("n")], F.col("c_mktsegment"), 5),
        Part("stages", stages, ["stage", "n"], [-F.col("n")], F.col("stage")),
    ])
    return _told(page, "p_brand", ["portfolio", "people", "sectors", "stages"])


@query(f"with {_LINES_SQL}, {_INVESTORS_SQL.rstrip(', ')} select p_brand, o_custkey as company_id, lead as is_lead, rounds, announced, names as round_names, (last).struct_extract(2) as latest_round from investors")
def portfolio_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every investor's whole portfolio as rows; a page shows the first 400 of them and how many there are."""
    held = investor_rounds(_investments(_lines(spark, sf_dir)), "company_id", "org", ["N"])
    return held.select(F.col("org").alias("p_brand"), "company_id", "is_lead", "rounds", "announced", F.array_join("round_names", "+").alias("round_names"), "latest_round")


@query(f"""
    with {_LINES_SQL}, heads as (select item, min(item) over (partition by company, date_trunc('month', o_orderdate)) as head from items),
    cluster_ as (select head as k, string_agg(item, ';' order by item) filter (n <= 12) as cluster from (select *, row_number() over (partition by head order by item) as n from heads where item <> head) group by 1),
    tops as (select company, item, score, row_number() over (partition by company order by score desc, o_orderdate desc, item) as n from items where o_orderstatus <> 'F'),
    related_ as (select k, string_agg(item, ';' order by n) filter (m <= 10) as related from (select i.item as k, t.item, t.n, row_number() over (partition by i.item order by t.n) as m from items i join tops t on t.company = i.company and t.item <> i.item and t.n <= 11) group by 1),
    jobs_ as (select user_id as k, string_agg(event_id, ';' order by n) as jobs from (select *, row_number() over (partition by user_id order by ts desc, event_id) as n from events where event_type = 'click') where n <= 2 group by 1),
    filings_ as (select o_custkey as k, string_agg(o_orderkey, ';' order by n) as filings from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as n from orders where o_orderstatus = 'F') where n <= 3 group by 1)
    select item as item_id, score, coalesce(cluster, '') as cluster, coalesce(related, '') as related, coalesce(jobs, '') as jobs, coalesce(filings, '') as filings
    from items left join cluster_ c on c.k = item left join related_ r on r.k = item left join jobs_ j on j.k = company left join filings_ f on f.k = company""")
def item_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's page: its last score, other items of its cluster and of its company, the company's job snapshots and filings."""
    items = _items(spark, sf_dir)
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "company_id")
    companies = bundles(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id")), "company_id", [
        Part("items", items.where("o_orderstatus <> 'F'"), ["item_id"], [-F.col("score"), newest_first(F.col("o_orderdate")), F.col("item_id")], None, 11),
        Part("jobs", _events(spark, sf_dir, "click"), ["event_id"], [newest_first(F.col("ts")), F.col("event_id")], None, 2),
        Part("filings", orders.where("o_orderstatus = 'F'"), ["o_orderkey"], [newest_first(F.col("o_orderdate")), F.col("o_orderkey")], None, 3),
    ])
    month = items.select("company_id", "item_id", F.date_trunc("month", "o_orderdate").alias("month"))
    heads = month.groupBy("company_id", "month").agg(F.min("item_id").alias("head"))
    others = month.join(heads, ["company_id", "month"]).where("item_id <> head").select(F.col("head").alias("item_id"), F.col("item_id").alias("other"))
    page = bundles(items, "item_id", [Part("cluster", others, ["other"], [F.col("other")], None, 12)])
    page = related_items(page, companies).join(companies.select("company_id", "jobs", "filings"), "company_id", "left")
    ids = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda x: x[f].cast("string")), ";"), F.lit(""))
    return page.select("item_id", "score", ids("cluster", "other").alias("cluster"), ids("related", "item_id").alias("related"), ids("jobs", "event_id").alias("jobs"), ids("filings", "o_orderkey").alias("filings"))


_NOW = "2001-08-02"


def _context(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = _items(spark, sf_dir).select(
        "company_id", "item_id", F.concat(F.lit("s"), (F.col("item_id") % 9).cast("string")).alias("source"), F.concat(F.lit("http://x/"), F.col("item_id").cast("string")).alias("url"),
        F.when(F.col("score") > 25, "filing").otherwise("news").alias("source_type"), F.when(F.col("score") % 7 != 0, F.col("o_orderdate")).alias("published_at"), F.col("o_orderdate").alias("fetched_at"), "score", "o_orderstatus",
    )
    plain = ["item_id", "source", "url", "source_type", "published_at", "fetched_at"]
    best = items.groupBy("company_id").agg(F.max(F.struct("score", "item_id"))["item_id"].alias("_best"))
    representative = items.join(best.select("_best"), F.col("item_id") == F.col("_best")).withColumn("why", F.lit("representative"))
    scored = items.where("o_orderstatus <> 'F'").withColumn("why", F.concat(F.lit("scored "), F.col("score").cast("string")))
    return items.where("score >= 45").select(*plain), representative.select("company_id", "why", *plain), scored.select("company_id", "why", *plain)


def _context_sql(most: str) -> str:
    return f"""with {_LINES_SQL},
    i as (select company, item, 's' || item % 9 as source, case when score > 25 then 'filing' else 'news' end as kind, case when score % 7 <> 0 then o_orderdate end as published, o_orderdate as fetched, score, o_orderstatus from items),
    best as (select max((score, item)).struct_extract(2) as item from i group by company),
    scored as (select * from i where o_orderstatus <> 'F' order by published desc nulls last, item, company {most}),
    both_ as (select 1 as r, 'representative' as why, i.* from i join best using (item) union all select 2, 'scored ' || score, * from scored),
    one as (select * from both_ qualify row_number() over (partition by company, item order by r, why) = 1),
    late as (select company, item, bool_or(coalesce(published, fetched) >= timestamp '{_NOW}' - interval 3 days) as fetched from both_ group by all)"""


def _siblings(spark: SparkSession, sf_dir: str, most: int | None) -> tuple[DataFrame, DataFrame]:
    now: Column = F.lit(_NOW).cast("timestamp")
    return sibling_context(*_context(spark, sf_dir), now - F.make_dt_interval(F.lit(3)), now, most=most)


@query(f"{_context_sql('limit 2000')} select company as company_id, item as item_id, why, kind as source_type, published as published_at, late.fetched from one join late using (company, item)")
def sibling_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What else each company did, from its representative item and the 2,000 latest scored ones."""
    return _siblings(spark, sf_dir, 2_000)[0]


@query(f"{_context_sql('')} select company as company_id, item as item_id, why, kind as source_type, published as published_at, late.fetched from one join late using (company, item)")
def sibling_items_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from all scored items."""
    return _siblings(spark, sf_dir, None)[0]


@query(f"{_context_sql('limit 2000')} select item as item_id, any_value(source) as source, 'http://x/' || item as url, any_value(published)::date as day from (select item, source, published from both_ union select item, source, published from i where score >= 45) group by item")
def sibling_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source, address and day of every item that a point may cite."""
    return _siblings(spark, sf_dir, 2_000)[1]


@query(f"""
    with recent as (select o_custkey as k, bool_or(o_orderstatus = 'O' and o_orderdate > timestamp '{_NOW}' - interval 30 days) as active from orders group by 1),
    signals as (select user_id as k, bool_or(event_type = 'view') as week, bool_or(event_type = 'click') as any_signal, bool_or(event_type = 'purchase') as assessed from events group by 1),
    c as (select c_custkey, c_mktsegment <> 'MACHINERY' as in_scope, coalesce(active, false) as active, coalesce(week, false) as week, coalesce(any_signal, false) as any_signal, coalesce(assessed, false) as assessed
        from customer left join recent r on r.k = c_custkey left join signals s on s.k = c_custkey)
    select (select count(*) from orders where o_orderstatus = 'P') as filter, count(*) filter (active and not week) as score, count(*) filter (in_scope and any_signal and not assessed) as assess from c""")
def backlogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much waits to be filtered, scored and assessed; each table is read once."""
    orders, events, customer = (read(spark, sf_dir, t) for t in ("orders", "events", "customer"))
    now = F.lit(_NOW).cast("timestamp")
    kind = lambda k: F.col("event_type") == k
    items = orders.select(F.explode(F.array(F.struct(F.concat(F.lit("c"), "o_custkey").alias("k"), ((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") > now - F.make_dt_interval(F.lit(30)))).alias("active"), F.lit(False).alias("fetched")),
                                          F.struct(F.concat(F.lit("i"), "o_orderkey").alias("k"), F.lit(False).alias("active"), (F.col("o_orderstatus") == "P").alias("fetched")))).alias("x")).select("x.*")
    return queue_sizes(
        [
            (items, "k", {"fetched": F.col("fetched"), "active": F.col("active")}),
            (events.withColumn("k", F.concat(F.lit("c"), "user_id")), "k", {"week": kind("view"), "signal": kind("click"), "assessed": kind("purchase")}),
            (customer.withColumn("k", F.concat(F.lit("c"), "c_custkey")), "k", {"company": F.lit(True), "in_scope": F.col("c_mktsegment") != "MACHINERY"}),
        ],
        {
            "filter": F.col("fetched"), "score": F.col("company") & F.col("active") & ~F.col("week"),
            "assess": F.col("in_scope") & F.col("signal") & ~F.col("assessed"),
        },
    )


@query("""
    with p as (select date_trunc('minute', ts) as minute, count(*) filter (event_type = 'view') as v, count(*) filter (event_type = 'purchase') as p from events group by 1)
    select minute, sum(v) over (order by minute range between interval 4 minutes preceding and current row)::bigint as scored_5m, sum(p) over (order by minute range between interval 29 minutes preceding and current row)::bigint as assessed_30m from p""")
def work_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items scored in the last five minutes and companies assessed in the last thirty, at each minute."""
    kind = lambda k: F.col("event_type") == k
    return sliding_rates(read(spark, sf_dir, "events"), "ts", {"scored_5m": (kind("view"), 5), "assessed_30m": (kind("purchase"), 30)})
