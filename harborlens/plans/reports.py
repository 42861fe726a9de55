"""Queries over lists and findings: suppliers and customers are companies, orders are watches and runs, events are calls and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlens.functions import derive
from harborlens.functions.gates import APAC, in_apac
from harborlens.operators import reports
from harborlens.plans.gates import PLACE, TITLE
from harborlens.plans.registry import query, read

_EVENTS_END = "2024-02-01"


@query(f"""
    with people as (select p_partkey as person_id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || case when p_size % 9 = 0 then ' Platform' else '' end as name,
        case when p_size % 3 = 0 then p_brand || '@x.com' end as email, case when p_size % 2 = 0 then 'in/' || p_partkey end as profile from part),
    met as (select distinct l_suppkey as company_id, person_id, name, case when email is not null then 0 when profile is not null then 1 else 2 end as rank from lineitem join people on person_id = l_partkey
        where regexp_matches(name, '^[A-Z][a-z]+ [A-Z]') and name not like '%Platform%'),
    n as (select *, row_number() over (partition by company_id order by person_id) as i from met)
    select company_id, string_agg(rank || ' ' || name || ' ' || person_id, '; ' order by rank, name, person_id) as contacts from n where i <= 4 group by 1""")
def company_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom to reach at each supplier."""
    name = F.concat(F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), " "), F.when(F.col("p_size") % 9 == 0, " Platform").otherwise(""))
    people = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("person_id"), name.alias("name"), F.when(F.col("p_size") % 3 == 0, F.concat("p_brand", F.lit("@x.com"))).alias("email"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("in/"), F.col("p_partkey").cast("string"))).alias("profile"),
    )
    roles = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("company_id"), F.col("l_partkey").alias("person_id"), F.col("l_shipdate").alias("last_seen"))
    companies = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("company_name"))
    shown = F.transform("contacts", lambda c: F.concat_ws(" ", c["rank"].cast("string"), c["name"], c["person_id"].cast("string")))
    return reports.contacts(roles, people, companies).select("company_id", F.array_join(shown, "; ").alias("contacts"))


_SIG = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9$%. ]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 and w not in " + str(reports.POINT_STOP) + "))"


@query(f"""
    with t as (select conv_id, turn, role, unnest(list_filter(list_transform(string_split(replace(text, chr(10), ' · '), ' · '), lambda x: trim(x, ' ')), lambda x: x <> '')) as text,
        generate_subscripts(list_filter(list_transform(string_split(replace(text, chr(10), ' · '), ' · '), lambda x: trim(x, ' ')), lambda x: x <> ''), 1) as pos from conversations),
    o as (select conv_id, list([{{'text': text, 'turn': turn, 'role': role, 'words': {_SIG.format('text')}}}] order by case when turn = 0 and role = 'user' then 0 when role = 'assistant' then 1 else 2 end, case when turn = 0 and role = 'user' then 0 else -turn end, turn * 2 + case when role = 'assistant' then 1 else 0 end, pos) as items from t group by 1),
    r as (select conv_id, list_reduce(items, lambda acc, x: case when len(acc) >= 4 or len(list_filter(acc, lambda y: least(len(y.words), len(x[1].words)) > 0 and len(list_intersect(y.words, x[1].words)) >= 0.6 * least(len(y.words), len(x[1].words)))) > 0
        then acc else list_concat(acc, x) end) as p from o)
    select conv_id, len(p) as n, sha256(array_to_string(list_transform(p, lambda x: x.text), '|')) as points_sha256, len(list_filter(p, lambda x: x.role = 'assistant')) between 1 and len(p) - 1 as mixed from r""")
def reasons_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four differing points of each conversation: its first turn's, then the assistant's, then the latest."""
    t = read(spark, sf_dir, "conversations")
    first = (F.col("turn") == 0) & (F.col("role") == "user")
    items = t.select(
        "conv_id", (F.col("turn") * 2 + F.when(F.col("role") == "assistant", 1).otherwise(0)).cast("long").alias("item_id"), F.replace("text", F.lit("\n"), F.lit(" · ")).alias("why"),
        (F.col("role") == "assistant").alias("job_board"), F.timestamp_seconds("turn").alias("published_at"), first.alias("featured"),
    )
    p = reports.why_now(items, "conv_id")
    return p.select("conv_id", F.size("points").cast("long").alias("n"), F.sha2(F.array_join("points.text", "|"), 256).alias("points_sha256"), "mixed")


@query("""
    select o_custkey as company_id, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as watchers, cast(max(o_orderdate) as date) as newest, any_value(s.signal_id) as signal_id from orders
        left join (select o_custkey as c, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as signal_id from orders where o_orderstatus = 'F' group by 1) s on s.c = o_custkey
    where o_orderstatus <> 'O' group by 1""")
def monitored_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that somebody watches, with all who do and the latest signal."""
    o = read(spark, sf_dir, "orders")
    watches = o.select(F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("watcher"), F.col("o_orderdate").alias("added_at"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate")).alias("removed_at"))
    signals = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("signal_id"), F.col("o_totalprice").alias("signal_at"))
    return reports.monitored(watches, signals).select("company_id", F.array_join("watchers", ",").alias("watchers"), F.col("newest").cast("date").alias("newest"), "signal_id")


@query(f"""
    with r as (select user_id as source, count(*) filter (event_type <> 'error') as n, max(case when event_type = 'error' then 'failed' end) as error, count(*) filter (event_type = 'view') > 0 as reached,
        user_id % 17 = 0 as blocked, max(ts) filter (event_type = 'signup') as newest from events group by 1)
    select source, case when blocked then 'blocked' when error is not null and not reached then 'down' when n = 0 then 'zero_volume' when newest < timestamp '{_EVENTS_END}' - interval 20 day then 'stale' else 'ok' end as status,
        case when error is not null and not reached then case when source % 2 = 0 then timestamp '2023-12-01' end else timestamp '{_EVENTS_END}' end as last_success from r""")
def source_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's health: blocked, down, without volume, stale or ok."""
    e = read(spark, sf_dir, "events")
    runs = e.groupBy(F.col("user_id").alias("source")).agg(
        F.count_if(F.col("event_type") != "error").alias("n"), F.max(F.when(F.col("event_type") == "error", "failed")).alias("error"), (F.count_if(F.col("event_type") == "view") > 0).alias("reached"),
        F.max(F.when(F.col("event_type") == "signup", F.col("ts").cast("timestamp_ntz"))).alias("newest"),
    ).withColumn("blocked", F.col("source") % 17 == 0)
    before = e.select(F.col("user_id").alias("source")).distinct().select("source", F.when(F.col("source") % 2 == 0, F.lit("2023-12-01").cast("timestamp_ntz")).alias("last_success"))
    return reports.source_status(runs, before, F.lit(_EVENTS_END).cast("timestamp_ntz"), 20)


@query("""
    select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '2-HIGH' and o_orderstatus <> 'F')
        and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O')""")
def open_follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers not hidden by a pending review for whom nothing is open."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey")
    reviews = o.select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderpriority") == "2-HIGH").alias("hide"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("resolved_at"))
    opened = o.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") != "O", "closed").otherwise("open").alias("status"))
    return reports.follow_ups(reports.without_pending(c, reviews, "c_custkey"), opened, "c_custkey")


@query("""
    with c as (select event_id, user_id, cast(round(value * 100) as bigint) as cost, coalesce(sum(cast(round(value * 100) as bigint)) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as spent, ts from events)
    select user_id, count(*) as calls, count(*) filter (spent < 20000) as allowed, max(spent)::bigint as spent, count(*) filter (ts > timestamp '2024-01-20' - interval 90 minute) as counted from c group by 1""")
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's calls, those made before the budget was spent, and those that a sliding window still counts."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cost"))
    spent = reports.spent_until_halt(e, "user_id", ["ts", "event_id"], "cost", 20000)
    counted = reports.within_window(e, "ts", F.lit("2024-01-20").cast("timestamp_ntz"), 90).groupBy("user_id").agg(F.count(F.lit(1)).alias("counted"))
    sums = spent.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if("allowed").alias("allowed"), F.max("spent").alias("spent"))
    return sums.join(counted, "user_id", "left").fillna(0, ["counted"])


_BACK = r"(?i)\bsingapore\b"


@query(f"""
    with p as (select c_nationkey, c_custkey, {TITLE} as title, {PLACE} as place from customer),
    h as (select c_nationkey, count(*) as now, count(*) filter (c_custkey % 3 > 0) as before, count(*) filter (regexp_matches(place, '(?i)\\bsingapore\\b')) as sg,
        count(*) filter (regexp_matches(place, '{APAC}')) as apac, count(*) filter (regexp_matches(title, '(?i)\\bcountry manager\\b')) as execs from p group by 1)
    select c_nationkey, array_to_string(list_filter([case when execs > 0 then execs || ' executive roles' end, case when sg > 0 then sg || ' roles in Singapore' when apac >= 2 then apac || ' roles in APAC' end,
            case when before >= 20 and now - before >= 5 and (now - before) / before > 0.25 then (now - before) || ' roles more than before' end], lambda x: x is not null), '; ') as claims,
        format('{{:,}}', now) || ' items read, ' || format('{{:,}}', before) || ' kept, ' || format('{{:,}}', sg) || ' shown' as coverage from h""")
def nation_hiring_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be said of each nation's postings, and how many were read."""
    p = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.expr(TITLE).alias("title"), F.expr(PLACE).alias("place"))
    h = p.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("now"), F.count_if(F.col("c_custkey") % 3 > 0).alias("before"), F.count_if(F.col("place").rlike(_BACK)).alias("sg"), F.count_if(in_apac(F.col("place"))).alias("apac"),
        F.count_if(F.col("title").rlike(r"(?i)\bcountry manager\b")).alias("execs"),
    )
    c = F.col
    return h.select("c_nationkey", F.array_join(reports.hiring_claims(c("execs"), c("sg"), c("apac"), c("before"), c("now")), "; ").alias("claims"), reports.coverage_line(c("now"), c("before"), c("sg")).alias("coverage"))


@query("""
    with s as (select o_custkey, 0 as section from orders where o_orderpriority = '1-URGENT' union all select o_custkey, 1 from orders where o_totalprice > 400000 union all select c_custkey, 2 from customer where c_acctbal > 5000)
    select o_custkey, min(section) as section from s group by 1""")
def placed_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of all sections, each in the first that has it."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return reports.placed_once([o.where("o_orderpriority = '1-URGENT'").select("o_custkey"), o.where("o_totalprice > 400000").select("o_custkey"), c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))], "o_custkey")


_ASOF = "2001-07-01"
_RUNS = "select o_custkey as stage, o_orderdate as started_at, case when o_orderstatus <> 'O' then o_orderdate end as finished_at, case when o_orderstatus = 'P' then 'x' end as error from orders"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("stage"), F.col("o_orderdate").cast("timestamp_ntz").alias("started_at"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("finished_at"), F.when(F.col("o_orderstatus") == "P", "x").alias("error")
    )


@query(f"""
    with runs as ({_RUNS}), clean as (select stage from runs where finished_at is not null and error is null and started_at > timestamp '{_ASOF}' - interval 4800 hour)
    select c_custkey as stage, 1.0 * c_acctbal as pos from customer where c_custkey not in (select stage from clean) order by c_acctbal, c_custkey limit 1""")
def resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage that hasn't finished cleanly of late."""
    stages = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stage"), F.col("c_acctbal").cast("double").alias("pos"))
    return reports.resume_point(stages, _runs(spark, sf_dir), F.lit(_ASOF).cast("timestamp_ntz"), 4800)


@query(f"""
    with runs as ({_RUNS}), clean as (select stage from runs where finished_at is not null and error is null and started_at > timestamp '{_ASOF}' - interval 18 hour),
    missing as (select s_suppkey as stage from supplier where s_suppkey not in (select stage from clean) and s_nationkey % 4 <> 0)
    select 'error' as severity, 'stranded-run' as code, stage::varchar as subject from runs where finished_at is null and started_at < timestamp '{_ASOF}' - interval 45 minute
    union all select 'warn', 'source-down', s_suppkey::varchar from supplier where s_acctbal < 1000 and s_nationkey % 2 = 0
    union all select case when (select count(*) from missing) > 3 then 'error' else 'warn' end, 'missing-stage', stage::varchar from missing
    union all select 'warn', 'queue', count(*)::varchar from events where event_type = 'error' having count(*) > 500""")
def health_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs left open, sources down, stages missing and a long queue, as rows."""
    s = read(spark, sf_dir, "supplier")
    stages = s.select(F.col("s_suppkey").alias("stage"), (F.col("s_nationkey") % 4 == 0).alias("needs_model"))
    sources = s.select(F.col("s_suppkey").alias("source"), F.when(F.col("s_acctbal") < 1000, "down").otherwise("ok").alias("status"), F.when(F.col("s_nationkey") % 2 == 0, F.lit("2001-01-01").cast("timestamp_ntz")).otherwise(F.lit(_ASOF).cast("timestamp_ntz")).alias("last_success"))
    queue = read(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "fetched").otherwise("kept").alias("status"))
    return reports.health_findings(stages, _runs(spark, sf_dir), sources, queue, F.lit(_ASOF).cast("timestamp_ntz"), excused=True)


@query("""
    with g as (select p_name as n from part where p_size % 10 = 0 union select p_name || ' ' || p_type from part where p_size % 15 = 0)
    select p_partkey from part where p_name not in (select n from g) and (p_name || ' ' || p_type) not in (select n from g) or false""")
def guarded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name neither is an excluded one's nor one of its aliases."""
    p = read(spark, sf_dir, "part")
    guard = p.where("p_size % 10 = 0").select(F.col("p_name").alias("name"), F.expr("cast(null as array<string>)").alias("aliases")).unionByName(
        p.where("p_size % 15 = 0").select(F.concat_ws(" ", "p_name", "p_type").alias("name"), F.array(F.concat_ws(" ", "p_name", "p_type")).alias("aliases"))
    )
    rows = p.select("p_partkey", "p_name", F.concat_ws(" ", "p_name", "p_type").alias("full"))
    return reports.guarded_out(reports.guarded_out(rows, guard, "p_name"), guard, "full").select("p_partkey")


@query("""
    with i as (select l_orderkey, l_linenumber, l_partkey, l_returnflag = 'R' as jb from lineitem),
    o as (select l_orderkey, list(l_partkey order by jb, l_linenumber, l_partkey) as pts from i group by 1)
    select l_orderkey, array_to_string(pts[1:4], ',') as points from o""")
def demoted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's points with those of job boards (returned lines) behind the others, four at most."""
    one = F.struct("l_linenumber", "l_partkey", (F.col("l_returnflag") == "R").alias("job_board"))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return rows.select("l_orderkey", F.array_join(F.transform(reports.demoted_points(F.col("all")), lambda p: p["l_partkey"].cast("string")), ",").alias("points"))


@query("""
    with o as (select c_nationkey, c_custkey, c_mktsegment, c_acctbal from customer)
    select c_nationkey, to_json(list({'segment': c_mktsegment, 'id': c_custkey} order by c_mktsegment, c_custkey)) as cards from o group by 1""")
def nation_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's customers as nested JSON, in order."""
    one = F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"))
    return read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("cards"))


@query(f"""
    with p as (select c_nationkey, {TITLE} as title, {PLACE} as place from customer),
    h as (select c_nationkey, count(*) as total, count(*) filter (place is not null and place not like '%CA') as non_us, count(*) filter (regexp_matches(place, '{APAC}')) as apac,
        count(*) filter (regexp_matches(place, '(?i)\\bsingapore\\b')) as sg, min(title) filter (regexp_matches(title, '^Country Manager') and c_nationkey % 2 = 0) as lead, max(place) as place from p group by 1)
    select c_nationkey, case when lead is not null and (sg > 0 or regexp_matches(lead || ' ' || coalesce(place, ''), '(?i)apac|asia|singapore|japan|korea|china|india')) then 'N' || c_nationkey || ' is recruiting ' || lead || coalesce(' (' || place || ')', '')
        when sg > 0 then 'N' || c_nationkey || ' is hiring ' || sg || case when sg = 1 then ' role' else ' roles' end || ' in Singapore, mostly sales, and ' || apac || ' across APAC'
        when apac > 0 then 'N' || c_nationkey || ' has ' || apac || ' open APAC roles, mostly sales' else 'N' || c_nationkey || ' has ' || non_us || ' open roles outside the US, none in APAC' end as headline from h""")
def hiring_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headline of each nation's postings."""
    p = read(spark, sf_dir, "customer").select("c_nationkey", F.expr(TITLE).alias("title"), F.expr(PLACE).alias("place"))
    h = p.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("place").isNotNull() & ~F.col("place").endswith("CA")).alias("non_us"), F.count_if(in_apac(F.col("place"))).alias("apac"), F.count_if(F.col("place").rlike(_BACK)).alias("singapore"),
        F.min(F.when(F.col("title").startswith("Country Manager") & (F.col("c_nationkey") % 2 == 0), F.col("title"))).alias("lead_title"), F.max("place").alias("lead_location"), F.lit("sales").alias("top_function"),
    )
    return h.select("c_nationkey", derive.hiring_title(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), F.struct(*h.columns)).alias("headline"))
