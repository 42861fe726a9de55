"""Queries over the weekly relation and what stands beside it: customers are companies, orders items and opportunities, suppliers people, events reviews and assessments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlens.functions import gates, text
from harborlens.functions.dates import week_of
from harborlens.operators import week as weekly
from harborlens.operators.shared import numbered
from harborlens.operators.placement import detail, place
from harborlens.plans.registry import query, read
from harborlens.plans.relational import PLACED_SQL

ASOF = "2001-08-02"
HIDDEN = ("FURNITURE",)


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("company_id"), F.when(k % 7 == 0, F.concat(F.lit("Ann Lee"), (k % 100).cast("string"))).otherwise(F.col("c_name")).alias("company_name"), F.when(k % 8 != 0, F.array("c_mktsegment")).alias("sectors"),
        F.when(k % 11 == 0, "out_of_scope").when(k % 3 == 0, "in_scope").alias("scope_status"), F.when(F.col("c_acctbal") < 0, "portfolio").when(k % 2 == 0, "news").alias("discovered_via"),
        F.concat(F.lit("N"), "c_nationkey").alias("state"), F.when(k % 4 != 0, F.concat(F.lit("City "), (k % 9).cast("string"))).alias("city"),
    )


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(
        k.alias("item_id"), F.col("o_custkey").alias("company_id"), F.when(F.col("o_orderstatus") == "P", "dropped").otherwise("kept").alias("status"), F.when(k % 5 != 0, F.floor(k / 4) * 4).alias("cluster_id"),
        F.concat(F.lit("Story "), k.cast("string")).alias("title"), F.concat(F.lit("s"), (k % 9).cast("string")).alias("source"), F.when(k % 6 != 0, at).alias("published_at"),
        (at + F.make_dt_interval((k % 10).cast("int"))).alias("fetched_at"),
    )


def _base(spark: SparkSession, sf_dir: str, week: str | None) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("company_id"), "event_id", "event_type", "value", (F.col("ts").cast("timestamp") - F.make_dt_interval(F.lit(8400))).alias("at"))
    kind = lambda name: events.where(F.col("event_type") == name)
    signals = o.withColumn("week_of", week_of(F.col("o_orderdate"))).groupBy(F.col("o_custkey").alias("company_id"), "week_of").agg(F.max("o_orderkey").alias("item_id"), F.max(k % 4).alias("expansion"), F.max(F.floor(k / 4) % 4).alias("momentum"), F.max(F.floor(k / 16) % 4).alias("partnership"))
    signals = signals.withColumn("version", F.when(F.col("company_id") % 10 == 9, "v7").otherwise("v8"))
    people = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("person_id"), F.when(F.col("s_suppkey") % 5 == 0, "Cloud Platform").otherwise(F.concat(F.lit("Ann Lee"), (F.col("s_suppkey") % 100).cast("string"))).alias("name"),
        F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit("@x.com"))).alias("email"), F.when(F.col("s_suppkey") % 2 == 0, "in/x").alias("profile"),
    )
    roles = read(spark, sf_dir, "lineitem").join(o, k == F.col("l_orderkey")).select(F.col("o_custkey").alias("company_id"), F.col("l_suppkey").alias("person_id"))
    return weekly.weekly_base(
        signals, _companies(spark, sf_dir), _items(spark, sf_dir), kind("purchase").select("company_id", F.col("at").alias("assessed_at"), F.col("event_id").alias("priority"), F.lit("high").alias("fit")),
        kind("view").select("company_id", F.when(F.col("value") < 30, "confirmed").otherwise("open").alias("status"), (F.col("event_id") % 3 == 0).alias("do_not_use"), F.col("event_id").alias("note"), F.col("at").alias("confirmed_at")),
        roles, people, o.select(F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("owner"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"), F.col("o_orderdate").alias("created_at"), k.alias("opportunity_id")),
        kind("error").select("company_id", (F.col("value") < 2).alias("hide"), F.when(F.col("event_id") % 2 == 0, F.col("at")).alias("resolved_at")),
        kind("click").where("value < 3").select("company_id", (F.col("event_id") % 4 == 0).alias("permanent"), F.col("at").alias("dismissed_at")), "v8", week, HIDDEN,
    )


def _told(base: DataFrame) -> DataFrame:
    reach = F.array_join(F.transform("contacts", lambda c: F.concat_ws(" ", c["rank"].cast("string"), c["name"], c["person_id"].cast("string"))), "; ")
    return base.select(
        "company_id", "week_of", "company_name", "item_id", "expansion", "momentum", "partnership", "title", "source", F.col("priority").alias("assessment"), F.col("cluster_size").cast("long").alias("cluster_size"),
        "warm_path", F.coalesce(reach, F.lit("")).alias("contacts"), "opportunity_owner", F.col("opportunity_since").cast("date").alias("opportunity_since"),
    )


_WEEK = "({0}::date - ((isodow({0}::date) + 1) % 7)::int)"
_BASE_SQL = f"""
    with e as (select user_id as company_id, event_id, event_type, value, ts - interval 8400 day as told from events),
    c as (select c_custkey as company_id, case when c_custkey % 7 = 0 then 'Ann Lee' || c_custkey % 100 else c_name end as company_name from customer
        where c_custkey % 11 <> 0 and c_acctbal >= 0 and (c_custkey % 8 = 0 or c_mktsegment <> 'FURNITURE')),
    i as (select o_orderkey as item_id, o_custkey as company_id, o_orderstatus <> 'P' as kept, case when o_orderkey % 5 <> 0 then o_orderkey // 4 * 4 end as cluster_id, 'Story ' || o_orderkey as title, 's' || o_orderkey % 9 as source,
        case when o_orderkey % 6 <> 0 then o_orderdate end as published, o_orderdate + (o_orderkey % 10)::int * interval 1 day as fetched from orders),
    active as (select distinct company_id, {_WEEK.format('published')} as week_of from i where kept and published is not null
        union select company_id, {_WEEK.format('fetched')} from i where kept and (published is null or published::date >= {_WEEK.format('fetched')} - 5)),
    s as (select o_custkey as company_id, {_WEEK.format('o_orderdate')} as week_of, max(o_orderkey) as item_id, max(o_orderkey % 4) as expansion, max(o_orderkey // 4 % 4) as momentum, max(o_orderkey // 16 % 4) as partnership
        from orders where o_custkey % 10 <> 9 group by 1, 2),
    a as (select company_id, arg_max(event_id, (told, event_id)) as assessment from e where event_type = 'purchase' group by 1),
    w as (select company_id, arg_max(event_id, (told, event_id)) as warm_path from e where event_type = 'view' and value < 30 and event_id % 3 <> 0 group by 1),
    hidden as (select distinct company_id from e where event_type = 'error' and value < 2 and event_id % 2 <> 0),
    gone as (select company_id, bool_or(event_id % 4 = 0) as for_good, max(told) as until from e where event_type = 'click' and value < 3 group by 1),
    p as (select s_suppkey as person_id, 'Ann Lee' || s_suppkey % 100 as name, case when s_suppkey % 3 = 0 then 0 when s_suppkey % 2 = 0 then 1 else 2 end as rank from supplier where s_suppkey % 5 <> 0),
    met as (select distinct o_custkey as company_id, person_id, name, rank from lineitem join orders on o_orderkey = l_orderkey join p on person_id = l_suppkey join (select c_custkey, case when c_custkey % 7 = 0 then 'Ann Lee' || c_custkey % 100 else c_name end as cn from customer) on c_custkey = o_custkey where name <> cn),
    four as (select *, row_number() over (partition by company_id order by person_id) as n from met),
    reach as (select company_id, string_agg(rank || ' ' || name || ' ' || person_id, '; ' order by rank, name, person_id) as contacts from four where n <= 4 group by 1),
    opp as (select o_custkey as company_id, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) as opportunity_owner, min(o_orderdate)::date as opportunity_since from orders where o_orderstatus <> 'F' group by 1),
    size as (select cluster_id, count(*) as n from i where cluster_id is not null group by 1),
    base as (select s.company_id, s.week_of, company_name, s.item_id, s.expansion, s.momentum, s.partnership, i.title, i.source, assessment, coalesce(size.n, 0) as cluster_size, warm_path, coalesce(contacts, '') as contacts, opportunity_owner, opportunity_since
        from s join active using (company_id, week_of) join c on c.company_id = s.company_id join i on i.item_id = s.item_id left join a on a.company_id = s.company_id left join w on w.company_id = s.company_id left join reach r on r.company_id = s.company_id
        left join opp on opp.company_id = s.company_id left join size on size.cluster_id = s.item_id left join gone g on g.company_id = s.company_id
        where s.company_id not in (select company_id from hidden) and not coalesce(for_good, false) and (until is null or published > until))"""


@query(f"{_BASE_SQL} select * from base")
def weekly_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly relation of all weeks at once."""
    return _told(_base(spark, sf_dir, None))


@query(f"{_BASE_SQL} select * from base where week_of = (select max(week_of) from s)")
def weekly_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly relation of the latest week."""
    return _told(_base(spark, sf_dir, "latest"))


@query(f"""with s as ({_BASE_SQL}
    select base.item_id, base.company_id, expansion, momentum, partnership, ['funding', 'hiring', 'launch', 'partnership', 'noise'][base.item_id % 5 + 1] as signal_type,
        case assessment % 5 when 0 then 'unknown' when 1 then 'low' when 2 then 'medium' else 'high' end as priority, case when assessment is not null then ['high', 'medium', 'low'][base.company_id % 3 + 1] end as fit,
        ['known', 'in_conversation', 'unfamiliar'][base.company_id % 3 + 1] as familiarity, published as published_at, cluster_size, ['series_a', 'seed', 'series_d', ''][base.company_id % 4 + 1] as round,
        base.item_id * 1e6 as valuation_usd, base.item_id * 1e4 as round_usd, 'Elsewhere' as hq from base join i on i.item_id = base.item_id where week_of = (select max(week_of) from base)),
    {PLACED_SQL.replace("greatest(0, 30 - floor(", "case when published_at is null then 10 else greatest(0, 30 - floor(").replace("/ 86400)) as fresh", "/ 86400)) end as fresh")}""")
def weekly_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the latest week with anything in it, placed from the weekly relation."""
    base = _base(spark, sf_dir, None)
    last = base.agg(F.max("week_of")).first()[0]
    c, i, a = F.col("company_id"), F.col("item_id"), F.col("priority")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    signals = base.where(F.col("week_of") == F.lit(last)).select(
        "item_id", "company_id", "expansion", "momentum", "partnership", pick(["funding", "hiring", "launch", "partnership", "noise"], i % 5).alias("signal_type"),
        F.when(a % 5 == 0, "unknown").when(a % 5 == 1, "low").when(a % 5 == 2, "medium").otherwise("high").alias("priority"), F.when(a.isNotNull(), pick(["high", "medium", "low"], c % 3)).alias("fit"),
        pick(["known", "in_conversation", "unfamiliar"], c % 3).alias("familiarity"), "published_at", F.col("cluster_size"), pick(["series_a", "seed", "series_d", ""], c % 4).alias("round"),
        (i * 1e6).alias("valuation_usd"), (i * 1e4).alias("round_usd"), F.lit("Elsewhere").alias("hq"),
    )
    placed = place(signals, F.lit(ASOF).cast("timestamp"))
    return placed.select("item_id", "company_id", "section", F.col("rank").cast("double").alias("rank"), "position", detail(F.col("position")).alias("detail"))


@query("""
    with d as (select doc_id, doc_id % 12 as k from documents)
    select doc_id, case k when 0 then 'blocked_domain:zacks.com' when 1 then 'blocked_source:Motley Fool' when 2 then 'junk_pattern:listicle' when 3 then 'company_mismatch' when 5 then 'no_company_match' when 7 then 'no_published_date' when 8 then 'older_than_30d' end as dropped_reason,
        case when k in (0, 1, 2, 3, 5, 7, 8) then 'dropped' when k = 6 then 'context' else 'kept' end as status from d""")
def item_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items through all stages of the filter: each kind fails one rule, or several of which the first counts."""
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id") % 12
    asof = F.lit(ASOF).cast("timestamp")
    rows = d.select(
        "doc_id", F.when(k == 0, "https://www.zacks.com/x").otherwise(F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string"))).alias("url"), F.when(k.isin(0, 1), "Motley Fool").otherwise(F.col("source")).alias("source"),
        F.when(k.isin(0, 1, 2), "10 Best Startups of the year").when(k == 3, "Another firm opens a plant").otherwise("Acme Corp opens a plant").alias("title"), F.substr("text", F.lit(1), F.lit(0)).alias("snippet"),
        F.when(~k.isin(5, 6), F.col("doc_id")).alias("company_id"), F.when(k != 10, F.array(F.lit("Acme Corp"))).alias("terms"), F.when(k == 9, "ats").when(k == 6, "context").otherwise("news").alias("source_type"),
        F.when(k == 8, asof - F.make_dt_interval(F.lit(31))).when(~k.isin(7, 9), asof - F.make_dt_interval(F.lit(29))).alias("published_at"),
    )
    return weekly.filter_cascade(rows, asof).select("doc_id", "dropped_reason", "status")


@query("""
    select o_orderkey as opportunity_id, o_custkey as company_id, coalesce(case when o_orderkey % 3 <> 0 then o_orderpriority end, 'Unassigned') as owner, coalesce(case when o_orderkey % 2 = 0 then 'call' end, '—') as next_action,
        case when o_orderkey % 5 <> 0 then o_orderdate::date end as due_date from orders join customer on c_custkey = o_custkey where o_orderstatus <> 'F'""")
def open_opportunity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All open opportunities with owner, next action and due date."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(
        k.alias("opportunity_id"), F.col("o_custkey").alias("company_id"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("owner"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"),
        F.when(k % 2 == 0, "call").alias("next_action"), F.when(k % 5 != 0, F.to_date("o_orderdate")).alias("due_date"),
    )
    return weekly.opportunity_list(o, _companies(spark, sf_dir)).select("opportunity_id", "company_id", "owner", "next_action", "due_date")


@query("""
    select event_id as dismissal_id, c_custkey as company_id, case when c_custkey % 4 <> 0 then 'City ' || c_custkey % 9 || ', ' else '' end || 'N' || c_nationkey as hq, case when event_id % 2 = 0 then 'too early' else '' end as reasons, coalesce(s_name, 'Someone') as by_name
    from events join customer on c_custkey = user_id left join supplier on s_suppkey = event_id % 150 where event_type = 'click'""")
def dismissals_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dismissals, and who made them."""
    e = read(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("event_id").alias("dismissal_id"), F.col("user_id").alias("company_id"), (F.col("event_id") % 150).alias("user_id"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("too early"))).alias("reasons"), F.col("ts").alias("dismissed_at"))
    users = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("user_name"))
    return weekly.dismissal_list(e, _companies(spark, sf_dir), users).select("dismissal_id", "company_id", "hq", F.array_join("reasons", ",").alias("reasons"), "by_name")


@query("""
    with p as (select n_nationkey as id, case when n_nationkey % 6 = 0 then ['cross_sector'] when n_nationkey % 2 = 0 then ['FURNITURE', 'BUILDING'] else ['MACHINERY', 'HOUSEHOLD', 'AUTOMOBILE'] end as sectors from nation)
    select c_custkey as company_id, id as proposition_id from customer, p where list_contains(sectors, 'cross_sector') or (c_custkey % 8 <> 0 and list_contains(sectors, c_mktsegment))""")
def proposition_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which propositions a company may be told: those of its sectors, and those for all."""
    n = F.col("n_nationkey")
    sectors = F.when(n % 6 == 0, F.array(F.lit("cross_sector"))).when(n % 2 == 0, F.array(F.lit("FURNITURE"), F.lit("BUILDING"))).otherwise(F.array(F.lit("MACHINERY"), F.lit("HOUSEHOLD"), F.lit("AUTOMOBILE")))
    props = read(spark, sf_dir, "nation").select(n.cast("int").alias("proposition_id"), sectors.alias("sectors"))
    return weekly.matching_propositions(_companies(spark, sf_dir).withColumnRenamed("sectors", "axes"), props)


@query("""
    select c_custkey, c_nationkey = 7 and n_regionkey = 2 as place_and_area, c_mktsegment = 'BUILDING' as sector_anywhere, upper(trim(c_mktsegment)) in ('BUILDING', 'MACHINERY') as heavy,
        case when c_mktsegment in ('BUILDING', 'MACHINERY') then lower(c_mktsegment) else 'other' end as word from customer join nation on n_nationkey = c_nationkey""")
def facet_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers a reader's choice of place, area and sector shows, and words held to a vocabulary."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    hq, area, sectors = F.col("c_nationkey").cast("string"), F.col("n_regionkey").cast("string"), F.array("c_mktsegment")
    word = weekly.known_word(F.concat(F.lit(" "), F.initcap("c_mktsegment"), F.lit(" ")), ("building", "machinery"), "other")
    return c.select("c_custkey", weekly.in_place(hq, area, sectors, "7", "2").alias("place_and_area"), weekly.in_place(hq, area, sectors, area="all", sector="BUILDING").alias("sector_anywhere"), (word != "other").alias("heavy"), word.alias("word"))


@query("""
    with done as (select distinct user_id from events where event_type = 'purchase'), c as (select c_custkey, case when c_acctbal < 0 then 'portfolio' when c_custkey % 2 = 0 then 'news' end as via from customer)
    select 'new' as targets, c_custkey as company_id from c where c_custkey not in (select user_id from done) union all select 'all', c_custkey from c union all select 'new in news', c_custkey from c where via = 'news' and c_custkey not in (select user_id from done)""")
def targets_by_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies to be scored: those not yet done, all of them by force, and those of one channel."""
    c = _companies(spark, sf_dir)
    done = read(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("company_id"), F.lit("v8").alias("version"))
    out = None
    for name, flags in (("new", {}), ("all", {"force": True}), ("new in news", {"via": "news"})):
        part = weekly.work_targets(c, done, "v8", **flags).select(F.lit(name).alias("targets"), "company_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
    select o_orderkey, case when v <= 0 then 'Unknown' when v >= 1e12 then '$' || regexp_replace(printf('%.1f', v / 1e12), '\\.0$', '') || 'T' when v >= 1e9 then '$' || regexp_replace(printf('%.1f', v / 1e9), '\\.0$', '') || 'B'
        when v >= 1e6 then '$' || regexp_replace(printf('%.1f', v / 1e6), '\\.0$', '') || 'M' else '$' || regexp_replace(printf('%.1f', v / 1e3), '\\.0$', '') || 'K' end as label
    from (select o_orderkey, ((o_orderkey % 997 - 3) * 1024) * (1024::double ** (o_orderkey % 4)) as v from orders)""")
def money_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of four orders of magnitude as labels, none for nothing."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.usd_label(((k % 997 - 3) * 1024) * F.pow(F.lit(1024.0), k % 4)).alias("label"))


@query("""
    select o_custkey, fresh, cast(row_number() over (order by fresh desc, o_custkey) as bigint) as place from (
        select o_custkey, min(o_orderdate) >= timestamp '1996-06-01' as fresh from orders group by 1) where fresh or o_custkey % 3 = 19723 % 3""")
def cohort_rotation_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the customers each day, and all new ones, new ones first."""
    c = read(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.min("o_orderdate") >= F.lit("1996-06-01").cast("timestamp_ntz")).alias("fresh"))
    due = c.where(F.col("fresh") | (F.pmod("o_custkey", F.lit(3)) == 19723 % 3)).withColumn("stale", ~F.col("fresh"))
    return numbered(due, ["stale", "o_custkey"], "n").select("o_custkey", "fresh", (F.col("n") + 1).cast("long").alias("place"))


@query("""
    select page_id, page_id % 5 = 0 and page_id % 2 = 1 as challenge from pages""")
def page_checks_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which whole pages ask whether the reader is a robot."""
    i = F.col("page_id")
    body = F.concat(F.when(i % 5 == 0, "Just a moment... ").otherwise(""), F.when(i % 2 == 0, "<rss version=2>").otherwise(""), F.coalesce("html", F.lit("")))
    return read(spark, sf_dir, "pages").select("page_id", gates.bot_challenge(body).alias("challenge"))
