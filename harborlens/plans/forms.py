"""Queries over normal forms, cells, windows of time and work queues, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlens.functions import dates, filters, text
from harborlens.operators import queues
from harborlens.plans.registry import query, read

PERSON = "concat(case c_custkey % 4 when 0 then 'Dr. ' when 1 then 'É' else '' end, 'Ann-', c_name, case c_custkey % 5 when 0 then ' Jr.' when 1 then ', PhD' when 2 then ' III' else '' end)"
SITE = "concat(case c_custkey % 4 when 0 then 'HTTPS://www.' when 1 then 'http://' when 2 then ' ' else '' end, 'Site', cast(c_custkey as varchar(12)), case c_custkey % 3 when 0 then '.com/a?b' when 1 then '.io' else '' end)"


@query(f"""
    with p as (select c_custkey, {PERSON} as name, {SITE} as site, case c_custkey % 6 when 0 then '$1,234' when 1 then '' when 2 then 'n/a' when 3 then '12.5' else c_acctbal::varchar end as musd,
        case c_custkey % 5 when 0 then '2020' when 1 then '2021-05' when 2 then '2022-02-30' when 3 then 'x' else '2023-11-09' end as day, ' a |' || c_mktsegment || '||b ' as pipes from customer),
    n as (select *, trim(regexp_replace(regexp_replace(replace(lower(name), 'é', 'e'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as plain, regexp_replace(regexp_replace(lower(trim(site)), '^https?://', ''), '^www\\.', '') as bare from p)
    select c_custkey, trim(regexp_replace(plain, '\\s+(jr|sr|ii|iii|iv|md|phd|dr)$', '')) as person, nullif(regexp_extract(bare, '^([^/?]*)', 1), '') as domain,
        case when regexp_matches(trim(regexp_replace(bare, '(?s)/.*$', '')), '^[a-z0-9-]+(\\.[a-z0-9-]+)+$') then trim(regexp_replace(bare, '(?s)/.*$', '')) end as host,
        cast(floor(try_cast(regexp_replace(trim(musd), '[,$]', '', 'g') as double) + 0.5) as bigint) as millions,
        try_cast(day || case length(day) when 4 then '-01-01' when 7 then '-01' else '' end as date) as day, array_to_string(list_filter(list_transform(string_split(pipes, '|'), lambda x: trim(x)), lambda x: x <> ''), ';') as parts from n""")
def cell_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of names and sites, and what cells hold: millions, days, lists."""
    c = read(spark, sf_dir, "customer")
    musd = F.expr("case c_custkey % 6 when 0 then '$1,234' when 1 then '' when 2 then 'n/a' when 3 then '12.5' else cast(c_acctbal as string) end")
    day = F.expr("case c_custkey % 5 when 0 then '2020' when 1 then '2021-05' when 2 then '2022-02-30' when 3 then 'x' else '2023-11-09' end")
    return c.select(
        "c_custkey", text.normalise_person(F.expr(PERSON)).alias("person"), text.normalise_domain(F.expr(SITE)).alias("domain"), text.bare_domain(F.expr(SITE)).alias("host"), text.million_usd(musd).alias("millions"),
        text.partial_date(day).alias("day"), F.array_join(text.pipe_list(F.concat(F.lit(" a |"), "c_mktsegment", F.lit("||b "))), ";").alias("parts"),
    )


SOURCE = "case doc_id % 7 when 0 then 'Motley Fool' when 1 then 'The Motley Fool' when 2 then ' Zacks Research ' when 3 then 'Yahoo Finance' when 4 then 'Yahoo' when 5 then source else 'Seeking Alpha via MSN' end"


@query(f"""
    with d as (select doc_id, {SOURCE} as src, lower(text) as t, lang from documents),
    l as (select *, ' ' || trim(regexp_replace(translate(t, 'éèêëàâçîïôùûäöüáíóúñ', 'eeeeaaciiouuaouaioun'), '[^a-z0-9]+', ' ', 'g')) || ' ' as loose from d)
    select doc_id, case when regexp_matches(trim(src), {"'" + filters.BLOCKED_SOURCES + "'"}) then trim(src) end as blocked,
        case doc_id % 3 when 0 then contains(loose, ' the of ') or contains(loose, ' que la ') when 1 then true else contains(loose, ' les ') end as mentioned from l""")
def source_and_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers that aren't taken, and whether a text names any of its terms (terms of fewer than three letters don't count, and none pass)."""
    d = read(spark, sf_dir, "documents")
    terms = F.expr("case doc_id % 3 when 0 then array('The, of', 'qué la') when 1 then array('a') else array('LES') end")
    return d.select("doc_id", filters.blocked_source(F.expr(SOURCE)).alias("blocked"), filters.mentions(F.col("text"), terms).alias("mentioned"))


@query("""
    select o_orderkey, o_orderstatus = 'P' or date_diff('day', date '1998-01-01', cast(o_orderdate as date)) between 0 and 400 as planned, o_orderdate > timestamp '2001-01-01' - interval 200 day as recent,
        round(date_diff('second', o_orderdate, timestamp '2001-01-01') / 60, 3)::double as minutes, o_orderdate >= greatest(coalesce(case when o_custkey % 2 = 0 then timestamp '1999-06-01' end, timestamp '1997-01-01'), timestamp '1997-01-01') as arrived,
        case when o_orderkey % 4 = 0 then 2000 + o_orderkey % 30 when o_orderkey % 4 = 1 then 2026 end as year_raw,
        case when o_orderkey % 4 = 0 and 2000 + o_orderkey % 30 between 2025 and 2029 then 2000 + o_orderkey % 30 when o_orderkey % 4 = 1 then 2026 end as url_year from orders""")
def order_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planning window, rolling window, minutes between, arrivals since the previous run, and years in addresses."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    o, when, i = read(spark, sf_dir, "orders"), F.col("o_orderdate").cast("timestamp_ntz"), F.col("o_orderkey")
    year = F.when(i % 4 == 0, 2000 + i % 30).when(i % 4 == 1, 2026)
    url = F.concat(F.lit("https://x.com/2001/"), F.coalesce(year.cast("string"), F.lit("a")), F.lit("/2035"))
    return o.select(
        "o_orderkey", dates.in_planning_window(F.when(F.col("o_orderstatus") != "P", when), F.lit("1998-01-01").cast("date")).alias("planned"), dates.within_days(when, at("2001-01-01"), 200).alias("recent"),
        F.round(dates.minutes_between(when.cast("timestamp"), at("2001-01-01").cast("timestamp")), 3).alias("minutes"),
        queues.arrived_since(when, when, F.when(F.col("o_custkey") % 2 == 0, at("1999-06-01")), at("1997-01-01")).alias("arrived"), year.alias("year_raw"), queues.url_year(url, F.lit(2026)).alias("url_year"),
    )


@query("""
    with n as (select distinct l_suppkey, case when l_partkey % 3 > 0 then l_partkey end as p from lineitem), k as (select distinct l_suppkey, case when l_partkey % 3 > 0 then l_partkey end as p from lineitem where l_returnflag = 'R')
    select l_suppkey, p from n where not exists (select 1 from k where k.l_suppkey = n.l_suppkey and k.p is not distinct from n.p)""")
def new_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants not recorded before, those without a person compared like others."""
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")).alias("p"), "l_returnflag")
    return queues.unseen(rows.select("l_suppkey", "p"), rows.where("l_returnflag = 'R'"), ["l_suppkey", "p"])


@query("""
    select distinct l_partkey as person_id, l_suppkey as company_id from lineitem where l_partkey in (select p_partkey from part where p_size % 4 = 0) and l_suppkey in (select s_suppkey from supplier where greatest(s_nationkey % 4, s_suppkey % 3) >= 3)""")
def people_to_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People without a title at companies with a strong signal."""
    roles = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("person_id"), F.col("l_suppkey").alias("company_id"))
    people = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("person_id"), F.when(F.col("p_size") % 4 != 0, "t").alias("title"))
    signals = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), (F.col("s_nationkey") % 4).alias("expansion"), (F.col("s_suppkey") % 3).alias("partnership"))
    return queues.people_queue(roles, people, signals, 3)


@query("""
    select o_orderkey as item_id from orders where o_orderstatus = 'F' and o_orderkey % 5 in (0, 1) and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'A')""")
def rescore_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept heads of clusters without a score of the current version."""
    i = F.col("o_orderkey")
    items = read(spark, sf_dir, "orders").select(i.alias("item_id"), F.when(i % 5 == 0, i).when(i % 5 > 1, i - 1).alias("cluster_id"), F.when(F.col("o_orderstatus") == "F", "kept").otherwise("dropped").alias("status"))
    scores = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("rubric_version"))
    return queues.rescore_queue(items, scores, "A").select("item_id")


@query("""
    with c as (select c_custkey, 'Ann' || c_custkey || '@x.com' as email from customer)
    select c_custkey, case when c_custkey % 3 <> 0 and c_custkey % 4 <> 1 then lower(email) end as email, case when c_custkey % 2 = 0 then '+65 6' || (100000 + c_custkey) end as phone,
        'https://www.x' || c_custkey || '.com/' || case when c_custkey % 2 = 0 then 'our-team' else 'about' end as page from c""")
def proven_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and numbers that their sources bear out, and the team page among search hits."""
    c, i = read(spark, sf_dir, "customer"), F.col("c_custkey")
    n = i.cast("string")
    email = F.concat(F.lit("Ann"), n, F.lit("@x.com"))
    corpus = F.concat(F.when(i % 4 != 1, F.concat(F.lit("write to "), F.upper(email))).otherwise("nothing"), F.lit(" or call (65) 6-"), (100000 + i).cast("string"))
    source = F.when(i % 3 != 0, "https://a.com").otherwise("https://b.com")
    phone = F.when(i % 2 == 0, F.concat(F.lit("+65 6"), (100000 + i).cast("string"))).otherwise("12")
    one = c.select("c_custkey", queues.proven_email(email, source, F.array(F.lit("https://a.com")), corpus).alias("email"), queues.proven_phone(phone, corpus).alias("phone"))
    base = F.concat(F.lit("https://www.x"), n, F.lit(".com/"))
    urls = F.array(F.concat(base, F.lit("careers/team")), F.lit("https://other.com/team"), F.concat(base, F.lit("about")), F.when(i % 2 == 0, F.concat(base, F.lit("our-team"))).otherwise(base))
    hits = c.select("c_custkey", F.concat(F.lit("x"), n, F.lit(".com")).alias("domain"), F.posexplode(urls).alias("rank", "url"))
    return one.join(queues.team_page(hits, "c_custkey", "domain").withColumnRenamed("url", "page"), "c_custkey")


@query("""
    with e as (select user_id, event_type, count(*) as n, min(ts) as first, max(ts) as last from events group by all)
    select user_id, min(first) as started, max(last) as finished, '{' || string_agg('"' || event_type || '":' || n, ',' order by event_type) || '}' as counts from e group by 1""")
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per stage with a map of what it counted."""
    r = queues.run_ledger(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "user_id", "event_type", "ts")
    return r.select("user_id", "started", "finished", F.to_json("counts").alias("counts"))


@query("select c_custkey, 'unknown' as c_mktsegment, null::double as c_acctbal, c_nationkey from customer")
def guest_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a guest may see them."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_nationkey")
    return queues.masked(c, {"c_mktsegment": "unknown", "c_acctbal": None}, guest=True)
