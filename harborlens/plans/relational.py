"""Queries over orders, events and their dimensions: latest rows, semi and anti joins, rollups, rankings, writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlens.functions.dates import week_label, week_of
from harborlens.functions.filters import volume_trigger
from harborlens.operators.graph import both_ways, canonical_edges, degree_discount, feasibility, reviewed, shared_hub_links
from harborlens.operators.latest import insert_ignore, interleaved_batches, latest_by, repoint, top_per, upsert, with_previous
from harborlens.operators.placement import detail, place
from harborlens.plans.registry import query, read


def cents(c: str) -> Column:
    """Whole cents: their sums are exact in any order."""
    return F.round(F.col(c) * 100).cast("long")


#: From s, the signals of a digest, to their places.
PLACED_SQL = """b as (select *, greatest(expansion, partnership) as trig, case priority when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end as p,
            case fit when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end as f,
            greatest(0, 30 - floor((epoch(timestamp '2001-08-02') - epoch(published_at)) / 86400)) as fresh from s),
    c as (select *, familiarity = 'known' as known,
            (case when priority is null then 1.5 else p end) * 1000000 + f * 100000 + trig * 10000 + (expansion + partnership) * 1500
              - case when familiarity = 'in_conversation' then 5000 else 0 end + momentum * 1000
              + case when cluster_size >= 10 then 200 when cluster_size >= 3 then 100 else 0 end + fresh as drank,
            momentum * 1000000 + least(cluster_size, 30) * 10000 + trig * 1000 + p * 100 + fresh as trend,
            case when round = 'series_d' then false when valuation_usd > 5e9 then false when round = 'series_a' then true
                 when round = 'seed' then cluster_size >= 3 else round_usd <= 150e6 end and trig >= 2 as early from b),
    pool as (
        select *, 'd' as kind, drank as rank, case when coalesce(priority, 'unknown') = 'unknown' then 'awaiting_assessment'
            when priority = 'low' or fit = 'low' then 'low_fit' when early then 'new_on_the_radar' else 'worth_a_conversation' end as section
        from c where hq <> 'Singapore' and not known and signal_type <> 'noise' and ((trig >= 3 and momentum >= 2) or (p >= 2 and trig >= 3))
        union all
        select *, 'k', trend, 'who_we_know' from c where known and (momentum >= 2 or trig >= 2)),
    best as (select * from pool qualify row_number() over (partition by kind, company_id order by rank desc, item_id) = 1),
    ranked as (select *, row_number() over (partition by section order by rank desc, item_id) as position from best),
    marked as (select *, position > case section when 'worth_a_conversation' then 25 when 'new_on_the_radar' then 25 when 'who_we_know' then 15 else 2147483647 end as over from ranked),
    shown as (select * from marked where not over),
    rest as (select * from c where item_id not in (select item_id from shown)),
    late as (
        select item_id, company_id, 'omitted' as section, rank from marked where over
        union all select item_id, company_id, 'to_watch', drank from rest where p >= 2 and trig < 2
        union all (select item_id, company_id, 'exploration', trend from rest where trig between 1 and 2
            order by signal_type in (select signal_type from shown where section in ('worth_a_conversation', 'new_on_the_radar', 'who_we_know')), trend desc, item_id limit 1)),
    numbered as (select item_id, company_id, section, rank, row_number() over (partition by section order by rank desc, item_id) as position from late
        union all select item_id, company_id, section, rank, position from shown)
    select item_id, company_id, section, rank::double as rank, position, case when position <= 3 then 'full' when position <= 10 then 'brief' else 'line' end as detail from numbered"""


@query(f"""
    with s as (select o_orderkey as item_id, o_custkey as company_id, o_orderkey % 4 as expansion, (o_orderkey // 4) % 4 as momentum,
            (o_orderkey // 16) % 4 as partnership, ['funding', 'hiring', 'launch', 'partnership', 'noise'][o_orderkey % 5 + 1] as signal_type,
            case o_orderpriority when '1-URGENT' then 'high' when '2-HIGH' then 'medium' when '3-MEDIUM' then 'low' when '5-LOW' then 'unknown' end as priority,
            ['high', 'medium', 'low', 'unknown'][o_custkey % 4 + 1] as fit, ['known', 'in_conversation', 'unfamiliar'][o_custkey % 3 + 1] as familiarity,
            o_orderdate as published_at, (o_custkey % 12) + 1 as cluster_size, ['series_a', 'seed', 'series_d', ''][o_custkey % 4 + 1] as round,
            o_totalprice * 20000 as valuation_usd, o_totalprice * 500 as round_usd, case when c_nationkey = 7 then 'Singapore' else 'Elsewhere' end as hq
        from orders join customer on c_custkey = o_custkey where o_orderdate >= timestamp '2001-06-01' and o_orderdate < timestamp '2001-08-02'),
    {PLACED_SQL}""")
def digest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly digest: two months of orders as signals, customers as companies."""
    orders = read(spark, sf_dir, "orders").where("o_orderdate >= '2001-06-01' and o_orderdate < '2001-08-02'")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    pick = lambda values, at: F.element_at(F.array(*(F.lit(v) for v in values)), (at + 1).cast("int"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    signals = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("item_id"), c.alias("company_id"), (k % 4).alias("expansion"), (F.floor(k / 4) % 4).alias("momentum"), (F.floor(k / 16) % 4).alias("partnership"),
        pick(["funding", "hiring", "launch", "partnership", "noise"], k % 5).alias("signal_type"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "medium").when(F.col("o_orderpriority") == "3-MEDIUM", "low")
        .when(F.col("o_orderpriority") == "5-LOW", "unknown").alias("priority"),
        pick(["high", "medium", "low", "unknown"], c % 4).alias("fit"), pick(["known", "in_conversation", "unfamiliar"], c % 3).alias("familiarity"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"), (c % 12 + 1).alias("cluster_size"), pick(["series_a", "seed", "series_d", ""], c % 4).alias("round"),
        (F.col("o_totalprice") * 20000).alias("valuation_usd"), (F.col("o_totalprice") * 500).alias("round_usd"),
        F.when(F.col("c_nationkey") == 7, "Singapore").otherwise("Elsewhere").alias("hq"),
    )
    placed = place(signals, F.lit("2001-08-02").cast("timestamp"))
    return placed.select("item_id", "company_id", "section", "rank", "position", detail(F.col("position")).alias("detail"))


@query("""
    select o_custkey, o_orderkey, o_orderpriority, cast(round(o_totalprice * 100) as bigint) as price_cents from orders
    qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""")
def latest_order_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_by(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return rows.select("o_custkey", "o_orderkey", "o_orderpriority", cents("o_totalprice").alias("price_cents"))


@query("""
    with m as (select l_suppkey, cast(date_trunc('month', l_shipdate) as date) as month, count(*) as n from lineitem group by all),
    p as (select *, lag(n) over (partition by l_suppkey order by month) as before from m)
    select l_suppkey, month, n, before, coalesce(before >= 20 and n - before >= 5 and (n - before) / before > 0.25, false) as fires from p
    qualify row_number() over (partition by l_suppkey order by month desc) = 1""")
def latest_two_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's latest monthly count beside the one before, and whether its growth is a trigger."""
    monthly = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    last = latest_by(with_previous(monthly, ["l_suppkey"], [F.col("month")], "n", "before"), ["l_suppkey"], [F.desc("month")])
    return last.withColumn("fires", volume_trigger(F.col("before"), F.col("n")))


@query("select c_custkey, c_mktsegment from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P' and o_orderdate >= timestamp '2000-01-01')")
def customers_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderdate >= '2000-01-01'")
    return read(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("select c_custkey, c_mktsegment from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return read(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("""
    select c_custkey from customer where
        exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)
        or exists (select 1 from supplier where s_nationkey = c_nationkey and s_acctbal < 100)
        or exists (select 1 from events where user_id = c_custkey and event_type = 'signup')""")
def customers_any_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A semi join on any of three branches: the union of their ids."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = read(spark, sf_dir, "orders").where("o_totalprice > 450000")
    s = read(spark, sf_dir, "supplier").where("s_acctbal < 100")
    e = read(spark, sf_dir, "events").where("event_type = 'signup'")
    parts = [
        c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi"), c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "left_semi"),
        c.join(e, F.col("c_custkey") == F.col("user_id"), "left_semi"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("c_custkey").distinct()


@query("""
    with f as (select user_id, min(ts) as first_ts from events where event_type = 'signup' group by user_id)
    select e.event_id, e.user_id, e.event_type from events e join f on e.user_id = f.user_id
    where e.ts between f.first_ts - interval 24 hour and f.first_ts + interval 2 hour""")
def events_near_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join: equality on the user, and a window around the first signup."""
    e = read(spark, sf_dir, "events")
    first = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    near = F.col("ts").between(F.expr("first_ts - interval 24 hours"), F.expr("first_ts + interval 2 hours"))
    return e.join(first, "user_id").where(near).select("event_id", "user_id", "event_type")


@query("""
    with e as (select distinct l_partkey as hub, l_suppkey as k from lineitem),
    d as (select hub, count(*) as degree from e group by hub),
    p as (select a.k as source, b.k as target, d.degree, a.hub from e a join e b on a.hub = b.hub and a.k <> b.k join d on d.hub = a.hub)
    select source, target, count(*) as hubs, min(degree) as least_degree,
        cast(round(max(case when degree <= 1 then 1.0 else 1 / log2(degree + 1) end) * 1000000) as bigint) as score_ppm from p group by source, target""")
def shared_hub_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers connected over shared parts, each path discounted by its hub's degree."""
    e = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_suppkey")
    score = F.round(degree_discount(F.col("least_degree")) * 1_000_000).cast("long")  # the best path is that of the least degree
    return shared_hub_links(e, "part", "l_suppkey").withColumn("score_ppm", score)


@query("""
    select distinct least(a, b) as a, greatest(a, b) as b from (select o_custkey % 300 as a, o_orderkey % 300 as b from orders) where a <> b""")
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("a"), (F.col("o_orderkey") % 300).alias("b"))
    return canonical_edges(e, "a", "b")


@query("""
    with e as (select distinct least(a, b) as a, greatest(a, b) as b from (select o_custkey % 300 as a, o_orderkey % 300 as b from orders) where a <> b),
    s as (select a, b from e union all select b, a from e)
    select a as node, count(*) as degree, min(b) as least_other from s group by a""")
def edge_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = both_ways(undirected_edges(spark, sf_dir), "a", "b")
    return e.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.min("b").alias("least_other"))


@query("""
    with e as (select distinct l_partkey as hub, l_suppkey as k from lineitem)
    select distinct x.k as a, y.k as b from e x join e y on x.hub = y.hub and x.k < y.k""")
def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share a part, over the whole table and its own ids."""
    e = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_suppkey")
    return shared_hub_links(e, "part", "l_suppkey", rising=True).select(F.col("source").alias("a"), F.col("target").alias("b"))


@query("""
    with e as (select distinct l_partkey as hub, l_suppkey as k from lineitem),
    s as (select distinct x.k as a, y.k as b from e x join e y on x.hub = y.hub and x.k <> y.k)
    select a as node, count(*) as degree, min(b) as least_other from s group by a""")
def supplier_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many suppliers each one shares a part with."""
    e = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_suppkey")
    return shared_hub_links(e, "part", "l_suppkey").groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.min("target").alias("least_other"))


@query("""
    with p as (select s_suppkey as target, case when s_nationkey % 3 = 0 then 'fund_portfolio' else 'person_role' end as kind,
            case when s_nationkey % 3 <> 0 then s_nationkey end as via_person, case when s_nationkey % 3 = 0 then s_nationkey end as via_org,
            0.5 + (s_suppkey % 4) * 0.25 as score from supplier),
    r as (select case when n_nationkey % 3 = 0 then 'fund_portfolio' else 'person_role' end as kind, case when n_nationkey % 3 <> 0 then n_nationkey end as via_person,
            case when n_nationkey % 3 = 0 then n_nationkey end as via_org, ['usable', 'not_usable', 'confirmed'][n_nationkey % 3 + 1] as status,
            n_nationkey % 7 = 0 as do_not_use from nation where n_regionkey <> 0),
    j as (select p.target, p.kind, case when r.do_not_use or r.status = 'not_usable' then -1 when r.status = 'usable' then score + 1 else score end as score, coalesce(r.status, 'unreviewed') as review_status
        from p left join r on p.kind = r.kind and p.via_person is not distinct from r.via_person and p.via_org is not distinct from r.via_org)
    select target, kind, score::double as score, review_status, case when review_status in ('confirmed', 'usable') then 'confirmed' when score >= 2 then 'plausible' else 'weak' end as feasibility from j where score >= 0""")
def reviewed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths under reviews, matched by kind and by person or fund, nulls alike."""
    def ends(c):
        n = F.col(c)
        return [
            F.when(n % 3 == 0, "fund_portfolio").otherwise("person_role").alias("kind"), F.when(n % 3 != 0, n).alias("via_person"), F.when(n % 3 == 0, n).alias("via_org"),
        ]

    p = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target"), *ends("s_nationkey"), (0.5 + (F.col("s_suppkey") % 4) * 0.25).alias("score"))
    status = F.element_at(F.array(F.lit("usable"), F.lit("not_usable"), F.lit("confirmed")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    r = read(spark, sf_dir, "nation").where("n_regionkey <> 0").select(*ends("n_nationkey"), status.alias("status"), (F.col("n_nationkey") % 7 == 0).alias("do_not_use"))
    out = reviewed(p, r, ["kind", "via_person", "via_org"])
    return out.select("target", "kind", "score", "review_status", feasibility(F.col("score"), F.col("review_status")).alias("feasibility"))


@query("""
    select cast(date_trunc('week', ts) as date) as week, count(*) as total, count(*) filter (event_type = 'error') as errors,
        count(*) filter (event_type = 'purchase') as purchases, count(*) filter (value > 100) as large from events group by 1""")
def filtered_counts_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("week", "ts").cast("date").alias("week")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("value") > 100).alias("large"),
    )


@query("""
    with w as (select cast(ts as date) - ((dayofweek(ts) + 1) % 7)::int as week_of, user_id from events)
    select week_of, week_of + 6 as week_end, count(*) as n, count(distinct user_id) as users,
        case when month(week_of) = month(week_of + 6) then day(week_of) || '–' || day(week_of + 6) || ' ' || strftime(week_of + 6, '%B')
             else day(week_of) || ' ' || strftime(week_of, '%B') || ' – ' || day(week_of + 6) || ' ' || strftime(week_of + 6, '%B') end as label
    from w group by week_of""")
def saturday_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(week_of(F.col("ts")).alias("week_of"), "user_id")
    g = e.groupBy("week_of").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return g.select("week_of", F.date_add("week_of", 6).alias("week_end"), "n", "users", week_label(F.col("week_of")).alias("label"))


@query("""
    select reason, count(*) as n, count(distinct p_brand) as brands from (select p_brand, unnest(string_split(p_name, ' ') || [p_type]) as reason from part) group by reason""")
def reason_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_brand", F.explode(F.concat(F.split("p_name", " "), F.array("p_type"))).alias("reason"))
    return p.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_brand").alias("brands"))


@query("""
    select l_suppkey, l_partkey % 50 as company, bool_or(l_returnflag = 'R') as any_lead, count(*) as rounds, cast(max(l_shipdate) as date) as latest,
        arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) filter (l_returnflag <> 'N') as latest_flag,
        string_agg(distinct l_returnflag, ',' order by l_returnflag) as flags from lineitem group by all""")
def investor_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per investor and company: any lead, rounds, latest date, latest named round, all rounds."""
    real = F.when(F.col("l_returnflag") != "N", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"))
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 50).alias("company")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("any_lead"), F.count(F.lit(1)).alias("rounds"), F.max("l_shipdate").cast("date").alias("latest"),
        F.max(real)["l_returnflag"].alias("latest_flag"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"),
    )


@query("with n as (select l_partkey, count(distinct l_suppkey) as suppliers from lineitem group by 1 having count(distinct l_suppkey) > 1) select suppliers, count(*) as parts from n group by 1")
def histogram_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("suppliers")).where("suppliers > 1")
    return n.groupBy("suppliers").agg(F.count(F.lit(1)).alias("parts"))


@query("""
    select case when l_quantity >= 35 then 'strong' when l_quantity >= 15 then 'moderate' else 'weak' end as band, o_orderpriority as priority, count(*) as n
    from lineitem join orders on o_orderkey = l_orderkey group by all having count(*) > 10""")
def score_priority_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("l_quantity") >= 35, "strong").when(F.col("l_quantity") >= 15, "moderate").otherwise("weak")
    j = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(band.alias("band"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n")).where("n > 10")


@query("""
    select user_id, max(w) as last_week, count(distinct w) as weeks from (select user_id, cast(date_trunc('week', ts) as date) as w from events where value > 60) group by user_id""")
def ever_surfaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("value > 60").select("user_id", F.date_trunc("week", "ts").cast("date").alias("w"))
    return e.groupBy("user_id").agg(F.max("w").alias("last_week"), F.countDistinct("w").alias("weeks"))


@query("select user_id, cast(min(ts) as date) as first_day from events where event_type = 'purchase' group by 1 having cast(min(ts) as date) >= date '2024-01-15' - 7")
def first_seen_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").cast("date").alias("first_day"))
    return e.where("first_day >= date_sub(date'2024-01-15', 7)")


@query("""
    select coalesce(case when n_chars < 200 then 'too_short' when lang <> 'en' then 'language_' || lang end, 'kept') as reason, count(*) as n
    from documents group by 1 order by n desc, reason limit 12""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    reason = F.coalesce(F.when(F.col("n_chars") < 200, "too_short").when(F.col("lang") != "en", F.concat(F.lit("language_"), F.col("lang"))), F.lit("kept"))
    return d.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(12)


@query("""
    with d as (select event_type as source, cast(ts as date) as day, count(*) as n from events group by all),
    l as (select *, sum(n) over (partition by source order by day rows between unbounded preceding and 1 preceding) as total,
        count(*) over (partition by source order by day rows between unbounded preceding and 1 preceding) as days from d)
    select source, day, n, case when n = 0 then 'silent' when n * days > 2 * total then 'spike' when 2 * n * days < total then 'drop' else 'ok' end as status from l where days > 0""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's daily volume against the mean of its days before, in whole numbers."""
    d = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"total": F.sum("n").over(w), "days": F.count(F.lit(1)).over(w)}).where("days > 0")
    status = F.when(F.col("n") == 0, "silent").when(F.expr("n * days > 2 * total"), "spike").when(F.expr("2 * n * days < total"), "drop").otherwise("ok")
    return d.select("source", "day", "n", status.alias("status"))


@query("""
    with e as (select *, lead(ts) over (partition by user_id order by ts, event_id) as finished from events)
    select cast(ts as date) as day, event_type as stage, count(*) as runs, count(*) filter (value < 1) as failed, count(*) filter (finished is null) as unfinished,
        max(event_id) filter (value < 1) as last_failed, cast(sum(floor(epoch(finished)) - floor(epoch(ts))) as bigint) as seconds from e group by all""")
def pipeline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day and stage: runs, failures, unfinished ones, the last failure, seconds taken."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumn("finished", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("stage")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("value") < 1).alias("failed"), F.count_if(F.col("finished").isNull()).alias("unfinished"),
        F.max(F.when(F.col("value") < 1, F.col("event_id"))).alias("last_failed"), F.sum(F.unix_timestamp("finished") - F.unix_timestamp("ts")).alias("seconds"),
    )


@query("""
    with a as (select 'customer' as kind, c_custkey as id, c_name as name from customer union all select 'supplier', s_suppkey, s_name from supplier union all select 'part', p_partkey, p_name from part)
    select kind, id, name from a where name ilike '%er#00000001%' or name ilike '%small%'
    order by case when name ilike 'small%' then 0 else 1 end, kind <> 'customer', length(name), name, kind, id limit 25""")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search over three kinds: prefix first, customers first, short names first."""
    kinds = [("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")]
    parts = [read(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(i).alias("id"), F.col(n).alias("name")) for t, i, n in kinds]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("name").ilike("%er#00000001%") | F.col("name").ilike("%small%"))
    order = [F.when(F.col("name").ilike("small%"), 0).otherwise(1), F.col("kind") != "customer", F.length("name"), "name", "kind", "id"]
    return every.orderBy(*order).limit(25)


@query("""
    select 'segment' as facet, c_mktsegment as value, count(*) as n from customer group by 2
    union all select 'region', r_name, count(*) from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by 2""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    where = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    faces = where.select(F.explode(F.array(F.struct(F.lit("segment").alias("facet"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("region").alias("facet"), F.col("r_name").alias("value")))).alias("f"))
    return faces.groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


@query("select event_type, count(*) as n, sum(cast(json_extract_string(props, '$.k') as bigint)) as total, max(cast(json_extract_string(props, '$.k') as bigint)) as most from events group by 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


@query("""
    with k(kind, days, slots) as (values ('purchase', 20, 5), ('signup', 15, 3), ('error', 5, 3), ('view', 2, 2), ('click', 1, 2))
    select event_type, event_id, row_number() over (partition by event_type order by ts desc, event_id desc) as position from events join k on kind = event_type
    where ts > timestamp '2024-01-31' - days * interval 1 day qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= slots""")
def per_kind_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind has its own window in days and its own number of places."""
    kinds = spark.createDataFrame([("purchase", 20, 5), ("signup", 15, 3), ("error", 5, 3), ("view", 2, 2), ("click", 1, 2)], "event_type string, days int, slots int")
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).join(F.broadcast(kinds), "event_type")
    e = e.where(F.col("ts") > F.lit("2024-01-31").cast("timestamp") - F.make_dt_interval("days"))
    return top_per(e, ["event_type"], [F.desc("ts"), F.desc("event_id")], F.col("slots")).select("event_type", "event_id", "position")


@query("""
    select o_custkey, fresh, cast(row_number() over (order by fresh desc, o_custkey) as bigint) as place from (
        select o_custkey, min(o_orderdate) >= timestamp '1996-06-01' as fresh from orders group by 1) where fresh or o_custkey % 3 = 19723 % 3
    order by fresh desc, o_custkey limit 200""")
def cohort_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the customers each day, and all new ones, new ones first; the first 200."""
    c = read(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.min("o_orderdate") >= F.lit("1996-06-01").cast("timestamp_ntz")).alias("fresh"))
    first = c.where(F.col("fresh") | (F.pmod("o_custkey", F.lit(3)) == 19723 % 3)).orderBy(F.desc("fresh"), "o_custkey").limit(200)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("fresh"), "o_custkey")).cast("long"))


@query("""
    with r as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as round from events where event_type = 'purchase'),
    p as (select event_id, user_id, row_number() over (order by round, user_id) - 1 as place from r)
    select event_id, user_id, place, place // 12 as batch from p""")
def round_robin_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases dealt one per user a round, in batches of twelve."""
    e = read(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return interleaved_batches(e, "user_id", ["ts", "event_id"], 12).select("event_id", "user_id", "place", "batch")


@query("""
    with d as (select user_id, bool_or(event_type = 'error' and value < 2) as permanent, max(ts) filter (event_type = 'error') as until from events where event_type in ('error') group by 1)
    select e.event_id, e.user_id from events e left join d using (user_id) where e.event_type = 'view'
        and not coalesce(d.permanent, false) and (d.until is null or e.ts > d.until)""")
def dismissal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of users who have not dismissed: for good, or until something newer."""
    e = read(spark, sf_dir, "events")
    d = e.where("event_type = 'error'").groupBy("user_id").agg(F.bool_or(F.col("value") < 2).alias("permanent"), F.max("ts").alias("until"))
    v = e.where("event_type = 'view'").join(d, "user_id", "left")
    return v.where("not coalesce(permanent, false) and (until is null or ts > until)").select("event_id", "user_id")


@query("""
    select c_custkey from customer join nation on n_nationkey = c_nationkey where coalesce(case when c_acctbal < 0 then 'portfolio' end, '') <> 'portfolio'
        and coalesce(case when n_regionkey = 3 then 'out_of_scope' end, 'unknown') <> 'out_of_scope' and len(list_filter([c_mktsegment], lambda x: x not in ('FURNITURE', 'HOUSEHOLD'))) > 0""")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in scope: not from the portfolio, not out of scope, with a sector that may be shown."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    via = F.coalesce(F.when(F.col("c_acctbal") < 0, "portfolio"), F.lit(""))
    scope = F.coalesce(F.when(F.col("n_regionkey") == 3, "out_of_scope"), F.lit("unknown"))
    sectors = F.array("c_mktsegment")
    shown = (F.size(sectors) == 0) | F.exists(sectors, lambda s: ~s.isin("FURNITURE", "HOUSEHOLD"))
    return c.where((via != "portfolio") & (scope != "out_of_scope") & shown).select("c_custkey")


@query("""
    with m as (select s_suppkey as loser, min(s_suppkey) over (partition by s_nationkey) as kept from supplier)
    select coalesce(m.kept, l_suppkey) as supplier, count(*) as n, cast(min(l_shipdate) as date) as first_seen, cast(max(l_shipdate) as date) as last_seen
    from lineitem left join m on m.loser = l_suppkey and m.loser <> m.kept group by 1""")
def merge_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of one nation merged into the first; their rows re-pointed and folded."""
    s = read(spark, sf_dir, "supplier")
    m = s.select(F.col("s_suppkey").alias("loser"), F.min("s_suppkey").over(Window.partitionBy("s_nationkey")).alias("kept")).where("loser <> kept")
    rows = repoint(read(spark, sf_dir, "lineitem"), "l_suppkey", m)
    return rows.groupBy(F.col("l_suppkey").alias("supplier")).agg(
        F.count(F.lit(1)).alias("n"), F.min("l_shipdate").cast("date").alias("first_seen"), F.max("l_shipdate").cast("date").alias("last_seen")
    )


@query("""
    select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts >= timestamp '2024-01-16' desc, ts desc, event_id desc) = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a month of events written over the one before, by user and type."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    old, new = e.where("ts < '2024-01-16'"), e.where("ts >= '2024-01-16'")
    return upsert(old, new, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("""
    with o as (select * from events where ts < timestamp '2024-01-04' qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1),
    n as (select * from events where ts >= timestamp '2024-01-04' qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1)
    select user_id, event_type, event_id from o union all select user_id, event_type, event_id from n where not exists (select 1 from o where o.user_id = n.user_id and o.event_type = n.event_type)""")
def insert_ignore_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    keys, order = ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]
    old = latest_by(e.where("ts < '2024-01-04'"), keys, order)
    return insert_ignore(old, e.where("ts >= '2024-01-04'"), keys, order).drop("ts")


@query("""
    with d as (select o_custkey, o_orderpriority, cast(o_orderdate as date) as day, o_totalprice, o_orderkey from orders
        qualify row_number() over (partition by o_custkey, o_orderpriority, o_orderdate order by o_orderkey) = 1)
    select o_custkey, count(*) as rounds, sum(case when o_orderpriority not in ('4-NOT SPECIFIED', '5-LOW') then cast(round(o_totalprice * 100) as bigint) end)::bigint as raised_cents,
        arg_max(o_orderpriority, (day, o_orderkey)) as latest_round, max(day) as latest_day from d group by 1""")
def funding_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds per customer, each once; sums without rumours; the latest round."""
    d = latest_by(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority", "o_orderdate"], [F.col("o_orderkey")])
    real = F.when(~F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW"), cents("o_totalprice"))
    last = F.max(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))
    return d.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("rounds"), F.sum(real).alias("raised_cents"), last["o_orderpriority"].alias("latest_round"), F.max("o_orderdate").cast("date").alias("latest_day")
    )


@query("""
    select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 15 minute preceding and current row) as recent from events where event_type in ('error', 'click', 'view')""")
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of a user in the fifteen minutes up to each."""
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("error", "click", "view")).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-15 * 60 * 1_000_000, 0)
    return e.select("event_id", "user_id", F.count(F.lit(1)).over(w).alias("recent"))


@query("""
    with f as (select user_id, event_type as category, case event_type when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 9 end as rank, event_id % 4 as exit from events where value > 150)
    select user_id, arg_min(category, (rank, -exit, category)) as verdict, max(exit) as exit, count(*) as findings from f group by 1""")
def run_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst finding names a run's verdict; its exit code is the largest of all."""
    rank = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(9)
    f = read(spark, sf_dir, "events").where("value > 150").select("user_id", F.col("event_type").alias("category"), rank.alias("rank"), (F.col("event_id") % 4).alias("exit"))
    worst = F.min(F.struct("rank", (-F.col("exit")).alias("x"), "category"))["category"]
    return f.groupBy("user_id").agg(worst.alias("verdict"), F.max("exit").alias("exit"), F.count(F.lit(1)).alias("findings"))


@query("""
    with c as (select user_id, event_type as f, case when value >= 100 then 'exec' when value >= 50 then 'director' else 'ic' end as rank, event_id % 7 = 0 as apac from events),
    t as (select user_id, f, count(*) as n, min(event_id) as first_at from (select user_id, event_type as f, event_id from events where event_id % 7 = 0) group by all),
    m as (select user_id, string_agg(f || ':' || n, ',' order by n desc, first_at) as mix from t group by 1)
    select user_id, count(*) as total, count(*) filter (apac) as apac, count(*) filter (apac and rank in ('exec', 'director')) as senior, mix,
        count(*) filter (apac) >= 2 or (count(*) filter (apac) >= 1 and count(*) filter (apac and rank in ('exec', 'director')) > 0) as material
    from c left join m using (user_id) group by user_id, mix""")
def hiring_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings per employer: counts, the mix of functions by size and first place, and whether it matters."""
    e = read(spark, sf_dir, "events")
    rank = F.when(F.col("value") >= 100, "exec").when(F.col("value") >= 50, "director").otherwise("ic")
    e = e.select("user_id", "event_id", "event_type", rank.alias("rank"), (F.col("event_id") % 7 == 0).alias("apac"))
    tally = e.where("apac").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("at"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "at", F.concat("event_type", F.lit(":"), F.col("n").cast("string")).alias("part"))))
    mix = tally.groupBy("user_id").agg(F.array_join(parts["part"], ",").alias("mix"))
    high = F.col("apac") & F.col("rank").isin("exec", "director")
    g = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("apac").alias("apac"), F.count_if(high).alias("senior"))
    return g.join(mix, "user_id", "left").withColumn("material", F.expr("apac >= 2 or (apac >= 1 and senior > 0)"))
