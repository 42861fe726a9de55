"""Queries over queues, states, writes and lookups of the weekly workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlens.functions import text
from harborlens.operators import joins, writes
from harborlens.operators.latest import latest_by, places
from harborlens.plans.registry import query, read


@query("""
    with p as (select * from events where event_type = 'purchase'), v as (select * from events where event_type = 'view')
    select p.event_id, p.user_id, arg_max(v.event_id, (v.ts, v.event_id)) as last_event_id from p left join v on v.user_id = p.user_id and v.ts <= p.ts group by all""")
def asof_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's latest view before it."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    p, v = e.where("event_type = 'purchase'"), e.where("event_type = 'view'")
    return joins.asof_join(p, v, "user_id", "ts", ["event_id"], "event_id").select("event_id", "user_id", "last_event_id")


@query("""
    with c as (select s_suppkey, ['a' || s_nationkey % 6, 'a' || s_suppkey % 4] as sectors from supplier),
    i as (select p_partkey, case when p_size = 2 then ['a' || p_partkey % 7] end as sectors from part where p_size <= 2)
    select s_suppkey, p_partkey from c join i on i.sectors is null or list_has_any(c.sectors, i.sectors)""")
def sector_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context items for companies that share a sector; items without sectors are for all."""
    a = lambda n: F.concat(F.lit("a"), n.cast("string"))
    c = read(spark, sf_dir, "supplier").select("s_suppkey", F.array(a(F.col("s_nationkey") % 6), a(F.col("s_suppkey") % 4)).alias("have"))
    i = read(spark, sf_dir, "part").where("p_size <= 2")
    i = i.select("p_partkey", F.when(F.col("p_size") == 2, F.array(a(F.col("p_partkey") % 7))).alias("want"))
    return joins.overlap_join(c, i, "s_suppkey", "have", "p_partkey", "want")


@query("""
    with c as (select s_suppkey, ['a' || s_nationkey % 6, 'a' || s_suppkey % 4] as sectors from supplier),
    i as (select p_partkey, case when p_size > 1 then ['a' || p_partkey % 7] end as sectors from part)
    select s_suppkey, p_partkey from c join i on i.sectors is null or list_has_any(c.sectors, i.sectors)""")
def sector_context_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context items over all parts: those of size 1 are for every company, the others for companies of their sector."""
    a = lambda n: F.concat(F.lit("a"), n.cast("string"))
    c = read(spark, sf_dir, "supplier").select("s_suppkey", F.array(a(F.col("s_nationkey") % 6), a(F.col("s_suppkey") % 4)).alias("have"))
    i = read(spark, sf_dir, "part").select("p_partkey", F.when(F.coalesce(F.col("p_size") > 1, F.lit(False)), F.array(a(F.col("p_partkey") % 7))).alias("want"))
    return joins.overlap_join(c, i, "s_suppkey", "have", "p_partkey", "want")


@query("""
    with a as (select lower(p_name) as key, p_partkey as id, false as is_alias from part union all select lower(p_type), p_partkey, true from part)
    select key, arg_min(id, (is_alias::int, id)) as id, min(is_alias::int) = 1 as is_alias from a group by key""")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which entity a name stands for: names before aliases, the first writer wins."""
    p = read(spark, sf_dir, "part")
    own = lambda c: p.select(F.lower(c).alias("key"), F.col("p_partkey").alias("id"))
    return joins.name_index(own("p_name"), own("p_type"))


@query("""
    with t as (select distinct array_to_string(w[1 : 1 + item_id % 4], ' ') as term from (select item_id, string_split(lower(text), ' ') as w from benchmark)),
    d as (select doc_id, string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+') as w from documents),
    p as (select doc_id, w, unnest(range(len(w))) as place from d), n(n) as (values (1), (2), (3), (4)),
    m as (select doc_id, array_to_string(w[place + 1 : place + n], ' ') as term, place, n from p, n where place + n <= len(w))
    select doc_id, arg_min(term, (-n, place)) as term, arg_min(place, (-n, place)) as place from m join t using (term) group by doc_id""")
def longest_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of a dictionary of one to four words that a document names: the longest, then the leftmost."""
    t = read(spark, sf_dir, "benchmark").select(F.slice(F.split(F.lower("text"), " "), F.lit(1), (F.col("item_id") % 4 + 1).cast("int")).alias("w"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), r"[ \t\n\x0B\f\r]+").alias("w"))
    found = joins.longest_mention(d, "doc_id", "w", t.select(F.array_join("w", " ").alias("term")))
    return found.select("doc_id", "term", F.col("at").cast("long").alias("place"))


@query("""
    with v as (select o_custkey, o_orderkey % 2 as version, o_orderpriority as fit from orders
        qualify row_number() over (partition by o_custkey, o_orderkey % 2 order by o_orderdate desc, o_orderkey desc) = 1)
    select a.o_custkey, a.fit as before, b.fit as after from v a join v b on a.o_custkey = b.o_custkey and a.version = 0 and b.version = 1 where a.fit is distinct from b.fit""")
def version_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose latest judgement differs between two versions, nulls told apart: one grouping instead of a self join."""
    o = read(spark, sf_dir, "orders").withColumn("version", F.col("o_orderkey") % 2)
    last = latest_by(o, ["o_custkey", "version"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    of = lambda v: F.max(F.when(F.col("version") == v, F.struct("o_orderpriority")))
    g = last.groupBy("o_custkey").agg(of(0).alias("a"), of(1).alias("b")).where("a is not null and b is not null")
    return g.select("o_custkey", F.col("a.o_orderpriority").alias("before"), F.col("b.o_orderpriority").alias("after")).where("not (before <=> after)")


@query("""
    with r as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders)
    select c_custkey, coalesce(string_agg(o_orderkey, ',' order by n) filter (n <= 4), '') as contacts, count(o_orderkey) as known
    from customer left join r on o_custkey = c_custkey group by 1""")
def nested_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four of a parent's children, in order, nested in its row; parents without children stay."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("n"))
    first = F.array_sort(F.collect_list(F.when(F.col("n") <= 4, F.struct("n", F.col("o_orderkey").cast("string").alias("k")))))
    g = o.groupBy("o_custkey").agg(F.array_join(first["k"], ",").alias("contacts"), F.count(F.lit(1)).alias("known"))
    c = read(spark, sf_dir, "customer").join(g, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.coalesce("contacts", F.lit("")).alias("contacts"), F.coalesce("known", F.lit(0)).alias("known"))


@query("""
    select count(distinct user_id) as monitored, count(distinct user_id) filter (event_type = 'purchase') as surfaced, count(*) filter (ts >= timestamp '2024-01-20') as read_this_week,
        count(*) filter (ts >= timestamp '2024-01-20' and value > 50) as scored_this_week, count(*) as items from events""")
def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All coverage figures in one pass."""
    new = F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")
    return read(spark, sf_dir, "events").agg(
        F.countDistinct("user_id").alias("monitored"), F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("surfaced"),
        F.count_if(new).alias("read_this_week"), F.count_if(new & (F.col("value") > 50)).alias("scored_this_week"), F.count(F.lit(1)).alias("items"),
    )


@query("""
    select l_orderkey // 8 as batch, count(*) as n, count(distinct l_returnflag) as scores from lineitem where l_quantity > 40 group by 1 having count(*) >= 5 and count(distinct l_returnflag) = 1""")
def uniform_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of five or more whose scores are all the same."""
    li = read(spark, sf_dir, "lineitem").where("l_quantity > 40")
    g = li.groupBy(F.floor(F.col("l_orderkey") / 8).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_returnflag").alias("scores"))
    return g.where("n >= 5 and scores = 1")


@query("""
    select case when p_size > 45 then null else least(3, greatest(0, round(p_size / 12.0)))::int end as score, count(*) as n from part group by 1""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores rounded and held within 0 and 3; unknown ones counted apart."""
    s = F.when(F.col("p_size") <= 45, F.greatest(F.lit(0.0), F.least(F.lit(3.0), F.round(F.col("p_size") / 12.0)))).cast("int")
    return read(spark, sf_dir, "part").groupBy(s.alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    with r as (select distinct event_type, date_trunc('hour', ts) as started from events where value > 40),
    n as (select event_type, started, row_number() over (partition by event_type order by started desc) as k from r)
    select event_type, greatest(timestamp '2024-01-24', least(coalesce(max(started) filter (k = 2), timestamp '2024-01-24'), timestamp '2024-01-30 18:00:00')) as since from n group by 1""")
def previous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the run before the last began, held between a week and six hours ago."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    r = read(spark, sf_dir, "events").where("value > 40").select("event_type", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("started")).distinct()
    r = r.withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("started"))))
    second = F.max(F.when(F.col("k") == 2, F.col("started")))
    since = F.greatest(at("2024-01-24"), F.least(F.coalesce(second, at("2024-01-24")), at("2024-01-30 18:00:00")))
    return r.groupBy("event_type").agg(since.alias("since"))


@query("""
    with q as (select c_custkey, c_acctbal > 8000 as has_slug, case when c_custkey % 3 > 0 then date '2024-01-01' + (c_custkey % 40)::int end as missing_at from customer)
    select c_custkey, row_number() over (order by not has_slug, missing_at nulls first, c_custkey) as place from q where has_slug or missing_at is null or missing_at < date '2024-01-20'
    order by place limit 150""")
def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known boards first, then those never tried, then the oldest misses; recent misses wait."""
    c = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 8000).alias("has_slug"), F.when(F.col("c_custkey") % 3 > 0, F.expr("date_add(date'2024-01-01', cast(c_custkey % 40 as int))")).alias("missing_at"))
    order = [F.col("has_slug").desc(), F.col("missing_at").asc_nulls_first(), F.col("c_custkey")]
    first = c.where("has_slug or missing_at is null or missing_at < date'2024-01-20'").orderBy(*order).limit(150)
    return first.select("c_custkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("""
    with q as (select c_custkey, c_acctbal > 8000 as has_slug, case when c_custkey % 3 > 0 then date '2024-01-01' + (c_custkey % 40)::int end as missing_at from customer)
    select c_custkey, row_number() over (order by not has_slug, missing_at nulls first, c_custkey) as place from q where has_slug or missing_at is null or missing_at < date '2024-01-20'""")
def retry_queue_whole(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """The whole queue of ``retry_queue``; ``limit`` keeps its first places only."""
    c = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 8000).alias("has_slug"), F.when(F.col("c_custkey") % 3 > 0, F.expr("date_add(date'2024-01-01', cast(c_custkey % 40 as int))")).alias("missing_at"))
    due = c.where("has_slug or missing_at is null or missing_at < date'2024-01-20'")
    q = places(due, [~F.col("has_slug"), F.col("missing_at"), F.floor(F.col("c_custkey") / 100_000)], [F.col("c_custkey")]).select("c_custkey", "place")
    return q if limit is None else q.where(F.col("place") <= limit)


@query("""
    with s as (select o_custkey, max(l_quantity) as best from orders join lineitem on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT' group by 1)
    select c_custkey, coalesce(best, 0)::double as best, row_number() over (order by coalesce(best, 0) desc, c_name) as place from customer left join s on o_custkey = c_custkey order by place limit 100""")
def signal_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies to work on, the strongest signal first."""
    li, o, c = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    s = o.where("o_orderpriority = '1-URGENT'").join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.max("l_quantity").alias("best"))
    q = c.join(s, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("best", F.lit(0.0)).alias("best"))
    first = q.orderBy(F.desc("best"), "c_name").limit(100)
    return first.select("c_custkey", "best", F.row_number().over(Window.orderBy(F.desc("best"), "c_name")).cast("long").alias("place"))


@query("""
    with s as (select o_custkey, max(l_quantity) as best from orders join lineitem on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT' group by 1)
    select c_custkey, coalesce(best, 0)::double as best, row_number() over (order by coalesce(best, 0) desc, c_name, c_custkey) as place from customer left join s on o_custkey = c_custkey""")
def signal_queue_whole(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """The whole queue of ``signal_queue``; ``limit`` keeps its first places only."""
    li, o, c = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    s = o.where("o_orderpriority = '1-URGENT'").join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.max("l_quantity").alias("best"))
    q = c.join(s, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("best", F.lit(0.0)).alias("best"))
    # Names hold nine digits: a range has those that agree in all but the last five.
    q = places(q, [-F.col("best"), F.substring("c_name", 1, 13)], [F.col("c_name"), F.col("c_custkey")]).select("c_custkey", "best", "place")
    return q if limit is None else q.where(F.col("place") <= limit)


@query("""
    with u as (select user_id, 0 as pass, event_id from events where event_type = 'purchase' and value > 100 union all select user_id, 1, event_id from events where event_type = 'signup'
        union all select user_id, 2, event_id from events where event_type = 'click')
    select user_id, min(pass) as pass, arg_min(event_id, (pass, event_id)) as event_id from u group by 1""")
def passes_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of three passes, each key from its first pass: one scan and one grouping."""
    t = F.col("event_type")
    n = F.when((t == "purchase") & (F.col("value") > 100), 0).when(t == "signup", 1).when(t == "click", 2)
    u = read(spark, sf_dir, "events").select("user_id", n.alias("pass"), "event_id").where("pass is not null")
    return u.groupBy("user_id").agg(F.min(F.struct("pass", "event_id")).alias("f")).select("user_id", "f.pass", "f.event_id")


@query("""
    select user_id, case arg_max(event_type, (ts, event_id)) when 'signup' then 'monitored' else 'removed' end as action, arg_max(event_id, (ts, event_id)) as event_id
    from events where event_type in ('signup', 'error') group by 1""")
def monitoring_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is monitored now, from the log of additions and removals."""
    action = F.when(F.col("event_type") == "signup", "monitored").when(F.col("event_type") == "error", "removed")
    return writes.state_of_log(read(spark, sf_dir, "events"), "user_id", action, ["ts", "event_id"]).select("user_id", "action", "event_id")


@query("""
    with e as (select user_id, ts, event_id, case event_type when 'view' then 'approve' when 'click' then 'unapprove' when 'purchase' then 'send' end as a from events),
    w as (select *, coalesce(last_value(case when a in ('approve', 'unapprove') then a end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding), 'unapprove') as was from e)
    select user_id, case when bool_or(coalesce(a, '') = 'send' and was = 'approve') then 'sent' when arg_max(was, (ts, event_id)) = 'approve' then 'approved' else 'draft' end as state from w group by 1""")
def digest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft, approved or sent, after all actions in order."""
    t = F.col("event_type")
    action = F.when(t == "view", "approve").when(t == "click", "unapprove").when(t == "purchase", "send")
    return writes.digest_states(read(spark, sf_dir, "events"), "user_id", action, ["ts", "event_id"])


@query("""
    with r as (select p_name, p_partkey, p_type, case when p_size > 10 then p_brand end as brand from part),
    o as (select p_name, arg_min(p_type, p_partkey) as own from part group by 1)
    select p_name, min(p_partkey) as keep_id, count(*) - 1 as merged, arg_min(brand, p_partkey) filter (brand is not null) as brand,
        coalesce(string_agg(distinct p_type, '|' order by p_type) filter (p_type <> own), '') as aliases from r join o using (p_name) group by 1""")
def hard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one name merged into the first: blank fields filled, other types carried as aliases."""
    p = read(spark, sf_dir, "part").select("p_name", "p_partkey", "p_type", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand"))
    m = writes.merge_fill(p, "p_name", "p_partkey", ["brand"], "p_type")
    return m.withColumn("aliases", F.array_join("aliases", "|"))


@query("""
    with n as (select o_custkey, case when o_orderpriority = '3-MEDIUM' then '' else o_orderpriority end as c_mktsegment, o_orderstatus from orders
        qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
    select c_custkey, coalesce(nullif(n.c_mktsegment, ''), c.c_mktsegment) as c_mktsegment, n.o_custkey is not null as patched
    from customer c left join n on n.o_custkey = c.c_custkey and n.o_orderstatus <> 'F'""")
def guarded_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load over known rows: rows without a source are rejected, blanks overwrite nothing."""
    o = latest_by(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    new = o.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderpriority") == "3-MEDIUM", "").otherwise(F.col("o_orderpriority")).alias("c_mktsegment"), "o_orderstatus")
    old = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return writes.guarded_patch(old, new, "c_custkey", ["c_mktsegment"], F.col("o_orderstatus") != "F")


@query("""
    with t as (select o_orderkey, 'dear' as problem from orders where o_totalprice > 400000 union all select o_orderkey, 'pending' from orders where o_orderstatus = 'P'
        union all select o_orderkey, 'no priority' from orders where o_orderpriority ilike '%not specified%') select problem, count(*) as n, min(o_orderkey) as first_row from t group by 1""")
def load_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load would complain of, by problem."""
    tests = {"dear": F.col("o_totalprice") > 400000, "pending": F.col("o_orderstatus") == "P", "no priority": F.col("o_orderpriority").ilike("%not specified%")}
    found = writes.problems(read(spark, sf_dir, "orders"), "o_orderkey", tests)
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_row"))


@query("""
    with i as (select event_id, ts as fetched, case when event_id % 11 > 0 then ts - (event_id % 20) * interval 1 day end as published from events)
    select event_id from i where (published >= timestamp '2024-01-13' and published < timestamp '2024-01-20')
        or (fetched >= timestamp '2024-01-13' and fetched < timestamp '2024-01-20' and (published is null or published >= timestamp '2024-01-08'))""")
def week_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a week: published in it, or found in it and not published more than five days before it."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    published = F.when(F.col("event_id") % 11 > 0, F.expr("ts - make_dt_interval(cast(event_id % 20 as int))"))
    i = read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("fetched"), published.alias("published"))
    within = lambda c: (F.col(c) >= at("2024-01-13")) & (F.col(c) < at("2024-01-20"))
    late = within("fetched") & (F.col("published").isNull() | (F.col("published") >= at("2024-01-08")))
    return i.where(within("published") | late).select("event_id")


@query("""
    with a as (select p_partkey, string_split(p_name, ' ') as w, string_split(p_type, ' ') as t from part)
    select p_partkey, i as at, w[i + 1] as point, t[i + 1] as source from (select p_partkey, w, t, unnest(range(greatest(len(w), len(t)))) as i from a)""")
def cited_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists side by side, a row for each place."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.arrays_zip(F.split("p_name", " ").alias("point"), F.split("p_type", " ").alias("source")).alias("z"))
    rows = p.select("p_partkey", F.posexplode("z").alias("at", "x"))
    return rows.select("p_partkey", F.col("at").cast("long").alias("at"), "x.point", "x.source")


@query("""
    select o_custkey, coalesce(arg_min(o_orderkey, (o_orderdate, o_orderkey)) filter (o_orderpriority = '1-URGENT'), arg_max(o_orderkey, (o_totalprice, o_orderkey))) as item,
        bool_or(o_orderpriority = '1-URGENT') as is_money from orders group by 1""")
def representative_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item that stands for a company: its first of the telling kind, else its largest."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    first = F.min(F.when(urgent, F.struct("o_orderdate", "o_orderkey")))["o_orderkey"]
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.coalesce(first, F.max(F.struct("o_totalprice", "o_orderkey"))["o_orderkey"]).alias("item"), F.bool_or(urgent).alias("is_money")
    )


@query("""
    with s(stage, place) as (values ('view', 1), ('click', 2), ('signup', 3), ('purchase', 4), ('error', 5)),
    l as (select event_type, arg_max(value, (ts, event_id)) as value, max(ts) as ts from events group by 1)
    select stage, place, case when ts is null then 'never' when ts < timestamp '2024-01-30 23:30:00' then 'stale' when value < 20 then 'failed' else 'ok' end as state from s left join l on event_type = stage""")
def stage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each stage stands, by its latest run."""
    stages = spark.createDataFrame([("view", 1), ("click", 2), ("signup", 3), ("purchase", 4), ("error", 5)], "stage string, place int")
    last = read(spark, sf_dir, "events").groupBy("event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("l"))
    state = F.when(F.col("l").isNull(), "never").when(F.col("l.ts") < F.lit("2024-01-30 23:30:00").cast("timestamp_ntz"), "stale").when(F.col("l.value") < 20, "failed").otherwise("ok")
    return stages.join(last, F.col("stage") == F.col("event_type"), "left").select("stage", "place", state.alias("state"))


@query("""
    select p_partkey, case when lower(split_part(p_type, ' ', 1)) in ('standard', 'small', 'medium') then lower(split_part(p_type, ' ', 1)) else 'unknown' end as band, left(p_name, 8) as detail,
        array_to_string(list_filter(string_split(p_name, ' '), lambda w: length(w) > 3)[1:2], ',') as drivers from part""")
def checked_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements held to their vocabulary: other bands are unknown, details are cut, two drivers at most."""
    band = F.lower(F.get(F.split("p_type", " "), F.lit(0)))
    drivers = F.slice(F.filter(F.split("p_name", " "), lambda w: F.length(w) > 3), 1, 2)
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.when(band.isin("standard", "small", "medium"), band).otherwise("unknown").alias("band"), F.substring("p_name", 1, 8).alias("detail"), F.array_join(drivers, ",").alias("drivers")
    )


@query("""
    select l_partkey as hub, count(distinct l_suppkey) as degree, string_agg(distinct l_suppkey, ',' order by l_suppkey) as targets from lineitem group by 1""")
def paths_by_connector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per connector with its distinct targets in order."""
    e = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("hub"), "l_suppkey").distinct()
    near = F.array_sort(F.collect_list("l_suppkey"))
    told = F.array_join(F.transform(near, lambda x: x.cast("string")), ",")
    return e.groupBy("hub").agg(F.count(F.lit(1)).alias("degree"), told.alias("targets"))


@query("""
    select p_partkey, case when p_retailprice is null or p_retailprice <= 0 then 'Unknown' else 'K' end as unit, (length(p_name) + 3) // 4 as tokens,
        case when regexp_matches(p_name, '^(.*)\\s+(\\S+)$') then regexp_extract(p_name, '^(.*)\\s+(\\S+)$', 2) end as tail from part""")
def labels_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money labels' units, token estimates and the last word of a name."""
    p = read(spark, sf_dir, "part")
    label = text.usd_label(F.col("p_retailprice"))
    tail = F.when(F.col("p_name").rlike(r"^(.*)\s+(\S+)$"), F.regexp_extract("p_name", r"^(.*)\s+(\S+)$", 2))
    return p.select("p_partkey", F.when(label == "Unknown", label).otherwise(F.substring(label, -1, 1)).alias("unit"), text.token_estimate(F.col("p_name")).cast("long").alias("tokens"), tail.alias("tail"))


@query("""
    select event_id, hour(ts + interval 8 hour) as local_hour, cast(ts + interval 8 hour as date) as local_day, floor((epoch(timestamp '2024-01-31') - epoch(ts)) / 60)::bigint as minutes,
        ts > timestamp '2024-01-31' - interval 7 day as recent from events where event_type = 'signup'""")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as a place eight hours ahead shows them, minutes up to a moment, and whether they are recent."""
    e = read(spark, sf_dir, "events").where("event_type = 'signup'").withColumn("ts", F.col("ts").cast("timestamp"))
    end, local = F.lit("2024-01-31").cast("timestamp"), F.from_utc_timestamp("ts", "Asia/Singapore")
    minutes = F.floor((F.unix_micros(end) - F.unix_micros("ts")) / 60_000_000)
    return e.select("event_id", F.hour(local).alias("local_hour"), F.to_date(local).alias("local_day"), minutes.alias("minutes"), (F.col("ts") > end - F.expr("interval 7 days")).alias("recent"))
