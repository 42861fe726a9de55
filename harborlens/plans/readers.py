"""Queries over what is read: replies with JSON, job boards, registry shards, event pages, feeds, indexes, headlines. Texts are composed of whole tables' rows, in shapes that vary by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlens.functions import dates, derive, filters, gates, money, text
from harborlens.operators.queues import discovery_candidates
from harborlens.operators.shared import shared_folder
from harborlens.plans.registry import query, read
from harborlens.sources import boards, feeds, registry, scans


def _pick(by: str, *forms: str) -> str:
    """SQL that both engines read: a form for each remainder of a column."""
    return f"case {by} % {len(forms)} " + " ".join(f"when {i} then {f}" for i, f in enumerate(forms)) + " end"


@query("""
    select conv_id, turn, turn % 6 as kind, turn % 6 not in (3, 4) as found, case when turn % 6 not in (3, 4) then role end as role,
        case when turn % 6 not in (3, 4) then case when turn % 6 = 5 then 'a } " \\ {' else '' end || coalesce(text, '') end as said from conversations""")
def json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON in replies: among prose, in a fence, as an array, cut off, missing, or with brackets and quotes in its strings."""
    c = read(spark, sf_dir, "conversations").withColumn("kind", F.col("turn") % 6)
    said = F.concat(F.when(F.col("kind") == 5, 'a } " \\ {').otherwise(""), F.coalesce("text", F.lit("")))
    body = F.to_json(F.struct("role", F.named_struct(F.lit("n"), F.array(F.lit(1), F.lit(2))).alias("deep"), said.alias("text")))
    raw = (
        F.when(F.col("kind") == 0, F.concat(F.lit("Sure ) here: "), body, F.lit(" Hope } that ] helps {}")))
        .when(F.col("kind") == 1, F.concat(F.lit("Answer [1]:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(F.col("kind") == 2, F.concat(F.lit('Two: ["]", '), body, F.lit(', "["] and more')))
        .when(F.col("kind") == 3, F.substring(body, F.lit(1), F.length(body) - 1)).when(F.col("kind") == 4, F.lit("no brackets at all")).otherwise(body)
    )
    v = c.select("conv_id", "turn", "kind", text.balanced_json(raw).alias("j")).withColumn("v", F.try_parse_json("j"))
    got = lambda f: F.coalesce(F.try_variant_get("v", f"$.{f}", "string"), F.try_variant_get("v", f"$[1].{f}", "string"))
    return v.select("conv_id", "turn", "kind", F.col("j").isNotNull().alias("found"), got("role").alias("role"), got("text").alias("said"))


_VENDORS = ["greenhouse", "lever", "ashby", "rippling", "workday"]


@query("""
    with c as (select c_custkey, ['greenhouse', 'lever', 'ashby', 'rippling', 'workday'][c_custkey % 5 + 1] as vendor, case when c_custkey % 11 = 0 then 404 when c_custkey % 13 = 0 then 500 else 200 end as status from customer),
    b as (select *, case when status = 404 then 'not_found' when status = 500 or vendor = 'workday' then 'error' when c_custkey % 17 = 0 then case vendor when 'rippling' then 'not_found' else 'error' end else 'ok' end as outcome from c),
    j as (select o_custkey, o_orderkey, case when o_orderkey % 19 <> 0 then 'Role ' || o_orderpriority end as title, case when o_orderkey % 3 <> 0 then 'City ' || o_orderkey % 7 end as place, o_orderkey % 23 <> 0 as has_url, o_orderdate from orders),
    k as (select c_custkey, vendor, o_orderkey::varchar as external_id, title, case when vendor = 'rippling' and o_orderkey % 4 = 0 then case when place is null then 'Remote' else place || '; Remote' end else place end as location,
        case when has_url or vendor in ('lever', 'ashby') then 'http://b/' || o_orderkey end as url, o_orderdate as posted_at, 'Team ' || o_orderkey % 5 as department
        from b join j on o_custkey = c_custkey where outcome = 'ok' and title is not null and (has_url or vendor <> 'greenhouse'))
    select c_custkey, b.vendor, outcome, external_id, title, location, url, posted_at, department from b left join k using (c_custkey)""")
def job_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four vendors' boards, made of each customer's orders: fields missing, alternative ones, times as numbers and as text, jobs told twice, boards not found, broken or unknown."""
    o = read(spark, sf_dir, "orders")
    key, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    title = F.when(key % 19 != 0, F.concat(F.lit("Role "), "o_orderpriority"))
    place, team = F.when(key % 3 != 0, F.concat(F.lit("City "), (key % 7).cast("string"))), F.concat(F.lit("Team "), (key % 5).cast("string"))
    url, other = F.when(key % 23 != 0, F.concat(F.lit("http://b/"), key.cast("string"))), F.when(key % 23 == 0, F.concat(F.lit("http://b/"), key.cast("string")))
    iso, ms = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.unix_millis(at)
    vendor = F.element_at(F.array(*map(F.lit, _VENDORS)), (F.col("o_custkey") % 5 + 1).cast("int"))
    s = lambda **f: F.struct(*(c.alias(n) for n, c in f.items()))
    shapes = {
        "greenhouse": s(id=key, title=title, location=F.when(place.isNotNull(), s(name=place)), absolute_url=url, first_published=iso, departments=F.array(s(name=team), s(name=F.lit("x")))),
        "lever": s(id=key.cast("string"), text=title, hostedUrl=url, applyUrl=other, createdAt=ms, categories=s(location=place, department=team)),
        "ashby": s(id=key, title=title, location=place, jobUrl=url, applyUrl=other, publishedAt=iso, team=team),
        "rippling": s(uuid=key, name=title, workLocation=s(label=place), url=url, createdAt=ms, department=s(label=team)),
    }
    again = s(uuid=key, name=title, workLocation=s(label=F.lit("Remote")), url=url, createdAt=ms, department=s(label=team))
    told = F.array(*(F.when(vendor == v, F.to_json(j)) for v, j in shapes.items()), F.when((vendor == "rippling") & (key % 4 == 0), F.to_json(again)))
    jobs = o.select("o_custkey", F.posexplode(told).alias("n", "job")).where("job is not null")
    listed = jobs.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "job"))), lambda x: x["job"]), ",").alias("jobs"))
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(k, F.element_at(F.array(*map(F.lit, _VENDORS)), (k % 5 + 1).cast("int")).alias("vendor"), F.when(k % 11 == 0, 404).when(k % 13 == 0, 500).otherwise(200).alias("status"))
    c = c.join(listed, k == F.col("o_custkey"), "left")
    array = F.concat(F.lit("["), F.coalesce("jobs", F.lit("")), F.lit("]"))
    held = F.when(F.col("vendor").isin("greenhouse", "ashby"), F.concat(F.lit('{"jobs": '), array, F.lit("}"))).when((F.col("vendor") == "rippling") & (k % 2 == 0), F.concat(F.lit('{"items": '), array, F.lit("}"))).otherwise(array)
    c = c.withColumn("body", F.when(k % 17 == 0, F.when(k % 2 == 0, '{"jobs": 3}').otherwise('"odd"')).otherwise(held))
    return boards.board_jobs(c, "vendor", "status", "body", "c_custkey").select("c_custkey", "vendor", "outcome", "external_id", "title", "location", "url", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "department")


@query("""
    with s as (select s_suppkey as k, chr(65 + (s_suppkey % 26)::int) || 'nimbus' || s_suppkey as stem from supplier),
    e as (select k, stem || ' Labs' as company, k as uen, upper(stem) || ' SINGAPORE PTE. LTD.' as registered, case when k % 7 = 0 then 'Struck Off' else 'Live Company' end as status from s where k % 3 <> 0
        union all select k, stem || ' Labs', k + 1000000, upper(stem) || ' DATA PTE LTD', 'Live Company' from s where k % 3 <> 0 and k % 2 = 0 and k % 10 <> 0
        union all select k, stem || ' Labs', k + 2000000, '3 ' || upper(stem) || ' PTE LTD', 'Live Company' from s where k % 3 <> 0 and k % 10 = 0)
    select company, uen, registered, status, 'confirmed' as match, row_number() over (partition by company order by status <> 'Live Company', registered, uen)::int as place from e""")
def sharded_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered entities that may be a supplier's, from a registry written in shards by letter."""
    k = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier").withColumn("stem", F.concat(F.char(F.lit(65) + k % 26), F.lit("nimbus"), k.cast("string")))
    big = F.upper("stem")
    forms = F.array(
        F.struct(k.alias("uen"), F.concat(big, F.lit(" SINGAPORE PTE. LTD.")).alias("name"), F.when(k % 7 == 0, "Struck Off").otherwise("Live Company").alias("status")),
        F.when((k % 2 == 0) & (k % 10 != 0), F.struct((k + 1000000).alias("uen"), F.concat(big, F.lit(" DATA PTE LTD")).alias("name"), F.lit("Live Company").alias("status"))),
        F.when(k % 10 == 0, F.struct((k + 2000000).alias("uen"), F.concat(F.lit("3 "), big, F.lit(" PTE LTD")).alias("name"), F.lit("Live Company").alias("status"))),
    )
    path = shared_folder(spark, "registry")
    registry.write_registry(s.where("s_suppkey % 3 <> 0").select(F.explode(F.array_compact(forms)).alias("e")).select("e.*"), path)
    companies = s.select(F.concat("stem", F.lit(" Labs")).alias("company"))
    return registry.lookup_sharded(companies, registry.read_registry(spark, path), F.col("status").startswith("Live"))


_BANNER = _pick("doc_id", "'Expo 1' || cast(doc_id % 9 + 1 as varchar(2)) || ' - 2' || cast(doc_id % 9 + 1 as varchar(2)) || ' October 2026'", "'Expo 1' || cast(doc_id % 9 + 1 as varchar(2)) || ' - 2' || cast(doc_id % 9 + 1 as varchar(2)) || ' October'", "'no banner'", "'12 May 2026'")


@query("""
    select doc_id, case when doc_id % 4 in (0, 1) and not (doc_id % 4 = 1 and doc_id % 3 = 0) then make_date(2026, 10, (11 + doc_id % 9)::int) end as starts_on,
        case when doc_id % 4 in (0, 1) and not (doc_id % 4 = 1 and doc_id % 3 = 0) then make_date(2026, 10, (21 + doc_id % 9)::int) end as ends_on from documents""")
def edition_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates at the head of directories: in full, without the year that the address has, none, or below the head."""
    d = read(spark, sf_dir, "documents")
    deep = F.when(F.col("doc_id") % 4 == 3, F.array_repeat(F.lit("An exhibitor"), 40)).otherwise(F.array_repeat(F.lit("Home"), (F.col("doc_id") % 5).cast("int")))
    lines = F.concat(deep, F.array(F.expr(_BANNER)), F.split(F.coalesce("text", F.lit("")), "\n"))
    url = F.concat(F.lit("https://show.example/"), F.when(F.col("doc_id") % 3 == 0, "list").otherwise("2026/list"))
    e = dates.edition_dates(lines, dates.year_in_url(url, F.lit("2026-03-01").cast("date")))
    return d.select("doc_id", e.alias("e")).select("doc_id", "e.starts_on", "e.ends_on")


_DAY = "cast(o_orderdate as date)"


@query(f"""
    with o as (select o_orderkey, {_DAY} as day, least(day({_DAY}) + 2, day(last_day({_DAY}))) as e from orders)
    select o_orderkey, case when o_orderkey % 5 <> 4 then day end as starts_on, case when o_orderkey % 5 in (0, 1) then make_date(year(day)::int, month(day)::int, e::int) when o_orderkey % 5 in (2, 3) then day end as ends_on from o""")
def event_date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each order as event pages write them, in four forms and none."""
    day = F.to_date("o_orderdate")
    d, y, m = F.dayofmonth(day).cast("string"), F.year(day).cast("string"), F.date_format(day, "MMMM")
    e, k = F.least(F.dayofmonth(day) + 2, F.dayofmonth(F.last_day(day))).cast("string"), F.col("o_orderkey") % 5
    t = (
        F.when(k == 0, F.concat(F.lit("Show | "), m, F.lit(" "), d, F.lit("–"), e, F.lit(", "), y)).when(k == 1, F.concat(F.lit("Expo "), d, F.lit(" - "), e, F.lit(" "), m, F.lit(" "), y))
        .when(k == 2, F.concat(d, F.lit(" "), m, F.lit(" "), y, F.lit(", Hall 3"))).when(k == 3, F.concat(F.lit("Opens "), m, F.lit(". "), d, F.lit(", "), y)).otherwise(F.concat(F.lit("© "), y, F.lit(" Exhibitors A–Z")))
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.date_range(t).alias("r")).select("o_orderkey", "r.starts_on", "r.ends_on")


_K = "cast(o_orderkey as varchar(20))"
_N = "cast(o_orderkey % 90 + 10 as varchar(4))"
_RAISED = _pick("o_orderkey", f"'Firm' || {_K} || ' raises $' || {_N} || 'M at $2.5B valuation'", f"'Firm' || {_K} || ' closes $' || {_N} || ' million Series B'", f"'Firm' || {_K} || ' lands US$' || {_N} || 'm seed round'", f"'Residents raise concerns over $' || {_N} || 'M plant ' || {_K}", f"'Firm' || {_K} || ' files for IPO'", f"'Firm' || {_K} || ' opens an office'")


@query("""
    select o_orderkey, ['', 'series_b', 'seed', '', 'ipo', ''][o_orderkey % 6 + 1] as round, case when o_orderkey % 6 < 3 then (o_orderkey % 90 + 10) * 1e6 end as amount, case when o_orderkey % 6 = 0 then 2.5e9 end as valuation from orders""")
def fundraise_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round, amount and valuation of a headline for each order; none for what isn't a raise."""
    f = read(spark, sf_dir, "orders").select("o_orderkey", money.parse_fundraise(F.expr(_RAISED)).alias("f"))
    return f.select("o_orderkey", F.coalesce("f.round", F.lit("")).alias("round"), "f.amount", "f.valuation")


@query("""
    select o_orderkey, case o_orderkey % 5 when 0 then 'website' when 1 then 'round' when 2 then 'country' end as agreed, case when o_orderkey % 5 <> 2 then (o_orderkey % 90 + 10)::double end as millions from orders""")
def profile_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ties a profile to an order's company: its website, a round of nearly the sum named, its country, or nothing; and the sum that the headline names."""
    k, n = F.col("o_orderkey"), (F.col("o_orderkey") % 90 + 10).cast("double")
    site = F.concat(F.lit("firm"), k.cast("string"), F.lit(".com"))
    headline = F.when(k % 5 == 2, "Swiss startup opens a lab").otherwise(F.concat(F.lit("Firm raises $"), (k % 90 + 10).cast("string"), F.lit("M")))
    rounds = F.when(k % 5 == 1, F.array(n * 3, n * 1.1)).when(k % 5 == 3, F.array(n * 1.5, n * 0.5)).otherwise(F.array().cast("array<double>"))
    url = F.when(k % 5 == 0, F.concat(F.lit("https://www."), site, F.lit("/about"))).otherwise(F.concat(F.lit("https://other"), k.cast("string"), F.lit(".io")))
    country = F.when(k % 5 == 2, "Switzerland").when(k % 5 == 4, "Germany")
    return read(spark, sf_dir, "orders").select("o_orderkey", money.profile_agrees(site, headline, url, country, rounds).alias("agreed"), money.headline_raise(headline).alias("millions"))


@query("""
    select o_orderkey, case o_orderkey % 7 when 0 then 'series_' || chr(97 + (o_orderkey // 7 % 12)::int) when 1 then 'series_' || chr(97 + (o_orderkey // 7 % 12)::int) when 2 then 'seed' when 3 then 'seed' when 4 then 'ipo' end as stage from orders""")
def round_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of round labels as a provider writes them."""
    letter = F.char(F.lit(65) + F.floor(F.col("o_orderkey") / 7) % 12)
    k = F.col("o_orderkey") % 7
    label = F.when(k == 0, F.concat(F.lit("Series "), letter, F.lit(" - II"))).when(k == 1, F.concat(F.lit(" series "), letter)).when(k == 2, "Pre-Seed").when(k == 3, "Seed VC").when(k == 4, "IPO - II").when(k == 5, "Convertible Note - III").otherwise("Growth Equity")
    return read(spark, sf_dir, "orders").select("o_orderkey", money.round_stage(label).alias("stage"))


@query("""
    select c_custkey, case c_custkey % 6 when 0 then 'dare ' || c_custkey when 1 then 'd matrix ' || c_custkey when 2 then 'smith and sons ' || c_custkey when 3 then 'societe generale ' || c_custkey when 4 then 'inc' else '???' end as name from customer""")
def normalise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they are compared: legal endings, accents and signs gone, never empty."""
    k = F.col("c_custkey")
    form = lambda a, b: F.concat(F.lit(a), k.cast("string"), F.lit(b))
    raw = F.when(k % 6 == 0, form("Daré ", " Technologies, Inc.")).when(k % 6 == 1, form("D-Matrix ", " Corp")).when(k % 6 == 2, form("Smith & Sons ", " Holdings Group")).when(k % 6 == 3, form("  Société Générale ", "  ")).when(k % 6 == 4, "Inc").otherwise("???")
    return read(spark, sf_dir, "customer").select("c_custkey", text.normalise_company(raw).alias("name"))


@query("""
    select c_custkey, case c_custkey % 6 when 0 then 'https://x' || c_custkey || '.com/a?a=1&b=2' when 1 then 'https://x' || c_custkey || '.com' when 2 then null when 3 then null when 4 then 'https://x' || c_custkey || '.com' else 'https://x' || c_custkey || '.com/p?b=1&b=0' end as canonical from customer""")
def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of each customer in six forms, and what they have in common."""
    k = F.col("c_custkey")
    host = F.concat(F.lit("X"), k.cast("string"), F.lit(".com"))
    url = (
        F.when(k % 6 == 0, F.concat(F.lit("http://www."), host, F.lit(":80/a?utm_source=x&b=2&a=1#top"))).when(k % 6 == 1, F.concat(F.lit("https://"), host, F.lit("/"))).when(k % 6 == 2, F.concat(F.lit("ftp://"), host))
        .when(k % 6 == 3, F.concat(F.lit("no address "), host)).when(k % 6 == 4, F.concat(F.lit("HTTPS://"), host, F.lit("/?ref=y"))).otherwise(F.concat(F.lit("https://"), host, F.lit("/p?b=1&b=0&gclid=3")))
    )
    return read(spark, sf_dir, "customer").select("c_custkey", text.canonical_url(url).alias("canonical"))


@query("select s_suppkey, ['confirmed', 'confirmed', null, 'probable', null, 'confirmed'][s_suppkey % 6 + 1] as outcome from supplier")
def registry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How surely a registered name is a supplier's: alone or among many that share its word."""
    k = F.col("s_suppkey")
    stem = F.concat(F.lit("Nimbus"), k.cast("string"))
    big = F.upper(stem)
    registered = F.when(k % 6 == 0, F.concat(big, F.lit(" PTE. LTD."))).when(k % 6 == 1, F.concat(big, F.lit(" SINGAPORE PTE LTD"))).when(k % 6 == 2, F.concat(F.lit("OTHER"), k.cast("string"), F.lit(" PTE LTD"))).when(k % 6 == 3, F.concat(big, F.lit(" PTE LTD"))).otherwise(F.concat(big, F.lit(" DATA PTE LTD")))
    collisions = F.when((k % 6).isin(3, 4), 9).otherwise(1)
    return read(spark, sf_dir, "supplier").select("s_suppkey", filters.registry_match(F.concat(stem, F.lit(" Labs")), registered, collisions).alias("outcome"))


@query("""
    with o as (select *, lpad(o_orderkey::varchar, 10, '0') || '-01-' || lpad((o_custkey % 1000000)::varchar, 6, '0') as accession from orders where o_orderdate::date >= date '2001-08-02' - 90 and o_orderdate::date < date '2001-08-02')
    select o_orderdate::date as day, case o_orderkey % 3 when 0 then 'D' else 'D/A' end as form, 'Firm ' || o_custkey || ' Inc.' as company, o_custkey::varchar as cik, o_orderdate::date as filed, accession from o where o_orderkey % 3 < 2""")
def filing_index_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms D of the daily indexes of 90 days, which list each order's filing on its day and again on the next."""
    o = read(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    form = F.rpad(F.when(k % 3 == 0, "D").when(k % 3 == 1, "D/A").otherwise("8-K"), 12, " ")
    accession = F.concat(F.lpad(k.cast("string"), 10, "0"), F.lit("-01-"), F.lpad((c % 1000000).cast("string"), 6, "0"))
    line = F.concat(form, F.lit("Firm "), c.cast("string"), F.lit(" Inc.    "), c.cast("string"), F.lit("   "), F.date_format("day", "yyyyMMdd"), F.lit("  edgar/data/"), accession, F.lit(".txt"))
    files = o.select("day", line.alias("line")).unionByName(o.select(F.date_add("day", 1).alias("day"), line.alias("line")))
    asof = F.lit("2001-08-02").cast("date")
    walked = feeds.walk_filing_index(files, "day", "line", asof, 90)
    return walked.where(F.col("filed") == F.col("day"))  # not those that the first index only repeats from the day before it


@query("""
    with d as (select doc_id, n_chars, lang from documents)
    select doc_id, 'Story ' || doc_id || ' & more' as title, 'http://n/' || doc_id as link, 'Text of ' || lang || ' < ' || n_chars as snippet, case doc_id % 3 when 0 then timestamp '2024-03-05 10:00:00' when 1 then timestamp '2024-03-05 08:00:00' end as published from d where doc_id % 7 <> 0""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of RSS and Atom feeds, one for each document: entities, CDATA, times in several forms or none, and items without a title."""
    k = F.col("doc_id")
    title = F.when(k % 7 != 0, F.concat(F.lit("<title>"), F.when(k % 2 == 0, F.concat(F.lit("<![CDATA[Story "), k.cast("string"), F.lit(" &amp; more]]>"))).otherwise(F.concat(F.lit("Story "), k.cast("string"), F.lit(" &amp; more"))), F.lit("</title>"))).otherwise("<title></title>")
    link = F.when(k % 2 == 0, F.concat(F.lit("<link>http://n/"), k.cast("string"), F.lit("</link>"))).otherwise(F.concat(F.lit('<link rel="alternate" href="http://n/'), k.cast("string"), F.lit('"/>')))
    words = F.concat(F.lit("&lt;p&gt;Text of "), "lang", F.lit("&lt;/p&gt; &amp;lt; "), F.col("n_chars").cast("string"))
    when = F.when(k % 3 == 0, "<pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate>").when(k % 3 == 1, "<updated>2024-03-05T08:00:00Z</updated>").otherwise("<pubDate>soon</pubDate>")
    item = F.when(k % 2 == 0, F.concat(F.lit("<item>"), title, link, F.lit("<description>"), words, F.lit("</description>"), when, F.lit("</item>"))).otherwise(F.concat(F.lit("<entry>"), title, link, F.lit("<summary>"), words, F.lit("</summary>"), when, F.lit("</entry>")))
    pages = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<feed>"), item, F.lit("</feed>")).alias("body"))
    return feeds.parse_feeds(pages, "body", "doc_id").select("doc_id", "title", "link", "snippet", F.col("published").cast("timestamp_ntz").alias("published"))


@query("""
    select c_custkey, unnest(case when c_custkey % 2 = 0 then ['Exhibitors', 'Firm ' || c_custkey, 'Booth & Hall ' || c_custkey % 5, 'Logo ' || c_custkey] else ['Firm ' || c_custkey, 'EXHIBITORS'] end) as line from customer""")
def show_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of exhibitors' directories, one page for each customer: repeats in any case, image texts, scripts and single letters."""
    k = F.col("c_custkey").cast("string")
    even = F.concat(F.lit("<script>var x = 'Hidden';</script><h2>Exhibitors</h2><li>Firm "), k, F.lit("</li><li>FIRM "), k, F.lit("</li><p>Booth &amp; Hall "), (F.col("c_custkey") % 5).cast("string"), F.lit('</p><img alt="Logo '), k, F.lit('"><p>A</p>'))
    odd = F.concat(F.lit("<div>Firm "), k, F.lit("</div><br><td>EXHIBITORS</td><td>exhibitors</td><style>p {}</style>"))
    pages = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, even).otherwise(odd).alias("html"))
    return feeds.directory_lines(pages, "html", "c_custkey").select("c_custkey", "line")


@query("""
    select doc_id, case when doc_id % 3 = 2 then 'Head ' || doc_id else 'Head ' || doc_id || case doc_id % 3 when 0 then ' - part two' else '' end end as title, case when doc_id % 3 < 2 then source end as publisher,
        'Firm & Co < ' || lang as snippet, doc_id % 4 <> 0 as rewritten from documents""")
def clean_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles parted from their publishers, and snippets cleaned of entities and tags; only those that the cleaning changes are written anew."""
    k = F.col("doc_id")
    title = F.when(k % 3 == 0, F.concat(F.lit("Head "), k.cast("string"), F.lit(" - part two - "), "source")).when(k % 3 == 1, F.concat(F.lit("Head "), k.cast("string"), F.lit(" - "), "source")).otherwise(F.concat(F.lit(" Head "), k.cast("string")))
    snippet = F.when(k % 4 == 0, F.concat(F.lit("Firm & Co < "), "lang")).when(k % 4 == 1, F.concat(F.lit("<b>Firm</b> &amp; Co  &lt; "), "lang")).when(k % 4 == 2, F.concat(F.lit("&lt;p&gt;Firm &amp;amp; Co&lt;/p&gt; &amp;lt; "), "lang")).otherwise(F.concat(F.lit("Firm&nbsp;&amp; Co &lt; "), "lang"))
    d = read(spark, sf_dir, "documents").select("doc_id", text.split_publisher(title).alias("t"), snippet.alias("raw"))
    clean = d.withColumn("snippet", text.clean_snippet(F.col("raw")))
    return clean.select("doc_id", "t.title", F.col("t.source").alias("publisher"), "snippet", (F.col("snippet") != F.col("raw")).alias("rewritten"))


@query("""
    with o as (select *, 'Firm' || o_custkey as name from orders where o_orderkey % 6 in (0, 1, 2) and o_custkey % 4 <> 0)
    select name, case o_orderkey % 6 when 1 then 'series_b' when 2 then 'seed' end as round, (o_orderkey % 90 + 10) * 1e6 as amount, case when o_orderkey % 6 = 0 then 2.5e9 end as valuation, o_orderkey as item_id, 's' || o_orderkey % 5 as source
    from o qualify row_number() over (partition by name order by o_orderdate desc, o_orderkey) = 1""")
def discovered_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies that headlines tell of and nobody knows, each by its latest headline; roundups, results and known names left out."""
    o = read(spark, sf_dir, "orders")
    k, n = F.col("o_orderkey"), (F.col("o_orderkey") % 90 + 10).cast("string")
    firm = F.concat(F.lit("Firm"), F.col("o_custkey").cast("string"))
    title = (
        F.when(k % 6 == 0, F.concat(firm, F.lit(" raises $"), n, F.lit("M at $2.5B valuation"))).when(k % 6 == 1, F.concat(firm, F.lit(" closes $"), n, F.lit(" million Series B"))).when(k % 6 == 2, F.concat(firm, F.lit(" lands US$"), n, F.lit("m seed round")))
        .when(k % 6 == 3, F.concat(firm, F.lit(" raises $"), n, F.lit("M: weekly roundup"))).when(k % 6 == 4, F.concat(firm, F.lit(" raises $"), n, F.lit("M after net loss"))).otherwise(F.concat(firm, F.lit(" opens an office")))
    )
    late = -F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    h = o.select(k.alias("item_id"), title.alias("title"), F.lit(None).cast("string").alias("snippet"), F.concat(F.lit("s"), (k % 5).cast("string")).alias("source"), F.lit("").alias("url"), late.alias("late"))
    known = read(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(text.normalise_company(F.concat(F.lit("FIRM"), F.col("c_custkey").cast("string"), F.lit(", Inc."))).alias("name"))
    return discovery_candidates(h, known, ["late"]).drop("title", "url")


@query("select c_custkey, c_custkey % 6 in (0, 4) as plausible, ['founder', 'ceo', 'partner', 'director', 'exec'][c_custkey % 5 + 1] as role from customer")
def show_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a row of a show's list is an attendee (not the show, its press, a blank, or a person whose name is none), and the role that a title says."""
    k = F.col("c_custkey")
    firm = F.concat(F.lit("Firm "), k.cast("string"))
    company = F.when(k % 6 == 1, "Tech-Show 2026").when(k % 6 == 2, F.concat(firm, F.lit(" Magazine"))).when(k % 6 == 3, " x ").otherwise(firm)
    person = F.when(k % 6 == 4, "Ann Lee").when(k % 6 == 5, "Register now for 2026!")
    title = F.element_at(F.array(*map(F.lit, ("Co-Founder", "Chief Executive Officer", "General Partner", "Chairman", "Head of Sales"))), (k % 5 + 1).cast("int"))
    ok = gates.plausible_participant(company, person, F.lit("TECH SHOW 2026"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.coalesce(ok, F.lit(False)).alias("plausible"), derive.listed_role(title, F.lit("senior")).alias("role"))


@query("""
    select c_custkey, c_name as name, 'He said "' || c_mktsegment || '", then' || chr(10) || 'left' as note, case when c_custkey % 3 = 0 then '' else round(c_acctbal)::bigint::varchar end as sum, 'part' || c_custkey % 2 as file from customer""")
def csv_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV files of one layout and read as one relation: quotes, line ends in cells, blanks at the ends and empty cells."""
    k = F.col("c_custkey")
    note = F.concat(F.lit('He said "'), "c_mktsegment", F.lit('", then\nleft'))
    c = read(spark, sf_dir, "customer").select(k.cast("string").alias("c_custkey"), F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name"), note.alias("note"), F.when(k % 3 != 0, F.round("c_acctbal").cast("long").cast("string")).alias("sum"), (k % 2).alias("half"))
    path = shared_folder(spark, "csv")
    for half in (0, 1):
        c.where(F.col("half") == half).drop("half").write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/part{half}")
    found = scans.read_csv_files(spark, [f"{path}/part0/*.csv", f"{path}/part1/*.csv"], ["c_custkey", "name", "note", "sum"])
    return found.withColumns({"c_custkey": F.col("c_custkey").cast("long"), "file": F.regexp_extract("file", "/(part[01])/", 1)})
