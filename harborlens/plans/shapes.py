"""Queries over pages and filings whose shape varies by row: missing and nested tags, entities, other ways of reading that win, sites that aren't the company's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlens.functions import filters
from harborlens.operators.shared import spread
from harborlens.plans.registry import query, read
from harborlens.sources import scans, sites


@query("""
    with c as (select c_custkey as k, 'Bright rv' || c_custkey || 'x Inc' as company from customer)
    select company, case k % 6 when 0 then 'brightrv' || k || 'x.ai' when 1 then 'brightrv' || k || 'x.com' else 'bright-rv' || k || 'x.com' end as domain, case k % 6 when 1 then 'verified' when 5 then 'thin' else 'verified' end as verdict from c where k % 6 in (0, 1, 5)
    union all select 'Zephyr' || s_suppkey || 'x', 'zephyr' || s_suppkey || 'x.io', 'thin' from supplier where s_suppkey % 2 = 0""")
def guessed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites found by guessing: brokers' pages, dead and empty ones, pages of others, names of one word, and those that are the company's."""
    c, s = spread(read(spark, sf_dir, "customer"), ["c_custkey"], 20_000), spread(read(spark, sf_dir, "supplier"), ["s_suppkey"], 20_000)
    k = F.col("c_custkey")
    stem, long = F.concat(F.lit("rv"), k.cast("string"), F.lit("x")), F.concat(F.lit("rv"), k.cast("string"), F.lit("x builds plants. "))
    page = lambda domain, title, description, text: F.struct(domain.alias("domain"), F.lit(title).alias("title"), F.lit(description).cast("string").alias("description"), text.alias("text"))
    com, ai, hyphen = F.concat(F.lit("bright"), stem, F.lit(".com")), F.concat(F.lit("bright"), stem, F.lit(".ai")), F.concat(F.lit("bright-"), stem, F.lit(".com"))
    prose = F.repeat(F.concat(F.lit("Bright "), long), 12)
    pages = F.array(
        F.when(k % 6 == 0, page(com, "Premium domains", None, prose)), F.when(k % 6 == 0, page(ai, "Bright", "We build", prose)), F.when(k % 6 == 1, page(com, "Home", "We build", prose)),
        F.when(k % 6 == 2, page(com, "404 not found", None, prose)), F.when(k % 6 == 3, page(com, "Home", None, F.concat(F.lit("Bright "), stem))), F.when(k % 6 == 4, page(com, "Bright insurance", "cover", F.repeat(F.lit("Bright cover for all of your things. "), 12))),
        F.when(k % 6 == 5, page(hyphen, "Home", None, prose)),
    )
    one = F.concat(F.lit("zephyr"), F.col("s_suppkey").cast("string"), F.lit("x"))
    single = s.select(F.when(F.col("s_suppkey") % 2 == 0, page(F.concat(one, F.lit(".io")), "Home", None, F.repeat(F.concat(one, F.lit(" flies. ")), 12))).otherwise(page(F.concat(F.lit("the"), one, F.lit(".com")), "Home", None, F.repeat(one, 30))).alias("p"))
    held = c.select(F.explode(F.array_compact(pages)).alias("p")).unionByName(single).select("p.*")
    names = c.select(F.concat(F.lit("Bright "), stem, F.lit(" Inc")).alias("company")).unionByName(s.select(F.initcap(one).alias("company")))
    return sites.resolved_sites(names, held)


@query("""
    with s as (select s_suppkey as k, s_name, case s_suppkey % 4 when 0 then 'feed' when 1 then 'topic' when 2 then 'newsletter' else 'fund' end as kind, s_suppkey % 5 <> 0 as on_, case s_suppkey % 3 when 0 then [] when 1 then ['ai', 'health'] else ['energy'] end as sectors, 'http://s/' || s_suppkey // 2 as url from supplier)
    select min(s_name) as source, arg_min(kind, s_name) as kind, url from s where on_ and kind in ('feed', 'topic') and (len(sectors) = 0 or list_contains(sectors, 'ai')) group by url""")
def enabled_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a registry that are on, of two kinds, for one sector or any; each address once."""
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "feed").when(k % 4 == 1, "topic").when(k % 4 == 2, "newsletter").otherwise("fund")
    sectors = F.when(k % 3 == 1, F.array(F.lit("ai"), F.lit("health"))).when(k % 3 == 2, F.array(F.lit("energy")))
    rows = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("source"), kind.alias("kind"), F.when(k % 5 == 0, False).when(k % 5 == 1, True).alias("enabled"), sectors.alias("sectors"), F.concat(F.lit("http://s/"), F.floor(k / 2).cast("string")).alias("url"))
    return sites.enabled_sources(rows, ("feed", "topic"), ("ai",))


_BLOCKED = ", ".join(f"'{d}'" for d in filters.BLOCKED_DOMAINS)


@query(f"""
    with d as (select doc_id, [{_BLOCKED}] as ds, doc_id // 4 % {len(filters.BLOCKED_DOMAINS)} + 1 as i from documents)
    select doc_id, case when doc_id % 4 < 2 then ds[i] end as blocked from d""")
def blocked_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses on every blocked domain, below it, beside it (a longer name that ends alike) and elsewhere."""
    k = F.col("doc_id")
    domain = F.element_at(F.array(*map(F.lit, filters.BLOCKED_DOMAINS)), (F.floor(k / 4) % len(filters.BLOCKED_DOMAINS) + 1).cast("int"))
    url = F.when(k % 4 == 0, F.concat(F.lit("https://www."), F.upper(domain), F.lit("/x?y"))).when(k % 4 == 1, F.concat(F.lit("http://a.b."), domain, F.lit(":80/"))).when(k % 4 == 2, F.concat(F.lit("https://un"), domain)).otherwise(F.concat(F.lit("https://example.org/"), domain))
    return read(spark, sf_dir, "documents").select("doc_id", filters.blocked_domain(url).alias("blocked"))


@query("""
    select s_suppkey, case when s_suppkey % 5 <> 0 then s_name end as entity, case when s_suppkey % 3 = 0 then 'Irvine' end as city, case when s_suppkey % 4 = 1 then 2e6::double end as offered,
        case s_suppkey % 4 when 0 then 'debt' when 1 then 'equity' when 2 then 'equity+debt' else 'unspecified' end as securities,
        case s_suppkey % 4 when 0 then '' when 1 then 'Ann Lee' when 2 then 'Ann Lee, Bo Ray' else 'Ann B Lee, Bo Ray, Cy Moe' end as people from supplier""")
def varied_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings without an issuer's name, place or sums, with nobody, one, two or three persons, with line ends between tags."""
    k = F.col("s_suppkey")
    tag = lambda name, inner: F.concat(F.lit(f"<{name}>\n  "), inner, F.lit(f"\n</{name}>"))
    person = lambda *names: tag("relatedPersonInfo", F.concat(F.lit("<relatedPersonName>"), *(F.lit(f"<{t}>{v}</{t}>") for t, v in zip(("firstName", "middleName", "lastName"), names, strict=True) if v), F.lit("</relatedPersonName>")))
    ann, bo, cy = person("Ann", "N/A", "Lee"), person("Bo", "", "Ray"), person("Cy", "", "Moe")
    people = F.when(k % 4 == 0, "").when(k % 4 == 1, ann).when(k % 4 == 2, F.concat(ann, bo)).otherwise(F.concat(person("Ann", "B", "Lee"), bo, cy))
    issuer = F.concat(F.when(k % 5 != 0, tag("entityName", F.col("s_name"))).otherwise("<entityName> </entityName>"), F.when(k % 3 == 0, F.lit("<issuerAddress><city> Irvine</city></issuerAddress>")).otherwise(""))
    kinds = F.concat(F.when((k % 4).isin(1, 2), "<isEquityType>true</isEquityType>").otherwise("<isEquityType>false</isEquityType>"), F.when((k % 4).isin(0, 2), "<isDebtType>true</isDebtType>").otherwise(""))
    offered = F.when(k % 4 == 1, "<offeringSalesAmounts><totalOfferingAmount>2000000</totalOfferingAmount></offeringSalesAmounts>").when(k % 4 == 2, "<offeringSalesAmounts><totalOfferingAmount>Indefinite</totalOfferingAmount></offeringSalesAmounts>").otherwise("")
    xml = F.concat(tag("primaryIssuer", issuer), people, tag("offeringData", F.concat(tag("typesOfSecuritiesOffered", kinds), offered)))
    f = scans.filing_details(read(spark, sf_dir, "supplier").select("s_suppkey", xml.alias("xml")), "xml", "s_suppkey")
    return f.select("s_suppkey", "entity", "city", "offered", "securities", F.array_join(F.transform("people", lambda p: p["name"]), ", ").alias("people"))


@query("""
    select c_custkey, ['cards', 'image text', 'links', 'headings'][c_custkey % 4 + 1] as strategy, 'Nimbus ' || c_custkey || ',Cirrus Works' as names from customer""")
def varied_portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio pages of four makings, of which another way of reading finds the names each time."""
    k = F.col("c_custkey")
    own = F.concat(F.lit("Nimbus "), k.cast("string"))
    html = (
        F.when(k % 4 == 0, F.concat(F.lit('<li class="portfolio-item"><b>'), own, F.lit('</b></li><li id="company-2">Cirrus&nbsp;Works</li>')))
        .when(k % 4 == 1, F.concat(F.lit('<img src="a.png" alt="'), own, F.lit(' logo"><img src="b.png" alt="cirrus.png"><img alt="Cirrus Works-wordmark">')))
        .when(k % 4 == 2, F.concat(F.lit('<p><a href="/x"><i>'), own, F.lit('</i></a></p><p><a href="/y">Cirrus Works</a></p>')))
        .otherwise(F.concat(F.lit("<h3>"), own, F.lit("</h3><p>text</p><h4><span>Cirrus Works</span></h4>")))
    )
    rows = read(spark, sf_dir, "customer").select("c_custkey", html.alias("html"))
    found = scans.portfolio_names(rows, "html", "c_custkey", fewest=0)
    return found.select("c_custkey", "strategy", F.array_join(F.filter("names", lambda n: n != "cirrus"), ",").alias("names"))


@query("""
    select s_suppkey, case s_suppkey % 4 when 0 then 'Ann Lee' when 1 then 'Bo Ray' when 2 then 'Carla Rossi' else 'Dan Moe' end as name,
        case s_suppkey % 4 when 0 then 'founder' when 1 then 'partner' when 2 then 'unknown' else 'ceo' end as role from supplier""")
def varied_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team pages that name people in blocks, under headings, in links' addresses alone, or in nested tags; page words are no names."""
    k = F.col("s_suppkey") % 4
    html = (
        F.when(k == 0, '<section class="leadership"><h2>Our Team</h2></section><div class="bio"><b>Ann Lee</b><i>Founder</i></div>').when(k == 1, "<h2>Our Mission</h2><p>x</p><h3><a>Bo Ray</a></h3><p>Managing Partner</p>")
        .when(k == 2, '<a href="/team/all">All</a><a href="/team/carla-rossi"><img src="x.png"></a>').otherwise('<script>var a = "<div class=person>Zed Zap</div>"</script><li class="profile"><p><span>Dan Moe</span></p><p>Chief Executive Officer</p></li>')
    )
    return scans.team_people(read(spark, sf_dir, "supplier").select("s_suppkey", html.alias("html")), "html", "s_suppkey")


@query("""
    select p_partkey, case p_partkey % 3 when 0 then 'Research' when 1 then null else 'Funding' end as section, 'A long story about ' || p_name as title, case when p_partkey % 2 = 0 then 'http://x/' || p_partkey end as url from part""")
def varied_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues with a section, with none, and with two of which the later holds; stories with and without a link, sponsors left out."""
    k = F.col("p_partkey")
    link = F.when(k % 2 == 0, F.concat(F.lit('<a href="http://x/'), k.cast("string"), F.lit('">A long story about '), "p_name", F.lit(" (GitHub Repo)</a>"))).otherwise(F.concat(F.lit("<em>A long story about "), "p_name", F.lit("</em>")))
    heads = F.when(k % 3 == 0, "<h3>Research</h3>").when(k % 3 == 2, "<h3>Science</h3><h3><b>Funding</b></h3>").otherwise("<h3>tiny</h3>")
    html = F.concat(heads, F.lit("<h3>"), link, F.lit("</h3><h3>Buy this great thing now (Sponsor)</h3>"))
    return scans.newsletter_issue(read(spark, sf_dir, "part").select("p_partkey", html.alias("html")), "html", "p_partkey").select("p_partkey", "section", "title", "url")
