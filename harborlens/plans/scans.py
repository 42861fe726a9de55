"""Queries over pages, filings and results composed of whole tables; the SQL reads the columns that they are composed of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlens.functions import derive, gates
from harborlens.operators.shared import spread
from harborlens.plans.registry import query, read
from harborlens.sources import scans

XML = """concat('<edgarSubmission><primaryIssuer><entityName> ', s_name, '</entityName><issuerAddress><city>', case when s_suppkey % 3 = 0 then '' else 'Irvine' end, '</city><stateOrCountry>CA</stateOrCountry></issuerAddress>
    <yearOfInc><value>', cast(1990 + s_nationkey as varchar(4)), '</value></yearOfInc></primaryIssuer><relatedPersonsList><relatedPersonInfo><relatedPersonName><firstName>', case when s_suppkey % 2 = 0 then 'N/A' else 'Ann' end,
    '</firstName><lastName>Lee', cast(s_nationkey as varchar(4)), '</lastName></relatedPersonName><relatedPersonRelationshipList><relationship>Director</relationship><relationship> Promoter </relationship></relatedPersonRelationshipList></relatedPersonInfo>
    <relatedPersonInfo><relatedPersonName><firstName>Fund ', cast(s_suppkey as varchar(9)), '</firstName><lastName>LLC</lastName></relatedPersonName></relatedPersonInfo></relatedPersonsList><offeringData><industryGroup><industryGroupType>Computers</industryGroupType></industryGroup>
    <typesOfSecuritiesOffered><isEquityType>', case when s_suppkey % 4 < 2 then 'true' else 'false' end, '</isEquityType><isDebtType>', case when s_suppkey % 3 = 1 then 'true' else 'false' end, '</isDebtType></typesOfSecuritiesOffered>
    <offeringSalesAmounts><totalOfferingAmount>', case when s_suppkey % 5 = 0 then 'Indefinite' else cast(s_suppkey * 1000 as varchar(12)) end, '</totalOfferingAmount><totalAmountSold>0</totalAmountSold></offeringSalesAmounts>
    <typeOfFiling><newOrAmendment><isAmendment>', case when s_suppkey % 7 = 0 then 'true' else 'false' end, '</isAmendment></newOrAmendment></typeOfFiling></offeringData></edgarSubmission>')"""


@query("""
    select s_suppkey, s_name as entity, case when s_suppkey % 3 <> 0 then 'Irvine' end as city, (1990 + s_nationkey)::varchar as year, case when s_suppkey % 5 <> 0 then s_suppkey * 1000.0::double end as offered,
        case when s_suppkey % 4 < 2 and s_suppkey % 3 = 1 then 'equity+debt' when s_suppkey % 4 < 2 then 'equity' when s_suppkey % 3 = 1 then 'debt' else 'unspecified' end as securities, s_suppkey % 7 = 0 as amended,
        case when s_suppkey % 2 = 1 then 'Ann ' else '' end || 'Lee' || s_nationkey || '/director/false, Fund ' || s_suppkey || ' LLC//true' as people from supplier""")
def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings' issuers, amounts, kinds of securities and related persons."""
    f = scans.filing_details(read(spark, sf_dir, "supplier").select("s_suppkey", F.expr(XML).alias("xml")), "xml", "s_suppkey")
    told = F.transform("people", lambda p: F.concat(p["name"], F.lit("/"), F.when(F.size(p["relationships"]) > 0, derive.filed_role(F.get(p["relationships"], F.lit(0)))).otherwise(""), F.lit("/"), p["is_entity"].cast("string")))
    return f.select("s_suppkey", "entity", "city", "year", "offered", "securities", "amended", F.array_join(told, ", ").alias("people"))


ISSUE = """concat('<h3>', case p_size % 4 when 0 then 'Big Tech &amp; Startups' when 1 then 'Quick Links' when 2 then 'Science is long but no section head at all, at length' else 'Other' end, '</h3>', '<h3><a href="/n/', cast(p_partkey as varchar(9)), '"><b>The ',
    p_name, ' story told (5 minute read)</b></a></h3><h3>An advert for you (Sponsor)</h3><h3>Deals</h3><h3>short</h3><h3 class="x">', p_brand, ' buys ', p_type, ' makers &amp; more</h3>')"""


@query("""
    select p_partkey, case p_size % 4 when 0 then 'Big Tech & Startups' when 1 then 'Quick Links' end as section, 'The ' || p_name || ' story told' as title, '/n/' || p_partkey as url from part
    union all select p_partkey, case p_size % 4 when 0 then 'Big Tech & Startups' when 1 then 'Quick Links' end, 'Science is long but no section head at all, at length', null from part where false
    union all select p_partkey, null, 'Science is long but no section head at all, at length', null from part where p_size % 4 = 2
    union all select p_partkey, 'Deals', p_brand || ' buys ' || p_type || ' makers & more', null from part""")
def newsletter_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of issues under the section that holds for them."""
    return scans.newsletter_issue(read(spark, sf_dir, "part").select("p_partkey", F.expr(ISSUE).alias("html")), "html", "p_partkey").select("p_partkey", "section", "title", "url")


HOME = """concat('<a class=x href="https://tldr.tech/own">a story on our own pages</a><a href="https://a.com/', cast(p_partkey as varchar(9)), '">A story about ', p_name, '</a><a href="http://b.com/1">a STORY about ', p_name, '</a>',
    '<a href="https://c.com/">short one</a><a href="https://d.com/?utm_source=tldr&sponsor=1">an advert that is long enough</a><a href="https://e.com/x"><i>Another</i> long story of ', p_brand, ' (3 minute read)</a>')"""


@query("""select p_partkey, 'A story about ' || p_name as title, 'https://a.com/' || p_partkey as url from part union all select p_partkey, 'Another long story of ' || p_brand, 'https://e.com/x' from part
    union all select p_partkey, 'short one an advert that is long enough', 'https://c.com/' from part""")
def landing_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that landing pages link to elsewhere, each once."""
    return scans.newsletter_home(spread(read(spark, sf_dir, "part"), ["p_partkey"], 20_000).select("p_partkey", F.expr(HOME).alias("html")), "html", "p_partkey", "tldr.tech").select("p_partkey", "title", "url")


FRONT = """concat('<a href="/venture-capital-funding/', cast(c_custkey as varchar(9)), '"><h5>', c_name, ' raises &amp; grows</h5></a><span class="posted-date"> May ', cast(1 + c_custkey % 28 as varchar(2)), ', 2026 </span><p class="article-paragraph">A <b>', lower(c_mktsegment), '</b> firm.</p>',
    '<a href="/venture-capital-funding/', cast(c_custkey as varchar(9)), '"><h5>Again</h5></a><p>x</p><a href="/other/1"><h5>Elsewhere</h5></a><p>y</p>')"""


@query("""select c_custkey, '/venture-capital-funding/' || c_custkey as link, c_name || ' raises & grows' as title, 'May ' || (1 + c_custkey % 28) || ', 2026' as posted, 'A ' || lower(c_mktsegment) || ' firm.' as snippet from customer""")
def front_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of a front page, each link once."""
    return scans.front_page_stories(read(spark, sf_dir, "customer").select("c_custkey", F.expr(FRONT).alias("html")), "html", "c_custkey").select("c_custkey", "link", "title", "posted", "snippet")


PORTFOLIO = """concat('<nav><a href="/a">About</a><a href="/t">Team</a></nav><div class="company-card">', c_name, '</div><div class="card">Nimbus ', cast(c_custkey as varchar(9)), '</div><div class="card">NIMBUS ', cast(c_custkey as varchar(9)), '</div><div class="card">Acme &amp; Co</div>',
    case when c_custkey % 3 = 0 then '<div class="card">news</div><div class="card">2024</div><div class="card">Privacy Policy</div><div class="card">Apply now</div>' else '' end,
    '<a href="https://nimbus', cast(c_custkey as varchar(9)), '.com/x"><img alt="Nimbus"></a><a href="https://twitter.com/y">Bird</a><a href="https://www.fund.com/z">Ours</a>')"""


@query("""
    select c_custkey, 'cards' as strategy, case when c_custkey % 3 <> 0 then c_name || ',Nimbus ' || c_custkey || ',Acme & Co' else '' end as names, case when c_custkey % 3 = 0 then 7 else 0 end as rejected, 'nimbus' || c_custkey || '.com' as domain from customer""")
def portfolio_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies that portfolio pages list, unless they read as navigation, and the site of one."""
    p = spread(read(spark, sf_dir, "customer"), ["c_custkey"], 20_000).select("c_custkey", F.lit("https://www.fund.com/p").alias("url"), F.expr(PORTFOLIO).alias("html"))
    names = scans.portfolio_names(p, "html", "c_custkey").select("c_custkey", "strategy", F.array_join("names", ",").alias("names"), "rejected")
    return names.join(scans.portfolio_domains(p, "html", "url", "c_custkey").select("c_custkey", "domain"), "c_custkey")


TEAM = """concat('<div class="member-card"><p>Ann Lee</p><p>Co-Founder and CEO</p></div><div class="person">Board Member<br>Partner</div><h3>Bob van Dyke</h3><p>', case when s_nationkey % 2 = 0 then 'General Partner' else 'nothing' end,
    '</p><a href="/team/carla-rossi"><img alt="Carla Rossi"></a><a href="/team/all">All</a><a href="/people/ann-lee">Ann Lee</a>')"""


@query("""select s_suppkey, unnest(['Ann Lee', 'Carla Rossi']) as name, unnest(['founder', 'unknown']) as role from supplier union all select s_suppkey, 'Bob van Dyke', 'partner' from supplier where s_nationkey % 2 = 0""")
def team_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of team pages with their roles."""
    return scans.team_people(read(spark, sf_dir, "supplier").select("s_suppkey", F.expr(TEAM).alias("html")), "html", "s_suppkey")


@query("""
    with r as (select s_suppkey, s_name as company, unnest(['a', 'b']) as round, unnest([0, s_nationkey % 3]) as n from supplier)
    select company, round, 'i' || j as investor from r, range(0, 3) t(j) where j < n union all select company, round, null from r where n = 0""")
def flat_fundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each investor of each round of nested results read from JSON."""
    s = read(spark, sf_dir, "supplier")
    names = F.transform(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda j: j < F.col("s_nationkey") % 3), lambda j: F.struct(F.concat(F.lit("i"), j.cast("string")).alias("name")))
    none = F.expr("cast(array() as array<struct<name: string>>)")
    body = F.to_json(F.struct(F.col("s_name").alias("company"), F.array(F.struct(F.lit("a").alias("round"), none.alias("investors")), F.struct(F.lit("b").alias("round"), names.alias("investors"))).alias("fundings")))
    parsed = s.select(F.from_json(body, "company string, fundings array<struct<round: string, investors: array<struct<name: string>>>>").alias("r")).select("r.*")
    return scans.flat_fundings(parsed, "company", "fundings")


@query("""
    with n as (select s_suppkey, 'nimbus' || s_suppkey as stem from supplier)
    select stem || ' Labs' as company, s_suppkey as uen, upper(stem) || ' SINGAPORE PTE. LTD.' as registered, 'confirmed' as match from n where s_suppkey % 3 <> 0
    union all select stem || ' Labs', s_suppkey + 1000000, upper(stem) || ' DATA PTE LTD', 'confirmed' from n where s_suppkey % 3 <> 0 and s_suppkey % 2 = 0""")
def registry_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered names that may be a supplier's."""
    s = read(spark, sf_dir, "supplier").withColumn("stem", F.concat(F.lit("nimbus"), F.col("s_suppkey").cast("string")))
    registry = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("uen"), F.concat(F.upper("stem"), F.lit(" SINGAPORE PTE. LTD.")).alias("name"))
    registry = registry.unionByName(s.where("s_suppkey % 2 = 0 and s_suppkey % 3 <> 0").select((F.col("s_suppkey") + 1000000).alias("uen"), F.concat(F.upper("stem"), F.lit(" DATA PTE LTD")).alias("name")))
    return scans.registry_lookup(s.select(F.concat("stem", F.lit(" Labs")).alias("company")), registry)


@query("""
    with h as (select c_custkey, 'Bright River ' || c_custkey || ' Inc' as company from customer)
    select company, case c_custkey % 3 when 0 then 'brightriver' || c_custkey || '.io' when 1 then 'brightriver.com' else 'the-bright-river-' || c_custkey || '.co' end as host, 'bright-river-' || c_custkey as slug from h""")
def found_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The company's own site among search hits, and the hyphenated slug of its job board."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("n"), F.concat(F.lit("Bright River "), F.col("c_custkey").cast("string"), F.lit(" Inc")).alias("company"), (F.col("c_custkey") % 3).alias("k"))
    own = F.when(F.col("k") == 0, F.concat(F.lit("brightriver"), "n", F.lit(".io"))).when(F.col("k") == 1, "brightriver.com").otherwise(F.concat(F.lit("the-bright-river-"), "n", F.lit(".co")))
    hits = F.array(F.struct(F.lit(0).alias("rank"), F.lit("linkedin.com").alias("host")), *(F.struct(F.lit(i).alias("rank"), h.alias("host")) for i, h in ((1, F.lit("river.org")), (2, own), (3, F.lit("brightriver.net")))))
    rows = c.select("company", F.explode(hits).alias("h")).select("company", "h.*")
    return scans.site_among_hits(rows).select("company", "host", F.element_at(derive.board_slugs(F.col("company"), F.col("host")), 2).alias("slug"))


@query("""
    select page_id, page_id % 5 = 0 and page_id % 2 = 1 as challenge, length('https://news.google.com/rss/' || repeat('x', page_id % 200)) > 120 and page_id % 2 = 0 as wrapped from pages""")
def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bodies ask whether the reader is a robot, and which addresses are redirects."""
    i = F.col("page_id")
    body = F.concat(F.when(i % 5 == 0, "Just a moment... ").otherwise(""), F.when(i % 2 == 0, "<rss version=2>").otherwise(""), F.substr("html", F.lit(1), F.lit(500)))
    url = F.concat(F.when(i % 2 == 0, "https://news.google.com/rss/").otherwise("https://news.example.com/rss/"), F.repeat(F.lit("x"), (i % 200).cast("int")))
    return read(spark, sf_dir, "pages").select("page_id", gates.bot_challenge(body).alias("challenge"), gates.wrapped_url(url).alias("wrapped"))
