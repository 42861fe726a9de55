"""Scans of pages, filings, search results and registries: what they list, as rows, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlens.functions.derive import decode_name, role_in, security_type
from harborlens.functions.filters import host, registry_match
from harborlens.functions.gates import company_name, entity_name, person_name
from harborlens.functions.text import bound, decode_entities, fold_accents, squeeze
from harborlens.sources.feeds import read_csv

# A newsletter's sections and sponsors, and what ends its titles.
SECTION = (
    r"(?i)^(big tech|science|programming|miscellaneous|quick links|research|startups|launches|deals|funding|policy|security|headlines|attacks|strategy|trends|tools|opinions|analysis"
    r"|around the horn|hardware|software|design|data|engineering|models)\b"
)
SPONSOR = r"(?i)\(sponsor\)|sponsored"
READ_TIME = r"(?i)\s*\((?:\d+\s*minute\s*read|GitHub Repo|Video|Sponsor)\)\s*$"
# Hosts that are no company's own.
FOREIGN_HOSTS = r"(?i)(twitter|x\.com|linkedin|facebook|youtube|instagram|medium|github|crunchbase|google|gstatic|webflow|squarespace|wixsite|cdn|cloudfront|typeform|mailchimp|hubspot|vimeo|substack|apple|spotify|bsky)"
# How pages mark up what they list.
CARD = r"""(?is)<(?:div|li|article|a|h[2-5])[^>]*(?:class|id)=["'][^"']*(?:portfolio|company|companies|card|logo|grid-item)[^"']*["'][^>]*>(.{0,400}?)</(?:div|li|article|a|h[2-5])>"""
ALT = r"""(?is)<img[^>]+alt=["']([^"']{2,60})["']"""
LINK = r"(?is)<a\s[^>]*>(.{0,120}?)</a>"
HEADING = r"(?is)<h[2-5][^>]*>(.{0,120}?)</h[2-5]>"
ALT_ENDING = r"(?i)[-_ ]?(cover[-_ ]?image|logo|logotype|icon|thumbnail|thumb|image|img|wordmark|mark|white|black|colour|color|dark|light|small|large|\d+x\d+)$"
TEAM_BLOCK = r"""(?is)<(?:div|li|article|a|section)[^>]*(?:class|id)=["'][^"']*(?:team|member|person|people|bio|profile|card|staff|leader)[^"']*["'][^>]*>(.{0,700}?)</(?:div|li|article|a|section)>"""
TEAM_HEADING = r"(?is)<h[2-5][^>]*>(.{0,80}?</h[2-5]>.{0,200})"
TEAM_LINK = r"""(?is)<a\s[^>]*href=["']([^"']*/(?:team|people|our-team|leadership|partners|staff|founders)/[^"'?#]+)["'][^>]*>(.{0,300}?)</a>"""
STORY = r"""(?is)(<a\s+href="[^"]+"[^>]*>\s*<h5[^>]*>.*?</h5>\s*</a>.{0,700}?</p>)"""
# Words of a company's name that don't lead to its registration.
REGISTRY_STOP = (
    "inc", "llc", "ltd", "corp", "limited", "incorporated", "company", "co", "the", "group", "holdings", "technologies", "technology", "labs", "systems", "solutions",
    "industries", "international", "global", "ventures", "partners", "capital", "ai", "io",
)


def read_csv_files(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """All files (or globs) of one layout as one relation, each row with the file that it comes from."""
    out = None
    for p in paths:
        part = read_csv(spark, p, columns).withColumn("file", F.input_file_name())
        out = part if out is None else out.unionByName(part)
    return out


def bare(html: Column) -> Column:
    return squeeze(F.regexp_replace(html, r"(?s)<[^>]+>", " "))


def _each(pages: DataFrame, html: Column, pattern: str, *keep: str) -> DataFrame:
    """(position, x): each first group of a pattern in a page, in order."""
    return pages.select(*keep, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("position", "x"))


def _scripts_gone(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style|svg)\b.*?</\1>", " ")


def newsletter_issue(pages: DataFrame, html: str, key: str, heading: str = "h3") -> DataFrame:
    """(position, section, title, url) of an issue's stories: headings in order, of which those that name a section hold for what follows."""
    rows = _each(pages, F.col(html), rf"(?is)<{heading}[^>]*>(.*?)</{heading}>", key).withColumn("text", squeeze(decode_entities(bare(F.col("x"))))).where("text <> ''")
    rows = rows.withColumn("_head", F.col("text").rlike(SECTION) & (F.length("text") < 45) & ~F.col("text").rlike("[.?!]"))
    w = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("section", F.last(F.when(F.col("_head"), F.col("text")), ignorenulls=True).over(w))
    title = F.trim(F.regexp_replace("text", READ_TIME, ""))
    return rows.where(~F.col("_head") & ~F.col("text").rlike(SPONSOR)).select(key, "position", "section", title.alias("title"), F.nullif(F.regexp_extract("x", 'href="([^"]+)"', 1), F.lit("")).alias("url")).where(F.length("title") >= 15)


def newsletter_home(pages: DataFrame, html: str, key: str, own_host: str, shortest: int = 18) -> DataFrame:
    """(position, title, url) of the stories that a landing page links to elsewhere, each title once, whatever its case."""
    rows = _each(pages, F.col(html), r'(?is)(<a[^>]+href="https?://[^"]+"[^>]*>.{15,300}?</a>)', key)
    rows = rows.withColumns({"url": F.regexp_extract("x", '(?is)href="(https?://[^"]+)"', 1), "text": squeeze(decode_entities(bare(F.col("x"))))})
    sold = F.col("url").rlike(r"utm_source=tldr(?!\w)") & F.col("url").rlike(r"(?i)sponsor|advertise|jobs\.")
    rows = rows.where(~F.contains(F.col("url"), F.lit(own_host)) & ~sold & ~F.col("text").rlike(SPONSOR)).withColumn("title", F.trim(F.regexp_replace("text", READ_TIME, "")))
    first = Window.partitionBy(key, F.lower("title")).orderBy("position")
    return rows.where(F.length("title") >= shortest).withColumn("_n", F.row_number().over(first)).where("_n = 1").select(key, "position", "title", "url")


def front_page_stories(pages: DataFrame, html: str, key: str, path: str = "/venture-capital-funding/") -> DataFrame:
    """(position, title, link, posted, snippet) of stories whose heading is a link into ``path``, each link once."""
    rows = _each(pages, F.col(html), STORY, key)
    part = lambda p: F.nullif(F.regexp_extract("x", p, 1), F.lit(""))
    rows = rows.select(
        key, "position", F.regexp_extract("x", '(?is)^<a\\s+href="([^"]+)"', 1).alias("link"), squeeze(decode_entities(bare(F.regexp_extract("x", "(?is)<h5[^>]*>(.*?)</h5>", 1)))).alias("title"),
        F.trim(part('(?is)class="[^"]*posted-date[^"]*"[^>]*>([^<]+)<')).alias("posted"), squeeze(decode_entities(bare(part('(?is)class="[^"]*article-paragraph[^"]*"[^>]*>(.*?)</p>')))).alias("snippet"),
    ).where((F.col("title") != "") & F.lower("link").contains(path))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "link").orderBy("position"))).where("_n = 1").drop("_n")


def portfolio_names(pages: DataFrame, html: str, key: str, fewest: int = 15, precision: float = 0.55) -> DataFrame:
    """(key, strategy, names, rejected, precision): the companies that a page lists, by that of four ways of reading it that finds most names surely.

    Cards by their class, image texts, links, headings: each way's names are filtered by their shape and made distinct, whatever their case; its score is their number times
    its precision (0.15 at least). A best way with few names and low precision reads the page's navigation, and gives no names.
    """
    clean = _scripts_gone(F.col(html))
    alt = squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("x"), ALT_ENDING, ""), r"(?i)\.(png|jpe?g|svg|webp|gif)$", ""), "[-_]+", " "))
    found = None
    for order, (strategy, pattern) in enumerate((("cards", CARD), ("image text", ALT), ("links", LINK), ("headings", HEADING))):
        part = _each(pages, clean, pattern, key).select(key, F.lit(order).alias("order"), F.lit(strategy).alias("strategy"), decode_name(alt if strategy == "image text" else bare(F.col("x"))).alias("name"), "position")
        found = part if found is None else found.unionByName(part)
    found = found.where("name <> ''").withColumn("ok", company_name(F.col("name")))
    each = found.groupBy(key, "order", "strategy", F.lower("name").alias("low"), "ok").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("position", "name")).alias("first"))
    ways = each.groupBy(key, "order", "strategy").agg(
        F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("first")))).alias("names"), F.count_if("ok").alias("kept"), F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0)).alias("rejected")
    ).where("kept > 0").withColumn("precision", F.col("kept") / (F.col("kept") + F.col("rejected")))
    best = ways.groupBy(key).agg(F.max_by(F.struct("strategy", "names", "kept", "rejected", "precision"), F.struct(F.col("kept") * F.greatest("precision", F.lit(0.15)), -F.col("order"))).alias("b")).select(key, "b.*")
    chrome = (F.col("kept") < fewest) & (F.col("precision") < precision)
    names = F.filter(F.col("names.name"), lambda n: ~n.rlike(r"(?i)^www\.|^https?:") & ~n.rlike(r"^\[.*\]$"))
    none = F.expr("cast(array() as array<string>)")
    return best.select(key, "strategy", F.when(chrome, none).otherwise(names).alias("names"), (F.col("rejected") + F.when(chrome, F.col("kept")).otherwise(F.col("kept") - F.size(names))).alias("rejected"), "precision")


def portfolio_domains(pages: DataFrame, html: str, url: str, key: str) -> DataFrame:
    """(key, name, domain): each company's site as the page's links tell it; a link's image text is taken before its own."""
    rows = _each(pages, F.col(html), r"""(?is)(<a\s[^>]*href=["']https?://[^"']+["'][^>]*>.{0,300}?</a>)""", key, url)
    there, here = host(F.regexp_extract("x", r"""(?is)href=["'](https?://[^"']+)["']""", 1)), host(F.col(url))
    inner = F.regexp_extract("x", r"(?is)^<a\s[^>]*>(.*)</a>$", 1)
    told = F.array_compact(F.array(F.nullif(decode_name(F.regexp_extract(inner, r"""alt=["']([^"']{2,48})["']""", 1)), F.lit("")), F.nullif(decode_name(bare(inner)), F.lit(""))))
    rows = rows.withColumns({"domain": there, "_own": here, "name": F.get(F.filter(told, company_name), F.lit(0))})
    own = (F.col("domain") == F.col("_own")) | F.endswith("domain", F.concat(F.lit("."), "_own"))
    rows = rows.where(F.col("name").isNotNull() & ~F.coalesce(own, F.lit(False)) & ~F.col("domain").rlike(FOREIGN_HOSTS))
    return rows.groupBy(key, "name").agg(F.max_by("domain", "position").alias("domain"))


def team_people(pages: DataFrame, html: str, key: str) -> DataFrame:
    """(key, name, role): people of a team page with a role beside their name; first those in blocks, then under headings, then links to profiles, who may have no known role."""
    clean = _scripts_gone(F.col(html))
    parts = None
    for order, pattern in enumerate((TEAM_BLOCK, TEAM_HEADING)):
        part = _each(pages, clean, pattern, key).withColumn("text", F.trim(F.regexp_replace(F.regexp_replace("x", r"(?s)<[^>]+>", " | "), r"\s+", " ")))
        part = part.select(key, F.lit(order).alias("order"), "position", role_in(F.col("text")).alias("role"), F.posexplode(F.split("text", r"\|")).alias("at", "raw")).withColumn("name", F.trim("raw"))
        part = part.where(person_name(F.col("name")) & F.col("role").isNotNull()).select(key, "order", "position", "at", "name", "role")
        parts = part if parts is None else parts.unionByName(part)
    linked = _each(pages, clean, r"(?is)(" + TEAM_LINK[5:] + ")", key)
    slug = F.element_at(F.filter(F.split(F.regexp_extract("x", TEAM_LINK, 1), "/"), lambda s: s != ""), -1)
    inner = F.regexp_extract("x", TEAM_LINK, 2)
    named = F.array(F.regexp_extract(inner, r"""alt=["']([^"']{4,42})["']""", 1), bare(inner), F.initcap(F.regexp_replace(slug, "[-_]+", " ")))
    linked = linked.where(~slug.rlike(r"(?i)^(all|index|page|\d+)$")).select(key, F.lit(2).alias("order"), "position", F.lit(0).alias("at"), F.get(F.filter(named, person_name), F.lit(0)).alias("name"), F.coalesce(role_in(bare(inner)), F.lit("unknown")).alias("role"))
    parts = parts.unionByName(linked.where("name is not null"))
    first = F.struct((F.col("role") == "unknown").alias("unknown"), "order", "position", "at")
    return parts.groupBy(key, F.lower("name").alias("low")).agg(F.min_by(F.struct("name", "role"), first).alias("p")).select(key, "p.name", "p.role")


def filing_details(filings: DataFrame, xml: str, *keep: str) -> DataFrame:
    """One row per filing: issuer, place, industry, amounts, kinds of securities, and the related persons as an array of structs."""
    tag = lambda body, name: F.nullif(F.regexp_extract(body, rf"(?s)<{name}>\s*(.*?)\s*</{name}>", 1), F.lit(""))
    value = lambda body, name: tag(tag(body, name), "value")
    x = F.col(xml)
    issuer, offering = tag(x, "primaryIssuer"), tag(x, "offeringData")
    sales = tag(offering, "offeringSalesAmounts")

    def person(b: Column) -> Column:
        given = F.filter(F.array(*(tag(b, n) for n in ("firstName", "middleName", "lastName"))), lambda p: p.isNotNull() & (F.upper(p) != "N/A"))
        return bound(squeeze(F.array_join(given, " ")), lambda name: F.struct(name.alias("name"), F.regexp_extract_all(b, F.lit(r"(?s)<relationship>\s*(.*?)\s*</relationship>"), F.lit(1)).alias("relationships"), entity_name(name).alias("is_entity")))

    people = F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"(?s)(<relatedPersonInfo>.*?</relatedPersonInfo>)"), F.lit(1)), person), lambda p: p["name"] != "")
    return filings.select(
        *keep, tag(issuer, "entityName").alias("entity"), tag(issuer, "city").alias("city"), tag(issuer, "stateOrCountry").alias("state"), value(issuer, "yearOfInc").alias("year"),
        tag(offering, "industryGroupType").alias("industry"), tag(sales, "totalOfferingAmount").try_cast("double").alias("offered"), tag(sales, "totalAmountSold").try_cast("double").alias("sold"),
        security_type(offering).alias("securities"), F.contains(offering, F.lit("<isAmendment>true</isAmendment>")).alias("amended"), people.alias("people"),
    )


def flat_fundings(results: DataFrame, company: str, fundings: str) -> DataFrame:
    """(company, round, investor) of nested results: a row for each investor of each round, rounds without any kept with null."""
    rounds = results.select(F.col(company).alias("company"), F.explode_outer(fundings).alias("f"))
    return rounds.select("company", F.col("f.round").alias("round"), F.explode_outer("f.investors").alias("i")).select("company", "round", F.col("i.name").alias("investor"))


def registry_lookup(companies: DataFrame, registry: DataFrame, most: int = 4) -> DataFrame:
    """(company, uen, registered, match): registered names that may be a company's, sure ones first.

    Over companies (company) and registry (uen, name). Candidates share one of the company's first two telling words of four letters or more with the
    registered name; how many there are says how far the name is distinctive. More than ``most`` matches of a short name are none.
    """
    letters = lambda c: F.trim(F.regexp_replace(fold_accents(F.lower(c)), r"[^a-z0-9\s]", " "))
    words = lambda c: F.array_distinct(F.split(letters(c), r"\s+"))
    telling = F.slice(F.filter(F.split(letters(F.col("company")), r"\s+"), lambda t: (F.length(t) >= 4) & ~t.isin(*REGISTRY_STOP)), 1, 2)
    asked = companies.select("company", F.explode(telling).alias("token"))
    met = asked.join(registry.select("uen", F.col("name").alias("registered"), F.explode(words(F.col("name"))).alias("token")), "token").select("company", "uen", "registered").distinct()
    met = met.join(met.groupBy("company").agg(F.count(F.lit(1)).alias("collisions")), "company")
    met = met.withColumn("match", registry_match(F.col("company"), F.col("registered"), F.col("collisions"))).where("match is not null")
    met = met.join(met.groupBy("company").agg(F.count(F.lit(1)).alias("matches")), "company")
    generic = (F.col("matches") > most) & (F.length(F.regexp_replace(letters(F.col("company")), r"\s+", "")) < 10)
    return met.where(~generic).select("company", "uen", "registered", "match")


def site_among_hits(hits: DataFrame, key: str = "company") -> DataFrame:
    """(company, host): the first search hit (company, rank, host) whose host is the company's compact name, holds it, or its first two words (eight letters or more)."""
    stop = ("inc", "llc", "ltd", "corp", "the", "company", "holdings", "group", "technologies", "labs")
    tokens = F.filter(F.split(F.regexp_replace(F.lower(key), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(*stop))
    rows = hits.withColumns({"_t": tokens, "_h": F.regexp_replace(F.regexp_replace("host", r"\.[a-z.]+$", ""), "[^a-z0-9]", "")}).withColumns({"_all": F.array_join("_t", ""), "_two": F.array_join(F.slice("_t", 1, 2), "")})
    held = lambda c: (F.length(c) >= 8) & F.contains("_h", F.col(c))
    fits = (F.size("_t") > 0) & ((F.col("_h") == F.col("_all")) | held("_all") | ((F.size("_t") >= 2) & held("_two")))
    return rows.where(fits & ~F.col("host").rlike(FOREIGN_HOSTS)).groupBy(key).agg(F.min_by("host", "rank").alias("host"))
