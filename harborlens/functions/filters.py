"""Predicates: blocklists, junk headlines, locations, jobs, registry matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlens.functions.text import first_match, fold_accents

# Hosts whose stories are not taken.
BLOCKED_DOMAINS = (
    "fool.com", "motleyfool.com", "zacks.com", "investorplace.com", "benzinga.com", "stocktwits.com", "simplywall.st",
    "marketbeat.com", "insidermonkey.com", "gurufocus.com", "tipranks.com", "barchart.com", "finance.yahoo.com", "msn.com",
    "news.yahoo.com", "einpresswire.com", "openpr.com", "prlog.org", "issuewire.com", "digitaljournal.com", "menafn.com",
    "indeed.com", "glassdoor.com", "ziprecruiter.com", "simplyhired.com", "jobs.lever.co.cdn.ampproject.org",
)
# Publishers whose stories are not taken.
BLOCKED_SOURCES = (
    r"(?i)^motley fool$|\bzacks\b|\binvestorplace\b|\bbenzinga\b|\bstocktwits\b|\bsimply wall st\b|\bmarketbeat\b|\binsider monkey\b"
    r"|\bgurufocus\b|\btipranks\b|\bbarchart\b|\bseeking alpha\b|\bmoomoo\b|\bmarketscreener\b|\bstock titan\b|\binvesting\.com\b"
    r"|\bthe globe and mail\b|\bmarket ?watch\b|\bstreet insider\b|\bstockstory\b|^yahoo( finance| news)?$|^msn$|\bfinance\.yahoo\b"
    r"|\bbiggo\b|\beinpresswire\b|\bopenpr\b|\bissuewire\b|\bdigital journal\b|\bmenafn\b|\bprlog\b"
)
# Headlines that are no news, in order; the first that fits names the reason.
JUNK_HEADLINES = (
    (r"(?i)^\d+\s+(best|top|hottest|biggest|leading|promising)", "listicle"),
    (r"(?i)\bstartups? to watch\b", "listicle"),
    (r"(?i)\bstocks? to (buy|watch|sell)\b", "stock_tip"),
    (r"(?i)\b(top|best)\s+\d+\b", "listicle"),
    (r"(?i)\bshould you (buy|sell|invest)\b", "stock_tip"),
    (r"(?i)\b(price (target|prediction)|share price|stock (forecast|price))\b", "stock_tip"),
    (r"(?i)\b(here's why|here is why)\b.*\b(soar|plunge|jump|tumble|rally)", "stock_tip"),
    (r"(?i)\bmarket (size|share|report|research|forecast)\b.*\b(20\d\d)\b", "market_report"),
    (r"(?i)\bglobal .* market\b.*\b(cagr|forecast|analysis)\b", "market_report"),
    (r"(?i)\bwhat (is|are)\b.*\?$", "explainer"),
    (r"(?i)\b(quiz|crossword|horoscope|obituary)\b", "not_news"),
)
# Publishers behind a paywall, and how far a publisher is trusted.
PAYWALLED = (
    r"(?i)wall street journal|wsj\b|financial times|\bft\.com|bloomberg|the information|the economist|barron|new york times"
    r"|nytimes|washington post|nikkei|business insider"
)
AUTHORITY = (
    (r"(?i)reuters|bloomberg|financial times|wall street journal|the economist", 100),
    (r"(?i)business wire|pr newswire|globenewswire", 90),
    (r"(?i)techcrunch|the information|axios|forbes|cnbc|wired|ars technica", 80),
    (r"(?i)job board", 75),
    (r"(?i)venturebeat|the verge|engadget|fierce|endpoints|stat news", 70),
    (r"(?i)prweb|einpresswire|openpr", 10),
)
# What a job's title says of its function and rank, in order.
FUNCTIONS = (
    (r"(?i)\b(manufactur|production|fab\b|cleanroom|process engineer|supply chain|logistics|assembly|hardware technician|facilities|plant\b)", "manufacturing"),
    (r"(?i)\b(research scientist|research engineer|scientist|r&d|principal investigator|computational|bioinformatic|chemist|biolog|physicist|phd\b)", "rnd"),
    (r"(?i)\b(engineer|developer|architect|sre\b|devops|infrastructure|data (scientist|engineer)|machine learning|software|technical staff|security)", "engineering"),
    (r"(?i)\b(sales|account (executive|manager|director)|business development|bd\b|partnership|channel|revenue|marketing|growth|customer success|solutions consultant|pre-?sales|gtm|go.to.market)", "sales_gtm"),
    (r"(?i)\b(support|success|operations|program manager|project manager|recruit|people|hr\b|talent|finance|legal|counsel|accounting|administrat|office manager)", "support"),
)
SENIORITY = (
    (r"\b(chief|cto|ceo|cfo|coo|vp\b|vice president|head of|general manager|country manager|managing director)\b", "exec"),
    (r"\b(director|principal|distinguished|fellow)\b", "director"),
    (r"\b(manager|lead\b|leader|supervisor)\b", "manager"),
    (r"\b(senior|sr\.?|staff|iii|iv)\b", "senior"),
    (r"\b(junior|jr\.?|intern|graduate|entry|associate|i{1,2}\b)\b", "junior"),
)
# Places by country, in order.
COUNTRIES = (
    ("Singapore", "singapore"), ("Japan", "japan|tokyo|osaka"), ("India", "india|bengaluru|bangalore|mumbai|delhi|hyderabad|pune|chennai"),
    ("China", "china|shanghai|beijing|shenzhen"), ("Hong Kong", "hong kong"), ("Taiwan", "taiwan|taipei"), ("South Korea", "korea|seoul"),
    ("Australia", "australia|sydney|melbourne|canberra|australian capital"), ("New Zealand", "new zealand"), ("Indonesia", "indonesia|jakarta"),
    ("Malaysia", "malaysia|kuala lumpur"), ("Thailand", "thailand|bangkok"), ("Vietnam", "vietnam|hanoi|ho chi minh"),
    ("Philippines", "philippines|manila"), ("United Kingdom", r"united kingdom|uk\b|london|england|scotland"), ("Ireland", "ireland|dublin"),
    ("Germany", "germany|berlin|munich|hamburg"), ("France", "france|paris"), ("Netherlands", "netherlands|amsterdam"),
    ("Spain", "spain|madrid|barcelona"), ("Switzerland", "switzerland|zurich|geneva"), ("Israel", "israel|tel aviv"),
    ("Canada", "canada|toronto|vancouver|montreal|ontario"), ("Poland", "poland|warsaw|krakow"), ("Brazil", "brazil|sao paulo"),
    ("Mexico", "mexico"), ("UAE", "uae|dubai|abu dhabi"),
)
# Words of registry names that say nothing of identity.
_LEGAL = r"\b(pte|ltd|limited|private|inc|incorporated|llc|corp|corporation|co|company|plc|lp|llp|pbc)\b"
_GEO = r"\b(singapore|sg|asia|asiapac|pacific|apac|international|global)\b"
_DESCRIPTIVE = (
    r"^(labs?|systems?|solutions?|technologies|technology|industries|industry|ventures?|partners?|capital|group|holdings?|digital"
    r"|consulting|services?|enterprises?|works?|studios?|projects?|minds?|data|ai|io)$"
)


def host(url: Column) -> Column:
    """Lower-case host without www of a web address, null for others."""
    return F.regexp_replace(F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))), r"^www\.", "")


def blocked_domain(url: Column) -> Column:
    """The blocked domain that an address belongs to, itself or above it; else null."""
    h = host(url)
    parts = F.split(h, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(h.isNotNull(), F.get(F.array_intersect(F.array(*(F.lit(d) for d in BLOCKED_DOMAINS)), ends), F.lit(0)))


def blocked_source(source: Column) -> Column:
    return F.when(F.trim(source).rlike(BLOCKED_SOURCES), F.trim(source))


def junk_reason(title: Column) -> Column:
    return first_match(title, JUNK_HEADLINES)


def source_authority(source: Column) -> Column:
    rank = F.coalesce(*(F.when(source.rlike(p), F.lit(r)) for p, r in AUTHORITY), F.lit(50))
    return rank - F.when(source.rlike(PAYWALLED), 60).otherwise(0)


def job_function(title: Column, department: Column | None = None) -> Column:
    text = F.concat(F.coalesce(department, F.lit("")) if department is not None else F.lit(""), F.lit(" "), title)
    return F.coalesce(first_match(text, FUNCTIONS), F.lit("other"))


def job_seniority(title: Column) -> Column:
    return F.coalesce(first_match(F.lower(title), SENIORITY), F.lit("ic"))


def country_of(location: Column) -> Column:
    return first_match(location, [(rf"(?i)\b({p})\b", name) for name, p in COUNTRIES])


def mentions(text: Column, terms: Column) -> Column:
    """Whether a text holds any term as whole words, whatever stands between them; terms of fewer than 3 letters don't count, and no terms pass."""
    loose = lambda c: F.trim(F.regexp_replace(fold_accents(F.lower(c)), "[^a-z0-9]+", " "))
    own = F.filter(F.transform(terms, loose), lambda t: F.length(t) >= 3)
    hay = F.concat(F.lit(" "), loose(text), F.lit(" "))
    return (F.size(own) == 0) | F.exists(own, lambda t: F.contains(hay, F.concat(F.lit(" "), t, F.lit(" "))))


def volume_trigger(before: Column, now: Column) -> Column:
    """A count that grew by 5 or more and by more than a quarter, from 20 or more; no baseline, no trigger."""
    return F.coalesce((before >= 20) & (now - before >= 5) & ((now - before) / before > 0.25), F.lit(False))


def registry_match(company: Column, registered: Column, collisions: Column) -> Column:
    """confirmed, probable or null: how surely a registered name is a company's.

    Legal and geographic words go; descriptive ones don't identify. A name met by more
    than two registered ones (``collisions``; unknown: of fewer than 7 letters) isn't distinctive.
    """

    def tokens(c: Column) -> Column:
        s = F.regexp_replace(fold_accents(F.lower(c)), r"[^a-z0-9\s]", " ")
        s = F.regexp_replace(F.regexp_replace(s, _LEGAL, " "), _GEO, " ")
        return F.filter(F.split(s, r"\s+"), lambda w: w != "")

    ct, rt = tokens(company), tokens(registered)
    own = lambda ts: F.filter(ts, lambda w: ~w.rlike(_DESCRIPTIVE))
    ci, ri = own(ct), own(rt)
    cj, rj = F.array_join(ci, ""), F.array_join(ri, "")
    distinctive = F.when(collisions.isNotNull(), collisions <= 2).otherwise(F.length(cj) >= 7)
    added = F.size(F.array_except(rt, ct)) > 0
    same = (
        F.when(added, F.when(distinctive, "confirmed"))
        .when(~distinctive, "probable").when(F.length(F.array_join(ct, "")) >= 5, "confirmed").otherwise("probable")
    )
    all_there = (F.size(F.array_except(ci, ri)) == 0) & (F.size(rt) <= F.size(ct) + 1)
    return F.when(
        (F.size(ci) > 0) & (F.size(ri) > 0),
        F.when(cj == rj, same)
        .when(F.contains(rj, cj) | F.contains(cj, rj), F.when(distinctive, "confirmed"))
        .when(all_there, F.when(distinctive, "probable")),
    )
