"""What a title, an address or a cell says: roles, regions, salaries, sectors, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlens.functions.filters import FUNCTIONS
from harborlens.functions.gates import us_state
from harborlens.functions.text import fold_accents, squeeze

# Executive hires, the regions they answer for, and how much each region weighs.
EXEC_TITLE = r"(?i)\b(chief|c[teo]o|cfo|cro|cso|president|vp|vice[\s-]president|svp|evp|head of|general manager|\bgm\b|managing director|country (lead|manager|head)|regional (lead|director|head|manager))\b"
REGION = r"(?i)\b(apac|asia[\s-]?pacific|asia|apj|aseanm?|southeast asia|japan|korea|china|india|singapore|taiwan|hong kong|australia|international|emea|latam|global)\b"
BACK_OFFICE = r"(?i)\b(tax|payroll|accounting|audit|compliance|treasury|order[\s-]to[\s-]cash|renewals|billing|procurement|deal desk|revenue operations|revops|controller|bookkeep)\b"
EXPANSION_FUNCTION = r"(?i)\b(expansion|market entry|go[\s-]to[\s-]market|gtm|business development|country|regional|operations|supply chain|manufacturing|site|facilit|partnerships?|commercial)\b"
REGION_WEIGHT = (
    (r"(?i)\bsingapore\b", 100), (r"(?i)\b(apac|asia[\s-]?pacific|apj|asean|southeast asia|asia)\b", 90),
    (r"(?i)\b(japan|korea|china|india|taiwan|hong kong|australia)\b", 80), (r"(?i)\binternational\b", 60), (r"(?i)\b(emea|latam)\b", 40), (r"(?i)\bglobal\b", 30),
)
# Salaries and registered names in postings.
SALARY = r"(?i)(US\$|S\$|\$|USD|SGD|EUR|GBP|£|€)\s*([\d,]{4,12})(?:\s*(?:-|–|—|to)\s*)(US\$|S\$|\$|USD|SGD|EUR|GBP|£|€)?\s*([\d,]{4,12})"
HOURLY = r"(?i)per hour|hourly|\/ ?hr"
SG_ENTITY = r"(?i)([A-Z][A-Za-z0-9&.\- ]{2,60}?)\s*(PTE\.?\s?LTD\.?|PRIVATE LIMITED)"
# Words for roles on a team page, by the role that they mean; where several stand, the longest counts.
ROLE_WORDS = (
    ("founder", ("founder", "co-founder", "cofounder")), ("ceo", ("ceo", "chief executive")),
    ("partner", ("partner", "general partner", "managing partner", "principal", "operating partner", "venture partner", "investor")),
    ("exec", ("cto", "coo", "cfo", "chief", "president", "vp", "vice president", "head of", "executive", "managing director", "director", "lead", "associate", "scientist", "engineer", "advisor")),
    ("director", ("chairman", "chairwoman", "chair", "board member")),
)
# States and cities by region.
WESTERN_STATES = ("OR", "NV", "AZ", "UT", "ID", "NM", "CO")
SOCAL_CITIES = ("los angeles", "santa monica", "pasadena", "irvine", "long beach", "el segundo", "burbank", "culver city", "torrance", "anaheim", "goleta", "santa barbara")
SAN_DIEGO_CITIES = ("san diego", "la jolla", "carlsbad")
# Sectors by family, and the axis on which a family's value propositions lie.
FAMILIES = {
    "compute": ("semiconductors", "photonics", "quantum"), "ai": ("ai_infrastructure", "ai_models", "ai_software"),
    "industrial": ("robotics", "advanced_manufacturing", "materials_energy"), "aerospace": ("space",), "defence": ("defence_systems", "defence_software"),
    "health": ("therapeutics", "biotech_platforms", "medtech_devices", "digital_health"),
    "digital": ("software_platforms", "cybersecurity", "networking_connectivity"), "commerce": ("commerce_marketplaces", "logistics_supply_chain"),
    "finance": ("fintech", "financial_services", "investment_funds"), "other": ("healthcare_services", "real_estate"),
}
AXES = {"ai": "ai", "digital": "ai", "compute": "deeptech", "industrial": "deeptech", "aerospace": "deeptech", "health": "biotech", "defence": "defence_tech"}
# Kinds of securities that a filing may tick, in order.
SECURITIES = (
    ("isEquityType", "equity"), ("isDebtType", "debt"), ("isPooledInvestmentFundType", "pooled_fund"), ("isOptionToAcquireType|isSecurityToBeAcquiredType", "option_warrant_other"),
    ("isMineralPropertyType", "mineral"), ("isTenantInCommonType", "tenant_in_common"), ("isOtherType", "other"),
)
# How filings' industry groups are routed, and the sectors that some of them tell.
INDUSTRIES = {
    "organization": {"Pooled Investment Fund": "fund, not an operating company", "Investing": "investing entity", "Investment Banking": "investment bank"},
    "in_scope": {
        "Biotechnology": "EDGAR Biotechnology = health", "Pharmaceuticals": "EDGAR Pharmaceuticals = health",
        "Computers": "EDGAR Computers = digital; hardware vs software needs assessment", "Telecommunications": "EDGAR Telecommunications = digital (networking)",
        "Manufacturing": "may be advanced manufacturing; needs assessment", "Other Technology": "EDGAR's tech catch-all; needs assessment",
        "Other Health Care": "may be biotech/medtech; needs assessment", "Environmental Services": "may be climate/materials tech; needs assessment",
        "Energy Conservation": "may be energy/materials tech; needs assessment", "Other Energy": "may be energy/materials tech; needs assessment",
        "Business Services": "may be AI/software; needs assessment", "Other": "unlabelled; needs assessment",
    },
    "out_of_scope": {
        "Agriculture": "agriculture", "Commercial Banking": "banking", "Insurance": "insurance", "Other Banking & Financial Services": "financial services",
        "Electric Utilities": "utilities", "Coal Mining": "extractive", "Oil & Gas": "extractive", "Health Insurance": "insurance",
        "Hospitals & Physicians": "care delivery, not biotech", "Commercial": "commercial real estate", "Construction": "construction",
        "REITS & Finance": "real estate finance", "Residential": "residential real estate", "Other Real Estate": "real estate", "Retailing": "retail",
        "Restaurants": "restaurants", "Airlines & Airports": "travel", "Lodging & Conventions": "travel", "Tourism & Travel Services": "travel", "Other Travel": "travel",
    },
}
INDUSTRY_SECTORS = {"Biotechnology": "health", "Pharmaceuticals": "health", "Computers": "digital", "Telecommunications": "digital"}
# Answers that tell nothing, how long a line may be, and endings that a job board's address leaves out.
NO_ANSWER = ("unknown", "unclear", "not clear", "n/a", "na", "none", "null", "no information", "not enough information", "cannot determine", "not specified", "not stated")
ONE_LINER = 80
SLUG_ENDINGS = r"\b(inc|corp|corporation|llc|ltd|limited|co|company|holdings|group|technologies|technology|labs|pbc)\b"


def _ladder(text: Column, rungs) -> Column:
    return F.coalesce(*(F.when(text.rlike(p), F.lit(v)) for p, v in rungs))


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def exec_hire(title: Column, location: Column) -> Column:
    """struct(basis, region, weight) of a posting for an executive who answers for a region; null for others."""
    t, where = F.trim(title), F.coalesce(location, F.lit(""))
    own, there = F.nullif(F.regexp_extract(t, REGION, 0), F.lit("")), F.nullif(F.regexp_extract(where, REGION, 0), F.lit(""))
    basis = F.when(own.isNotNull(), "regional_mandate").when(t.rlike(EXPANSION_FUNCTION) & there.isNotNull(), "expansion_function")
    weight = F.coalesce(_ladder(F.concat(t, F.lit(" "), where), REGION_WEIGHT), F.lit(10))
    return F.when(t.rlike(EXEC_TITLE) & ~t.rlike(BACK_OFFICE) & basis.isNotNull(), F.struct(basis.alias("basis"), F.coalesce(own, there).alias("region"), weight.alias("weight")))


def salary(content: Column) -> Column:
    """struct(low, high, currency, period) of the first range of pay in a posting, whose markup may be escaped twice; null without one."""
    text = content
    for _ in range(2):
        for pattern, sign in ((r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"(?i)&nbsp;|&#160;", " "), (r"(?i)&mdash;|&ndash;|&#8211;|&#8212;", "-"), (r"&#36;", r"\$"), (r"&#163;", "£"), (r"&#8364;", "€"), (r"&amp;", "&")):
            text = F.regexp_replace(text, pattern, sign)
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]+>", " "), r"\s+", " ")
    number = lambda g: F.replace(F.regexp_extract(text, SALARY, g), F.lit(","), F.lit("")).try_cast("double")
    low, high, sign = number(2), number(4), F.upper(F.regexp_extract(text, SALARY, 1))
    currency = F.when(F.contains(sign, F.lit("S$")) | (sign == "SGD"), "SGD").when(sign.isin("£", "GBP"), "GBP").when(sign.isin("€", "EUR"), "EUR").otherwise("USD")
    period = F.when((low < 500) | text.rlike(HOURLY), "hour").otherwise("year")
    return F.when((low > 0) & (high >= low) & (high <= 10_000_000), F.struct(low.alias("low"), high.alias("high"), currency.alias("currency"), period.alias("period")))


def sg_entity(text: Column) -> Column:
    """The first name with a Singapore legal form in a text, if it has eight letters or more."""
    name = squeeze(F.concat(F.trim(F.regexp_extract(text, SG_ENTITY, 1)), F.lit(" "), F.trim(F.regexp_extract(text, SG_ENTITY, 2))))
    return F.when(F.length(name) >= 8, name)


def decode_name(raw: Column) -> Column:
    """A name from a page: common entities decoded, signs of no width dropped, blanks squeezed."""
    for pattern, sign in ((r"&(amp|#38);", "&"), (r"&(quot|#34);", '"'), (r"(?i)&(apos|#39|#x27);", "'"), (r"&(lt|#60);", "<"), (r"&(gt|#62);", ">"), (r"(?i)&nbsp;|&#160;", " "), (r"[​-‍﻿]", "")):
        raw = F.regexp_replace(raw, pattern, sign)
    return squeeze(raw)


def role_in(context: Column) -> Column:
    """The role that a text beside a name tells, by the longest role word in it; null without any."""
    low = F.lower(context)
    words = sorted(((w, role) for role, ws in ROLE_WORDS for w in ws), key=lambda x: -len(x[0]))
    return F.coalesce(*(F.when(F.contains(low, F.lit(w)), F.lit(role)) for w, role in words))


def filed_role(relationship: Column) -> Column:
    r = F.lower(relationship)
    return F.when(F.contains(r, F.lit("executive officer")), "officer").when(F.contains(r, F.lit("director")), "director").when(F.contains(r, F.lit("promoter")), "promoter").otherwise("officer")


def listed_role(title: Column, seniority: Column) -> Column:
    t = F.lower(F.concat(title, F.lit(" "), seniority))
    return F.coalesce(_ladder(t, ((r"founder", "founder"), (r"chief executive|\bceo\b", "ceo"), (r"partner|principal|investor", "partner"), (r"board|director of the board|chairman|chairwoman", "director"))), F.lit("exec"))


def region(state: Column, city: Column | None = None) -> Column:
    """The region of a US state, California's by its city; null for other places."""
    c = F.lower(F.trim(F.coalesce(city, F.lit("")))) if city is not None else F.lit("")
    western = F.when(c.isin(*SAN_DIEGO_CITIES), "san_diego").when(c.isin(*SOCAL_CITIES), "socal").otherwise("bay_area")
    return F.when(us_state(state), F.when(state == "WA", "seattle").when(state == "CA", western).when(state.isin(*WESTERN_STATES), "other_west").otherwise("other_us"))


def geography(region: Column, state: Column) -> Column:
    return F.when(region.isNotNull() & (region != "other_us"), "west_coast").when(us_state(state), "other_us").otherwise("non_us")


def industry_route(group: Column) -> Column:
    """struct(disposition, sector, reason) of a filing's industry group, however it writes its ``and``."""
    disposition = {k: d for d, groups in INDUSTRIES.items() for k in groups}
    reasons = {k: r for groups in INDUSTRIES.values() for k, r in groups.items()}
    g = F.trim(F.coalesce(group, F.lit("")))
    forms = (g, F.replace(g, F.lit("&"), F.lit("and")), F.regexp_replace(g, r"\band\b", "&"))
    found = F.coalesce(*(F.when(_map(disposition)[f].isNotNull(), f) for f in forms))
    other = F.when(g == "", "no industry group stated; needs assessment").otherwise(F.concat(F.lit("unrecognised industry '"), group, F.lit("'; needs assessment")))
    return F.struct(
        F.coalesce(_map(disposition)[found], F.lit("in_scope")).alias("disposition"), _map(INDUSTRY_SECTORS)[found].alias("sector"),
        F.coalesce(_map(reasons)[found], other).alias("reason"),
    )


def security_type(xml: Column) -> Column:
    """Kinds of securities ticked in a filing, in order, joined by +; none -> unspecified."""
    block = F.regexp_extract(xml, r"(?s)<typesOfSecuritiesOffered>(.*?)</typesOfSecuritiesOffered>", 1)
    ticked = F.array_compact(F.array(*(F.when(block.rlike(f"<({names})>true</"), F.lit(kind)) for names, kind in SECURITIES)))
    return F.when(F.size(ticked) > 0, F.array_join(ticked, "+")).otherwise("unspecified")


def sector_family(sector: Column) -> Column:
    return _map({s: f for f, sectors in FAMILIES.items() for s in sectors})[sector]


def value_axes(sectors: Column) -> Column:
    """The axes that a company's sectors (or families, or axes themselves) lie on, sorted."""
    axis = lambda s: F.coalesce(F.when(s.isin("deeptech", "biotech", "defence_tech"), s), _map(AXES)[F.coalesce(sector_family(s), s)])
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce(sectors, F.expr("cast(array() as array<string>)")), axis))))


def repaired_child(family: Column, child: Column) -> Column:
    """A subsector only where it is one of the family given with it; the family stays, the contradiction goes."""
    return F.when(sector_family(child) == family, child)


def points(why: Column) -> Column:
    """The points of a reason, which stand between `` · ``."""
    return F.filter(F.transform(F.split(F.coalesce(why, F.lit("")), " · "), lambda x: F.trim(x)), lambda x: x != "")


def first_sentence(text: Column) -> Column:
    """All up to the first full stop, question or exclamation mark before a blank; the whole text if nothing follows."""
    t = F.trim(text)
    return F.coalesce(F.nullif(F.regexp_extract(t, r"(?s)^([^.!?].*?[.!?])\s", 1), F.lit("")), t)


def html_escaped(s: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(sign), F.lit(entity))
    return s


def one_liner(raw: Column) -> Column:
    """A line for a card: plain signs, no stop, no quotes, a capital first; null for no answer or more than 80 characters."""
    s = F.translate(F.trim(raw), "‐‑‒–—‘’“”   ", "-----''\"\"   ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"\.$", ""))
    s = F.trim(F.regexp_replace(s, "^[\"'`]|[\"'`]$", ""))
    return F.when((s != "") & ~F.lower(s).isin(*NO_ANSWER) & (F.length(s) <= ONE_LINER), F.concat(F.upper(F.substr(s, F.lit(1), F.lit(1))), F.substr(s, F.lit(2))))


def board_slugs(name: Column, website: Column) -> Column:
    """Where a company's job board may be: its name without endings, joined and hyphenated, and its site's label."""
    base = squeeze(F.regexp_replace(F.regexp_replace(fold_accents(F.lower(F.coalesce(name, F.lit("")))), r"[^a-z0-9\s-]", " "), SLUG_ENDINGS, " "))
    label = F.lower(F.substring_index(F.substring_index(F.regexp_replace(F.regexp_replace(website, r"^https?://", ""), r"^www\.", ""), "/", 1), ".", 1))
    return F.array_distinct(F.filter(F.array_compact(F.array(F.regexp_replace(base, r"[\s-]", ""), F.regexp_replace(base, r"\s+", "-"), label)), lambda s: F.length(s) >= 2))


def hiring_title(company: Column, h: Column) -> Column:
    """A headline of a hiring pattern h: struct(total, non_us, apac, singapore, top_function, lead_title, lead_location), by what weighs most."""
    lead = F.concat_ws(" ", h["lead_title"], h["lead_location"])
    regional = h["lead_title"].isNotNull() & ((h["singapore"] > 0) | lead.rlike("(?i)apac|asia|singapore|japan|korea|china|india"))
    mostly = F.coalesce(F.concat(F.lit(", mostly "), h["top_function"]), F.lit(""))
    n = lambda c: h[c].cast("string")
    return (
        F.when(regional, F.concat(company, F.lit(" is recruiting "), h["lead_title"], F.coalesce(F.concat(F.lit(" ("), h["lead_location"], F.lit(")")), F.lit(""))))
        .when(h["singapore"] > 0, F.concat(company, F.lit(" is hiring "), n("singapore"), F.when(h["singapore"] == 1, " role").otherwise(" roles"), F.lit(" in Singapore"), mostly, F.lit(", and "), n("apac"), F.lit(" across APAC")))
        .when(h["apac"] > 0, F.concat(company, F.lit(" has "), n("apac"), F.lit(" open APAC roles"), mostly))
        .otherwise(F.concat(company, F.lit(" has "), n("non_us"), F.lit(" open roles outside the US, none in APAC")))
    )


FUNCTION_KEYS = tuple(name for _, name in FUNCTIONS)
