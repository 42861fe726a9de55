"""Queries over names, headlines, postings and places made of whole tables: what passes each gate, and what is derived.

Inputs are composed of columns by one SQL expression that both engines read; the rules are then written twice, as
Column functions and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlens.functions import derive, gates, money
from harborlens.functions.filters import COUNTRIES, FUNCTIONS, JUNK_HEADLINES, SENIORITY, country_of, job_function, job_seniority, junk_reason
from harborlens.functions.text import re2
from harborlens.plans.registry import query, read

#: A part's name as a company's, and headlines about it.
COMPANY = "concat(upper(substr(p_name, 1, 1)), replace(substr(p_name, 2), ' ', case when p_size % 3 = 0 then '' else ' Labs ' end))"
HEADLINE = f"""concat(
    case p_partkey % 7 when 0 then 'Exclusive: ' when 1 then 'AI chip startup ' when 2 then 'The ' when 3 then 'Report - ' else '' end,
    case when p_size = 13 then 'European robotics company' else {COMPANY} end,
    case p_partkey % 5 when 0 then '''s' when 1 then ' reportedly' when 2 then ', the maker,' else '' end,
    case p_partkey % 11 when 0 then ' raises $' when 1 then ' raised US$' when 2 then ' secures $' when 3 then ' closes round of $' when 4 then ' opens plant worth $'
        when 5 then ' to go public at $' when 6 then ' valued at $' when 7 then ' launches tool for $' when 8 then ' lands $' when 9 then ' reports a loss of $' else ' sees ' end,
    cast(p_size * 3 as varchar(9)), case p_partkey % 3 when 0 then 'M' when 1 then ' million' else 'bn' end,
    case p_size % 8 when 0 then ' Series A' when 1 then ' in seed round' when 2 then ' Series B extension' when 3 then ' to fuel growth' when 4 then ' at $2B valuation'
        when 5 then ' pre-seed' when 6 then ' bridge, says weekly digest' else '' end)"""
#: Postings of customers.
TITLE = """concat(case c_custkey % 9 when 0 then 'VP of Sales, ' when 1 then 'Country Manager ' when 2 then 'Head of Tax ' when 3 then 'Senior Software Engineer ' when 4 then 'Chief of Staff '
    when 5 then 'Regional Director, Operations ' when 6 then 'Process Engineer ' when 7 then 'General Manager ' else 'Recruiting Intern ' end,
    case c_nationkey % 6 when 0 then 'APAC' when 1 then 'Japan' when 2 then 'International' when 3 then 'EMEA' when 4 then 'Singapore' else '' end)"""
PLACE = """case c_nationkey when 0 then 'Singapore' when 1 then 'Tokyo, Japan' when 2 then 'San Francisco, CA' when 3 then 'Remote' when 4 then 'Remote - Singapore' when 5 then 'Austin, TX'
    when 6 then 'London' when 7 then 'Berlin, Germany' when 8 then 'Remote - US' when 9 then 'Global' when 10 then 'Hanoi' when 11 then 'Asia-Pacific' when 12 then 'Toronto, Ontario'
    when 13 then 'New York' when 14 then 'Bengaluru' when 15 then '' when 16 then 'Sydney, Australia' when 17 then 'Palo Alto' when 18 then 'Paris' when 19 then 'Multiple locations'
    when 20 then 'Mexico City, Mexico' when 21 then 'Kuala Lumpur' when 22 then 'Boulder, CO' when 23 then 'Lagos' else null end"""


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(f"""
    with h as (select p_partkey, {HEADLINE} as title from part),
    t as (select p_partkey, title, regexp_extract(regexp_replace(trim(title), {_q(gates.OPENER)}, ''), {_q('(?is)^(.*?)' + gates.RAISE_VERB[4:])}, 1) as led,
        regexp_matches(regexp_replace(trim(title), {_q(gates.OPENER)}, ''), {_q(gates.RAISE_VERB)}) as verb from h),
    n as (select *, trim(led) as before, trim(regexp_replace(trim(led), {_q(gates.LEAD_IN)}, '')) as bare, regexp_matches(trim(led), {_q(gates.LEAD_IN)}) as leads from t),
    o as (select *, case when not verb then null when not leads then before when regexp_matches(bare, '^[A-Z]') then case when regexp_matches(bare, {_q(gates.BARE_SUFFIX)}) then before else bare end end as own from n),
    c as (select *, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(case when not regexp_matches(own, '[''’]s\\b') then own end, '(?s)[,:;–—].*$', '')),
        '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}.''’&-]+$', ''), {_q(gates.AUXILIARY)}, '')) as name from o),
    w as (select *, regexp_split_to_array(name, '\\s+') as words from c)
    select p_partkey, case when name <> '' and not regexp_matches(name, {_q(gates.NO_COMPANY)}) and len(words) <= 5 and length(name) between 2 and 60 and regexp_matches(name, '[A-Z]')
        and not (regexp_matches(words[-1], {_q(gates.CATEGORY)}) and len(list_filter(words[:-2], lambda x: not regexp_matches(x, {_q(gates.DESCRIPTOR)}))) = 0)
        and (len(words) > 1 or regexp_matches(name, '^[A-Z]')) then name end as company from w""")
def headline_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The company that each headline is about."""
    return read(spark, sf_dir, "part").select("p_partkey", gates.company_from_headline(F.expr(HEADLINE)).alias("company"))


_SUM = r"(?:us\s*)?\$\s*[\d,.]+\s*(?:k|m|bn|b|t|thousand|million|billion|trillion)?"


def _usd(x: str) -> str:
    n = f"try_cast(replace(regexp_extract({x}, '\\$\\s*([\\d,]+(?:\\.\\d+)?)', 1), ',', '') as double)"
    return f"{n} * case when regexp_matches({x}, '(?i)\\d\\s*(bn?|billion)') then 1e9 when regexp_matches({x}, '(?i)\\d\\s*m') then 1e6 else 1 end"


_RAISES_SQL = f"""
    h as (select p_partkey, {HEADLINE} as title from part),
    f as (select *, regexp_extract(title, {_q(money.VALUED_AT)}, 1) as v1, regexp_extract(title, {_q(money.VALUATION)}, 1) as v2, regexp_extract(title, {_q(money.RAISED)}, 1) as r,
        regexp_extract(title, {_q('(?i)(' + _SUM + ')')}, 1) as s, lower(regexp_extract(title, {_q(money.ROUND)}, 1)) as stage,
        regexp_matches(title, {_q(money.GOING_PUBLIC)}) and not regexp_matches(title, {_q(money.IPO_COMMENT)}) as public from h),
    g as (select *, coalesce({_usd('v1')}, {_usd('v2')}) as valuation, {_usd('r')} as named, {_usd('s')} as lone,
        case when public then 'ipo' when stage in ('seed', 'pre-seed') then 'seed' when stage like 'series %' then 'series_' || stage[8:8] || case when stage like '%ext%' then '_ext' else '' end
            when stage like '%growth%' or stage like 'late%' then 'growth' end as round,
        public or regexp_matches(title, {_q(money.IS_RAISE[0])}) or regexp_matches(title, {_q(money.SERIES)}) or regexp_matches(title, '(?i)\\bvaluation\\b') as told from f),
    x as (select *, case when valuation is null then coalesce(named, lone) else nullif(named, valuation) end as amount from g),
    raises as (select p_partkey, title, case when told then round end as round, case when told then amount end as amount, case when told then valuation end as valuation from x)"""


@query(f"with {_RAISES_SQL} select p_partkey, round, amount, valuation from raises")
def headline_raises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round, amount and valuation of each headline."""
    f = money.parse_fundraise(F.expr(HEADLINE))
    return read(spark, sf_dir, "part").select("p_partkey", f["round"].alias("round"), f["amount"].alias("amount"), f["valuation"].alias("valuation"))


@query(f"""with {_RAISES_SQL} select p_partkey, regexp_matches(title, {_q(gates.EXPANSION)}) as expansion,
        (regexp_matches(title, {_q(gates.EVENT)}) and round is null and amount is null) as event from raises""")
def headline_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which headlines tell of an expansion, and which of an event other than a raise."""
    t = F.expr(HEADLINE)
    return read(spark, sf_dir, "part").select("p_partkey", gates.expansion_gate(t).alias("expansion"), gates.event_headline(t).alias("event"))


_JUNK_SQL = " ".join(f"when regexp_matches(title, {_q(p)}) then '{r}'" for p, r in JUNK_HEADLINES)
JUNKED = """concat(case p_partkey % 12 when 0 then '10 best ' when 1 then 'Should you buy ' when 2 then 'Global ' when 3 then 'What is ' when 4 then 'Here''s why ' when 5 then 'Top 5 ' when 6 then 'Crossword: ' else '' end,
    p_name, case p_size % 6 when 0 then ' startups to watch' when 1 then ' market size report 2026' when 2 then ' stock forecast' when 3 then ' shares soar' when 4 then ' market CAGR analysis' else '?' end)"""


@query(f"with t as (select p_partkey, {JUNKED} as title from part) select p_partkey, case {_JUNK_SQL} end as reason from t")
def headline_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each headline is no news, if it is none."""
    return read(spark, sf_dir, "part").select("p_partkey", junk_reason(F.expr(JUNKED)).alias("reason"))


_LABELS = r"(?is)<(?:a|h[1-6]|li|td)\b[^>]*>([^<]{1,60})<"
NAMES_SQL = f"names as (select page_id, unnest(regexp_extract_all(html, {_q(_LABELS)}, 1)) as raw from pages)"


@query(f"""
    with {NAMES_SQL}, s as (select page_id, raw, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as s from names),
    w as (select *, string_split(s, ' ') as words from s),
    k as (select *, len(list_filter(words, lambda x: list_contains({gates.TITLE_WORDS}, regexp_replace(lower(x), '[^a-z]', '', 'g')))) as titles,
        len(list_filter(words, lambda x, i: not ((i > 1 and regexp_matches(x, {_q(gates.PARTICLE)})) or regexp_matches(x, '^[A-Z]\\.?$') or regexp_matches(x, {_q(gates.NAME_WORD)})))) as odd from w)
    select page_id, count(*) as labels, count(*) filter (length(s) between 5 and 42 and lower(s) not in {gates.NO_PERSON} and not regexp_matches(s, '\\d|@|https?:|&|\\||,')
        and not regexp_matches(s, {_q(gates.FIRM_WORDS)}) and not regexp_matches(s, {_q(gates.INSTITUTION)}) and not regexp_matches(s, {_q(gates.HONORIFIC)})
        and len(words) between 2 and 4 and case when len(words) <= 2 then titles = 0 else titles < len(words) - 1 end and odd = 0) as people,
        count(*) filter (length(trim(raw)) between 2 and 48 and len(regexp_split_to_array(trim(raw), '\\s+')) <= 5 and lower(trim(raw)) not in {gates.PAGE_CHROME}
        and {" and ".join(f"not regexp_matches(trim(raw), {_q(p)})" for p in gates.NO_COMPANY_NAME)}
        and not (regexp_matches(trim(raw), '[.!?]$') and len(regexp_split_to_array(trim(raw), '\\s+')) > 2) and regexp_matches(trim(raw), '(?i)[a-z]')) as companies,
        count(*) filter (regexp_matches(trim(raw), {_q(gates.ENTITY_END)}) or regexp_matches(raw, {_q(gates.ENTITY_WORD)})) as entities from k group by 1""")
def page_name_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many labels of each page have the shape of a person's, a company's or a legal entity's name."""
    raw = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(re2(_LABELS)), F.lit(1))).alias("raw"))
    return raw.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("labels"), F.count_if(gates.person_name(F.col("raw"))).alias("people"), F.count_if(gates.company_name(F.col("raw"))).alias("companies"),
        F.count_if(gates.entity_name(F.col("raw"))).alias("entities"),
    )


@query(f"""
    with p as (select c_custkey, {TITLE} as title, {PLACE} as place from customer),
    r as (select *, nullif(regexp_extract(trim(title), {_q(derive.REGION)}, 0), '') as own, nullif(regexp_extract(coalesce(place, ''), {_q(derive.REGION)}, 0), '') as there from p),
    e as (select *, regexp_matches(title, {_q(derive.EXEC_TITLE)}) and not regexp_matches(title, {_q(derive.BACK_OFFICE)}) and (own is not null or (there is not null and regexp_matches(title, {_q(derive.EXPANSION_FUNCTION)}))) as hire from r)
    select c_custkey, case when hire then case when own is not null then 'regional_mandate' else 'expansion_function' end end as basis, case when hire then coalesce(own, there) end as region,
        case when hire then case {" ".join(f"when regexp_matches(title || ' ' || coalesce(place, ''), {_q(p)}) then {w}" for p, w in derive.REGION_WEIGHT)} else 10 end end as weight,
        coalesce(trim(place) <> '' and not regexp_matches(place, {_q(gates.US_WORDS)}) and not regexp_matches(place, {_q(gates.US_CODES)}) and not (regexp_matches(place, {_q(gates.ANYWHERE)}) and not regexp_matches(place, '[,-]'))
            and regexp_matches(place, {_q(gates.ABROAD)}), false) as abroad,
        coalesce(regexp_matches(place, {_q(gates.APAC)}), false) as apac from e""")
def job_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executive hires with the region they answer for, and whether a posting is abroad."""
    p = read(spark, sf_dir, "customer").select("c_custkey", F.expr(TITLE).alias("title"), F.expr(PLACE).alias("place"))
    h = derive.exec_hire(F.col("title"), F.col("place"))
    return p.select("c_custkey", h["basis"].alias("basis"), h["region"].alias("region"), h["weight"].alias("weight"), gates.abroad(F.col("place")).alias("abroad"), gates.in_apac(F.col("place")).alias("apac"))


@query(f"""
    with p as (select c_custkey, {TITLE} as title, {PLACE} as place from customer)
    select c_custkey, case {" ".join(f"when regexp_matches(title, {_q(p)}) then '{v}'" for p, v in FUNCTIONS)} else 'other' end as function,
        case {" ".join(f"when regexp_matches(lower(title), {_q(p)}) then '{v}'" for p, v in SENIORITY)} else 'ic' end as seniority,
        case {" ".join(f"when regexp_matches(place, {_q('(?i)' + chr(92) + 'b(' + p + ')' + chr(92) + 'b')}) then '{v}'" for v, p in COUNTRIES)} end as country from p""")
def posting_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function, rank and country of each posting."""
    t, place = F.expr(TITLE), F.expr(PLACE)
    return read(spark, sf_dir, "customer").select("c_custkey", job_function(t).alias("function"), job_seniority(t).alias("seniority"), country_of(place).alias("country"))


PAY = """concat('<p>Pay: ', case c_custkey % 6 when 0 then '&lt;b&gt;$' when 1 then 'S$ ' when 2 then '&pound;' when 3 then '£' when 4 then 'EUR ' else 'USD' end,
    case when c_custkey % 4 = 0 then '1,' else '' end, cast(100 + c_custkey % 900 as varchar(9)), case when c_custkey % 3 = 0 then '' else ',000' end, case c_custkey % 4 when 0 then ' - ' when 1 then ' to ' when 2 then '&amp;ndash;' else ' – ' end,
    case when c_custkey % 5 = 0 then '$' else '' end, cast(120 + c_custkey % 700 as varchar(9)), ',000</p> per year at Nimbus ', cast(c_custkey as varchar(12)), case when c_custkey % 2 = 0 then ' Pte. Ltd.' else ' Private Limited' end)"""


@query(f"""
    with p as (select c_custkey, {PAY} as body from customer),
    t as (select c_custkey, body, regexp_replace(regexp_replace(replace(replace(replace(replace(body, '&amp;', '&'), '&ndash;', '-'), '&lt;', '<'), '&gt;', '>'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g') as text from p),
    m as (select *, upper(regexp_extract(text, {_q(derive.SALARY)}, 1)) as sign, try_cast(replace(regexp_extract(text, {_q(derive.SALARY)}, 2), ',', '') as double) as lo,
        try_cast(replace(regexp_extract(text, {_q(derive.SALARY)}, 4), ',', '') as double) as hi from t)
    select c_custkey, case when lo > 0 and hi >= lo and hi <= 1e7 then lo end as low, case when lo > 0 and hi >= lo and hi <= 1e7 then hi end as high,
        case when lo > 0 and hi >= lo and hi <= 1e7 then case when sign like '%S$%' or sign = 'SGD' then 'SGD' when sign in ('£', 'GBP') then 'GBP' when sign in ('€', 'EUR') then 'EUR' else 'USD' end end as currency,
        trim(regexp_extract(body, {_q(derive.SG_ENTITY)}, 1)) || ' ' || trim(regexp_extract(body, {_q(derive.SG_ENTITY)}, 2)) as entity from m""")
def posting_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of pay in each posting, and the registered name that it gives."""
    p = read(spark, sf_dir, "customer").select("c_custkey", F.expr(PAY).alias("body"))
    s = derive.salary(F.col("body"))
    return p.select("c_custkey", s["low"].alias("low"), s["high"].alias("high"), s["currency"].alias("currency"), derive.sg_entity(F.col("body")).alias("entity"))


STATE = "case s_suppkey % 11 when 0 then 'CA' when 1 then 'WA' when 2 then ' ca' when 3 then 'TX' when 4 then 'Singapore' when 5 then 'NV' when 6 then 'NY' when 7 then 'PR' when 8 then null when 9 then 'CO' else 'XX' end"
CITY = "case s_nationkey % 5 when 0 then 'San Diego' when 1 then 'Irvine ' when 2 then 'Oakland' when 3 then null else 'la jolla' end"


@query(f"""
    with p as (select s_suppkey, {STATE} as st, {CITY} as city from supplier), u as (select *, coalesce(upper(trim(st)) in {tuple(gates.US_STATES)}, false) as us from p),
    r as (select *, case when us then case when st = 'WA' then 'seattle' when st = 'CA' then case when lower(trim(city)) in {derive.SAN_DIEGO_CITIES} then 'san_diego' when lower(trim(city)) in {derive.SOCAL_CITIES} then 'socal' else 'bay_area' end
        when st in {derive.WESTERN_STATES} then 'other_west' else 'other_us' end end as region from u)
    select s_suppkey, us, region, case when region is not null and region <> 'other_us' then 'west_coast' when us then 'other_us' else 'non_us' end as geography from r""")
def supplier_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a supplier is in the US, its region, and the class of its place."""
    p = read(spark, sf_dir, "supplier").select("s_suppkey", F.expr(STATE).alias("st"), F.expr(CITY).alias("city"))
    region = derive.region(F.col("st"), F.col("city"))
    return p.select("s_suppkey", gates.us_state(F.col("st")).alias("us"), region.alias("region"), derive.geography(region, F.col("st")).alias("geography"))


_GROUPS = [g for groups in derive.INDUSTRIES.values() for g in groups] + ["REITS and Finance", "Other Banking and Financial Services", "Quarries", ""]
INDUSTRY = f"case s_suppkey % {len(_GROUPS) + 1} " + " ".join(f"when {i} then '{g}'" for i, g in enumerate(_GROUPS)) + " else null end"
_ROUTES = ", ".join(f"({_q(g)}, '{d}', {_q(r)})" for d, groups in derive.INDUSTRIES.items() for g, r in groups.items())


@query(f"""
    with p as (select s_suppkey, {INDUSTRY} as grp from supplier), routes(g, disposition, reason) as (values {_ROUTES}),
    j as (select p.*, r.disposition, r.reason from p left join routes r on replace(trim(p.grp), ' and ', ' & ') = r.g)
    select s_suppkey, coalesce(disposition, 'in_scope') as disposition, case trim(grp) when 'Biotechnology' then 'health' when 'Pharmaceuticals' then 'health' when 'Computers' then 'digital' when 'Telecommunications' then 'digital' end as sector,
        coalesce(reason, case when coalesce(grp, '') = '' then 'no industry group stated; needs assessment' else 'unrecognised industry ''' || grp || '''; needs assessment' end) as reason from j""")
def industry_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where filings go by their industry group: companies, organisations, or out of scope."""
    r = derive.industry_route(F.expr(INDUSTRY))
    return read(spark, sf_dir, "supplier").select("s_suppkey", r["disposition"].alias("disposition"), r["sector"].alias("sector"), r["reason"].alias("reason"))


_SECTORS = [s for sectors in derive.FAMILIES.values() for s in sectors] + ["ai", "digital", "deeptech", "unheard_of"]
_FAMILY_OF = {s: f for f, sectors in derive.FAMILIES.items() for s in sectors}
_LIST = ", ".join(f"'{s}'" for s in _SECTORS)
_N = len(_SECTORS)


def _sector(i: str) -> str:
    return f"case ({i}) % {_N} " + " ".join(f"when {k} then '{s}'" for k, s in enumerate(_SECTORS)) + " end"


@query(f"""
    with p as (select p_partkey, {_sector('p_partkey')} as a, {_sector('p_size')} as c from part),
    f(s, family) as (values {", ".join(f"('{s}', '{f}')" for s, f in _FAMILY_OF.items())}), x(family, axis) as (values {", ".join(f"('{f}', '{a}')" for f, a in derive.AXES.items())}),
    e as (select p_partkey, unnest([a, c]) as s from p),
    ax as (select p_partkey, case when s in ('deeptech', 'biotech', 'defence_tech') then s else axis end as axis from e left join f using (s) left join x on x.family = coalesce(f.family, e.s))
    select p.p_partkey, fa.family as family, case when fc.family = fa.family then p.c end as child, coalesce(a.axes, '') as axes, a.controlled as export_controlled from p left join f fa on fa.s = p.a left join f fc on fc.s = p.c
        join (select p_partkey, string_agg(distinct axis, ',' order by axis) as axes, max(controlled) as controlled from (select ax.p_partkey, ax.axis, p.a in {gates.EXPORT_CONTROLLED} or p.c in {gates.EXPORT_CONTROLLED} as controlled from ax join p using (p_partkey)) group by 1) a using (p_partkey)""")
def sector_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company's family, its second sector where that fits the family, the axes of its sectors, and whether exports are controlled."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.expr(_sector("p_partkey")).alias("a"), F.expr(_sector("p_size")).alias("c"))
    family, both = derive.sector_family(F.col("a")), F.array("a", "c")
    return p.select(
        "p_partkey", family.alias("family"), derive.repaired_child(family, F.col("c")).alias("child"), F.array_join(derive.value_axes(both), ",").alias("axes"), gates.export_controlled(both).alias("export_controlled")
    )


NAME = "case doc_id % 6 when 0 then 'Sierra' when 1 then ' clay ' when 2 then 'Sierra Space' when 3 then 'Acme' when 4 then 'ring' else 'Orbit' end"
WEBSITE = "case doc_id % 4 when 0 then 'https://www.Sierra.ai/x' when 1 then null when 2 then 'localhost' else 'http://clay.com' end"


@query(f"""
    with d as (select doc_id, lower(text) as hay, {NAME} as name, {WEBSITE} as site, ['la', 'With', 'enre', null][doc_id % 4 + 1] as city, case doc_id % 3 when 0 then 'quantum' when 1 then 'medtech_devices' end as sector from documents)
    select doc_id, lower(trim(name)) in ('sierra', 'clay', 'ring', 'orbit') as ambiguous,
        coalesce(contains(hay, case when site like '%ierra%' then 'sierra.ai' when site like '%clay%' then 'clay.com' end), false) or coalesce(length(city) >= 4 and contains(hay, lower(city)), false)
            or coalesce(case sector when 'quantum' then contains(hay, 'quantum') when 'medtech_devices' then contains(hay, 'medical device') or contains(hay, 'medtech') end, false) as corroborated,
        '"' || name || '"' || case when lower(trim(name)) in ('sierra', 'clay', 'ring', 'orbit') and (sector is not null or doc_id % 4 in (0, 3)) then ' AND (' || array_to_string(list_filter(
            [case sector when 'quantum' then 'quantum' when 'medtech_devices' then '"medical device" OR medtech' end, case doc_id % 4 when 0 then 'sierra' when 3 then 'clay' end], lambda x: x is not null), ' OR ') || ')' else '' end as search from d""")
def name_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names are common words, whether a text is about the company all the same, and what to search for."""
    d = read(spark, sf_dir, "documents").select(
        "doc_id", "text", F.expr(NAME).alias("name"), F.expr(WEBSITE).alias("site"), F.expr("element_at(array('la', 'With', 'enre', null), cast(doc_id % 4 + 1 as int))").alias("city"),
        F.expr("array_compact(array(case doc_id % 3 when 0 then 'quantum' when 1 then 'medtech_devices' end))").alias("sectors"),
    )
    c = [F.col(x) for x in ("site", "city", "sectors")]
    return d.select(
        "doc_id", gates.ambiguous_name(F.col("name")).alias("ambiguous"), gates.corroborates(F.col("text"), *c).alias("corroborated"), gates.news_query(F.col("name"), c[0], c[2]).alias("search")
    )


@query("""
    select event_id, case when event_type = 'view' then null when ts < timestamp '2024-01-15' - interval 10 day then 'older_than_10d' end as reason from events where event_type <> 'error'
    union all select event_id, 'no_published_date' from events where event_type = 'error'""")
def recency_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items too old or without a date; job boards (views) always pass."""
    e = read(spark, sf_dir, "events").withColumn("at", F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp_ntz")))
    return e.select("event_id", gates.recency_reason(F.col("at"), F.lit("2024-01-15").cast("timestamp_ntz"), job_board=F.col("event_type") == "view").alias("reason"))


@query("""
    with t as (select conv_id, turn, role, text, trim(text, ' ') as s from conversations)
    select conv_id, turn, role, sha256(case when regexp_matches(s, '(?s)^[^.!?].*?[.!?]\\s') then regexp_extract(s, '(?s)^([^.!?].*?[.!?])\\s', 1) else s end) as first_sha256,
        sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) as escaped_sha256,
        length(array_to_string(list_filter(list_transform(string_split(text, ' · '), lambda x: trim(x, ' ')), lambda x: x <> ''), '|')) as points_length from t""")
def turn_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of each turn, its form in HTML, and its points."""
    t = read(spark, sf_dir, "conversations")
    return t.select(
        "conv_id", "turn", "role", F.sha2(derive.first_sentence(F.col("text")), 256).alias("first_sha256"), F.sha2(derive.html_escaped(F.col("text")), 256).alias("escaped_sha256"),
        F.length(F.array_join(derive.points(F.col("text")), "|")).alias("points_length"),
    )


LINER = """concat(case c_custkey % 5 when 0 then '"' when 1 then '  ' when 2 then '“' else '' end, case c_custkey % 9 when 0 then 'n/a' when 1 then 'Unknown' when 2 then 'makes – robots' else concat(lower(c_mktsegment), ' ', c_name) end,
    case c_custkey % 4 when 0 then '.' when 1 then '."' when 2 then ' and a tail so long that with all of its words the line has more than eighty characters' else '' end)"""


@query(f"""
    with t as (select c_custkey, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(trim(translate({LINER}, '–“', '-"'), ' '), '\\s+', ' ', 'g'), '\\.$', ''), ' '), '^["''`]', ''), '["''`]$', ''), ' ') as s from customer)
    select c_custkey, case when s <> '' and lower(s) not in {derive.NO_ANSWER} and length(s) <= 80 then upper(s[1]) || s[2:] end as line from t""")
def one_liners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each customer's card, if the answer is one."""
    return read(spark, sf_dir, "customer").select("c_custkey", derive.one_liner(F.expr(LINER)).alias("line"))


SPONSOR = "case s_suppkey % 5 when 0 then 'Duke-NUS Medical School' when 1 then 'Acme Bio' when 2 then 'National Cancer Centre' when 3 then null else 'Vertex' end"


@query(f"""
    with s as (select s_suppkey, {SPONSOR} as sponsor from supplier),
    c as (select s_suppkey, list(distinct case (o.k % 7) when 0 then 'Singapore' when 1 then 'Japan' when 2 then 'France' when 3 then 'Singapore' when 4 then 'Canada' when 5 then 'Singapore' else 'Germany' end) as countries
        from (select s_suppkey, s_suppkey + j * s_nationkey as k from supplier, range(1, 4) r(j)) o group by 1)
    select s_suppkey, not regexp_matches(coalesce(sponsor, ''), {_q(gates.LOCAL_SPONSOR)}) and list_contains(countries, 'Singapore') and not list_contains(countries, 'Japan') as first_site from s join c using (s_suppkey)""")
def first_asian_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sponsors from elsewhere whose only Asian country is Singapore."""
    country = "case (k % 7) when 0 then 'Singapore' when 1 then 'Japan' when 2 then 'France' when 3 then 'Singapore' when 4 then 'Canada' when 5 then 'Singapore' else 'Germany' end"
    s = read(spark, sf_dir, "supplier").withColumn("j", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("k", F.col("s_suppkey") + F.col("j") * F.col("s_nationkey"))
    s = s.groupBy("s_suppkey").agg(F.collect_set(F.expr(country)).alias("countries"))
    return s.select("s_suppkey", gates.first_asian_site(F.expr(SPONSOR), F.col("countries")).alias("first_site"))
