"""Gates on names, headlines and places: is this a company, a person, an event, in scope?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlens.functions.money import parse_fundraise
from harborlens.functions.text import bound, normalise_domain, re2, squeeze

# Company names that are common words.
AMBIGUOUS_NAMES = (
    "air", "anchor", "apex", "atlas", "beacon", "clay", "compass", "echo", "electra", "element", "figure", "flow", "forge", "fusion",
    "harvey", "instinct", "linear", "motion", "notion", "orbit", "origin", "owner", "prism", "pulse", "ring", "scale", "sierra", "signal",
    "spark", "summit", "temple", "vertex",
)
# Words that a story about a company of a sector is likely to hold.
SECTOR_HINTS = {
    "ai_software": ("AI", "software", "startup"), "ai_models": ("AI", "model", "startup"), "ai_infrastructure": ("AI", "infrastructure", "compute"),
    "semiconductors": ("chip", "semiconductor"), "photonics": ("photonics", "optical"), "quantum": ("quantum",), "robotics": ("robotics", "robot"),
    "space": ("space", "satellite", "launch"), "aerospace": ("aerospace", "aviation"), "defence_systems": ("defense", "defence", "military"),
    "defence_software": ("defense", "defence", "software"), "cybersecurity": ("cybersecurity", "security"),
    "therapeutics": ("biotech", "therapeutics", "clinical"), "biotech_platforms": ("biotech", "platform"), "medtech_devices": ("medical device", "medtech"),
    "digital_health": ("health", "digital health"), "fintech": ("fintech", "payments"), "software_platforms": ("software", "platform", "SaaS"),
    "advanced_manufacturing": ("manufacturing", "factory"), "materials_energy": ("energy", "materials", "battery"),
    "networking_connectivity": ("networking", "connectivity"),
}
# Words of an expansion, of an event, and scripts that are read whatever they say.
EXPANSION = r"(?i)\b(facilit|factor(y|ies)|plant\b|fab\b|campus|headquarter|hq\b|open(s|ed|ing)?\b|expand|expansion|manufactur|production|build(s|ing)?\b|invest(s|ed|ment)?\b|site\b|siting|relocat|footprint|capacity|award(s|ed)?\b|contract|acquir|acquisition)\b"
EVENT = (
    r"(?i)\b(opens?|opening|expands?|expansion|new (plant|facility|factory|site|campus|centre|center)|breaks? ground|manufactur|production line|partners?|partnership"
    r"|teams? up|collaborat|joint venture|alliance|signs? (a )?(deal|mou|agreement)|acquires?|acquisition|acquired|merges?|buys?|takeover|launches?|launched|unveils?"
    r"|debuts?|introduces?|rolls? out|appoints?|names? (a )?(new )?(ceo|cto|cfo|president|head)|hires?|taps?|wins?|won|awarded|selected (by|for)|contract"
    r"|fda (approval|clearance)|approval|cleared|certification|explores?|in talks|weighs?|plans? to|eyes?|considers?|to (build|open|invest|set up|establish|enter)"
    r"|invests?|investment|backs?|scales?|doubles?|triples?|adds? \d+|hiring|IPO|files? for|valuation|stake)\b"
)
OTHER_SCRIPT = r"[一-鿿぀-ヿ가-힯]"
ROUNDUP = r"(?i)\b(tracker|roundup|round-up|weekly|daily|digest|newsletter|this week in|top \d+|list of|deals? of the)\b"
RESULTS = r"(?i)\b(loss|losses|profit|revenue|earnings|writedown|write-down|impairment|deficit|fine|settlement|lawsuit|damages|valuation of its stake)\b"
# How a headline leads to a company's name and away from it.
RAISE_VERB = (
    r"(?i)\s+\b(raises?|raised|raising|secures?|secured|closes?|closed|lands?|landed|nets?|netted|banks?|announces?|announced|completes?|completed|emerges?|emerged"
    r"|launches?|launched|(?:to\s+)?(?:goes?|go) public|going public|files?|filed|prices?|priced|(?:to\s+)?debuts?|debuted|(?:to\s+)?lists?|listed|begins? trading)\b"
)
OPENER = r"(?i)^(exclusive|breaking|update|report|opinion|analysis|watch|video|podcast|interview|profile|q&a|explainer|sponsored|paid post)\b[:\s-]*"
LEAD_IN = r"(?i)^(?:[\w.-]+-backed\s+)?(?:[\w-]+\s+){0,5}?\b(startup|start-up|company|firm|maker|manufacturer|developer|platform|scaleup|scale-up|unicorn|venture|lab|group)\s+"
CATEGORY = r"(?i)^(startup|start-up|company|firm|maker|manufacturer|developer|scaleup|scale-up|unicorn|venture|ventures|business)s?$"
DESCRIPTOR = (
    r"(?i)^(a|an|the|new|young|early|late|first|second|largest|biggest|top|local|foreign|domestic|global|regional|leading|emerging|stealth|sg|us|uk|eu|ai|defen[cs]e"
    r"|fintech|biotech|healthtech|edtech|insurtech|proptech|agritech|cleantech|deeptech|space|quantum|robot|robotics|humanoid|drone|chip|semiconductor|travel|fashion"
    r"|energy|mobility|logistics|austin|boston|seattle|london|berlin|paris|singapore|indian|chinese|japanese|korean|german|french|british|american|european|asian)$"
)
NO_COMPANY = (
    r"(?i)^(the|a|an|this|these|those|new|top|best|why|how|what|when|where|india|china|singapore|us|uk|eu|europe|asia|apac|africa|startup|startups|vc|vcs|investors?"
    r"|founders?|report|study|survey|market|markets|sector|industry)\b"
)
BARE_SUFFIX = r"(?i)^(partners?|technologies|technology|systems|labs?|holdings?|group|ventures?|capital|industries|solutions|networks|sciences?)$"
KEPT_SUFFIX = r"(?i)\b(inc|corp|corporation|llc|ltd|limited|plc|ag|sa|bv|gmbh|labs?|technologies|technology|systems|robotics|bio|biosciences|therapeutics|semiconductor|semiconductors|networks|health|medical|space|ai)\b\.?$"
AUXILIARY = r"(?i)\s+\b(has|have|had|is|are|was|were|will|just|now|also|reportedly|said|says|to|set|plans?|prepares?)$"
# What a person's name isn't.
NO_PERSON = (
    "privacy policy", "terms of use", "contact us", "our team", "the team", "about us", "read more", "learn more", "view profile", "load more",
    "see all", "all rights", "general partner", "managing partner", "venture partner", "operating partner", "board member", "chief executive",
    "united states", "new york", "san francisco", "palo alto", "menlo park", "los angeles", "silicon valley", "east coast", "west coast",
)
TITLE_WORDS = (
    "executive assistant national security chief officer president vice managing general operating venture partner principal director associate "
    "chairman chairwoman chair founder cofounder head lead senior junior global regional technical technology financial marketing operations "
    "business development strategy strategic investment investments portfolio talent people platform communications legal counsel advisor advisory "
    "board member emeritus fellow scientist engineer analyst manager intern human resources information data product program project affairs relations "
    "our the team advisors activist environmental entrepreneur investor operator builder leader expert specialist consultant professor author "
    "former current retired co and of at in for"
).split()
FIRM_WORDS = r"(?i)\b(inc|llc|ltd|corp|corporation|company|capital|ventures|partners|fund|group|labs|technologies|holdings)\b"
INSTITUTION = r"(?i)\b(university|universit[eé]|college|school|institute|institut|academy|hospital|foundation|society|association|council|committee|board|boards|ministry|department|agency|bureau)\b"
HONORIFIC = r"(?i)^(the\s+)?(honorable|hon|rev|sir|dame|lord|lady|dr|prof|professor|mr|mrs|ms|gen|adm|col|capt|lt)\b"
PARTICLE = r"(?i)^(van|von|de|del|della|di|da|du|la|le|bin|al|ibn|mc|mac|st)$"
NAME_WORD = r"^[A-ZÀ-Þ][a-zà-ÿ'’]*(-[A-ZÀ-Þa-zà-ÿ'’]+)*$"
# What a company's name isn't, and legal forms.
PAGE_CHROME = (
    "home", "about", "about us", "team", "our team", "portfolio", "companies", "our companies", "news", "insights", "blog", "contact", "contact us", "careers",
    "jobs", "people", "press", "privacy", "privacy policy", "terms", "terms of use", "cookie policy", "legal", "login", "log in", "sign in", "sign up",
    "subscribe", "newsletter", "search", "menu", "close", "twitter", "linkedin", "facebook", "instagram", "youtube", "medium", "github", "x", "read more",
    "learn more", "view all", "see all", "load more", "next", "previous", "back", "all", "filter", "filters", "sort", "reset", "submit", "email", "follow us",
    "investments", "approach", "thesis", "strategy", "values", "mission", "vision", "process", "founders", "founder", "partners", "partnership", "platform",
    "resources", "events", "stories", "perspectives", "media", "reports", "research", "podcast", "videos", "exits", "ipo", "acquired", "current", "former",
    "active", "sitemap", "accessibility", "visit", "loading...", "loading", "company", "bio", "exited", "milestones", "industries", "overview", "more", "details",
    "website", "explore", "discover", "view", "open", "select", "toggle", "expand", "ai", "artificial intelligence", "robotics", "logistics", "security",
    "contact information", "press/media", "press / media", "news & insights", "news and insights", "who we serve", "how we help", "what we do", "connect",
    "connect with us", "get in touch", "view open roles", "open roles", "job openings", "portfolio job openings", "terms of use & privacy", "follow", "clear",
    "builders", "partner with us", "work with us", "contact us today", "offices", "office", "locations", "location", "our offices", "ideas", "principles",
    "roadmap", "lp portal", "investor disclosure", "investors", "back to top", "link", "[emailprotected]", "disclosures", "our approach", "our focus", "why us",
    "join us", "apply", "pitch us", "submit a pitch", "portfolio companies", "health", "healthcare", "fintech", "software", "hardware", "space", "climate",
    "enterprise", "consumer", "data", "semiconductors", "materials", "agriculture", "transportation", "san francisco", "new york", "los angeles", "austin",
    "boston", "chicago", "seattle", "menlo park", "palo alto", "london", "paris", "berlin", "munich", "zurich", "amsterdam", "stockholm", "dubai", "abu dhabi",
    "doha", "riyadh", "tel aviv", "bangalore", "bengaluru", "mumbai", "delhi", "singapore", "hong kong", "tokyo", "seoul", "beijing", "shanghai", "shenzhen",
    "taipei", "sydney", "melbourne", "toronto", "vancouver", "sao paulo", "mexico city",
)
NO_COMPANY_NAME = (
    r"^\d+$", r"(?i)^[^a-z0-9]+$", r"^(19|20)\d{2}$", r"(?i)\b(cookie|consent|gdpr|copyright|all rights reserved)\b",
    r"(?i)^(series|seed|stage|sector|industry|category|region)\b", r"@|https?:\/\/",
    r"(?i)\b(job openings?|open roles?|apply now|read the|view all|get in touch)\b",
    r"(?i)^(news|press|media|contact|careers|jobs|about|team|insights)\b.{0,20}$",
    r"(?i)^(terms of (use|service)|privacy policy|cookie policy|accessibility)$", r"&(quot|amp|#x27|#\d+);",
    r"(?i)^(accept|reject|allow|manage|decline)\b.{0,24}\bcookies?\b", r"\{\{|\}\}|\bitem\.\w+\.\w+",
    r"(?i)\b(platform|solution|software|tools?|infrastructure) for\b", r"(?i)\(opens in (a )?new (tab|window)\)",
    r"(?i)^([a-z0-9-]+\.)+[a-z]{2,}\/$", r"(?i)^[a-z0-9-]{6,}\.(com|io|ai|co|dev|net|org|health|xyz|bio|tech|app)$",
    r"^([A-Z][a-z]+\s){3,}[A-Z][a-z]+$", ",", ":",
)
ENTITY_END = r"(?i)\b(LLC|L\.L\.C|LP|L\.P|LLP|INC|CORP|CORPORATION|COMPANY|CO|LTD|LIMITED|TRUST|PARTNERS|CAPITAL|VENTURES|HOLDINGS|MANAGEMENT|FUND|GROUP|ASSOCIATES|ADVISORS)\b\.?$"
ENTITY_WORD = r"(?i)\b(LLC|LP|LLP|INC|CORP|LTD)\b"
NO_PARTICIPANT = r"(?i)\b(media partner|supporting (organisation|organization|association)|host(ed by)?|organiser|organizer|venue|convention cent(re|er)|association|society|magazine|journal|press|conference|expo|summit|symposium|show daily)\b"
# Places.
US_STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY "
    "DC PR VI GU AS MP"
).split()
US_CODES = r"\b(AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC)\b"
US_WORDS = (
    r"(?i)\b(united states|usa|u\.s\.|us remote|remote - us|remote \(us\)|san francisco|new york|seattle|boston|austin|los angeles|san diego|chicago|denver|atlanta"
    r"|washington|palo alto|mountain view|sunnyvale|santa clara|menlo park|redwood city|cupertino|bay area|silicon valley)\b"
)
ANYWHERE = r"(?i)\b(remote|anywhere|global|worldwide|multiple locations|various)\b"
ABROAD = (
    r"(?i)\b(singapore|japan|tokyo|korea|seoul|china|shanghai|beijing|shenzhen|hong kong|taiwan|taipei|india|bangalore|bengaluru|mumbai|delhi|hyderabad|australia|sydney"
    r"|melbourne|new zealand|indonesia|jakarta|malaysia|kuala lumpur|thailand|bangkok|vietnam|hanoi|ho chi minh|philippines|manila|united kingdom|uk|london|england"
    r"|ireland|dublin|germany|berlin|munich|france|paris|netherlands|amsterdam|spain|madrid|barcelona|italy|milan|rome|sweden|stockholm|switzerland|zurich|geneva|israel"
    r"|tel aviv|canada|toronto|vancouver|montreal|brazil|sao paulo|mexico|poland|warsaw|portugal|lisbon|denmark|copenhagen|norway|oslo|finland|helsinki|austria|vienna"
    r"|belgium|brussels|czech|prague|romania|bucharest|uae|dubai|abu dhabi|saudi|riyadh|south africa|cape town|nigeria|lagos|kenya|nairobi|egypt|cairo|turkey|istanbul"
    r"|argentina|chile|colombia|peru)\b"
)
APAC = (
    r"(?i)\b(singapore|japan|tokyo|korea|seoul|china|shanghai|beijing|shenzhen|hong kong|taiwan|taipei|india|bangalore|bengaluru|mumbai|delhi|hyderabad|australia|sydney"
    r"|melbourne|new zealand|indonesia|jakarta|malaysia|kuala lumpur|thailand|bangkok|vietnam|hanoi|ho chi minh|philippines|manila|apac|asia[- ]pacific|asia)\b"
)
LOCAL_SPONSOR = (
    r"(?i)\b(singapore|nanyang|ntu|nus\b|duke-nus|a\*star|astar|sengkang|tan tock seng|changi general|khoo teck puat|kk women"
    r"|national (heart|university|cancer|dental|skin|neuroscience)|singhealth|nhg\b|synapxe)\b"
)
ASIAN = ("Singapore", "Japan", "Korea, Republic of", "China", "Taiwan", "Hong Kong", "India", "Malaysia", "Thailand", "Indonesia", "Viet Nam", "Philippines")
EXPORT_CONTROLLED = ("defence_systems", "defence_software", "space", "quantum", "semiconductors")
BOT_CHALLENGE = r"(?i)Security Checkpoint|Just a moment\.\.\.|Enable JavaScript (?:and cookies )?to continue|cf-browser-verification|Attention Required!|Checking your browser before"


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(re2(p))
    return out


def ambiguous_name(name: Column) -> Column:
    """Whether a name is a common word; a name of several words never is."""
    n = F.lower(F.trim(name))
    return ~F.contains(n, F.lit(" ")) & n.isin(*AMBIGUOUS_NAMES)


def sector_hints(sectors: Column) -> Column:
    """The hint words of the first sector that has any."""
    table = F.create_map(*(x for k, v in SECTOR_HINTS.items() for x in (F.lit(k), F.array(*(F.lit(w) for w in v)))))
    known = F.filter(F.coalesce(sectors, F.expr("cast(array() as array<string>)")), lambda s: s.isin(*SECTOR_HINTS))
    return F.coalesce(table[F.get(known, F.lit(0))], F.expr("cast(array() as array<string>)"))


def _site(website: Column) -> Column:
    d = normalise_domain(website)
    return F.when(F.contains(d, F.lit(".")), d)


def corroborates(text: Column, website: Column, city: Column, sectors: Column) -> Column:
    """Whether a text names the company's whole domain, its city (four letters or more), or a hint of its sector."""
    hay = F.lower(text)
    told = F.exists(sector_hints(sectors), lambda h: F.contains(hay, F.lower(h)))
    return F.coalesce(F.contains(hay, _site(website)), F.lit(False)) | F.coalesce((F.length(city) >= 4) & F.contains(hay, F.lower(city)), F.lit(False)) | told


def news_query(name: Column, website: Column, sectors: Column) -> Column:
    """What to search the news for: the quoted name; of an ambiguous one with its sector's hints and its site's label."""
    label = F.substring_index(_site(website), ".", 1)
    terms = F.array_distinct(F.array_compact(F.concat(sector_hints(sectors), F.array(F.nullif(label, F.lit(""))))))
    shown = F.transform(terms, lambda t: F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))
    quoted = F.concat(F.lit('"'), name, F.lit('"'))
    return F.when(ambiguous_name(name) & (F.size(terms) > 0), F.concat(quoted, F.lit(" AND ("), F.array_join(shown, " OR "), F.lit(")"))).otherwise(quoted)


def recency_reason(published_at: Column, asof: Column, days: int = 10, job_board: Column | None = None) -> Column:
    """no_published_date, older_than_N_d, or null for an item that is recent; job boards list what is open, so their items always are."""
    old = F.when(published_at.isNull(), "no_published_date").when(published_at < asof - F.make_dt_interval(F.lit(days)), f"older_than_{days}d")
    return old if job_board is None else F.when(~job_board, old)


def expansion_gate(text: Column) -> Column:
    return text.rlike(EXPANSION)


def event_headline(title: Column, snippet: Column | None = None) -> Column:
    """Whether a headline tells of an event (or is in another script) and isn't a fundraise."""
    raised = bound(parse_fundraise(title, snippet), lambda f: F.coalesce(f["round"], f["amount"].cast("string")))
    return (title.rlike(EVENT) | title.rlike(OTHER_SCRIPT)) & raised.isNull()


def category_name(name: Column) -> Column:
    """Whether a name is only a kind of company: a category noun after nothing but descriptors."""
    words = F.split(F.trim(name), r"\s+")
    return F.element_at(words, -1).rlike(CATEGORY) & F.forall(F.slice(words, 1, F.size(words) - 1), lambda w: w.rlike(DESCRIPTOR))


def _subject(title: Column) -> Column:
    """What a headline says before its verb, as facts: struct(before, led, own), each null where there is none.

    ``before`` stands before the verb; ``led`` is that without the words that lead to a name, unless only a suffix would be left; ``own`` is what
    ``led`` holds before a comma or dash, without signs at its ends and a trailing auxiliary.
    """
    opened = F.regexp_replace(F.trim(title), OPENER, "")
    before = bound(opened, lambda x: F.when(x.rlike(RAISE_VERB), F.trim(F.substr(x, F.lit(1), F.regexp_instr(x, F.lit(RAISE_VERB)) - 1))))

    def led(x: Column) -> Column:
        rest = F.trim(F.regexp_replace(x, LEAD_IN, ""))
        return F.when(~x.rlike(LEAD_IN) | rest.rlike(BARE_SUFFIX) & rest.rlike("^[A-Z]"), x).when(rest.rlike("^[A-Z]"), rest)

    def own(x: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(x, r"(?s)[,:;–—].*$", "")), r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}.'’&-]+$", "")
        return F.trim(F.regexp_replace(bare, AUXILIARY, ""))

    return bound(before, lambda x: bound(led(x), lambda y: F.struct(x.alias("before"), y.alias("led"), own(y).alias("own"))))


def _rejections(s: Column) -> dict[str, Column]:
    """Why a subject is no company's name, by name of the reason."""
    own, words = s["own"], F.size(F.split(s["own"], r"\s+"))
    return {
        "no verb": s["before"].isNull(), "a kind of company": s["led"].isNull() | category_name(own), "part of a company": s["led"].rlike(r"['’]s\b"), "nothing left": own == "",
        "not a company": own.rlike(NO_COMPANY), "a sentence": (words > 5) | ~F.length(own).between(2, 60), "no capital": ~own.rlike("[A-Z]"), "a common noun": (words == 1) & ~own.rlike("^[A-Z]") & ~own.rlike(KEPT_SUFFIX),
    }


def headline_subject(title: Column) -> Column:
    """struct(name, rejected): the company that a headline says raises, launches or lists, or why what stands before the verb can't be its name."""

    def told(s: Column) -> Column:
        reason = F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), name) for name, test in _rejections(s).items()))
        return bound(reason, lambda r: F.struct(F.when(r.isNull(), s["own"]).alias("name"), r.alias("rejected")))

    return bound(_subject(title), told)


def company_from_headline(title: Column) -> Column:
    """The company that a headline says raises, launches or lists; null where there is none."""
    return headline_subject(title)["name"]


def discovery_headline(title: Column, snippet: Column | None = None) -> Column:
    """struct(name, round, amount, valuation) of a headline that may name a company not yet known; null for others."""
    both = F.struct(parse_fundraise(title, snippet).alias("f"), company_from_headline(title).alias("name"))

    def told(x: Column) -> Column:
        f = x["f"]
        ok = F.coalesce(f["round"], f["amount"].cast("string")).isNotNull() & ~title.rlike(ROUNDUP) & ~title.rlike(RESULTS) & x["name"].isNotNull()
        return F.when(ok, F.struct(x["name"].alias("name"), f["round"].alias("round"), f["amount"].alias("amount"), f["valuation"].alias("valuation")))

    return bound(both, told)


def _person(s: Column) -> Column:
    words = F.split(s, " ")
    n = F.size(words)
    titles = F.size(F.filter(words, lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "").isin(*TITLE_WORDS)))
    shaped = F.forall(F.transform(words, lambda w, i: ((i > 0) & w.rlike(re2(PARTICLE))) | w.rlike(re2(r"^[A-Z]\.?$")) | w.rlike(re2(NAME_WORD))), lambda ok: ok)
    other = F.lower(s).isin(*NO_PERSON) | s.rlike(re2(r"\d|@|https?:|&|\||,")) | s.rlike(re2(FIRM_WORDS)) | s.rlike(re2(INSTITUTION)) | s.rlike(re2(HONORIFIC))
    few = F.when(n <= 2, titles == 0).otherwise(titles < n - 1)
    return F.coalesce(F.length(s).between(5, 42) & ~other & n.between(2, 4) & few & shaped, F.lit(False))


def person_name(raw: Column) -> Column:
    """Whether a text has the shape of a person's name: two to four capitalised words, few of them words of a title."""
    return bound(F.trim(F.regexp_replace(raw, re2(r"\s+"), " ")), _person)


def company_name(raw: Column) -> Column:
    """Whether a text found on a page may be a company's name, and no heading, link or address."""
    s = F.trim(raw)
    n = F.size(F.split(s, re2(r"\s+")))
    sentence = s.rlike(re2(r"[.!?]$")) & (n > 2)
    return F.coalesce(F.length(s).between(2, 48) & (n <= 5) & ~F.lower(s).isin(*PAGE_CHROME) & ~_any(s, NO_COMPANY_NAME) & ~sentence & s.rlike(re2("(?i)[a-z]")), F.lit(False))


def entity_name(name: Column) -> Column:
    """Whether a name is a firm's rather than a person's, by its legal form."""
    return F.trim(name).rlike(re2(ENTITY_END)) | name.rlike(re2(ENTITY_WORD))


def plausible_participant(company: Column, person: Column, event: Column) -> Column:
    c = F.trim(company)
    fold = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    return F.length(c).between(2, 90) & ~c.rlike(NO_PARTICIPANT) & (fold(c) != fold(event)) & (F.coalesce(person, F.lit("")).isin("") | person_name(person))


def us_state(v: Column) -> Column:
    return F.coalesce(F.upper(F.trim(v)).isin(*US_STATES), F.lit(False))


def abroad(location: Column) -> Column:
    """Whether a job is outside the US: places known to be, without a US word or state; what is only remote tells nothing."""
    s = F.trim(location)
    vague = s.rlike(ANYWHERE) & ~s.rlike("[,-]")
    return F.coalesce(~s.rlike(US_WORDS) & ~s.rlike(US_CODES) & ~vague & s.rlike(ABROAD), F.lit(False))


def in_apac(location: Column) -> Column:
    return F.coalesce(location.rlike(APAC), F.lit(False))


def first_asian_site(sponsor: Column, countries: Column) -> Column:
    """Whether a sponsor from elsewhere has Singapore as its only Asian country."""
    asian = F.array_intersect(countries, F.array(*(F.lit(c) for c in ASIAN)))
    return ~F.coalesce(sponsor, F.lit("")).rlike(LOCAL_SPONSOR) & (asian == F.array(F.lit("Singapore")))


def wrapped_url(url: Column) -> Column:
    """Whether an address is a long redirect of a news search, which nobody can read."""
    return url.rlike(r"(?i)^https?:\/\/(?:[\w-]+\.)*news\.google\.com\/") & (F.length(url) > 120)


def export_controlled(sectors: Column) -> Column:
    return F.coalesce(F.arrays_overlap(sectors, F.array(*(F.lit(s) for s in EXPORT_CONTROLLED))), F.lit(False))


def bot_challenge(body: Column) -> Column:
    """Whether a page asks the reader to prove that it is no robot; feeds and very long bodies don't."""
    return F.coalesce((F.length(body).between(1, 200_000)) & ~body.rlike(r"(?i)<(rss|feed|channel)[\s>]") & body.rlike(BOT_CHALLENGE), F.lit(False))
