"""A company's own site among guessed addresses, and registries of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlens.functions.text import bound, fold_accents
from harborlens.operators.shared import shuffled

# Words that don't tell a company by, endings to try, and how many addresses are tried where each has to be fetched.
STOP = ("inc", "corp", "corporation", "llc", "ltd", "limited", "lp", "llp", "co", "company", "holdings", "group", "the", "pbc", "incorporated")
ENDINGS = ("com", "ai", "io", "co", "tech", "bio")
TRIED = 14
# Titles of dead pages, and what brokers of domains write.
DEAD = r"(?i)^(404|not found|page not found|domain (is )?for sale|buy this domain|coming soon|under construction)"
PARKED = r"(?i)(premium domains?|domain (is )?for sale|buy this domain|whois privacy|make an offer|this domain is available|godaddy|sedo|dan\.com|afternic|hugedomains|namecheap market)"


def _words(name: Column, least: int = 1) -> Column:
    return F.filter(F.split(F.regexp_replace(fold_accents(F.lower(name)), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: (F.length(w) >= least) & ~w.isin(*STOP))


def candidate_domains(name: Column, most: int | None = TRIED) -> Column:
    """Addresses that a company's name suggests, likeliest first: its words joined, the first two, the first, and all with hyphens, with each ending;
    the first ``most`` of them, or all with None."""

    def made(ws: Column) -> Column:
        stems = F.array(F.array_join(ws, ""), F.array_join(F.slice(ws, 1, 2), ""), F.get(ws, F.lit(0)), F.array_join(ws, "-"))
        stems = F.filter(F.array_distinct(stems), lambda s: F.length(s) >= 3)
        every = F.flatten(F.transform(stems, lambda s: F.array(*(F.concat(s, F.lit(f".{e}")) for e in ENDINGS))))
        return every if most is None else F.slice(every, 1, most)

    return bound(_words(name), made)


def site_verdict(name: Column, domain: Column, title: Column, description: Column, text: Column) -> Column:
    """verified, thin (verified, but the page says next to nothing), or why a page isn't the company's: dead, parked, empty, nameless, stem, partial.

    A name of several telling words (four letters or more) must have all of them on the page, or stand there in one piece; that one word occurs
    proves nothing, so a name of one word must open the address itself.
    """
    said = F.concat_ws(" ", title, description, F.substring(text, 1, 4000))
    facts = F.struct(fold_accents(F.lower(said)).alias("hay"), _words(name, 4).alias("tokens"), F.regexp_replace(F.regexp_replace(F.lower(domain), r"\.[a-z.]+$", ""), "[^a-z0-9]", "").alias("stem"))

    def told(f: Column) -> Column:
        word = F.array_join(f["tokens"], "")
        here = F.forall(f["tokens"], lambda t: F.contains(f["hay"], t)) | F.contains(F.regexp_replace(f["hay"], "[^a-z0-9]", ""), word)
        one = F.size(f["tokens"]) == 1
        ok = F.when(one, F.startswith(f["stem"], word)).otherwise(here)
        words = F.array_distinct(F.filter(F.split(F.lower(F.substring(text, 1, 4000)), r"\s+"), lambda w: F.length(w) > 3))
        thin = description.isNull() & (F.size(words) < 40)
        return (
            F.when(F.trim(F.coalesce(title, F.lit(""))).rlike(DEAD), "dead").when(F.concat_ws(" ", title, description, F.substring(text, 1, 800)).rlike(PARKED), "parked")
            .when(F.length(F.coalesce(text, F.lit(""))) < 120, "empty").when(F.size(f["tokens"]) == 0, "nameless").when(ok & thin, "thin").when(ok, "verified").when(one, "stem").otherwise("partial")
        )

    return bound(facts, told)


def resolved_sites(companies: DataFrame, pages: DataFrame) -> DataFrame:
    """(company, domain, verdict): of each company (company), the first of all guessed addresses whose page (domain, title, description, text) is its own; companies without one are left out."""
    tried = companies.select("company", F.posexplode(candidate_domains(F.col("company"), None)).alias("place", "domain"))
    met = tried.join(shuffled(pages), "domain").withColumn("verdict", site_verdict(F.col("company"), F.col("domain"), F.col("title"), F.col("description"), F.col("text")))
    own = met.where(F.col("verdict").isin("verified", "thin"))
    return own.groupBy("company").agg(F.min_by(F.struct("domain", "verdict"), "place").alias("_s")).select("company", "_s.domain", "_s.verdict")


def enabled_sources(registry: DataFrame, kinds: Sequence[str] = (), sectors: Sequence[str] = ()) -> DataFrame:
    """Sources (source, kind, enabled, sectors, url) that are on, of the ``kinds`` asked for, and for one of the ``sectors`` or for any; each address once, the first name by order."""
    rows = registry.where(F.coalesce("enabled", F.lit(True)) & (F.coalesce("url", F.lit("")) != ""))
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    if sectors:
        own = F.coalesce("sectors", F.array().cast("array<string>"))
        rows = rows.where((F.size(own) == 0) | F.arrays_overlap(own, F.array(*map(F.lit, sectors))))
    return rows.groupBy("url").agg(F.min(F.struct("source", "kind")).alias("_s")).select("_s.source", "_s.kind", "url")
