"""What is due next, what has arrived, and what evidence holds: small rules over work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlens.functions.gates import discovery_headline
from harborlens.functions.text import normalise_company


def arrived_since(published: Column, fetched: Column, previous: Column, floor: Column) -> Column:
    """Whether an item came after the previous run, which counts from ``floor`` at the earliest."""
    return F.coalesce(F.coalesce(published, fetched) >= F.greatest(F.coalesce(previous, floor), floor), F.lit(False))


def unseen(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys, null ones compared like others, aren't in ``known``; each once."""
    held = known.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return new.dropDuplicates(keys).join(held, same, "left_anti")


def discovery_candidates(headlines: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """(name, round, amount, valuation, item_id, title, source, url) of companies that headlines (item_id, title, snippet, source, url, and what ``order`` names) tell of and nobody knows.

    ``known`` holds names in the form of ``normalise_company``, those of excluded companies and aliases among them. Of several headlines on one name, whatever its case, the first by ``order`` counts.
    """
    found = headlines.withColumn("_d", discovery_headline(F.col("title"), F.col("snippet"))).where("_d is not null")
    found = found.withColumns({"_key": normalise_company(F.col("_d.name")), "_name": F.lower("_d.name")})
    new = found.join(known.select(F.col("name").alias("_known")).distinct(), F.col("_key") == F.col("_known"), "left_anti")
    first = F.min_by(F.struct("_d.name", "_d.round", "_d.amount", "_d.valuation", "item_id", "title", "source", "url"), F.struct(*order, "item_id"))
    return new.groupBy("_name").agg(first.alias("_f")).select("_f.*")


def rescore_queue(items: DataFrame, scores: DataFrame, version: str) -> DataFrame:
    """Items (item_id, cluster_id, status) that head their cluster, are kept, and have no score of the version (scores: item_id, rubric_version)."""
    done = scores.where(F.col("rubric_version") == version).select("item_id").distinct()
    return items.where((F.col("status") == "kept") & (F.col("cluster_id").isNull() | (F.col("cluster_id") == F.col("item_id")))).join(done, "item_id", "left_anti")


def people_queue(roles: DataFrame, people: DataFrame, signals: DataFrame, least: int = 2) -> DataFrame:
    """(person_id, company_id): people without a title at companies with a signal (expansion or partnership) of ``least`` or more, each pair once."""
    strong = signals.where(F.greatest("expansion", "partnership") >= least).select("company_id").distinct()
    return roles.select("person_id", "company_id").distinct().join(people.where("title is null").select("person_id"), "person_id", "left_semi").join(strong, "company_id", "left_semi").select("person_id", "company_id")


def proven_email(email: Column, source: Column, offered: Column, corpus: Column) -> Column:
    """An address only if it is well formed, its source was among those offered, and it stands in what these say."""
    ok = email.rlike(r"(?i)^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$") & F.array_contains(offered, source) & F.contains(F.lower(corpus), F.lower(email))
    return F.when(F.coalesce(ok, F.lit(False)), F.lower(email))


def proven_phone(phone: Column, corpus: Column, least: int = 7) -> Column:
    """A number only if its digits, seven or more, stand among the digits of what the sources say."""
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    return F.when((F.length(digits(phone)) >= least) & F.contains(digits(corpus), digits(phone)), phone)


def team_page(hits: DataFrame, key: str, domain: str) -> DataFrame:
    """(key, url): of search hits (url, rank) on a company's domain that are no job pages, the one whose path says team or people first of all."""
    path = F.lower(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)?", 1))
    score = F.when(path.rlike(r"/(team|our-team|people|leadership)\b"), 3).when(path.rlike(r"/(about|company|who-we-are)\b"), 2).when(path.isin("", "/"), 1).otherwise(0)
    own = F.regexp_replace(F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)), r"^www\.", "")
    fits = ((own == F.col(domain)) | F.endswith(own, F.concat(F.lit("."), F.col(domain)))) & ~path.rlike(r"/(jobs|careers)\b")
    return hits.where(fits).groupBy(key).agg(F.min_by("url", F.struct(-score, "rank")).alias("url"))


def url_year(url: Column, year: Column) -> Column:
    """The latest plausible year in an address: from the year before to three years after."""
    years = F.transform(F.regexp_extract_all(url, F.lit(r"(20\d\d)"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: y.between(year - 1, year + 3)))


def run_ledger(events: DataFrame, stage: str, kind: str, started: str) -> DataFrame:
    """(stage, started, finished, counts): a row per stage with a map of what it counted."""
    each = events.groupBy(stage, kind).agg(F.count(F.lit(1)).alias("n"), F.min(started).alias("first"), F.max(started).alias("last"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n"))))
    return each.groupBy(stage).agg(F.min("first").alias("started"), F.max("last").alias("finished"), counts.alias("counts"))


def masked(rows: DataFrame, internal: dict[str, object], guest: bool) -> DataFrame:
    """``rows`` as a reader may see them: for a guest, internal columns hold their neutral value."""
    return rows.withColumns({c: F.lit(v).cast(rows.schema[c].dataType) for c, v in internal.items()}) if guest else rows
