"""The weekly relation that pages and digests are read from, the cascade that items go through before it, and lists beside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlens.functions.dates import week_of
from harborlens.functions.filters import blocked_domain, blocked_source, junk_reason, mentions
from harborlens.functions.gates import recency_reason
from harborlens.operators.reports import contacts
from harborlens.operators.shared import spread


def weeks_of_items(items: DataFrame, late_days: int = 5) -> DataFrame:
    """(company_id, week_of): the weeks in which a company did something, each once.

    An item (company_id, status, published_at, fetched_at) that was kept belongs to the week in which it was published, and to that in which it was
    found if it wasn't published more than ``late_days`` before that week began.
    """
    found = F.when(F.col("published_at").isNull() | (F.to_date("published_at") >= F.date_sub(week_of(F.col("fetched_at")), late_days)), week_of(F.col("fetched_at")))
    weeks = F.explode(F.array_compact(F.array(week_of(F.col("published_at")), found)))
    return items.where((F.col("status") == "kept") & F.col("company_id").isNotNull()).select("company_id", weeks.alias("week_of")).distinct()


def open_opportunities(opportunities: DataFrame) -> DataFrame:
    """(company_id, opportunity_owner, opportunity_since): the oldest of a company's opportunities (company_id, owner, status, created_at, opportunity_id) that is neither closed nor dropped."""
    live = opportunities.where(~F.col("status").isin("closed", "dropped"))
    first = F.min(F.struct("created_at", "opportunity_id", "owner"))
    return live.groupBy("company_id").agg(first.alias("_o")).select("company_id", F.col("_o.owner").alias("opportunity_owner"), F.col("_o.created_at").alias("opportunity_since"))


def weekly_base(
    signals: DataFrame, companies: DataFrame, items: DataFrame, assessments: DataFrame, path_reviews: DataFrame, roles: DataFrame, people: DataFrame,
    opportunities: DataFrame, reviews: DataFrame, dismissals: DataFrame, version: str, week: Column | str | None = None, hidden_sectors: Sequence[str] = (),
) -> DataFrame:
    """One row per company and week with a signal of ``version``: the company, its representative item, scores, last assessment, size of the story's cluster, note of a confirmed warm path, contacts and opportunity.

    ``week`` is a week's Saturday, ``"latest"`` for the last week with such a signal, or None for all weeks at once, as the archive shows them.

    Rows are left out of companies that are out of scope, were discovered in a portfolio, are only of ``hidden_sectors``, are hidden by an open review, or were
    dismissed (for good, or until something newer than the dismissal), and of weeks in which the company did nothing (see ``weeks_of_items``).

    signals: company_id, week_of, version, item_id, expansion, momentum, partnership. companies: company_id, company_name, sectors, scope_status, discovered_via. items: item_id, company_id, status,
    cluster_id, title, source, published_at, fetched_at. assessments: company_id, assessed_at, priority, fit. path_reviews: company_id, status, do_not_use, note, confirmed_at. roles: company_id,
    person_id. people: person_id, name, email, profile. opportunities: as in ``open_opportunities``. reviews: company_id, hide, resolved_at. dismissals: company_id, permanent, dismissed_at.

    What a row needs of a table is brought down to one row per company or item first, and each is one join; the latest week alone comes to the driver.
    """
    own = signals.where(F.col("version") == version)
    if isinstance(week, str) and week == "latest":
        week = F.lit(own.agg(F.max("week_of")).first()[0])
    if week is not None:
        own = own.where(F.col("week_of") == week)
    via, scope = F.coalesce("discovered_via", F.lit("")), F.coalesce("scope_status", F.lit("unknown"))
    sectors = F.coalesce("sectors", F.array().cast("array<string>"))
    shown = companies.where((via != "portfolio") & (scope != "out_of_scope") & ((F.size(sectors) == 0) | F.exists(sectors, lambda s: ~s.isin(*hidden_sectors))))
    hidden = reviews.where(F.col("hide") & F.col("resolved_at").isNull()).select("company_id").distinct()
    gone = dismissals.groupBy("company_id").agg(F.bool_or("permanent").alias("_for_good"), F.max("dismissed_at").alias("_until"))
    last = assessments.groupBy("company_id").agg(F.max(F.struct("assessed_at", "priority", "fit")).alias("_a"))
    confirmed = path_reviews.where((F.col("status") == "confirmed") & ~F.coalesce("do_not_use", F.lit(False)))
    paths = confirmed.groupBy("company_id").agg(F.max(F.struct("confirmed_at", "note"))["note"].alias("warm_path"))
    sizes = items.where("cluster_id is not null").groupBy(F.col("cluster_id").alias("_cluster")).agg(F.count(F.lit(1)).alias("_size"))
    reach = contacts(roles, people, companies.select("company_id", "company_name"))
    stories = items.select("item_id", "title", "source", "published_at")
    rows = own.join(weeks_of_items(items), ["company_id", "week_of"], "left_semi").join(shown, "company_id").join(hidden, "company_id", "left_anti").join(stories, "item_id")
    rows = rows.join(gone, "company_id", "left").where("not coalesce(_for_good, false) and (_until is null or published_at > _until)").drop("_for_good", "_until")
    for side in (last, paths, reach, open_opportunities(opportunities)):
        rows = rows.join(side, "company_id", "left")
    rows = rows.join(sizes, F.col("item_id") == F.col("_cluster"), "left").withColumn("cluster_size", F.coalesce("_size", F.lit(0)))
    return rows.withColumns({"priority": F.col("_a.priority"), "fit": F.col("_a.fit"), "assessed_at": F.col("_a.assessed_at")}).drop("_a", "_cluster", "_size")


def filter_cascade(items: DataFrame, asof: Column, days: int = 30) -> DataFrame:
    """``items`` with status (kept, dropped or context) and dropped_reason: the first rule that drops an item names the reason.

    Over items with url, source, title, snippet, company_id, terms (the company's names; null or none: any text will do), source_type and published_at. In order: blocked domain, blocked
    publisher, junk headline; a company's item that doesn't name it (job boards' excepted), an item without a company (context excepted); no date, or older than ``days``
    (job boards' excepted). Context items that pass are set aside.
    """
    board, context = (F.coalesce(F.col("source_type") == k, F.lit(False)) for k in ("ats", "context"))
    named = lambda kind, found: F.when(found.isNotNull(), F.concat(F.lit(f"{kind}:"), found))
    terms = F.coalesce("terms", F.array().cast("array<string>"))
    told = mentions(F.concat_ws(" ", "title", "snippet"), terms)
    reason = F.coalesce(
        named("blocked_domain", blocked_domain(F.col("url"))), named("blocked_source", blocked_source(F.col("source"))), named("junk_pattern", junk_reason(F.col("title"))),
        F.when(F.col("company_id").isNotNull() & ~board & ~told, "company_mismatch"), F.when(F.col("company_id").isNull() & ~context, "no_company_match"), recency_reason(F.col("published_at"), asof, days, board),
    )
    rows = items.withColumn("dropped_reason", reason)
    return rows.withColumn("status", F.when(F.col("dropped_reason").isNotNull(), "dropped").when(context, "context").otherwise("kept"))


def opportunity_list(opportunities: DataFrame, companies: DataFrame, unset: str = "—") -> DataFrame:
    """Open opportunities with their company's name, to be shown by due date, undated ones last."""
    live = opportunities.where(~F.col("status").isin("closed", "dropped")).join(companies.select("company_id", "company_name"), "company_id")
    return live.select("opportunity_id", "company_id", "company_name", F.coalesce("owner", F.lit("Unassigned")).alias("owner"), "status", F.coalesce("next_action", F.lit(unset)).alias("next_action"), "due_date")


def dismissal_list(dismissals: DataFrame, companies: DataFrame, users: DataFrame) -> DataFrame:
    """Every dismissal with its company's name and place, and who made it (Someone, if nobody knows)."""
    rows = dismissals.join(companies.select("company_id", "company_name", "city", "state"), "company_id").join(users.select("user_id", "user_name"), "user_id", "left")
    hq = F.coalesce(F.nullif(F.concat_ws(", ", F.nullif(F.col("city"), F.lit("")), F.nullif(F.col("state"), F.lit(""))), F.lit("")), F.lit("Unknown"))
    return rows.select("dismissal_id", "company_id", "company_name", hq.alias("hq"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"), "dismissed_at", F.coalesce("user_name", F.lit("Someone")).alias("by_name"))


def matching_propositions(companies: DataFrame, propositions: DataFrame, everywhere: str = "cross_sector") -> DataFrame:
    """(company_id, proposition_id): the propositions (proposition_id, sectors) that share a sector with a company (company_id, axes), and those for every sector.

    Both sides are joined on the single sector, each pair told once; a company without a sector gets those for every sector.
    """
    # Dealt by company, so that no task holds the pairs of all of them to tell each once.
    asked = spread(companies, ["company_id"]).select("company_id", F.explode(F.array_union(F.coalesce("axes", F.array().cast("array<string>")), F.array(F.lit(everywhere)))).alias("sector"))
    held = propositions.select("proposition_id", F.explode(F.array_distinct("sectors")).alias("sector"))
    return asked.join(held, "sector").select("company_id", "proposition_id").distinct()


def in_place(hq: Column, geography: Column, sectors: Column, place: str | None = None, area: str = "west_coast", sector: str | None = None) -> Column:
    """A reader's choice of headquarters, area (``all``: any) and sector; what isn't chosen holds for every row."""
    out = F.lit(True) if area == "all" else F.coalesce(geography == area, F.lit(False))
    if place is not None:
        out = out & F.coalesce(hq == place, F.lit(False))
    return out if sector is None else out & F.coalesce(F.array_contains(sectors, sector), F.lit(False))


def work_targets(companies: DataFrame, done: DataFrame, version: str, force: bool = False, via: str | None = None) -> DataFrame:
    """Companies that the version hasn't been run for: all of them if ``force``, and only those found ``via`` a channel if one is named. Clauses that don't apply aren't in the plan."""
    rows = companies if via is None else companies.where(F.col("discovered_via") == via)
    return rows if force else rows.join(done.where(F.col("version") == version).select("company_id").distinct(), "company_id", "left_anti")


def known_word(c: Column, vocabulary: Sequence[str], other: str | None = None) -> Column:
    """A word of a vocabulary as it is, whatever its case and blanks; others become ``other``."""
    bare = F.lower(F.trim(c))
    return F.when(bare.isin(*vocabulary), bare).otherwise(F.lit(other))


def cap_day(started_at: Column) -> Column:
    """The UTC day on which a run started, which all its stages count their budget by, however long they run."""
    return F.to_date(F.to_utc_timestamp(started_at, F.current_timezone()))
