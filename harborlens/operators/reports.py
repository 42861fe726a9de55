"""Lists and findings for readers: contacts, reasons, watched companies, health, queues, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlens.functions.derive import points
from harborlens.operators.shared import checkpointed

# Words of a page's headings, which no person's name holds.
NO_CONTACT = (
    r"(?i)(cloud|aws|azure|foundry|powered by|claude|api|platform|inc\.?$|llc$)",
    r"(?i)\b(transformation|expansion|leadership|partnership|innovation|solutions|systems|services|strategy|growth|results|overview|highlights|mission|vision|values|careers|investor"
    r"|technolog|enterprise|platform|research|development|operations|excellence|commitment|sustainability|governance|diversity|culture|community|policy|cookie|privacy|terms)\b",
)
# Words that don't tell one point from another.
POINT_STOP = ("the", "a", "an", "of", "in", "to", "for", "at", "on", "and", "or", "with", "as", "is", "are", "no", "not", "its", "it", "this", "that", "by", "from")
SEVERITY = ("blocked", "down", "zero_volume", "stale", "ok")


def contacts(roles: DataFrame, people: DataFrame, companies: DataFrame, most: int = 4) -> DataFrame:
    """(company_id, contacts): up to ``most`` people of each company, those who can be reached first.

    Over roles (company_id, person_id), people (person_id, name, email, profile) and companies (company_id, company_name). A person
    with several roles counts once; names that look like headings, or are the company's, are left out. The first ``most`` by id are taken, and
    these are ordered by an email, a profile or neither, and then by name.
    """
    once = roles.select("company_id", "person_id").distinct()
    named = people.where(F.col("name").rlike("^[A-Z][a-z]+ [A-Z]") & ~F.col("name").rlike(NO_CONTACT[0]) & ~F.col("name").rlike(NO_CONTACT[1]))
    met = once.join(named, "person_id").join(companies, "company_id").where("name <> company_name")
    first = Window.partitionBy("company_id").orderBy("person_id")
    rank = F.when(F.col("email").isNotNull(), 0).when(F.col("profile").isNotNull(), 1).otherwise(2)
    kept = met.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).withColumn("rank", rank)
    one = F.struct("rank", "name", "person_id", "email", "profile")
    return kept.groupBy("company_id").agg(F.array_sort(F.collect_list(one)).alias("contacts"))


def _signature(point: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(point), "[^a-z0-9$%. ]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*POINT_STOP)))


def why_now(items: DataFrame, key: str, most: int = 4) -> DataFrame:
    """(key, points, mixed): up to ``most`` points for each key that differ, the featured item's first, then those of job boards, then by date.

    Over items (key, item_id, why, job_board, published_at, featured). A point whose significant words are covered to 0.6 by those of one taken before is
    left out. Each round takes every key's first point that is left, by a map-side minimum, and leaves out what it covers; so a key's points are never in one
    row or task together. ``mixed`` says whether points of job boards and others stand together.
    """
    rank = F.when(F.col("featured"), 0).when(F.col("job_board"), 1).otherwise(2)
    when = -F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(0))
    told = items.select(key, rank.alias("rank"), F.when(F.col("featured"), F.lit(0).cast("long")).otherwise(when).alias("at"), "item_id", "job_board", F.posexplode(points(F.col("why"))).alias("pos", "text"))
    left = checkpointed(told.withColumn("words", _signature(F.col("text"))))
    keys, taken = left.select(key).distinct(), None
    for n in range(most):
        first = checkpointed(left.groupBy(key).agg(F.min(F.struct("rank", "at", "item_id", "pos", "text", "job_board", "words")).alias("_f")))
        part = first.select(key, F.lit(n).alias("n"), "_f.text", "_f.item_id", "_f.job_board")
        taken = part if taken is None else taken.unionByName(part)
        same = F.struct("rank", "at", "item_id", "pos", "text") == F.struct("_f.rank", "_f.at", "_f.item_id", "_f.pos", "_f.text")
        least = F.least(F.size("words"), F.size("_f.words"))
        like = (least > 0) & (F.size(F.array_intersect("words", "_f.words")) >= 0.6 * least)
        if n + 1 < most:
            left = checkpointed(left.join(first, key).where(~same & ~like).drop("_f"))
    found = taken.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "text", "item_id", "job_board"))).alias("p"))
    found = keys.join(found, key, "left")
    mixed = F.exists("p", lambda x: x["job_board"]) & F.exists("p", lambda x: ~x["job_board"])
    return found.select(key, F.transform("p", lambda x: F.struct(x["text"].alias("text"), x["item_id"].alias("item_id"))).alias("points"), mixed.alias("mixed"))


def monitored(watches: DataFrame, signals: DataFrame) -> DataFrame:
    """(company_id, watchers, newest, signal_id, signal_at): companies that somebody watches, each once, with its latest signal.

    Over watches (company_id, watcher, added_at, removed_at) and signals (company_id, signal_id, signal_at).
    """
    open_ = watches.where("removed_at is null").groupBy("company_id").agg(F.array_sort(F.collect_set("watcher")).alias("watchers"), F.max("added_at").alias("newest"))
    last = signals.groupBy("company_id").agg(F.max(F.struct("signal_at", "signal_id")).alias("s"))
    return open_.join(last, "company_id", "left").select("company_id", "watchers", "newest", F.col("s.signal_id").alias("signal_id"), F.col("s.signal_at").alias("signal_at"))


def source_status(runs: DataFrame, before: DataFrame, asof: Column, stale_days: int = 30) -> DataFrame:
    """(source, status, last_success): each source's health after a run.

    Over runs (source, n, error, reached, blocked, newest) and before (source, last_success). Blocked comes before down (an error, not reached), no volume, stale and ok;
    the last success only moves when the source was reached.
    """
    failed = F.col("error").isNotNull() & ~F.col("reached")
    stale = F.col("newest") < asof - F.make_dt_interval(F.lit(stale_days))
    status = F.when(F.col("blocked"), SEVERITY[0]).when(failed, SEVERITY[1]).when(F.col("n") == 0, SEVERITY[2]).when(stale, SEVERITY[3]).otherwise(SEVERITY[4])
    return runs.join(before, "source", "left").select("source", status.alias("status"), F.when(failed, F.col("last_success")).otherwise(asof).alias("last_success"))


def without_pending(rows: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """``rows`` without those that an open review (key, hide, resolved_at) hides."""
    return rows.join(reviews.where("hide and resolved_at is null").select(key).distinct(), key, "left_anti")


def follow_ups(wanted: DataFrame, opened: DataFrame, key: str) -> DataFrame:
    """Those of ``wanted`` for whom nothing is open yet (opened: key, status), each once."""
    return wanted.dropDuplicates([key]).join(opened.where("status is null or status not in ('closed', 'dropped')").select(key), key, "left_anti")


def within_window(attempts: DataFrame, at: str, asof: Column, minutes: int) -> DataFrame:
    """Attempts that a sliding window still counts; older ones are pruned."""
    return attempts.where(F.col(at) > asof - F.make_dt_interval(mins=F.lit(minutes)))


def spent_until_halt(calls: DataFrame, key: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Calls with what was spent before each by its key, and whether it was still allowed: a key halts once its budget is spent."""
    before = F.coalesce(F.sum(cost).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return calls.withColumn("spent", before).withColumn("allowed", F.col("spent") < budget)


def demoted_points(points: Column, most: int = 4) -> Column:
    """Points (struct with job_board) with those of job boards behind the others, both in their order, cut to ``most``."""
    return F.slice(F.concat(F.filter(points, lambda p: ~p["job_board"]), F.filter(points, lambda p: p["job_board"])), 1, most)


def hiring_claims(execs: Column, singapore: Column, apac: Column, before: Column, now: Column) -> Column:
    """What may be said of a company's postings: executives, roles in Singapore or else two or more in the region, and a clear rise."""
    n = lambda c, text: F.concat(c.cast("string"), F.lit(text))
    rise = (before >= 20) & (now - before >= 5) & ((now - before) / before > 0.25)
    return F.array_compact(
        F.array(F.when(execs > 0, n(execs, " executive roles")), F.when(singapore > 0, n(singapore, " roles in Singapore")).when(apac >= 2, n(apac, " roles in APAC")), F.when(rise, n(now - before, " roles more than before")))
    )


def coverage_line(seen: Column, kept: Column, shown: Column) -> Column:
    f = lambda c: F.format_number(c, 0)
    return F.concat(f(seen), F.lit(" items read, "), f(kept), F.lit(" kept, "), f(shown), F.lit(" shown"))


def placed_once(sections: list[DataFrame], key: str) -> DataFrame:
    """Rows of all sections, each key only in the first section that has it, with the section's number."""
    rows = sections[0].withColumn("section", F.lit(0))
    for i, s in enumerate(sections[1:], 1):
        rows = rows.unionByName(s.withColumn("section", F.lit(i)))
    return rows.groupBy(key).agg(F.min("section").alias("section"))


def resume_point(stages: DataFrame, runs: DataFrame, asof: Column, hours: int = 18) -> DataFrame:
    """The first stage (stage, pos) without a clean finish (runs: stage, started_at, finished_at, error) in the last ``hours``."""
    clean = runs.where(F.col("finished_at").isNotNull() & F.col("error").isNull() & (F.col("started_at") > asof - F.make_dt_interval(hours=F.lit(hours))))
    return stages.join(clean.select("stage").distinct(), "stage", "left_anti").orderBy("pos").limit(1)


def health_findings(stages: DataFrame, runs: DataFrame, sources: DataFrame, queue: DataFrame, asof: Column, excused: bool = False, stranded_minutes: int = 45, down_days: int = 3, queue_limit: int = 500) -> DataFrame:
    """(severity, code, subject): what is wrong, as rows.

    Runs left open, sources down for days, stages without a clean finish (excused when models have no allowance; more than three unexcused are an
    error), and a queue (status) that has grown long. Over stages (stage, needs_model), runs (stage, started_at, finished_at, error), sources (source, status, last_success).
    """
    finding = lambda df, severity, code, subject: df.select((F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(code).alias("code"), subject.cast("string").alias("subject"))
    stranded = runs.where(F.col("finished_at").isNull() & (F.col("started_at") < asof - F.make_dt_interval(mins=F.lit(stranded_minutes))))
    down = sources.where((F.col("status") == "down") & (F.col("last_success") < asof - F.make_dt_interval(F.lit(down_days))))
    clean = runs.where(F.col("finished_at").isNotNull() & F.col("error").isNull() & (F.col("started_at") > asof - F.make_dt_interval(hours=F.lit(18))))
    missing = stages.join(clean.select("stage").distinct(), "stage", "left_anti").where(~(F.col("needs_model") & F.lit(excused)))
    missing = missing.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))  # stages are few by nature
    waiting = queue.where("status = 'fetched'").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > queue_limit)
    return (
        finding(stranded, "error", "stranded-run", F.col("stage")).unionByName(finding(down, "warn", "source-down", F.col("source")))
        .unionByName(finding(missing, F.when(F.col("_n") > 3, "error").otherwise("warn"), "missing-stage", F.col("stage"))).unionByName(finding(waiting, "warn", "queue", F.col("n")))
    )


def registry_order(strength: Column) -> Column:
    """Where a registry match stands in a list: sure ones first."""
    return F.when(strength == "confirmed", 0).when(strength == "probable", 1).otherwise(2)


def guarded_out(rows: DataFrame, guard: DataFrame, name: str) -> DataFrame:
    """Rows whose normalised name is neither an excluded company's (guard: name, aliases) nor one of its aliases."""
    held = guard.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))).alias("_held")).distinct()
    return rows.join(held, F.col(name) == F.col("_held"), "left_anti")
