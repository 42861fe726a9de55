"""Where a company's signal is placed in a weekly digest, and in what order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlens.functions.money import parse_fundraise

# A placement's thresholds, caps and ranks.
CAPS = {"worth_a_conversation": 25, "new_on_the_radar": 25, "who_we_know": 15}
CORE_ROUNDS = ("series_a", "series_b", "series_a_ext", "series_b_ext")
LATE_ROUNDS = (
    "series_c", "series_c_ext", "series_d", "series_e", "series_f", "series_g", "series_h", "series_i", "series_j", "series_k",
    "series_l", "series_d_ext", "series_e_ext", "series_f_ext", "series_g_ext", "series_h_ext", "series_i_ext", "series_j_ext",
    "series_k_ext", "series_l_ext", "growth", "late", "ipo", "strategic", "multiple",
)
PRIORITY = {"high": 3, "medium": 2, "low": 1}

_top = F.greatest


def priority_score(band: Column) -> Column:
    return F.coalesce(*(F.when(band == k, v) for k, v in PRIORITY.items()), F.lit(0))


def early_stage(news: Column | None = None) -> Column:
    """Over columns round, valuation_usd, round_usd, cluster_size: young enough to be a find. What this week's headline says (``news``) goes before what is stored."""
    told = lambda field, column: F.col(column) if news is None else F.coalesce(news[field], F.col(column))
    r, valuation, amount = F.lower(F.coalesce(told("round", "round"), F.lit(""))), told("valuation", "valuation_usd"), told("amount", "round_usd")
    return F.coalesce(
        F.when(r.isin(*LATE_ROUNDS), F.lit(False)).when(valuation > 5e9, F.lit(False)).when(r.isin(*CORE_ROUNDS), F.lit(True))
        .when(r.isin("seed", "launch"), F.col("cluster_size") >= 3).otherwise(amount <= 150e6),
        F.lit(False),
    )


def freshness(asof: Column) -> Column:
    days = F.floor((F.unix_timestamp(asof) - F.unix_timestamp("published_at")) / 86400)
    return F.when(F.col("published_at").isNull(), 10).otherwise(F.greatest(F.lit(0), 30 - days))


def place(signals: DataFrame, asof: Column, title: str | None = None) -> DataFrame:
    """One row per placed signal: its columns, section, rank and position (from 1 in each section).

    ``signals`` has item_id, company_id, expansion, momentum, partnership, signal_type, priority, fit,
    familiarity, published_at, cluster_size, round, valuation_usd, round_usd, hq. A signal is a discovery (by tier)
    or about a company already known; of a company only its best signal counts in each of the two; what is above a
    section's cap is omitted. Signals of priority without a trigger are to be watched, and one that
    was cut is explored, of a kind not yet shown if there is one. Ties go to the smaller item id. With ``title`` the
    headline's own round, valuation and amount say how young a company is.
    """
    trigger, p = _top("expansion", "partnership"), priority_score(F.col("priority"))
    known = F.coalesce(F.col("familiarity") == "known", F.lit(False))
    assessed = F.coalesce(F.col("priority") != "unknown", F.lit(False))
    low = F.coalesce(F.col("priority") == "low", F.lit(False)) | F.coalesce(F.col("fit") == "low", F.lit(False))
    qualifies = (trigger >= 3) & (F.col("momentum") >= 2)
    discovery = (
        F.col("company_id").isNotNull() & ~F.coalesce(F.lower("hq").rlike(r"\bsingapore\b"), F.lit(False)) & ~known
        & (F.col("signal_type") != "noise") & (qualifies | ((p >= 2) & (trigger >= 3)))
    )
    tier = F.when(~assessed, "awaiting_assessment").when(low, "low_fit").when(early_stage(None if title is None else parse_fundraise(F.col(title))) & (trigger >= 2), "new_on_the_radar").otherwise("worth_a_conversation")
    cluster = F.col("cluster_size")
    rank = (
        F.when(F.col("priority").isNull(), 1.5).otherwise(p) * 1_000_000 + priority_score(F.col("fit")) * 100_000 + trigger * 10_000
        + (F.col("expansion") + F.col("partnership")) * 1_500 - F.when(F.col("familiarity") == "in_conversation", 5_000).otherwise(0)
        + F.col("momentum") * 1_000 + F.when(cluster >= 10, 200).when(cluster >= 3, 100).otherwise(0) + freshness(asof)
    )
    trending = F.col("momentum") * 1_000_000 + F.least(cluster, F.lit(30)) * 10_000 + trigger * 1_000 + p * 100 + freshness(asof)
    base = signals.withColumns(
        {"_trigger": trigger, "_p": p, "_found": discovery, "_known": known & ((F.col("momentum") >= 2) | (trigger >= 2)), "_rank": rank.cast("double"), "_trend": trending.cast("double")}
    )
    pool = base.where("_found").withColumn("section", tier).withColumn("rank", F.col("_rank"))
    pool = pool.unionByName(base.where("_known").withColumn("section", F.lit("who_we_know")).withColumn("rank", F.col("_trend")))
    # The best signal of a company in each of the two pools; signals of no company all count.
    one = Window.partitionBy("_known", "company_id", F.when(F.col("company_id").isNull(), F.col("item_id"))).orderBy(F.desc("rank"), "item_id")
    pool = pool.withColumn("_nth", F.when(F.col("company_id").isNull(), 1).otherwise(F.row_number().over(one))).where("_nth = 1").drop("_nth")
    cap = F.coalesce(*(F.when(F.col("section") == k, v) for k, v in CAPS.items()), F.lit(2**31 - 1))
    ranked = pool.withColumn("position", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("rank"), "item_id"))).withColumn("_over", F.col("position") > cap)
    shown = ranked.where("not _over")
    omitted = ranked.where("_over").withColumn("section", F.lit("omitted"))
    rest = base.join(shown.select("item_id").distinct(), "item_id", "left_anti")
    watch = rest.where("_p >= 2 and _trigger < 2").withColumn("section", F.lit("to_watch")).withColumn("rank", F.col("_rank"))
    seen = shown.where(F.col("section").isin("worth_a_conversation", "new_on_the_radar", "who_we_know")).select("signal_type").distinct().withColumn("_seen", F.lit(1))
    explore = (
        rest.where("_trigger between 1 and 2").join(F.broadcast(seen), "signal_type", "left").withColumn("rank", F.col("_trend"))
        .orderBy(F.asc_nulls_first("_seen"), F.desc("rank"), "item_id").limit(1).withColumn("section", F.lit("exploration")).drop("_seen")
    )
    parts = [x.drop("position", "_over") for x in (omitted, watch, explore)]
    late = parts[0]
    for x in parts[1:]:
        late = late.unionByName(x.select(*late.columns))
    late = late.withColumn("position", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("rank"), "item_id")))
    out = shown.drop("_over").unionByName(late)
    return out.drop("_trigger", "_p", "_found", "_known", "_rank", "_trend")


def detail(position: Column) -> Column:
    """full for a section's first three, brief for the first ten, then a line."""
    return F.when(position <= 3, "full").when(position <= 10, "brief").otherwise("line")
