"""What the pages of an entity show, for all entities at once: bundles of child rows, sibling items, and the state of the queues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlens.operators.shared import parts_for, shuffled


@dataclass(frozen=True)
class Part:
    """A kind of child rows that a page lists: rows with the entity's key, the columns shown, and up to three numbers and a string to sort by (ascending, null
    last; the last of them must tell rows apart). ``most`` is how many a page shows; ``counted`` are all rows, where ``rows`` are no more than those shown."""

    name: str
    rows: DataFrame
    fields: Sequence[str]
    numbers: Sequence[Column]
    then: Column | None = None
    most: int = 400
    counted: DataFrame | None = None

    def listed(self, key: str) -> DataFrame:
        """(_key, <name>): the rows that a page shows, as one array. No task sends more than ``most`` rows of a key to the window that numbers them."""
        numbers = {f"_n{i}": F.coalesce(n.cast("double"), F.lit(float("inf"))) for i, n in enumerate(self.numbers)}
        order = numbers if self.then is None else numbers | {"_s": F.coalesce(self.then.cast("string"), F.lit(""))}
        own = F.when(F.spark_partition_id() >= 0, F.col(key)).alias("_key")  # a constant key would be folded away, and with it the cut in each task
        rows = self.rows.where(F.col(key).isNotNull()).select(own, *(c.alias(n) for n, c in order.items()), F.struct(*self.fields).alias("_row"))
        shown = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where(F.col("_n") <= self.most)
        return shown.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_row"))), lambda x: x["_row"]).alias(self.name))


def newest_first(time: Column) -> Column:
    """A number by which later times sort first, and null ones last."""
    return -F.unix_micros(time.cast("timestamp")).cast("double")


def bundles(entities: DataFrame, key: str, parts: Sequence[Part]) -> DataFrame:
    """``entities`` (one row per key) with an array of structs for each part, in its order, and ``n_<part>``: how many rows there are in all.

    The rows of each part are cut to what a page shows before they are shuffled by key, so a key that holds a third of all rows is no task's own. They become arrays where they
    are numbered, in a part's own columns; all arrays of a key then travel as one relation, not as a join for each kind. Rows are counted apart, by key alone.
    """
    tagged = None
    for p in parts:
        kind = (p.rows if p.counted is None else p.counted).where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.lit(p.name).alias("_kind"))
        tagged = kind if tagged is None else tagged.unionByName(kind)
    counts = tagged.groupBy("_key").agg(*(F.count_if(F.col("_kind") == p.name).alias(f"n_{p.name}") for p in parts))
    listed = [p.listed(key) for p in parts]
    kinds = {p.name: x.schema[p.name].dataType for p, x in zip(parts, listed, strict=True)}
    arrays = listed[0]
    for x in listed[1:]:
        arrays = arrays.unionByName(x, allowMissingColumns=True)
    n = parts_for(entities, 50_000)
    nested = arrays.repartition(n, "_key").groupBy("_key").agg(*(F.first(name, ignorenulls=True).alias(name) for name in kinds))
    met = entities.repartition(n, key).join(shuffled(nested), F.col(key) == F.col("_key"), "left").drop("_key")  # all three are dealt alike, so arrays aren't shuffled again
    met = met.join(shuffled(counts.repartition(n, "_key")), F.col(key) == F.col("_key"), "left").drop("_key")
    filled = {n: F.coalesce(n, F.array().cast(kind)) for n, kind in kinds.items()}
    return met.withColumns(filled | {f"n_{p.name}": F.coalesce(f"n_{p.name}", F.lit(0)) for p in parts})


def investor_rounds(investments: DataFrame, company: str, org: str, silent: Sequence[str]) -> DataFrame:
    """Over investments (company, org, round, is_lead, announced): one row per company and investor, rounds counted and named but those of ``silent``."""
    named = F.when(~F.col("round").isin(*silent), F.col("round"))
    return investments.groupBy(company, org).agg(
        F.bool_or("is_lead").alias("is_lead"), F.count(F.lit(1)).alias("rounds"), F.max("announced").alias("announced"), F.array_sort(F.collect_set(named)).alias("round_names"),
        F.max_by(named, F.when(named.isNotNull(), F.struct(F.col("announced").isNotNull(), "announced", "round"))).alias("latest_round"),
    )


def latest_scores(scores: DataFrame, item: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The fields of each item's last score; versions of a score are rows of one item, not items."""
    last = F.max_by(F.struct(*fields), F.struct(*order))
    return scores.groupBy(item).agg(last.alias("_s")).select(item, "_s.*")


def related_items(items: DataFrame, pages: DataFrame, most: int = 10) -> DataFrame:
    """``items`` (item_id, company_id) with ``related``: of the company's bundle in ``pages`` (company_id, items) the first ``most`` that aren't the item itself.

    The bundle must list one item more than ``most``; so no two items of a company are ever joined.
    """
    others = F.slice(F.filter("_items", lambda x: x["item_id"] != F.col("item_id")), 1, most)
    told = pages.select(F.col("company_id").alias("_company"), F.col("items").alias("_items"))
    return items.join(told, F.col("company_id") == F.col("_company"), "left").withColumn("related", F.coalesce(others, F.slice("_items", 1, 0))).drop("_company", "_items")


def sibling_context(
    cited: DataFrame, representative: DataFrame, scored: DataFrame, previous: Column, now: Column, floor_days: int = 4, most: int | None = 2_000
) -> tuple[DataFrame, DataFrame]:
    """What else a company did beside its headline: siblings (company_id, item_id, why, source_type, published_at, fetched) and sources (item_id, source, url, day).

    Over items as read in three ways, each with item_id, source, url, source_type, published_at, fetched_at: those that points cite, the companies' representative ones and
    the scored ones (both with company_id and why). Of one item's readings for a company the representative comes first; of all readings of an item the cited. Of the scored
    only the ``most`` latest are read, null dates last (None: all): each task hands on that many, and no more meet in one place.
    ``fetched`` says whether an item came after the ``previous`` run, which counts from ``floor_days`` before ``now`` at the earliest.
    """
    if most is not None:
        scored = scored.orderBy(F.desc_nulls_last("published_at"), "item_id", "company_id").limit(most)
    since = F.coalesce(F.greatest(previous, now - F.make_dt_interval(F.lit(floor_days))), now - F.make_dt_interval(F.lit(floor_days)))
    fetched = F.coalesce(F.coalesce("published_at", "fetched_at") >= since, F.lit(False))
    told = lambda df, k: df.withColumns({"_order": F.lit(k), "fetched": fetched})
    both = told(representative, 1).unionByName(told(scored, 2))
    fields = ["why", "source_type", "published_at"]
    siblings = both.groupBy("company_id", "item_id").agg(F.min_by(F.struct(*fields), F.struct("_order", "why")).alias("_f"), F.bool_or("fetched").alias("fetched")).select("company_id", "item_id", "_f.*", "fetched")
    every = told(cited, 0).unionByName(both.select(*cited.columns, "_order", "fetched"))
    first = F.min_by(F.struct("source", "url", "published_at"), F.struct("_order", "source", "url"))
    sources = every.groupBy("item_id").agg(first.alias("_f")).select("item_id", "_f.source", "_f.url", F.to_date("_f.published_at").alias("day"))
    return siblings, sources


def queue_sizes(flags: Sequence[tuple[DataFrame, str, Mapping[str, Column]]], waiting: Mapping[str, Column]) -> DataFrame:
    """One row with the size of each queue, from one pass.

    ``flags`` are (rows, key column, flag name -> condition): whether an entity has such a row. All flags meet in one
    grouping by entity, and each queue counts the entities whose flags fulfil its condition; so no table is read for more than one anti-join.
    """
    names = [n for _, _, conditions in flags for n in conditions]
    union = None
    for rows, key, conditions in flags:
        part = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_key"), *(F.coalesce(conditions[n], F.lit(False)).alias(n) if n in conditions else F.lit(False).alias(n) for n in names))
        union = part if union is None else union.unionByName(part)
    each = union.groupBy("_key").agg(*(F.bool_or(n).alias(n) for n in names))
    return each.agg(*(F.count_if(c).alias(name) for name, c in waiting.items()))


def sliding_rates(events: DataFrame, ts: str, kinds: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """(minute, rates): for each minute with an event, how many of each kind came in the so many minutes that end with it.

    Events are counted by minute first, and the counts combined over a range; no event is copied into the windows it falls into.
    """
    panes = events.groupBy(F.date_trunc("minute", ts).alias("minute")).agg(*(F.count_if(c).alias(n) for n, (c, _) in kinds.items()))
    at = F.unix_seconds(F.col("minute").cast("timestamp"))
    panes = panes.withColumns({"_at": at, "_day": F.floor(at / 86_400)})
    # A day's minutes are one partition, and the minutes before midnight are lent to the next day's.
    longest = max(m for _, m in kinds.values())
    lent = panes.where(F.pmod(F.col("_at"), F.lit(86_400)) >= 86_400 - 60 * longest).withColumn("_day", F.col("_day") + 1)
    both = panes.withColumn("_own", F.lit(True)).unionByName(lent.withColumn("_own", F.lit(False)))
    over = lambda m: Window.partitionBy("_day").orderBy("_at").rangeBetween(-60 * (m - 1), 0)
    return both.select("minute", "_own", *(F.sum(n).over(over(m)).alias(n) for n, (_, m) in kinds.items())).where("_own").drop("_own")
