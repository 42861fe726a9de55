"""Warm paths between companies for all companies at once: shared people, shared funds, edges, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlens.operators.graph import both_ways, degree_coverage, degree_discount, edge_sentence
from harborlens.operators.shared import pairs_of, parts_for

PATH_COLUMNS = ("company_id", "kind", "via_person", "via_org", "target_id", "score", "degree", "coverage", "told")


def _rows(df: DataFrame, kind: str, **given: Column) -> DataFrame:
    """``df`` in the columns that all kinds of paths share; what isn't given is null."""
    kinds = {"company_id": "long", "via_person": "long", "via_org": "long", "target_id": "long", "score": "double", "degree": "long", "coverage": "string", "told": "string"}
    return df.select(*(F.lit(kind).alias(c) if c == "kind" else given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in PATH_COLUMNS))


def _linked(df: DataFrame, links: DataFrame, kind: str, id_col: str, name: str) -> DataFrame:
    """Adds whether a subject of ``kind`` has a row among polymorphic links (subject_type, subject_id)."""
    own = links.where(F.col("subject_type") == kind).select(F.col("subject_id").alias(f"_{name}")).distinct()
    return df.join(own, F.col(id_col) == F.col(f"_{name}"), "left").withColumn(name, F.col(f"_{name}").isNotNull()).drop(f"_{name}")


def _pairs(ends: DataFrame, hub: str, facts: DataFrame) -> DataFrame:
    """Each two rows of a hub with different companies, as (hub, company_id, other_id, the hub's facts, and what both rows carry with _there).

    What a score needs of a company is joined to the single rows before, so that pairs are made last and scored where they are made.
    """
    return pairs_of(ends, hub, "company_id", "company_id", facts).withColumnRenamed("company_id_there", "other_id")


def person_paths(roles: DataFrame, links: DataFrame) -> DataFrame:
    """Over roles (person_id, company_id, role): each two roles of a person at different companies.

    1.0 where the other company is linked to Singapore, else 0.55, discounted by the person's number of roles, times 1.4.
    """
    degree = roles.groupBy("person_id").agg(F.count(F.lit(1)).alias("degree"))
    p = _pairs(_linked(roles.select("person_id", "company_id", "role"), links, "company", "company_id", "linked"), "person_id", degree)
    score = F.when(F.col("linked_there"), 1.0).otherwise(0.55) * degree_discount(F.col("degree")) * 1.4
    told = F.concat("role", F.lit(" here, "), "role_there", F.lit(" there"))
    return _rows(p, "person_role", company_id=F.col("company_id"), via_person=F.col("person_id"), target_id=F.col("other_id"), score=score, degree=F.col("degree"), told=told)


def person_strengths(roles: DataFrame, links: DataFrame, most: int = 1_000, lists: int = 1 << 16, roles_of_company: int = 100_000, each: int = 250_000) -> DataFrame:
    """``path_strengths`` of ``person_paths``, (company_id, n, targets, best, total), without shuffling a path: each role takes the list of its person's other companies along,
    and what all of them score; lists become targets, to be told from others, where all of a company's are.

    People are dealt into ``lists`` buckets by a hash. Those of a bucket of more roles than ``most`` and twice the usual have paths instead, dealt as in ``pairs_of``, so no list is
    longer than that; a company of more than ``roles_of_company`` roles is cut into slices by target. Some ``each`` roles are a task's.
    """
    n, parts = F.count(F.lit(1)), parts_for(roles, each)
    roles = roles.select("person_id", "company_id", F.pmod(F.xxhash64("person_id"), F.lit(lists)).alias("_bucket"))
    heavy = roles.groupBy("_bucket").agg(n.alias("_n")).where(F.col("_n") > most + 2 * parts * each // lists).select("_bucket")
    few = _linked(roles.join(F.broadcast(heavy), "_bucket", "left_anti").where("person_id is not null"), links, "company", "company_id", "linked")
    held = few.select("person_id", F.struct("company_id", "linked").alias("_r")).repartition(parts, "person_id").groupBy("person_id")
    held = held.agg(n.alias("_degree"), F.collect_list(F.when(F.col("_r.company_id").isNotNull(), F.col("_r"))).alias("_held"))
    held = held.select("_held", "_degree", F.explode(F.array_distinct(F.col("_held.company_id"))).alias("company_id"))
    held = held.withColumn("_others", F.filter("_held", lambda x: x["company_id"] != F.col("company_id")))
    own, other, linked = F.size("_held") - F.size("_others"), F.size("_others"), F.size(F.filter("_others", lambda x: x["linked"]))
    score = lambda base: F.lit(base) * degree_discount(F.col("_degree")) * 1.4
    told = held.select(
        "company_id", F.col("_others.company_id").alias("_targets"), (own * other).cast("long").alias("n"),
        F.when(linked > 0, score(1.0)).when(other > 0, score(0.55)).alias("best"), (own * (linked * score(1.0) + (other - linked) * score(0.55))).alias("total"),
    )
    many = person_paths(roles.join(F.broadcast(heavy), "_bucket", "left_semi").withColumn("role", F.lit("")), links).groupBy("company_id", "target_id")
    many = many.agg(n.alias("n"), F.max("score").alias("best"), F.sum("score").alias("total")).select("company_id", F.array("target_id").alias("_targets"), "n", "best", "total")
    wide = roles.groupBy("company_id").agg((F.floor(n / roles_of_company) + 1).cast("int").alias("_slices")).where("_slices > 1").orderBy(F.desc("_slices"), "company_id").limit(10_000)
    sent = told.unionByName(many).join(F.broadcast(wide), "company_id", "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)))
    mine = F.filter("_targets", lambda x: F.pmod(F.xxhash64(x), F.col("_slices")) == F.col("_slice"))
    sent = sent.withColumn("_targets", F.when(F.col("_slices").isNull(), F.col("_targets")).otherwise(mine)).drop("_slices").repartition(parts, "company_id", "_slice")
    first = lambda c: F.when((F.col("_slice") == 0) & (F.coalesce("_at", F.lit(0)) == 0), F.col(c)).alias(c)
    one = sent.select("company_id", "_slice", F.posexplode_outer("_targets").alias("_at", "_target"), "n", "best", "total").select("company_id", "_slice", "_target", first("n"), first("best"), first("total"))
    sums = (F.sum("n").alias("n"), F.max("best").alias("best"), F.sum("total").alias("total"))
    return one.groupBy("company_id", "_slice", "_target").agg(*sums).groupBy("company_id").agg(F.count("_target").alias("targets"), *sums).where("n > 0").select("company_id", "n", "targets", "best", "total")


def fund_paths(investments: DataFrame, orgs: DataFrame, companies: DataFrame, links: DataFrame, engaged: tuple[str, ...]) -> DataFrame:
    """Over investments (org_id, company_id, scraped): companies with a fund in common, each pair once for a fund.

    The other company is engaged or linked to Singapore, or the fund is present there. 0.8 where the fund is, 0.6 where the company
    is linked, else 0.35; discounted by the fund's edges, by half or more where its portfolio wasn't scraped.
    """
    degree = investments.groupBy("org_id").agg(F.count(F.lit(1)).alias("degree"), F.count_if("scraped").alias("scraped"))
    told = companies.select("company_id", F.coalesce(F.col("familiarity").isin(*engaged), F.lit(False)).alias("engaged"), F.lit(True).alias("known"))
    ends = _linked(investments.select("org_id", "company_id").distinct().join(told, "company_id", "left"), links, "company", "company_id", "linked")
    p = _pairs(ends, "org_id", degree.join(orgs.select("org_id", "sg_presence"), "org_id")).where("known_there")
    here = F.coalesce(F.col("sg_presence"), F.lit(False))
    p = p.where(here | F.col("linked_there") | F.col("engaged_there"))
    coverage = degree_coverage(F.col("scraped"), F.col("degree"))
    discount = F.when(coverage == "scraped", degree_discount(F.col("degree"))).otherwise(F.least(degree_discount(F.col("degree")), F.lit(0.5)))
    score = F.when(here, 0.8).when(F.col("linked_there"), 0.6).otherwise(0.35) * discount
    return _rows(p, "fund_portfolio", company_id=F.col("company_id"), via_org=F.col("org_id"), target_id=F.col("other_id"), score=score, degree=F.col("degree"), coverage=coverage)


def edge_paths(edges: DataFrame, companies: DataFrame, engaged: tuple[str, ...]) -> DataFrame:
    """Over edges (from_id, to_id, relation): each edge from either end; 0.9 where the other company is engaged, else 0.5, told in its direction."""
    e = both_ways(edges.select("from_id", "to_id", "relation"), "from_id", "to_id").select(F.col("from_id").alias("company_id"), F.col("to_id").alias("other_id"), "relation", "is_first")
    here = companies.select("company_id", F.col("name").alias("subject"))
    there = companies.select(F.col("company_id").alias("other_id"), F.col("name").alias("other"), "familiarity")
    p = e.join(here, "company_id").join(there, "other_id")
    known = F.coalesce(F.col("familiarity").isin(*engaged), F.lit(False))
    told = edge_sentence(F.col("subject"), F.col("relation"), F.col("other"), F.col("is_first"))
    return _rows(p, "company_edge", company_id=F.col("company_id"), target_id=F.col("other_id"), score=F.when(known, 0.9).otherwise(0.5), told=told)


def event_paths(participants: DataFrame, events: DataFrame, asof: Column) -> DataFrame:
    """Over participants (event_id, company_id, person_id) and events (event_id, starts_on): 0.75 for each event to come or without a date."""
    ahead = events.where(F.col("starts_on").isNull() | (F.col("starts_on") >= asof)).select("event_id")
    p = participants.join(ahead, "event_id")
    return _rows(p, "event", company_id=F.col("company_id"), via_person=F.col("person_id"), score=F.lit(0.75))


def warm_paths(*kinds: DataFrame) -> DataFrame:
    """All kinds of paths of all companies, in one relation."""
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


def path_strengths(paths: DataFrame) -> DataFrame:
    """(company_id, kind, n, targets, best, total): of each company and kind how many paths, to how many others, their best score and the sum of all."""
    return paths.groupBy("company_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target_id").alias("targets"), F.max("score").alias("best"), F.sum("score").alias("total"))


def companies_with_paths(paths: DataFrame) -> DataFrame:
    return paths.select("company_id").distinct()


def path_nodes(paths: DataFrame) -> DataFrame:
    """(company_id, kind, nodes, edges): ids of a path's nodes in order and keys of the edges between them, for a picture of the graph."""
    node = lambda prefix, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(prefix), F.col(c).cast("string")))
    nodes = F.array_compact(F.array(node("c", "company_id"), node("p", "via_person"), node("o", "via_org"), node("c", "target_id")))
    paths = paths.select("company_id", "kind", nodes.alias("nodes"))
    pairs = F.zip_with(F.slice("nodes", F.lit(1), F.size("nodes") - 1), F.slice("nodes", F.lit(2), F.size("nodes") - 1), lambda a, b: F.concat(a, F.lit("|"), b))
    return paths.withColumn("edges", pairs)
