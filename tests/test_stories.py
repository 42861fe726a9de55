"""Clusters of stories against the one-pass rule as a fold, reclustering, new stories, and the helpers for hot keys."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from harborlens.functions.filters import source_authority
from harborlens.operators import cluster, graph, shared
from harborlens.plans import catalogue, texts

NAMES = ["item_id", "title", "company_id", "signal_type", "published_at"]
SCHEMA = "item_id long, title string, company_id string, source string, signal_type string, published_at timestamp, status string"


def stories(spark, n=260, seed=1):
    """Headlines of few names and figures, many of them equal or alike, over two months; one block and one headline hold much of them."""
    rng, rows = random.Random(seed), []
    names = ["Acme", "Borealis", "Cygnus", "Dorado", "Elara", "Fornax"]
    for i in rng.sample(range(10_000), n):
        words = [rng.choice(names), rng.choice(["raises", "opens", "RAISES!", "hires"]), rng.choice(["$40M", "$40 million", "a Plant", "120 staff", ""]), rng.choice(["in Singapore", "with Gamma", ""])]
        title = "Acme raises $40M" if rng.random() < 0.2 else rng.choice([None, "", "!!"]) if rng.random() < 0.05 else " ".join(words)
        day = datetime(2025, 1, 1) + timedelta(hours=rng.randrange(24 * 60)) if rng.random() < 0.9 else None
        rows.append((i, title, rng.choice([None, None, "a", "b"]), rng.choice(["Business Wire", "OpenPR", "Other"]), rng.choice(["funding", "hiring", "", None]), day, rng.choice(["kept", "duplicate", "dropped"])))
    return rows, spark.createDataFrame(rows, SCHEMA)


def folded(spark, df):
    """The rule as it is told: a pass over later items for each item that no cluster has taken."""
    f = {r.item_id: r for r in cluster.with_features(df, "title").collect()}

    def jaccard(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0

    def same(a, b):
        if jaccard(a._grams, b._grams) >= 0.7:
            return True
        least = 0.15 if a.signal_type and a.signal_type == b.signal_type else 0.4
        if jaccard(a._terms, b._terms) < least:
            return False
        return not a.published_at or not b.published_at or abs((a.published_at - b.published_at).total_seconds()) <= 5 * 86_400

    out = {}
    for block in {r.company_id for r in f.values()}:
        group = [f[i] for i in sorted(f) if f[i].company_id == block]
        for seed in group:
            if seed.item_id in out:
                continue
            members = [seed]
            out[seed.item_id] = seed.item_id
            for other in group:
                if other.item_id not in out and any(same(m, other) for m in members):
                    members.append(other)
                    out[other.item_id] = seed.item_id
    return out


def test_dated_clusters_are_the_fold(spark):
    rows, df = stories(spark)
    want = folded(spark, df)
    assert len(set(want.values())) < len(want) * 0.8  # there is something to find
    got = {r.item_id: r.cluster_id for r in cluster.dated_clusters(df, *NAMES).collect()}
    assert got == want
    assert cluster.dated_clusters(df.limit(0), *NAMES).count() == 0


def test_new_stories_join_stored_clusters(spark):
    rows, df = stories(spark, 160, 2)
    want = folded(spark, df)
    old = df.where("item_id < 6000")
    known = spark.createDataFrame([(i, c) for i, c in folded(spark, old).items()], "item_id long, cluster_id long")
    got = cluster.assign_new(df.where("item_id >= 6000"), old.join(known, "item_id"), *NAMES)
    assert {r.item_id: r.cluster_id for r in got.collect()} == {i: c for i, c in want.items() if i >= 6000}


def test_recluster(spark):
    rows, df = stories(spark, 120, 3)
    told = {r[0]: r[4] for r in rows}
    scores = [(i, "v2", s) for i, s in told.items() if s is not None] + [(i, "v1", "other") for i in told]
    got = {r.item_id: r for r in cluster.recluster(df.drop("signal_type"), spark.createDataFrame(scores, "item_id long, rubric_version string, signal_type string"), "v2").collect()}
    live = df.where("status <> 'dropped'")
    want, members = folded(spark, live), {}
    assert set(got) == set(want)
    trust = {r.item_id: (-r.t, r.published_at is None, r.published_at or datetime.min, r.item_id) for r in live.withColumn("t", source_authority(F.col("source"))).collect()}
    for i, root in want.items():
        members.setdefault(root, []).append(i)
    for group in members.values():
        head = min(group, key=trust.get)
        assert {got[i].cluster_id for i in group} == {head} and [i for i in group if got[i].status == "kept"] == [head]


def test_long_chains_settle(spark):
    """A way of 300 steps, which no number of rounds fixed beforehand would bound."""
    pairs = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 150)], "left_id long, right_id long")
    items = spark.createDataFrame([(i,) for i in [*range(301), 1000, 2000]], "i long")
    assert {r.i: r.cluster_id for r in cluster.greedy_clusters(items, pairs, "i").collect()} == {**dict.fromkeys([*range(301), 1000], 0), 2000: 2000}
    down = spark.createDataFrame([(1, 9), (5, 9), (5, 7)], "left_id long, right_id long")  # 5 opens its own cluster before 9 is looked at
    assert {r.i: r.cluster_id for r in cluster.greedy_clusters(spark.createDataFrame([(1,), (5,), (7,), (9,)], "i long"), down, "i").collect()} == {1: 1, 5: 5, 7: 5, 9: 1}


def test_headlines_of_stories_meet_in_cells(spark, monkeypatch):
    """Trigrams, of which nearly any two headlines share rare ones, make no candidates by prefixes; key terms do."""
    rows, df = stories(spark, 40, 6)
    sought = []
    told = cluster.jaccard_candidates
    monkeypatch.setattr(cluster, "jaccard_candidates", lambda sets, i, c, *a, **k: sought.append(c) or told(sets, i, c, *a, **k))
    cluster.story_ways(df, "item_id", "title", "company_id", "signal_type", "published_at")
    assert set(sought) == {"_terms"}


def test_copies_of_a_headline_are_one_node(spark, tmp_path, monkeypatch):
    """Components are of distinct headlines: 100 copies give no pair of each two of them."""
    rows = [(i, "Acme opens a plant in Singapore\nmore" if i < 100 else "ACME opens a plant in Singapore!!" if i == 100 else "Acme opens plants in Singapore" if i < 103 else "", "s", "en") for i in range(5, 106)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    told = cluster.label_components
    monkeypatch.setattr(texts, "label_components", lambda nodes, pairs, c: seen.append(pairs.count()) or told(nodes, pairs, c))
    got = {r.doc_id: r.cluster_id for r in catalogue.QUERIES["story_clusters"](spark, str(tmp_path)).collect()}
    assert got == {i: 5 if i < 103 else i for i in range(5, 106)}
    assert seen == [1]


def test_rows_before(spark):
    rng = random.Random(4)
    rows = [(k, i) for k in "aab" for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(sorted(set(rows)), "k string, i long").repartition(5)
    got = {(r.k, r.i): r._before and r._before.i for r in shared.with_before(df, ["k"], ["i"], ["i"]).collect()}
    for k in "ab":
        own = sorted(i for x, i in set(rows) if x == k)
        assert [got[k, i] for i in own] == [None, *own[:-1]]


def test_hot_hubs_are_dealt(spark):
    """No task gets a third of all rows because one hub has them."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("hub"), F.col("id").alias("end"))
    left, right = shared.dealt(rows, [rows], ["hub"], ["end"])
    assert left.groupBy("hub", "_part").count().agg(F.max("count")).first()[0] < 2_000
    assert left.count() == 30_000
    assert right.where("hub = -1").groupBy("_part").count().select("count").distinct().count() == 1
    degree = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("degree"))
    few = rows.where("end < 300")
    got = shared.pairs_of(few, "hub", "end", "end", degree, most=10)
    assert got.count() == 100 * 99 and got.select("degree").distinct().collect()[0][0] == 10_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_part") > 4 and "CartesianProduct" not in plan


def test_links_over_hubs_are_those_of_all_paths(spark):
    """Lists of a hub's ends in place of pairs: the same links, whether hubs and sources are cut or not, and pairs aren't shuffled."""
    rng = random.Random(8)
    e = spark.createDataFrame([(rng.choice([None, *range(12)]), rng.choice([None, *range(30)])) for _ in range(400)], "h long, c long")
    p = graph.shared_hub_paths(e, "h", "c").groupBy("source", "target").agg(F.count(F.lit(1)), F.min("degree"))
    want = {tuple(r) for r in p.collect()}
    for given in ({}, {"most": 5}, {"hubs_of_end": 3}, {"most": 3, "hubs_of_end": 2}):
        got = [tuple(r) for r in graph.shared_hub_links(e, "h", "c", **given).collect()]
        assert set(got) == want and len(got) == len(want), given
        rising = [tuple(r) for r in graph.shared_hub_links(e, "h", "c", rising=True, **given).collect()]
        assert sorted(rising) == sorted(x for x in want if x[0] < x[1]), given
    plan = catalogue.QUERIES["shared_hub_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Generate")[0]
