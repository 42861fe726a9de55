"""Joins and writes of the workflow on small tables, nulls and ties included."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from harborlens.operators import joins, writes
from harborlens.plans.texts import passage_mentions


def test_asof_join_against_brute_force(spark):
    rng = random.Random(5)
    left = [(i, rng.choice([1, 2, None]), rng.choice([*range(9), None])) for i in range(40)]
    right = [(100 + i, rng.choice([1, 2, None]), rng.choice([*range(9), None])) for i in range(15)]
    a, b = spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "id int, k int, t int")
    got = {r.id: r.last_id for r in joins.asof_join(a, b, "k", "t", ["id"], "id").collect()}
    want = {i: max(((u, j) for j, m, u in right if None not in (k, t, m, u) and m == k and u <= t), default=(0, None))[1] for i, k, t in left}
    assert got == want


def test_overlap_join(spark):
    a = spark.createDataFrame([(1, ["x", "y", "x"]), (2, []), (3, None), (4, [None, "z"])], "a int, s array<string>")
    b = spark.createDataFrame([(1, ["y", "x"]), (2, None), (3, []), (4, ["z", None]), (5, ["q"])], "b int, s array<string>")
    got = sorted(tuple(r) for r in joins.overlap_join(a, b, "a", "s", "b", "s").collect())
    assert got == sorted([(1, 1), (4, 4)] + [(i, j) for i in (1, 2, 3, 4) for j in (2, 3)])


def test_names_and_mentions(spark):
    names = spark.createDataFrame([("acme", 7), ("acme", 3), ("", 1)], "key string, id int")
    aliases = spark.createDataFrame([("acme", 1), ("ac", 9), ("ac", 8), (None, 2)], "key string, id int")
    assert {tuple(r) for r in joins.name_index(names, aliases).collect()} == {("acme", 3, False), ("ac", 8, True)}
    texts = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c", "a"]), (3, []), (4, None), (5, ["a", "b"]), (6, ["z"])], "id int, w array<string>")
    terms = spark.createDataFrame([("a",), ("b c",), ("c",), ("a b c d",), ("a b c d e",), ("a",)], "term string")
    assert {tuple(r) for r in joins.longest_mention(texts, "id", "w", terms).collect()} == {(1, "b c", 1), (2, "c", 0), (5, "a", 0)}


def test_states(spark):
    rows = [(1, 1, "approve"), (1, 2, "send"), (1, 3, "unapprove"), (2, 1, "send"), (2, 2, "approve"), (3, 1, "approve"), (3, 2, "unapprove"), (3, 3, "send"), (4, 1, None)]
    log = spark.createDataFrame(rows, "k int, at int, a string")
    assert {tuple(r) for r in writes.digest_states(log, "k", F.col("a"), ["at"]).collect()} == {(1, "sent"), (2, "approved"), (3, "draft"), (4, "draft")}
    assert {(r.k, r.action) for r in writes.state_of_log(log, "k", F.col("a"), ["at"]).collect()} == {(1, "unapprove"), (2, "approve"), (3, "send")}


def test_merge_patch_and_problems(spark):
    rows = spark.createDataFrame([("g", 2, None, "B"), ("g", 1, None, "A"), ("g", 3, "x", "B"), ("g", 4, "y", "A"), ("h", 5, None, "C")], "g string, id int, f string, name string")
    got = {r.g: (r.keep_id, r.merged, r.f, r.aliases) for r in writes.merge_fill(rows, "g", "id", ["f"], "name").collect()}
    assert got == {"g": (1, 3, "x", ["B"]), "h": (5, 0, None, [])}
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, " ", True), (2, "c", False), (3, "d", True), (9, "e", True)], "k int, v string, ok boolean")
    assert {tuple(r) for r in writes.guarded_patch(old, new, "k", ["v"], F.col("ok")).collect()} == {(1, "a", True), (2, "b", False), (3, "d", True), (None, "n", False)}
    found = writes.problems(old, "k", {"missing": F.col("v").isNull(), "small": F.col("k") < 2})
    assert {tuple(r) for r in found.collect()} == {(1, "small"), (3, "missing")}


def test_context_of_all_parts(spark):
    """Every part counts: none is left out for its size."""
    sf = "/root/testdata/sf0.001"
    sup = [(r.s_suppkey, {f"a{r.s_nationkey % 6}", f"a{r.s_suppkey % 4}"}) for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()]
    want = {(s, r.p_partkey) for r in spark.read.parquet(f"{sf}/part.parquet").collect() for s, have in sup if r.p_size == 1 or f"a{r.p_partkey % 7}" in have}
    assert {tuple(r) for r in entry.queries()["sector_context_all"](spark, sf).collect()} == want


def test_passages_of_items(spark):
    """Later passages of an item and whole short items are found."""
    items = spark.createDataFrame([(1, "a b c d e".split()), (2, ["x", "y"]), (3, ["z"]), (4, [""]), (5, None)], "item_id int, w array<string>")
    docs = spark.createDataFrame([(1, "q c d e".split()), (2, "a b q".split()), (3, ["x", "y"]), (4, ["q", "z"]), (5, []), (6, None), (7, "b c d z".split()), (8, ["x", "q", "y"])], "doc_id int, w array<string>")
    assert {tuple(r) for r in passage_mentions(docs, items).collect()} == {(1, 1), (3, 2), (4, 3), (7, 1), (7, 3)}


def test_queues_are_whole(spark):
    """Nobody who is due is lost after the first hundreds; places are those of one order over all, and a limit is an option."""
    q, sf = entry.queries(), "/root/testdata/sf0.01"
    first = {r.c_custkey: r.place for r in q["retry_queue"](spark, sf).collect()}
    whole = {r.c_custkey: r.place for r in q["retry_queue_whole"](spark, sf).collect()}
    assert len(first) == 150 < len(whole) and sorted(whole.values()) == list(range(1, len(whole) + 1)) and first.items() <= whole.items()
    c = spark.read.parquet(f"{sf}/customer.parquet")
    best = {r.c_custkey: (r.best, r.place) for r in q["signal_queue_whole"](spark, sf).collect()}
    names = {r.c_custkey: r.c_name for r in c.collect()}
    assert best.keys() == names.keys() and sorted(best, key=lambda k: (-best[k][0], names[k])) == sorted(best, key=lambda k: best[k][1])
    assert q["signal_queue_whole"](spark, sf, limit=7).count() == 7
