"""The driver contract: names, oracles, and the shapes of plans."""

from collections import Counter, defaultdict

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    q = entry.queries()
    assert "LeftSemi" in plan(q["customers_with_orders"](spark, SF)) and "LeftAnti" in plan(q["customers_without_orders"](spark, SF))
    assert "WindowGroupLimit" in plan(q["latest_order_per_customer"](spark, SF))
    for name in ("trigram_pairs", "edit_distance_pairs", "shared_hub_scores", "dictionary_mentions", "events_near_signup"):
        assert "Cartesian" not in plan(q[name](spark, SF)) and "NestedLoop" not in plan(q[name](spark, SF)), name
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)" in plan(q["customers_without_orders"](spark, SF))


def test_edges_of_real_ids(spark):
    """Edges and degrees come from the ids as they are, so they grow with the table."""
    q, sf = entry.queries(), "/root/testdata/sf0.01"
    hubs = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect():
        hubs[r.l_partkey].add(r.l_suppkey)
    want = {(a, b) for k in hubs.values() for a in k for b in k if a < b}
    assert {tuple(r) for r in q["supplier_edges"](spark, sf).collect()} == want
    degree = Counter(x for e in want for x in e)
    assert {r.node: r.degree for r in q["supplier_degrees"](spark, sf).collect()} == degree


def test_what_grows_is_not_broadcast(spark):
    """Joins of two sides that grow with the input, as duplicates and merges make them, send neither through the driver; the list of hot keys alone is."""
    q = entry.queries()
    for name in ("org_duplicates", "surviving_customers", "merged_companies", "merged_schema"):
        joins = [line for line in plan(q[name](spark, SF)).split("\n") if "BroadcastHashJoin" in line]
        assert not joins or name == "org_duplicates" and all("LeftOuter" in line for line in joins), (name, joins)


def test_pairs_that_share_an_element_stay_where_they_are_made(spark):
    """No row pair is shuffled or made distinct afterwards: nothing but the join of the classes is on the way to them."""
    for name in ("sector_context", "sector_context_all"):
        made = plan(entry.queries()[name](spark, SF))
        assert "Aggregate" not in made.split("Join")[0], name
