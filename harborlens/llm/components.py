"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlens.llm.common import checkpointed, dealt


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) long edges in any direction -> (node, root): the smallest node that each node reaches, roots left out.

    Each round links all larger neighbours of a node to its smallest neighbour, then all
    smaller ones (the large-star and small-star steps of Kiveris et al., 2014), until the
    edges are stars. Rounds grow with the logarithm of the longest chain. All steps are
    joins and grouped minima; edges, which never grow in number, stay on the executors. A node
    of very many edges is counted with a map-side combine and dealt into parts for the joins.
    Loops and nulls are dropped; repeated edges do no harm; no edges give no rows.
    """
    stars = checkpointed(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while True:
        state = tuple(stars.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(pmod(xxhash64(v, u), 1000003))")).first())
        if state == before or not state[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        parts, least = dealt(both, least, ["u"], "n", 2 * state[0], ["u", "v"])
        large = parts.join(least, ["u", "_part"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        parts, centres = dealt(large, least, ["u"], "n", 2 * state[0], ["u", "v"])
        small = parts.join(centres, ["u", "_part"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
