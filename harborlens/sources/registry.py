"""A company registry kept in shards by the first letter of the name, and lookups that open the shards they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlens.functions.filters import registry_match
from harborlens.functions.text import fold_accents
from harborlens.operators.reports import registry_order
from harborlens.sources.scans import REGISTRY_STOP

OTHERS = "Others"


def _letters(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold_accents(F.lower(c)), r"[^a-z0-9\s]", " "))


def shard_of(name: Column) -> Column:
    """The capital that a name begins with, marks left off; Others for names that begin with none."""
    first = F.upper(F.substring(_letters(name), 1, 1))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise(OTHERS)


def write_registry(registry: DataFrame, path: str, name: str = "name") -> None:
    """Writes a registry as a table partitioned by ``shard``; rows of a shard are spread over as many files as their number asks for."""
    registry.withColumn("shard", shard_of(F.col(name))).write.mode("overwrite").partitionBy("shard").parquet(path)


def lookup_sharded(companies: DataFrame, registry: DataFrame, live: Column, each: int = 40, most: int = 4) -> DataFrame:
    """(company, uen, registered, status, match, place): registered entities that may be a company's, sure ones first, living ones before others.

    Over companies (company) and a sharded registry (uen, name, status, shard). A company is looked for in its own letter's shard and in Others, by its first two telling words of
    four letters or more; a search gives ``each`` entities at most, in order of their names, as the registry's own search does. What the searches give is joined by uen. How many there are
    says how far the name is distinctive, and more than ``most`` matches of a short name are none.

    The companies' shards, 27 at most, are broadcast, and prune the registry's partitions where it is read.
    """
    name = _letters(F.col("company"))
    telling = F.slice(F.filter(F.split(name, r"\s+"), lambda t: (F.length(t) >= 4) & ~t.isin(*REGISTRY_STOP)), 1, 2)
    asked = companies.select("company").distinct().select("company", F.explode(F.array_distinct(telling)).alias("token"), F.array(shard_of(F.col("company")), F.lit(OTHERS)).alias("_shards"))
    asked = asked.select("company", "token", F.explode(F.array_distinct("_shards")).alias("shard"))
    there = F.broadcast(asked.select("shard").distinct().where("shard >= 'A'"))
    held = registry.join(there, "shard", "left_semi").select("uen", F.col("name").alias("registered"), "status", "shard", F.explode(F.array_distinct(F.split(_letters(F.col("name")), r"\s+"))).alias("token"))
    n = F.row_number().over(Window.partitionBy("company", "shard", "token").orderBy("registered", "uen"))
    met = asked.join(held, ["shard", "token"]).withColumn("_n", n).where(F.col("_n") <= each)
    met = met.groupBy("company", "uen").agg(F.min(F.struct("registered", "status")).alias("_e")).select("company", "uen", "_e.*")
    met = met.withColumn("collisions", F.count(F.lit(1)).over(Window.partitionBy("company")))
    met = met.withColumn("match", registry_match(F.col("company"), F.col("registered"), F.col("collisions"))).where("match is not null")
    order = Window.partitionBy("company").orderBy(registry_order(F.col("match")), F.when(live, 0).otherwise(1), "registered", "uen")
    met = met.withColumns({"matches": F.count(F.lit(1)).over(Window.partitionBy("company")), "place": F.row_number().over(order)})
    generic = (F.col("matches") > most) & (F.length(F.regexp_replace(_letters(F.col("company")), r"\s+", "")) < 10)
    return met.where(~generic).select("company", "uen", "registered", "status", "match", "place")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
