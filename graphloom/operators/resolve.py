"""From link texts to nodes, in tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import node_id


def resolve(links: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """links (source_id, raw_target, relation_type) with target_id and tier, null where nothing answers.

    Tiers: id, alias, unique title, unique path suffix. All are equi-joins: a node's
    suffixes are exploded once, so no link is compared with every node. Targets are
    made distinct first, so that a much linked name is looked up once.
    """
    raw = F.trim(F.regexp_replace("raw_target", r"^\[\[|\]\]$", ""))
    wanted = links.select("raw_target").distinct().withColumns({"k": F.lower(raw), "own": raw})
    slug = node_id(F.col("own"))
    ids = nodes.select(F.col("id").alias("t1"), F.lower("id").alias("k1")).groupBy("k1").agg(F.min("t1").alias("t1"))
    al = aliases.select(F.lower("alias").alias("k2"), F.col("node_id").alias("t2")).groupBy("k2").agg(F.min("t2").alias("t2"))
    titles = nodes.groupBy(F.lower("title").alias("k3")).agg(F.min("id").alias("t3"), F.count("*").alias("n")).where("n = 1").drop("n")
    parts = F.split(F.lower("id"), "/")
    suffix = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    tails = nodes.where(F.contains(F.col("id"), F.lit("/"))).select("id", F.explode(suffix).alias("k4")).groupBy("k4").agg(F.min("id").alias("t4"), F.count("*").alias("n")).where("n = 1").drop("n")
    w = wanted.join(ids, F.col("k") == F.col("k1"), "left").join(ids.toDF("k1s", "t1s"), slug == F.col("k1s"), "left").join(al, F.col("k") == F.col("k2"), "left").join(titles, F.col("k") == F.col("k3"), "left").join(tails, F.col("k") == F.col("k4"), "left")
    tier = F.when(F.coalesce("t1", "t1s").isNotNull(), "id").when(F.col("t2").isNotNull(), "alias").when(F.col("t3").isNotNull(), "title").when(F.col("t4").isNotNull(), "suffix")
    found = w.select("raw_target", F.coalesce("t1", "t1s", "t2", "t3", "t4").alias("target_id"), tier.alias("tier"))
    return links.join(found, "raw_target", "left")


def split(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges, without loops, and the links that stay pending."""
    edges = resolved.where("target_id is not null and target_id <> source_id").select("source_id", "target_id", "relation_type").distinct()
    pending = resolved.where("target_id is null").select("source_id", "raw_target", "relation_type").distinct()
    return edges, pending
