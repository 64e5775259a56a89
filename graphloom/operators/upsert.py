"""Changes of tables as joins of the old rows with the new."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MAIN, is_auto

ROWS_A_TASK = 1_000_000


def nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by id: new ones win, created_at is that of the first, an empty scope is main."""
    first = old.select("id", F.col("created_at").alias("_first"))
    fresh = new.join(first, "id", "left").withColumns({"created_at": F.coalesce("_first", "created_at"), "scope": F.coalesce(F.nullif("scope", F.lit("")), F.lit(MAIN))}).select(*old.columns)
    return old.join(new.select("id"), "id", "left_anti").select(*old.columns).unionByName(fresh)


def edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by (source, target, relation): weight and decay of the new, created_at of the old.

    Rows are shared out before they are sorted, ROWS_A_TASK or so a task.
    """
    key = ["source_id", "target_id", "relation_type"]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    both = both.repartition(-(-both.count() // ROWS_A_TASK) or 1, *key)
    return both.groupBy(*key).agg(*[F.max_by(c, F.struct("_new", "created_at", "weight")).alias(c) for c in ("weight", "decay_rate")], F.min_by("created_at", F.struct("_new", "created_at")).alias("created_at")).select(*old.columns)


def pending(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows stay as they are; of new ones, those with an unknown key come."""
    key = ["source_id", "raw_target", "relation_type"]
    return old.unionByName(new.join(old.select(*key), key, "left_anti")).dropDuplicates(key)


def without(rows: DataFrame, sources: DataFrame, relation: str | None = None) -> DataFrame:
    """Rows without those of the sources (id), of one relation or all: what is done before links are made anew."""
    gone = sources.select(F.col("id").alias("source_id")).distinct()
    if relation is not None:
        gone = gone.withColumn("relation_type", F.lit(relation))
    return rows.join(gone, gone.columns, "left_anti").select(*rows.columns)


def without_auto(rows: DataFrame) -> DataFrame:
    return rows.where(~is_auto(F.col("relation_type")))


def tags(old: DataFrame, new: DataFrame, ids: DataFrame) -> DataFrame:
    """Tags of the given nodes (id) put as the new ones."""
    return old.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns)).distinct()


def aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases in lower case; each has one node: the newest row's, then that of the least id."""
    clean = lambda d, k: d.select(F.lower(F.trim("alias")).alias("alias"), "node_id", F.lit(k).alias("_k"))
    line = Window.partitionBy("alias").orderBy(F.desc("_k"), "node_id")
    return clean(old, 0).unionByName(clean(new, 1)).where("alias <> ''").withColumn("_r", F.row_number().over(line)).where("_r = 1").select("alias", "node_id")


def contested(rows: DataFrame) -> DataFrame:
    """Aliases that several nodes claim."""
    return rows.groupBy(F.lower(F.trim("alias")).alias("alias")).agg(F.count_distinct("node_id").alias("n"), F.min("node_id").alias("winner")).where("n > 1")


def set_scope(tags_: DataFrame, scopes: DataFrame) -> DataFrame:
    """Tags with one scope:* tag for each node of scopes (id, scope)."""
    s = scopes.select(F.col("id").alias("node_id"), F.concat(F.lit("scope:"), "scope").alias("tag"))
    rest = tags_.join(s.select("node_id"), "node_id", "left_anti").unionByName(tags_.where(~F.startswith(F.col("tag"), F.lit("scope:"))).join(s.select("node_id"), "node_id", "left_semi"))
    return rest.unionByName(s).distinct()


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (id, content_hash) to (id, change): added, changed, removed or same."""
    o, n = old.select("id", F.col("content_hash").alias("o")), new.select("id", F.col("content_hash").alias("n"))
    return o.join(n, "id", "full_outer").select("id", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") == F.col("n"), "same").otherwise("changed").alias("change"))
