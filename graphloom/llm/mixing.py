"""Mixing sources to target weights along a time-varying curriculum; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, col, table

WEIGHTS = (5, 2, 1)
#: Slope of each source's weight over training time, by the place of the source; the weight's integral stays its target.
RAMPS = (-0.5, 0.0, 0.5)
CAP = 3
#: Hexadecimal digits of a document's digest that part a source, so that none, however large, is one task's work.
DIGITS = 3


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, ramps: Sequence[float] = RAMPS, cap: int = CAP) -> DataFrame:
    """sizes (source, s) to (source, s, target, ramp): shares by weight, none above cap times its source.

    Sorted by size for its weight, the sources at their cap come first, so the level
    at which the rest share follows from running sums. The table has a row a source.
    """
    name, line = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("need", "place")
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(0, Window.unboundedFollowing)
    place = F.row_number().over(name) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("place") % len(values) + 1).cast("int"))
    level = F.col("left") / F.col("w_left").cast("double")
    return (
        sizes.withColumn("place", place)
        .withColumns({"w": pick(weights), "ramp": pick([float(x) for x in ramps])})
        .withColumn("need", F.col("s").cast("double") / F.col("w"))
        .withColumns({"total": F.sum("s").over(Window.partitionBy()), "w_left": F.sum("w").over(after), "taken_up": F.coalesce(F.sum("s").over(before), F.lit(0)), "rank": F.row_number().over(line)})
        .withColumn("left", (F.col("total") - cap * F.col("taken_up")).cast("double"))
        .withColumn("level", level)
        .withColumn("open", F.col("w") * F.col("level") <= (cap * F.col("s")).cast("double"))
        .withColumn("first", F.min(F.when(F.col("open"), F.struct("rank", "level"))).over(Window.partitionBy()))
        .withColumn("target", F.when(F.col("rank") >= F.col("first.rank"), F.col("w") * F.col("first.level")).otherwise((cap * F.col("s")).cast("double")))
        .select("source", "s", "target", "ramp")
    )


def when(share: Column, ramp: Column) -> Column:
    """The time at which the share of a source's demand is used up: the root of t + ramp (t^2 - t) = share."""
    b = 1 - ramp
    return F.when(ramp == 0, share).otherwise((F.sqrt(b * b + 4 * ramp * share) - b) / (2 * ramp))


def plan(docs: DataFrame, *carry: str, weights: Sequence[int] = WEIGHTS, ramps: Sequence[float] = RAMPS, cap: int = CAP, digits: int = DIGITS) -> DataFrame:
    """docs (doc_id, text, source) to carry with _size, _source_size, _target, _taken, _ramp, _at (words of its source before it).

    A source's documents stand in the order of their ids' digests and are read up to
    cap times over until the source's target, rounded down, is reached: the
    cumulative demand decides what each gives, the last one giving a part.
    Running sums come from sums by (source, leading digits) and a window inside
    each. Null text: size 0; null source: a source of its own, last; null id: as the
    empty id. Repeated rows count each; an empty table gives an empty one.
    """
    return _planned(docs, *carry, weights=weights, ramps=ramps, cap=cap, digits=digits).select("own.*", *PLAN)


PLAN = ("_size", "_source_size", "_target", "_taken", "_ramp", "_at")


def _planned(docs: DataFrame, *carry: str, weights: Sequence[int] = WEIGHTS, ramps: Sequence[float] = RAMPS, cap: int = CAP, digits: int = DIGITS) -> DataFrame:
    """As plan(), with the columns to carry in a struct, so that their names meet no others."""
    d = docs.select(
        F.struct(*map(col, carry)).alias("own"),
        F.col("source").alias("_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_key"),
        F.xxhash64("text").alias("_tie"),
    ).withColumn("_part", F.substring("_key", 1, digits))
    sums = d.groupBy("_source", "_part").agg(F.sum("_size").alias("_in"))
    by = targets(sums.groupBy(F.col("_source").alias("source")).agg(F.sum("_in").alias("s")), weights, ramps, cap)
    w = Window.partitionBy("_source").orderBy("_part")
    heads = sums.withColumn("_head", F.sum("_in").over(w) - F.col("_in")).join(by, F.col("_source").eqNullSafe(by["source"])).select("_source", "_part", "_head", "s", "target", "ramp")
    heads = heads.select(*[F.col(c).alias(f"h{c}") for c in heads.columns])
    inside = Window.partitionBy("_source", "_part").orderBy("_key", "_size", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_run", F.sum("_size").over(inside) - F.col("_size"))
    d = d.join(heads, F.col("_source").eqNullSafe(F.col("h_source")) & (F.col("_part") == F.col("h_part")))
    at, s, budget = F.col("h_head") + F.col("_run"), F.col("hs"), F.floor("htarget").cast("long")
    give = lambda j: F.greatest(F.lit(0), F.least(F.col("_size"), budget - j * s - at))
    taken = give(0)
    for j in range(1, cap):
        taken = taken + give(j)
    return d.select("own", "_size", s.alias("_source_size"), F.col("htarget").alias("_target"), taken.cast("long").alias("_taken"), F.col("hramp").alias("_ramp"), at.alias("_at"))


def position(reading: Column | int = 0) -> Column:
    """Training time, 0 to 1, at which the given reading of a planned document starts; null beyond its source's demand."""
    start = (F.col("_at") + F.lit(reading) * F.col("_source_size")) / F.col("_target")
    return F.when((F.col("_target") > 0) & (start <= 1), when(start, F.col("_ramp")))


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in the order in which the mix reads it; nulls, repeats and empty tables as in plan()."""
    return (
        plan(table(spark, sf_dir, "documents"), "doc_id")
        .select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), (F.round(position(), 9) + 0.0).alias("position"))
        .orderBy("position", "doc_id", "size")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row is there once for each time the mix reads it, whole also where the last reading is cut.

    Null and empty texts have size 0 and are read once; a null source is one of its
    own; null ids and repeated rows count like others. An empty table gives an empty
    one; further columns stay.
    """
    times = F.when(F.col("_size") == 0, (F.col("_target") > 0).cast("int")).otherwise(F.ceil(F.col("_taken") / F.col("_size"))).cast("int")
    d = _planned(docs, *docs.columns).where(times > 0).withColumn("_reading", F.explode(F.sequence(F.lit(0), times - 1)))
    d = d.withColumn("_position", position(F.col("_reading")))
    return d.repartitionByRange("_position", "own.doc_id").sortWithinPartitions("_position", "own.doc_id").select("own.*")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(place % 3 + 1)::INT] AS w, [-0.5, 0.0, 0.5][(place % 3 + 1)::INT]::DOUBLE AS ramp FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY s::DOUBLE / w, place) AS r FROM w),
l AS (SELECT a.*, ((SELECT sum(s) FROM o)::BIGINT - 3 * coalesce((SELECT sum(b.s) FROM o b WHERE b.r < a.r), 0)::BIGINT)::DOUBLE
             / (SELECT sum(b.w) FROM o b WHERE b.r >= a.r)::DOUBLE AS level FROM o a),
f AS (SELECT r AS fr, level AS fl FROM l WHERE w * level <= (3 * s)::DOUBLE ORDER BY r LIMIT 1),
t AS (SELECT l.*, CASE WHEN r >= fr THEN w * fl ELSE (3 * s)::DOUBLE END AS target FROM l LEFT JOIN f ON true),
c AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS pos FROM d),
j AS (SELECT c.doc_id, c.size, t.s, t.target, t.ramp, c.pos, floor(t.target)::BIGINT AS b FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN target > 0 AND pos / target <= 1 THEN pos / target END AS share FROM j)
SELECT doc_id, size, s AS source_size, target,
  (greatest(0, least(size, b - pos)) + greatest(0, least(size, b - s - pos)) + greatest(0, least(size, b - 2 * s - pos)))::BIGINT AS taken,
  round(CASE WHEN ramp = 0 THEN share ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * share) - (1 - ramp)) / (2 * ramp) END, 9) + 0.0 AS position
FROM p
"""
