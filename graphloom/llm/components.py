"""Connected components by large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one union-find holds at a time.
BLOCK = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block of links becomes a star about the least id of each of its components."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (p := up.get(top, top)) != top:
                top = p
            while x != top:
                up[x], x = top, up.get(x, x)
            return top

        for b in held:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                up[max(x, y)] = min(x, y)
        ends = [x for x in up if up[x] != x]
        return pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array([root(x) for x in ends], pa.int64())], names=["a", "b"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BLOCK:
            yield stars(held)
            held, n = [], 0
    if held:
        yield stars(held)


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) to (id, component): the least id that each linked id can reach.

    Ids without a link are not in the result; null ids, loops, repeated links and
    either order are allowed. Links are first contracted within partitions, then
    rounds of large-star and small-star run until the star's edges stay the same.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges = cut(edges.mapInArrow(_forest, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).where("a <> b")
        edges = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
