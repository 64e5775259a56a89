"""SimHash near-duplicates: a byte-position inverted index with count filtering."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut, free, table
from .components import components

SEED, SHINGLE = 42, 3
#: Fingerprints of 8 bytes that differ in at most 3 bits share at least 5 bytes in place.
BITS, SHARED = 3, 5
#: Places of the bytes of a posting's key. A list of one positional byte would hold a 256th of all fingerprints, so postings are of four.
GRAM = 4
PLACES = [*combinations(range(8), GRAM)]
#: Postings in common of a pair that shares the guaranteed bytes: a pair with k bytes in place shares k over GRAM.
LEAST = math.comb(SHARED, GRAM)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MASKS = [_signed(sum(0xFF << 8 * i for i in p)) for p in PLACES]


def fingerprint(text: str | None) -> int:
    """The signed 64-bit SimHash of a text; 0 where it has no word."""
    words = (text or "").encode().lower().split()  # ASCII only, as is the white space of bytes.split
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(flat, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
        hashes = [xxhash.xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array([fingerprint(x.as_py()) for x in b.column("text")], pa.int64())], names=["doc_id", "tie", "fp"])


def prints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, tie (the text's xxhash64), fp; a row for each row."""
    d = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")
    return d.mapInArrow(_prints, "doc_id long, tie long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """fps (fp, distinct) to the pairs a < b that differ in at most 3 bits, each once.

    An inverted index over bytes in their positions: a posting list is known by four
    places and the bytes there. Every pair of a list counts one; a pair's tally tells
    how many bytes it shares in place, and those that reach the count of the
    guaranteed five are verified by their bits.
    """
    lists = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in MASKS])).alias("places", "bytes"))
    left, right = lists.withColumnRenamed("fp", "a"), lists.withColumnRenamed("fp", "b")
    met = left.join(right, ["places", "bytes"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("tally"))
    return met.where((F.col("tally") >= LEAST) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)).select("a", "b")


def groups(rows: DataFrame) -> DataFrame:
    """rows (doc_id, fp) to one row a fingerprint: fp, n_near, component_id."""
    by = cut(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")))
    pairs = cut(links(by.select("fp")))
    both = pairs.union(pairs.select("b", "a")).toDF("fp", "other")
    near = both.join(by.select(F.col("fp").alias("other"), "n"), "other").groupBy("fp").agg(F.sum("n").alias("others"))
    of = by.join(components(pairs).withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    low = of.groupBy("component").agg(F.min("low").alias("component_id"))
    return of.join(low, "component").join(near, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), "component_id", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, fingerprint, n_near, component_id; a row for each row.

    Texts without words (null, empty, blank) have fingerprint 0 and link like any
    other. Repeated rows, also of one id, count as others. A null id is passed over
    in component_id, which is null only where all ids of a component are. An empty
    table gives an empty one. Documents of one fingerprint are one node, so copies
    are never paired.
    """
    rows = cut(prints(docs).select("doc_id", "fp"))
    return rows.join(groups(rows), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document; nulls, repeats and empty tables as in near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that with the least id, then text hash; one without id only where no other is there.

    Null, empty and blank texts are copies of one another. Rows that repeat id and
    text are one document. An empty table gives an empty one; further columns stay.
    """
    rows = cut(prints(docs))
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    keep = rows.join(groups(rows).select("fp", "component"), "fp").groupBy("component").agg(F.min(best).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.tie").alias("_t"))
    own = docs.columns
    (tie,) = free(docs, "_tie")
    d = docs.withColumn(tie, F.xxhash64("text"))
    keep = keep.select(F.col("_id").alias(f"{tie}_id"), F.col("_t").alias(f"{tie}_t"))
    return d.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{tie}_id")) & (F.col(tie) == F.col(f"{tie}_t")), "left_semi").dropDuplicates(["doc_id", tie]).select(*map(col, own))
