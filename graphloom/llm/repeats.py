"""Repeated byte strings: windows meet by their minimiser, and each shard of them is suffix-sorted by induction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import induced
from .common import cut, own_dir, parts, table

WINDOW, GRAM = 400, 96
#: Bytes of spans that one task sorts at a time, and bytes of one minimiser's spans beyond which its windows are counted by digest.
SHARD, HOT = 6 << 20, 12 << 20
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _BASE, np.uint64)), np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))


def spans(data: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first, last, whether the minimiser's gram is in the span twice) of the runs of window starts that share one minimiser.

    A window's minimiser is the least hash of the grams within it and so depends on
    the window's bytes alone: equal windows have equal minimisers, wherever they are.
    """
    n = len(data)
    if n < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    power, inverse = _powers(1 << max(16, (n + 1).bit_length()))
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * power[:n], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    w = window - gram + 1
    rows = -(-len(h) // w)
    grid = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(h)] = h
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - window + 1
    least = np.minimum(back[:m], ahead[w - 1 : w - 1 + m])
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    a, last = least[first], np.concatenate([first[1:], [m]]) - 1
    own = np.zeros(len(a), bool)
    values, counts = np.unique(h[np.isin(h, a)], return_counts=True)
    for r in np.flatnonzero(np.isin(a, values[counts > 1])).tolist():
        own[r] = np.count_nonzero(h[first[r] : last[r] + w] == a[r]) > 1
    return a, first, last, own


_SPANS = "k1 long, k2 long, a long, nb long, lo int, hi int, own boolean"


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        for x in b.column(0):
            data = x.as_py()
            a, lo, hi, own = spans(data)
            if not len(a):
                continue
            key = np.frombuffer(hashlib.md5(data).digest(), np.int64)
            nb = np.fromiter((xxhash.xxh3_64_intdigest(data[s : e + WINDOW]) for s, e in zip(lo.tolist(), hi.tolist(), strict=True)), np.uint64, len(lo))
            for c, v in zip(cols, (np.full(len(a), key[0]), np.full(len(a), key[1]), a.view(np.int64), nb.view(np.int64), lo.astype(np.int32), hi.astype(np.int32), own), strict=True):
                c.append(v)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["k1", "k2", "a", "nb", "lo", "hi", "own"])


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with the two halves of their text's MD5, by which texts are known; ids may be null or repeat."""
    half = lambda i: F.expr(f"cast(conv(substring(_md5, {1 + 16 * i}, 16), 16, -10) as bigint)")
    # md5().digest() read as two little-endian numbers
    swap = F.regexp_replace(F.md5("data"), "(..)(..)(..)(..)(..)(..)(..)(..)", "$8$7$6$5$4$3$2$1")
    return docs.withColumn("_md5", swap).withColumns({"k1": half(0), "k2": half(1)}).drop("_md5")


def _texts(docs: DataFrame) -> DataFrame:
    """k1, k2, data of distinct texts: copies, however many, meet as one of each map task."""
    return _keyed(docs.select("data")).groupBy("k1", "k2").agg(F.first("data").alias("data"))


_PIECES = "a long, nb long, n long, data binary"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (data, wanted array<struct<a,nb,n,lo,hi>>) to the bytes of each wanted span."""
    for b in batches:
        out: list[tuple] = []
        for x, wanted in zip(b.column("data"), b.column("wanted"), strict=True):
            data = x.as_buffer()
            view = memoryview(data)
            out += [(w["a"], w["nb"], w["n"], bytes(view[w["lo"] : w["hi"] + WINDOW])) for w in wanted.as_py()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["a", "nb", "n", "data"])


def repeated_windows(texts: list[bytes], counts: list[int], folder: str | None = None, memory: int = induced.MEMORY, stats: dict | None = None) -> list[list[tuple[int, int]]]:
    """For each text, the runs (first, last) of window starts whose window is elsewhere too, the text itself standing `counts` times.

    The texts are joined to one and its suffixes sorted; windows that are equal
    stand side by side with a common prefix of a window's length. A window across two
    texts holds the mark between them, so it is equal to none that lies within one.
    """
    used = sorted(set().union(*map(set, texts)))
    if len(used) <= 253:
        step, code = 1, bytearray(256)
        for i, x in enumerate(used):
            code[x] = i + 2
        coded = (t.translate(bytes(code)) for t in texts)
    else:  # more kinds of byte: two symbols a byte keep order and alignment
        step, halves = 2, [bytes((x >> 4, x & 15)).translate(bytes(range(2, 256)) + bytes(2)) for x in range(256)]
        coded = (b"".join(map(halves.__getitem__, t)) for t in texts)
    text = np.frombuffer(b"\x01".join(coded) + b"\x01" + bytes(9), np.uint8)
    window, again = WINDOW * step, np.zeros(len(text), bool)
    last = None
    for pos, lcp in induced.suffixes(text, window, folder, memory, stats):
        same = lcp >= window
        if same[0]:
            again[last] = True
        again[pos[same]] = True
        again[pos[:-1][same[1:]]] = True
        last = pos[-1]
    out, at = [], 0
    for t, n in zip(texts, counts, strict=True):
        size = len(t) * step
        m = size - window + 1
        here = np.ones(len(t) - WINDOW + 1, bool) if n > 1 and m > 0 else again[at : at + max(m, 0) : step]
        edge = np.flatnonzero(np.diff(here, prepend=False, append=False))
        out.append([*zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True)])
        at += size + 1
    return out


def _sorter(work: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, a, nb, n, data), sorted by shard and a, to (nb, a, first, last) of windows that repeat."""

        def sort(held: dict[tuple[int, int], tuple[int, bytes]]) -> pa.RecordBatch:
            keys = [*held]
            got = repeated_windows([held[k][1] for k in keys], [held[k][0] for k in keys], work)
            rows = [(a, nb, s, e) for (a, nb), runs in zip(keys, got, strict=True) for s, e in runs]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["a", "nb", "s", "e"])

        held: dict[tuple[int, int], tuple[int, bytes]] = {}
        size, last = 0, None
        for b in batches:
            for a, nb, n, data in zip(*(b.column(c).to_pylist() for c in ("a", "nb", "n", "data")), strict=True):
                if a != last and size >= SHARD:  # a minimiser's spans stay together
                    yield sort(held)
                    held, size = {}, 0
                last = a
                if (a, nb) not in held:
                    held[a, nb] = (n, data)
                    size += len(data)
        if held:
            yield sort(held)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, nb, n, data) to each window's digest and place."""
    for b in batches:
        for a, nb, n, data in zip(*(b.column(c).to_pylist() for c in ("a", "nb", "n", "data")), strict=True):
            m = len(data) - WINDOW + 1
            view = memoryview(data)
            yield pa.RecordBatch.from_arrays([pa.array([a] * m), pa.array([nb] * m), pa.array([n] * m), pa.array(range(m), pa.int64()), pa.array([xxhash.xxh3_128_digest(view[i : i + WINDOW]) for i in range(m)], pa.binary())], names=["a", "nb", "n", "s", "digest"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for x, gaps in zip(b.column("data"), b.column("gaps"), strict=True):
            data = memoryview(x.as_buffer())
            kept, removed, n, at = hashlib.sha256(), 0, 0, 0
            for s, e in sorted((g["s"], g["e"]) for g in gaps.as_py() or []):
                if e <= at:
                    continue
                if s > at or not n:
                    kept.update(data[at:s])
                    n += 1
                removed += e - max(s, at)
                at = e
            kept.update(data[at:])
            rows.append((len(data), removed, n, kept.hexdigest()))
        cols = [*zip(*rows, strict=True)] if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, work: str) -> DataFrame:
    """docs (data binary) to k1, k2, s, e: by text, the byte ranges that repeated windows cover (they may overlap).

    1. Windows are put into spans by minimiser; a minimiser whose gram occurs once
       has no repeated window. 2. A span that occurs twice repeats as a whole. 3. Of
       minimisers with several different spans, or twice in one, one copy of each span is sorted with
       the others of its shard; of a minimiser with too many for a task, windows are
       counted by digest. Spans are shared out by minimiser, so shards are
       independent, and a lost one is sorted again alone.
    """
    spark = docs.sparkSession
    rows = docs.where(F.octet_length("data") >= WINDOW).select("data").mapInArrow(_span_rows, _SPANS)
    rows.write.parquet(f"{work}/spans")
    rows = spark.read.parquet(f"{work}/spans")
    many = rows.groupBy("a").agg(F.count("*").alias("c"), F.max("own").alias("own")).where("c > 1 or own").select("a")
    rows.join(many, "a", "left_semi").write.parquet(f"{work}/many")
    rows = spark.read.parquet(f"{work}/many")
    by = rows.groupBy("a", "nb").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "lo", "hi")).alias("one"), F.max("own").alias("own"))
    kinds = by.groupBy("a").agg(F.count("*").alias("kinds"), F.sum(F.col("one.hi") - F.col("one.lo") + WINDOW).alias("bytes"))
    by = cut(by.join(kinds, "a"))
    wanted = by.where("kinds > 1 or own").select("one.k1", "one.k2", F.struct("a", "nb", "n", "one.lo", "one.hi").alias("w")).groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted"))
    pieces = _texts(docs.where(F.octet_length("data") >= WINDOW)).join(wanted, ["k1", "k2"]).select("data", "wanted").mapInArrow(_slices, _PIECES)
    hot = by.where(F.col("bytes") > HOT).select("a").distinct()
    hot_n = hot.count()
    total = by.where("kinds > 1 or own").agg(F.coalesce(F.sum(F.col("one.hi") - F.col("one.lo") + WINDOW), F.lit(0))).first()[0]
    n = max(parts(spark), -(-int(total) // SHARD))
    if hot_n:
        pieces.write.parquet(f"{work}/pieces")
        pieces = spark.read.parquet(f"{work}/pieces").dropDuplicates(["a", "nb"])
        cold = pieces.join(hot, "a", "left_anti")
    else:
        cold = pieces
    found = cold.repartition(n, "a").sortWithinPartitions("a").mapInArrow(_sorter(work), "a long, nb long, s long, e long")
    if hot_n:
        each = pieces.join(hot, "a", "left_semi").repartition(4 * parts(spark)).mapInArrow(_digests, "a long, nb long, n long, s long, digest binary")
        twice = each.groupBy("a", "digest").agg(F.sum("n").alias("t")).where("t > 1").select("a", "digest")
        found = found.unionByName(each.join(twice, ["a", "digest"], "left_semi").select("a", "nb", "s", F.col("s").alias("e")))
    part = found.join(rows.select("a", "nb", "k1", "k2", "lo").distinct(), ["a", "nb"]).select("k1", "k2", (F.col("lo") + F.col("s")).alias("s"), (F.col("lo") + F.col("e") + WINDOW).alias("e"))
    whole = rows.join(by.where("n > 1").select("a", "nb"), ["a", "nb"], "left_semi").select("k1", "k2", F.col("lo").cast("long").alias("s"), (F.col("hi") + WINDOW).cast("long").alias("e"))
    return part.union(whole).distinct()


def remove_repeats(docs: DataFrame, work: str) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_bytes, n_removed, n_spans, kept_sha256; a row for each row.

    A byte goes if a window of 400 bytes that covers it also starts anywhere else,
    in this or another row, overlapping or not. Repeated rows are other rows, also
    of one id; null ids stay. A null text is empty. Texts of under 400 bytes have
    no window. Each distinct text is cut and digested once; rows meet its result. An empty table gives an empty one.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    gaps = repeated_spans(d, work).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("gaps"))
    done = _texts(d).join(gaps, ["k1", "k2"], "left").mapInArrow(_apply, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return _keyed(d).select("doc_id", "k1", "k2").join(done, ["k1", "k2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op1_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document; nulls, repeats and empty tables as in remove_repeats()."""
    return remove_repeats(table(spark, sf_dir, "documents"), own_dir(spark, "repeats"))
