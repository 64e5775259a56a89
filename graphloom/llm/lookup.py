"""A table of distinct strings in the shared folder that workers map into memory and search by hash."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files of the table, by the leading bits of the hash.
BUCKETS = 256


def save(system: fs.FileSystem, path: str, array: np.ndarray) -> None:
    at = f"{path}.{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(at) as out:
        out.write(np.ascontiguousarray(array).tobytes())
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_file(path)  # of an attempt that was lost
    system.move(at, path)


@lru_cache(maxsize=4096)
def load(to: str, name: str, dtype: str) -> np.ndarray:
    """A file of the table: mapped where the folder is mounted, else read."""
    system, root = fs.FileSystem.from_uri(to)
    info = system.get_file_info(f"{root}/{name}")
    if info.type == fs.FileType.NotFound or not info.size:
        return np.empty(0, dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(info.path, dtype, "r").view(np.ndarray)
    with system.open_input_stream(info.path) as s:
        return np.frombuffer(s.read(), dtype)


def write(rows: DataFrame, to: str, n: int) -> int:
    """rows (key string, distinct; value binary) to files in the folder; returns the number of keys.

    Keys are told apart by their xxhash64 and their crc32.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(to)
        held, bucket, total = [], None, 0

        def flush() -> None:
            h = np.concatenate([x[0] for x in held])
            order = np.argsort(h, kind="stable")
            sizes = np.concatenate([x[2] for x in held])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            blob = b"".join(x[3] for x in held)
            ends = np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.uint32)
            save(system, f"{root}/{bucket:03d}.hash", h[order])
            save(system, f"{root}/{bucket:03d}.check", np.concatenate([x[1] for x in held])[order])
            save(system, f"{root}/{bucket:03d}.ends", ends)
            save(system, f"{root}/{bucket:03d}.blob", np.frombuffer(b"".join(blob[a : a + k] for a, k in zip(starts[order].tolist(), sizes[order].tolist(), strict=True)), np.uint8))

        for b in batches:
            of, h, c = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy().astype(np.uint32)
            values = b.column(3).to_pylist()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if bucket is not None and of[x] != bucket:
                    flush()
                    held = []
                bucket = int(of[x])
                held.append((h[x:y], c[x:y], np.fromiter(map(len, values[x:y]), np.int64, y - x), b"".join(values[x:y])))
                total += y - x
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    system, root = fs.FileSystem.from_uri(to)
    system.create_dir(root, recursive=True)
    h = F.xxhash64("key")
    rows = rows.select(F.shiftrightunsigned(h, 56).cast("int").alias("of"), h.alias("h"), F.crc32(F.col("key").cast("binary")).alias("c"), "value")
    return rows.repartition(min(n, BUCKETS), "of").sortWithinPartitions("of").mapInArrow(store, "n long").agg(F.sum("n")).first()[0] or 0


@lru_cache(maxsize=4096)
def _blob(to: str, b: int) -> memoryview:
    return memoryview(load(to, f"{b:03d}.blob", "u1"))


def places(to: str, keys: Sequence[bytes]) -> np.ndarray:
    """The place of each key among all keys by hash, -1 where it is not in the table."""
    n = len(keys)
    h = np.fromiter(map(xxhash.xxh64_intdigest, keys, repeat(42)), np.uint64, n)
    c = np.fromiter(map(zlib.crc32, keys), np.uint32, n)
    out = np.full(n, -1, np.int64)
    order = np.argsort(h)
    of = (h[order] >> np.uint64(56)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), n]
    start = starts(to)
    for x, y in zip(cuts, cuts[1:], strict=False):
        if x == y:
            continue
        b, ask = int(of[x]), order[x:y]
        there = load(to, f"{b:03d}.hash", "u8")
        if not len(there):
            continue
        at = np.minimum(np.searchsorted(there, h[ask]), len(there) - 1)
        hit = (there[at] == h[ask]) & (load(to, f"{b:03d}.check", "u4")[at] == c[ask])
        out[ask[hit]] = start[b] + at[hit]
    return out


@lru_cache(maxsize=16)
def starts(to: str) -> np.ndarray:
    """The place of the first key of each file, and the number of keys."""
    return np.concatenate([[0], np.cumsum([len(load(to, f"{b:03d}.hash", "u8")) for b in range(BUCKETS)])])


def find(to: str, keys: Sequence[bytes]) -> list[bytes | None]:
    """The value of each key, None where there is none."""
    out: list[bytes | None] = [None] * len(keys)
    at, start = places(to, keys), starts(to)
    asked = np.flatnonzero(at >= 0)
    asked = asked[np.argsort(at[asked])]
    of = np.searchsorted(start, at[asked], "right") - 1
    cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
    for x, y in zip(cuts, cuts[1:], strict=False):
        if x == y:
            continue
        b, ask = int(of[x]), asked[x:y]
        ends, blob = load(to, f"{b:03d}.ends", "u4"), _blob(to, b)
        own = at[ask] - start[b]
        for i, a, e in zip(ask.tolist(), ends[own].tolist(), ends[own + 1].tolist(), strict=True):
            out[i] = bytes(blob[a:e])
    return out


def slices(to: str, keys: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the keys in one array of bytes, with where each begins (-1: not in the table) and its size."""
    at, begin = places(to, keys), starts(to)
    where, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    asked = np.flatnonzero(at >= 0)
    asked = asked[np.argsort(at[asked])]
    of = np.searchsorted(begin, at[asked], "right") - 1
    cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
    flat, total = [], 0
    for x, y in zip(cuts, cuts[1:], strict=False):
        if x == y:
            continue
        b, ask = int(of[x]), asked[x:y]
        own = at[ask] - begin[b]
        ends = load(to, f"{b:03d}.ends", "u4")
        a, n = ends[own].astype(np.int64), ends[own + 1].astype(np.int64) - ends[own]
        before = np.cumsum(n) - n
        flat.append(load(to, f"{b:03d}.blob", "u1")[np.repeat(a - before, n) + np.arange(int(n.sum()))])
        where[ask], size[ask] = total + before, n
        total += int(n.sum())
    return (np.concatenate(flat) if flat else np.empty(0, np.uint8)), where, size


def numbers(to: str, at: np.ndarray, dtype: str = "<i8") -> np.ndarray:
    """Values of a fixed size, as numbers, of places in ascending order."""
    start = starts(to)
    of = np.searchsorted(start, at, "right") - 1
    out = np.empty(len(at), dtype)
    cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
    for x, y in zip(cuts, cuts[1:], strict=False):
        if x != y:
            b = int(of[x])
            out[x:y] = load(to, f"{b:03d}.blob", "u1").view(dtype)[at[x:y] - start[b]]
    return out
