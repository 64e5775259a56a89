"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import col, crc_mod, free, table

#: Cells that words are hashed to; further features follow them.
CELLS = 1 << 15
RANK, EPOCHS, BATCH, RATE = 8, 12, 128, 0.05
DECAY = 1e-5
#: Labelled rows of each class that the machine learns from, those of least id hash: the bound of what goes to the driver.
LEARN = 4000
CUT = 0.3
N_STATS = 14


def _stats(text: str, words: list[bytes], counts: Counter, n_chars: int | None) -> list[float]:
    """Shape of a text, each about 0 to 1."""
    n, w = len(text), len(words)
    lines = text.split("\n")
    some = max(1, n)
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    digit = sum(map(str.isdigit, text))
    space = sum(map(str.isspace, text))
    top = counts.most_common(1)[0][1] if counts else 0
    pairs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        math.log1p(n) / 12,
        math.log1p(n if n_chars is None else max(0, n_chars)) / 12,
        letters / some,
        upper / max(1, letters),
        digit / some,
        space / some,
        (n - letters - digit - space) / some,
        len(counts) / max(1, w),
        top / max(1, w),
        pairs / max(1, w - 1),
        min(1.0, sum(map(len, words)) / max(1, w) / 20),
        1 - len(set(lines)) / len(lines),
        sum(x[-1:] in (b".", b",", b"!", b"?", b";", b":") for x in words) / max(1, w),
        sum(x.isalpha() for x in words) / max(1, w),
    ]


def features(text: str | None, n_chars: int | None, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features: tempered, length-normalised word counts; statistics; their bins."""
    text = text or ""
    words = text.encode("utf-8", "replace").lower().split()
    counts = Counter(words)
    at: dict[int, float] = {}
    for k, c in counts.items():
        i = xxhash.xxh32_intdigest(k) % cells
        at[i] = at.get(i, 0.0) + math.log1p(c)
    norm = math.sqrt(sum(v * v for v in at.values())) or 1.0
    stats = _stats(text, words, counts, n_chars)
    place = [*at, *(cells + i for i in range(N_STATS)), *(cells + N_STATS + 10 * i + min(9, max(0, int(v * 10))) for i, v in enumerate(stats))]
    value = [*(v / norm for v in at.values()), *stats, *[1.0 / math.sqrt(N_STATS)] * N_STATS]
    return np.array(place, np.int32), np.array(value, np.float32)


@dataclass
class Machine:
    """w0 + <w, x> + sum over pairs of <v_i, v_j> x_i x_j."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, places: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
        """Scores before the logistic curve; linear time: pairs are half of (sum v x)^2 - sum (v x)^2."""
        sizes = np.fromiter(map(len, places), np.int64, len(places))
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        i, x = np.concatenate(places), np.concatenate(values)
        vx = self.v[i] * x[:, None]
        s = np.add.reduceat(vx, at, axis=0)
        q = np.add.reduceat((vx * vx).sum(axis=1), at)
        return self.w0 + np.add.reduceat(self.w[i] * x, at) + 0.5 * ((s * s).sum(axis=1) - q)

    def score(self, places: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
        if not places:
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(places, values).astype(np.float64), -30, 30)))


def fit(places: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, weight: np.ndarray, size: int, rank: int = RANK, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss, the same run for the same rows."""
    rnd = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(size, np.float32), (rnd.standard_normal((size, rank)) * 0.02).astype(np.float32))
    g0, gw, gv = 1e-6, np.full(size, 1e-6, np.float32), np.full((size, rank), 1e-6, np.float32)
    for _ in range(epochs):
        order = rnd.permutation(len(y))
        for b in range(0, len(y), BATCH):
            rows = order[b : b + BATCH]
            p, v = [places[r] for r in rows], [values[r] for r in rows]
            sizes = np.fromiter(map(len, p), np.int64, len(p))
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            err = (m.score(p, v) - y[rows]) * weight[rows] / len(rows)
            i, x = np.concatenate(p), np.concatenate(v)
            own, where = np.unique(i, return_inverse=True)
            e = np.repeat(err, sizes).astype(np.float32)
            vx = m.v[i] * x[:, None]
            s = np.repeat(np.add.reduceat(vx, at, axis=0), sizes, axis=0)
            dv = (e * x)[:, None] * (s - vx)
            dw = np.bincount(where, e * x, len(own)).astype(np.float32) + DECAY * m.w[own]
            dv = np.stack([np.bincount(where, dv[:, k], len(own)) for k in range(rank)], axis=1).astype(np.float32) + DECAY * m.v[own]
            d0 = float(err.sum())
            g0 += d0 * d0
            gw[own] += dw * dw
            gv[own] += dv * dv
            m.w0 -= RATE * d0 / math.sqrt(g0)
            m.w[own] -= RATE * dw / np.sqrt(gw[own])
            m.v[own] -= RATE * dv / np.sqrt(gv[own])
    return m


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t.as_py(), n.as_py()) for t, n in zip(b.column("text"), b.column("n_chars"), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary()), b.column("y")], names=["p", "v", "y"])


def train(docs: DataFrame, labels: DataFrame, learn: int = LEARN, cells: int = CELLS) -> Machine:
    """Learns labels.quality from the rows whose id's crc32 is no multiple of 5.

    At most `learn` rows of each class, those of least id hash, are turned to
    vectors and brought to the driver; classes weigh the same in sum, then by their
    share among all labelled rows through the intercept. Without both classes the
    machine is a constant: the share of label 1, or 0.5.
    """
    of = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    of = of.where(crc_mod(F.col("doc_id"), 5) != 0)
    count = {r["y"]: r["count"] for r in of.groupBy("y").count().collect()}
    size = cells + N_STATS * 11
    share = count.get(1, 0) / max(1, sum(count.values())) if count else 0.5
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    known = docs.select(F.col("doc_id").cast("long"), F.col("text"), n.alias("n_chars"))
    picked = None
    if len(count) == 2:
        ids = known.select("doc_id").join(of, "doc_id").distinct()
        parts = [ids.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(learn) for k in (0, 1)]
        rows = [(r.doc_id, r.y) for p in parts for r in p.collect()]  # at most 2 * learn ids
        picked = docs.sparkSession.createDataFrame(rows, "doc_id long, y int") if len({y for _, y in rows}) == 2 else None
    if picked is None:
        return Machine(math.log((share + 1e-6) / (1 - share + 1e-6)), np.zeros(size, np.float32), np.zeros((size, 1), np.float32))
    got = known.join(F.broadcast(picked), "doc_id").select("text", "n_chars", "y").mapInArrow(_vectors, "p binary, v binary, y int").toArrow()
    p, v = ([x.as_buffer() for x in got.column(c)] for c in ("p", "v"))  # views of the table, no copies
    order = sorted(range(len(p)), key=lambda i: (xxhash.xxh3_128_digest(p[i]), xxhash.xxh3_128_digest(v[i])))
    places, values = [np.frombuffer(p[i], np.int32) for i in order], [np.frombuffer(v[i], np.float32) for i in order]
    y = got.column("y").to_numpy()[order].astype(np.float64)
    ones = y.mean()
    weight = np.where(y == 1, 0.5 / ones, 0.5 / (1 - ones))
    m = fit(places, values, y, weight, size)
    m.w0 += math.log(share / (1 - share))
    return m


def scored(docs: DataFrame, machine: Machine, name: str = "_score") -> DataFrame:
    """docs with the score in front, under a name that the table lacks; a row for each row.

    Null and empty texts have a score by their statistics; without n_chars, or where
    it is null, the text's own length counts.
    """
    held = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*held.value)
        for b in batches:
            score = []
            texts, sizes = b.column("text"), b.column(b.num_columns - 1)
            for at in range(0, b.num_rows, 256):
                rows = [features(texts[i].as_py(), sizes[i].as_py()) for i in range(at, min(at + 256, b.num_rows))]
                score.append(m.score([p for p, _ in rows], [v for _, v in rows]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(score) if score else [], pa.float64()), *b.columns], names=[name, *b.schema.names])

    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    d = docs.withColumn(free(docs, "_n")[0], n)
    return d.mapInArrow(run, StructType([StructField(name, DoubleType()), *d.schema.fields])).drop(d.columns[-1])


def op4_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document scored by what the rows that are not held out teach; nulls and empty tables as in scored() and train()."""
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text", "n_chars"), machine)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go.

    Each row is judged by its own text and length: null and empty texts by their
    statistics, repeated rows alike, null ids like others. Without labels of both
    classes all rows are judged alike. An empty table gives an empty one; further
    columns stay.
    """
    machine = train(docs, table(spark, sf_dir, "labels"))
    (name,) = free(docs, "_score")
    return scored(docs, machine, name).where(F.col(name) >= CUT).select(*map(col, docs.columns))
