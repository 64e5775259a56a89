import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import ngram
from graphloom.llm.eliasfano import EliasFano, Grouped, encode, grouped

from . import cases


def crc(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows):
    one, two, three = Counter(), Counter(), Counter()
    for d, t in rows:
        if crc(d) != 2:
            w = [None, None, *words(t), None]
            one.update(w[2:])
            two.update(zip(w[1:], w[2:]))
            three.update(zip(w, w[1:], w[2:]))
    of1, kinds1, of2, kinds2 = Counter(), Counter(), Counter(), Counter()
    for (a, _), n in two.items():
        of1[a] += n
        kinds1[a] += 1
    for (a, b, _), n in three.items():
        of2[a, b] += n
        kinds2[a, b] += 1
    n, v = sum(one.values()), len(one)
    out = []
    for d, t in rows:
        w = [None, None, *words(t), None]
        low = [(one[x] + 1) / (n + v + 1) for x in w[2:]]
        p = 0.0
        for a, b, c, q in zip(w, w[1:], w[2:], low):
            q = (two[b, c] + kinds1[b] * q) / (of1[b] + kinds1[b]) if of1[b] else q
            q = (three[a, b, c] + kinds2[a, b] * q) / (of2[a, b] + kinds2[a, b]) if of2[a, b] else q
            p += math.log10(q)
        out.append((d, crc(d) == 2, len(w) - 2, sum(one[x] > 0 for x in w[2:]), n, sum(map(math.log10, low)), p))
    return sorted(out, key=str)


def compare(got, want):
    got = sorted((tuple(r) for r in got), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert abs(g[6] - w[6]) <= 1e-6 + 1.5 * g[2] / ngram.STEP


def test_sequences():
    rnd = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1), (500, 600), (3000, 10**6), (2000, 10**12)):
        v = np.sort(rnd.choice(top, n, replace=False)) if n <= top < 10**7 else np.unique(rnd.integers(0, top, n))
        part = encode(v, top)
        e = EliasFano(part)
        assert (e.get(np.arange(len(v))) == v).all()
        ask = np.concatenate([v, rnd.integers(0, top, 200)])
        full = e.find(ask, np.zeros(len(ask), int), np.full(len(ask), len(v)))
        where = {int(x): i for i, x in enumerate(v)}
        assert full.tolist() == [where.get(int(x), -1) for x in ask]


def test_groups_and_their_size():
    rnd = np.random.default_rng(2)
    sizes = rnd.integers(0, 6, 400)
    values = np.concatenate([np.sort(rnd.choice(5000, n, replace=False)) for n in sizes] or [[]]).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    part = grouped(values, starts)
    g = Grouped(part)
    group = rnd.integers(0, 400, 3000)
    ask = np.where(rnd.random(3000) < 0.5, rnd.integers(-1, 5000, 3000), values[np.minimum(starts[group], len(values) - 1)])
    want = [next((i for i in range(starts[k], starts[k + 1]) if values[i] == x), -1) for k, x in zip(group, ask, strict=True)]
    assert g.at(ask, starts[group], starts[group + 1], g.base(starts[group])).tolist() == want
    v = np.sort(rnd.integers(0, 1 << 30, 100_000))
    bits = 8 * sum(x.nbytes for x in encode(v, 1 << 30).values()) / len(v)
    assert bits < math.log2((1 << 30) / len(v)) + 2 + 1.6  # two bits above the low ones, and the directory


def test_against_a_loop(spark, sf, monkeypatch):
    monkeypatch.setattr(ngram, "RANGE", 20_000)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = ngram.op8_trie_scores(spark, sf).collect()
    compare(got, brute(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def run(spark, df, tmp_path, per_range):
    from pyspark.sql import functions as F

    held = ngram.crc_mod(F.col("doc_id"), 7) == 2
    to = f"file://{tmp_path}/m{per_range}"
    chunks = ngram.chunked(df.withColumn("learn", ~held), to)
    m = ngram.train(chunks, to, per_range)
    return ngram.score(chunks, m).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(m.all).alias("n"), "base_score", "score").collect()


def test_awkward_rows(spark, tmp_path):
    df = cases.clash(cases.docs(spark), "key", "n", "r", "value")
    compare(run(spark, df, tmp_path, 1000), brute([r[:2] for r in cases.ROWS]))
    assert run(spark, cases.docs(spark, []), tmp_path, 5) == []
    rows = [r for r in cases.ROWS if crc(r[0]) == 2] or [(next(i for i in range(99) if crc(i) == 2), "all held out", "en", "a", 1)]
    compare(run(spark, cases.docs(spark, rows), tmp_path, 6), brute([r[:2] for r in rows]))
