"""Scoring asks the trie for each distinct pair and triple of a chunk once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ngram
from graphloom.llm.eliasfano import EliasFano, Grouped, encode

from . import test_ngram


class Here:
    """Chunks whose mapInArrow gives the function, to run in this process."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


@pytest.mark.parametrize("per_range", [6, 1000])
def test_each_is_asked_once(spark, tmp_path, monkeypatch, per_range):
    rows = [(i, " ".join(["a b c", "b c d", "d a b c"][(i + k) % 3] for k in range(40)) + f" w{i % 7} ü{i}") for i in range(60)]
    to = f"file://{tmp_path}/m"
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    chunks = ngram.chunked(df.withColumn("learn", ngram.crc_mod(F.col("doc_id"), 7) != 2), to)
    model = ngram.train(chunks, to, per_range)
    asked, at = [], Grouped.at
    monkeypatch.setattr(Grouped, "at", lambda self, value, *a: asked.append(len(value)) or at(self, value, *a))
    batches = chunks.select("ids", "words", "seq_n", "seq").toArrow().to_batches()
    assert sum(b.num_rows for b in batches) == 1
    got = [r for b in ngram.score(Here(), model)(iter(batches)) for r in b.to_pylist()]
    want = test_ngram.brute(rows)
    test_ngram.compare([(r["doc_id"], test_ngram.crc(r["doc_id"]) == 2, r["n_tokens"], r["n_known"], model.all, r["base_score"], r["score"]) for r in got], want)
    pairs, befores, triples = set(), set(), set()
    for _, t in rows:
        w = [None, None, *test_ngram.words(t), None]
        pairs.update(zip(w[1:], w[2:]))
        befores.update(zip(w, w[1:-1]))
        triples.update(zip(w, w[1:], w[2:]))
    assert sum(asked) <= len(pairs) + len(befores) + len(triples)


def test_distinct():
    rnd = np.random.default_rng(5)
    for n, most in ((0, 9), (1, 1), (2000, 300), (2000, 1 << 52), (2000, 1 << 62)):
        x = rnd.integers(0, most, n)
        for a, b in zip(ngram._distinct(x, most), np.unique(x, return_inverse=True), strict=True):
            assert a.tolist() == b.tolist()


def test_long_runs_of_the_upper_bits():
    for v in (np.arange(300), np.concatenate([np.arange(300), 10**9 - np.arange(130)[::-1]]), np.arange(0, 64 * 700, 64), np.array([0, 10**6])):
        e = EliasFano(encode(v, int(v[-1]) + 1))
        a, b = e.both(np.arange(len(v) - 1))
        assert a.tolist() == v[:-1].tolist()
        assert b.tolist() == v[1:].tolist()
        ask = np.concatenate([v, v + 1, v - 1])
        ask = ask[(ask >= 0) & (ask <= v[-1])]
        where = {int(x): i for i, x in enumerate(v)}
        assert e.find(ask, np.zeros(len(ask), int), np.full(len(ask), len(v))).tolist() == [where.get(int(x), -1) for x in ask]
        lo, hi = np.arange(len(v)) // 2, np.arange(len(v)) // 2 + 3  # bounds that cut runs
        assert e.find(v, lo, hi).tolist() == [i if lo[i] <= i < hi[i] else -1 for i in range(len(v))]
