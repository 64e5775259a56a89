import zlib
from itertools import combinations

import numpy as np

from graphloom.llm import quality

from . import cases


def test_pairs_in_linear_time():
    rnd = np.random.default_rng(0)
    m = quality.Machine(0.3, rnd.standard_normal(50).astype(np.float32), rnd.standard_normal((50, 4)).astype(np.float32))
    places = [rnd.choice(50, n, replace=False).astype(np.int32) for n in (1, 7, 20)]
    values = [rnd.standard_normal(len(p)).astype(np.float32) for p in places]
    want = [0.3 + sum(m.w[i] * x for i, x in zip(p, v, strict=True)) + sum(m.v[i] @ m.v[j] * x * y for (i, x), (j, y) in combinations(zip(p, v, strict=True), 2)) for p, v in zip(places, values, strict=True)]
    assert np.allclose(m.raw(places, values), want, atol=1e-3)


def test_learns_an_interaction():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 2, (600, 2))
    places = [np.array([2 * 0 + a, 2 + b], np.int32) for a, b in x]
    values = [np.ones(2, np.float32)] * len(x)
    y = (x[:, 0] == x[:, 1]).astype(float)
    m = quality.fit(places, values, y, np.ones(len(y)), 4, epochs=60)
    assert ((m.score(places, values) > 0.5) == y).mean() > 0.95


def test_held_out(spark, sf):
    got = quality.op4_quality_fm(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_awkward_rows(spark):
    d = cases.clash(cases.docs(spark), "score", "y", "_m", "p", "v")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, 0, 0), (6, 1, 0), (7, 1, 1), (7, 0, 1), (9, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    m = quality.train(d, labels)
    got = quality.scored(d, m).collect()
    assert len(got) == len(cases.ROWS) and all(0 <= r._score <= 1 for r in got)
    none = quality.train(d, labels.limit(0))
    assert {round(r._score, 6) for r in quality.scored(d, none).collect()} == {0.5}
    assert quality.scored(cases.docs(spark, []), none).count() == 0
