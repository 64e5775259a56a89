from collections import defaultdict

from graphloom.llm import mixing

from . import cases


def test_awkward_rows(spark):
    d = cases.clash(cases.docs(spark), "s", "target", "place", "w", "_x")
    rows = mixing.plan(d, "doc_id", "source").collect()
    assert len(rows) == len(cases.ROWS)
    size, took, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        size[r.source] += r["_size"]
        took[r.source] += r["_taken"]
        target[r.source] = r["_target"]
        assert 0 <= r["_taken"] <= 3 * r["_size"]
    for s in size:
        assert took[s] == int(target[s]) and target[s] <= 3 * size[s]
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert mixing.plan(cases.docs(spark, []), "doc_id").count() == 0


def test_capped_share_goes_to_the_rest(spark):
    rows = [(i, "w " * n, "en", s, n) for i, (s, n) in enumerate([("a", 10), ("b", 500), ("c", 490)])]
    got = {r.source: r["_target"] for r in mixing.plan(cases.docs(spark, rows), "source").collect()}
    assert got["a"] == 30.0 and abs(got["b"] - 970 * 2 / 3) < 1e-9 and abs(got["c"] - 970 / 3) < 1e-9


def test_schedule_is_inverted(spark):
    from pyspark.sql import functions as F

    for ramp in (-0.5, 0.0, 0.5):
        t = spark.range(101).select((F.col("id") / 100).alias("t"))
        back = t.select("t", mixing.when(F.col("t") + F.lit(ramp) * (F.col("t") * F.col("t") - F.col("t")), F.lit(ramp)).alias("u"))
        assert back.where("abs(t - u) > 1e-9").count() == 0


def test_stage_repeats_and_drops(spark):
    d = cases.docs(spark)
    got = mixing.stage(spark, d, "")
    assert got.columns == d.columns
    n = sum(-(-r["_taken"] // r["_size"]) for r in mixing.plan(d, "doc_id").collect() if r["_size"])
    assert got.where(r"regexp_count(text, '[^ \\t\\n]+') > 0").count() == n
    assert got.groupBy("doc_id", "text").count().where("count > 6").count() == 0
