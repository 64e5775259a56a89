import random

import pytest

from graphloom.operators import graph


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("block, task", [(7, 50), (2000, 8_000_000)])
def test_pairs_of_several_keys_are_made_once_and_not_shuffled(spark, monkeypatch, block, task):
    monkeypatch.setattr(graph, "BLOCK", block, raising=False)
    monkeypatch.setattr(graph, "TASK_PAIRS", task, raising=False)
    r = random.Random(1)
    rows = [(f"n{i}", f"k{k}") for i in range(120) for k in r.sample(range(9), r.randint(0, 3))]
    rows += rows[:40] + [(None, "k1"), ("n3", None)]
    keys = {}
    for i, k in rows:
        keys.setdefault(k, set()).add(i)
    want = {(a, b) for k, ids in keys.items() if k for a in ids for b in ids if a and b and a < b}
    df = graph.pairs_by(spark.createDataFrame(rows, "id string, key string"), "auto_tag")
    got = [(x.source_id, x.target_id) for x in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    above = plan(df).split("Join", 1)[0]
    assert "Aggregate" not in above and "Repartition" not in above


def test_stars_beside_pairs(spark):
    rows = [(f"n{i:02}", "large") for i in range(30)] + [("n00", "small"), ("n05", "small"), ("n06", "small")]
    got = [(x.source_id, x.target_id) for x in graph.pairs_by(spark.createDataFrame(rows, "id string, key string"), "auto_tag", most=10).collect()]
    assert sorted(got) == sorted({("n00", f"n{i:02}") for i in range(1, 30)} | {("n05", "n06")})
