"""What moves where graphs are walked and joined, and rows that stand several times or have no end."""

import pytest

from graphloom.operators import graph, upsert
from graphloom.sources import bundle

EDGES = [("a/1", "a/2", "r", 0.5), ("a/1", "a/2", "r", 0.5), ("a/1", "a/2", "s", 0.9), ("a/2", "b/1", "r", 1.0), ("a/2", "b/1", "r", 1.0), ("a/1", "x/1", "r", 1.0), ("x/1", "x/2", "r", 1.0), (None, "a/1", "r", 1.0)]


@pytest.fixture
def tables(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.createDataFrame([("a/1", "n"), ("a/2", "n"), ("b/1", "n")], "id string, node_type string"), spark.createDataFrame(EDGES, "source_id string, target_id string, relation_type string, weight double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_few_starts_are_sent_to_the_edges(spark, tables):
    _, e = tables
    start = spark.createDataFrame([("a/1",)], "root string")
    hop = graph.k_hop(e, start, 1)
    assert sorted(tuple(r) for r in hop.collect()) == [("a/1", "a/2", 1, 0.9), ("a/1", "x/1", 1, 1.0)]
    sent = []
    real = graph.few
    graph.few = lambda df: sent.append(real(df)) or sent[-1]
    try:
        around = graph.neighborhood(e.where("source_id is not null"), start, 2)
        assert sorted((r.id, r.hop, r.parent) for r in around.collect()) == [("a/2", 1, "a/1"), ("b/1", 2, "a/2"), ("x/1", 1, "a/1"), ("x/2", 2, "x/1")]
    finally:
        graph.few = real
    assert sent and all("ResolvedHint" in d._jdf.queryExecution().toString() for d in sent)


def test_adjacency_moves_edges_once(tables):
    n, e = tables
    got = graph.adjacency(n, e)
    assert {r.source_id: [tuple(t) for t in r.targets] for r in got.collect()} == {"a/1": [("a/2", 0.9)], "a/2": [("b/1", 1.0)]}
    assert plan(got).count("Exchange hashpartitioning") == 1


def test_dangling_edges_stand_once(tables):
    n, e = tables
    got = graph.dangling(n, e)
    assert sorted(tuple(r) for r in got.select("target_id", "source_id").collect()) == [("a/1", None), ("x/1", "a/1"), ("x/2", "x/1")]
    assert "SortMergeJoin" not in plan(got)


def test_closure_leaves_other_folders_before_it_joins(tables):
    n, e = tables
    n = n.selectExpr("*", "case when id like 'a%' then 'main' else 'y' end as scope", "'p' as file_path", "0L as symbol_hash")
    kept = bundle.closure(n, e, scope="main")[1]
    assert sorted(tuple(r) for r in kept.select("source_id", "target_id", "relation_type").collect()) == [("a/1", "a/2", "r"), ("a/1", "a/2", "r"), ("a/1", "a/2", "s")]
    assert "substring_index" in plan(kept)


def test_upsert_shares_edges_out_by_their_number(tables, monkeypatch):
    _, e = tables
    monkeypatch.setattr(upsert, "ROWS_A_TASK", 3, raising=False)
    e = e.selectExpr("*", "0D as decay_rate", "1L as created_at")
    got = upsert.edges(e, e.selectExpr("source_id", "target_id", "relation_type", "weight / 2 as weight", "decay_rate", "2L as created_at").where("weight < 0.3"))
    rows = {tuple(r)[:3]: (r.weight, r.created_at) for r in got.collect()}
    assert len(rows) == got.count() == 6 and rows["a/1", "a/2", "r"] == (0.25, 1) and rows["a/1", "a/2", "s"] == (0.9, 1)
    assert "REPARTITION_BY_NUM" in plan(got)
