import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.schema import AmbiguousTarget, NotFound

NODES = [("docs/concepts/raft", "concept", "Raft", "docs/concepts/raft.md"), ("docs/concepts/logcompaction", "concept", "LogCompaction", "docs/concepts/logcompaction.md"), ("docs/adr/0001-use-raft", "adr", "Use Raft", "docs/adr/0001-use-raft.md"), ("symbol/demo/lib/storageengine", "symbol", "StorageEngine", "src/lib.rs")]
EDGES = [("docs/concepts/raft", "docs/concepts/logcompaction", "relates_to", 1.0), ("docs/concepts/raft", "symbol/demo/lib/storageengine", "anchors", 1.0), ("docs/adr/0001-use-raft", "docs/concepts/raft", "relates_to", 0.9), ("docs/concepts/raft", "docs/concepts/logcompaction", "auto_filename", 0.4)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(NODES, "id string, node_type string, title string, file_path string"), spark.createDataFrame(EDGES, "source_id string, target_id string, relation_type string, weight double")


def around(spark, edges, **more):
    start = spark.createDataFrame([("docs/concepts/raft",)], "root string")
    return {r.id: r for r in graph.neighborhood(edges, start, **more).collect()}


def test_neighborhood(spark, tables):
    n, e = tables
    both = around(spark, e)
    assert len(both) == 3 and both["docs/concepts/logcompaction"].relation == "relates_to" and not any(r.truncated for r in both.values())
    assert "docs/adr/0001-use-raft" not in around(spark, e, direction="out")
    left = around(spark, graph.walkable(e, n, no_auto=True, no_symbols=True))
    assert set(left) == {"docs/concepts/logcompaction", "docs/adr/0001-use-raft"}
    assert next(iter(around(spark, e, cap=1).values())).truncated


def test_k_hop_and_stats(spark, tables):
    n, e = tables
    start = spark.createDataFrame([("docs/adr/0001-use-raft",)], "root string")
    got = {r.id: (r.hop, round(r.weight, 6)) for r in graph.k_hop(e, start, 2).collect()}
    assert got == {"docs/concepts/raft": (1, 0.9), "docs/concepts/logcompaction": (2, 0.9), "symbol/demo/lib/storageengine": (2, 0.9)}
    assert graph.hubs(n, e).first().id == "docs/concepts/raft"
    assert graph.dangling(n.limit(2), e).count() > 0 and graph.dangling(n, e).count() == 0


def test_targets(tables):
    n, _ = tables
    assert graph.resolve_target(n, "raft") == "docs/concepts/raft"
    assert graph.resolve_target(n, "docs/adr/0001-use-raft") == "docs/adr/0001-use-raft"
    assert graph.resolve_target(n, "demo::StorageEngine") == "symbol/demo/lib/storageengine"
    with pytest.raises(NotFound):
        graph.resolve_target(n, "zz")
    with pytest.raises(AmbiguousTarget):
        graph.resolve_target(n.withColumn("title", F.lit("Same")), "same")


def test_soft_links_leave_orphans(spark):
    n = spark.createDataFrame([("docs/goals/rust-fluency", "goal", "A", "docs/goals/rust-fluency.md"), ("docs/concepts/rust-fluency", "concept", "B", "docs/concepts/rust-fluency.md")], "id string, node_type string, title string, file_path string")
    tags = spark.createDataFrame([("docs/goals/rust-fluency", "scope:main"), ("docs/concepts/rust-fluency", "scope:main")], "node_id string, tag string")
    e = graph.auto_links(n, tags)
    assert e.count() == 2 and {r.relation_type for r in e.collect()} == {"auto_filename"}
    assert graph.orphans(n, e).count() == 2


def test_large_groups_become_stars(spark):
    g = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("k").alias("key"))
    assert graph.pairs_by(g, "auto_tag", most=100).count() == 499
    assert graph.pairs_by(g, "auto_tag").count() == 500 * 499 // 2
