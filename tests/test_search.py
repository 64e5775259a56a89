import sqlite3

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import search
from graphloom.schema import QueryError


def test_prepared_queries(spark):
    assert text.prepared("why egui not tauri") == ["egui", "tauri"]
    assert text.prepared("explain raft") == ["raft"]
    with pytest.raises(QueryError):
        text.prepared("!!!")
    assert len(text.stopwords()) == 132
    q = spark.createDataFrame([("summarize architecture",), ("what changed in v0.3.14",), ("roadmap status",)], "t string").select(text.significant_tokens(text.query_tokens(F.col("t"))).alias("s"))
    got = q.select(text.is_generic(F.col("s")), text.is_release(F.col("s")), text.is_planning(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, True, False), (False, False, True)]


def test_bm25_is_that_of_fts5(spark, sf):
    rows = [(str(r.doc_id), " ".join(r.text.split()[:3]), r.text, f"{r.lang} {r.source}") for r in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()]
    rows.append(("p", "status: in_progress", "the in progress café of 0.3.15", "x"))
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(node_id unindexed, title, content, tags)")
    db.executemany("insert into f values (?, ?, ?, ?)", rows)
    docs = spark.createDataFrame(rows, "node_id string, title string, content string, tags string")
    queries = {1: ["that", "src3"], 2: ["status:in_progress"], 3: ["cafe", "0.3.15"], 4: ["en"]}
    got = {(r.query_id, r.node_id): r.bm25 for r in search.bm25(search.postings(docs), search.corpus_size(docs), spark.createDataFrame([*queries.items()], "query_id int, tokens array<string>")).collect()}
    want = {}
    for k, tokens in queries.items():
        for d, b in db.execute("select node_id, bm25(f) from f where f match ?", (" OR ".join(f'"{t}"' for t in tokens),)):
            want[k, d] = b
    assert got.keys() == want.keys() and (2, "p") in got
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_tags_bring_a_hit_and_scopes_hold(spark):
    n = spark.createDataFrame([("a", "concept", "A", None, "main"), ("b", "concept", "B", None, "x"), ("readme", "goal", "R", "README.md", "main")], "id string, node_type string, title string, file_path string, scope string")
    docs = spark.createDataFrame([("a", "A", "body about raft", ""), ("b", "B", "none", ""), ("readme", "R", "raft", "")], "node_id string, title string, content string, tags string")
    tags = spark.createDataFrame([("b", "raft")], "node_id string, tag string")
    none = spark.createDataFrame([], "alias string, node_id string")
    q = spark.createDataFrame([(1, ["raft"])], "query_id int, tokens array<string>")
    run = lambda **o: {r.id: r for r in search.ranked(n, docs, tags, none, q, search.SearchOptions(**o)).collect()}
    assert run()["b"].reason == "name" and run()["b"].score == 3.5
    assert set(run(scope="x", scope_mode="strict")) == {"b"}
    assert set(run(scope="x")) == {"b", "readme"}
    assert set(run(scope="x", scope_mode="main")) == {"a", "b", "readme"}
    assert set(run(include_types=("goal",))) == {"readme"}
