import random

from pyspark.sql import functions as F

from graphloom.operators import search
from graphloom.plans import catalog


def test_batches_score_as_the_index_does(spark):
    r = random.Random(3)
    word = lambda: r.choice("in of the and on que Café 3 15 raft paxos the".split())
    rows = [(f"n{i:03}", " ".join(word() for _ in range(r.randint(0, 3))), " ".join(word() for _ in range(r.randint(0, 40))), "en x") for i in range(200)]
    rows += [(f"m{i:03}", "raft", "of the raft", None) for i in range(20)]  # ties
    docs = spark.createDataFrame(rows, "node_id string, title string, content string, tags string")
    queries = spark.createDataFrame([(1, ["raft", "the", "raft"]), (2, ["of-the", "of_the", "cafe"]), (3, ["3.15", "in-in-in"]), (4, ["nowhere", "--"]), (5, [])], "query_id int, tokens array<string>")
    known = docs.where("node_id <> 'm003'").select(F.col("node_id").alias("id"))
    for n in (7, None):
        got = search.batch_bm25(docs, queries, known, n)
        want = search.bm25(search.postings(docs), search.corpus_size(docs), queries).join(known, F.col("node_id") == F.col("id"), "left_semi")
        want = want if n is None else search.top(want, n, F.round("bm25", 9), F.col("node_id"))
        rows_of = lambda d: sorted((x.query_id, x.node_id, round(x.bm25, 9)) for x in d.collect())
        assert rows_of(got) == rows_of(want)


def test_context_is_packed_for_every_turn(spark, tmp_path):
    text = "Of the raft and the paxos in three words"
    spark.createDataFrame([(k, f"{text} {k}", "en", "src1") for k in range(6)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(c, t, ("system", "user", "assistant")[t], "raft or paxos") for c in (100, 101, 200) for t in range(3)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn) for r in catalog.context_pack(spark, str(tmp_path)).collect()}
    assert got == {(c, t) for c in (100, 200) for t in range(3)}
