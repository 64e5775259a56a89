from graphloom.operators import lexicon


def test_names_of_any_length(spark):
    long = "a very long title of one note that has many more words than eight"
    texts = spark.createDataFrame([("t", f"See {long} and short name."), ("u", "a very long title of one note")], "id string, body string")
    names = spark.createDataFrame([(long, "n1"), ("short name", "n2")], "surface string, node_id string")
    assert {(r.id, r.node_id, r.n) for r in lexicon.mentions(texts, names).collect()} == {("t", "n1", 1), ("t", "n2", 1)}
    assert lexicon.mentions(texts, names.limit(0)).count() == 0
