from collections import defaultdict

from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.plans import catalog


def brute(nodes, tags, focus, n=24):
    groups, of = defaultdict(set), defaultdict(set)
    for i, path in nodes:
        stem = path.rsplit("/", 1)[-1].removesuffix(".md").lower()
        groups["auto_filename", stem].add(i)
    for i, t in tags:
        if t.lower() not in graph.TRIVIAL_TAGS and not t.lower().startswith("scope:"):
            groups["auto_tag", t.lower()].add(i)
    for key, ids in groups.items():
        for i in ids:
            of[i].add(key)
    weight = {"auto_filename": 0.4, "auto_tag": 0.25}
    out = set()
    for f in focus:
        links = {(-weight[k[0]], i, k[0]) for k in of[f] for i in groups[k] if i != f}
        out |= {(f, i, r, -w, place) for place, (w, i, r) in enumerate(sorted(links)[:n], 1)}
    return out


def found(df):
    return {(r.source_id, r.target_id, r.relation_type, r.weight, r.place) for r in df.collect()}


def test_groups_of_any_size(spark):
    n = spark.range(1500).select(F.format_string("n%04d", "id").alias("id"), F.lit("concept").alias("node_type"), F.lit("docs/x/same.md").alias("file_path"))
    tags = n.select(F.col("id").alias("node_id"), F.explode(F.array(F.lit("Brand"), F.substring("id", 4, 2), F.lit("scope:main"))).alias("tag"))
    focus = ["n0000", "n0700", "n1499"]
    got = found(graph.suggestions(n, tags, spark.createDataFrame([(x,) for x in focus], "id string")))
    assert len(got) == 72 and got == brute([(r.id, r.file_path) for r in n.collect()], [tuple(r) for r in tags.collect()], focus)


def test_query_against_brute_force(spark, sf):
    n, tags = catalog._parts(spark, sf)
    rows = [(r.id, r.file_path) for r in n.collect()]
    focus = [i for i, _ in rows if int(i.split("/")[1]) % 100 == 0]
    assert found(catalog.autolink_suggestions(spark, sf)) == brute(rows, [tuple(r) for r in tags.collect()], focus)


def test_soft_links_are_all_pairs(spark):
    n = spark.range(1001).select(F.col("id").cast("string").alias("id"), F.lit("concept").alias("node_type"), F.lit("docs/x/same.md").alias("file_path"))
    assert graph.auto_links(n, spark.createDataFrame([], "node_id string, tag string")).count() == 1001 * 1000
