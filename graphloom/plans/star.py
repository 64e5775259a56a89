"""The driver's tables as a knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: table, key, prefix, type, title, scope
_KINDS = [("region", "r_regionkey", "region", "goal", "r_name"), ("nation", "n_nationkey", "nation", "adr", "n_name"), ("customer", "c_custkey", "customer", "concept", "c_name"), ("supplier", "s_suppkey", "supplier", "reference", "s_name"), ("part", "p_partkey", "part", "analysis", "p_name"), ("orders", "o_orderkey", "order", "plan", "o_orderpriority")]
#: table, from prefix and key, to prefix and key, relation, weight
_LINKS = [("nation", "nation", "n_nationkey", "region", "n_regionkey", "relates_to", 1.0), ("customer", "customer", "c_custkey", "nation", "c_nationkey", "relates_to", 0.9), ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "anchors", 0.8), ("orders", "order", "o_orderkey", "customer", "o_custkey", "doc_links", 1.0), ("lineitem", "order", "l_orderkey", "part", "l_partkey", "relates_to", 0.7), ("lineitem", "order", "l_orderkey", "supplier", "l_suppkey", "auto_tag", 0.25)]


def _ref(prefix: str, key: str):
    return F.concat(F.lit(f"{prefix}/"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key, prefix, kind, title in _KINDS:
        d = table(spark, sf_dir, name).select(_ref(prefix, key).alias("id"), F.lit(kind).alias("node_type"), F.col(title).alias("title"), F.concat(F.lit("docs/"), _ref(prefix, key), F.lit(".md")).alias("file_path"), F.lit("main").alias("scope"))
        out = d if out is None else out.unionByName(d)
    return out


def edges(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """repeats: edges of line items may stand several times, for operators to which that makes no difference."""
    out = None
    for name, a, ka, b, kb, relation, weight in _LINKS:
        d = table(spark, sf_dir, name).select(ka, kb)
        d = d.distinct() if name == "lineitem" and not repeats else d
        d = d.select(_ref(a, ka).alias("source_id"), _ref(b, kb).alias("target_id"), F.lit(relation).alias("relation_type"), F.lit(weight).alias("weight"))
        out = d if out is None else out.unionByName(d)
    return out


NODES_SQL = " UNION ALL ".join(f"SELECT '{p}/' || {k} AS id, '{t}' AS node_type, {c} AS title, 'docs/{p}/' || {k} || '.md' AS file_path, 'main' AS scope FROM {n}" for n, k, p, t, c in _KINDS)
EDGES_SQL = " UNION ALL ".join(f"SELECT {'DISTINCT' if n == 'lineitem' else ''} '{a}/' || {ka} AS source_id, '{b}/' || {kb} AS target_id, '{r}' AS relation_type, {w}::DOUBLE AS weight FROM {n}" for n, a, ka, b, kb, r, w in _LINKS)
GRAPH_SQL = f"n AS ({NODES_SQL}), e AS ({EDGES_SQL})"

TYPES = {"en": "concept", "fr": "adr", "de": "goal", "es": "plan"}


def doc_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """documents as nodes, index texts, tags and aliases."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    nid = F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    kind = F
    for k, v in TYPES.items():
        kind = kind.when(F.col("lang") == k, F.lit(v))
    title = F.regexp_extract("text", r"^([^ ]+ [^ ]+ [^ ]+)", 1)
    n = d.select(nid.alias("id"), kind.otherwise("reference").alias("node_type"), title.alias("title"), F.concat(nid, F.lit(".md")).alias("file_path"), F.col("source").alias("scope"))
    docs = d.select(nid.alias("node_id"), title.alias("title"), F.col("text").alias("content"), F.concat_ws(" ", "lang", "source").alias("tags"))
    tags = d.select(nid.alias("node_id"), F.explode(F.array("lang", "source")).alias("tag"))
    return n, docs, tags, d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("alias"), nid.alias("node_id"))


DOCS_SQL = r"""d AS (SELECT 'docs/' || source || '/' || doc_id AS id, CASE lang WHEN 'en' THEN 'concept' WHEN 'fr' THEN 'adr' WHEN 'de' THEN 'goal' WHEN 'es' THEN 'plan' ELSE 'reference' END AS node_type,
  regexp_extract(text, '^([^ ]+ [^ ]+ [^ ]+)', 1) AS title, source AS scope, lang, source, text, 'doc-' || doc_id AS alias FROM documents),
tok AS (SELECT id, list_filter(string_split_regex(strip_accents(lower(title || ' ' || text || ' ' || lang || ' ' || source)), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS toks FROM d),
size AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM tok)"""
