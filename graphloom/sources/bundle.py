"""Bundles: a part of a graph as one JSON file, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, upsert
from ..schema import EDGES, HUBS, NODES, BundleError

VERSION = 1
#: Most top folders of ids by which edges are sorted out.
FOLDERS = 1000
SCHEMA = f"version int, name string, created_at long, nodes array<struct<{', '.join(c.replace(' ', ':', 1) for c in NODES.split(', '))}>>, edges array<struct<{', '.join(c.replace(' ', ':', 1) for c in EDGES.split(', '))}>>"


def closure(nodes: DataFrame, edges: DataFrame, scope: str | None = None, decouple: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes of a scope and the hubs, without symbols and file facts when decoupled; edges of which both ends stay."""
    if scope is not None:
        nodes = nodes.where((F.col("scope") == scope) | F.col("id").isin(*HUBS))
    if decouple:
        nodes = nodes.where(F.col("node_type") != "symbol").withColumns({"file_path": F.lit(None).cast("string"), "symbol_hash": F.lit(None).cast("long")})
    ids = nodes.select("id")
    # an end in a folder that holds none of the nodes is out before anything moves
    folder = lambda c: F.substring_index(c, "/", 1)
    folders = [r[0] for r in ids.where("id is not null").select(folder(F.col("id"))).distinct().limit(FOLDERS + 1).collect()]
    if len(folders) <= FOLDERS:
        edges = edges.where(folder(F.col("source_id")).isin(*folders) & folder(F.col("target_id")).isin(*folders))
    edges = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return nodes, edges


def export(nodes: DataFrame, edges: DataFrame, path: str, name: str = "bundle", scope: str | None = None, decouple: bool = False, at: int = 0) -> None:
    """Writes a folder with the tables' rows as JSON lines and a head; Spark's commit puts it in place as a whole."""
    n, e = closure(nodes, edges, scope, decouple)
    rows = n.select(F.lit("node").alias("kind"), F.to_json(F.struct(*n.columns)).alias("row")).unionByName(e.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*e.columns)).alias("row")))
    head = nodes.sparkSession.createDataFrame([("head", f'{{"version":{VERSION},"name":"{name}","created_at":{at}}}')], "kind string, row string")
    rows.unionByName(head).write.mode("overwrite").json(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a folder that export() wrote, or of one JSON document of the plain layout; later versions are refused."""
    d = spark.read.schema("kind string, row string, version int, nodes string, edges string").option("multiLine", not _lines(spark, path)).json(path)
    head = d.select(F.coalesce(F.when(F.col("kind") == "head", F.get_json_object("row", "$.version").cast("int")), "version").alias("v")).where("v is not null").first()
    if head is None or head["v"] > VERSION:
        raise BundleError(f"bundle version {head['v'] if head else 'missing'}")
    part = lambda kind, column, schema: d.where(F.col("kind") == kind).select(F.from_json("row", schema).alias("x")).unionByName(d.where(F.col(column).isNotNull()).select(F.explode(F.from_json(column, f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>")).alias("x"))).select("x.*")
    return part("node", "nodes", NODES), part("edge", "edges", EDGES)


def _lines(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).limit(1).collect()
    return bool(first) and first[0][0].lstrip().startswith('{"kind"')


def import_(spark: SparkSession, path: str, nodes: DataFrame, edges: DataFrame, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The tables with a bundle's rows put in, all or none: an edge with an unknown end stops it."""
    n, e = read(spark, path)
    if scope is not None:
        n = n.withColumn("scope", F.lit(scope))
    all_n, all_e = upsert.nodes(nodes, n), upsert.edges(edges, e)
    if not graph.dangling(all_n, e).isEmpty():
        raise BundleError("an edge leads to no node")
    return all_n, all_e
