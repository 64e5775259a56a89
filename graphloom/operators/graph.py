"""Neighbourhoods, statistics, adjacency and automatic links of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import path_stem
from ..schema import AUTO_FILE, AUTO_TAG, AUTO_WEIGHTS, AmbiguousTarget, NotFound, is_auto
from ..shared import few, kept

TRIVIAL_TAGS = ("adr", "goal", "index", "symbol", "readme", "concept", "analysis", "reference", "generated", "edge_case", "alternative")


def steps(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(from, to, relation, weight, way): edges as they may be walked."""
    out = edges.select(F.col("source_id").alias("from"), F.col("target_id").alias("to"), F.col("relation_type").alias("relation"), "weight", F.lit("out").alias("way"))
    back = edges.select(F.col("target_id").alias("from"), F.col("source_id").alias("to"), F.col("relation_type").alias("relation"), "weight", F.lit("in").alias("way"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def walkable(edges: DataFrame, nodes: DataFrame, no_auto: bool = False, no_symbols: bool = False, types: tuple[str, ...] = (), scope: Column | None = None) -> DataFrame:
    """Edges left by the filters; what filters remove is removed before any join of the walk."""
    if no_auto:
        edges = edges.where(~is_auto(F.col("relation_type")))
    keep = F.lit(True)
    if no_symbols:
        keep = keep & (F.col("node_type") != "symbol")
    if types:
        keep = keep & F.col("node_type").isin(*types)
    if scope is not None:
        keep = keep & scope
    ok = nodes.where(keep).select(F.col("id").alias("target_id"))
    return edges.join(ok, "target_id", "left_semi")


def neighborhood(edges: DataFrame, start: DataFrame, hops: int = 1, direction: str = "both", cap: int = 200) -> DataFrame:
    """start (root) to (root, id, hop, parent, relation, weight, way, place, truncated): the tree of first visits.

    A round a hop: the frontier meets the edges, and of the ways to a new node that
    by the earliest parent, heaviest edge, id and relation (outward first) stays.
    Any number of roots are walked at once. Edges that stand several times count as
    one. A frontier of few rows is broadcast, so that edges stay where they are.
    Lineage is cut each hop at the shared checkpoint folder where one is set.
    """
    s = steps(edges, direction)
    seen = start.select("root", F.col("root").alias("id"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("string").alias("way"), F.lit(0).cast("long").alias("place"))
    front = seen
    for h in range(1, max(1, hops) + 1):
        ways = few(front.select("root", F.col("id").alias("parent"), F.col("place").alias("_place"))).join(s, F.col("parent") == F.col("from")).select("root", F.col("to").alias("id"), "parent", "_place", "relation", "weight", "way")
        ways = ways.join(seen.select("root", "id"), ["root", "id"], "left_anti")
        first = Window.partitionBy("root", "id").orderBy("_place", F.desc("weight"), "relation", F.desc("way"))
        ways = ways.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        line = Window.partitionBy("root").orderBy("_place", F.desc("weight"), "id", "relation")
        base = F.lit(h * (1 << 40))
        front = ways.select("root", "id", F.lit(h).alias("hop"), "parent", "relation", "weight", "way", (base + F.row_number().over(line)).alias("place"))
        if edges.sparkSession.sparkContext.getCheckpointDir():
            front = front.checkpoint()
        seen = seen.unionByName(front)
    line = Window.partitionBy("root").orderBy("place")
    out = seen.where("hop > 0").withColumn("place", F.row_number().over(line))
    return out.withColumn("truncated", F.max("place").over(Window.partitionBy("root")) > cap).where(F.col("place") <= cap)


def k_hop(edges: DataFrame, start: DataFrame, hops: int = 1) -> DataFrame:
    """start (root) to (root, id, hop, weight): outward only; of the shortest paths the greatest product of weights.

    Of the edges, which may stand several times, only those of the frontier are
    gathered; a frontier of few rows is broadcast.
    """
    seen = start.select("root", F.col("root").alias("id"), F.lit(0).alias("hop"), F.lit(1.0).alias("weight"))
    front = seen
    for h in range(1, hops + 1):
        best = edges.join(few(front.select(F.col("id").alias("source_id")).distinct()), "source_id", "left_semi").groupBy("source_id", "target_id").agg(F.max("weight").alias("w"))
        go = front.select("root", F.col("id").alias("source_id"), "weight").join(best, "source_id").select("root", F.col("target_id").alias("id"), (F.col("weight") * F.col("w")).alias("weight"))
        front = go.join(seen.select("root", "id"), ["root", "id"], "left_anti").groupBy("root", "id").agg(F.max("weight").alias("weight")).select("root", "id", F.lit(h).alias("hop"), "weight")
        if edges.sparkSession.sparkContext.getCheckpointDir():
            front = front.checkpoint()
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count("*").alias("n"))


def by_relation(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation_type").agg(F.count("*").alias("n"))


def by_scope(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("scope").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame, explicit: bool = False) -> DataFrame:
    """(id, degree), in and out; explicit: without automatic links. Ends are counted before they are shuffled."""
    e = edges.where(~is_auto(F.col("relation_type"))) if explicit else edges
    return e.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, n: int = 15) -> DataFrame:
    """The n nodes of most edges; ends without a node are no hubs."""
    return degrees(edges).join(nodes.select("id", "node_type", "title"), "id").orderBy(F.desc("degree"), "id").limit(n)


def unknown_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the ends of edges that no node has, once each. Edges stay where they are: what moves is each task's distinct ends."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).where("id is not null").distinct()
    return kept(ends.join(nodes.select("id"), "id", "left_anti"))


def _with_unknown(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with whether one end at least is unknown or null."""
    gone = few(unknown_ends(nodes, edges))
    e = edges
    for end in ("source_id", "target_id"):
        e = e.join(gone.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    unknown = F.coalesce(F.col("_source_id") | F.col("_target_id"), F.lit(False)) | F.col("source_id").isNull() | F.col("target_id").isNull()
    return e.select(*edges.columns, unknown.alias("_unknown"))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, targets array<struct<target_id, weight>>), sorted; edges with an unknown end are dropped. The graph as a table to write.

    Edges, which may stand several times, move once, by source.
    """
    e = _with_unknown(nodes, edges).where("not _unknown").select("source_id", "target_id", "weight").repartition("source_id")
    e = e.groupBy("source_id", "target_id").agg(F.max("weight").alias("weight"))
    return e.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("target_id", "weight"))).alias("targets"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that lead to or from no node, once each: must be none in a table that is published."""
    return _with_unknown(nodes, edges).where("_unknown").drop("_unknown").distinct()


def noise_id(c: Column) -> Column:
    low = F.lower(c)
    return low.contains("template") | low.contains("bootstrap") | low.contains("module-map.generated") | (low == "agents") | F.endswith(low, F.lit("/agents")) | (low == "docs/goals/readme")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Notes without a link of their own: automatic ones do not count."""
    linked = edges.where(~is_auto(F.col("relation_type"))).select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return nodes.where((F.col("node_type") != "symbol") & ~noise_id(F.col("id"))).join(linked, "id", "left_anti").select("id", "node_type", "title", "file_path")


#: Rows of a block of a group, and pairs of a task: what a task holds is two blocks.
BLOCK, TASK_PAIRS = 2000, 8_000_000


def pairs_by(groups: DataFrame, relation: str, most: int | None = None) -> DataFrame:
    """groups (id, key) to the edges a < b of ids that share a key.

    The number of pairs grows as the square of a group; with `most`, larger groups
    are linked as a star to their least id, so that they stay connected in as many
    edges as rows. Pairs are never shuffled: a group is cut into blocks, two blocks
    meet in one cell, cells are shared out by the number of pairs, and of the keys
    that two ids share only the least gives their edge.
    """
    g = groups.where("id is not null and key is not null").groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    if most is not None:
        rows = g.select("id", F.explode("keys").alias("key"))
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"))
        large = rows.join(sizes.where(F.col("n") > most), "key").where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))
        g = rows.join(sizes.where(F.col("n") <= most), "key").groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    # the keys of an id that stand before this one
    g = kept(g.select("id", F.posexplode("keys").alias("at", "key"), "keys").select("id", "key", F.when(F.col("at") > 0, F.slice("keys", 1, F.col("at"))).alias("before")))
    sizes = kept(g.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    n = F.col("n").cast("double")
    tasks = min(max(round((sizes.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0) / TASK_PAIRS), 1), 10_000)
    several = not g.where("before is not null").isEmpty()
    g = g.join(sizes, "key").withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("id")))
    g = g.withColumn("block", F.floor((F.col("at") - 1) / BLOCK)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))))
    # a cell is a block and one that is not before it
    left = g.where("block <= other").select("key", F.col("block").alias("i"), F.col("other").alias("j"), F.col("id").alias("a"), F.col("at").alias("a_at"), F.col("before").alias("a_before"))
    right = g.where("other <= block").select("key", F.col("other").alias("i"), F.col("block").alias("j"), F.col("id").alias("b"), F.col("at").alias("b_at"), F.col("before").alias("b_before"))
    cell = ["key", "i", "j"]
    pairs = left.repartition(tasks, *cell).hint("merge").join(right.repartition(tasks, *cell), cell).where("a_at < b_at")
    if several:
        pairs = pairs.where("a_before is null or b_before is null or not arrays_overlap(a_before, b_before)")
    pairs = pairs.select("a", "b")
    if most is not None:
        pairs = pairs.unionByName(large).distinct()
    return pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit(relation).alias("relation_type"), F.lit(AUTO_WEIGHTS[relation]).alias("weight"))


def _soft_groups(nodes: DataFrame, tags: DataFrame) -> dict[str, DataFrame]:
    """(id, key) of each kind of soft link: notes of one file stem or one telling tag; scope tags and type names tell nothing."""
    notes = nodes.where(F.col("node_type") != "symbol")
    stems = notes.select("id", path_stem(F.col("file_path")).alias("key")).where("key is not null")
    low = F.lower("tag")
    told = tags.where(~low.isin(*TRIVIAL_TAGS) & ~F.startswith(low, F.lit("scope:"))).select(F.col("node_id").alias("id"), low.alias("key")).join(notes.select("id"), "id", "left_semi")
    return {AUTO_FILE: stems, AUTO_TAG: told}


def auto_links(nodes: DataFrame, tags: DataFrame, most: int | None = None) -> DataFrame:
    """Soft links both ways between notes of one group; `most`: larger groups are linked as a star."""
    groups = _soft_groups(nodes, tags)
    one = pairs_by(groups[AUTO_FILE], AUTO_FILE, most).unionByName(pairs_by(groups[AUTO_TAG], AUTO_TAG, most))
    return one.unionByName(one.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relation_type", "weight"))


def suggestions(nodes: DataFrame, tags: DataFrame, focus: DataFrame, n: int = 24) -> DataFrame:
    """focus (id) to its best n automatic links, heaviest first.

    Links of one relation weigh the same and stand by target, so of a group no more
    than its n + 1 least ids can be among the best n of a member, which may be one of
    them: the focus meets those by key, and work is linear in the size of a group.
    """
    links = None
    for relation, rows in _soft_groups(nodes, tags).items():
        g = rows.distinct()
        mine = g.join(focus.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("source_id"), "key")
        line = Window.partitionBy("key").orderBy("id")
        first = g.join(mine.select("key").distinct(), "key", "left_semi").withColumn("_n", F.row_number().over(line)).where(F.col("_n") <= n + 1).select(F.col("id").alias("target_id"), "key")
        found = mine.join(first, "key").where("source_id <> target_id").select("source_id", "target_id").distinct()
        found = found.withColumns({"relation_type": F.lit(relation), "weight": F.lit(AUTO_WEIGHTS[relation])})
        links = found if links is None else links.unionByName(found)
    line = Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id", "relation_type")
    return links.withColumn("place", F.row_number().over(line)).where(F.col("place") <= n)


def resolve_target(nodes: DataFrame, name: str) -> str:
    """The node that a name means: id, id below docs/, symbol, path suffix, title, part of a title (3 characters); the first kind that answers."""
    low = name.strip().lower()
    title = F.lower("title")
    tiers = [F.col("id") == name, F.lower("id") == low, F.lower("id").isin(f"docs/{low}", low.removesuffix(".md"), f"docs/{low.removesuffix('.md')}"), F.startswith(F.col("id"), F.lit("symbol/")) & F.endswith(F.lower("id"), F.lit("/" + low.split("::")[-1])), F.endswith(F.lower("id"), F.lit("/" + low)), title == low]
    if len(low) >= 3:
        tiers.append(title.contains(low))
    tier = F
    for k, t in enumerate(tiers):
        tier = tier.when(t, F.lit(k))
    hits = nodes.select("id", tier.otherwise(F.lit(None)).alias("tier")).where("tier is not null")
    found = hits.groupBy("tier").agg(F.count("*").alias("n"), F.min("id").alias("id")).orderBy("tier").limit(1).collect()
    if not found:
        raise NotFound(name)
    if found[0]["n"] > 1:
        raise AmbiguousTarget(f"{name}: {found[0]['n']} nodes")
    return found[0]["id"]
