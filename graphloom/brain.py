"""A knowledge graph in a folder: tables as Parquet, and what is asked of them."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions.text import changelog_versions, mass, prepared
from .operators import context, doctor, graph, lexicon, linking, resolve, scopes, search, upsert
from .schema import ANCHORED, ANCHORS, DOC_LINK, DOCS, EDGES, NODES, PENDING, RELATES, TAGS, GraphError, NotFound
from .sources import bundle, workspace
from .streaming import watch

_TABLES = {"nodes": NODES, "edges": EDGES, "tags": TAGS, "aliases": "alias string, node_id string", "pending": PENDING, "docs": DOCS, "anchors": ANCHORS}


class KnowledgeGraph:
    """Tables below root/.graphloom/vN; `current` names the version in force, so that a sync is seen whole or not at all."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.home = spark, root, Path(root, ".graphloom")

    @classmethod
    def open(cls, spark: SparkSession, root: str, create: bool = False, exact: bool = False) -> KnowledgeGraph:
        found = root if exact or Path(root, ".graphloom").is_dir() else workspace.find_root(root)
        if found is None or not Path(found, ".graphloom").is_dir():
            if not create:
                raise NotFound(f"no graph at {root}")
            Path(root, ".graphloom").mkdir(parents=True)
            found = root
        return cls(spark, found)

    @property
    def version(self) -> int:
        at = self.home / "current"
        return int(at.read_text()) if at.exists() else 0

    def table(self, name: str) -> DataFrame:
        at = self.home / f"v{self.version}" / name
        return self.spark.read.schema(_TABLES[name]).parquet(str(at)) if at.exists() else self.spark.createDataFrame([], _TABLES[name])

    def size(self) -> DataFrame:
        """The corpus size as the sync counted it."""
        at = self.home / f"v{self.version}" / "size"
        return self.spark.read.parquet(str(at)) if at.exists() else search.corpus_size(self.table("docs"))

    def postings(self) -> DataFrame:
        """The kept index; made from the texts where a version has none."""
        at = self.home / f"v{self.version}" / "postings"
        return self.spark.read.parquet(str(at)) if at.exists() else search.postings(self.table("docs"))

    def manifest(self) -> scopes.Manifest:
        return scopes.Manifest.load(str(self.home / "scopes.json"))

    def save_manifest(self, manifest: scopes.Manifest) -> None:
        manifest.save(str(self.home / "scopes.json"))

    def _publish(self, tables: dict[str, DataFrame]) -> None:
        """All tables to a new version, then the name of the version in force in one step."""
        new = self.version + 1
        for name, d in tables.items():
            d.select(*[c.split()[0] for c in _TABLES[name].split(", ")]).write.mode("overwrite").parquet(str(self.home / f"v{new}" / name))
        at = self.home / f"v{new}"
        n, e = (self.spark.read.parquet(str(at / t)) for t in ("nodes", "edges"))
        if not graph.dangling(n, e).isEmpty():
            raise GraphError("an edge leads to no node")
        search.postings(self.spark.read.parquet(str(at / "docs"))).write.mode("overwrite").parquet(str(at / "postings"))
        search.corpus_size(self.spark.read.parquet(str(at / "docs"))).write.mode("overwrite").parquet(str(at / "size"))
        graph.adjacency(n, e).write.mode("overwrite").parquet(str(at / "adjacency"))
        mark = self.home / "current.new"
        mark.write_text(str(new))
        mark.replace(self.home / "current")

    def sync(self, crate: str = "crate") -> dict[str, int]:
        """Reads the workspace and publishes the graph of its files; returns counts of what changed.

        Links are resolved when all nodes are known, so one pass is enough; nodes of
        files that are gone go too.
        """
        globs = [p.read_text().splitlines() for p in [Path(self.root, ".graphloomignore")] if p.exists()]
        found = workspace.files(self.spark, self.root, globs[0] if globs else None).persist()
        m = self.manifest()
        roots = scopes.roots_frame(self.spark, m) if m.mode == "multi" and m.scopes else self.spark.createDataFrame([], "root string, scope string")
        notes = scopes.assign(workspace.notes(found), roots, "file_path").persist()
        symbols = workspace.symbols(found, crate).persist()
        now = int(time.time())
        n1 = notes.select("id", "node_type", "title", "file_path", F.lit(None).cast("long").alias("symbol_hash"), "summary", "content_hash", "scope")
        n2 = scopes.assign(symbols, roots, "file_path").select("id", F.lit("symbol").alias("node_type"), F.col("symbol_name").alias("title"), "file_path", "symbol_hash", F.col("doc_comment").alias("summary"), F.sha2(F.concat_ws("#", "id", "start_line", "end_line", "doc_comment"), 256).alias("content_hash"), "scope")
        new = n1.unionByName(n2).dropDuplicates(["id"]).withColumns({"created_at": F.lit(now).cast("long"), "updated_at": F.lit(now).cast("long")})
        old = self.table("nodes")
        change = {r["change"]: r["count"] for r in upsert.changes(old, new).groupBy("change").count().collect()}
        nodes = upsert.nodes(old, new).join(new.select("id"), "id", "left_semi").persist()
        tags = notes.select(F.col("id").alias("node_id"), F.explode(F.array_distinct(F.concat("tags", F.array("node_type"), F.when(F.lit(m.mode == "multi"), F.array(F.concat(F.lit("scope:"), "scope"))).otherwise(F.array().cast("array<string>"))))).alias("tag"))
        names = notes.select(F.explode("aliases").alias("alias"), F.col("id").alias("node_id"))
        aliases = upsert.aliases(self.spark.createDataFrame([], "alias string, node_id string"), names)
        wiki = notes.select(F.col("id").alias("source_id"), F.explode(F.transform("links", lambda x: x["target"])).alias("raw_target")).where("not startswith(raw_target, 'symbol:')").withColumn("relation_type", F.lit(RELATES))
        drawn = workspace.canvas(found).select(F.col("source").alias("source_name"), F.col("target").alias("raw_target"), F.col("relation").alias("relation_type"))
        ends = resolve.resolve(drawn.select(F.lit("").alias("source_id"), F.col("source_name").alias("raw_target"), "relation_type").distinct(), nodes, aliases).where("target_id is not null").select(F.col("raw_target").alias("source_name"), F.col("target_id").alias("source_id")).distinct()
        drawn = drawn.join(ends, "source_name").select("source_id", "raw_target", "relation_type")
        anchored = notes.select(F.col("id").alias("source_id"), F.explode("symbols").alias("raw_target")).withColumn("relation_type", F.lit(ANCHORED))
        leaf = n2.select(F.lower(F.concat(F.lit("symbol:"), F.regexp_extract("title", r"([^:]*)$", 1))).alias("alias"), F.col("id").alias("node_id"))
        one = leaf.groupBy("alias").agg(F.min("node_id").alias("node_id"), F.count("*").alias("c")).where("c = 1").drop("c")
        keyed = anchored.withColumn("raw_target", F.concat(F.lit("symbol:"), F.regexp_extract("raw_target", r"([^:]*)$", 1)))
        docs_of = symbols.select(F.col("id").alias("source_id"), F.explode(F.regexp_extract_all(F.coalesce("doc_comment", F.lit("")), F.lit(r"\[\[([^\]\n|#]+)"), F.lit(1))).alias("raw_target")).withColumn("relation_type", F.lit(DOC_LINK))
        solved = resolve.resolve(wiki.unionByName(drawn).unionByName(docs_of), nodes, aliases).unionByName(resolve.resolve(keyed, nodes, one)).persist()
        edges, pending = resolve.split(solved)
        edges = edges.withColumns({"weight": F.lit(1.0), "decay_rate": F.lit(0.0), "created_at": F.lit(now).cast("long")})
        edges = upsert.edges(self.table("edges").select(*edges.columns).join(edges, ["source_id", "target_id", "relation_type"], "left_semi"), edges)
        tag_text = tags.groupBy("node_id").agg(F.array_join(F.sort_array(F.collect_list("tag")), " ").alias("tags"))
        docs = notes.select(F.col("id").alias("node_id"), "title", F.col("body").alias("content")).unionByName(n2.select(F.col("id").alias("node_id"), "title", F.coalesce("summary", F.lit("")).alias("content"))).join(tag_text, "node_id", "left").withColumn("tags", F.coalesce("tags", F.lit("")))
        self._publish({"nodes": nodes, "edges": edges, "tags": tags, "aliases": aliases, "pending": pending.withColumn("created_at", F.lit(now).cast("long")), "docs": docs.dropDuplicates(["node_id"]), "anchors": symbols.dropDuplicates(["symbol_hash"])})
        for d in (found, notes, symbols, nodes, solved):
            d.unpersist()
        return {k: change.get(k, 0) for k in ("added", "changed", "removed", "same")} | {"edges": self.table("edges").count(), "pending": self.table("pending").count()}

    def search(self, query: str, opts: search.SearchOptions | None = None) -> DataFrame:
        q = self.spark.createDataFrame([(0, prepared(query))], "query_id int, tokens array<string>")
        return self.search_many(q, opts).drop("query_id").orderBy(F.desc("score"), "id")

    def search_many(self, queries: DataFrame, opts: search.SearchOptions | None = None) -> DataFrame:
        return search.ranked(self.table("nodes"), self.table("docs"), self.table("tags"), self.table("aliases"), queries, opts, self.postings(), self.size())

    def context(self, prompt: str, opts: context.ContextOptions | None = None) -> DataFrame:
        return self.context_many(self.spark.createDataFrame([(0, prompt)], "query_id long, prompt string"), opts).orderBy("place")

    def context_many(self, prompts: DataFrame, opts: context.ContextOptions | None = None) -> DataFrame:
        return context.assemble(self.table("nodes"), self.table("edges"), self.table("docs"), self.table("tags"), self.table("aliases"), prompts, opts, self.postings())

    def neighborhood(self, target: str, hops: int = 1, direction: str = "both", no_auto: bool = False, no_symbols: bool = False, limit: int = 200) -> DataFrame:
        root = graph.resolve_target(self.table("nodes"), target)
        e = graph.walkable(self.table("edges"), self.table("nodes"), no_auto, no_symbols) if no_auto or no_symbols else self.table("edges")
        return graph.neighborhood(e, self.spark.createDataFrame([(root,)], "root string"), hops, direction, limit)

    def stats(self) -> dict[str, DataFrame]:
        n, e = self.table("nodes"), self.table("edges")
        return {"types": graph.by_type(n), "relations": graph.by_relation(e), "scopes": graph.by_scope(n), "hubs": graph.hubs(n, e)}

    def orphans(self) -> DataFrame:
        return graph.orphans(self.table("nodes"), self.table("edges"))

    def pending(self) -> DataFrame:
        return self.table("pending").orderBy("source_id", "raw_target")

    def auto_link(self, most: int | None = None) -> int:
        """Makes the soft links anew; returns their number."""
        soft = graph.auto_links(self.table("nodes"), self.table("tags"), most).withColumns({"decay_rate": F.lit(0.0), "created_at": F.lit(int(time.time())).cast("long")})
        self._publish({t: self.table(t) for t in _TABLES if t != "edges"} | {"edges": upsert.without_auto(self.table("edges")).unionByName(soft)})
        return self.table("edges").where(F.col("relation_type").startswith("auto_")).count()

    def plan_links(self, limit: int = 200) -> DataFrame:
        names = lexicon.surfaces(self.table("nodes"), self.table("aliases")).where("n = 1").select("surface", "node_id")
        found = lexicon.mentions(self.table("docs").select(F.col("node_id").alias("id"), F.col("content").alias("body")), names)
        return lexicon.plan(found, self.table("edges"), limit)

    def apply_links(self, write: bool = False, style: str = "inline", tiers: tuple[str, ...] = ("normalize", "auto"), limit: int = 200) -> DataFrame:
        """The edits that link the notes; with write, those of the tiers are made in the files, but for generated ones.

        style: `inline` puts mentions as links where they stand, `related` lists them
        under a heading; texts of links are put as ids in both.
        """
        n, aliases = self.table("nodes"), self.table("aliases")
        rows = [(r.id, text) for r in n.where("file_path like '%.md'").select("id", "file_path").distinct().collect() if (at := Path(self.root, r.file_path)).exists() and (text := at.read_text()) is not None]
        paths = {r.id: r.file_path for r in n.where("file_path like '%.md'").select("id", "file_path").collect()}
        notes = self.spark.createDataFrame([(i, t, paths[i]) for i, t in rows], "id string, body string, path string").where(~context.generated(F.col("path"), F.col("body"))).select("id", "body")
        links = linking.normalised(notes, n, aliases)
        edits = links.unionByName(linking.discovered(notes, n, aliases, self.table("edges"), limit)).where(F.col("tier").isin(*tiers) | F.lit(not write)).orderBy("id", "start")
        edits = self.spark.createDataFrame(edits.collect(), edits.schema)  # the plan as it was, also once files have changed
        if write:
            new = {r.id: r.body for r in linking.applied(notes, edits.where("tier = 'normalize'") if style == "related" else edits).collect()}
            if style == "related":
                now = self.spark.createDataFrame([(i, new.get(i, t)) for i, t in rows], "id string, body string")
                new |= {r.id: r.body for r in linking.applied(now, edits.where("tier <> 'normalize'"), style).collect()}
            for i, body in new.items():
                Path(self.root, paths[i]).write_text(body)
        return edits

    def export(self, path: str, decouple: bool = False, scope: str | None = None) -> None:
        bundle.export(self.table("nodes"), self.table("edges"), path, scope=scope, decouple=decouple)

    def import_(self, path: str, scope: str | None = None) -> None:
        """Puts a bundle in; its nodes are searchable by title and summary at once."""
        n, e = bundle.import_(self.spark, path, self.table("nodes"), self.table("edges"), scope)
        own = n.join(self.table("docs").select(F.col("node_id").alias("id")), "id", "left_anti").select(F.col("id").alias("node_id"), "title", F.coalesce("summary", F.lit("")).alias("content"), F.lit("").alias("tags"))
        self._publish({t: self.table(t) for t in _TABLES} | {"nodes": n, "edges": e, "docs": self.table("docs").unionByName(own)})

    def doctor(self) -> DataFrame:
        read = lambda name: next((p.read_text() for p in Path(self.root).iterdir() if p.name.lower() == name), None)
        readme, log = read("readme.md"), read("changelog.md")
        m, n = self.manifest(), self.table("nodes")
        try:
            m.validate()
            bad = 0
        except GraphError:
            bad = 1
        multi = m.mode == "multi"
        roots = scopes.roots_frame(self.spark, m) if m.scopes else self.spark.createDataFrame([], "root string, scope string")
        text = self.spark.createDataFrame([(readme or "", log or "")], "r string, c string").select(mass(F.col("r")).alias("r"), mass(F.col("c")).alias("c"), F.size(changelog_versions(F.col("c"))).alias("v")).first()
        facts = {
            "has_tables": self.version > 0, "has_adjacency": (self.home / f"v{self.version}" / "adjacency").exists(), "has_docs": Path(self.root, "docs").is_dir(), "has_ignore": Path(self.root, ".graphloomignore").exists(), "has_agents": Path(self.root, "AGENTS.md").exists(),
            "has_readme": readme is not None, "readme_mass": text["r"], "readme_lines": sum(bool(x.strip()) for x in (readme or "").splitlines()), "has_changelog": log is not None, "changelog_mass": text["c"], "changelog_versions": text["v"], "has_manifest": Path(self.root, "Cargo.toml").exists(),
            "multi": multi, "manifest_errors": bad, "scopes": len(m.scopes), "missing_roots": sum(not Path(self.root, r).exists() for s in m.scopes for r in s.roots), "empty_scopes": scopes.empty(n, roots).count() if multi else 0, "unknown_scopes": scopes.unknown(n, roots).count() if multi else 0,
        }
        return doctor.findings(doctor.counts(n, self.table("edges"), self.table("docs"), self.table("pending"), facts))

    def watch(self, changes: DataFrame, checkpoint: str, once: bool = False, after: Callable[[dict[str, int]], None] | None = None) -> StreamingQuery:
        def each(_: DataFrame, __: int) -> None:
            done = self.sync()
            if after:
                after(done)

        return watch.watch(changes, each, checkpoint, once=once)

    def note(self, kind: str, title: str, body: str = "", tags: tuple[str, ...] = ()) -> Path:
        """Writes a note of a type and refuses to put it over another."""
        folder = {"goal": "goals", "adr": "adr", "concept": "concepts", "edge_case": "edge-cases", "plan": "plans"}.get(kind, kind)
        at = Path(self.root, "docs", folder, re.sub("[^a-z0-9]+", "-", title.lower()).strip("-") + ".md")
        if at.exists():
            raise GraphError(f"{at} is there already")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"---\nnode_type: {kind}\ntitle: {json.dumps(title)}\ntags: [{', '.join(tags)}]\n---\n# {title}\n\n{body}\n")
        return at

    def dependencies(self) -> DataFrame:
        m = [Path(self.root, x, "Cargo.toml") for x in ("", *workspace.members(self.root))]
        lock = Path(self.root, "Cargo.lock")
        return self.spark.createDataFrame(workspace.dependencies([p.read_text() for p in m if p.exists()], lock.read_text() if lock.exists() else None), "name string, version string, kind string")


def search_all(graphs: list[KnowledgeGraph], query: str, limit: int = 50) -> DataFrame:
    """One search over several workspaces."""
    return search.merged([(g.root, g.search(query, search.SearchOptions(limit=limit)).withColumn("query_id", F.lit(0))) for g in graphs], limit).drop("query_id")

