import json

import pytest
from pyspark.sql import functions as F

from graphloom.brain import KnowledgeGraph, search_all
from graphloom.functions import ids, planstatus, text
from graphloom.operators import doctor, lexicon, resolve, scopes, upsert
from graphloom.schema import BundleError, NotFound, ScopeError
from graphloom.sources import bundle, workspace
from graphloom.streaming import watch

RUST = '''//! crate docs
/// Stores things, see [[docs/concepts/raft]].
pub struct StorageEngine { x: u32 }
impl StorageEngine {
    /// Opens it.
    pub fn open(path: &str) -> Self { let s = "{"; Self { x: 1 } }
    pub async fn close(&self) {
    }
}
pub trait Backend { fn get(&self) -> u8; }
enum Kind { A, B }
mod inner {
    pub const LIMIT: u32 = 3;
}
'''


@pytest.fixture
def project(tmp_path):
    for path, body in {
        "docs/concepts/raft.md": "---\ntags: [consensus, storage]\naliases:\n  - raft protocol\n---\n# Raft\n\nLeader election; see [[LogCompaction]] and symbol:demo::StorageEngine.\n",
        "docs/concepts/logcompaction.md": "# LogCompaction\n\nSnapshots for the raft protocol, at length. `[[no]]` [[nowhere]]\n",
        "docs/adr/0001-use-raft.md": "# Use Raft\n\nWe use [[docs/concepts/raft|Raft]] for replication.\n",
        "README.md": "# Demo\n\nA store.\n## Goals\nFast.\n",
        "CHANGELOG.md": "# Changelog\n## [0.3.14] - 2026-07-31\n- more\n",
        "src/lib.rs": RUST,
        "target/x.md": "# no\n",
        "map.canvas": json.dumps({"nodes": [{"id": "1", "type": "file", "file": "docs/concepts/raft.md"}, {"id": "2", "type": "text", "text": "# LogCompaction\nmore"}], "edges": [{"fromNode": "1", "toNode": "2", "label": "needs"}]}),
    }.items():
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(body)
    return tmp_path


def test_life_of_a_project(spark, project):
    with pytest.raises(NotFound):
        KnowledgeGraph.open(spark, str(project), exact=True)
    g = KnowledgeGraph.open(spark, str(project), create=True)
    first = g.sync("demo")
    n = {r.id: r for r in g.table("nodes").collect()}
    assert {"docs/concepts/raft", "docs/concepts/logcompaction", "docs/adr/0001-use-raft", "readme", "changelog", "symbol/demo/crate/StorageEngine", "symbol/demo/crate/StorageEngine::open", "symbol/demo/crate/LIMIT"} <= set(n)
    assert not any("target" in i for i in n) and n["docs/adr/0001-use-raft"].node_type == "adr" and n["changelog"].summary == "[0.3.14] - 2026-07-31"
    e = {(r.source_id, r.target_id, r.relation_type) for r in g.table("edges").collect()}
    assert ("docs/concepts/raft", "docs/concepts/logcompaction", "relates_to") in e and ("docs/concepts/raft", "docs/concepts/logcompaction", "needs") in e
    assert ("docs/concepts/raft", "symbol/demo/crate/StorageEngine", "anchors") in e and ("symbol/demo/crate/StorageEngine", "docs/concepts/raft", "doc_links") in e
    assert [r.raw_target for r in g.pending().collect()] == ["nowhere"]
    again = g.sync("demo")
    assert again["same"] == first["added"] and again["added"] == again["changed"] == 0
    (project / "docs/concepts/nowhere.md").write_text("# Nowhere\n")
    (project / "README.md").unlink()
    third = g.sync("demo")
    assert third["added"] == 1 and third["removed"] == 1 and third["pending"] == 0
    assert g.search("replication").first().id == "docs/adr/0001-use-raft"
    assert {r.id for r in g.search("raft protocol").collect()} >= {"docs/concepts/raft", "docs/concepts/logcompaction"}
    packed = [r.id for r in g.context("replication of raft").collect()]
    assert "docs/adr/0001-use-raft" in packed and "docs/concepts/raft" in packed
    assert len(g.context("raft", None).collect()) >= 1
    assert g.neighborhood("raft").count() == 3
    assert {r.code for r in g.doctor().collect()} >= {"no_readme", "no_goals"} and doctor.healthy(g.doctor())
    g.export(str(project / "bundle"), decouple=True)
    other = KnowledgeGraph.open(spark, str(project / "copy"), create=True, exact=True)
    other.import_(str(project / "bundle"), scope="team")
    assert other.table("nodes").where("scope = 'team'").count() == len([i for i in n if not i.startswith("symbol/")])
    assert other.search("raft").count() > 0
    assert search_all([g, other], "raft", 3).count() == 3
    assert g.auto_link() >= 0 and {r.id for r in g.orphans().collect()} == {"changelog"}
    assert any(r.node_id == "docs/concepts/raft" for r in g.plan_links().collect())
    assert g.note("concept", "New Idea").exists()


def test_bundles_are_checked(spark, tmp_path):
    p = tmp_path / "b.json"
    p.write_text(json.dumps({"version": 9, "name": "x", "nodes": [], "edges": []}))
    with pytest.raises(BundleError):
        bundle.read(spark, str(p))
    p.write_text(json.dumps({"version": 1, "name": "x", "created_at": 1, "nodes": [{"id": "a", "node_type": "concept", "title": "A", "created_at": 1, "updated_at": 1}], "edges": [{"source_id": "a", "target_id": "zz", "relation_type": "relates_to", "weight": 1.0}]}))
    n, e = bundle.read(spark, str(p))
    assert n.count() == 1 and e.count() == 1
    with pytest.raises(BundleError):
        bundle.import_(spark, str(p), n.limit(0), e.limit(0))


def test_rust_items():
    got = {(k, n): (a, b, d) for k, n, a, b, d in workspace.rust_items(RUST)}
    assert got["struct", "StorageEngine"][:2] == (3, 3) and "Stores things" in got["struct", "StorageEngine"][2]
    assert ("fn", "StorageEngine::open") in got and got["fn", "StorageEngine::close"][:2] == (7, 8)
    assert {("trait", "Backend"), ("enum", "Kind"), ("mod", "inner"), ("const", "LIMIT")} <= set(got)


def test_dependencies_and_globs(tmp_path):
    m = '[dependencies]\nserde = "1"\nown = { path = "../own" }\n[dev-dependencies]\nserde = "0.9"\ntempfile = { version = "3" }\n'
    assert workspace.dependencies([m], '[[package]]\nname = "serde"\nversion = "1.0.9"\n[[package]]\nname = "serde"\nversion = "1.0.10"\n') == [("serde", "1.0.10", "normal"), ("tempfile", "3", "dev")]
    import re

    r = re.compile(workspace.ignore_regex(["target/", "*.tmp", "/docs/private/**", "# x", "!keep"]))
    assert r.search("a/target/x.md") and r.search("x.tmp") and r.search("docs/private/a/b.md") and not r.search("docs/a.md") and not r.search("targets.md")


def test_ids_links_and_marks(spark):
    d = spark.createDataFrame([("docs/concepts/Raft Consensus.md",), ("README.md",), ("history.md",), ("a/!!.md",)], "p string")
    assert [r[0] for r in d.select(ids.node_id(F.col("p"))).collect()][:3] == ["docs/concepts/raft-consensus", "readme", "changelog"]
    links = spark.createDataFrame([("x [[Real#S|A b]] `[[no]]`\n```\n[[no]]\n```\n[[Yes]] [[ ]]",)], "t string").select(text.wiki_links(F.col("t")).alias("l")).first().l
    assert [(x.target, x.section, x.alias) for x in links] == [("Real", "S", "A b"), ("Yes", None, None)]
    n = spark.createDataFrame([("docs/a/raft", "Raft"), ("docs/b/dup", "T"), ("docs/c/dup", "T")], "id string, title string")
    asked = spark.createDataFrame([("s", t, "relates_to") for t in ("raft", "[[Raft]]", "dup", "T", "docs/b/dup")], "source_id string, raw_target string, relation_type string")
    got = {r.raw_target: (r.target_id, r.tier) for r in resolve.resolve(asked, n, spark.createDataFrame([], "alias string, node_id string")).collect()}
    assert got["raft"][0] == "docs/a/raft" and got["dup"] == (None, None) and got["T"] == (None, None) and got["docs/b/dup"] == ("docs/b/dup", "id")


def test_plans(spark):
    body = "# Plan\n## Status\nin progress\n## Backlog\n- [ ] a\n- [x] b\n## In Progress (now)\n- [?] c\n* [weird] d\n- wip: e\n## Cancelled\n- [~] f\n## Notes\n- [huh] g\n"
    d = spark.createDataFrame([("p", body, None)], "id string, body string, status string")
    got = {r.text: r.status for r in planstatus.tasks(d.select("id", "body")).collect()}
    assert got == {"a": "backlog", "b": "done", "c": "qa", "d": "in_progress", "e": "in_progress", "f": "cancelled", "g": "backlog"}
    r = planstatus.digest(d).first()
    assert (r.overall, r.open, r.done, r.cancelled) == ("in_progress", 5, 1, 1)


def test_scopes(spark, tmp_path):
    m = scopes.Manifest().add(scopes.Scope("web", ("apps/web",), ("site",))).add(scopes.Scope("deep", ("apps/web/deep",)))
    assert m.find("site").id == "web" and scopes.for_folder(m, "apps/web/deep/x") == "deep"
    with pytest.raises(ScopeError):
        m.add(scopes.Scope("main", ("x",)))
    m.save(str(tmp_path / "s.json"))
    assert scopes.Manifest.load(str(tmp_path / "s.json")) == m and scopes.Manifest.load(str(tmp_path / "none")).mode == "single"
    p = spark.createDataFrame([("apps/web/a.md",), ("apps/web/deep/b.md",), ("apps/webby/c.md",)], "path string")
    assert {r.path: r.scope for r in scopes.assign(p, scopes.roots_frame(spark, m)).collect()} == {"apps/web/a.md": "web", "apps/web/deep/b.md": "deep", "apps/webby/c.md": "main"}


def test_changes_keep_the_first_date(spark):
    old = spark.createDataFrame([("a", "main", 1), ("b", "x", 1)], "id string, scope string, created_at long")
    got = {r.id: tuple(r) for r in upsert.nodes(old, spark.createDataFrame([("a", "", 9), ("c", "y", 9)], old.schema)).collect()}
    assert got == {"a": ("a", "main", 1), "b": ("b", "x", 1), "c": ("c", "y", 9)}


def test_mentions_take_the_longest(spark):
    names = spark.createDataFrame([("raft", "r"), ("raft log", "l"), ("log", "g")], "surface string, node_id string")
    t = spark.createDataFrame([("n", "A Raft log, a raft. `raft` [[raft]] rafting logs")], "id string, body string")
    assert {(r.node_id, r.n) for r in lexicon.mentions(t, names).collect()} == {("l", 1), ("r", 1)}
    r = lexicon.rewrite(spark.createDataFrame([("n", "ab cd", [{"start": 0, "end": 2, "after": "[[x]]"}, {"start": 3, "end": 5, "after": "Z"}])], "id string, body string, spans array<struct<start:int,end:int,after:string>>")).first()
    assert r.body == "[[x]] Z"


def test_bursts_on_a_stream(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").where("user_id < 20").select("user_id", "ts")
    e.write.parquet(str(tmp_path / "in"))
    s = watch.bursts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "user_id", "ts", "6 hours", "0 seconds")
    q = s.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    whole = {tuple(r) for r in watch.bursts(e, "user_id", "ts", "6 hours").collect()}
    given = {tuple(r) for r in spark.table("bursts").collect()}
    assert given and given <= whole and len(given) > 0.8 * len(whole)
    seen = []
    f = spark.createDataFrame([("a.md",), ("x.png",), ("target/b.md",)], "path string")
    f.write.json(str(tmp_path / "f"))
    watch.watch(spark.readStream.schema("path string").json(str(tmp_path / "f")), lambda b, n: seen.extend(r.path for r in b.collect()), str(tmp_path / "w"), once=True).awaitTermination()
    assert seen == ["a.md"]
