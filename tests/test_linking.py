from pyspark.sql import functions as F

from graphloom.brain import KnowledgeGraph
from graphloom.operators import context, linking

from .test_workspace import project  # noqa: F401


def test_links_are_put_as_ids_outside_code(spark):
    nodes = spark.createDataFrame([("docs/a", "Alpha"), ("docs/b", "Beta")], "id string, title string")
    aliases = spark.createDataFrame([("the first", "docs/a")], "alias string, node_id string")
    body = "---\ntitle: [[Alpha]]\n---\n[[Alpha]] `[[Beta]]` [[the first|One]] [[docs/b]] [[nobody]] é [[Beta]]\n```\n[[Alpha]]\n```\n"
    notes = spark.createDataFrame([("n", body), ("m", None), ("e", "")], "id string, body string")
    edits = linking.normalised(notes, nodes, aliases)
    assert sorted((r.before, r.after) for r in edits.collect()) == [("[[Alpha]]", "[[docs/a|Alpha]]"), ("[[Beta]]", "[[docs/b|Beta]]"), ("[[the first|One]]", "[[docs/a|One]]")]
    assert {r.tier: (r.n, r.notes) for r in linking.tallies(edits).collect()} == {"normalize": (3, 1)}
    out = {r.id: r.body for r in linking.applied(notes, edits).collect()}
    assert out == {"n": body.replace("\n[[Alpha]] `", "\n[[docs/a|Alpha]] `").replace("[[the first|One]]", "[[docs/a|One]]").replace("é [[Beta]]", "é [[docs/b|Beta]]")}


def test_related_section(spark):
    rows = [(1, "# T\ntext [[docs/a]]", ["docs/a", "docs/b"]), (2, "# T\n\n## Related\n- [[docs/c]]\n", ["docs/b", "docs/c"]), (3, "x", []), (4, "y\n", ["docs/$1", "docs/$1"])]
    d = spark.createDataFrame(rows, "i int, body string, ids array<string>")
    got = {r.i: r.t for r in d.select("i", linking.with_related(F.col("body"), F.col("ids")).alias("t")).collect()}
    assert got == {1: "# T\ntext [[docs/a]]\n\n## Related\n\n- [[docs/b]]\n", 2: "# T\n\n## Related\n- [[docs/b]]\n- [[docs/c]]\n", 3: "x", 4: "y\n\n## Related\n\n- [[docs/$1]]\n"}


def test_generated_files(spark):
    rows = [("a.md", "---\ngenerated: true\n---\nx"), ("b.md", "---\ntitle: x\n---\ngenerated: true"), ("x.generated.md", ""), ("c.md", None), ("d.md", "---\n" + "k: v\n" * 25 + "generated: true\n---\n")]
    d = spark.createDataFrame(rows, "p string, t string")
    assert {r.p for r in d.where(context.generated(F.col("p"), F.col("t"))).collect()} == {"a.md", "x.generated.md"}


def test_apply_links_to_files(spark, project):  # noqa: F811
    g = KnowledgeGraph.open(spark, str(project), create=True)
    g.sync("demo")
    was = {p: p.read_text() for p in project.glob("docs/**/*.md")}
    plan = g.apply_links()
    assert {p: p.read_text() for p in was} == was
    assert {(r.id, r.before, r.after) for r in plan.where("tier = 'normalize'").collect()} == {("docs/concepts/raft", "[[LogCompaction]]", "[[docs/concepts/logcompaction|LogCompaction]]")}
    assert ("docs/concepts/logcompaction", "[[docs/concepts/raft|raft protocol]]") in {(r.id, r.after) for r in plan.collect()}
    g.apply_links(write=True, tiers=("normalize", "auto", "suggest"))
    assert "see [[docs/concepts/logcompaction|LogCompaction]] and" in (project / "docs/concepts/raft.md").read_text()
    assert "Snapshots for the [[docs/concepts/raft|raft protocol]], at length. `[[no]]`" in (project / "docs/concepts/logcompaction.md").read_text()
    g.sync("demo")
    assert g.apply_links().where("tier = 'normalize'").count() == 0


def test_apply_links_under_a_heading(spark, project):  # noqa: F811
    g = KnowledgeGraph.open(spark, str(project), create=True)
    g.sync("demo")
    g.apply_links(write=True, style="related", tiers=("normalize", "auto", "suggest"))
    text = (project / "docs/concepts/logcompaction.md").read_text()
    assert "for the raft protocol, at" in text and "## Related\n\n- [[docs/concepts/raft]]" in text
