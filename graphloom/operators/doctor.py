"""Health of a graph: counts in one row, findings as rules over them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import mass
from ..schema import MAIN
from . import graph

#: code, severity, condition over the counts, message with counts in braces
RULES = [
    ("no_db", "error", "not has_tables", "there is no graph here or above"),
    ("no_mmap", "warn", "has_tables and not has_adjacency", "the adjacency table is missing"),
    ("empty_brain", "warn", "nodes = 0", "the graph has no nodes"),
    ("symbols_only", "warn", "notes = 0 and symbols > 0", "{symbols} symbols and not one note"),
    ("symbol_flood", "info", "notes > 0 and symbols > 20 * notes", "{symbols} symbols for {notes} notes"),
    ("pending_links", "warn", "pending > 0", "{pending} links lead nowhere yet"),
    ("fts_empty", "error", "nodes > 0 and indexed = 0", "nothing is indexed for search"),
    ("no_docs_dir", "info", "not has_docs", "there is no docs folder"),
    ("no_ignore", "info", "not has_ignore", "there is no ignore file"),
    ("no_agents_md", "info", "nodes > 0 and not has_agents", "there is no file for agents"),
    ("no_goals", "info", "nodes > 0 and goals = 0", "no node is a goal"),
    ("adr_template_only", "info", "adrs > 0 and real_adrs = 0", "decisions are templates only"),
    ("no_adrs", "info", "notes > 0 and adrs = 0", "no node is a decision"),
    ("no_readme", "info", "not has_readme", "there is no readme"),
    ("sparse_readme", "info", "has_readme and (readme_mass < 120 or readme_lines < 3)", "the readme says little"),
    ("readme_not_indexed", "info", "has_readme and nodes > 0 and readme_nodes = 0", "the readme is no node"),
    ("no_from_readme", "info", "readme_mass >= 120 and from_readme = 0", "nothing was taken from the readme"),
    ("thin_from_readme", "info", "from_readme > 0 and from_readme_mass < 180", "little was taken from the readme"),
    ("no_changelog", "info", "has_manifest and not has_changelog", "there is no changelog"),
    ("sparse_changelog", "info", "has_changelog and changelog_mass < 80", "the changelog says little"),
    ("changelog_no_versions", "info", "has_changelog and changelog_versions = 0", "the changelog names no version"),
    ("changelog_not_indexed", "info", "has_changelog and nodes > 0 and changelog_nodes = 0", "the changelog is no node"),
    ("changelog_latest", "info", "changelog_nodes > 0 and changelog_versions > 0", "the changelog names {changelog_versions} versions"),
    ("scaffold_only", "info", "substantive = 0 and (scaffold > 0 or symbols > 0)", "no note of substance"),
    ("knowledge_thin", "info", "substantive > 0 and symbols > 30 * substantive", "{symbols} symbols for {substantive} notes of substance"),
    ("multi_empty_scopes", "info", "multi and scopes = 0", "many scopes are meant and none is there"),
    ("empty_subbrain", "info", "multi and empty_scopes > 0", "{empty_scopes} scopes have no node"),
    ("scope_manifest_invalid", "warn", "manifest_errors > 0", "{manifest_errors} errors in the manifest"),
    ("scope_db_mode_mismatch", "warn", "not multi and scoped_nodes > 0", "{scoped_nodes} nodes of other scopes in single mode"),
    ("orphan_scope_rows", "warn", "multi and unknown_scopes > 0", "{unknown_scopes} scopes are not in the manifest"),
    ("missing_scope_root", "warn", "missing_roots > 0", "{missing_roots} roots are missing"),
    ("orphan_notes", "info", "orphans > 0", "{orphans} notes have no link of their own"),
]
_FLAGS = ("has_tables", "has_adjacency", "has_docs", "has_ignore", "has_agents", "has_readme", "has_changelog", "has_manifest", "multi")
_COUNTS = ("manifest_errors", "missing_roots", "readme_mass", "readme_lines", "changelog_mass", "changelog_versions", "scopes", "empty_scopes", "unknown_scopes")


def counts(nodes: DataFrame, edges: DataFrame, docs: DataFrame, pending: DataFrame, facts: Mapping[str, int | bool] | None = None) -> DataFrame:
    """One row of counts; facts are those about files and the manifest, which are no tables."""
    body = docs.select(F.col("node_id").alias("id"), mass(F.coalesce("content", F.lit(""))).alias("mass"))
    n = nodes.join(body, "id", "left").withColumn("mass", F.coalesce("mass", F.lit(0)))
    note, low = F.col("node_type") != "symbol", F.lower("id")
    scaffold = graph.noise_id(F.col("id"))
    harvest = low.contains("from-readme")
    enough = F.col("mass") >= F.when(harvest, 200).otherwise(80)
    c = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    one = n.agg(
        F.count("*").alias("nodes"), c(note).alias("notes"), c(~note).alias("symbols"), c(F.col("node_type") == "goal").alias("goals"), c(F.col("node_type") == "adr").alias("adrs"),
        c((F.col("node_type") == "adr") & ~low.contains("template")).alias("real_adrs"), c(F.col("id") == "readme").alias("readme_nodes"), c(F.col("id") == "changelog").alias("changelog_nodes"),
        c(harvest).alias("from_readme"), F.coalesce(F.sum(F.when(harvest, F.col("mass"))), F.lit(0)).alias("from_readme_mass"), c(note & enough & ~scaffold).alias("substantive"), c(note & scaffold).alias("scaffold"), c(F.col("scope") != MAIN).alias("scoped_nodes"),
    )
    single = lambda d, name: d.agg(F.count("*").alias(name))
    for d in (single(pending, "pending"), single(docs, "indexed"), single(graph.orphans(nodes, edges), "orphans")):
        one = one.crossJoin(d)  # rows of one table of one row
    facts = dict(facts or {})
    known = {**{f: True for f in _FLAGS if f != "multi"}, "multi": False, **{k: 0 for k in _COUNTS}, **facts}
    return one.withColumns({k: F.lit(v) for k, v in known.items()})


def findings(one: DataFrame) -> DataFrame:
    """(severity, code, message): a row for each rule that holds, or the one that all is well."""
    def message(text: str):
        parts, rest = [], text
        while "{" in rest:
            head, _, tail = rest.partition("{")
            name, _, rest = tail.partition("}")
            parts += [F.lit(head), F.col(name).cast("string")]
        return F.concat(*parts, F.lit(rest))

    rules = F.array(*[F.when(F.expr(f"coalesce({cond}, false)"), F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"), message(text).alias("message"))) for code, sev, cond, text in RULES])
    held = F.filter(rules, lambda r: r.isNotNull())
    ok = F.array(F.struct(F.lit("info").alias("severity"), F.lit("ok").alias("code"), F.lit("nothing to report").alias("message")))
    return one.select(F.inline(F.when(F.size(held) > 0, held).otherwise(ok)))


def healthy(found: DataFrame, strict: bool = False) -> bool:
    bad = F.col("severity") == "error"
    return found.where(bad | (F.col("code") == "pending_links") if strict else bad).isEmpty()
