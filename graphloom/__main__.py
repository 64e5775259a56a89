"""python -m graphloom COMMAND: the graph of a workspace from the shell."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .brain import KnowledgeGraph, search_all
from .operators import context, doctor, scopes
from .operators.search import SearchOptions
from .schema import GraphError
from .sources import workspace


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("--root", default=".")
    p.add_argument("--registry", default=None, help="file of known workspaces")
    s = p.add_subparsers(dest="command", required=True)
    s.add_parser("init")
    s.add_parser("sync").add_argument("--crate", default="crate")
    q = s.add_parser("query")
    q.add_argument("text")
    q.add_argument("-n", type=int, default=25)
    q.add_argument("--type", action="append", default=[])
    q.add_argument("--no-symbols", action="store_true")
    q.add_argument("--scope")
    q.add_argument("--scope-mode", choices=("strict", "hubs", "main"), default="hubs")
    q.add_argument("--all-workspaces", action="store_true")
    c = s.add_parser("context")
    c.add_argument("prompt")
    c.add_argument("-m", type=int, default=2048)
    c.add_argument("--hops", type=int, default=1)
    c.add_argument("--format", choices=("markdown", "xml"), default="markdown")
    c.add_argument("--no-hop-symbols", action="store_true")
    g = s.add_parser("graph")
    g.add_argument("target", nargs="?")
    g.add_argument("--hops", type=int, default=1)
    g.add_argument("--direction", choices=("out", "in", "both"), default="both")
    g.add_argument("--no-auto", action="store_true")
    g.add_argument("--no-symbols", action="store_true")
    g.add_argument("--limit", type=int, default=200)
    k = s.add_parser("links")
    k.add_argument("--auto", action="store_true")
    k.add_argument("--discover", action="store_true")
    k.add_argument("--limit", type=int, default=200)
    d = s.add_parser("doctor")
    d.add_argument("--strict", action="store_true")
    d.add_argument("--orphans", action="store_true")
    e = s.add_parser("export")
    e.add_argument("path")
    e.add_argument("--decouple", action="store_true")
    e.add_argument("--scope")
    i = s.add_parser("import")
    i.add_argument("path")
    i.add_argument("--scope")
    n = s.add_parser("note")
    n.add_argument("kind")
    n.add_argument("title")
    o = s.add_parser("scopes")
    o.add_argument("what", choices=("list", "add", "remove", "detect"))
    o.add_argument("names", nargs="*", help="add: id and roots; remove: id; detect: folder")
    s.add_parser("deps")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    try:
        return _run(a, spark)
    except GraphError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace, spark: SparkSession) -> int:
    g = KnowledgeGraph.open(spark, a.root, create=a.command == "init")
    show = lambda d, n=1000: d.show(n, truncate=80)
    if a.command == "init":
        if a.registry:
            workspace.register(a.registry, g.root)
        print(g.root)
    elif a.command == "sync":
        print(g.sync(a.crate))
    elif a.command == "query" and a.all_workspaces:
        show(search_all([KnowledgeGraph.open(spark, w) for w in workspace.registry(a.registry or "")] or [g], a.text, a.n), a.n)
    elif a.command == "query":
        show(g.search(a.text, SearchOptions(limit=a.n, include_types=tuple(a.type), with_symbols=not a.no_symbols, scope=a.scope, scope_mode=a.scope_mode)), a.n)
    elif a.command == "context":
        rows = g.context(a.prompt, context.ContextOptions(max_tokens=a.m, hops=a.hops, hop_symbols=not a.no_hop_symbols)).collect()
        print((context.markdown if a.format == "markdown" else context.xml)(a.prompt, rows))
    elif a.command == "graph" and a.target:
        rows = g.neighborhood(a.target, a.hops, a.direction, a.no_auto, a.no_symbols, a.limit).orderBy("place").collect()
        print(context.tree(rows[0]["root"] if rows else a.target, rows))
    elif a.command == "graph":
        for d in g.stats().values():
            show(d)
    elif a.command == "links" and a.auto:
        print(g.auto_link())
    elif a.command == "links":
        show(g.plan_links(a.limit) if a.discover else g.pending())
    elif a.command == "doctor":
        found = g.doctor()
        show(found)
        if a.orphans:
            show(g.orphans())
        return int(not doctor.healthy(found, a.strict))
    elif a.command == "export":
        g.export(a.path, a.decouple, a.scope)
    elif a.command == "import":
        g.import_(a.path, a.scope)
    elif a.command == "note":
        print(g.note(a.kind, a.title))
    elif a.command == "deps":
        show(g.dependencies())
    elif a.what == "list":
        for s in g.manifest().scopes:
            print(s.id, *s.roots)
    elif a.what == "add":
        g.save_manifest(g.manifest().add(scopes.Scope(a.names[0], tuple(a.names[1:]))))
    elif a.what == "remove":
        g.save_manifest(g.manifest().remove(a.names[0]))
    else:
        print(scopes.for_folder(g.manifest(), a.names[0]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
