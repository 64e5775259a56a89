"""Packing the best notes and their neighbours into a budget of text."""

from __future__ import annotations

from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt, is_generic, is_planning, is_release, query_tokens, significant_tokens
from ..schema import PACK_BONUS, choose
from ..shared import few, kept
from . import graph
from .search import SearchOptions, ranked, top

#: Hubs that seed a context, with what a cold start, a release or a planning question gives them.
HUB_SCORES = {"readme": (4.5, 0.0, 0.0), "docs/goals/from-readme": (3.8, 0.0, 0.0), "docs/implementation/module-map.generated": (2.2, 0.0, 0.0), "docs/goals/readme": (1.5, 0.0, 0.0), "changelog": (3.2, 5.0, 0.0), "roadmap": (2.4, 0.0, 4.6), "backlog": (2.2, 0.0, 4.4)}


@dataclass(frozen=True)
class ContextOptions:
    max_tokens: int = 2048
    hops: int = 1
    max_seeds: int = 8
    max_nodes: int = 24
    decay: float = 0.65
    max_symbols: int = 8
    near: float = 0.55
    note_chars: int = 900
    symbol_chars: int = 280
    symbols_as_seeds: bool = False
    hop_symbols: bool = True
    types: tuple[str, ...] = ()


def generated(path: Column, text: Column | None = None) -> Column:
    """Whether a file is made by a tool: by its path, or by `generated: true` in the front matter of its first 20 lines."""
    p = F.coalesce(path, F.lit(""))
    named = p.contains("from-readme") | p.contains(".generated.")
    if text is None:
        return named
    head = F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 20), "\n")
    return named | (head.startswith("---\n") & F.rlike(F.split(F.substring(head, 5, 1 << 30), "(?m)^---").getItem(0), F.lit(r"(?m)^generated:\s*true\s*$")))


def stub(node_id: Column, title: Column, path: Column) -> Column:
    return F.lower(node_id).contains("template") | F.lower(title).contains("template") | F.endswith(F.lower(F.coalesce(path, F.lit(""))), F.lit("template.md"))


def may_pack(kind: Column, seed: bool, opts: ContextOptions) -> Column:
    """Whether a node of a type may be packed as a seed, or as a neighbour."""
    symbol = kind == "symbol"
    listed = kind.isin(*opts.types) if opts.types else F.lit(True)
    if seed:
        return listed & (F.lit(opts.symbols_as_seeds) | ~symbol)
    return (listed | symbol) & ~symbol if not opts.hop_symbols else listed | symbol


def symbol_gate(title: Column, node_id: Column, tokens: Column) -> Column:
    """Factor of a symbol as a neighbour, null to drop it: named by the query 1.8, a method 1.15; short plain names go."""
    low, leaf = F.lower(title), F.lower(F.regexp_extract(node_id, r"([^/]*)$", 1))
    asked = F.exists(tokens, lambda t: low.contains(t) | F.lower(node_id).contains(t))
    method = low.contains("::") | leaf.contains("::")
    short = (F.octet_length(low) <= 2) | ((F.octet_length(low) <= 8) & ~low.contains("_"))
    return F.when(asked, 1.8).when(method, 1.15).when(~short, 1.0)


def hub_seeds(nodes: DataFrame, prompts: DataFrame) -> DataFrame:
    """prompts (query_id, cold, release, planning) to (query_id, id, score) of the hubs that they call for."""
    score = F
    for hub, (cold, release, planning) in HUB_SCORES.items():
        score = score.when(F.col("id") == hub, F.greatest(F.when(F.col("cold"), cold).otherwise(0.0), F.when(F.col("release"), release).otherwise(0.0), F.when(F.col("planning"), planning).otherwise(0.0)))
    some = nodes.where(F.col("id").isin(*HUB_SCORES) & ~stub(F.col("id"), F.col("title"), F.col("file_path"))).select("id")
    return some.crossJoin(F.broadcast(prompts)).select("query_id", "id", score.alias("score")).where("score > 0")


def candidates(nodes: DataFrame, edges: DataFrame, docs: DataFrame, seeds: DataFrame, prompts: DataFrame, opts: ContextOptions) -> DataFrame:
    """Seeds and neighbours of each prompt with score, role, hop, excerpt and rank of packing.

    Seeds (query_id, id, score) lose by their place and when generated; neighbours
    have the best of seed times edge weights times decay a hop. The walk takes all
    prompts' seeds at once.
    """
    info = nodes.select("id", "node_type", "title", "summary", "file_path")
    s = few(kept(seeds)).join(info, "id").where(may_pack(F.col("node_type"), True, opts) & ~stub(F.col("id"), F.col("title"), F.col("file_path")))
    s = top(s, opts.max_seeds, F.desc("score"), F.col("id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")) - 1
    s = s.withColumn("score", F.col("score") / (1 + place * 0.05) * F.when(generated(F.col("file_path")), 0.85).otherwise(1.0) * F.when(F.col("node_type") == "adr", 1.08).otherwise(1.0))
    s = kept(s)
    walk = graph.k_hop(edges, s.where("node_type <> 'symbol'").select(F.col("id").alias("root")).distinct(), opts.hops)
    n = s.select("query_id", F.col("id").alias("root"), F.col("score").alias("seed")).join(walk, "root")
    n = n.join(s.select("query_id", "id"), ["query_id", "id"], "left_anti")
    n = n.withColumn("score", F.col("seed") * F.col("weight") * F.pow(F.lit(opts.decay), F.col("hop"))).groupBy("query_id", "id").agg(F.max_by(F.struct("score", "hop"), F.struct("score", -F.col("hop"))).alias("b"))
    n = n.select("query_id", "id", "b.score", "b.hop").join(info, "id").join(F.broadcast(prompts.select("query_id", "tokens")), "query_id")
    gate = F.when(F.col("node_type") == "symbol", symbol_gate(F.col("title"), F.col("id"), F.col("tokens"))).otherwise(1.0)
    n = n.where(may_pack(F.col("node_type"), False, opts)).withColumn("score", F.col("score") * gate).where("score is not null").drop("tokens")
    both = s.withColumns({"hop": F.lit(0), "role": F.lit("seed")}).unionByName(n.withColumn("role", F.lit("neighbor")))
    both = kept(both)
    docs = docs.join(few(both.select(F.col("id").alias("node_id")).distinct()), "node_id", "left_semi")
    text = F.coalesce(F.nullif(F.trim("content"), F.lit("")), "summary")
    cut = F.when(F.col("node_type") == "symbol", excerpt(text, opts.symbol_chars)).otherwise(excerpt(text, opts.note_chars))
    rank = F.col("score") + F.when(F.col("role") == "seed", 3.0).otherwise(0.0) + choose(F.col("node_type"), PACK_BONUS, 0.0)
    return both.join(docs.select(F.col("node_id").alias("id"), "content"), "id", "left").select("query_id", "id", "node_type", "title", "summary", "file_path", "role", "hop", F.round("score", 6).alias("score"), cut.alias("excerpt"), F.round(rank, 6).alias("rank"))


_PACKED = "query_id long, place int, id string, node_type string, title string, role string, hop int, score double, cost long, excerpt string, file_path string, used long"


def _pack(opts: ContextOptions):
    budget = max(4 * opts.max_tokens, 256)

    def words(t: str | None) -> set[str]:
        return {w for w in (t or "").split() if len(w.encode()) > 2}

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out, taken, bags = [], set(), []
        used = 120 + len(str(rows["prompt"].iloc[0] or "").encode())
        symbols = readme = 0
        for r in rows.sort_values(["rank", "id"], ascending=[False, True]).itertuples():
            text = lambda x: x if isinstance(x, str) else ""
            family = r.id == "readme" or "from-readme" in r.id
            if len(out) >= opts.max_nodes:
                break
            bag = words(text(r.excerpt))
            like = any(bag and b and len(bag & b) / len(bag | b) > opts.near for b in bags)
            if r.id in taken or (r.node_type == "symbol" and r.role == "neighbor" and symbols >= opts.max_symbols) or (family and readme) or like:
                continue
            cost = 48 + sum(len(text(x).encode()) for x in (r.id, r.title, r.summary, r.excerpt, r.file_path))
            if used + cost > budget and out:
                if r.role == "neighbor" or any(o[5] == "seed" for o in out):
                    continue
                break
            used += cost
            taken.add(r.id)
            bags.append(bag)
            symbols += r.node_type == "symbol" and r.role == "neighbor"
            readme += family
            out.append([r.query_id, len(out) + 1, r.id, r.node_type, r.title, r.role, r.hop, r.score, cost, r.excerpt, r.file_path, used])
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PACKED.split(", ")])

    return one


def pack(found: DataFrame, prompts: DataFrame, opts: ContextOptions | None = None) -> DataFrame:
    """Candidates in rank order into the budget: what is like a packed one, or beyond it, is passed over.

    What is taken depends on what was, so a prompt is one group; it holds at most
    the seeds and their neighbours.
    """
    d = found.join(F.broadcast(prompts.select("query_id", "prompt")), "query_id").withColumn("query_id", F.col("query_id").cast("long"))
    return d.groupBy("query_id").applyInPandas(_pack(opts or ContextOptions()), _PACKED)


def assemble(nodes: DataFrame, edges: DataFrame, docs: DataFrame, tags: DataFrame, aliases: DataFrame, prompts: DataFrame, opts: ContextOptions | None = None, index: DataFrame | None = None) -> DataFrame:
    """prompts (query_id, prompt) to packed nodes: search, hubs, walk, pack; all prompts in one plan."""
    opts = opts or ContextOptions()
    p = prompts.select("query_id", "prompt", significant_tokens(query_tokens(F.col("prompt"))).alias("tokens"))
    p = p.withColumns({"cold": is_generic(F.col("tokens")), "release": is_release(F.col("tokens")), "planning": is_planning(F.col("tokens"))})
    hits = ranked(nodes, docs, tags, aliases, p.select("query_id", "tokens"), SearchOptions(limit=max(2 * opts.max_seeds, 8)), index).select("query_id", "id", "score")
    hubs = hub_seeds(nodes, p).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return pack(candidates(nodes, edges, docs, hits.unionByName(hubs), p, opts), p, opts)


def markdown(prompt: str, rows: list) -> str:
    """A packed context as Markdown."""
    out = [f"# Context: {prompt}", ""]
    for r in rows:
        out += [f"## {r['title']} ({r['node_type']})", f"`{r['id']}` {r['role']}, score {r['score']:.2f}", "", r["excerpt"] or "", ""]
    return "\n".join(out)


def xml(prompt: str, rows: list) -> str:
    inner = "".join(f"<node id={quoteattr(r['id'])} type={quoteattr(r['node_type'])} role={quoteattr(r['role'])}><title>{escape(r['title'])}</title><excerpt>{escape(r['excerpt'] or '')}</excerpt></node>" for r in rows)
    return f"<context prompt={quoteattr(prompt)}>{inner}</context>"


def tree(root: str, rows: list) -> str:
    """A neighbourhood as an indented tree."""
    kids: dict = {}
    for r in rows:
        kids.setdefault(r["parent"], []).append(r)

    def below(x: str, depth: int) -> list[str]:
        return [line for r in kids.get(x, []) for line in ("  " * depth + f"{'->' if r['way'] == 'out' else '<-'} {r['id']} [{r['relation']} {r['weight']:.2f}]", *below(r["id"], depth + 1))]

    return "\n".join([root, *below(root, 1)])

