"""Files of a workspace: walk, ignore globs, notes, canvases, Rust items and manifests."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..schema import RELATES, node_type

IGNORED = (".git/", "target/", "node_modules/", ".brain/", ".venv/", "venv/", "dist/", "build/", "__pycache__/", ".idea/", ".vscode/", ".cache/", "vendor/", ".obsidian/", "coverage/")


def ignore_regex(lines: list[str]) -> str:
    """One expression for globs as ignore files have them; negated ones are passed over.

    A glob with a slash is of the whole path, others are of any name; a closing
    slash means folders.
    """
    out = []
    for raw in lines:
        g = raw.strip()
        if not g or g[0] in "#!":
            continue
        folder, g = g.endswith("/"), g.rstrip("/")
        rooted, g = "/" in g, g.lstrip("/")
        body = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|\*|\?|[^*?]+", g)).replace(".*/", "(?:.*/)?")
        out.append(("^" if rooted else "(?:^|/)") + body + ("/" if folder else "(?:/|$)"))
    return "|".join(out) or r"(?!)"


def files(spark: SparkSession, root: str, globs: list[str] | None = None) -> DataFrame:
    """(path, content, content_hash) of notes, canvases and Rust files below root; unreadable ones are left to Spark's ignoreCorruptFiles."""
    base = root.rstrip("/")
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,canvas,rs}").load(base)
    rel = F.regexp_replace("path", "^(?:file:)?/*" + re.escape(base.removeprefix("file:").lstrip("/")) + "/", "")
    d = d.select(rel.alias("path"), F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("content"), F.unix_timestamp("modificationTime").alias("at"))
    return d.where(~F.col("path").rlike(ignore_regex([*IGNORED, *(globs or [])])))


def _listed(front: Column, key: str) -> Column:
    """A front matter list, in brackets or as dashes."""
    flat = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\[([^\]]*)\]", 1)
    dashes = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[^\n]*\n?)+)", 1)
    one = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*([^\[\s][^\n]*)$", 1)
    parts = F.when(flat != "", F.split(flat, ",")).when(dashes != "", F.split(dashes, "\n")).when(one != "", F.array(one)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "^[\\s\\-\"']+|[\\s\"']+$", "")), lambda x: x != "")


def notes(found: DataFrame) -> DataFrame:
    """Markdown files as rows: id, node_type, title, summary, tags, aliases, links, symbols, body, status."""
    d = found.where(F.lower("path").endswith(".md"))
    front = F.regexp_extract("content", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    value = lambda k: F.nullif(F.regexp_replace(F.regexp_extract(front, rf"(?m)^{k}:[ \t]*([^\n\[]+?)[ \t]*$", 1), "^[\"']|[\"']$", ""), F.lit(""))
    body = F.regexp_replace("content", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    folder = F.regexp_extract("path", r"^docs/([^/]+)/", 1)
    by_folder = F.when(folder == "goals", "goal").when(folder.isin("adr", "adrs", "decisions"), "adr").when(folder == "concepts", "concept").when(folder.isin("edge-cases", "edge_cases"), "edge_case").when(folder.isin("plans", "plan"), "plan").when(folder == "alternatives", "alternative").when(folder.isin("analysis", "analyses"), "analysis").when(folder.isin("reference", "references"), "reference")
    nid = ids.node_id(F.col("path"))
    by_hub = F.when(nid == "changelog", "changelog").when(nid.isin("roadmap", "backlog"), "plan").when(nid == "readme", "goal")
    return d.select(
        nid.alias("id"), F.coalesce(node_type(value("node_type")), node_type(value("type")), by_hub, by_folder, F.lit("concept")).alias("node_type"),
        F.coalesce(value("title"), text.first_heading(body), F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1)).alias("title"), F.col("path").alias("file_path"),
        F.coalesce(F.when(nid == "changelog", text.changelog_heading(body)), text.first_line(body)).alias("summary"), "content_hash",
        _listed(front, "tags").alias("tags"), F.array_distinct(F.concat(_listed(front, "aliases"), F.when(nid == "changelog", text.changelog_versions(body)).otherwise(F.array().cast("array<string>")))).alias("aliases"),
        text.wiki_links(body).alias("links"), text.symbol_refs(body).alias("symbols"), body.alias("body"), value("status").alias("status"), "at",
    )


def canvas(found: DataFrame) -> DataFrame:
    """Canvas files to (source, target, relation): names of file and text nodes, the edge's label or relates_to."""
    shape = "struct<nodes:array<struct<id:string,type:string,file:string,text:string>>,edges:array<struct<fromNode:string,toNode:string,label:string>>>"
    d = found.where(F.lower("path").endswith(".canvas")).select("path", F.from_json("content", shape).alias("c"))
    name = F.when(F.col("n.file").isNotNull(), F.regexp_replace("n.file", r"\.md$", "")).otherwise(F.trim(F.regexp_replace(F.regexp_extract("n.text", r"\A([^\n]*)", 1), r"^#+ ", "")))
    named = d.select("path", F.explode("c.nodes").alias("n")).select("path", F.col("n.id").alias("k"), name.alias("name"))
    e = d.select("path", F.explode("c.edges").alias("e")).select("path", "e.fromNode", "e.toNode", F.coalesce(F.nullif(F.trim("e.label"), F.lit("")), F.lit(RELATES)).alias("relation"))
    return e.join(named.toDF("path", "fromNode", "source"), ["path", "fromNode"]).join(named.toDF("path", "toNode", "target"), ["path", "toNode"]).select("source", "target", "relation")


_ITEM = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|async\s+|unsafe\s+|const\s+(?=fn\b)|extern\s+\"[^\"]*\"\s+)*(fn|struct|enum|trait|impl|mod|const|static|type|union|macro_rules!)\s*(<[^>]*>)?\s*([^\s;{(=:<]+)?(.*)$")


def rust_items(source: str) -> list[tuple[str, str, int, int, str]]:
    """(kind, name, first line, last line, doc) of a Rust file's items; functions of an impl or trait are Type::name.

    Braces are counted outside strings and comments, which is enough for items that
    begin on lines of their own.
    """
    out: list[list] = []
    depth, owners, docs = 0, [], []
    waiting: list[tuple[int, int]] = []
    for n, line in enumerate(source.split("\n"), 1):
        s = line.strip()
        if s.startswith(("///", "//!")):
            docs.append(s[3:].strip())
            continue
        code = re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\\\'])\'|//.*$', "", line)
        m = _ITEM.match(code)
        if m and (m[3] or m[1] == "impl"):
            kind, name = m[1], m[3] or ""
            if kind == "impl":
                target = re.search(r"\bfor\s+([\w:]+)", code)
                owner = (target[1] if target else name).split("::")[-1]
                if "{" in code:
                    owners.append((depth, owner))
            else:
                full = f"{owners[-1][1]}::{name}" if kind == "fn" and owners else name
                out.append([kind.rstrip("!"), full, n, n, "\n".join(docs)])
                if "{" in code:
                    waiting.append((depth, len(out) - 1))
                    if kind == "trait":
                        owners.append((depth, name))
        if s and not s.startswith(("#[", "//")):
            docs = []
        depth += code.count("{") - code.count("}")
        while waiting and waiting[-1][0] >= depth:
            out[waiting.pop()[1]][3] = n
        while owners and owners[-1][0] >= depth:
            owners.pop()
    return [tuple(x) for x in out]


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "kind", "name", "start_line", "end_line", "doc"]
    for b in batches:
        rows = [(p, *i) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for i in rust_items(c or "")]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k in (3, 4) else pa.string()) for k in range(6)], names=names)


def symbols(found: DataFrame, crate: Column | str = "crate") -> DataFrame:
    """Rust files to symbol anchors with their node ids."""
    d = found.where(F.lower("path").endswith(".rs")).select("path", "content").mapInArrow(_symbols, "path string, kind string, name string, start_line int, end_line int, doc string")
    c = F.lit(crate) if isinstance(crate, str) else crate
    own = F.coalesce(F.nullif(F.regexp_extract("path", r"(?:^|/)crates/([^/]+)/", 1), F.lit("")), c)
    m = ids.module_path(F.col("path"))
    return d.select(ids.symbol_id(own, m, F.col("name")).alias("id"), ids.symbol_hash(own, m, F.col("name")).alias("symbol_hash"), own.alias("crate_name"), m.alias("module_path"), F.col("name").alias("symbol_name"), F.col("path").alias("file_path"), "start_line", "end_line", text.rustdoc(F.col("doc")).alias("doc_comment"), "kind")


def dependencies(manifests: list[str], lock: str | None = None) -> list[tuple[str, str | None, str]]:
    """(name, version, kind) of Cargo manifests' texts: no path dependencies; normal before build before dev, the lock's version before a range."""
    locked: dict[str, str] = {}
    for p in tomllib.loads(lock).get("package", []) if lock else []:
        if p["name"] not in locked or _numbers(p["version"]) > _numbers(locked[p["name"]]):
            locked[p["name"]] = p["version"]
    order, out = {"normal": 0, "build": 1, "dev": 2}, {}
    for text_ in manifests:
        m = tomllib.loads(text_)
        for kind, table in (("normal", m.get("dependencies")), ("dev", m.get("dev-dependencies")), ("build", m.get("build-dependencies")), ("normal", m.get("workspace", {}).get("dependencies"))):
            for name, spec in (table or {}).items():
                if isinstance(spec, dict) and "path" in spec:
                    continue
                version = spec if isinstance(spec, str) else spec.get("version")
                if name not in out or order[kind] < order[out[name][1]]:
                    out[name] = (version, kind)
    return sorted((n, locked.get(n, v), k) for n, (v, k) in out.items())


def _numbers(v: str) -> list[int]:
    return [int(x) for x in re.findall(r"\d+", v)]


def members(root: str) -> list[str]:
    """Folders of a Cargo workspace's members, with braces and one star a segment."""
    m = Path(root, "Cargo.toml")
    if not m.exists():
        return []
    out = []
    for g in tomllib.loads(m.read_text()).get("workspace", {}).get("members", []):
        b = re.match(r"(.*)\{([^}]*)\}(.*)", g)
        for one in [b[1] + x.strip() + b[3] for x in b[2].split(",")] if b else [g]:
            out += [str(p.relative_to(root)) for p in Path(root).glob(one) if (p / "Cargo.toml").exists()]
    return sorted(set(out))


def find_root(start: str, mark: str = ".graphloom") -> str | None:
    """The folder at or above start that holds a graph."""
    here = Path(start).resolve()
    return next((str(p) for p in (here, *here.parents) if (p / mark).is_dir()), None)


def registry(path: str) -> list[str]:
    """Workspaces of a registry file that still hold a graph."""
    p = Path(path)
    return [w for w in json.loads(p.read_text()) if Path(w, ".graphloom").is_dir()] if p.exists() else []


def register(path: str, root: str) -> None:
    all_ = sorted({*registry(path), root})
    new = Path(f"{path}.new")
    new.write_text(json.dumps(all_))
    new.replace(path)


def json_path(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def json_set(c: Column, schema: str, field: str, value: Column) -> Column:
    """A JSON object with one field put."""
    return F.to_json(F.from_json(c, schema).withField(field, value))


def module_map(anchors: DataFrame) -> DataFrame:
    """A line a file: its module and the names in it, in order of lines."""
    names = F.transform(F.sort_array(F.collect_list(F.struct("start_line", "symbol_name"))), lambda x: x["symbol_name"])
    return anchors.groupBy("file_path", "module_path").agg(F.array_join(names, ", ").alias("names"))

