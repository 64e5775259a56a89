"""Identifiers of nodes, symbols and scopes, and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitized(c: Column) -> Column:
    """A path segment in lower case: letters, digits and . _ - stay, white space becomes one dash, the rest goes."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9._\s\\-]", ""), r"[\s\\]+", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"-{2,}", "-"), r"^-(?=.)", ""), r"-+$", "")


def node_id(path: Column) -> Column:
    """The id of a note: its path's segments, sanitised, without the last extension; root hubs have names of their own."""
    parts = F.filter(F.transform(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".", "..")), sanitized), lambda x: x != "")
    joined = F.regexp_replace(F.array_join(parts, "/"), r"(?<=[^/])\.[^./]*$", "")
    low = F.lower(path)
    hub = F.when(low == "readme.md", "readme").when(low.isin("changelog.md", "changes.md", "history.md"), "changelog").when(low == "roadmap.md", "roadmap").when(low == "backlog.md", "backlog")
    return F.coalesce(hub, F.nullif(joined, F.lit("")), F.lit("untitled"))


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")


def slug_token(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.substring(c, 1, 48)), "[^a-z0-9]+", "_"), "^_|_$", "")


def path_stem(path: Column) -> Column:
    """The file name without extension, in lower case; null for names that many files share."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))
    return F.when(~(stem.isin("", "readme", "template", "from-readme", "bootstrap-checklist") | stem.contains("generated")), stem)


def symbol_id(crate: Column, module: Column, name: Column) -> Column:
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_.:-]", "_")
    return F.concat_ws("/", F.lit("symbol"), safe(crate), safe(F.regexp_replace(module, "::|/", ".")), safe(name))


def symbol_parts(path: Column) -> Column:
    """crate, module and name of a::b::C; Type::method stays one name where the type is capitalised."""
    p = F.split(path, "::")
    n = F.size(p)
    typed = (n >= 2) & F.get(p, n - 2).rlike("^[A-Z]")
    k = F.when(typed, 2).otherwise(1)
    name = F.array_join(F.slice(p, n - k + 1, k), "::")
    rest = F.slice(p, 1, n - k)
    return F.struct(F.get(rest, F.lit(0)).alias("crate"), F.array_join(F.slice(rest, 2, 100), "::").alias("module"), name.alias("name"))


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def symbol_hash(crate: Column, module: Column, name: Column) -> Column:
    """Depends on the symbol's path alone, so that it outlives moves between files."""
    return F.xxhash64(F.concat_ws("::", crate, module, name))


def module_path(path: Column) -> Column:
    """src/a/b.rs to a::b; lib, main and mod name the module above."""
    inner = F.regexp_replace(F.regexp_replace(path, r"^.*?src/", ""), r"\.rs$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, r"(^|/)(?:lib|main|mod)$", ""), "/", "::"), "^$", "crate")


def version_key(c: Column) -> Column:
    """Numbers of a version, for comparing: 1.10.0 is after 1.9."""
    return F.transform(F.regexp_extract_all(F.regexp_extract(c, r"^([0-9.]*)", 1), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))


def docs_url(name: Column, version: Column) -> Column:
    return F.format_string("https://docs.rs/%s/%s", name, F.coalesce(version, F.lit("latest")))


def crate_url(name: Column) -> Column:
    return F.concat(F.lit("https://crates.io/crates/"), name)
