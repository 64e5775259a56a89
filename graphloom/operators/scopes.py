"""Owner scopes of paths: manifest, longest prefix, and changes."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MAIN, ScopeError


@dataclass(frozen=True)
class Scope:
    id: str
    roots: tuple[str, ...]
    aliases: tuple[str, ...] = ()
    source: str = "manual"


@dataclass(frozen=True)
class Manifest:
    mode: str = "single"
    scopes: tuple[Scope, ...] = field(default_factory=tuple)

    def validate(self) -> None:
        """No reserved or repeated name, no root twice or inside another scope's root."""
        names = [n for s in self.scopes for n in (s.id, *s.aliases)]
        if MAIN in names or len(set(names)) < len(names) or any(scope_id(s.id) != s.id for s in self.scopes):
            raise ScopeError("scope names must be clean, distinct and other than main")
        roots = [(r.strip("/"), s.id) for s in self.scopes for r in s.roots]
        if len({r for r, _ in roots}) < len(roots) or any(not r or ".." in r.split("/") for r, _ in roots):
            raise ScopeError("roots must be distinct paths below the workspace")

    def find(self, name: str) -> Scope | None:
        return next((s for s in self.scopes if name == s.id or name in s.aliases), None)

    def add(self, scope: Scope) -> Manifest:
        out = replace(self, mode="multi", scopes=(*self.scopes, scope))
        out.validate()
        return out

    def remove(self, name: str) -> Manifest:
        s = self.find(name)
        if s is None:
            raise ScopeError(f"no scope {name}")
        return replace(self, scopes=tuple(x for x in self.scopes if x is not s))

    def save(self, path: str) -> None:
        self.validate()
        at = Path(f"{path}.new")
        at.write_text(json.dumps({"version": 1, "mode": self.mode, "scopes": [s.__dict__ for s in self.scopes]}, indent=1))
        at.replace(path)

    @staticmethod
    def load(path: str) -> Manifest:
        """A missing file, or one that names no scopes, is the single mode."""
        if not Path(path).exists():
            return Manifest()
        d = json.loads(Path(path).read_text())
        return Manifest(d.get("mode", "single"), tuple(Scope(s["id"], tuple(s.get("roots", ())), tuple(s.get("aliases", ())), s.get("source", "manual")) for s in d.get("scopes", ())))


def scope_id(name: str) -> str:
    return re.sub(r"^[-_]+|[-_]+$", "", re.sub(r"[^a-z0-9_-]+", "-", name.strip().lower()))


def roots_frame(spark, manifest: Manifest) -> DataFrame:
    """(root, scope): as many rows as the manifest has roots, which is a file that people write."""
    return spark.createDataFrame([(r.strip("/"), s.id) for s in manifest.scopes for r in s.roots], "root string, scope string")


def prefixes(path: Column) -> Column:
    """The path and all folders above it."""
    parts = F.split(F.regexp_replace(path, "^/+", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def assign(paths: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """Rows with scope: that of the longest root that is the path or a folder above it, else main.

    An equi-join of the paths' prefixes with the roots; rows do not multiply beyond
    their depth and are brought together by path.
    """
    each = paths.select(path).distinct()
    hit = each.select(path, F.explode(prefixes(F.col(path))).alias("root")).join(roots, "root").groupBy(path).agg(F.max_by("scope", F.struct(F.length("root"), "scope")).alias("scope"))
    return paths.drop("scope").join(hit, path, "left").withColumn("scope", F.coalesce("scope", F.lit(MAIN)))


def overlaps(roots: DataFrame) -> DataFrame:
    """Pairs of roots of which one is the other or above it."""
    inner = roots.select("scope", F.col("root").alias("inner"), F.explode(prefixes(F.col("root"))).alias("root"))
    return inner.join(roots.select("root", F.col("scope").alias("outer_scope")), "root").where("scope <> outer_scope or inner <> root").select(F.col("root").alias("outer_root"), "outer_scope", F.col("inner").alias("inner_root"), F.col("scope").alias("inner_scope"))


def reconcile(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, scope, expected) of nodes whose scope is not what their path says."""
    have = nodes.where("file_path is not null").select("id", "file_path", F.col("scope").alias("had"))
    return assign(have, roots, "file_path").where("scope <> had").select("id", F.col("had").alias("scope"), F.col("scope").alias("expected"))


def absorb(nodes: DataFrame, name: str | None = None) -> DataFrame:
    """Nodes of one scope, or of all, put in main."""
    return nodes.withColumn("scope", F.lit(MAIN) if name is None else F.when(F.col("scope") == name, MAIN).otherwise(F.col("scope")))


def unknown(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Scopes of nodes that the manifest lacks."""
    return nodes.where(F.col("scope") != MAIN).groupBy("scope").agg(F.count("*").alias("n")).join(roots.select("scope").distinct(), "scope", "left_anti")


def empty(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Scopes of the manifest that no node has."""
    return roots.select("scope").distinct().join(nodes.select("scope").distinct(), "scope", "left_anti")


def for_folder(manifest: Manifest, folder: str) -> str:
    """The scope of a folder within the workspace."""
    best = ("", MAIN)
    for s in manifest.scopes:
        for r in s.roots:
            if PurePosixPath(folder).is_relative_to(r.strip("/")) and len(r) > len(best[0]):
                best = (r, s.id)
    return best[1]


def imported_links(body: Column, below: str) -> Column:
    """Links to paths, as they are to be in notes that were copied below a folder; other links stay."""
    return F.regexp_replace(body, r"\[\[((?:docs|src|crates)/)", f"[[{below.strip('/')}/$1")
