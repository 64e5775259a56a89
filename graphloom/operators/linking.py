"""Edits that link notes: texts of links put as ids, mentions put as links, and a section of related notes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon, resolve

_FIELDS = "id string, start int, end int, before string, after string, node_id string, tier string"
_LINK = re.compile(r"\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]")
#: What is no prose: front matter, fenced and inline code.
_CODE = re.compile(r"\A---\n.*?\n---(?=\n|\Z)|^```.*?(?:^```|\Z)|`[^`\n]*`", re.S | re.M)
_OTHER = re.compile(r"\[\[[^\]\n]*\]\]|\[[^\]\n]*\]\([^)\n]*\)|^#+ .*$", re.M)
RELATED = "## Related"


def blanked(text: str, *patterns: re.Pattern[str]) -> str:
    """The text with every match put as as many marks, so that places stay."""
    for p in patterns:
        text = p.sub(lambda m: "\0" * len(m[0]), text)
    return text


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, m.start(), m.end(), m[1].strip(), m[2]) for i, x in zip(b.column("id").to_pylist(), b.column("body").to_pylist(), strict=True) for m in _LINK.finditer(blanked(x or "", _CODE))]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "start", "end", "raw_target", "label"])


def links(notes: DataFrame) -> DataFrame:
    """notes (id, body) to (id, start, end, raw_target, label): the wiki links outside code, by code points."""
    return notes.select(F.col("id").cast("string"), "body").mapInArrow(_found, "id string, start int, end int, raw_target string, label string")


def normalised(notes: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edits of links that resolve by alias, title or path suffix, to links by id that show the same text."""
    found = links(notes).withColumns({"source_id": F.col("id"), "relation_type": F.lit("relates_to")})
    found = resolve.resolve(found, nodes, aliases).where("target_id is not null and target_id <> raw_target")
    shown = F.coalesce(F.when(F.trim("label") != "", F.col("label")), F.col("raw_target"))
    before = F.concat(F.lit("[["), "raw_target", F.coalesce(F.concat(F.lit("|"), "label"), F.lit("")), F.lit("]]"))
    return found.select("id", "start", "end", before.alias("before"), F.concat(F.lit("[["), "target_id", F.lit("|"), shown, F.lit("]]")).alias("after"), F.col("target_id").alias("node_id"), F.lit("normalize").alias("tier"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, body, wanted in zip(*(b.column(c).to_pylist() for c in ("id", "body", "wanted")), strict=True):
            text = blanked(body or "", _CODE, _OTHER)
            taken: list[tuple[int, int]] = []
            for w in sorted(wanted, key=lambda w: (-len(w["surface"]), w["surface"])):  # longer names first
                at = next((m.span() for m in re.finditer(rf"(?<![\w]){re.escape(w['surface'])}(?![\w])", text, re.I) if not any(m.start() < e and s < m.end() for s, e in taken)), None)
                if at:
                    taken.append(at)
                    rows.append((i, *at, body[slice(*at)], f"[[{w['node_id']}|{body[slice(*at)]}]]", w["node_id"], w["tier"]))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[f.split()[0] for f in _FIELDS.split(", ")])


def discovered(notes: DataFrame, nodes: DataFrame, aliases: DataFrame, edges: DataFrame, limit: int = 200) -> DataFrame:
    """Edits of first mentions of unambiguous names to links, as lexicon.plan() proposes them."""
    names = lexicon.surfaces(nodes, aliases).where("n = 1").select("surface", "node_id")
    wanted = lexicon.plan(lexicon.mentions(notes, names), edges, limit).groupBy("id").agg(F.collect_list(F.struct("surface", "node_id", "tier")).alias("wanted"))
    return notes.select(F.col("id").cast("string"), "body").join(wanted, "id").select("id", "body", "wanted").mapInArrow(_placed, _FIELDS)


def tallies(edits: DataFrame) -> DataFrame:
    """How many edits of each tier, and in how many notes."""
    return edits.groupBy("tier").agg(F.count("*").alias("n"), F.count_distinct("id").alias("notes"))


def with_related(body: Column, ids: Column) -> Column:
    """The text with a line for each id under the heading of related notes, which is put at the end where it lacks; ids that the text links already are left out."""
    new = F.filter(F.array_distinct(ids), lambda i: ~body.contains(F.concat(F.lit("[["), i, F.lit("]]"))) & ~body.contains(F.concat(F.lit("[["), i, F.lit("|"))))
    lines = F.array_join(F.transform(new, lambda i: F.concat(F.lit("- [["), i, F.lit("]]"))), "\n")
    has = F.concat(F.lit("\n"), body, F.lit("\n")).contains(f"\n{RELATED}\n")
    inside = F.regexp_replace(body, F.lit(rf"(?m)^{RELATED}\n"), F.concat(F.lit(f"{RELATED}\n"), F.regexp_replace(lines, r"([\\$])", r"\\$1"), F.lit("\n")))
    after = F.concat(F.regexp_replace(body, r"\s+\z", ""), F.lit(f"\n\n{RELATED}\n\n"), lines, F.lit("\n"))
    return F.when(F.size(new) == 0, body).when(has, inside).otherwise(after)


def applied(notes: DataFrame, edits: DataFrame, style: str = "inline") -> DataFrame:
    """notes (id, body) that the edits change, changed: in place, or with links to their nodes under the related heading."""
    if style == "related":
        ids = edits.groupBy("id").agg(F.array_sort(F.collect_set("node_id")).alias("ids"))
        return notes.join(ids, "id").select("id", with_related(F.col("body"), F.col("ids")).alias("body"))
    spans = edits.groupBy("id").agg(F.collect_list(F.struct("start", "end", "after")).alias("spans"))
    return lexicon.rewrite(notes.join(spans, "id"))
