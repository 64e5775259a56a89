"""Names that notes may be linked by, and where texts mention them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import path_stem
from ..functions.text import stopwords, words

#: Names too common to link by, besides the stopwords.
COMMON = (
    "v1 v2 data lib pub vec sync doc read load id field build mod trace code node see page edge table file list map app number user tests body key run todo info link goal api path type "
    "add related generated scaffold method service reference usage apache the example title module name readme time home fixme none edge-case edge_case false license date update create template crate state delete write note value true save alternative remove config warning string log debug graph ok install yaml symbol impl param item system enum open fn main column decision version application implementation function option json warn return markdown cargo bootstrap http adr super server error err docs ids fields methods consequences nodes edges files examples modules notes logs analysis links goals params functions returns https users errors concepts status keys struct set trait mit default result client concept test checklist const rust input output text context new row index array summary query static self"
)
_LEAST = {"symbol": 3, "alias": 3, "title": 4, "stem": 4}


def surfaces(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(surface in lower case, kind, n nodes, node_id): n > 1 is ambiguous and not for linking."""
    notes, symbols = nodes.where("node_type <> 'symbol'"), nodes.where("node_type = 'symbol'")
    leaf = F.regexp_extract("id", r"([^/:]*)$", 1)
    all_ = symbols.select(leaf.alias("s"), "id", F.lit("symbol").alias("kind"), F.lit(2).alias("k"))
    all_ = all_.unionByName(notes.select(F.col("title").alias("s"), "id", F.lit("title").alias("kind"), F.lit(0).alias("k")))
    all_ = all_.unionByName(notes.select(path_stem(F.col("file_path")).alias("s"), "id", F.lit("stem").alias("kind"), F.lit(1).alias("k")))
    all_ = all_.unionByName(aliases.select(F.col("alias").alias("s"), F.col("node_id").alias("id"), F.lit("alias").alias("kind"), F.lit(3).alias("k")))
    d = all_.withColumn("surface", F.lower(F.trim("s"))).where("surface <> ''").groupBy("surface").agg(F.min_by("kind", "k").alias("kind"), F.count_distinct("id").alias("n"), F.min("id").alias("node_id"))
    least = F.col("kind")
    out = F
    for kind, n in _LEAST.items():
        out = out.when(least == kind, F.lit(n))
    return d.where((F.length("surface") >= out) & ~F.col("surface").isin(*stopwords(), *words(COMMON)))


def fingerprint(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: a number that changes when a name does; sums of hashes, so in any order."""
    h = nodes.select(F.xxhash64("id", "title", "file_path", "node_type").alias("h")).unionByName(aliases.select(F.xxhash64("alias", "node_id").alias("h")))
    return h.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"))


def masked(c: Column) -> Column:
    """The text with what must not be linked put as a mark: front matter, code, links, headings."""
    for p in (r"(?s)\A---\n.*?\n---", r"(?ms)^```.*?(?:^```|\z)", r"`[^`\n]*`", r"\[\[[^\]\n]*\]\]", r"\[[^\]\n]*\]\([^)\n]*\)", r"(?m)^#+ .*$"):
        c = F.regexp_replace(c, p, "\x00")
    return c


#: Most first words of names that are looked for in a text before n-grams are made; with more, n-grams are made of all words.
FEW_WORDS = 5000


def mentions(texts: DataFrame, names: DataFrame, max_words: int | None = None) -> DataFrame:
    """texts (id, body), names (surface, node_id) to (id, surface, node_id, n): names as whole words, of overlapping ones the longest.

    Word n-grams meet the names by equality, whatever the number of names: up to
    as many words as the longest name has, or up to max_words where that is given. Of mentions that
    overlap, the first counts and of those with one start the longest.
    """
    word = r"[\p{L}\p{N}_]+(?:[-.:/'][\p{L}\p{N}_]+)*"
    in_name = F.regexp_extract_all("surface", F.lit(word), F.lit(0))
    keyed = names.select(F.array_join(in_name, " ").alias("gram"), "surface", "node_id").where("gram <> ''")
    if max_words is None:
        max_words = names.agg(F.max(F.size(in_name))).first()[0] or 1
    first = [r.w for r in keyed.select(F.substring_index("gram", " ", 1).alias("w")).distinct().limit(FEW_WORDS + 1).collect()]

    def grams_of(w: Column) -> Column:
        n = F.size(w)
        start = F.sequence(F.lit(0), n - 1)
        if len(first) <= FEW_WORDS:  # only where a name may begin
            start = F.filter(start, lambda i: F.get(w, i).isin(*first))
        at = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(max_words), n - i)), lambda k: F.struct(i.alias("at"), k.alias("k"), F.array_join(F.slice(w, i + 1, k), " ").alias("gram")))
        return F.when(n > 0, F.flatten(F.transform(start, at)))

    found = F.regexp_extract_all(F.lower(masked(F.col("body"))), F.lit(word), F.lit(0))
    once = F.get(F.transform(F.array(found), grams_of), F.lit(0))  # the words are found once, not for every gram
    grams = texts.select("id", F.inline(once))
    hits = grams.join(keyed, "gram")
    longest = Window.partitionBy("id", "at").orderBy(F.desc("k"), "surface")
    hits = hits.withColumn("_r", F.row_number().over(longest)).where("_r = 1")
    step = lambda acc, x: F.when(x["at"] >= acc["end"], F.struct((x["at"] + x["k"]).alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    each = hits.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "k", "surface", "node_id"))).alias("m"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,k:int,surface:string,node_id:string>>").alias("kept"))
    kept = each.select("id", F.explode(F.aggregate("m", start, step)["kept"]).alias("m"))
    return kept.groupBy("id", "m.surface", "m.node_id").agg(F.count("*").alias("n"))


def plan(found: DataFrame, edges: DataFrame, limit: int = 200) -> DataFrame:
    """Links to propose: a target once a note and none to itself; with a common neighbour or two mentions the link is sure (auto), else a suggestion."""
    linked = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("node_id")).unionByName(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("node_id"))).distinct().withColumn("near", F.lit(True))
    one = Window.partitionBy("id", "node_id").orderBy(F.desc("n"), F.desc(F.length("surface")), "surface")
    d = found.where("id <> node_id").withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r").join(linked, ["id", "node_id"], "left")
    tier = F.when(F.col("near") | (F.col("n") >= 2), "auto").otherwise("suggest")
    return d.select("id", "node_id", "surface", "n", tier.alias("tier")).orderBy("tier", "id", "node_id").limit(limit)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for body, spans in zip(b.column("body").to_pylist(), b.column("spans").to_pylist(), strict=True):
            at = len(body or "")
            for s in sorted(spans or [], key=lambda s: -s["start"]):
                if not 0 <= s["start"] <= s["end"] <= at:
                    raise ValueError("spans overlap or lie outside the text")
                body = body[: s["start"]] + s["after"] + body[s["end"] :]
                at = s["start"]
            out.append(body)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], names=["id", "body"])


def rewrite(notes: DataFrame) -> DataFrame:
    """notes (id, body, spans array<struct<start,end,after>>) with the spans replaced, from the last to the first."""
    return notes.select(F.col("id").cast("string"), "body", "spans").mapInArrow(_rewrite, "id string, body string")
