"""Document fingerprints from closed syncmers; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Units of a text: up to four letters or digits, counted from a word's start, or one other character; characters of scripts that write no spaces are units by themselves.
UNIT = r"[\p{L}\p{N}&&[^\u0E00-\u0EFF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF]]{1,4}|[^\x20\x09-\x0D]"
#: A k-mer is K units; its inner substrings are of S units.
K, S = 8, 2
#: Bits of the number of units from one anchor to the next, which is K - S at most, and hexadecimal digits of an anchor.
GAP_BITS, DIGITS = 4, 9
#: Documents of a run of neighbours, about.
RUN = 1024
#: Most runs whose table is broadcast (at about 40 bytes a row); more are joined by a shuffle.
FEW_RUNS = 50_000


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value worked out once: within a lambda, an expression from outside is worked out for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def anchors(text: Column) -> Column:
    """All anchors of a text in text order, each as hash << GAP_BITS | the number of units since the one before.

    Closed syncmers: a k-mer of units is chosen if the least hash of its inner
    s-mers is at its first or last place, so that the choice depends on the k-mer
    alone; of any K - S + 1 in a row one at least is chosen, so that anchors grow
    with the text and no stretch is without. An anchor is the 32-bit hash of a chosen
    k-mer. A text of fewer units is one k-mer; one without any has no anchors. Null:
    as the empty text.
    """
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))
    w = K - S + 1
    packed = lambda h, gap: F.shiftleft(h.bitwiseAND(F.lit(0xFFFFFFFF)), GAP_BITS) + gap

    def of(u: Column) -> Column:
        n = F.size(u)
        inner = F.transform(F.sequence(F.lit(0), n - S), lambda i: F.xxhash64(*[F.get(u, i + j) for j in range(S)]))

        def chosen(h: Column) -> Column:
            def edge(i: Column) -> Column:
                least = F.least(*[F.get(h, i + j) for j in range(w)])
                return (F.get(h, i) == least) | (F.get(h, i + (w - 1)) == least)

            whole = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(0, w, S)])
            return _let(F.filter(F.sequence(F.lit(0), n - K), edge), lambda at: F.transform(at, lambda i, k: packed(whole(i), i - F.coalesce(F.get(at, k - 1), i))))

        short = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(packed(F.xxhash64(F.array_join(u, "\x00")), F.lit(0))))
        return F.when(n < K, short).otherwise(_let(inner, chosen))

    return _let(units, of)


def fingerprint(anchors: Column) -> Column:
    """The anchors as text, DIGITS hexadecimal digits each; without any, empty."""
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(x), DIGITS, "0")), "")


def links(anchors: Column) -> Column:
    """What a text's anchors say of position: a hash of each with its distance from the one before, repeats once.

    Two texts share a link where two neighbouring anchors are at the same distance
    in both, wherever that is, so a passage is matched after any shift.
    """
    return F.array_distinct(_let(anchors, lambda v: F.transform(v, lambda x, i: F.xxhash64(x, F.shiftright(F.get(v, i - 1), GAP_BITS)))))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two texts by their links, 0 to 1: twice those in common by the number of both.

    Two texts without anchors are alike, one without and another are not.
    """
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(2 * F.size(F.array_intersect(a, b)) / n)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, known, run, tie: runs of neighbouring ids, as wide as hold RUN rows on the whole; rows without id come first, by text hash."""
    n, low, high = docs.select(F.col("doc_id").cast("long").alias("i")).agg(F.count("i"), F.min("i"), F.max("i")).first()
    bits = max(0, ((high - low + 1) * RUN // n).bit_length() - 1) if n else 0
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    none, tie = F.col("doc_id").isNull(), F.xxhash64("text")
    return d.withColumns({"known": ~none, "run": F.when(none, F.shiftright(tie, 44)).otherwise(F.shiftright("doc_id", min(bits, 63))), "tie": F.when(none, tie).otherwise(F.col("doc_id"))})


def _heads(keyed: DataFrame) -> DataFrame:
    """A row a run: the least tie of the run, and the run before it (before the first: the last)."""
    runs = keyed.groupBy("known", "run").agg(F.min("tie").alias("tie")).sort("known", "run")
    runs = cut(runs.withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33).cast("int")
    counts = {r["p"]: r["count"] for r in runs.groupBy(part.alias("p")).count().collect()}  # a row a partition
    starts, n = [0] * (max(counts, default=-1) + 1), 0
    for p in range(len(starts)):
        starts[p], n = n, n + counts.get(p, 0)
    if not n:
        return runs.select("known", "run", "tie", F.col("known").alias("to_known"), F.col("run").alias("to_run"))
    ranked = runs.withColumn("r", F.get(F.array(*[F.lit(x) for x in starts]), part) + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    to = ranked.select(F.col("known").alias("to_known"), F.col("run").alias("to_run"), ((F.col("r") + 1) % n).alias("r"))
    heads = ranked.join(to, "r").select("known", "run", "tie", "to_known", "to_run")
    return F.broadcast(heads) if n <= FEW_RUNS else heads


def prints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_anchors; a row for each row.

    A fingerprint holds every closed syncmer of its text in text order with its
    distance from the one before, whatever the length; the near_ columns match them
    in position. Repeats within a text count once in a likeness.

    The next document comes from a window over runs of neighbouring ids, to each of
    which a copy of the following run's first row is sent, so that texts move once
    and no task holds more than a run; a second window over the same rows brings the
    next document's links. Null texts are empty. Of rows with one id, that of the
    lesser text is first; rows without id come before all others. A single row is
    followed by itself. An empty table gives an empty one.
    """
    d = _keyed(docs)
    heads = _heads(d).select(F.col("known").alias("_known"), F.col("run").alias("_run"), F.col("tie").alias("_tie"), "to_known", "to_run")
    d = d.join(heads, (F.col("known") == F.col("_known")) & (F.col("run") == F.col("_run")) & (F.col("tie") == F.col("_tie")), "left")
    own = F.struct(F.lit(False).alias("guest"), F.col("known").alias("k"), F.col("run").alias("r"))
    guest = F.struct(F.lit(True).alias("guest"), F.col("to_known").alias("k"), F.col("to_run").alias("r"))
    d = d.select("doc_id", "text", "tie", F.explode(F.when(F.col("to_run").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("at"))
    d = d.select("doc_id", "text", "tie", "at.guest", "at.k", "at.r")
    w = Window.partitionBy("k", "r").orderBy("guest", "tie", "text")
    d = d.withColumn("next_text", F.lead("text").over(w))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))})
    d = d.select("doc_id", "text", "tie", "guest", "k", "r", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), anchors(F.col("text")).alias("anchors"), F.when(~F.col("guest"), anchors(F.col("edited"))).alias("edited_anchors"))
    d = d.withColumns({"links": links(F.col("anchors")), "edited_links": links(F.col("edited_anchors"))})
    d = d.withColumn("next_links", F.lead("links").over(w)).where("not guest")
    near = [likeness(F.col("links"), F.col(c)).alias(f"near_{c.removesuffix('_links')}") for c in ("edited_links", "next_links")]
    return d.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("anchors")).alias("fingerprint"), fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"), *near, F.size("anchors").cast("long").alias("n_anchors"))


def op3_syncmer_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document against its edited text and the next document; nulls, repeats and empty tables as in prints()."""
    return prints(table(spark, sf_dir, "documents"))
