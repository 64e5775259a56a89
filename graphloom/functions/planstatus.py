"""Status of plans: surface forms, checkboxes, tagged bullets, and what a plan comes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORMS = {
    "in_progress": "wip doing active started working progress inprogress in_progress",
    "backlog": "todo open later queue to_do icebox queued pending backlog",
    "qa": "qa test review verify testing in_review pr_review code_review verification",
    "done": "done fixed closed merged shipped complete resolved finished completed",
    "cancelled": "dropped wontfix wont_fix obsolete declined canceled abandoned cancelled",
    "blocked": "stuck paused undone reopen on_hold blocked deferred reopened",
}
MARKS = {"": "backlog", "x": "done", "/": "in_progress", ">": "in_progress", "o": "in_progress", "~": "cancelled", "-": "cancelled", "?": "qa", "!": "blocked"}
OPEN = ("qa", "backlog", "blocked", "in_progress")


def status(c: Column) -> Column:
    """The status that a text means as a whole; null for none."""
    t = F.regexp_replace(F.lower(F.regexp_replace(F.trim(c), "^[\"'`]+|[\"'`]+$", "")), "[- ]", "_")
    out = F
    for name, forms in FORMS.items():
        out = out.when(t.isin(*forms.split()), F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def heading_status(c: Column) -> Column:
    """Of a heading: the whole, then its first word that has one, then a part of it."""
    word = F.get(F.filter(F.transform(F.split(F.lower(c), r"\s+"), status), lambda s: s.isNotNull()), F.lit(0))
    part = F
    for key, name in (("in progress", "in_progress"), ("backlog", "backlog"), ("done", "done"), ("review", "qa"), ("cancel", "cancelled"), ("todo", "backlog"), ("blocked", "blocked")):
        part = part.when(F.lower(c).contains(key), F.lit(name))
    return F.coalesce(status(c), word, part.otherwise(F.lit(None).cast("string")))


def _mark(c: Column) -> Column:
    m, out = F.lower(F.trim(c)), F
    for k, v in MARKS.items():
        out = out.when(m == k, F.lit(v))
    return out.otherwise(status(m))


def tasks(notes: DataFrame) -> DataFrame:
    """notes (id, body) to (id, line, status, text): checkboxes and tagged bullets.

    A box takes its mark's status, else that of the heading above, else backlog; a
    heading without a status ends the one before it. A mark outweighs the heading.
    """
    box, bullet = r"^\s*[-*]\s*\[([^\]]*)\]\s*(\S.*)$", r"^\s*[-*]\s*([A-Za-z_ -]+?)\s*[:—-]\s*(\S.*)$"
    d = notes.select("id", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\r?\n")).alias("line", "t"))
    d = d.withColumn("is_head", F.col("t").rlike(r"^\s*#"))
    run = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("section", F.sum(F.col("is_head").cast("int")).over(run))
    head = F.when(F.col("is_head"), heading_status(F.trim(F.regexp_replace("t", r"^\s*#+\s*", ""))))
    d = d.withColumn("above", F.first(head, ignorenulls=False).over(Window.partitionBy("id", "section").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    is_box = F.col("t").rlike(box)
    mark = F.coalesce(_mark(F.regexp_extract("t", box, 1)), F.col("above"), F.lit("backlog"))
    tag, text = status(F.regexp_extract("t", bullet, 1)), F.trim(F.regexp_extract("t", bullet, 2))
    st = F.when(is_box, mark).when(F.col("t").rlike(bullet) & (F.octet_length(text) < 200), tag)
    body = F.when(is_box, F.trim(F.regexp_extract("t", box, 2))).otherwise(text)
    return d.where("not is_head").select("id", "line", st.alias("status"), F.when(F.length(body) > 80, F.concat(F.substring(body, 1, 79), F.lit("…"))).otherwise(body).alias("text")).where("status is not null")


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "status").agg(F.count("*").alias("n"))


def overall(rows: DataFrame) -> DataFrame:
    """(id, status) of tasks to one row a plan: overall, open, done, cancelled. What is under way outweighs what is not."""
    n = lambda s: F.count_if(F.col("status") == s)
    d = rows.groupBy("id").agg(*[n(s).alias(s) for s in FORMS])
    has = lambda s: F.col(s) > 0
    best = F.when(has("in_progress"), "in_progress").when(has("qa"), "qa").when(has("blocked"), "blocked").when(has("backlog"), "backlog").when(has("done") & ~has("cancelled"), "done").when(has("cancelled") & ~has("done"), "cancelled").otherwise("backlog")
    return d.select("id", best.alias("overall"), (F.col("qa") + F.col("backlog") + F.col("blocked") + F.col("in_progress")).alias("open"), "done", "cancelled")


def digest(notes: DataFrame) -> DataFrame:
    """notes (id, body, status of the front matter) to their plan's digest; a status that is said outweighs one that is inferred."""
    section = F.regexp_extract(F.coalesce("body", F.lit("")), r"(?mis)^#+[ \t]*status\b[^\n]*\n(.*?)(?=^\s*#|\z)", 1)
    said = F.get(F.filter(F.transform(F.split(section, r"[\s,;|]+"), status), lambda s: s.isNotNull()), F.lit(0))
    first = notes.select("id", F.coalesce(status(F.col("status")), said).alias("said"))
    return first.join(overall(tasks(notes)), "id", "left").select("id", F.coalesce("said", "overall").alias("overall"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("open", "done", "cancelled")])
