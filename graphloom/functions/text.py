"""Tokens, queries and Markdown pieces as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import QueryError

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīįłńňōőřśšţťūůűźżž"
_PLAIN = "aaaaaa" "c" "eeee" "iiii" "n" "ooooo" "uuuu" "yy" "aaa" "cc" "d" "eee" "g" "ii" "l" "nn" "oo" "r" "ss" "tt" "uuu" "zzz"

#: Words that carry no topic, by length.
STOPWORDS = (
    "a i be me we if of an in on do no so to up or as is vs at it by my via had did and the are use off all can own who too per for nor our has was its get "
    "not but out you few how may why need used find once make same some here were more else have give each such with both look tell will them whom from "
    "than been then when down also into help over your does this that what want most just must show they only very could would there where these those "
    "whose above being using which shall again under other after their needs wants might about below should before please during versus looking through "
    "between explain further against describe summarize "
)
GENERIC = "tool repo code tools stack system design project software codebase overview structure repository architecture"
RELEASE = "v3 v2 v1 semver history shipped version upgrade release versions released releases breaking migration changelog unreleased changelogs"
PLANNING = "next plan todo epic todos epics story status sprint kanban stories backlog roadmap planning priority milestone prioritize priorities milestones"


def words(text: str) -> list[str]:
    return text.split()


def stopwords() -> list[str]:
    return sorted(words(STOPWORDS))


def index_tokens(c: Column) -> Column:
    """Tokens of the index: lower case, without accents, split at all but letters and digits."""
    return F.filter(F.split(F.translate(F.lower(F.coalesce(c, F.lit(""))), _ACCENTED, _PLAIN), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_tokens(c: Column) -> Column:
    """Tokens of a query: lower case; letters, digits and _ - : . stay together, bare marks go."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\-:.]+"), lambda t: ~t.isin("", "-", "_", ":", "."))


def significant_tokens(tokens: Column) -> Column:
    """Without stopwords and one-byte tokens; if none is left without one-byte tokens; else all. Distinct, in order."""
    long_ = F.filter(tokens, lambda t: F.octet_length(t) > 1)
    kept = F.array_distinct(F.filter(long_, lambda t: ~t.isin(*stopwords())))
    return F.when(F.size(kept) > 0, kept).when(F.size(long_) > 0, F.array_distinct(long_)).otherwise(tokens)


def is_generic(tokens: Column) -> Column:
    return F.forall(tokens, lambda t: t.isin(*words(GENERIC)))


def is_release(tokens: Column) -> Column:
    return F.exists(tokens, lambda t: t.isin(*words(RELEASE)) | t.rlike("^v[0-9]") | (t.rlike(r"^[0-9.]{3,}$") & t.contains(".")))


def is_planning(tokens: Column) -> Column:
    return F.exists(tokens, lambda t: t.isin(*words(PLANNING)))


def prepared(query: str) -> list[str]:
    """Significant tokens of one query, on the driver; it fails if there are none."""
    import re

    all_ = [t for t in re.split(r"[^\w\-:.]+", query.lower()) if t not in ("", "-", "_", ":", ".")]
    if not all_:
        raise QueryError("a query needs a letter or digit")
    long_ = [t for t in all_ if len(t.encode()) > 1]
    stop = set(stopwords())
    return list(dict.fromkeys(t for t in long_ if t not in stop)) or list(dict.fromkeys(long_)) or all_


def without_code(c: Column) -> Column:
    """Markdown without fenced blocks (an open one to the end) and code in backticks."""
    return F.regexp_replace(F.regexp_replace(c, r"(?ms)^```.*?(?:^```|\z)", ""), r"(?s)`[^`]*(?:`|\z)", "")


def wiki_links(c: Column) -> Column:
    """[[target#section|alias]] outside code: array of (target, section, alias), in order."""
    inner = F.regexp_extract_all(without_code(c), F.lit(r"\[\[([^\n]*?)\]\]"), F.lit(1))

    def link(x: Column) -> Column:
        left, alias = F.regexp_extract(x, r"^([^|]*)", 1), F.when(x.contains("|"), F.trim(F.regexp_extract(x, r"^[^|]*\|(.*)$", 1)))
        section = F.when(left.contains("#"), F.trim(F.regexp_extract(left, r"^[^#]*#(.*)$", 1)))
        return F.struct(F.trim(F.regexp_extract(left, r"^([^#]*)", 1)).alias("target"), section.alias("section"), alias.alias("alias"))

    return F.filter(F.transform(inner, link), lambda x: x["target"] != "")


def symbol_refs(c: Column) -> Column:
    """Paths of symbol:... outside code, without closing marks."""
    raw = F.regexp_extract_all(without_code(c), F.lit(r"symbol:([^\s\]),;\"']+)"), F.lit(1))
    return F.filter(F.transform(raw, lambda x: F.regexp_replace(x, r"[.!?:]+$", "")), lambda x: x != "")


def html_links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r'<a href="([^"]*)"'), F.lit(1))


def without_frontmatter(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?s)\A\s*---\n?.*?\n---[\r\n]*", ""))


def excerpt(c: Column, n: int) -> Column:
    """The trimmed text, cut to n characters with an ellipsis for the last."""
    t = without_frontmatter(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t)


def mass(c: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(c, r"\s", ""))


def first_heading(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, r"(?m)^# +(.+)$", 1)), F.lit(""))


def first_line(c: Column) -> Column:
    """The first line that is neither empty, a heading, a rule nor a comment."""
    return F.nullif(F.trim(F.regexp_extract(c, r"(?m)^(?!\s*(?:#|---|<!--|```))[ \t]*(\S.*)$", 1)), F.lit(""))


def changelog_heading(body: Column) -> Column:
    """The first version heading, without its marks."""
    h = F.regexp_extract(body, r"(?mi)^[ \t]*##[ \t]*(\[.*|unreleased[ \t]*)$", 1)
    return F.nullif(F.trim(h), F.lit(""))


def changelog_versions(body: Column, most: int = 8) -> Column:
    """Versions named in headings, newest first; unreleased work has none."""
    v = F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*##[ \t]?\[([^\]\n]*)\]"), F.lit(1)), lambda x: F.trim(x))
    return F.slice(F.array_distinct(F.filter(v, lambda x: (F.length(x) >= 3) & (F.lower(x) != "unreleased"))), 1, most)


def rustdoc(c: Column) -> Column:
    """Doc comments without their slashes and stars."""
    return F.regexp_replace(F.regexp_replace(c, r"(?m)^[ \t]*(?:///|//!)[ ]?", ""), r"(?m)^[ \t]*(?:/\*\*|\*/|\*)[ ]?", "")


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def readme_sections(c: Column) -> Column:
    """(heading, body) of second-level sections about goals, reasons or features."""
    parts = F.slice(F.split(c, r"(?m)^## +"), 2, 1000)
    cut = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"\A([^\n]*)", 1)).alias("heading"), F.trim(F.regexp_replace(p, r"\A[^\n]*\n?", "")).alias("body")))
    return F.filter(cut, lambda p: F.lower(p["heading"]).rlike("goal|why|feature|overview|about|architecture|status|roadmap"))
