"""Secret scans: fixed patterns, and a randomness test battery under false-discovery control."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Shortest run of code characters that the battery judges.
SHORTEST = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
#: Parts of a run at equals signs (those at its end are padding), and parts of these at what joins names and paths.
PIECE, PART = re.compile(r"[^=]+(?:=+\Z)?"), re.compile(r"[^/_-]{%d,}" % SHORTEST)
#: Lengths from which a class of its own begins for the false-discovery control.
CLASSES = (20, 24, 32, 48, 96, 192)
BINS, RATE, LAMBDA = 200, 0.05, 0.5

_COMMON = "etaoinshrdlcumwfgypbvkjxqz"  # frequent letters first, so that cells of neighbours tell prose from chance
_DIGITS = "0123456789"
#: Encodings from the smallest alphabet; a run has the first that holds all its characters.
ALPHABETS = (
    _DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _COMMON, _COMMON.upper(), _COMMON.upper() + "234567", _COMMON + _DIGITS, _COMMON.upper() + _DIGITS,
    _COMMON + _COMMON.upper(), _COMMON + _COMMON.upper() + _DIGITS, _COMMON + _COMMON.upper() + _DIGITS + "+/", _COMMON + _COMMON.upper() + _DIGITS + "-_", _COMMON + _COMMON.upper() + _DIGITS + "+/-_=",
)
_RANK = [{c: i for i, c in enumerate(a)} for a in ALPHABETS]
_ORDER = [{c: i for i, c in enumerate(sorted(a))} for a in ALPHABETS]


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def randomness(run: str) -> float:
    """The battery's p-value of a run under 'drawn evenly and independently from its encoding's alphabet'.

    Chi-squared over cells of the alphabet (as many as the length gives five each),
    runs of character classes or of halves of the alphabet, and serial correlation
    at lag 1; the least of the three, corrected for being the least (Sidak).
    """
    s = run.rstrip("=")
    which = next((i for i, r in enumerate(_RANK) if all(c in r for c in s)), None)
    if which is None or len(s) < 8:
        return 0.0
    rank = _RANK[which]
    v, n, size = [rank[c] for c in s], len(s), len(rank)
    cells = max(2, min(size, n // 5))
    want = [0.0] * cells
    for x in range(size):
        want[x * cells // size] += n / size
    got = [0] * cells
    for x in v:
        got[x * cells // size] += 1
    chi = sum((g - w) ** 2 / w for g, w in zip(got, want, strict=True))
    df = cells - 1
    p_chi = _upper(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    kinds = [_class(c) for c in rank]
    if len(set(kinds)) > 1:
        share = [kinds.count(k) / size for k in range(4)]
        marks = [_class(c) for c in s]
    else:
        share = [(size // 2) / size, (size - size // 2) / size]
        marks = [x >= size // 2 for x in v]
    turn = 1 - sum(x * x for x in share)
    turns = sum(a != b for a, b in zip(marks, marks[1:], strict=False))
    sd = math.sqrt(max(1e-9, (n - 1) * turn * (1 - turn)))
    p_runs = 2 * _upper(max(0.0, abs(turns - (n - 1) * turn) - 0.5) / sd)
    order = _ORDER[which]
    v = [order[c] for c in s]
    mean = sum(v) / n
    var = sum((x - mean) ** 2 for x in v)
    r = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:], strict=False)) / var if var else 1.0
    p_serial = 2 * _upper(abs(r + 1 / n) * math.sqrt(n))
    least = min(p_chi, p_runs, p_serial, 1.0)
    return 1 - (1 - least) ** 3


def _candidates(text: str, a: int, b: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the battery judges of a run: its pieces between fixed patterns and equals signs, and the parts of these; with the class of each.

    Parts hang on their pieces, so they have length classes of their own.
    """
    out = []
    for s, _, e in [*found, (b, 0, b)]:
        for m in PIECE.finditer(text[a : min(s, b)]) if s > a else ():
            if len(m[0]) >= SHORTEST:
                at = a + m.start()
                out.append((at, a + m.end(), length_class(len(m[0]))))
                out += [(at + p.start(), at + p.end(), len(CLASSES) + length_class(len(p[0]))) for p in PART.finditer(m[0]) if p.span() != (0, len(m[0]))]
        a = max(a, e)
        if a >= b:
            break
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans (start, kind, end) of the fixed patterns, and what of the runs the battery may judge."""
    runs = [m.span() for m in RUN.finditer(text)]
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS) or not text.isascii():
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for a, b in runs:  # any match of the other two lies within a run of code characters
        part = text[a:b]
        if "AKIA" in part:
            found += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(part) if len(m[0]) >= 20]
        if b - a >= 24:
            found += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(part) if len(m[0]) >= 24]
    found.sort()
    free = [c for a, b in runs for c in _candidates(text, a, b, found)]
    return found, free


def length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES) - 1


def judged(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, bin of the p-value) of each candidate outside the fixed patterns."""
    return [(a, b, c, min(BINS - 1, int(randomness(text[a:b]) * BINS))) for a, b, c in base_spans(text)[1]]


_SPAN = "array<struct<s:int,k:int,e:int>>"
_SCAN = f"doc_id long, base {_SPAN}, base_sha256 string, runs array<struct<s:int,e:int,c:int,p:int>>"


def _label(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_t = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
    run_t = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("c", pa.int32()), ("p", pa.int32())]))
    for b in batches:
        bases, runs, digests = [], [], []
        for x in b.column("text"):
            text = x.as_py() or ""
            found, free = base_spans(text)
            bases.append([{"s": s, "k": k, "e": e} for s, k, e in found])
            digests.append(hashlib.sha256(_label(found).encode()).hexdigest())
            runs.append([{"s": s, "e": e, "c": c, "p": min(BINS - 1, int(randomness(text[s:e]) * BINS))} for s, e, c in free])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bases, base_t), pa.array(digests), pa.array(runs, run_t)], names=["doc_id", "base", "base_sha256", "runs"])


def thresholds(counts: dict[tuple[int, int], int], rate: float = RATE) -> list[int]:
    """The first bin of each length class from which runs are taken for random; BINS for none.

    Random runs have even p-values, others crowd at 0: those above LAMBDA tell how
    many random ones there are, so of the runs from a bin on, all but the random
    share of them are false. The first bin that keeps false ones within the rate counts.
    """
    out = []
    for c in range(2 * len(CLASSES)):
        n = [counts.get((c, p), 0) for p in range(BINS)]
        top = int(LAMBDA * BINS)
        random = sum(n[top:]) / (1 - LAMBDA)
        first, above = BINS, 0
        for p in reversed(range(BINS)):
            above += n[p]
            if above and 1 - random * (1 - p / BINS) / above <= rate:
                first = p
        out.append(first)
    return out


def _control(scanned: DataFrame) -> list[int]:
    r = scanned.select(F.explode("runs").alias("r")).groupBy("r.c", "r.p").count()
    return thresholds({(x["c"], x["p"]): x["count"] for x in r.collect()})  # at most 2 * len(CLASSES) * BINS rows


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to the spans of each row; a row for each row.

    A null text is empty. The false-discovery control counts the runs of all rows,
    repeated ones too; without runs there is nothing to add. Null ids stay. Spans
    count code points, the end exclusive. An empty table gives an empty one.
    """
    s = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, _SCAN))
    first = F.array(*map(F.lit, _control(s)))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    s = s.withColumn("runs", F.filter("runs", lambda r: r["p"] >= F.get(first, r["c"])))
    # a part of a piece that is taken is the same secret
    outer = F.filter("runs", lambda r: ~F.exists("runs", lambda o: (o["s"] <= r["s"]) & (o["e"] >= r["e"]) & (o["e"] - o["s"] > r["e"] - r["s"])))
    more = F.transform(outer, lambda r: F.struct(r["s"].alias("s"), F.lit(3).alias("k"), r["e"].alias("e")))
    spans = F.array_sort(F.concat("base", more))
    names = F.array(*map(F.lit, KINDS))
    return s.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), "base_sha256",
        F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",").alias("spans"),
        F.size(more).cast("long").alias("n_random"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document; nulls, repeats and empty tables as in scan()."""
    return scan(table(spark, sf_dir, "documents"))


def masked(text: str, first: list[int], mask: str = "[SECRET]") -> str:
    """The text with each span, or union of overlapping ones, put as the mask."""
    found, _ = base_spans(text)
    spans = sorted([(s, e) for s, _, e in found] + [(s, e) for s, e, c, p in judged(text) if p >= first[c]])
    out, at = [], 0
    for s, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; its secrets are masked and n_chars, where the table has it, follows.

    Null and empty texts stay as they are, as do null ids, repeated rows and further
    columns. An empty table gives an empty one.
    """
    first = _control(cut(docs.select(F.lit(None).cast("long").alias("doc_id"), "text").mapInArrow(_scan, _SCAN).select("runs")))

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, n = b.schema.get_field_index("text"), b.schema.get_field_index("n_chars")
            old = b.column(i).to_pylist()
            new = [x if x is None else masked(x, first) for x in old]
            if n >= 0:
                sizes = [c if x == y else len(y) for c, x, y in zip(b.column(n).to_pylist(), old, new, strict=True)]
                b = b.set_column(n, b.schema.field(n), pa.array(sizes, pa.int64()).cast(b.schema.field(n).type))
            yield b.set_column(i, b.schema.field(i), pa.array(new, b.schema.field(i).type))

    return docs.mapInArrow(mask, docs.schema)
