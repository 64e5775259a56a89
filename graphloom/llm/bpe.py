"""Byte-level BPE: higher-order functions fold ranked merges over the byte arrays of distinct words."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lookup
from .common import own_dir, parts, table

#: Words of more bytes are merged with a heap where they occur; the fold's work grows as the square of the length.
LONGEST = 1024
#: Groups and slots of the rank map, as powers of two.
GROUPS, SLOTS = 14, 17
#: Distinct words, and words, of a chunk of documents.
REMEMBER, CHUNK = 400_000, 3_000_000
_NONE = 1 << 40
#: An entry of the fold's state is rank << AT | the byte where a piece begins.
AT = 16

#: White space as the pattern has it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: White space other than a single space between words.
_ODD = re.compile(f"([{_SPACE}]{{2,}}|[{_SPACE.replace(' ', '')}])")


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of a word: the pair of least rank, leftmost first, is merged until none is known; long words with a heap, in O(n log n)."""
    if (whole := rank.get(word)) is not None:
        return [whole]
    n = len(word)
    if n <= 96:
        at, near = [*range(n + 1)], [rank.get(word[i : i + 2], _NONE) for i in range(n - 1)]
        while near and (least := min(near)) < _NONE:
            i = near.index(least)
            del at[i + 1], near[i]
            if i < len(near):
                near[i] = rank.get(word[at[i] : at[i + 2]], _NONE)
            if i:
                near[i - 1] = rank.get(word[at[i - 1] : at[i + 1]], _NONE)
        return [rank[word[a:b]] for a, b in zip(at, at[1:], strict=False)]
    start, end, back, live = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not live[i] or end[i] >= n or end[end[i]] != e or end[i] == e:
            continue
        j = end[i]  # a piece is known by its first byte; the next begins at its end
        live[j] = False
        end[i] = e
        if e < n:
            back[e] = i
            if (r := rank.get(word[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (p := back[i]) >= 0 and (r := rank.get(word[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(rank[word[start[i] : end[i]]])
        i = end[i]
    return out


@lru_cache(maxsize=4)
def _hashed(path: str) -> str:
    """The rank map of a file as JSON of a perfect hash: displacement of each group, then key (base64) and rank of each slot.

    A key of xxhash64 h is in group h mod 2^GROUPS and in slot (h >> GROUPS + the
    group's displacement) mod 2^SLOTS.
    """
    rank = ranks(path)
    group: list[list[tuple[int, bytes]]] = [[] for _ in range(1 << GROUPS)]
    for k in rank:
        h = xxhash.xxh64_intdigest(k, 42)
        group[h & (1 << GROUPS) - 1].append((h >> GROUPS, k))
    d, keys, values, most = [0] * (1 << GROUPS), [None] * (1 << SLOTS), [None] * (1 << SLOTS), (1 << SLOTS) - 1
    for g in sorted(range(1 << GROUPS), key=lambda g: -len(group[g])):
        at = [h & most for h, _ in group[g]]
        if len({*at}) < len(at):
            raise ValueError("two words of one group have one slot")  # does not happen with the vocabularies in use
        d[g] = next(x for x in range(1 << SLOTS) if all(values[a + x & most] is None for a in at))
        for a, (_, k) in zip(at, group[g], strict=True):
            keys[a + d[g] & most], values[a + d[g] & most] = base64.b64encode(k).decode(), rank[k]
    return json.dumps({"d": d, "k": keys, "v": values})


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def encoded(words: DataFrame, path: str) -> DataFrame:
    """words (key string) to key, ids array<int>: a fold over (rank of each pair, where its first piece begins), a merge a step.

    The word is its byte array and a piece a slice of it, known by the byte where it
    begins. Each step drops the second piece of the leftmost pair of the least rank
    and looks up the two pairs that this makes in the literal rank map.
    """
    table_ = F.from_json(F.lit(_hashed(path)), "struct<d:array<int>,k:array<binary>,v:array<int>>")
    place = lambda x: x.bitwiseAND(F.lit((1 << AT) - 1)).cast("int")
    entry = lambda rank, at: F.shiftleft(rank, AT) + at
    none = F.lit(_NONE)

    def word(t: Column) -> Column:
        w = F.col("key").cast("binary")
        n = F.octet_length(w)

        def of(piece: Column) -> Column:
            slot = lambda h: (F.shiftrightunsigned(h, GROUPS) + F.get(t["d"], h.bitwiseAND(F.lit((1 << GROUPS) - 1)).cast("int"))).bitwiseAND(F.lit((1 << SLOTS) - 1)).cast("int")
            return _let(slot(F.xxhash64(piece)), lambda i: F.when(F.get(t["k"], i) == piece, F.get(t["v"], i)))

        pair = lambda a, b: F.coalesce(of(F.substring(w, a + 1, b - a)).cast("long"), none)

        def step(r: Column, _: Column) -> Column:
            def merged(j: Column) -> Column:
                here, before = place(F.get(r, j - 1)), place(F.get(r, j - 2))
                end, beyond = (F.coalesce(place(F.get(r, j + k)), n) for k in (1, 2))
                left = lambda: entry(pair(before, end), before)
                right = lambda: entry(F.when(end < n, pair(here, beyond)).otherwise(none), here)
                return F.transform(F.array_remove(r, F.get(r, j)), lambda x, i: F.when(i == j - 1, right()).when(i == j - 2, left()).otherwise(x))

            least = F.array_min(r)
            return F.when(least >= _NONE << AT, r).otherwise(_let(F.array_position(r, least).cast("int"), merged))

        start = F.transform(F.sequence(F.lit(0), n - 1), lambda i: entry(F.when(i + 2 <= n, pair(i, i + 2)).otherwise(none), i))
        pieces = lambda r: F.transform(r, lambda x, i: of(F.substring(w, place(x) + 1, F.coalesce(place(F.get(r, i + 1)), n) - place(x))))
        folded = F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), start, step, pieces)
        return _let(of(w), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(folded))

    return words.select("key", _let(table_, word).alias("ids"))  # the map stands once in the plan


def _pieces(text: str) -> tuple[list[str], list[list[str]]]:
    """A text as (marks, runs of words), taken in turn: mark 0, run 0, mark 1, run 1, ...

    No token of the pattern goes across the cuts. Words of a run are apart by single
    spaces, which go with the word that follows; a mark is other white space before
    the run, of which a last space too goes with the word.
    """
    found = _ODD.split(text)
    return ["", *found[1::2]], [x.split(" ") if x else [] for x in found[::2]]


def _mark(mark: str, last: bool) -> tuple[list[str], bool]:
    """The tokens of white space between runs, and whether the next word takes a space along."""
    if not mark or last:
        return [mark] if mark else [], False
    lead = mark[-1] == " "
    return [x for x in ((mark[:-1],) if lead else (mark[:-1], mark[-1])) if x], lead


def pieces(text: str) -> list[str]:
    """The cut text in order; each piece may be given to the pattern by itself."""
    marks, runs = _pieces(text)
    out = []
    for i, (m, r) in enumerate(zip(marks, runs, strict=True)):
        tokens, lead = _mark(m, i == len(runs) - 1 and not r)
        out += tokens
        out += [f" {w}" if k or lead else w for k, w in enumerate(r)]
    return [x for x in out if x]


class _Index(dict):
    """Numbers words as they are met."""

    def __init__(self, lead: str, words: list[tuple[str, str]]) -> None:
        self.lead, self.words = lead, words

    def __missing__(self, w: str) -> int:
        n = self[w] = len(self.words)
        self.words.append((self.lead, w))
        return n


def _planes(x: np.ndarray) -> bytes:
    """Bytes of 32-bit numbers, those of one place together, which packs better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(b: pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")


def _cutter(keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(public_tokenizers.PATTERN)
        words: list[tuple[str, str]] = []
        spaced, bare = _Index(" ", words), _Index("", words)
        seq, sizes, held = array("I"), [], []

        def out() -> pa.RecordBatch:
            tokens = _Index("", [])
            split, n = array("I"), np.empty(len(words), np.uint32)
            for i, (lead, w) in enumerate(words):
                if w.isalpha():  # one token to the pattern
                    split.append(tokens[lead + w])
                    n[i] = 1
                else:
                    x = pattern.findall(lead + w)
                    split.extend(map(tokens.__getitem__, x))
                    n[i] = len(x)
            rows = pa.Table.from_batches(held).combine_chunks()
            struct = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in keep], fields=[rows.schema.field(c) for c in keep])
            of = lambda x: pa.array([_planes(np.asarray(x, np.uint32))], pa.binary())
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(struct)], pa.int32()), struct), pa.array([[w for _, w in tokens.words]], pa.list_(pa.string())), of(n), of(split), of(sizes), of(seq)], names=["rows", "tokens", "split_n", "split", "seq_n", "seq"])

        for b in batches:
            first = 0
            for k, x in enumerate(b.column("text")):
                text = x.as_py() or ""
                at = len(seq)
                if "  " not in text:  # no run of white space goes across a cut at a space
                    plain = text.split(" ")
                    seq.append(bare[plain[0]])
                    seq.extend(map(spaced.__getitem__, islice(plain, 1, None)))
                    marks, runs = [], []
                else:
                    marks, runs = _pieces(text)
                for i, (m, r) in enumerate(zip(marks, runs, strict=True)):
                    tokens, lead = _mark(m, i == len(runs) - 1 and not r)
                    if tokens:
                        seq.extend(map(bare.__getitem__, tokens))
                    if r and not lead:
                        seq.append(bare[r[0]])
                        r = r[1:]
                    seq.extend(map(spaced.__getitem__, r))
                sizes.append(len(seq) - at)
                if len(words) >= REMEMBER or len(seq) >= CHUNK:
                    held.append(b.select(keep).slice(first, k + 1 - first))
                    yield out()
                    words.clear(), spaced.clear(), bare.clear(), held.clear(), sizes.clear()
                    seq, first = array("I"), k + 1
            if first < b.num_rows:
                held.append(b.select(keep).slice(first))
        if held:
            yield out()

    return run


def chunked(docs: DataFrame, to: str) -> DataFrame:
    """docs (doc_id, text, ...) to chunks of rows, written to the folder: the other columns, distinct tokens, words as tokens, texts as words.

    Texts are cut once. A chunk ends at so many words or distinct words, so its size
    is bounded but for one text. A null text is empty.
    """
    keep = [c for c in docs.columns if c not in ("text", "ids", "ids_sha256")]
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    rows = docs.select(*keep, "text").mapInArrow(_cutter(keep), f"rows array<struct<{fields}>>, tokens array<string>, split_n binary, split binary, seq_n binary, seq binary")
    # a row is some MB, so row groups are checked for their size at each
    rows.write.options(**{"compression": "zstd", "parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1}).parquet(f"{to}/chunks")
    return docs.sparkSession.read.parquet(f"{to}/chunks")


def vocabulary(chunks: DataFrame, path: str, to: str) -> int:
    """The distinct tokens of all chunks, folded, to a look-up table in the folder; returns their number."""
    words = chunks.select(F.explode("tokens").alias("key")).where(F.octet_length("key") <= LONGEST).distinct()
    packed = F.unhex(F.array_join(F.transform("ids", lambda i: F.lpad(F.hex((i % 256 * 256 + F.shiftright(i, 8)).cast("long")), 4, "0")), ""))  # 16 bits each, little-endian
    return lookup.write(encoded(words, path).select("key", packed.alias("value")), to, parts(chunks.sparkSession))


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of a flat array one after another."""
    before = np.cumsum(size) - size
    return flat[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def _joiner(path: str, to: str, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks(path)
        for b in batches:
            for i in range(b.num_rows):
                of = lambda c: _unplanes(b.column(c)[i].as_buffer())  # noqa: B023, E731
                rows = b.column("rows")[i].values
                keys = [x.encode() for x in b.column("tokens")[i].values.to_pylist()]
                flat, start, size = lookup.slices(to, keys)
                lost = np.flatnonzero(start < 0)
                more = [array("H", merge(keys[k], rank)) for k in lost.tolist()]  # words beyond LONGEST
                flat = np.concatenate([flat.view("<u2"), *(np.frombuffer(m, np.uint16) for m in more)])
                size = size // 2
                start = np.where(start < 0, 0, start // 2)
                if len(lost):
                    size[lost] = [len(m) for m in more]
                    start[lost] = len(flat) - int(size[lost].sum()) + _starts(size[lost])
                split, n = of("split").astype(np.int64), of("split_n").astype(np.int64)
                flat, by = _gather(flat, start[split], size[split]), np.concatenate([[0], np.cumsum(size[split])])
                ends = np.cumsum(n)
                start, size = by[ends - n], by[ends] - by[ends - n]
                seq, n = of("seq").astype(np.int64), np.cumsum(of("seq_n").astype(np.int64))
                ends = np.concatenate([[0], np.concatenate([[0], np.cumsum(size[seq])])[n]])
                ids = _gather(flat, start[seq], size[seq]).astype("<u4")
                digests = [hashlib.sha256(ids[x:y]).hexdigest() for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([*(rows.field(k) for k in range(len(keep))), column, pa.array(digests)], names=[*keep, "ids", "ids_sha256"])

    return run


def encode(chunks: DataFrame, path: str, to: str) -> DataFrame:
    """chunks to their rows: the other columns, ids array<int> and ids_sha256.

    Tokens come from the look-up table that vocabulary() wrote; those too long for
    it are merged here. Ids of the empty text are an empty array. Rows stay one to
    one, ids and other columns as they are.
    """
    fields = chunks.schema["rows"].dataType.elementType.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return chunks.mapInArrow(_joiner(path, to, [f.name for f in fields]), f"{schema}, ids array<int>, ids_sha256 string")


def decode(ids: Column, path: str) -> Column:
    """The bytes of ids: their binary pieces concatenated; a cast of binary to string keeps any bytes."""
    rank = ranks(path)
    pieces = F.from_json(F.lit(json.dumps([base64.b64encode(k).decode() for k in sorted(rank, key=rank.get)])), "array<binary>").cast("array<string>")
    return F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "").cast("binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text, ...) to the other columns, ids, ids_sha256, n_tokens, decoded_sha256; columns of these names give way."""
    to = own_dir(docs.sparkSession, "bpe")
    chunks = chunked(docs.drop("n_tokens", "decoded_sha256"), to)
    vocabulary(chunks, path, to)
    return encode(chunks, path, to).withColumns({"n_tokens": F.size("ids").cast("long"), "decoded_sha256": F.sha2(decode(F.col("ids"), path), 256)})


def op7_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every whole document encoded and decoded; a null text is empty, rows that repeat stay, an empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, path or public_tokenizers.path("byte_bpe_50k.tiktoken")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids in place of its text, with digests of the ids and of the decoded bytes.

    Null and empty texts have no ids; repeated rows and null ids stay; further
    columns stay but for those named n_tokens, ids, ids_sha256, decoded_sha256.
    """
    out = round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    made = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    return out.select(*[c for c in docs.columns if c not in ("text", *made)], *made)
