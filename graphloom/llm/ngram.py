"""Language-model scores from a trigram trie of Elias-Fano levels in the shared folder."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lookup
from .common import crc_mod, cut, own_dir, parts, table
from .eliasfano import EliasFano, Grouped, encode, grouped

#: Distinct words, and tokens, of a chunk of texts; and tokens whose n-grams a task counts before it hands on.
WORDS, CHUNK, TOKENS = 300_000, 1_000_000, 2_500_000
#: Tokens of the corpus for each range of middle words, the piece of the trie that one task builds.
RANGE = 2_000_000
#: Log10 probabilities are kept in steps of 1 / STEP, down to -65535 / STEP.
STEP = 4096


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; bytes know ASCII only."""
    return (text or "").encode("utf-8", "replace").lower().split()


class _Index(dict):
    """Numbers words as they are met."""

    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self)
        return n


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as bytes, those of one place together, packed; after their number."""
    x = np.asarray(x).astype("<u4")
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unplanes(b: pa.Buffer) -> np.ndarray:
    n = int.from_bytes(b.slice(0, 8).to_pybytes(), "little")
    flat = np.frombuffer(pa.decompress(b.slice(8), decompressed_size=4 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)


_CHUNK = "ids array<long>, learn binary, words array<string>, counts array<long>, seq_n binary, seq binary"


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, seq, sizes, ids, learn = _Index(), array("I"), [], [], []

    def out() -> pa.RecordBatch:
        s = np.frombuffer(seq, np.uint32)
        counts = np.bincount(s[np.repeat(np.array(learn, bool), sizes)], minlength=len(index)).astype(np.int64)
        words = pa.array([*index], pa.binary()).cast(pa.string())
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        of = lambda x: pa.array([_planes(x)], pa.binary())
        return pa.RecordBatch.from_arrays([one(pa.array(ids, pa.int64())), pa.array([np.array(learn, bool).tobytes()], pa.binary()), one(words), one(pa.array(counts)), of(sizes), of(s)], names=["ids", "learn", "words", "counts", "seq_n", "seq"])

    for b in batches:
        for i, x, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            w = tokens(x.as_py())
            seq.extend(map(index.__getitem__, w))
            sizes.append(len(w))
            ids.append(i)
            learn.append(y)
            if len(index) >= WORDS or len(seq) >= CHUNK:
                yield out()
                index, seq, sizes, ids, learn = _Index(), array("I"), [], [], []
    if ids:
        yield out()


def chunked(docs: DataFrame, to: str) -> DataFrame:
    """docs (doc_id, text, learn) to chunks of rows, written to the folder: ids, distinct words with their counts in the rows to learn from, texts as words. Texts are cut once."""
    d = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce("learn", F.lit(False)).alias("learn"))
    # a row is some MB, so row groups are checked for their size at each
    d.mapInArrow(_cutter, _CHUNK).write.options(**{"compression": "zstd", "parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1}).parquet(f"{to}/chunks")
    return docs.sparkSession.read.parquet(f"{to}/chunks")


def _words(b: pa.RecordBatch, i: int) -> list[bytes]:
    """The distinct words of a chunk's texts."""
    words = b.column("words")[i].values.cast(pa.binary())
    if not len(words):
        return []
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    flat = words.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])).to_pybytes()
    at = (at - at[0]).tolist()
    return [flat[x:y] for x, y in zip(at, at[1:], strict=False)]


def _ids(b: pa.RecordBatch, i: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is known of each word of a chunk's texts, and the number of words of each text."""
    seq = _unplanes(b.column("seq")[i].as_buffer())
    return (known[seq] if len(seq) else np.empty(0, np.int64)), _unplanes(b.column("seq_n")[i].as_buffer())


def _distinct(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers below `most` in order, and which of them each is."""
    bits = len(x).bit_length()
    if not len(x) or most << bits >= 1 << 63:
        return np.unique(x, return_inverse=True)
    s = np.sort(x << bits | np.arange(len(x)))  # several times as fast as an order by argsort
    key = s >> bits
    new = np.concatenate([[True], key[1:] != key[:-1]])
    of = np.empty(len(x), np.int64)
    of[s & ((1 << bits) - 1)] = np.cumsum(new) - 1
    return key[new], of


def steps_of(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before the last, last word, token) of each text's words and its end; before the first word, and as the end token, stands `end`."""
    n = len(ids) + len(sizes)
    last = np.cumsum(sizes + 1) - 1
    token = np.full(n, end, np.int64)
    inner = np.ones(n, bool)
    inner[last] = False
    token[inner] = ids
    first = last - sizes
    one = np.concatenate([[end], token[:-1]])[:n]
    one[first] = end
    two = np.concatenate([[end], one[:-1]])[:n]
    two[first] = end
    return two, one, token


def _ordered(one: np.ndarray, token: np.ndarray, two: np.ndarray, most: tuple[int, int]) -> np.ndarray:
    """The order by (one, token, two); most: bounds of `one`, and of the others."""
    if most[0] * most[1] * most[1] < 1 << 63:
        return np.argsort((one * most[1] + token) * most[1] + two)
    return np.lexsort((two, token, one))


def _summed(one: np.ndarray, token: np.ndarray, two: np.ndarray, n: np.ndarray | None, most: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """Distinct (one, token, two) in order, with their counts added up."""
    if n is None and most[0] * most[1] * most[1] < 1 << 63:
        key = np.sort((one * most[1] + token) * most[1] + two)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        pair, c = np.divmod(key[first], most[1])
        return *np.divmod(pair, most[1]), c, np.diff(np.append(first, len(key)))
    order = _ordered(one, token, two, most)
    a, b, c = one[order], token[order], two[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]))
    return a[first], b[first], c[first], np.add.reduceat(n[order], first) if n is not None else np.diff(np.append(first, len(a)))


_BLOCK = "r int, one binary, token binary, two binary, n binary"


def _counter(to: str, width: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, held, n = int(lookup.starts(to)[-1]) + 1, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            two, one, token = (np.concatenate([h[k] for h in held]) for k in range(3))
            of = one // width
            order = np.argsort(of.astype(np.uint16) if ranges < 1 << 16 else of, kind="stable")
            bounds = np.searchsorted(of[order], np.arange(ranges + 1))
            for r in np.flatnonzero(np.diff(bounds)).tolist():
                s = order[bounds[r] : bounds[r + 1]]
                got = _summed(one[s] - r * width, token[s], two[s], None, (width, wide))
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *(pa.array([_planes(x)], pa.binary()) for x in got)], names=["r", "one", "token", "two", "n"])

        for b in batches:
            for i in range(b.num_rows):
                ids, sizes = _ids(b, i, lookup.places(to, _words(b, i)))
                learn = np.frombuffer(b.column("learn")[i].as_buffer(), bool)
                held.append(steps_of(ids[np.repeat(learn, sizes)], sizes[learn], wide - 1))
                n += len(held[-1][0])
                if n > TOKENS:
                    yield from out()
                    held, n = [], 0
        if n:
            yield from out()

    return run


def _quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) * STEP), 65535).astype("<u2")


def _store(to: str, r: int, arrays: dict[str, np.ndarray]) -> None:
    """All arrays of a range in one file, after a head that says where each is."""
    head, flat, at = {}, [], 0
    for k, x in arrays.items():
        b = np.ascontiguousarray(x).tobytes()
        head[k] = [x.dtype.str, at, len(x)]
        flat += [b, b"\0" * (-len(b) % 8)]
        at += len(b) + -len(b) % 8
    first = json.dumps(head).encode()
    first += b" " * (-len(first) % 8)
    system, root = fs.FileSystem.from_uri(to)
    lookup.save(system, f"{root}/{r:07d}.trie", np.frombuffer(b"".join([len(first).to_bytes(8, "little"), first, *flat]), np.uint8))


def _trie_builder(to: str, width: int):
    """A range of words w: words after w, words before w, and for each word after w the words before w, each by its place among those."""

    def build(r: int, blocks: list[tuple[np.ndarray, ...]]) -> int:
        wide = int(lookup.starts(to)[-1]) + 1
        here = min(width, wide - r * width)
        one, token, two, n = _summed(*(np.concatenate([b[k] for b in blocks]) for k in range(4)), (width, wide))
        first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (token[1:] != token[:-1])]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(one))))  # the bigram of each trigram
        after_one, after = one[first], token[first]
        c = np.add.reduceat(n, first)
        # Witten-Bell: each kind of successor gives one count to the shorter history
        single = np.zeros(len(after))
        word = after < wide - 1
        own, back = _distinct(after[word], wide)
        single[word] = lookup.numbers(to, own)[back]
        all_, distinct, ends = map(int, lookup.load(to, "meta", "<i8"))
        single[~word] = ends
        kinds, total = np.bincount(after_one, minlength=here), np.bincount(after_one, c, minlength=here)
        back1 = kinds / np.maximum(total + kinds, 1)
        p2 = c / (total + kinds)[after_one] + back1[after_one] * (single + 1) / (all_ + distinct + 1)
        before, at = _distinct(one * wide + two, here * wide)
        before_one, before = before // wide, before % wide
        kinds2, total2 = np.bincount(at), np.bincount(at, n)
        back2 = kinds2 / (total2 + kinds2)
        p3 = n / (total2 + kinds2)[at] + back2[at] * p2[of]
        starts = lambda x, most: np.concatenate([[0], np.cumsum(np.bincount(x, minlength=most))])
        to_before = starts(before_one, here)
        place = at - to_before[one]
        arrays: dict[str, np.ndarray] = {"back1": _quantised(np.where(kinds > 0, back1, 1.0)), "back2": _quantised(back2), "prob2": _quantised(p2), "prob3": _quantised(p3)}
        for name, values, pointers in (("after", after, starts(after_one, here)), ("before", before, to_before), ("third", place, starts(of, len(first)))):
            arrays |= {f"{name}.{k}": v for k, v in grouped(values, pointers).items()} | {f"to_{name}.{k}": v for k, v in encode(pointers, len(values) + 1).items()}
        _store(to, r, arrays)
        return len(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, blocks, n = None, [], 0
        for b in batches:
            for i in range(b.num_rows):
                x = b.column(0)[i].as_py()
                if r is not None and x != r:
                    n += build(r, blocks)
                    blocks = []
                r = x
                blocks.append(tuple(_unplanes(b.column(k)[i].as_buffer()) for k in range(1, 5)))
        if r is not None:
            n += build(r, blocks)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


class _Level:
    """A range of the trie, mapped."""

    def __init__(self, data: np.ndarray) -> None:
        n = int(data[:8].view("<i8")[0])
        body = data[8 + n :]
        parts_: dict[str, dict[str, np.ndarray]] = {}
        for k, (kind, at, size) in json.loads(bytes(data[8 : 8 + n])).items():
            name, _, part = k.partition(".")
            parts_.setdefault(name, {})[part] = body[at : at + size * np.dtype(kind).itemsize].view(kind)
        self.back1, self.back2, self.prob2, self.prob3 = (parts_[k][""] for k in ("back1", "back2", "prob2", "prob3"))
        self.after, self.before, self.third = (Grouped(parts_[k]) for k in ("after", "before", "third"))
        self.to_after, self.to_before, self.to_third = (EliasFano(parts_[f"to_{k}"]) for k in ("after", "before", "third"))


@lru_cache(maxsize=4096)
def _level(to: str, r: int) -> _Level | None:
    data = lookup.load(to, f"{r:07d}.trie", "u1")
    return _Level(data) if len(data) else None


class Model:
    """Where the trie is, and its sizes; goes to workers as it is."""

    def __init__(self, to: str, all_: int, distinct: int, ends: int, width: int) -> None:
        self.to, self.all, self.distinct, self.ends, self.width = to, all_, distinct, ends, width

    def counts(self, own: np.ndarray, wide: int) -> np.ndarray:
        """Training count of each of these tokens, in ascending order; 0 of unknown ones."""
        out = np.zeros(len(own), np.int64)
        out[own == wide - 1] = self.ends
        known = (own >= 0) & (own < wide - 1)
        out[known] = lookup.numbers(self.to, own[known])
        return out

    def log10(self, own: np.ndarray, low: np.ndarray, two: np.ndarray, one: np.ndarray, token: np.ndarray) -> np.ndarray:
        """log10 of each token's probability after its last two words; these are given by their place in own, tokens in ascending order; low: that of each of own alone.

        All is in the range of the last word: the token among the words after it, the
        word before among the words before it, whose place there is then looked for
        among those of this pair. Each distinct pair and triple is looked for once.
        """
        n = len(own)
        # ordered by the last word, so that a range's are side by side and searches go through the levels in order
        pairs, pair_of = _distinct(one * n + token, n * n)
        befores, before_of = _distinct(one * n + two, n * n)
        triples, of = _distinct(pair_of * len(befores) + before_of, len(pairs) * len(befores))
        to_pair, to_before = triples // len(befores), triples % len(befores)
        token, two = pairs % n, befores % n
        after_one, before_one = pairs // n, befores // n
        shorter, back2, out = low[token], np.zeros(len(befores)), np.full(len(triples), np.nan)
        ones = np.flatnonzero(np.bincount(after_one, minlength=n))  # the same before and after
        ones = ones[own[ones] >= 0] if self.all else ones[:0]
        ranges = own[ones] // self.width
        cuts = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist(), len(ones)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x == y or (level := _level(self.to, int(ranges[x]))) is None:
                continue
            here = ones[x:y]
            w = own[here] - int(ranges[x]) * self.width

            def placed(pointers: EliasFano, groups: Grouped, of_one: np.ndarray, v: np.ndarray, here=here, w=w) -> tuple[slice, np.ndarray, np.ndarray, np.ndarray]:
                """The part of the pairs (one, v) whose word is here, which of the words each has, its place in the level, and where the word's group begins."""
                s = slice(*np.searchsorted(of_one, (here[0], here[-1] + 1)).tolist())
                which = np.searchsorted(here, of_one[s])
                begin, end = pointers.both(w)
                base = groups.base(begin)
                return s, which, groups.at(own[v[s]], begin[which], end[which], base[which]), begin[which]

            s, which, i, _ = placed(level.to_after, level.after, after_one, token)
            some = np.flatnonzero(i >= 0)
            third = np.zeros((3, len(i)), np.int64)
            begin, end = level.to_third.both(i[some])
            third[:, some] = begin, end, level.third.base(begin)
            q = level.back1[w][which] / -float(STEP) + shorter[s]
            q[some] = level.prob2[i[some]] / -float(STEP)
            shorter[s] = q
            b, _, j, begin = placed(level.to_before, level.before, before_one, two)
            back2[b] = np.where(j >= 0, level.back2[np.maximum(j, 0)], 0) / -float(STEP)
            place = np.where(j >= 0, j - begin, -1)
            t = slice(*np.searchsorted(to_pair, (s.start, s.stop)).tolist())
            k = level.third.at(place[to_before[t] - b.start], *third[:, to_pair[t] - s.start])
            out[t] = np.where(k >= 0, level.prob3[np.maximum(k, 0)] / -float(STEP), np.nan)
        return np.where(np.isnan(out), back2[to_before] + shorter[to_pair], out)[of]


def train(chunks: DataFrame, to: str, per_range: int = RANGE) -> Model:
    """Counts all words and trigrams of the chunks' rows to learn from and writes vocabulary and trie to the folder.

    Counts are added up in tasks before they are shuffled: words by word, trigrams as
    sorted blocks by range of middle words, so that a frequent word's occurrences are
    no one task's load. Counts of pairs are sums of those of triples. Every count of
    the corpus is kept.
    """
    spark = chunks.sparkSession
    words = chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("key"), F.col("w.counts").alias("n")).where("n > 0")
    words = cut(words.groupBy("key").agg(F.sum("n").alias("n")))
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ones = F.length(F.regexp_replace(F.hex("learn"), "00", "")) / 2  # a byte a row, 1 for those to learn from
    ends = int(chunks.agg(F.coalesce(F.sum(ones), F.lit(0))).first()[0])
    all_, distinct = int(sums[0]) + ends, int(sums[1]) + (ends > 0)
    value = F.unhex(F.regexp_replace(F.lpad(F.hex("n"), 16, "0"), "(..)(..)(..)(..)(..)(..)(..)(..)", "$8$7$6$5$4$3$2$1"))
    lookup.write(words.select("key", value.alias("value")), to, parts(spark))
    system, root = fs.FileSystem.from_uri(to)
    with system.open_output_stream(f"{root}/meta") as s:
        s.write(np.array([all_, distinct, ends], "<i8").tobytes())
    wide = int(sums[1]) + 1
    ranges = max(1, min(wide, -(-all_ // per_range)))
    width = -(-wide // ranges)
    if all_:
        blocks = chunks.select("learn", "words", "seq_n", "seq").mapInArrow(_counter(to, width, ranges), _BLOCK)
        blocks.repartition(max(1, min(ranges, 10 * parts(spark))), "r").sortWithinPartitions("r").mapInArrow(_trie_builder(to, width), "n long").agg(F.sum("n")).collect()
    return Model(to, all_, distinct, ends, width)


def score(chunks: DataFrame, model: Model) -> DataFrame:
    """chunks to doc_id, n_tokens, n_known, base_score, score; a row for each row. A null text is empty: its end alone."""
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = int(lookup.starts(model.to)[-1]) + 1
        for b in batches:
            for i in range(b.num_rows):
                own, which = np.unique(np.append(lookup.places(model.to, _words(b, i)), wide - 1), return_inverse=True)
                words, sizes = _ids(b, i, which)
                two, one, token = steps_of(words, sizes, len(own) - 1)
                c = model.counts(own, wide)
                low = np.log10((c + 1) / (model.all + model.distinct + 1))
                at = np.cumsum(sizes + 1) - (sizes + 1)
                full = model.log10(own, low, two, one, token)
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, pa.array(sizes + 1), pa.array(np.add.reduceat((c > 0)[token].astype(np.int64), at)), pa.array(np.add.reduceat(low[token], at)), pa.array(np.add.reduceat(full, at))], names=names)

    return chunks.select("ids", "words", "seq_n", "seq").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op8_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document scored by what the rows that are not held out teach; rows without id count as the empty id for the hold-out, null texts as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 7) == 2
    to = own_dir(spark, "ngram")
    chunks = chunked(docs.withColumn("learn", ~held), to)
    model = train(chunks, to)
    return score(chunks, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.all).cast("long").alias("train_tokens"), "base_score", "score")
