import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash

from graphloom.llm import bpe, lookup

from . import cases

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["a", "b", "Z", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "'ll", "é", "ß", "日本", "1", "23", ".", "!!", "\xa0", " ", "\x1c", "\x85", "​", "́", "🙂", "\x00", "　", "ſ", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


def test_pieces_keep_the_patterns_words(library):
    rnd, pattern = random.Random(1), regex.compile(public_tokenizers.PATTERN)
    for _ in range(5000):
        t = "".join(rnd.choice(ODD) for _ in range(rnd.randrange(14)))
        words = [w for c in bpe.pieces(t) for w in pattern.findall(c)]
        assert [i for w in words for i in bpe.merge(w.encode(), bpe.ranks(PATH))] == library.encode_ordinary(t)


def test_fold_and_heap_agree(spark, library):
    rnd = random.Random(2)
    words = {"".join(rnd.choice("abcdeéß 日ab") for _ in range(rnd.randrange(1, 14))) for _ in range(300)} | {"x" * 40, " thblethen"}
    got = bpe.encoded(spark.createDataFrame([(w,) for w in words], "key string"), PATH).collect()
    assert len(got) == len(words)
    for r in got:
        assert list(r.ids) == bpe.merge(r.key.encode(), bpe.ranks(PATH))


def check(spark, library, df, rows):
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    want = {}
    for d, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want.setdefault(d, []).append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_against_the_library(spark, sf, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, library, bpe.op7_byte_bpe(spark, sf), rows)


def test_awkward_rows(spark, library):
    rnd = random.Random(4)
    rows = [*cases.ROWS, (30, "".join(rnd.choice(ODD) for _ in range(3000)), "en", "a", 0), (31, "q" * 30000, "en", "a", 0), (32, "aé日" * 330, "en", "a", 0)]
    d = cases.clash(cases.docs(spark, rows), "ids", "key", "ids_sha256", "n_tokens")
    check(spark, library, bpe.round_trip(d, PATH), [r[:2] for r in rows])
    assert bpe.stage(spark, cases.docs(spark, []), "").count() == 0


def test_look_up_table(spark, tmp_path):
    rows = [(f"w{i}", str(i).encode()) for i in range(2000)]
    to = f"file://{tmp_path}/t"
    assert lookup.write(spark.createDataFrame(rows, "key string, value binary"), to, 8) == 2000
    flat, start, size = lookup.slices(to, [b"w77", b"no", b"w3"])
    assert start[1] < 0 and [bytes(flat[a : a + n]) for a, n in zip(start[[0, 2]], size[[0, 2]], strict=True)] == [b"77", b"3"]
    keys = [b"w5", b"nothing", b"w1999", "é".encode(), b""]
    assert lookup.find(to, keys) == [b"5", None, b"1999", None, None]
    at = lookup.places(to, [f"w{i}".encode() for i in range(2000)])
    assert sorted(at.tolist()) == list(range(2000))
    h = spark.sql("select xxhash64('w1999abé') x").first()
    assert xxhash.xxh64_intdigest("w1999abé".encode(), 42) == h.x & (1 << 64) - 1
