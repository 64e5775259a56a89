import hashlib
import random
from collections import Counter

import numpy as np

from graphloom.llm import induced, repeats

from . import cases


def brute(rows, window=400):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + window] for _, b in data for i in range(len(b) - window + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, tmp_path):
    return sorted((tuple(r) for r in repeats.remove_repeats(df, f"file://{tmp_path}").collect()), key=str)


def tangled():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, line = prose(150), "the same line again and again " * 20
    rows = [(i, prose(rnd.randrange(50, 200)) + (shared[rnd.randrange(60) : -1 - rnd.randrange(60)] if i % 2 else "") + prose(rnd.randrange(90))) for i in range(40)]
    rows += [(40 + i, rows[0][1]) for i in range(3)] + [(50, line), (51, "x" * 900), (52, "x" * 399), (53, "x" * 400), (54, "ab" * 500), (55, shared + "!" + shared)]
    for i in range(6):
        t = list(rows[2][1])
        t[rnd.randrange(len(t))] = "#"
        rows.append((60 + i, "".join(t)))
    return rows


def test_suffixes_against_sorting(tmp_path, monkeypatch):
    monkeypatch.setattr(induced, "STEP", 32)
    monkeypatch.setattr(induced, "RUN", 8)
    rnd = random.Random(0)
    deep = []
    inner = induced._recursive
    monkeypatch.setattr(induced, "_recursive", lambda *a: deep.append(len(a[2])) or inner(*a))
    for _ in range(80):
        limit, n = rnd.choice([3, 8, 20, 40]), rnd.randrange(1, 400)
        b = bytes(rnd.randrange(1, rnd.choice([3, 5, 200])) for _ in range(n))
        b += b[rnd.randrange(n) :][:60] + b"a" * rnd.randrange(50) + b"\x00"
        steps = [*induced.suffixes(np.frombuffer(b + bytes(8), np.uint8), limit, f"file://{tmp_path}", rnd.choice([1, 4, 1 << 20]))]
        pos, lcp = np.concatenate([p for p, _ in steps]).tolist(), np.concatenate([x for _, x in steps]).tolist()
        assert sorted(pos) == [*range(len(b))]
        for i, j, k in zip(pos, pos[1:], lcp[1:], strict=False):
            assert b[i : i + limit] >= b[j : j + limit]
            assert k == next((x for x in range(limit) if i + x >= len(b) or j + x >= len(b) or b[i + x] != b[j + x]), limit)
    assert len(deep) > 60 and any(x > y for x, y in zip(deep, deep[1:]))  # levels below levels
    assert not [*tmp_path.iterdir()]


def test_a_shard_far_larger_than_memory(tmp_path, monkeypatch):
    monkeypatch.setattr(induced, "RUN", 1 << 8)
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(500, 3000))).encode() for _ in range(120)]
    for i in range(0, 120, 5):
        texts[i] = texts[i][:300] + texts[(i + 7) % 120][100:900] + texts[i][300:]
    stats = {}
    memory = sum(map(len, texts)) // 64
    got = repeats.repeated_windows(texts, [1] * 119 + [2], f"file://{tmp_path}", memory, stats)
    assert stats["written"] > 8 * memory
    assert got == repeats.repeated_windows(texts, [1] * 119 + [2])
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    for t, runs in zip(texts[:-1], got, strict=False):
        assert {i for s, e in runs for i in range(s, e + 1)} == {i for i in range(len(t) - 399) if seen[t[i : i + 400]] > 1}


def test_against_all_windows(spark, sf, tmp_path):
    rows = tangled()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, tmp_path / "a") == brute(rows)
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 0").select("doc_id", "text")
    assert found(d, tmp_path / "b") == brute([tuple(r) for r in d.collect()])


def test_hot_minimisers_and_small_shards(spark, tmp_path, monkeypatch):
    rows = tangled()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(repeats, "HOT", 3000)
    assert found(df, tmp_path / "a") == brute(rows)


def test_all_byte_values():
    rnd = np.random.default_rng(0)
    t = [rnd.integers(0, 256, 900).astype(np.uint8).tobytes() for _ in range(4)]
    t[2] = t[0][100:800] + t[1][:50]
    got = repeats.repeated_windows(t, [1, 1, 1, 2])
    assert got == [[(100, 400)], [], [(0, 300)], [(0, 500)]]


def test_awkward_rows(spark, tmp_path):
    df = cases.clash(cases.docs(spark), "data", "k1", "a", "nb", "gaps")
    assert found(df, tmp_path / "a") == brute([r[:2] for r in cases.ROWS])
    assert found(cases.docs(spark, []), tmp_path / "b") == []
