import re

import xxhash

from graphloom.llm import simhash

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fp = [slow(t) for _, t in rows]
    n, up = len(rows), list(range(len(rows)))
    near = [0] * n

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                near[i] += 1
                near[j] += 1
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return sorted(((d, f"{f:016x}", k, low.get(root(i))) for i, ((d, _), f, k) in enumerate(zip(rows, fp, near, strict=True))), key=str)


def found(df):
    return sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)


def test_tallies_tell_shared_bytes(spark):
    base = 0x0123456789ABCDEF
    fps = [base, *(base ^ sum(0x80 << 8 * i for i in range(k)) for k in range(1, 5))]  # 7 to 4 bytes in place
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    near = {(r.a, r.b) for r in simhash.links(rows).collect()}
    assert near == {(min(x, y), max(x, y)) for x in (r.fp for r in rows.collect()) for y in (r.fp for r in rows.collect()) if x != y and ((x ^ y) & (1 << 64) - 1).bit_count() <= 3}
    assert len(simhash.MASKS) == 70 and simhash.LEAST == 5


def test_against_all_pairs(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(400).select("doc_id", "text")
    rows = [tuple(r) for r in d.collect()]
    assert found(spark.createDataFrame(rows, d.schema)) == brute(rows)


def test_chains_of_close_prints(spark):
    base = 0x0123456789ABCDEF
    fps, x = [], base
    for i in range(40):
        fps.append(x - (1 << 64) if x >> 63 else x)
        x ^= 1 << (i * 13 % 64) | 1 << (i * 29 % 64)
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.fp: (r.n_near, r.component_id) for r in simhash.groups(rows).collect()}
    for f in fps:
        assert got[f][0] == sum(((f ^ g) & (1 << 64) - 1).bit_count() <= 3 for g in fps) - 1
    assert {c for _, c in got.values()} == {0}


def test_awkward_rows(spark):
    d = cases.clash(cases.docs(spark), "fp", "tie", "n_near", "component", "fingerprint")
    assert found(d) == brute([r[:2] for r in cases.ROWS])
    assert found(cases.docs(spark, [])) == []
    kept = simhash.stage(spark, d, "")
    assert kept.columns == d.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, -8), (False, 1), (False, 3), (False, 6), (False, 9), (True, 0)]
