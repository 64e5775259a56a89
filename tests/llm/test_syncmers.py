import hashlib
import random
import regex
import xxhash

from graphloom.llm import syncmers

from . import cases

UNIT = regex.compile(r"(?V1)[[\p{L}\p{N}]--[\u0E00-\u0EFF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF]]{1,4}|[^\x20\x09-\x0D]")


def chain(*values, seed=42):
    """Spark's xxhash64 of several values: each is the seed of the next."""
    for v in values:
        b = v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(b, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def placed(text):
    """(place, hash) of each anchor."""
    u = UNIT.findall(text or "")
    if len(u) < 8:
        return [(0, chain(chr(0).join(u)) & 0xFFFFFFFF)] if u else []
    h = [chain(u[i], u[i + 1]) for i in range(len(u) - 1)]
    return [(i, chain(h[i], h[i + 2], h[i + 4], h[i + 6]) & 0xFFFFFFFF) for i in range(len(u) - 7) if min(h[i : i + 7]) in (h[i], h[i + 6])]


def slow(text):
    p = placed(text)
    assert all(j - i <= 6 for (i, _), (j, _) in zip(p, p[1:]))
    return "".join(f"{h << 4 | i - (p[k - 1][0] if k else i):09X}" for k, (i, h) in enumerate(p))


def near(a, b):
    x, y = ({(h, i - (p[k - 1][0] if k else i), p[k - 1][1] if k else None) for k, (i, h) in enumerate(p)} for p in (placed(a), placed(b)))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else chain(r[1] or ""), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), slow(t), slow(e), round(near(t, e), 9), round(near(t, nxt), 9)))
    return sorted(out, key=str)


def found(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in syncmers.prints(df).collect()), key=str)


def test_against_a_loop(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 5 < 2 and length(text) < 6000").select("doc_id", "text")
    assert found(d) == brute([tuple(r) for r in d.collect()])


def test_awkward_rows(spark):
    rows = [r[:2] for r in cases.ROWS if r[0] not in (6, 7)] + [(1 << 40, "far away text of one"), (-5000, "left half | right half, " * 3), (77, "日本語の文章をここに書く、ひらがなも漢字も。" * 3), (78, "naïve façade éàü ß œuvre " * 9)]
    d = cases.clash(cases.docs(spark, [(*r, "en", "a", 1) for r in rows]), "fp", "run", "known", "tie", "guest", "k", "r", "at")
    assert found(d) == brute(rows)
    assert syncmers.prints(cases.docs(spark, [])).count() == 0
    assert found(cases.docs(spark, [(7, "alone in the table here", "en", "a", 1)])) == brute([(7, "alone in the table here")])


def test_likeness_tells_edits_from_strangers(spark, sf):
    got = syncmers.op3_syncmer_prints(spark, sf).where("n_chars > 400").collect()
    assert sum(r.near_edited for r in got) / len(got) > 0.35
    assert sum(r.near_edited > r.near_next for r in got) / len(got) > 0.95


def test_python_stays_out(spark, sf):
    plan = syncmers.op3_syncmer_prints(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def made(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(n))


def test_a_passage_in_long_texts_and_small_edits_show(spark):
    long, other, passage = made(1, 3000), made(2, 3000), made(3, 60)
    words = long.split()
    rows = [(1, long), (2, long + " " + passage), (3, other + " " + passage), (4, " ".join([*words[:1500], "qqqq", *words[1501:]])), (5, "new words first " + long)]
    got = {r.doc_id: r for r in syncmers.prints(cases.docs(spark, [(*r, "en", "a", 1) for r in rows])).collect()}
    assert got[1].n_anchors > 500 and 0.97 < got[1].near_next < 1.0
    assert 0.4 * 60 / 3060 < got[2].near_next < 0.1  # the passage alone
    assert 0.99 < got[4].near_next < 1.0 and got[4].fingerprint != got[1].fingerprint  # shifted by three words
    assert got[3].near_next == 0.0
