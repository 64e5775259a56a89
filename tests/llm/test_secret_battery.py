"""The battery as a whole: what it finds of planted random strings of each encoding and length, and what of all it finds is false."""

import base64
import random
import string
from collections import Counter, defaultdict

from graphloom.llm import secrets

from . import cases

MAKE = {
    "digits": lambda r, n: "".join(r.choices(string.digits, k=n)),
    "HEX": lambda r, n: "".join(r.choices("0123456789ABCDEF", k=n)),
    "base32": lambda r, n: "".join(r.choices(string.ascii_uppercase + "234567", k=n)),
    "lower": lambda r, n: "".join(r.choices(string.ascii_lowercase, k=n)),
    "lower+digits": lambda r, n: "".join(r.choices(string.ascii_lowercase + string.digits, k=n)),
    "letters+digits": lambda r, n: "".join(r.choices(string.ascii_letters + string.digits, k=n)),
    "base64": lambda r, n: base64.b64encode(r.randbytes(n)).decode()[:n],
    "url-safe": lambda r, n: base64.urlsafe_b64encode(r.randbytes(n)).decode()[:n],
}
WORDS = "the configuration manager service of a local index holds every record that was written before translation and internationalization of resources began".split()


def planted(seed=11):
    """Rows of one planted string or one name put together from words; the strings by row."""
    rnd = random.Random(seed)
    rows, keys = [], {}
    for kind, make in MAKE.items():
        for n in (20, 24, 32, 48, 96):
            for _ in range(12):
                key = make(rnd, n)
                keys[len(rows)] = (kind, n, key)
                rows.append(f"value {key} follows")
    for _ in range(600):
        name = rnd.choice(["_", "-", "/", "", ""]).join(rnd.choices(WORDS, k=rnd.randrange(3, 9)))
        rows.append(f"value {name} follows")
    return rows, keys


def brute(texts):
    """Random spans by the definitions, from the candidates' p-values: counts over all texts, then the first bin a class that keeps the rate."""
    found = [secrets.base_spans(t) for t in texts]
    bins = [[(a, b, c, min(199, int(secrets.randomness(t[a:b]) * 200))) for a, b, c in free] for t, (_, free) in zip(texts, found, strict=True)]
    counts = Counter((c, p) for row in bins for _, _, c, p in row)
    first = {}
    for c in {c for c, _ in counts}:
        even = sum(n for (k, p), n in counts.items() if k == c and p >= 100) / 0.5
        for p in range(200):
            above = sum(n for (k, x), n in counts.items() if k == c and x >= p)
            if above and 1 - even * (1 - p / 200) / above <= 0.05:
                first[c] = p
                break
    out = []
    for (base, _), row in zip(found, bins, strict=True):
        taken = [(a, b) for a, b, c, p in row if p >= first.get(c, 200)]
        outer = [s for s in taken if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in taken)]
        spans = sorted([(a, k, b) for a, k, b in base] + [(a, 3, b) for a, b in outer])
        out.append(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans))
    return out


def test_spans_against_the_definitions(spark):
    texts, _ = planted(5)
    texts = [*texts[::3], "token=abcdef1 and " + "ab12" * 10, "", "x=" + "Q7" * 30]
    got = {r.doc_id: r.spans for r in secrets.scan(cases.docs(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_recall_and_false_discoveries(spark):
    texts, keys = planted()
    got = secrets.scan(cases.docs(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])).collect()
    hit, false, all_ = defaultdict(list), 0, 0
    for r in got:
        found = [x.split(":") for x in r.spans.split(",") if x]
        spans = {(int(a), int(b)) for k, a, b in found if k == "random"}
        all_ += len(spans)
        if r.doc_id in keys:
            kind, n, key = keys[r.doc_id]
            got_it = (6, 6 + len(key)) in {(int(a), int(b)) for _, a, b in found}  # by a fixed pattern or by the battery
            hit[kind].append(got_it)
            hit[n].append(got_it)
        else:
            false += len(spans)
    recall = {k: sum(v) / len(v) for k, v in hit.items()}
    # the shorter a string, the less the tests can tell it from a name; the control then gives strings up, not its rate
    assert all(recall[n] >= least for n, least in ((20, 0.45), (24, 0.8), (32, 0.8), (48, 0.85), (96, 0.9))), recall
    assert all(recall[k] >= 0.7 for k in MAKE), recall
    assert false <= 0.1 * all_, (false, all_)
