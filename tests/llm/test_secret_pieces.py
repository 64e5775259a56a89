import base64
import random

from graphloom.llm import secrets

from . import cases

KEY = "9F86D081884C7D659A2FEAA0C55AD015"


def judged(text):
    return {text[a:b]: p for a, b, _, p in secrets.judged(text)}


def test_names_and_paths_do_not_hide_a_key():
    assert judged(f"signing_key={KEY}")[KEY] > 10
    key = "NaBNbeOONcRBzinL91HUss6a"
    hexes = "0a1b2c3d4e5f60718293a4b5"
    for text in (f"https://x.org/{hexes}/{key}", f"docs/release/{key}/index", f"live_{key}", f"{key}-suffix", f"a={hexes}={key}"):
        assert judged(text)[key] > 10, text
    assert judged(f"x={key}==") == {key + "==": judged(key)[key]}
    assert judged("internationalization/localization/resources") .keys() >= {"internationalization"}
    assert [text for text in judged(hexes + "0")] == [] and judged("=" * 30) == {}


def test_keys_behind_names_are_found_and_masked(spark):
    rnd = random.Random(4)
    keys = [rnd.randbytes(16).hex().upper() for _ in range(150)]
    plain = [base64.b64encode(rnd.randbytes(30)).decode() for _ in range(150)]
    rows = [(i, f"see {'signing_key=' + k if i % 2 else 'https://host/files/' + k + '/get'} here {b}", "en", "a", 1) for i, (k, b) in enumerate(zip(keys, plain, strict=True))]
    got = {r.doc_id: r for r in secrets.scan(cases.docs(spark, rows)).collect()}
    at = [t.index(k) for (_, t, *_), k in zip(rows, keys, strict=True)]
    assert sum(f"random:{a}:{a + 32}" in got[i].spans for i, a in enumerate(at)) > 0.8 * len(rows)
    for r in got.values():
        spans = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x]
        assert r.n_random == len(spans) and not any(p != q and p[0] <= q[0] and q[1] <= p[1] for p in spans for q in spans)
    out = {r.doc_id: r.text for r in secrets.stage(spark, cases.docs(spark, rows), "").collect()}
    assert sum(k not in out[i] for i, k in enumerate(keys)) > 0.8 * len(rows)
