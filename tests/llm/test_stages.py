"""Each stage on awkward rows: nulls, empty and very long texts, repeats, empty tables, columns of the names that it uses itself."""

import pytest

from graphloom.llm import bpe, mixing, quality, secrets, simhash

from . import cases

STAGES = {"quality": quality.stage, "simhash": simhash.stage, "secrets": secrets.stage, "mixing": mixing.stage, "bpe": bpe.stage}
OWN = ["_tie", "_old", "_n", "_score", "_size", "_position", "_taken", "_at", "_target", "_reading", "own", "runs", "n", "s", "target"]


@pytest.mark.parametrize("name", STAGES)
def test_awkward_rows(spark, sf, name):
    d = cases.clash(cases.docs(spark), *OWN)
    out = STAGES[name](spark, d, sf)
    rows = out.collect()
    if name == "bpe":
        assert out.columns == [c for c in d.columns if c != "text"] + ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    else:
        assert out.schema.simpleString() == d.schema.simpleString()
    assert all(r[c] == "x" for r in rows for c in OWN)
    ids = [r.doc_id for r in rows]
    if name in ("secrets", "bpe"):
        assert sorted(ids, key=str) == sorted((r[0] for r in cases.ROWS), key=str)
    assert set(ids) <= {r[0] for r in cases.ROWS}
    if name == "secrets":
        masked = {(9, "[SECRET]", 8)}  # 1,600 hexadecimal digits
        assert {(r.doc_id, r.text, r.n_chars) for r in rows} == {(r[0], r[1], r[4]) for r in cases.ROWS if r[0] != 9} | masked
    assert STAGES[name](spark, cases.clash(cases.docs(spark, []), *OWN), sf).count() == 0


def test_without_n_chars(spark, sf):
    d = cases.docs(spark).drop("n_chars")
    for name in ("quality", "secrets", "simhash", "mixing"):
        assert STAGES[name](spark, d, sf).columns == d.columns
