import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from graphloom.llm import bpe, mixing, quality, secrets, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_each_stage_acts(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    first, good, single, masked, mixed, ids = seen
    assert all(d.columns == docs.columns for d in seen[:-1])
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in good.collect()}
    marked = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(marked[d] == 1 for d in kept if d in marked) >= 0.98 * sum(v == 1 for v in marked.values())
    assert sum(marked[d] == 0 for d in kept if d in marked) <= 0.2 * sum(v == 0 for v in marked.values())
    dup = simhash.near_duplicates(good).collect()
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in dup}
    assert single.count() == len({r.component_id for r in dup})
    had = {r.doc_id: r.text for r in single.collect()}
    now = {r.doc_id: r for r in masked.collect()}
    assert had.keys() == now.keys()
    for d, t in had.items():
        n = now[d]
        assert (n.text != t) == bool(secrets.base_spans(t or "")[0]) or "[SECRET]" in n.text
        assert not secrets.base_spans((n.text or "").replace("[SECRET]", "#"))[0]
    want = {r.doc_id: -(-r["_taken"] // r["_size"]) for r in mixing.plan(masked, "doc_id").collect() if r["_size"]}
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert {d: n for d, n in want.items() if n} == {d: n for d, n in got.items() if want.get(d, 1) and d in want}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert ids.count() == mixed.count()
    for r in ids.dropDuplicates(["doc_id"]).collect():
        t = now[r.doc_id].text or ""
        assert list(r.ids) == library.encode_ordinary(t) and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_run_is_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids"} <= set(out.columns)
    assert quality.CUT == 0.3
