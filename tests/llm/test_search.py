"""Exact top-k search against brute force, and the pipeline."""

import numpy as np

import corpus_pipeline
from printloom.llm import topk
from printloom.llm.common import table


def plain(rows, k=10):
    v = {i: np.floor(np.array(x, np.float64) * 1024).astype(np.int64) for i, x in rows if x is not None and i is not None and all(c is not None and np.isfinite(c) for c in x)}
    out = []
    for q in v:
        if q % 100 == 0:
            found = sorted((-int(v[q] @ v[i]), i) for i in v if i != q and len(v[i]) == len(v[q]))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.2, 6), 2)]) for i in range(420)]
    rows += [(500 + i, rows[3][1]) for i in range(40)]
    rows += [(1000, None), (1100, [None] * 6), (1200, [float("nan")] * 6), (1300, [float("inf")] * 6), (1400, [0.0] * 6), (1500, [1.0, 2.0]), (1501, [1.0, 1.0]), (None, [0.1] * 6), (1600, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 AS id", "2 AS v")
    got = topk.top_k(df, df.where("vec_id % 100 = 0"))
    rows32 = [(i, x if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, x in rows]
    assert sorted(map(tuple, got.collect())) == plain(rows32)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_a_search_stops_on_proof_only():
    rng = np.random.default_rng(0)
    for trial in range(200):
        n, d = rng.integers(1, 200), rng.integers(1, 9)
        rows = rng.integers(-5, 6, (n, d))
        rows[rng.random(n) < 0.3] = rows[0]
        ids = rng.permutation(n * 2)[:n]
        q, own = rng.integers(-5, 6, d), int(ids[0]) if trial % 2 else None
        found, scores = topk.Index(ids, rows).top(q, 10, own)
        want = sorted((-int(r @ q), int(i)) for i, r in zip(ids, rows) if i != own)[:10]
        assert [(-int(s), int(i)) for i, s in zip(found, scores)] == want


def test_the_pipeline_takes_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    extra = spark.createDataFrame([(10**6, "12 34", "en", "src0", 5), (10**6 + 1, None, "en", "src0", 0)], docs.schema)
    now, columns = docs.union(extra), docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns
            now = now.persist()
        sizes.append(now.count())
    assert sizes[0] >= 199 and sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] > 0 and sizes[4] == sizes[3]
    assert {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} <= set(now.columns)
