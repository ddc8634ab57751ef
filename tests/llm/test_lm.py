"""Model scores of op7 against a plain dictionary of the same counts."""

import math
from collections import Counter

from pyspark.sql import functions as F

from printloom.llm import lm

TEACH = ["a b a b c", "a b", "", "c a b a", "", "b b b b c"]
ASK = ["a b c", "", "c c", "unseen a", "b b b"]


def plain_scores(teach, ask):
    single, pair = Counter(), Counter()
    for t in teach:
        w = ["<s>", *t.split(), "</s>"]
        single.update(w[1:])
        pair.update(zip(w, w[1:]))
    mid = lambda n: 0.0 if not n else (2.0 ** (n.bit_length() - 1) + 2.0 ** n.bit_length() - 1) / 2
    total, distinct = sum(single.values()), len(single)
    out = []
    for t in ask:
        w, score = ["<s>", *t.split(), "</s>"], 0.0
        for a, b in zip(w, w[1:]):
            first = mid(single["</s>" if a == "<s>" else a])  # as many texts start as end
            smooth = (mid(single[b]) + 0.1) / (total + 0.1 * (distinct + 1))
            p = lm.WEIGHT * min(1.0, mid(pair[a, b]) / first) + (1 - lm.WEIGHT) * smooth if first else smooth
            score += math.log10(min(1.0, p))
        out.append(score)
    return out


def asked(spark, teach, ask):
    rows = [(i, t, True) for i, t in enumerate(teach)] + [(100_000 + i, t, False) for i, t in enumerate(ask)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string, teaches boolean"), F.col("teaches"))
    return [r["score"] for r in got.where("doc_id >= 100000").orderBy("doc_id").collect()]


def test_model_scores_equal_a_dictionary(spark):
    assert all(abs(a - b) < 1e-9 for a, b in zip(asked(spark, TEACH, ASK), plain_scores(TEACH, ASK), strict=True))


def test_a_filter_beyond_the_broadcast_bound_grows(spark, monkeypatch):
    monkeypatch.setattr(lm, "FILTER_BYTES", 64)
    monkeypatch.setattr(lm, "ASK_TOKENS", 50)
    teach = [*TEACH, *(f"x{i} y{i} x{i} z{i}" for i in range(4000))]
    ask = [*ASK, *(f"x{i} y{i}" for i in range(50)), *(f"never{i} met{i}" for i in range(50))]
    got = asked(spark, teach, ask)
    monkeypatch.setattr(lm, "FILTER_BYTES", 1 << 27)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, asked(spark, teach, ask), strict=True))


def test_scores_of_documents_are_near_those_of_exact_counts(spark):
    """The filter's classes and false answers against a model with the same interpolation and the classes of exact counts."""
    rows = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    teach, ask = [low(t) for t in rows[::2]], [low(t) for t in rows[1::2]][:40]
    got, want = asked(spark, teach, ask), plain_scores(teach, ask)
    assert max(abs(a - b) / abs(b) for a, b in zip(got, want, strict=True)) < 0.1


def test_other_keys_and_an_empty_table(spark):
    df = spark.createDataFrame([(1.5, "a b"), (None, None)], "doc_id double, text string")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in lm.score(df, F.lit(True)).collect()) == [(0, 1), (1.5, 3)]
    assert lm.score(df.limit(0), F.lit(True)).count() == 0
