"""The near-dedup stage of the pipeline against all pairs."""

import glob
import random

import numpy as np

import corpus_pipeline
from printloom.llm import simhash
from printloom.llm.common import shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_groups(texts):
    """id -> least id of its group, by the similarity of all pairs of word tuples."""
    sets = {}
    for i, t in texts:
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    return group


def near_copies(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts, i = [], 0
    for _ in range(40):
        own = [rng.choice(words) for _ in range(rng.choice((30, 120, 400)))]
        for _ in range(rng.randrange(1, 7)):
            texts.append((i, " ".join(own)))
            i += 1
            own = list(own)  # copies of copies: groups are chains
            for _ in range(rng.randrange(0, 1 + len(own) // 40)):
                own[rng.randrange(len(own))] = rng.choice(words)
    return [*texts, (i, ""), (i + 1, " "), (i + 2, "two words"), (i + 3, "Two  Words"), (i + 4, "two")]


def test_near_dedup_keeps_one_of_each_group_of_similar_texts(spark, monkeypatch):
    texts = near_copies()
    want = plain_groups(texts)
    assert 40 < len(set(want.values())) < len(texts) - 60
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 2)  # groups in many blocks
    monkeypatch.setattr(simhash, "BUCKET", 3)  # index values in many blocks
    monkeypatch.setattr(simhash, "SMALL", 2)
    monkeypatch.setattr(simhash, "STEP_ROWS", 50)
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == sorted(set(want.values()))


def test_only_the_tables_that_are_still_read_stay(spark):
    before = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/table-*"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in near_copies()], SCHEMA)
    kept = simhash.one_of_each(docs)
    after = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/table-*")) - before
    assert len(after) == 1 and kept.count() > 40


def test_keys_that_repeat_or_are_null(spark):
    odd = [(7, "one text of its own here"), (7, "one text of its own here"), (None, "no id at all and alone"), (None, "no id at all and alone"), (None, "one text of its own here"), (8, "")]
    rows = simhash.one_of_each(spark.createDataFrame([(i, t, None, None, None) for i, t in odd], SCHEMA)).collect()
    assert sorted(map(str, (tuple(r)[:2] for r in rows))) == sorted(map(str, [(7, "one text of its own here"), (None, "no id at all and alone"), (8, "")]))
    assert simhash.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wide_fingerprints_equal_plain_majorities():
    own = simhash.shingle_set(" ".join(f"w{i * i % 97}" for i in range(700)))
    for rows in (own, own[:1], own[:255], own[:256]):
        plain = []
        for w in range(3):
            h = [int(simhash.mixed(np.array([x ^ np.uint64((w + 1) * int(simhash._A) & (1 << 64) - 1)]))[0]) for x in rows]
            plain.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
        assert simhash.wide_fingerprint(rows, 3).tolist() == plain


def test_a_segment_plan_reaches_pairs_at_the_least_similarity():
    for n in (0, 1, 10**5, 10**7, 10**9):
        bits, segments = simhash.plan_segments(n)
        assert (1 - simhash.reach(bits)) ** segments <= simhash.MISS and 2**bits >= n / 2
    rng, bits, segments, met = np.random.default_rng(4), 14, 6, 0
    for _ in range(300):  # sets of 400 with a similarity of 0.8
        pool = rng.integers(0, 1 << 63, 445, dtype=np.uint64)
        a, b = (simhash.wide_fingerprint(np.unique(x), simhash.NEAR_LONGS) for x in (pool[:400], pool[45:]))
        assert simhash.distances(a[None], b[None])[0] <= simhash.NEAR_BITS
        cut = lambda x: np.unpackbits(x.view(np.uint8), bitorder="little")[: bits * segments].reshape(segments, bits)
        met += ((cut(a) != cut(b)).sum(1) <= 2).any()
    assert met >= 291
