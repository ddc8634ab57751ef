"""Known and discovered identifiers where the base expressions fail, and long texts."""

import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from printloom.llm import pii
from test_documents import PII, plain_pii


def test_known_identifiers_are_marked_next_to_other_numbers(spark):
    texts = [(1, "pay by 4111111111111111 now"), (2, "order 12 4111111111111111 is late"), (3, "call +1-555-123-4567 now"), (4, "call +1-555-123-4567 20231010 please"), (5, "order 12 4111111111111112")]
    got = {r["doc_id"]: (r["n_discovered"], r["spans"]) for r in pii.find_pii(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1] == (0, "card:7:23") and got[2] == (1, "card:9:25")
    assert got[3] == (0, "phone:5:20") and got[4] == (1, "phone:5:20") and got[5] == (0, "")


def spans_of(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    return {r["doc_id"]: (r["n_discovered"], r["spans"]) for r in pii.find_pii(df).collect()}


def test_texts_of_many_identifiers_take_about_linear_time(spark):
    rng = random.Random(4)
    kinds = [lambda: "u%d@h%d.org" % (rng.randrange(999), rng.randrange(99)), lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: "+1 555 %07d" % rng.randrange(10**7), lambda: "AB%07d" % rng.randrange(10**7), lambda: "mot"]
    many = " ".join(rng.choice(kinds)() for _ in range(90_000))
    assert len(many) > 900_000
    texts = [(1, many), (2, "\n".join(kinds[1]() for _ in range(20_000)))]
    began = time.time()
    got = spans_of(spark, texts)
    assert time.time() - began < 60
    for i, t in texts:
        want = {f"{PII[k][0]}:{a}:{b}" for a, k, b in plain_pii(t)}
        assert want <= set(got[i][1].split(",")) and len(got[i][1].split(",")) == len(want) + got[i][0]


def test_running_values_in_blocks(spark):
    for n in (0, 1, 2, 3, 10, 257):
        own = [(i * 7919) % 31 - 9 for i in range(n)]
        df = spark.createDataFrame([(own,)], "v array<int>")
        r = df.select(pii.running(F.col("v"), lambda a, b: a + b, 0), pii.running(F.col("v"), F.greatest, -100)).first()
        assert r[0] == [sum(own[: i + 1]) for i in range(n)] and r[1] == [max(own[: i + 1]) for i in range(n)]


def test_numbers_with_spaces_and_addresses_spelt_out_are_found(spark):
    texts = [(i, f"Please call phone: +1 555 123 45{i:02} after noon.") for i in range(10, 15)]
    texts += [(20 + i, f"write to mail: user{i}@host{i}.org any time") for i in range(5)]
    texts += [(30, "the phone: (555) 123 4567 after all"), (31, "call phone: 555 123 4567 works"), (32, "a mail: john at example dot org any day"), (33, "version 1.2 of 2024 01 02"), (34, "look at the dot there")]
    got = spans_of(spark, texts)
    assert got[30] == (1, "phone:11:25") and got[31] == (1, "phone:12:24")
    assert got[32] == (1, "email:8:31") and got[33] == (0, "") and got[34] == (0, "")


def plain_bootstrap(seeds, tokens):
    """The same rounds over plain sets: seeds (kind, value, pattern), tokens (value, pattern)."""
    edges = {(p, v) for _, v, p in seeds} | {(p, v) for v, p in tokens}
    trust = {(k, v): 1.0 for k, v, _ in seeds}
    known, found = {v for _, v, _ in seeds}, {}
    while True:
        accepted = defaultdict(list)
        for (k, v), x in trust.items():
            for p, w in edges:
                if w == v:
                    accepted[p, k].append(x)
        score = {(p, k): min(1, sum(x) / sum(q == p for q, _ in edges)) for (p, k), x in accepted.items() if len(x) >= pii.MIN_SUPPORT}
        new = {}
        for v in {v for v, _ in tokens} - known - set(found):
            for k in range(4):
                miss = 1.0
                for p, w in edges:
                    if w == v and score.get((p, k), 0) >= pii.MIN_PATTERN:
                        miss *= 1 - pii.TRUST * score[p, k]
                if 1 - miss >= pii.MIN_INSTANCE and 1 - miss > new.get(v, (0, 0))[0] + 1e-12:
                    new[v] = (1 - miss, k)
        if not new:
            return {(v, k) for v, (_, k) in found.items()}
        found |= new
        trust |= {(k, v): x for v, (x, k) in new.items()}


def test_bootstrapping_equals_a_plain_version(spark):
    rng, total = random.Random(7), 0
    for _ in range(2):
        seeds = [(rng.randrange(3), f"s{i}", f"p{rng.randrange(6)}") for i in range(24)]
        seeds = [(int(v[1:]) % 3, v, p) for _, v, p in seeds]
        tokens = [(f"t{rng.randrange(16)}", f"p{rng.randrange(12)}") for _ in range(30)] + [("s3", "p1")]
        want = plain_bootstrap(seeds, tokens)
        got = pii.bootstrap(spark.createDataFrame(seeds, "kind int, value string, pattern string"), spark.createDataFrame(tokens, "value string, pattern string"))
        assert {(r["value"], r["kind"]) for r in got.collect()} == want
        total += len(want)
    chain = [(0, f"s{i}", p) for i in range(12) for p in ("p0", "q0")]  # each round finds the next group
    groups = [[f"a{g}-{j}" for j in range(n)] for g, n in enumerate((8, 4, 1))]
    links = [(v, f"{p}{g + more}") for g, own in enumerate(groups) for v in own for p in "pq" for more in (0, 1)]
    want = plain_bootstrap(chain, links)
    got = pii.bootstrap(spark.createDataFrame(chain, "kind int, value string, pattern string"), spark.createDataFrame(links, "value string, pattern string"))
    assert {(r["value"], r["kind"]) for r in got.collect()} == want and len(want) == 13


def test_an_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
