"""Connected components against a plain walk."""

import random

from printloom.llm import graph


def plain(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for x in sorted(near):
        todo = [] if x in out else [x]
        while todo:
            y = todo.pop()
            if y not in out:
                out[y] = x
                todo += near[y]
    return out


def test_components_of_chains_stars_and_cliques(spark, monkeypatch):
    rng = random.Random(2)
    names = [rng.randrange(-(2**63), 2**63) for _ in range(400)]
    edges = [(names[i], names[i + 1]) for i in range(60)] + [(names[100], names[i]) for i in range(101, 180)]
    edges += [(names[i], names[j]) for i in range(200, 215) for j in range(200, 215)] + [(rng.choice(names[250:]), rng.choice(names[250:])) for _ in range(90)]
    want = plain([(a, b) for a, b in edges if a != b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for part in (1 << 20, 40):
        monkeypatch.setattr(graph, "PART_EDGES", part)
        assert {r["node"]: r["component"] for r in graph.components(df).collect()} == want
    assert graph.components(df.limit(0)).count() == 0
