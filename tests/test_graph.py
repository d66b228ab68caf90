"""Components against a plain search, in one partition and in many."""

import random

import pytest

from kerbline.operators import graph


@pytest.mark.parametrize("partitions", [1, 7])
def test_components(spark, partitions):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(40)] + [(5, 5), (None, 3)]
    label = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in label:
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(edges, "src bigint, dst bigint").repartition(partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(partitions == 1).lower())
    got = graph.connected_components(frame)
    assert {r["node"]: r["component"] for r in got.collect()} == label
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert graph.connected_components(frame.where("false")).count() == 0


def test_few_edges_are_contracted_together(spark, monkeypatch):
    # Few edges in many partitions need no rounds; with no room for them the rounds give the same.
    rng = random.Random(8)
    ids = list(range(300))
    rng.shuffle(ids)
    want = {k: min(ids[:200] if k in ids[:200] else ids[200:]) for k in ids}
    edges = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(299) if i != 199], "src bigint, dst bigint").repartition(20)
    seen, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: seen.append(name) or write(df, name))
    found = lambda: {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert found() == want and len(seen) == 2
    monkeypatch.setattr(graph, "TOGETHER", 0)
    assert found() == want and len(seen) > 4
