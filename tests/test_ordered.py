"""Scans over a global order against plain Python, with groups, nulls and ties."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from wharfline.operators.ordered import connected, indexed, last_known, medians, running_total


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    return [(i, rng.choice(["a", "a", "a", "b", None]), rng.randint(-50, 50) if rng.random() < 0.7 else None) for i in range(3000)] + [(3000, "c", None), (3001, "d", 4)]


def test_scans(spark, rows):
    d = spark.createDataFrame(rows, "id long, g string, v long").repartition(7)
    for group in ([], ["g"]):
        at, total, last = {}, {}, {}
        want = {}
        for i, g, v in rows:
            k = g if group else 0
            at[k] = at.get(k, -1) + 1
            total[k] = total.get(k) if v is None else (total.get(k) or 0) + v
            last[k] = last.get(k) if v is None else v
            want[i] = (at[k], total[k], last[k])
        one = {r.id: r.idx for r in indexed(d, group, ["id"]).collect()}
        two = {r.id: r.t for r in running_total(d, "v", "t", ["id"], group).collect()}
        three = {r.id: r.l for r in last_known(d, "v", "l", ["id"], group).collect()}
        assert {i: (one[i], two[i], three[i]) for i in want} == want and len(one) == len(two) == len(three) == len(rows)
    assert indexed(d.limit(0), ["g"], ["id"]).isEmpty()


def test_medians(spark, rows):
    d = spark.createDataFrame(rows, "id long, g string, v long").repartition(7)
    by = {}
    for _, g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    assert {r.g: r["median"] for r in medians(d, ["g"], "v").collect()} == {g: statistics.median(v) for g, v in by.items()}
    assert [r["median"] for r in medians(d, [], "v").collect()] == [statistics.median([v for x in by.values() for v in x])]
    hot = spark.range(200_001).select(F.lit("x").alias("g"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("v"))
    assert medians(hot, ["g"], "v").first()["median"] == 1.0


def test_connected(spark):
    rng = random.Random(3)
    ids = list(range(400))
    rng.shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(0, 150)] + [(ids[200 + i], ids[200 + i // 3]) for i in range(1, 120)] + [(ids[390], ids[390])]
    label = {x: x for e in edges for x in e}
    for _ in range(500):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()} == label
