"""Rising curves and stratified folds against plain pooling."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.operators import isotonic, training

POINTS = "fold int, x double, y double, weight double"


def plain(points):
    """By the theorem: the largest over starts of the smallest mean over ends."""
    out = {}
    for f in {p[0] for p in points}:
        at = {}
        for k, x, y, w in points:
            if k == f:
                s, t = at.get(x, (0.0, 0.0))
                at[x] = (s + w * y, t + w)
        xs = sorted(at)
        mean = lambda j, k: sum(at[x][0] for x in xs[j : k + 1]) / sum(at[x][1] for x in xs[j : k + 1])  # noqa: B023,E731
        for i, x in enumerate(xs):
            out[f, x] = max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1))
    return out


@pytest.mark.parametrize("parts", [1, 9])
def test_pooled_blocks(spark, parts):
    rng = random.Random(parts)
    points = [(f, float(rng.randint(0, 30)), float(rng.random() < 0.2 + f / 10), rng.choice([1.0, 0.5])) for f in range(4) for _ in range(60)]
    points += [(9, 1.0, 1.0, 1.0), (8, 1.0, 1.0, 1.0), (8, 2.0, 0.0, 1.0)]
    odd = [(None, 1.0, 1.0, 1.0), (9, None, 1.0, 1.0), (9, float("nan"), 1.0, 1.0), (9, 1.0, None, 1.0), (9, 5.0, 0.0, 0.0), (9, 6.0, 0.0, None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        blocks = [tuple(r) for r in isotonic.pooled(spark.createDataFrame(points + odd, POINTS)).orderBy("fold", "low").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for a, b in zip(blocks[:-1], blocks[1:], strict=True):
        assert a[0] != b[0] or (a[2] < b[1] and a[3] < b[3])
    for (f, x), value in plain(points).items():
        (own,) = [b for b in blocks if b[0] == f and b[1] <= x <= b[2]]
        assert own[3] == pytest.approx(value)
    assert isotonic.pooled(spark.createDataFrame([], POINTS)).count() == 0


@pytest.mark.parametrize("n", [5, 2_000])
def test_curves_are_read_alike(spark, n):
    """Long curves are read by another function than short ones."""
    lines = isotonic.curves(spark.createDataFrame([(0, float(i), i / n, 1.0) for i in range(n)], POINTS))
    got = spark.createDataFrame([(-3.0,), (0.0,), (1.5,), (n + 9.0,)], "x double").select(lines[0].at(F.col("x")).alias("v")).collect()
    assert [r["v"] for r in got] == pytest.approx([0.0, 0.0, 1.5 / n, (n - 1) / n])


def test_folds_are_stratified(spark):
    rows = spark.createDataFrame([(i, 1.0 if i % 7 == 0 else 0.0) for i in range(100)], "doc_id long, y double")
    count = Counter((r["y"], r["fold"]) for r in training.stratified_folds(rows, 4).collect())
    assert sum(count.values()) == 100
    for y in (0.0, 1.0):
        own = [count[y, f] for f in range(4)]
        assert max(own) - min(own) <= 1
    few = training.stratified_folds(rows.filter("y = 0 or doc_id < 15"), 5)  # three of label 1
    assert few.agg(F.max("fold")).first()[0] == 2
    with pytest.raises(ValueError, match="two rows"):
        training.stratified_folds(rows.filter("y = 0 or doc_id = 7"))
