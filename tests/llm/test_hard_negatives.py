import random
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvest.llm.hard_negatives import Rules, hard_negatives, scores, usable

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50):
    """Sorted result by comparing all anchors with all rows, in unbounded integers."""
    fine = [(i, (y + 1) % 10 if i % 7 == 0 else y, [floor(256 * x) for x in v]) for i, v, y in rows
            if None not in (i, v, y) and all(x is not None and isfinite(x) for x in v)]
    anchors, out = {}, []
    for i, y, v in fine:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    for i, (y, v) in anchors.items():
        near = sorted((-max(-2**63 + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, u)))), j, z) for j, z, u in fine if j != i)
        for p, j, _ in [r for r in near if r[2] == y][:5]:
            found = [(n, k) for n, k, z in near if z != y and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(i, j, rank, k, -p, -n) for rank, (n, k) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, every=50, **settings):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    table = usable(spark.createDataFrame(rows, SCHEMA), moved)
    return sorted(tuple(r) for r in hard_negatives(table, table.where(f"vec_id % {every} = 0"), **settings).collect())


def vectors(seed, n, dims, labels=3, scale=1.0):
    rng = random.Random(seed)
    return [(i, [scale * rng.gauss(0.2, 0.6) for _ in range(dims)], rng.randrange(labels)) for i in rng.sample(range(3 * n), n)]


@pytest.mark.parametrize("block_bytes", [16 << 20, 300])
def test_rows_equal_brute_force(spark, block_bytes):
    rows = vectors(1, 700, 8)
    want = brute(rows, 20)
    assert len(want) > 100 and mined(spark, rows, 20, block_bytes=block_bytes) == want


def test_awkward_rows(spark):
    """Nulls, odd components, unequal lengths, ties, repeated rows and ids, a third of all rows alike."""
    rows = vectors(2, 200, 4)
    rows += [(None, [1.0], 1), (9001, None, 1), (9002, [1.0, None], 1), (9003, [float("nan")], 1), (9004, [float("inf")], 1), (9005, [1.0] * 4, None)]
    rows += [(9010, [], 1), (9050, [], 1), (9011, [0.5], 2), (9012, [0.5] * 9, 0), (9100, [0.5] * 9, 0), (9100, [0.25] * 9, 0)]
    rows += [(10_000 + i, [0.3, 0.4, 0.5, 0.6], i % 4) for i in range(100)] + [(10_007, [0.3, 0.4, 0.5, 0.6], 3)] * 3
    want = brute(rows)
    assert want and mined(spark, rows) == want


def test_many_equal_rows_stay_few(spark):
    rows = [(i, [1.0, 0.5], 0) for i in range(0, 3000, 2)] + [(i, [0.75, 0.375], 1) for i in range(1, 3000, 2)]
    assert mined(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    for scale in (1e4, 3e6, 1e18):
        rows = vectors(3, 60, 3, 2, scale)
        assert mined(spark, rows, 10) == brute(rows, 10)
    big = np.array([[3e9, 7.0]])
    assert scores(big, big).tolist() == [[9 * 10**18 + 49]]


def test_empty_tables(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(0, [1.0], 1)]) == []


def test_other_rules_and_columns(spark):
    rows = vectors(4, 300, 4, 2)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("vector", "score", "_block", "_n", "_kind", "id")})
    got = hard_negatives(usable(table), usable(table).where("vec_id % 30 = 0"), Rules(positives=1, negatives=1, low=0, high=100))
    assert 0 < got.count() == got.select("anchor_id").distinct().count()
