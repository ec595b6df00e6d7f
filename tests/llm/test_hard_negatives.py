import math

import numpy as np
from pyspark.sql import functions as F

from sonarlake.llm.hard_negatives import MiningRule, SharedList, mine, upper_bounds, whole_numbers


def loop(rows, every, rule):
    """Every anchor against every row, in plain Python."""
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    anchors = {}
    for i, lab, v in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (len(v), lab, v)), (len(v), lab, v))
    for a, (_, lab, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in good if len(w) == len(v))
        for s, p in [(-s, i) for s, i, other in scored if other == lab and i != a][:rule.positives]:
            band = [(i, -t) for t, i, other in scored if other != lab and rule.low * s <= -100 * t <= rule.high * s]
            out += [(a, p, k + 1, i, s, t) for k, (i, t) in enumerate(band[:rule.negatives])]
    return sorted(out)


def got(df, every, rule):
    df = df.withColumn("vector", whole_numbers(F.col("embedding"), 256))
    return sorted(tuple(r) for r in mine(df, F.col("vec_id") % every == 0, rule).collect())


def test_equals_the_loop_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=4).round(1).tolist(), int(rng.integers(3))) for i in range(150)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(40)] + [(1000, rows[5][1], 1)]
    rows += [(2000, None, 1), (2010, [], 1), (2011, [], 2), (2020, [0.0] * 4, 1), (2030, [1.0, None, 0.0, 0.0], 1), (2040, [math.nan] * 4, 1), (2050, [math.inf] * 4, 1),
             (2060, [1.0] * 4, None), (None, [1.0] * 4, 1), (2070, [1.0, 2.0], 1), (2071, [3.0, 4.0], 1), (2072, [3.0, 1.0], 2), (2080, [5.0], 1), (-20, rows[0][1], 0), (40, rows[3][1], 2)]
    df = spark.createDataFrame([(i, v, lab, 1, 2, 3) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, v int, block int, cluster int").repartition(5)
    for rule in (MiningRule(cluster=3, block=40), MiningRule(positives=2, negatives=3, low=10, high=100)):
        assert got(df, 10, rule) == loop(rows, 10, rule)
    assert got(df.limit(0), 10, MiningRule()) == []
    assert got(df.filter("vec_id = 10"), 10, MiningRule()) == []


def test_bounds_hold_and_end_the_walk_early():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 100
    x = (np.repeat(centres, 200, axis=0) + rng.normal(size=(4000, 16)) * 4).astype("int64")
    members = x[:30]
    dots = x @ members.T
    assert (dots <= upper_bounds(x, members)[:, None] * np.linalg.norm(members, axis=1)[None, :]).all()
    shared = SharedList(np.arange(4000), np.zeros(4000, "int64"), x, members, tile=100)
    low, high = np.full(30, np.iinfo("int64").min), np.full(30, np.iinfo("int64").max)
    ask, ids, score = shared.best(np.arange(30), lambda r, a: np.ones((len(r), len(a)), bool), low, high, 5)
    for a in range(30):
        want = sorted(zip(-dots[:, a], range(4000)))[:5]
        assert [(-s, i) for s, i in zip(score[ask == a], ids[ask == a])] == want
    assert shared.seen < 0.3 * dots.size


def test_large_components_stay_exact():
    x = np.array([[2 ** 27, 2 ** 27 - 1], [2 ** 27 - 1, 2 ** 27]], "int64")
    shared = SharedList(np.array([7, 8]), np.zeros(2, "int64"), x, x[:1])
    _, ids, score = shared.best(np.zeros(1, "int64"), lambda r, a: np.ones((len(r), len(a)), bool), np.full(1, -2 ** 62), np.full(1, 2 ** 62), 2)
    assert score.tolist() == [int(x[0, 0]) ** 2 + int(x[0, 1]) ** 2, 2 * int(x[0, 0]) * int(x[0, 1])] and ids.tolist() == [7, 8]
