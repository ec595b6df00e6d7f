import random

import numpy as np
import pandas as pd
import pytest

from sonarlake.operators import cfar as cf
from sonarlake.plans.iterate import connected_components, first_come_set
from sonarlake.plans.ordered import dense_index, exact_quantiles, running_sums
from sonarlake.plans.spatial import best_overlap, box_pairs


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most of the rows."""
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 5), rng.randint(0, 40), i, rng.randint(1, 9)) for i in range(3000)]
    return pd.DataFrame(rows, columns=["k", "o", "i", "v"])


@pytest.mark.parametrize("slices", [1, 8])
def test_dense_index_equals_row_number(spark, skewed, slices):
    got = dense_index(spark.createDataFrame(skewed), ["k"], ["o", "i"], slices=slices).toPandas().sort_values("i")
    want = skewed.sort_values(["k", "o", "i"]).assign(idx=lambda d: d.groupby("k").cumcount()).sort_values("i")
    assert (got["idx"].to_numpy() == want["idx"].to_numpy()).all()


@pytest.mark.parametrize("slices", [1, 8])
def test_running_sums(spark, skewed, slices):
    got = running_sums(spark.createDataFrame(skewed), ["k"], ["o", "i"], {"s": "v"}, slices=slices).toPandas().sort_values("i")
    want = skewed.sort_values(["k", "o", "i"]).assign(s=lambda d: d.groupby("k")["v"].cumsum()).sort_values("i")
    assert (got["s"].to_numpy() == want["s"].to_numpy()).all()


def test_exact_quantiles(spark, skewed):
    got = exact_quantiles(spark.createDataFrame(skewed), ["k"], "o", [0.0, 0.33, 0.5, 1.0]).toPandas()
    for (k, no), g in got.groupby(["k", "q_no"]):
        assert g["q"].iloc[0] == pytest.approx(np.quantile(skewed[skewed.k == k]["o"], [0.0, 0.33, 0.5, 1.0][no]))


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    n = 400
    edges = [(i, i + 1) for i in range(0, 90)] + [(rng.randrange(100, n), rng.randrange(100, n)) for _ in range(220)]
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    out = connected_components(spark.range(n), spark.createDataFrame(edges, "a bigint, b bigint")).toPandas()
    assert {r.id: r.component for r in out.itertuples()} == {i: find(i) for i in range(n)}


def test_first_come_set_equals_loop(spark):
    rng = random.Random(7)
    n = 200
    pairs = {tuple(sorted((rng.randrange(n), rng.randrange(n)))) for _ in range(400)}
    pairs = {(a, b) for a, b in pairs if a != b}
    kept = []
    for i in range(n):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    got = first_come_set(spark.range(n), spark.createDataFrame(list(pairs), "earlier bigint, later bigint"))
    assert sorted(r.id for r in got.collect()) == kept


def boxes(rng, n, first):
    out = []
    for i in range(n):
        side = rng.choice([3, 10, 40, 200])
        x, y = rng.uniform(0, 300), rng.uniform(0, 300)
        out.append((rng.randint(0, 1), first + i, x, y, x + side * rng.uniform(0.5, 1.5), y + side * rng.uniform(0.5, 1.5)))
    return out + [(0, first + n + j, 50.0, 50.0, 70.0, 70.0) for j in range(n // 2)]


def iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / u


@pytest.mark.parametrize("pad", [0.0, 6.0])
def test_box_pairs_equal_nested_loop(spark, pad):
    rng = random.Random(11)
    a, b = boxes(rng, 60, 0), boxes(rng, 60, 1000)
    s = "image_id int, {} bigint, x1 double, y1 double, x2 double, y2 double"
    got = box_pairs(spark.createDataFrame(a, s.format("p")), spark.createDataFrame(b, s.format("q")), ["image_id"], "p", "q", pad)
    rows = [(r.p, r.q) for r in got.select("p", "q").collect()]
    gap = 2 * pad
    want = {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and not (x[4] + gap < y[2] or y[4] + gap < x[2] or x[5] + gap < y[3] or y[5] + gap < x[3])}
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_best_overlap_equals_argmax(spark):
    rng = random.Random(12)
    a, b = boxes(rng, 50, 0), boxes(rng, 50, 1000)
    s = "image_id int, {} bigint, x1 double, y1 double, x2 double, y2 double"
    got = best_overlap(spark.createDataFrame(a, s.format("p")), spark.createDataFrame(b, s.format("q")), ["image_id"], "q").collect()
    got = {r.p: r.best_id for r in got}
    for x in a:
        cand = [(-iou(x[2:], y[2:]), y[1]) for y in b if y[0] == x[0] and iou(x[2:], y[2:]) > 0]
        assert got[x[1]] == (min(cand)[1] if cand else None)


def test_box_sums_equal_padded_numpy(spark):
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (40, 23))
    cells = spark.createDataFrame([(1, int(p), int(c), int(img[p, c])) for p in range(40) for c in range(23)], "survey_id int, ping bigint, col int, v int")
    got = cf.box_sums(cells, {"s": ("v", 5), "t": ("v", 2)}, chunk=7).toPandas()
    assert len(got) == img.size
    for name, r in (("s", 5), ("t", 2)):
        padded = np.pad(img, r, mode="reflect")
        want = sum(padded[i:i + 40, j:j + 23] for i in range(2 * r + 1) for j in range(2 * r + 1))
        assert (got.sort_values(["ping", "col"])[name].to_numpy().reshape(40, 23) == want).all()


@pytest.mark.parametrize("name", ["k04_ratio_split", "k05_group_split", "d22_forecast_errors", "e12_tracking_metrics", "v09_confidence_sweep", "v10_ablation",
                                  "v18_select_threshold", "v22_select_policy", "r04_training_set"])
def test_totals_are_not_crossed(spark, name):
    """One-row totals come as scalar subqueries: no cross product even when nothing may be broadcast."""
    from sonarlake.queries import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
