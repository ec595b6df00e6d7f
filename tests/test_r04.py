"""Findings of the fourth review."""
import random

import pytest
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mask_iou_moves_blocks_of_cells_as_bits(spark):
    from sonarlake.operators import evaluation as ev

    rnd = random.Random(4)
    draw = lambda: {(rnd.randint(-9, 20), rnd.randint(-9, 20)) for _ in range(rnd.randint(0, 300))}
    p, g = {i: draw() for i in range(30)}, {100 + i: draw() for i in range(30)}
    pairs = [(i, 100 + (i * 7) % 30) for i in range(0, 30, 2)]
    rows = lambda m: [(k, r, c) for k, v in m.items() for r, c in v]
    out = ev.instance_mask_iou(spark.createDataFrame(pairs, "pred_id bigint, gt_id bigint"), spark.createDataFrame(rows(p), "pred_id bigint, row int, col int"),
                               spark.createDataFrame(rows(g), "gt_id bigint, row int, col int"))
    assert {(r.pred_id, r.gt_id): r.iou for r in out.collect()} == {(a, b): len(p[a] & g[b]) / len(p[a] | g[b]) for a, b in pairs if p[a] | g[b]}
    # no lists are gathered and shuffled
    assert "collect_set" not in plan_of(out) and "array_intersect" not in plan_of(out)


def near_fragments(seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rnd.choice([10.0 * rnd.randrange(30), rnd.uniform(0, 300)]), 10.0 * rnd.randrange(30)
        rows.append((rnd.choice([1, 1, 2, 3]), i, x, y, x + rnd.choice([4.0, 12.0, 40.0]), y + rnd.choice([3.0, 20.0]), rnd.randrange(5)))
    rows += [(4, n, 0.0, 0.0, 9.0, 9.0, 1), (4, n + 1, 0.0, 0.0, 9.0, 9.0, 2), (None, n + 2, 5.0, 5.0, 8.0, 8.0, 1), (5, n + 3, 1.0, 1.0, 2.0, 2.0, 0)]
    return rows


def test_fragments_of_small_images_meet_in_one_shuffle(spark, monkeypatch):
    from sonarlake.operators import cfar as cf
    from sonarlake.plans import groups

    df = spark.createDataFrame(near_fragments(5, 120), "survey_id int, candidate_id bigint, x1 double, y1 double, x2 double, y2 double, regime int").withColumns(
        {"area": F.expr("(x2 - x1) * (y2 - y1)"), "peak_intensity": F.expr("candidate_id * 1D"), "contrast_ratio": F.lit(1.0), "cx": F.lit(0.0), "cy": F.lit(0.0)})
    columns = ["survey_id", "x1", "y1", "x2", "y2", "area", "merged_fragments", "candidate_id", "regime"]
    out = cf.merge_candidates(df.filter("survey_id is not null"), 6)
    plan = plan_of(out)
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan  # the images' boxes, then a row per object and task
    walked = sorted(map(str, out.select(columns).collect()))
    assert walked == sorted(r for r in map(str, cf.merge_candidates(df, 6).select(columns).collect()) if "survey_id=None" not in r) and len(walked) > 10
    monkeypatch.setattr(groups, "SMALL", 30)  # some images are walked, some are joined
    assert walked == sorted(r for r in map(str, cf.merge_candidates(df, 6).select(columns).collect()) if "survey_id=None" not in r)
    monkeypatch.setattr(groups, "SMALL", 0)
    assert walked == sorted(r for r in map(str, cf.merge_candidates(df, 6).select(columns).collect()) if "survey_id=None" not in r)


def test_groups_are_whole_across_batches_and_slabs(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    from sonarlake.plans import groups

    def work(t, sizes):
        assert (sizes * sizes).sum() <= 200 + sizes.max() ** 2
        return t.append_column("n", pa.array([int(s) for s in sizes for _ in range(s)], pa.int64()))

    monkeypatch.setattr(groups, "PAIRS", 200)
    parts = [[(k, i) for k, n in batch for i in range(n)] for batch in ([("a", 3)], [("a", 4), ("b", 1), ("c", 19)], [], [("c", 1), ("d", 9), ("e", 9), ("f", 2)])]
    batches = [pa.RecordBatch.from_pylist([{"k": k, "i": i} for k, i in p], pa.schema([("k", pa.string()), ("i", pa.int64())])) for p in parts]
    got = [r for b in groups._whole_groups(["k"], work)(iter(batches)) for r in b.to_pylist()]
    assert {r["k"]: r["n"] for r in got} == {"a": 7, "b": 1, "c": 20, "d": 9, "e": 9, "f": 2} and len(got) == 48
    df = spark.range(300).selectExpr("id % 70 as k", "id")
    out = groups.map_groups(df, ["k"], [F.col("id").desc()], work, StructType([*df.schema.fields, StructField("n", LongType())]))
    assert sorted((r.k, r.n) for r in out.distinct().collect()) == sorted((i % 70, 5 if i % 70 < 20 else 4) for i in range(300))


def test_boxes_of_small_images_are_suppressed_in_one_shuffle(spark, monkeypatch):
    from sonarlake.operators import detections as dt
    from sonarlake.plans import groups

    rnd = random.Random(6)
    rows = []
    for i in range(260):
        x, y = 7.0 * rnd.randrange(12), rnd.choice([5.0 * rnd.randrange(12), rnd.uniform(0, 60)])
        rows.append((rnd.choice([1, 1, 1, 2, 3]), i, rnd.choice([0.2, 0.5, 0.9, rnd.random(), None]), x, y, x + rnd.choice([0.0, 12.0, 20.0]), y + rnd.choice([9.0, 18.0])))

    def iou(a, b):
        inter = max(0.0, min(a[5], b[5]) - max(a[3], b[3])) * max(0.0, min(a[6], b[6]) - max(a[4], b[4]))
        union = (a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - inter
        return inter / union if union > 0 else 0.0

    kept = []
    for q in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0.0), r[1])):
        if not any(k[0] == q[0] and iou(k, q) > 0.35 for k in kept):
            kept.append(q)
    df = spark.createDataFrame(rows, "image_id int, pred_id bigint, conf double, x1 double, y1 double, x2 double, y2 double")
    out = dt.nms(df, ["image_id"], "pred_id")
    plan = plan_of(out)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sorted(map(tuple, out.collect()), key=str) == sorted(kept, key=str) and 60 < len(kept) < 240
    for limit in (60, 0):  # some images, then all, are solved by joins
        monkeypatch.setattr(groups, "SMALL", limit)
        assert sorted(map(tuple, dt.nms(df, ["image_id"], "pred_id").collect()), key=str) == sorted(kept, key=str)


def test_gate_over_small_images_in_one_shuffle(spark, monkeypatch):
    from sonarlake.operators import fusion as fu
    from sonarlake.plans import groups

    rnd = random.Random(7)

    def side(n, extra):
        out = []
        for i in range(n):
            x, y = 6.0 * rnd.randrange(20), 6.0 * rnd.randrange(20)
            out.append((rnd.choice([1, 1, 1, 2, 3]), i, x, y, x + rnd.choice([12.0, 20.0]), y + rnd.choice([9.0, 18.0]), extra()))
        return out

    b, c, a = side(90, rnd.random), side(80, rnd.random), side(60, lambda: rnd.choice([None, -0.5, rnd.random()]))
    c += [(1, 200, 0.0, 0.0, 12.0, 9.0, 0.1), (1, 200, 50.0, 50.0, 62.0, 59.0, 0.2), (9, 201, 0.0, 0.0, 5.0, 5.0, 0.3), (None, 202, 0.0, 0.0, 5.0, 5.0, 0.3)]

    def hit(p, q):
        inter = max(0.0, min(p[4], q[4]) - max(p[2], q[2])) * max(0.0, min(p[5], q[5]) - max(p[3], q[3]))
        return p[0] == q[0] and inter / ((p[4] - p[2]) * (p[5] - p[3]) + (q[4] - q[2]) * (q[5] - q[3]) - inter) > 0.15

    first = lambda p: min((q[1] for q in c if hit(p, q)), default=None)
    boxes = [(*p, first(p), max([0.0, *[q[6] for q in a if hit(p, q) and q[6] is not None]])) for p in b]
    left = [(*q, first(q)) for q in a if not any(hit(p, q) for p in b)]
    used = {(p[0], p[7]) for p in [*boxes, *left]}
    want = {"boxes": boxes, "anomalies": left, "candidates": [q for q in c if (q[0], q[1]) not in used]}
    frame = lambda rows, i, v: spark.createDataFrame(rows, f"image_id int, {i} bigint, x1 double, y1 double, x2 double, y2 double, {v} double")
    given = frame(b, "box_id", "conf"), frame(c, "cand_id", "contrast_ratio"), frame(a, "anom_id", "anomaly_score")
    shape = {"boxes": ["box_id", "conf", "cand_id", "ae_score"], "anomalies": ["anom_id", "anomaly_score", "cand_id"], "candidates": ["cand_id", "contrast_ratio"]}
    plans = []
    inner = fu.durable
    monkeypatch.setattr(fu, "durable", lambda df, name: (plans.append(plan_of(df)), inner(df, name))[1])
    for limit in (1024, 60, 0):  # all images in tasks, some of them, none
        monkeypatch.setattr(groups, "SMALL", limit)
        got = fu.gate_overlap(*given)
        for name, rows in want.items():
            seen = [tuple(r[k] for k in ("image_id", shape[name][0], "x1", "y1", "x2", "y2", *shape[name][1:])) for r in got[name].collect()]
            assert sorted(seen, key=str) == sorted(rows, key=str), (limit, name)
    assert len(left) > 5 and len(want["candidates"]) > 5
    assert plans[0].count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plans[0]


def test_plain_and_wide_assignment_take_the_same_steps():
    import numpy as np

    from sonarlake.functions import assign as fa

    rng = np.random.default_rng(3)
    for k in range(300):
        n = int(rng.integers(1, 9))
        cost = rng.integers(0, 6, (n, n + int(rng.integers(0, 12)))) + (rng.random() if k % 2 else 0.0)  # with many ties
        cost = np.where(rng.random(cost.shape) < 0.3, 1e6, cost)
        assert fa._assign_small(cost.tolist(), cost.shape[1]) == fa._assign_wide(cost)
        allowed = cost < 1e5
        best = sum(cost[i, j] for i, j in fa._assign_wide(cost) if allowed[i, j])
        for c, a in ((cost, allowed), (cost.T, allowed.T)):
            found = [(i, j) for i, j in fa.matched_pairs(c, a) if a[i, j]]
            assert sum(c[i, j] for i, j in found) == pytest.approx(best) and len({i for i, _ in found}) == len({j for _, j in found}) == len(found)


def test_held_frames_are_stored_as_blocks_of_bytes():
    import pandas as pd

    from sonarlake.config import TrackSettings
    from sonarlake.streaming import tracks as ts
    from tests.test_r03_tracks import Handle

    rows = pd.DataFrame([(f, 2 * f + k, 1000 + f, 5.0 * k, None if f % 9 else 1.5, "can" if k else None) for f in range(300) for k in range(2)], columns=ts.HELD)
    handle, walker = Handle(), ts.HeldFrames(TrackSettings())
    walker.init(handle)
    list(walker.handleInputRows((1,), iter([rows.iloc[250:], rows.iloc[:250]]), handle))
    held = handle.states[0].m
    assert len(held) == 3 and all(len(v) == 1 and isinstance(v[0], bytes) for v in held.values())
    back = pd.concat([ts.unpacked(v[0]) for v in held.values()]).sort_values("det_id", ignore_index=True)
    pd.testing.assert_frame_equal(back, rows, check_dtype=False)
