import math

import numpy as np
from pyspark.sql import functions as F

from sonarlake.llm.common import table
from sonarlake.llm.lsh_forest import Forest, ForestSettings, nearest


def brute(rows, k, every):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in good.items():
        if q % every == 0:
            found = sorted((-float(x @ y), i) for i, y in good.items() if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_runs_share_the_longest_prefixes():
    rng = np.random.default_rng(1)
    vectors, queries = rng.normal(size=(300, 6)), rng.normal(size=(7, 6))
    s = ForestSettings(trees=3, bits=12, fraction=0.3, least=1)
    f = Forest(vectors, 9.0, s)
    codes, mine = f.codes(np.column_stack([vectors, np.sqrt(81 - (vectors ** 2).sum(1))])), f.codes(np.column_stack([queries, np.zeros(7)]))
    for q, got in enumerate(f.candidates(queries)):
        for depth in range(12, -1, -1):
            runs = [np.flatnonzero(codes[t] >> np.uint64(12 - depth) == mine[t, q] >> np.uint64(12 - depth)) for t in range(3)]
            if sum(map(len, runs)) >= 90 or depth == 0:
                break
        assert got.tolist() == sorted(set(np.concatenate(runs).tolist()))


def test_small_tables_equal_brute_force_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=4).round(1).tolist()) for i in range(60)]
    rows += [(100 + i, rows[5][1]) for i in range(50)] + [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 0.0]), (204, [math.nan] * 4),
             (205, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4), (220, [1.0, 2.0]), (221, [3.0, 4.0]), (240, [5.0]), (40, rows[40][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, block int, score int").repartition(4)
    got = {}
    for r in nearest(df, k=5, every=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {q: v for q, v in brute(rows, 5, 20).items() if v}
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for q in want for a, b in zip(got[q], want[q]))
    assert nearest(df.limit(0)).count() == 0


def test_recall_over_blocks(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = {}
    for r in nearest(df, settings=ForestSettings(block=700)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, 20, 20)
    recall = np.mean([len(got[q] & {i for i, _ in v}) / len(v) for q, v in want.items()])
    assert recall >= 0.95
    assert df.filter(F.col("vec_id") % 20 == 0).count() == len(got)
