"""Registered queries against their SQL on the smallest data. SONARLAKE_ALL=1 runs all of them."""
import math
import os

import duckdb
import pytest

from sonarlake.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["table_pings", "table_pred", "b01_validate_pings", "e03_trajectory_verdict", "e08_resurvey_areas", "s18_scqi", "s19_quality_control", "s03_geolocate", "c04_fuse_objects",
        "s10_decision_gate", "w01_snr_index", "w10_ring_mean", "w18_shadow_check", "h01_kde_grid", "h03_scqi_heatmap", "v04_mean_iou", "v06_region_score", "v15_roc_auc",
        "v18_select_threshold", "k03_stratified_split", "e10_cv_forecast", "a06_decode_nav", "u02_stream_trajectory", "d06_dataset_summary"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("SONARLAKE_ALL") else SOME)
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = db.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want
