"""Third review: logs of many small files."""
import pandas as pd
import pytest

from sonarlake.queries.streaming_q import jsf_bytes, xtf_bytes
from sonarlake.sources import log_source as ls
from sonarlake.sources import logs as lg


@pytest.mark.parametrize("kind, build", [("jsf", jsf_bytes), ("xtf", xtf_bytes)])
def test_small_files_share_tasks(spark, tmp_path, kind, build):
    for i in range(30):
        pings = pd.DataFrame({"ping": range(i, i + 4), "samples": [[(i + k + c) % 256 for c in range(64)] for k in range(4)]})
        (tmp_path / f"{i}.{kind}").write_bytes(build(pings))
    spark.dataSource.register(ls.SonarLog)
    load = lambda **o: spark.read.format("sonarlog").options(kind=kind, range_mb="0.001", **o).load(str(tmp_path))
    assert load().rdd.getNumPartitions() > 60 >= 12 >= load(tasks="4").rdd.getNumPartitions() >= 4
    key = lambda df: sorted((r.path, r.range_no, r.seq, r.channel, tuple(r.samples)) for r in df.collect())
    assert key(load()) == key(load(tasks="4"))
    read = lg.read_jsf if kind == "jsf" else lg.read_xtf
    assert read(spark, str(tmp_path), 0.001).count() == 30 * 4 * 2


def test_ranges_are_dealt_whole_and_in_order():
    ranges = [r for i, size in enumerate([5, 70 << 20, 9, 9, 9]) for r in ls.byte_ranges(f"f{i}", size, 32 << 20)]
    for tasks in (None, 1, 3, 100):
        dealt = ls.deal(ranges, tasks)
        assert [r for d in dealt for r in d.parts] == ranges and all(d.parts for d in dealt)
    assert [len(d.parts) for d in ls.deal(ranges, 1)] == [1, 1, 1, 4]
    assert ls.deal([], 4)[0].parts == [] and len(ls.deal([], 4)) == 1


def test_pings_are_numbered_without_reading_the_samples_again(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame([(f"f{i}", k, k % (2 + i % 2), [1.0]) for i in range(4) for k in range(12)], "path string, trace_no bigint, channel int, samples array<double>")
    got = sorted((r.path, r.trace_no, r.ping_id) for r in lg.group_traces(df.mapInPandas(count, df.schema), 4).collect())
    assert got == [(f"f{i}", k, k // (2 + i % 2)) for i in range(4) for k in range(12)]
    assert seen.value == 2 * 48
