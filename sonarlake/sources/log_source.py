"""XTF and JSF logs as a Spark data source that reads byte ranges, in batch and as a stream.

A file is cut into ranges of ``range_mb``. A range's task takes the records whose header lies in the range; a record that
runs past the end is read to its end. Where the first record of a range starts is known only from the records before it,
so a task enters at the first place where two headers follow each other. An index pass (``mode`` index) gives per range where it
entered, where it left and how many pings or traces it holds, from headers alone. ``read_ranges`` puts these together per
file: a range counts as it was read if the range before left exactly at its entry; else it is walked again from there. So the
rows and their numbers are those of a walk from the start of the file, and one large file keeps many tasks busy. A task takes
one range, or with option ``tasks`` as many neighbouring ones as fill a task: a folder of small files must not cost a task each.

As a stream the source offers the files of a folder as they appear, in order of their paths.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sonarlake.plans.durable import durable

from . import logs

RANGE_MB = 32.0
#: What opening a file is worth in bytes read, where ranges are dealt to tasks.
OPEN_BYTES = 1 << 16
INDEX_SCHEMA = "path string, range_no bigint, start bigint, stop bigint, size bigint, entry bigint, leave bigint, n bigint"
PLACE = "path string, range_no bigint, seq bigint, channel int, "
SCHEMAS = {"xtf": PLACE + logs.XTF_SCHEMA.split("channel int, ")[1], "jsf": PLACE + logs.JSF_SCHEMA.split("channel int, ")[1]}
#: A walk that met a record which runs past the end of its file: nothing after it counts.
ENDED = -1


def file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlsplit(path).path
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Bytes:
    """Random access to one file through a window of ``step`` bytes."""

    def __init__(self, path: str, step: int):
        files, inner = file_system(path)
        self.file, self.step = files.open_input_file(inner), step
        self.size = self.file.size()
        self.at, self.data = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from ``at``; fewer at the end of the file."""
        if at < self.at or at + n > self.at + len(self.data):
            self.file.seek(min(at, self.size))
            self.at, self.data = at, self.file.read(min(max(n, self.step), max(0, self.size - at)))
        return self.data[at - self.at:at - self.at + n]

    def find(self, mark: bytes, at: int, stop: int) -> int:
        """First place of ``mark`` in [at, stop) or -1."""
        while at + len(mark) <= stop:
            block = self.get(at, min(1 << 16, stop - at))
            hit = block.find(mark)
            if hit >= 0:
                return at + hit
            at += max(1, len(block) - len(mark) + 1)
        return -1

    def __enter__(self) -> Bytes:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


class Xtf:
    first, head, mark = logs.XTF_FILE_HEADER, 14, b"\xce\xfa"

    def __init__(self, src: Bytes):
        self.src = src
        head = src.get(0, logs.XTF_FILE_HEADER)
        self.channels = max(1, min(6, int.from_bytes(head[106:108], "little"))) if len(head) == logs.XTF_FILE_HEADER else 0

    def length(self, at: int) -> int | None:
        """Whole length of the record at ``at``, 0 for one that ends the file, None where no header is."""
        head = self.src.get(at, self.head)
        if head[:2] != self.mark:
            return None
        n = int.from_bytes(head[10:14], "little")
        return n if n >= 14 and at + n <= self.src.size else 0

    def skip(self, at: int) -> int:
        ahead = self.src.find(self.mark, at + 1, self.src.size)
        return ahead if ahead >= 0 else self.src.size

    def counts(self, at: int, n: int) -> bool:
        """Whether a record is a ping with both sides, from its headers (as ``logs._xtf_ping`` decides on all its bytes)."""
        at, end = at + 14, at + n
        if self.src.get(at - 12, 1) != bytes([logs.XTF_SONAR]) or min(logs.XTF_PING_HEADER, end - at) < 100:
            return False
        at += min(logs.XTF_PING_HEADER, end - at)
        sides = set()
        for i in range(self.channels):
            if at + logs.XTF_CHANNEL_HEADER > end:
                break
            head = self.src.get(at, 38)
            count = int.from_bytes(head[34:38], "little")
            at += logs.XTF_CHANNEL_HEADER
            if count == 0 or count > 65536:
                count = min(1024, end - at)
            count = max(0, min(count, end - at))
            if not count:
                break
            at += count
            sides.add(0 if head[:2] == b"\0\0" or i == 0 else 1)
        return len(sides) == 2

    def rows(self, at: int, n: int) -> Iterator[dict]:
        meta, sides = logs._xtf_ping(self.src.get(at, n), 14, n, self.channels)
        for channel, samples in sorted(sides.items()):
            yield {"channel": channel, **meta, "samples": samples.astype(np.int32)}


class Jsf:
    first, head, mark = 0, 16, b"\x01\x16"
    channels = 1

    def __init__(self, src: Bytes):
        self.src = src

    def length(self, at: int) -> int | None:
        head = self.src.get(at, self.head)
        if head[:2] != self.mark:
            return None
        n = 16 + int.from_bytes(head[12:16], "little")
        return n if at + n <= self.src.size else None

    def skip(self, at: int) -> int:
        ahead = self.src.find(self.mark, at + 1, min(self.src.size, at + 1 + 65536))
        return ahead if ahead >= 0 else at + 65536

    def counts(self, at: int, n: int) -> bool:
        head = self.src.get(at, self.head)
        return int.from_bytes(head[4:6], "little") == logs.JSF_SIDESCAN and n - 16 > logs.JSF_TRACE_HEADER

    def rows(self, at: int, n: int) -> Iterator[dict]:
        data = self.src.get(at, n)
        yield {"channel": data[8], **logs._jsf_trace(data, 16, n - 16)}


KINDS = {"xtf": Xtf, "jsf": Jsf}


def walk(log: Xtf | Jsf, at: int, stop: int) -> Iterator[tuple[int, int]]:
    """(place, length) of the records whose headers lie before ``stop``, in order from ``at``; then (place it left at, 0)."""
    while at < stop and at + log.head <= log.src.size:
        n = log.length(at)
        if n is None:
            at = log.skip(at)
        elif n == 0:
            at = ENDED
            break
        else:
            yield at, n
            at += n
    yield at, 0


def enter(log: Xtf | Jsf, start: int, stop: int) -> int | None:
    """First place in [start, stop) where a whole record is followed by another header or by the end of the file."""
    at = start
    while at < stop:
        at = log.src.find(log.mark, at, min(log.src.size, stop + 1))
        if at < 0 or at >= stop:
            return None
        n = log.length(at)
        if n and (at + n == log.src.size or log.length(at + n) is not None):
            return at
        at += 1
    return None


@dataclass
class ByteRange(InputPartition):
    path: str
    range_no: int
    start: int
    stop: int
    size: int


def byte_ranges(path: str, size: int, step: int) -> list[ByteRange]:
    return [ByteRange(path, k, s, min(size, s + step), size) for k, s in enumerate(range(0, size, step))]


@dataclass
class Ranges(InputPartition):
    """Neighbouring ranges that one task reads."""

    parts: list[ByteRange]


def deal(ranges: list[ByteRange], tasks: int | None) -> list[Ranges]:
    """One range per task, or runs of them up to an even share of ``tasks``, at most ``RANGE_MB`` of bytes each; a larger range stays whole."""
    if not tasks:
        return [Ranges([r]) for r in ranges] or [Ranges([])]
    cost = [r.stop - r.start + OPEN_BYTES for r in ranges]
    share, out, filled = min(RANGE_MB * (1 << 20), sum(cost) / tasks), [Ranges([])], 0
    for r, c in zip(ranges, cost):
        if filled and filled + c > share:
            out.append(Ranges([]))
            filled = 0
        out[-1].parts.append(r)
        filled += c
    return out


def list_logs(path: str, suffix: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    files, inner = file_system(path)
    info = files.get_file_info(inner)
    found = [info] if info.is_file else files.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and f.path.endswith(f".{suffix}"))


def decode_range(kind: str, schema: pa.Schema, part: ByteRange, entry: int | None = None) -> Iterator[pa.RecordBatch]:
    """Trace rows of one range, entered at ``entry`` or where the range itself finds a record; ``seq`` counts pings (traces) from 0."""
    with Bytes(part.path, 1 << 20) as src:
        log = KINDS[kind](src)
        at = entry if entry is not None else (log.first if part.start <= log.first < part.stop else enter(log, part.start, part.stop))
        if at is None or not log.channels:
            return
        seq, held = 0, []
        for place, n in walk(log, at, part.stop):
            if n and log.counts(place, n):
                held += [{"path": part.path, "range_no": part.range_no, "seq": seq, **row} for row in log.rows(place, n)]
                seq += 1
                if len(held) >= logs.BATCH:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(held, columns=schema.names), schema=schema, preserve_index=False)
                    held = []
        if held:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(held, columns=schema.names), schema=schema, preserve_index=False)


def index_range(kind: str, part: ByteRange, entry: int | None = None) -> tuple[int | None, int | None, int]:
    """Where a range was entered and left, and its number of pings (traces), from headers alone."""
    with Bytes(part.path, 4096) as src:
        log = KINDS[kind](src)
        at = entry if entry is not None else (log.first if part.start <= log.first < part.stop else enter(log, part.start, part.stop))
        if at is None or not log.channels:
            return None, None, 0
        first, count, left = at, 0, at
        for place, n in walk(log, at, part.stop):
            count += bool(n) and log.counts(place, n)
            left = place
        return first, left, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.kind, self.path, self.index = options.get("kind", "xtf"), options["path"], options.get("mode", "rows") == "index"
        self.step = max(1, int(float(options.get("range_mb", RANGE_MB)) * (1 << 20)))
        self.tasks = int(options.get("tasks", 0))
        self.schema = to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        return self.dealt(list_logs(self.path, self.kind))

    def dealt(self, files: list[tuple[str, int]]) -> list[Ranges]:
        return deal([r for path, size in files for r in byte_ranges(path, size, self.step)], self.tasks)

    def read(self, partition: Ranges):
        for part in partition.parts:
            if self.index:
                entry, leave, n = index_range(self.kind, part)
                yield (part.path, part.range_no, part.start, part.stop, part.size, entry, leave, n)
            else:
                yield from decode_range(self.kind, self.schema, part)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the largest path seen; files must appear under growing names, as dated logs do."""

    def __init__(self, options: dict, schema: StructType):
        self.batch = _Reader(options, schema)

    def initialOffset(self) -> dict:
        return {"upto": ""}

    def latestOffset(self) -> dict:
        return {"upto": max((p for p, _ in list_logs(self.batch.path, self.batch.kind)), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        start, end = (json.loads(x) if isinstance(x, str) else x for x in (start, end))
        new = [(p, s) for p, s in list_logs(self.batch.path, self.batch.kind) if start["upto"] < p <= end["upto"]]
        return self.batch.dealt(new)

    def read(self, partition: Ranges):
        yield from self.batch.read(partition)


class SonarLog(DataSource):
    """``spark.read.format("sonarlog").option("kind", "xtf" | "jsf").load(folder)``; options ``range_mb``, ``tasks`` and ``mode`` (rows, index)."""

    @classmethod
    def name(cls) -> str:
        return "sonarlog"

    def schema(self) -> str:
        return INDEX_SCHEMA if self.options.get("mode") == "index" else SCHEMAS[self.options.get("kind", "xtf")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options), schema)


def _stitch(kind: str):
    """Go along the ranges of one file: keep a range whose entry is where the walk stands, walk others again from there."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, at, number = [], KINDS[kind].first, 0
        for r in pdf.sort_values("range_no").itertuples(index=False):
            if at == ENDED or at >= r.stop:
                out.append((r.path, r.range_no, r.start, r.stop, r.size, None, number, False))
                continue
            same = not pd.isna(r.entry) and int(r.entry) == at
            part = ByteRange(r.path, int(r.range_no), int(r.start), int(r.stop), int(r.size))
            entry, leave, n = (at, int(r.leave), int(r.n)) if same else index_range(kind, part, at)
            out.append((r.path, r.range_no, r.start, r.stop, r.size, entry, number, same))
            at, number = (ENDED if leave is None else leave), number + n
        return pd.DataFrame(out, columns=["path", "range_no", "start", "stop", "size", "entry", "before", "same"]).astype({"entry": "Int64"})

    return run


def read_ranges(spark: SparkSession, path: str, kind: str, number: str, range_mb: float = RANGE_MB) -> DataFrame:
    """Trace rows of all logs below ``path`` with ``number`` counting from 0 through each file."""
    spark.dataSource.register(SonarLog)
    source = lambda: spark.read.format("sonarlog").options(kind=kind, range_mb=str(range_mb), tasks=str(spark.sparkContext.defaultParallelism))
    # a fixed number of partitions: stitching is compute-bound, so short index rows must not be folded into one task
    index = source().option("mode", "index").load(path).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    plan = durable(index.groupBy("path").applyInPandas(
        _stitch(kind), "path string, range_no bigint, start bigint, stop bigint, size bigint, entry bigint, before bigint, same boolean"), "log-ranges")
    rows = source().load(path).join(plan.filter("same").select("path", "range_no", "before"), ["path", "range_no"])
    again = plan.filter("not same and entry is not null")
    if not again.isEmpty():
        schema = to_arrow_schema(rows.drop("before").select(*[c.split()[0] for c in SCHEMAS[kind].split(", ")]).schema)
        shape = pa.schema([*schema, ("before", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    part = ByteRange(r["path"], r["range_no"], r["start"], r["stop"], r["size"])
                    for b in decode_range(kind, schema, part, r["entry"]):
                        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r["before"]] * b.num_rows, pa.int64())], schema=shape)

        rows = rows.unionByName(again.repartition("path", "range_no").mapInArrow(run, SCHEMAS[kind] + ", before bigint"))
    return rows.withColumn(number, F.col("before") + F.col("seq")).drop("before", "seq", "range_no")
