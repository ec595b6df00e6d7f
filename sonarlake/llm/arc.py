"""Legacy ARC archives: writing, conversion to WARC, and reading WARC back.

An ARC file starts with a version block whose second line names the version; every record is one header line and as many
bytes as the line declares. Version 1 lines hold URL, IP address, date, content type, length; version 2 lines add result
code, checksum, location, offset and file name before the length. The converter parses these lines by the version,
takes exactly the declared bytes, and synthesises what WARC has and ARC has not: record ids (a name-based UUID of file and
record number, so a repeated conversion gives the same ids), ISO dates, record types, payload and block digests. Records
with equal payloads of some size become revisits of one of them.

Files are written and read inside tasks, one file at a time, record by record; payloads are never shuffled. What is
shuffled is one short row per record to decide about revisits.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarlake.plans.durable import durable

from .common import filesystem, new_folder, pick, write_file

NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space
FIELDS = {"1": ["url", "ip", "date", "type", "length"],
          "2": ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"]}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URL = "urn:none"
SALTS = 32


# ---------------------------------------------------------------- ARC

@dataclass(frozen=True)
class ArcRecord:
    number: int
    version: str
    head: dict[str, str]
    block: bytes


def arc_record(version: str, url: str, date: str, block: bytes, kind: str = "text/html", ip: str = "0.0.0.0", file: str = "-") -> bytes:
    """Header line and block, followed by the separating line end."""
    values = {"url": url, "ip": ip, "date": date, "type": kind, "status": "200", "checksum": "-", "location": "-", "offset": "0", "file": file, "length": str(len(block))}
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n" + block + b"\n"


def arc_opening(version: str, name: str, date: str) -> bytes:
    titles = {"1": "URL IP-address Archive-date Content-type Archive-length",
              "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 sonarlake\n{titles[version]}\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body + b"\n"


def read_arc(stream) -> Iterator[ArcRecord]:
    """Records after the version block. A line that does not fit the version, or a short block, is an error."""
    opening = stream.readline()
    if not opening.startswith(b"filedesc://"):
        if not opening:
            return
        raise ValueError("no ARC version block")
    block = stream.read(int(opening.split(b" ")[-1]))
    version = block.split(b" ", 1)[0].decode()
    if version not in FIELDS:
        raise ValueError(f"ARC version {version}")
    names, number = FIELDS[version], 0
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        values = line.rstrip(b"\r\n").decode("utf-8").split(" ")
        if len(values) > len(names):  # some crawlers left blanks in content types
            over = len(values) - len(names)
            values = [*values[:3], " ".join(values[3:4 + over]), *values[4 + over:]]
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"header line {number} does not fit ARC version {version}")
        head = dict(zip(names, values))
        body = stream.read(int(head["length"]))
        if len(body) != int(head["length"]):
            raise ValueError(f"record {number} is cut off")
        yield ArcRecord(number, version, head, body)
        number += 1


# ---------------------------------------------------------------- WARC

def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload; a block without a head is all payload."""
    if block.startswith(b"HTTP/"):
        at = block.find(b"\r\n\r\n")
        if at >= 0:
            return block[:at + 4], block[at + 4:]
    return b"", block


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode() if m else None


def record_id(file: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{file}#{number}')}>"


def warc_date(date: str) -> str:
    d = (date + "0" * 14)[:14] if date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def digest32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def convert_record(r: ArcRecord, file: str, original: tuple[str, int] | None) -> bytes:
    """The WARC record of an ARC record; with ``original`` (file, number) it is a revisit that keeps the HTTP head only."""
    head, payload = split_http(r.block)
    http = bool(head)
    kind = "revisit" if original else "response" if http else "resource"
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id(file, r.number), "WARC-Date": warc_date(r.head["date"]),
              "WARC-Target-URI": r.head["url"], "WARC-IP-Address": r.head["ip"], "WARC-Payload-Digest": digest32(payload)}
    block = r.block
    if original:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(*original)}
        block = head
    fields |= {"WARC-Block-Digest": digest32(block), "Content-Type": "application/http; msgtype=response" if http else r.head["type"]}
    return warc_record(fields, block)


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record is cut off")
        yield fields, block


# ---------------------------------------------------------------- Spark

def _gz(parts: Iterator[bytes]) -> Iterator[bytes]:
    """One gzip member per record."""
    for p in parts:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        yield z.compress(p) + z.flush()


def write_arc(pages: DataFrame, folder: str, file_bytes: int = 64 << 20, key: str = "page_id", url: str = "url", body: str = "html",
              date: str = "20200101000000") -> DataFrame:
    """Rows as gzipped ARC files of about ``file_bytes`` (versions 1 and 2 in turn by file); returns the files' names.

    A null body is an empty payload, a null URL is ``urn:none``; other characters than a URL may hold are percent-encoded.
    The key travels as an HTTP field. Only one task's current file is being written at a time.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, names = TaskContext.get().partitionId(), []
        rows = ((k, u, h) for b in batches for k, u, h in zip(b["key"].astype("Int64"), b["url"].tolist(), b["body"].tolist()))
        ahead = next(rows, None)
        while ahead is not None:
            n = len(names)
            version, name = "12"[(part + n) % 2], f"pages-{part:05d}-{n:04d}.arc.gz"

            def records():
                nonlocal ahead
                yield arc_opening(version, name, date)
                size = 0
                while ahead is not None and size < file_bytes:
                    k, u, h = ahead
                    payload = h.encode("utf-8", "surrogatepass") if isinstance(h, str) else b""
                    mark = "" if k is pd.NA else f"X-Page-Id: {int(k)}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{mark}\r\n".encode()
                    size += len(head) + len(payload)
                    place = quote(u, safe=":/?#[]@!$&'()*+,;=%~") if isinstance(u, str) and u else NO_URL
                    yield arc_record(version, place, date, head + payload, file=name)
                    ahead = next(rows, None)

            write_file(folder, name, _gz(records()))
            names.append(name)
        yield pd.DataFrame({"file": names}, dtype=object)

    return durable(pick(pages, key=key, url=url, body=body).mapInPandas(run, "file string"), "arc-files")


def _each_file(files: DataFrame) -> DataFrame:
    n = max(1, files.count())
    return files.select("file").repartition(min(n, 4096))


def scan_arc(folder: str, files: DataFrame) -> DataFrame:
    """One short row per ARC record: file, number, key (or null), payload_bytes, digest."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = filesystem(folder)
        for batch in batches:
            for name in batch["file"]:
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for r in read_arc(stream):
                        head, payload = split_http(r.block)
                        mark = http_field(head, "X-Page-Id")
                        rows.append((name, r.number, int(mark) if mark else None, len(payload), hashlib.sha1(payload).hexdigest()))
                yield pd.DataFrame(rows, columns=["file", "number", "key", "payload_bytes", "digest"], dtype=object)

    return _each_file(files).mapInPandas(run, "file string, number long, key long, payload_bytes long, digest string")


def _attach(many: DataFrame, few: DataFrame, on: str, salt: Column) -> DataFrame:
    """Left join on a key that may hold a third of ``many``: its rows are spread over SALTS copies of the other side."""
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(spread, [on, "_salt"], "left").drop("_salt")


def choose_originals(records: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Records with the file and number of the record they revisit; null for those that stay whole.

    Of records with one digest and at least ``least_bytes`` the one of largest key stays (then file, number; a null key
    is the smallest).
    """
    top = (records.filter(F.col("payload_bytes") >= least_bytes).groupBy("digest")
           .agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("key", "file", "number")).alias("_top"))
           .filter("_n > 1").select("digest", F.col("_top.file").alias("of_file"), F.col("_top.number").alias("of_number")))
    joined = _attach(records, top, "digest", F.xxhash64("file", "number"))
    itself = (F.col("of_file") == F.col("file")) & (F.col("of_number") == F.col("number"))
    again = F.col("of_file").isNotNull() & ~itself & (F.col("payload_bytes") >= least_bytes)
    return joined.select("file", "number", F.when(again, F.col("of_file")).alias("of_file"), F.when(again, F.col("of_number")).alias("of_number"))


def convert(arc_folder: str, files: DataFrame, warc_folder: str, least_bytes: int = 1000) -> DataFrame:
    """Convert ARC files to WARC files of the same number; returns the WARC files' names."""
    plan = durable(choose_originals(scan_arc(arc_folder, files), least_bytes).filter("of_file IS NOT NULL"), "revisits")
    listed = files.select("file", F.lit(-1).cast("long").alias("number"), F.lit(None).cast("string").alias("of_file"), F.lit(None).cast("long").alias("of_number"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by (file, number): the file itself first, then its revisits, which are read along with its records."""
        fs, path = filesystem(arc_folder)
        rows = (r for b in batches for r in zip(b["file"].tolist(), b["number"].tolist(), b["of_file"].tolist(), b["of_number"].tolist()))
        ahead, done = next(rows, None), []
        while ahead is not None:
            name = ahead[0]
            ahead = next(rows, None)

            def records():
                nonlocal ahead
                info = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(name, -1), "WARC-Date": warc_date(""), "WARC-Filename": target, "Content-Type": "application/warc-fields"}
                yield warc_record(info, f"software: sonarlake\r\nisPartOf: {name}\r\n".encode())
                with fs.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for r in read_arc(stream):
                        original = None
                        if ahead is not None and ahead[0] == name and ahead[1] == r.number:
                            original = (ahead[2], int(ahead[3]))
                            ahead = next(rows, None)
                        yield convert_record(r, name, original)

            target = name.replace(".arc.gz", ".warc.gz")
            write_file(warc_folder, target, _gz(records()))
            done.append(target)
        yield pd.DataFrame({"file": done}, dtype=object)

    n = max(1, files.count())
    placed = listed.union(plan).repartition(min(n, 4096), "file").sortWithinPartitions("file", "number")
    return durable(placed.mapInPandas(run, "file string"), "warc-files")


def scan_warc(folder: str, files: DataFrame) -> DataFrame:
    """One row per captured record: page_id, url, payload_bytes, payload_digest (hex), record_type, record_id, refers_to_id.

    A whole record's length and digest come from its payload, and the digest must be the one declared; a revisit's come
    from its fields.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = filesystem(folder)
        for batch in batches:
            for name in batch["file"]:
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for f, block in read_warc(stream):
                        if f["warc-type"] == "warcinfo":
                            continue
                        head, payload = split_http(block)
                        mark, declared = http_field(head, "X-Page-Id"), base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if f["warc-type"] == "revisit":
                            size = int(http_field(head, "Content-Length") or 0)
                        else:
                            size = len(payload)
                            if hashlib.sha1(payload).hexdigest() != declared:
                                raise ValueError(f"digest of {f['warc-record-id']} in {name}")
                        url = None if f["warc-target-uri"] == NO_URL else unquote(f["warc-target-uri"])
                        rows.append((int(mark) if mark else None, url, size, declared, f["warc-type"], f["warc-record-id"], f.get("warc-refers-to")))
                yield pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id"], dtype=object)

    return _each_file(files).mapInPandas(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string")


def convert_pages(pages: DataFrame, least_bytes: int = 1000, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Pages as a legacy archive, converted to WARC and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null bodies are empty payloads; null keys stay null; repeated rows are records of their own (of equal keys the later
    record in file order is the response); an empty table gives no rows.
    """
    spark = pages.sparkSession
    arcs, warcs = new_folder(spark, "arc"), new_folder(spark, "warc")
    arc_files = write_arc(pages, arcs, key=key, url=url, body=body)
    back = durable(scan_warc(warcs, convert(arcs, arc_files, warcs, least_bytes)), "records")
    wanted = back.filter("refers_to_id IS NOT NULL").groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("_n")).select("refers_to_id")
    originals = back.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).join(wanted, "refers_to_id", "left_semi")
    return _attach(back, originals, "refers_to_id", F.xxhash64("record_id")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
