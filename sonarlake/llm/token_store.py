"""Token ids in flat binary shards with a minimal perfect hash index for keyed access.

Layout of a store folder:

* ``ids-00000.bin`` ...: 16 bytes of header (magic, bytes per id, shard number), then the raw ids of the shard's
  documents, one after the other, as little-endian unsigned integers of two bytes, or four if the vocabulary needs them.
  Shards follow each other in ascending document order.
* ``index-00000.mph`` ...: one per bucket of keys. Levels of bit arrays give each key of the bucket its own slot 0..n-1
  (minimal perfect hashing by cascading collisions: a key alone on its bit of a level stays there, the others go on to
  the next level; the slot is the rank of the bit). Per slot: fingerprint, shard, first id, number of ids.
* ``manifest.json``: shards with their sizes and running starts, number of buckets.

A lookup hashes the key, probes one or two bits, reads a slot and compares the fingerprint, whatever the store's size.
Keys are (doc_id, copy): rows with one doc_id are numbered 0, 1, ... in the order of their texts; a null doc_id is a key
of its own and comes first.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarlake.plans.durable import durable

from .common import filesystem, new_folder, pick, write_file
from .tokens import encoder

MAGIC, HEADER = b"SLTOKENS", 16
BUCKET_KEYS = 20_000
MAX_LEVELS = 48
DIRECTORY = "doc_id long, copy long, shard int, first long, n_tokens long"


# ---------------------------------------------------------------- hashing

def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer (add, xor-shift, multiply), vectorised."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(doc_id: pd.Series, copy: pd.Series) -> np.ndarray:
    ids = doc_id.astype("Int64")
    plain = ids.fillna(0).to_numpy("int64").view("uint64")
    nulls = ids.isna().to_numpy().astype("uint64")
    return _mix(_mix(plain, 1) ^ _mix(copy.to_numpy("int64").view("uint64") * np.uint64(2) + nulls, 2), 3)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(hashes, 9) % np.uint64(buckets)).astype("int32")


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes, 10) >> np.uint64(32)).astype("uint32")


class PerfectHash:
    """Distinct 64-bit hashes to 0..n-1 without gaps."""

    def __init__(self, levels: list[np.ndarray], n: int):
        self.levels, self.n = levels, n
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        self.ranks = np.concatenate([[0], np.cumsum(bits)]).astype("int64")
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in levels])]).astype("int64")

    @classmethod
    def build(cls, hashes: np.ndarray, gamma: float = 1.7) -> PerfectHash:
        left, levels = hashes, []
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError("two keys share a hash")
            size = max(8, int(gamma * len(left)))
            at = _mix(left, 100 + len(levels)) % np.uint64(size)
            hits = np.bincount(at.astype("int64"), minlength=size)
            levels.append(hits == 1)
            left = left[hits[at.astype("int64")] != 1]
        return cls(levels, len(hashes))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot per hash; -1 for some hashes that are not keys (the fingerprint tells the other strangers)."""
        out, open_ = np.full(len(hashes), -1, "int64"), np.arange(len(hashes))
        for k, bits in enumerate(self.levels):
            at = (_mix(hashes[open_], 100 + k) % np.uint64(len(bits))).astype("int64")
            hit = bits[at]
            out[open_[hit]] = self.ranks[self.starts[k] + at[hit]]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<II", self.n, len(self.levels)) + b"".join(struct.pack("<I", len(x)) for x in self.levels)
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[PerfectHash, int]:
        """The function and the number of bytes it took."""
        n, k = struct.unpack_from("<II", raw)
        sizes, at, levels = struct.unpack_from(f"<{k}I", raw, 8), 8 + 4 * k, []
        for size in sizes:
            used = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, "u1", used, at), count=size).astype(bool))
            at += used
        return cls(levels, n), at


SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("n", "<u4")])


def index_bytes(hashes: np.ndarray, shard: np.ndarray, first: np.ndarray, n: np.ndarray) -> bytes:
    function = PerfectHash.build(hashes)
    slots = np.zeros(len(hashes), SLOT)
    at = function.slots(hashes)
    for name, values in (("fingerprint", fingerprint(hashes)), ("shard", shard), ("first", first), ("n", n)):
        slots[name][at] = values
    return function.to_bytes() + slots.tobytes()


def index_lookup(raw: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the hashes and whether each is a key of the index."""
    function, at = PerfectHash.from_bytes(raw)
    slots = np.frombuffer(raw, SLOT, function.n, at)
    if not function.n:
        return np.zeros(len(hashes), SLOT), np.zeros(len(hashes), bool)
    place = function.slots(hashes)
    found = slots[np.maximum(place, 0)]
    return found, (place >= 0) & (found["fingerprint"] == fingerprint(hashes))


# ---------------------------------------------------------------- writing

@dataclass(frozen=True)
class TokenStore:
    """A written store: its folder and manifest. ``directory`` lists its keys while the writing session lives."""

    folder: str
    manifest: dict
    directory: DataFrame | None = None


def id_bytes(tokenizer_file: str, end_id: int) -> int:
    """Bytes that hold every id of the vocabulary and the end id."""
    return 2 if max(len(encoder(tokenizer_file).led) - 1, end_id) < 1 << 16 else 4


def _write_shards(folder: str, tokenizer_file: str, end_id: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId()
        encode, end = encoder(tokenizer_file), int(end_id).to_bytes(4, "little")
        keys, copies, firsts, sizes = [], [], [], []

        def parts():
            yield MAGIC + struct.pack("<II", width, shard)
            at, last, copy = 0, object(), 0
            for batch in batches:
                held = []
                for key, words in zip(batch["doc_id"].astype("Int64"), batch["_text"].tolist()):
                    key = None if key is pd.NA else int(key)
                    raw = (encode.ids(words) if isinstance(words, str) else b"") + end
                    copy = copy + 1 if key == last else 0
                    last = key
                    keys.append(key), copies.append(copy), firsts.append(at), sizes.append(len(raw) // 4)
                    at += len(raw) // 4
                    held.append(raw)
                yield np.frombuffer(b"".join(held), "<u4").astype(f"<u{width}").tobytes()

        write_file(folder, f"ids-{shard:05d}.bin", parts())
        if keys:
            yield pd.DataFrame({"doc_id": pd.array(keys, "Int64"), "copy": copies, "shard": np.int32(shard), "first": firsts, "n_tokens": sizes})

    return run


def _write_index(folder: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        b = int(rows["bucket"].iloc[0])
        raw = index_bytes(key_hash(rows["doc_id"], rows["copy"]), rows["shard"].to_numpy("uint32"), rows["first"].to_numpy("uint64"),
                          rows["n_tokens"].to_numpy("uint32"))
        write_file(folder, f"index-{b:05d}.mph", [raw])
        return pd.DataFrame({"bucket": [b], "keys": [len(rows)]})

    return run


def _with_bucket(keys: DataFrame, buckets: int) -> DataFrame:
    @F.pandas_udf("int")
    def bucket(doc_id: pd.Series, copy: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(key_hash(doc_id, copy), buckets))

    return keys.withColumn("bucket", bucket("doc_id", "copy"))


def write_store(docs: DataFrame, tokenizer_file: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id",
                folder: str | None = None, shards: int | None = None) -> TokenStore:
    """Encode all rows and write shards, index and manifest.

    A null or empty text is a document of the end id alone; an empty table gives a store without documents. A task that
    runs again replaces its shard as a whole. Only one row per shard and per bucket comes to the driver.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    width = id_bytes(tokenizer_file, end_id)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pick(docs, doc_id=doc_id, _text=text)
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "_text")
    directory = durable(ordered.mapInPandas(_write_shards(folder, tokenizer_file, end_id, width), DIRECTORY), "directory")
    found = directory.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).orderBy("shard").collect()
    start, listed = 0, []
    for r in found:
        listed.append({"shard": r["shard"], "documents": r["n"], "tokens": r["t"], "start": start})
        start += r["t"]
    buckets = max(1, math.ceil(sum(r["n"] for r in found) / BUCKET_KEYS))
    keyed = _with_bucket(directory, buckets)
    made = keyed.groupBy("bucket").applyInPandas(_write_index(folder), "bucket int, keys long").collect()
    manifest = {"format": 1, "id_bytes": width, "end_id": end_id, "buckets": buckets, "filled": sorted(r["bucket"] for r in made), "shards": listed}
    write_file(folder, "manifest.json", [json.dumps(manifest).encode()])
    return TokenStore(folder, manifest, directory)


def open_store(folder: str) -> TokenStore:
    files, path = filesystem(folder)
    with files.open_input_stream(f"{path}/manifest.json") as f:
        return TokenStore(folder, json.loads(f.read()))


# ---------------------------------------------------------------- reading

def locate(store: TokenStore, keys: DataFrame) -> DataFrame:
    """(doc_id, copy) to shard, first, n_tokens by the index files alone; keys the store does not hold are left out."""
    folder, buckets = store.folder, store.manifest["buckets"]
    filled = set(store.manifest["filled"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = filesystem(folder)
        now, raw = -1, b""
        for batch in batches:
            hashes, places = key_hash(batch["doc_id"], batch["copy"]), batch["bucket"].to_numpy()
            for b in np.unique(places):
                if b not in filled:
                    continue
                if b != now:
                    with files.open_input_stream(f"{path}/index-{b:05d}.mph") as f:
                        now, raw = b, f.read()
                mine = np.flatnonzero(places == b)
                slots, known = index_lookup(raw, hashes[mine])
                part = batch.iloc[mine[known]]
                slots = slots[known]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "copy": part["copy"], "shard": slots["shard"].astype("int32"),
                                    "first": slots["first"].astype("int64"), "n_tokens": slots["n"].astype("int64")})

    grouped = _with_bucket(keys.select("doc_id", "copy"), buckets).repartition("bucket").sortWithinPartitions("bucket")
    return grouped.mapInPandas(run, DIRECTORY)


def read_documents(store: TokenStore, keys: DataFrame, body) -> DataFrame:
    """One row per located key: doc_id, copy, start, n_tokens and ``body(ids)`` as a long, ids being an array of unsigned 32-bit integers.

    Places are read in file order, so a full read is one pass over each shard.
    """
    folder = store.folder
    width = store.manifest["id_bytes"]
    starts = {s["shard"]: s["start"] for s in store.manifest["shards"]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = filesystem(folder)
        now, stream, at = -1, None, 0
        for batch in batches:
            out = []
            for shard, first, n in zip(batch["shard"].tolist(), batch["first"].tolist(), batch["n_tokens"].tolist()):
                if shard != now or HEADER + width * first < at:
                    if stream is not None:
                        stream.close()
                    now, at = shard, HEADER
                    stream = files.open_input_stream(f"{path}/ids-{shard:05d}.bin", buffer_size=1 << 20)
                    if stream.read(HEADER) != MAGIC + struct.pack("<II", width, shard):
                        raise ValueError(f"shard {shard} has a foreign header")
                if (gap := HEADER + width * first - at) > 0:
                    stream.read(gap)
                raw = stream.read(width * n)
                at = HEADER + width * (first + n)
                out.append((starts[shard] + first, body(np.frombuffer(raw, f"<u{width}").astype("<u4"))))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "copy": batch["copy"], "start": [x[0] for x in out],
                                "n_tokens": batch["n_tokens"], "value": [x[1] for x in out]})

    placed = locate(store, keys).repartition("shard").sortWithinPartitions("shard", "first")
    return placed.mapInPandas(run, "doc_id long, copy long, start long, n_tokens long, value long")


def store_and_check(docs: DataFrame, tokenizer_file: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write a store and read every document back by its key: doc_id, start, n_tokens, ids_crc32."""
    store = write_store(docs, tokenizer_file, end_id, text, doc_id)
    back = read_documents(store, store.directory, zlib.crc32)
    return back.select("doc_id", "start", "n_tokens", F.col("value").alias("ids_crc32"))


def read_one(store: TokenStore, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
    """Ids of one document with two small reads; None if the store does not hold the key."""
    files, path = filesystem(store.folder)
    h = key_hash(pd.Series([doc_id], dtype="Int64"), pd.Series([copy]))
    b = int(bucket_of(h, store.manifest["buckets"])[0])
    if b not in store.manifest["filled"]:
        return None
    with files.open_input_stream(f"{path}/index-{b:05d}.mph") as f:
        slots, known = index_lookup(f.read(), h)
    if not known[0]:
        return None
    with files.open_input_file(f"{path}/ids-{slots['shard'][0]:05d}.bin") as f:
        width = store.manifest["id_bytes"]
        f.seek(HEADER + width * int(slots["first"][0]))
        return np.frombuffer(f.read(width * int(slots["n"][0])), f"<u{width}").astype("<u4")
