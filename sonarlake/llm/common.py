"""Small helpers the text operators share: column picking, bounded caches, and files in the session's shared folder."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarlake.plans.durable import shared_dir

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = " \t\n\x0b\x0c\r"
BLANK_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so extra or clashing columns of the input never matter."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body``; a plain reference would be evaluated again inside every lambda."""
    return F.transform(F.array(value), body)[0]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which the driver and all executors reach."""
    return f"{shared_dir(spark)}/sonarlake/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """The Arrow file system of a folder URI and the folder's path in it."""
    from pyarrow import fs

    if not urlsplit(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, name: str, parts) -> int:
    """Write byte strings as one file, complete or not at all: a retried task replaces what an earlier attempt left."""
    files, folder = filesystem(uri)
    files.create_dir(folder, recursive=True)
    draft, size = f"{folder}/.{name}.{uuid.uuid4().hex}", 0
    with files.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    files.move(draft, f"{folder}/{name}")
    return size


class Generations:
    """A bounded dictionary in two generations: when the young one is full the old one is dropped."""

    def __init__(self, make, size: int):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def values(self, keys: list) -> list:
        """The values of ``keys`` in order; ``make`` turns the list of unknown keys into their values."""
        young = self.young
        out = list(map(young.get, keys))
        if None in out:
            gaps = [i for i, v in enumerate(out) if v is None]
            fresh = dict.fromkeys(keys[i] for i in gaps)
            if self.old:
                for k in fresh:
                    if (v := self.old.get(k)) is not None:
                        young[k] = v
                fresh = [k for k in fresh if k not in young]
            else:
                fresh = list(fresh)
            if fresh:
                young.update(zip(fresh, self.make(fresh)))
            for i in gaps:
                out[i] = young[keys[i]]
            if len(young) > self.size:
                self.old, self.young = young, {}
        return out
