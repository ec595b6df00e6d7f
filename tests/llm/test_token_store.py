import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sonarlake.llm import token_store as ts
from sonarlake.llm.tokens import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_perfect_hash_is_minimal_and_survives_bytes():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 5000):
        keys = np.unique(rnd.integers(0, 2**63, n).astype("uint64"))
        made = ts.PerfectHash.build(keys)
        assert sorted(made.slots(keys)) == list(range(len(keys)))
        again, used = ts.PerfectHash.from_bytes(made.to_bytes() + b"tail")
        assert used == len(made.to_bytes()) and (again.slots(keys) == made.slots(keys)).all()
    with pytest.raises(ValueError):
        ts.PerfectHash.build(np.array([7, 7], "uint64"))


def test_store_round_trip_and_strangers(spark):
    rows = [(5, "five words are in here"), (1, "one"), (None, "no key"), (None, None), (9, ""), (9, "nine"), (9, "nine"), (-4, "below"), (2, "x " * 5000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, shard int, copy int")
    store = ts.write_store(docs, PATH, end_id=2, shards=3)
    library = Tokenizer.from_file(PATH)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start, seen = [], 0, {}
    for key, text in order:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        copy = seen[key] = seen.get(key, -1) + 1
        want.append((key, copy, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
        assert (ts.read_one(ts.open_store(store.folder), key, copy) == ids).all()
    got = [tuple(r) for r in ts.read_documents(store, store.directory, zlib.crc32).orderBy("start").collect()]
    assert got == want
    assert ts.read_one(store, 12345) is None
    strangers = spark.range(1000, 3000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("copy"))
    assert ts.locate(store, strangers).count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ts.store_and_check(docs, PATH).count() == 0


def test_added_tokens_in_texts_equal_the_untouched_library(spark):
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b c", "<|endoftext", "a b <|endoftext|><|endoftext|> c  d", "plain words here"]
    library, encode = Tokenizer.from_file(PATH), PieceEncoder(PATH)
    want = [np.array(library.encode(x, add_special_tokens=False).ids, "<u4") for x in texts]
    assert want[0].tolist() == [87, 220, 50256, 331]
    assert [encode.ids(x) for x in texts] == [x.tobytes() for x in want]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in ts.store_and_check(docs, PATH, end_id=2).collect()}
    start = 0
    for key, ids in enumerate(want):
        raw = np.append(ids, 2).astype("<u4")
        assert got[key] == (start, len(raw), zlib.crc32(raw.tobytes()))
        start += len(raw)
