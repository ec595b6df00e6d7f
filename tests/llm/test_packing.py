import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sonarlake.llm.packing import CapacityTree, pack, pack_documents
from sonarlake.llm.tokens import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_tree_finds_the_tightest_window():
    rnd, tree, plain = random.Random(1), CapacityTree(37), []
    for step in range(3000):
        if rnd.random() < 0.5:
            c = rnd.randint(1, 37)
            tree.put(c, step)
            plain.append(c)
        else:
            need = rnd.randint(1, 37)
            fits = [c for c in plain if c >= need]
            got = tree.take(need)
            assert (got is None) == (not fits)
            if got:
                assert got[0] == min(fits)
                plain.remove(got[0])


def test_pack_covers_every_token_once_and_fills_windows():
    rnd = random.Random(2)
    for window in (8, 16, 100):
        lengths = [rnd.randint(1, 3 * window) for _ in range(rnd.randint(0, 200))]
        pieces = pack(lengths, window)
        seen = sorted((i, s, n) for i, s, n, _, _ in pieces)
        at = {i: 0 for i in range(len(lengths))}
        for i, s, n in seen:
            assert s == at[i]
            at[i] += n
        assert list(at.values()) == lengths
        fill = {}
        for _, _, n, q, o in sorted(pieces, key=lambda p: (p[3], p[4])):
            assert o == fill.get(q, 0)
            fill[q] = o + n
        assert sorted(fill) == list(range(len(fill)))
        assert sum(v < window for v in fill.values()) <= 1 and all(v <= window for v in fill.values())


def test_documents_round_trip(spark):
    texts = [(1, "Hello  world, it's\n\nfine "), (2, None), (3, ""), (4, "ab " * 900), (4, "ab " * 900), (None, "x"), (7, "<|endoftext|>"), (8, "x <|endoftext|> y"), (9, "long " * 40_000 + "tail" * 20_000)]
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t in texts], "doc_id long, text string, start long, offset string")
    rows = pack_documents(docs, PATH, window=64, end_id=0).collect()
    library = Tokenizer.from_file(PATH)
    for key, text in set(texts):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        mine = [r for r in rows if r.doc_id == key]
        assert {r.doc_tokens for r in mine} == {len(ids) // 4}
        assert sum(r.length for r in mine) == len(ids) // 4 * texts.count((key, text))
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start:4 * (r.start + r.length)])
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 64
    assert pack_documents(docs.filter(F.lit(False)), PATH).count() == 0


def test_piece_encoder_equals_the_library():
    e, rnd = PieceEncoder(PATH, cache=50), random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", " \n", "\n ", "'s", "don't", "1", "é", "ß", "!?", "　", "<|endoftext|>", "日本", "\r\n", "'", "\x1c", "\x85"]
    for _ in range(1500):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        assert e.ids(s) == np.array(e.library.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
