import random

import numpy as np
import pyarrow as pa

from sonarlake.llm import jaccard_join
from sonarlake.llm.jaccard_join import BLOCK, JaccardRule, jaccard_classes, shingle_set, signatures, spare_buckets


def nothing(rule):
    def run(batches):
        for batch in batches:
            assert not len(batch), "a pair that meets too seldom was sent"
            yield batch[["a", "b"]] if "a" in batch else batch[["row", "row"]].set_axis(["a", "b"], axis=1)

    return run


def test_texts_with_one_short_passage_are_not_compared(spark, monkeypatch):
    """They meet in fewer buckets than a linked pair must, so neither sketches nor bucket rows are sent."""
    monkeypatch.setattr(jaccard_join, "_not_refuted", nothing)
    monkeypatch.setattr(jaccard_join, "_cross_pairs", nothing)
    rnd = random.Random(3)
    docs = [(key, " ".join([f"u{rnd.randrange(10**9)}" for _ in range(100)] + list("pqrstu") + [f"v{rnd.randrange(10**9)}" for _ in range(100)])) for key in range(60)]
    got = sorted(tuple(r) for r in jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(key, 202, key) for key in range(60)]


def test_linked_sets_meet_more_often_than_their_spares():
    rule, rnd, seen = JaccardRule(), random.Random(4), 0
    for _ in range(1500):
        n = rnd.choice([3, 8, 20, 33, 60, 64, 65, 120, 250, 400])
        base = np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64))
        other = rnd.sample(base.tolist(), n - rnd.randint(0, n // 6)) + [rnd.getrandbits(64) for _ in range(rnd.randint(0, n // 6))]
        other = np.unique(np.array(other, np.uint64))
        both = len(np.intersect1d(base, other))
        if 100 * both >= 75 * (len(base) + len(other) - both):
            seen += 1
            assert len(np.intersect1d(signatures(base, rule), signatures(other, rule))) > min(spare_buckets(base, rule), spare_buckets(other, rule))
    assert seen > 700


def test_buckets_of_one_two_many_and_very_many():
    rnd = random.Random(5)
    want = {1: [4], 2: [9, 5], 3: list(range(40)), 7: list(range(100, 100 + 2 * BLOCK)), 8: [3, 1, 2], 9: [6, 5]}
    pairs = [(sig, row) for sig, rows in want.items() for row in rnd.sample(rows, len(rows))]
    for step in (1000, 7, 10**6):
        batches = [pa.RecordBatch.from_pydict({"sig": pa.array([p[0] for p in pairs[i:i + step]], pa.int64()), "row": pa.array([p[1] for p in pairs[i:i + step]], pa.int64())})
                   for i in range(0, len(pairs), step)]
        out = [r for b in jaccard_join._buckets(iter(batches)) for r in b.to_pylist()]
        assert [(r["pivot"], r["row"]) for r in out if r["sig"] < 0] == [(5, 9), (5, 6)]
        got = {r["sig"]: r["members"] for r in out if r["members"]}
        streamed = [r for r in out if r["sig"] == 7 and not r["members"]]
        if streamed:
            assert len({r["pivot"] for r in streamed}) == 1 and streamed[0]["pivot"] in {r["row"] for r in streamed}
            got[7] = sorted(r["row"] for r in streamed)
        assert got == {sig: sorted(rows) for sig, rows in want.items() if len(rows) > 2}


def test_words_are_told_apart_however_they_are_cut():
    words = [f"w{i}" for i in range(3000)] + ["ab", "ba", "aab", "aba", "a" * 50, "a" * 51, "é", "\ud800"]
    assert len(shingle_set(" ".join(words), 1)) == len(words)
    assert (shingle_set("\x0bAB\tba\x0c \r\n" + "x" * (1 << 21) + " ab", 1) == np.sort(shingle_set("x" * (1 << 21) + " ba ab", 1))).all()
    assert len(shingle_set(None, 5)) == len(shingle_set(" \n", 5)) == 0
