import random

import numpy as np
import pytest

from sonarlake.llm import jaccard_join
from sonarlake.llm.jaccard_join import JaccardRule, band_of, fold, jaccard_classes, shingle_set, signatures, sketch

RULE = JaccardRule()


def linked(a, b):
    both = len(np.intersect1d(a, b))
    return len(a) and len(b) and 100 * both >= 75 * (len(a) + len(b) - both)


def classes(docs):
    sets = [shingle_set(t, 5) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), key), key)
    return sorted((key, len(sets[i]), low[find(i)]) for i, (key, _) in enumerate(docs))


def near(rnd, words, edits):
    out = list(words)
    for _ in range(edits):
        k = rnd.randrange(len(out))
        action = rnd.random()
        if action < 0.5:
            out[k] = f"n{rnd.randrange(10**6)}"
        elif action < 0.75 and len(out) > 1:
            del out[k]
        else:
            out.insert(k, f"n{rnd.randrange(10**6)}")
    return out


def test_linked_sets_share_a_signature():
    rnd = random.Random(1)
    shared = 0
    for _ in range(4000):
        n = rnd.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 16, 17, 30, 33, 60, 64, 65, 100, 250])
        base = np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64))
        other = base
        for _ in range(rnd.randint(0, 1 + n // 3)):
            other = np.delete(other, rnd.randrange(len(other))) if rnd.random() < 0.5 and len(other) > 1 else np.unique(np.append(other, np.uint64(rnd.getrandbits(64))))
        if linked(base, other):
            shared += 1
            assert len(np.intersect1d(signatures(base, RULE), signatures(other, RULE)))
            k = min(len(sketch(base)), len(sketch(other))) // 8
            x, y = (fold(np.frombuffer(sketch(s), "<u8")[None, :], k) for s in (base, other))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(base, other)) <= RULE.difference(len(base) + len(other))
    assert shared > 1000


def test_crowded_segments_still_meet():
    """Tokens that fall into one segment make one-deletion neighbourhoods and single tokens necessary."""
    rnd = random.Random(2)
    for _ in range(500):
        n = rnd.randint(1, 40)
        base = np.unique(np.array([rnd.getrandbits(30) for _ in range(n)], np.uint64))
        other = base.copy()
        for _ in range(rnd.randint(0, 1 + n // 3)):
            other = np.delete(other, rnd.randrange(len(other))) if rnd.random() < 0.5 and len(other) > 1 else np.unique(np.append(other, np.uint64(rnd.getrandbits(30))))
        if linked(base, other):
            assert len(np.intersect1d(signatures(base, RULE), signatures(other, RULE)))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    passage = [rnd.choice(vocab) + str(i) for i in range(60)]
    docs, key = [], 100
    for _ in range(12):
        base = [f"{rnd.choice(vocab)}{rnd.randrange(40)}" for _ in range(rnd.choice([1, 3, 6, 9, 20, 60, 150]))]
        if rnd.random() < 0.4:
            base[len(base) // 2:len(base) // 2] = passage
        for _ in range(rnd.choice([1, 2, 12])):
            docs.append((key, " ".join(near(rnd, base, rnd.randint(0, 1 + len(base) // 12)))))
            key += 1
    hot = [f"h{i}" for i in range(90)]
    for _ in range(60):
        docs.append((key, "\n".join(near(rnd, hot, rnd.randint(0, 6)))))
        key += 1
    docs += [(7, ""), (8, None), (9, " \t"), (10, "a"), (11, "A"), (12, "a b c d"), (13, "A b C d"), (14, "a b c d e"), (15, docs[0][1].upper()), (3, docs[-1][1])]
    rnd.shuffle(docs)
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, row int, comp int").repartition(3)
    got = sorted(tuple(r) for r in jaccard_classes(df).collect())
    assert got == classes(docs)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (1, "x y z"), (1, "x y z"), (2, "x y z")], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_classes(df).collect()), key=str)
    assert got == sorted([(None, None, None), (None, None, None), (1, 1, 1), (1, 1, 1), (2, 1, 1)], key=str)
    assert jaccard_classes(df.limit(0)).count() == 0
    assert band_of(np.array([1, 2, 3, 4, 5, 8, 9])).tolist() == [0, 1, 2, 2, 3, 3, 4]


def boilerplate(rnd, count, shares, words=120):
    """Different texts that share the head of one passage; each third one is a near copy of the one before."""
    passage = [f"p{i}" for i in range(words)]
    docs, own = [], []
    for key in range(count):
        share = rnd.choice(shares)
        if key % 3 != 1:
            own = [f"o{rnd.randrange(10**9)}" for _ in range(int(words / share) - words)]
            head = near(rnd, passage, rnd.randint(0, 2))
        docs.append((key, " ".join(head + near(rnd, own, key % 2 * 2))))
    return docs


@pytest.mark.parametrize("block", [40, 2048])
def test_many_texts_with_one_passage(spark, monkeypatch, block):
    """More members than HOT and, in one case, than a block: no task holds a bucket that is larger than a block."""
    bounded = jaccard_join._cross_pairs

    def watched(rule):
        def run(batches):
            def each():
                for batch in batches:
                    assert batch["sig"].value_counts().max() <= block
                    yield batch

            yield from bounded(rule)(each())

        return run

    monkeypatch.setattr(jaccard_join, "BLOCK", block, raising=False)
    monkeypatch.setattr(jaccard_join, "_cross_pairs", watched)
    docs = boilerplate(random.Random(5), 240, [0.4, 0.6, 0.75, 0.8, 0.84, 0.88])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in jaccard_classes(df).collect())
    assert got == classes(docs)
    assert 30 < len({c for _, _, c in got}) < 200


def test_different_texts_of_one_id_are_all_compared(spark):
    rnd = random.Random(8)
    docs = []
    for key in range(15):
        bases = [[f"x{rnd.randrange(10**9)}" for _ in range(n)] for n in (40, 70)]
        docs += [(key, " ".join(b)) for b in bases] + [(100 + 2 * key + k, " ".join(near(rnd, b, 1))) for k, b in enumerate(bases)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in jaccard_classes(df).collect()) == classes(docs)


def test_pairs_of_one_document_are_spread(spark, monkeypatch):
    plain = jaccard_join._verify

    def watched(rule):
        def run(batches):
            batches = list(batches)
            own = np.concatenate([np.zeros(0, bool), *[(b["a"] == b["b"]).to_numpy() for b in batches]])
            assert np.diff(np.append(np.flatnonzero(own), len(own))).max(initial=0) < 40  # pairs on one sent text of a
            yield from plain(rule)(batches)

        return run

    monkeypatch.setattr(jaccard_join, "FAN", 8, raising=False)
    monkeypatch.setattr(jaccard_join, "_verify", watched)
    rnd = random.Random(9)
    base = [f"c{i}" for i in range(150)]
    docs = [(key, " ".join(near(rnd, base, 1 + key % 2))) for key in range(250)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in jaccard_classes(df).collect()) == classes(docs)
