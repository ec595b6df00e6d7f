import hashlib
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sonarlake.llm.common import table
from sonarlake.llm.weighted_sampling import SamplingRule, bid, compare_with_next, fingerprints, likeness


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def jaccard(a, b):
    a, b = Counter(words(a)), Counter(words(b))
    most = sum(max(a[w], b[w]) for w in a | b)
    return sum(min(a[w], b[w]) for w in a & b) / most if most else 1.0


def neighbours(rows):
    """Documents in descending id, nulls last, with the one after each."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return list(zip(order, order[1:] + order[:1]))


def edit(text, after):
    text, after = text or "", after or ""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def share(a, b):
    return sum(a[k:k + 4] == b[k:k + 4] for k in range(0, len(a), 4)) / (len(a) / 4)


def test_collision_rate_is_the_generalised_jaccard(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary, size=n)) for n in (40, 80, 200, 120)] + ["", None, " \n ", "a a a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sums, rounds = np.zeros((4, 4)), 12
    for seed in range(rounds):
        got = {r.id: r.fingerprint for r in fingerprints(df, ["id"], rule=SamplingRule(seed=seed)).collect()}
        assert got[4] == got[5] == got[6] == "0" * 128 and got[7] != got[4]
        sums += [[share(got[i], got[j]) for j in range(4)] for i in range(4)]
    for i in range(4):
        for j in range(4):
            p = jaccard(texts[i], texts[j])
            assert abs(sums[i, j] / rounds - p) < 4 * math.sqrt(p * (1 - p) / (32 * rounds)) + 1e-9


def test_bids_and_samples_equal_a_plain_loop(spark):
    text = " the cat and the dog\x0band the end  日本 "
    counts = Counter(words(text))
    df = spark.createDataFrame(list(counts.items()), "word string, n int").select("word", "n", F.xxhash64("word").alias("h"))
    fingerprint = fingerprints(spark.createDataFrame([(1, text)], "id long, text string"), ["id"]).first().fingerprint
    for k in (0, 5, 31):
        best = []
        for r in df.select("h", "n", F.xxhash64("h", F.lit(k)).alias("x"), bid(F.col("h"), F.log(F.col("n").cast("double")), k).alias("bid")).collect():
            x = r.x & (2 ** 64 - 1)
            u = [((x >> s & (1 << b) - 1) + .5) / 2 ** b for s, b in ((0, 12), (12, 12), (24, 13), (37, 13), (50, 14))]
            size, c = -math.log(u[0] * u[1]), -math.log(u[2] * u[3])
            t = math.floor(math.log(r.n) / size + u[4])
            log_a = math.log(c) - size * (t - u[4]) - size
            assert abs((r.bid >> 31) / 2 ** 24 - 128 - log_a) < 1e-6
            best.append((log_a, (r.h ^ t * 40503) & (2 ** 31 - 1)))
        assert int(fingerprint[4 * k:4 * k + 4], 16) == min(best)[1] % 65535 + 1


def check(rows, got):
    want = sorted(((r[0] is None, r[0] or 0), len(r[1] or ""), hashlib.sha256(edit(r[1], n[1]).encode()).hexdigest()) for r, n in neighbours(rows))
    assert sorted(((g.doc_id is None, g.doc_id or 0), g.n_chars, g.edited_sha256) for g in got) == want


def test_edits_copies_nulls_and_long_texts(spark):
    long_text = "verylong" * 30_000 + " " + "x y z " * 60_000
    rows = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, None), (4, ""), (5, "日本語 テキスト é 🎉 ok"), (6, long_text), (7, "one"), (9, " \n ")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, k1 long, half int").repartition(3)
    got = compare_with_next(df).collect()
    check(rows, got)
    by_id = {g.doc_id: g for g in got}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[2].near_next == 1.0
    assert by_id[4].near_next == 1.0 and by_id[4].fingerprint == "0" * 128 == by_id[3].edited_fingerprint and by_id[3].near_next == 0.0
    for a, b in [(a, b) for a, b in neighbours(rows)]:
        assert by_id[a[0]].near_next == share(by_id[a[0]].fingerprint, by_id[b[0]].fingerprint)
    repeated = [(8, "to be or not to be that is it")] * 25 + [(3, "other words here now"), (None, "no id a"), (None, "no id a")]
    got = compare_with_next(spark.createDataFrame(repeated, "doc_id long, text string")).collect()
    check(repeated, got)
    assert sum(g.near_next == 1.0 for g in got if g.doc_id == 8) == 24
    assert compare_with_next(df.limit(0)).count() == 0
    assert compare_with_next(df.filter("doc_id = 1")).first().near_next == 1.0


def test_likeness_follows_the_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {g.doc_id: g for g in compare_with_next(docs).collect()}
    check(rows, list(got.values()))
    errors = []
    for a, b in neighbours(rows):
        errors += [got[a[0]].near_edited - jaccard(a[1], edit(a[1], b[1])), got[a[0]].near_next - jaccard(a[1], b[1])]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.09
    assert spark.range(1).select(likeness(F.lit("0" * 128), F.lit("0" * 128)).alias("x")).first().x == 1.0
