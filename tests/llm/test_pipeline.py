from pyspark.sql import functions as F

import corpus_pipeline as cp
from sonarlake.llm import divergence, toxicity_chain
from sonarlake.llm.common import table

from .test_jaccard_join import classes

SF = "/root/testdata/sf0.001"


def test_run_equals_the_stages_done_by_hand(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in divergence.divergence_rules(docs).filter("kept").collect()}
    first = docs.filter(docs.doc_id.isin(*kept))
    model = toxicity_chain.fit(first, table(spark, SF, "labels"))
    clean = {r.doc_id for r in toxicity_chain.score(first, model).filter("kept").collect()}
    heads = {c for _, n, c in classes([(i, rows[i]) for i in sorted(clean)])}
    assert heads and heads < clean < kept < set(rows)
    pieces = cp.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == heads
    for i in heads:
        mine = sorted((r.start, r.length) for r in pieces if r.doc_id == i)
        assert mine[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:]))
        assert mine[-1][0] + mine[-1][1] == [r.doc_tokens for r in pieces if r.doc_id == i][0]


def test_stages_keep_the_columns_and_odd_rows(spark):
    text = " ".join(f"the and of word{i} in to is" for i in range(12))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, None, None, None), (None, text, "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"_row": F.lit(8), "row": F.lit("x")})
    assert [n for n, _ in cp.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "packing"] and cp.ORACLE_SQL is None
    got = docs
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, got, SF)
        assert out.columns == docs.columns
        got = out
    assert [(r.doc_id, r["_row"], r["row"]) for r in got.collect()] == [(1, 8, "x")]
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_null_and_repeated_ids_are_judged_row_by_row(spark):
    good, other, third = (" ".join(f"the and of {w}{i} in to is" for i in range(12)) for w in ("word", "thing", "matter"))
    rows = [(None, good), (None, "bad"), (None, good + " end"), (5, other), (5, "bad"), (5, third), (6, third + " end"), (7, good)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.quality_rules(spark, docs, SF)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted((str(i), t) for i, t in rows if t != "bad")
    left = [(str(r.doc_id), r.text) for r in cp.near_copies(spark, kept, SF).collect()]
    assert sorted(left) == sorted([("5", other), ("5", third), ("7", good)])
    unnamed = cp.near_copies(spark, kept.filter("doc_id IS NULL"), SF).collect()
    assert len(unnamed) == 1 and unnamed[0].text in (good, good + " end")


def test_toxicity_judges_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = toxicity_chain.fit(docs, table(spark, "/root/testdata/sf0.01", "labels"))
    verdict = {r.doc_id: r.kept for r in toxicity_chain.score(docs, model).collect()}
    bad = next(i for i in sorted(verdict) if not verdict[i])
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == bad % 2, F.lit(None).cast("long")).otherwise(F.col("doc_id")))
    labelled = docs.filter(docs.doc_id % 2 == bad % 2).unionByName(odd)
    model = toxicity_chain.fit(labelled, table(spark, "/root/testdata/sf0.01", "labels"))
    want = toxicity_chain.score(odd, model).filter("kept AND doc_id IS NULL").count()
    assert 0 < want == cp.toxicity(spark, labelled, "/root/testdata/sf0.01").filter("doc_id IS NULL").count()
