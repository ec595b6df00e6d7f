import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarlake.llm import fm_quality, toxicity_chain
from sonarlake.llm.common import table
from sonarlake.llm.labelled import held_out

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_linear_time_interactions_equal_the_pair_sum():
    rng = np.random.default_rng(1)
    bits, k = 6, 3
    size = (1 << bits) + fm_quality.STATS
    model = fm_quality.FmModel(0.3, rng.normal(size=size), rng.normal(size=(size, k)), np.zeros(fm_quality.STATS), np.ones(fm_quality.STATS), bits)
    text = "Some words, some more words\nand 12 symbols ###"
    ids, values, stats = fm_quality.features(text, None, bits)
    x = np.zeros(size)
    x[ids], x[1 << bits:] = values, np.clip(stats, -4, 4) / 4
    z = 0.3 + model.linear @ x + sum(model.factors[i] @ model.factors[j] * x[i] * x[j] for i in range(size) for j in range(i))
    assert fm_quality.score_text(model, text, None) == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), rel=1e-6)


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = fm_quality.score(docs, fm_quality.fit(docs, labels)).toPandas()
    assert len(got) == docs.count()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out))
    both = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert auc(both.quality.to_numpy(), both.score.to_numpy()) > 0.97
    assert (both.predicted == both.quality).mean() > 0.95


def test_toxicity_chain_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = toxicity_chain.score(docs, toxicity_chain.fit(docs, labels.filter(~held_out()))).toPandas()
    both = got.merge(labels.toPandas(), on="doc_id")
    both = both[[zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]]
    assert (both[both.toxic == 1].predicted == 1).mean() > 0.85
    assert (both[both.toxic == 0].predicted == 1).mean() < 0.01
    assert (got.kept == (got.predicted == 0)).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "an idiot wrote this", 19, "x", 1), (1, "an idiot wrote this", 19, "x", 1), (None, None, None, None, None), (2, "", None, "y", 0), (3, "fine words here", 15, "y", 0)],
                                 "doc_id long, text string, n_chars long, score string, label int")
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, None, 0), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module, columns in ((fm_quality, {"doc_id", "held_out", "score", "predicted"}), (toxicity_chain, {"doc_id", "score", "predicted", "kept"})):
        out = module.score(docs, module.fit(docs, labels))
        assert columns <= set(out.columns) and out.count() == 5
        assert out.filter((F.col("score") >= 0) & (F.col("score") <= 1)).count() == 5
        empty = module.score(docs.limit(0), module.fit(docs.limit(0), labels.limit(0)))
        assert empty.count() == 0


def test_training_rows_are_bounded_by_rows_not_ids(spark):
    from sonarlake.llm.labelled import training_rows
    docs = spark.range(15_000).selectExpr("7L as doc_id", "concat('copy ', id) as text").unionAll(spark.range(100, 160).selectExpr("id as doc_id", "concat('one ', id) as text"))
    labels = spark.createDataFrame([(7, 1), *[(i, i % 2) for i in range(100, 160)], (7, 0)], "doc_id long, quality int")
    rows = training_rows(docs, labels, "quality", {"text": "text"}, 50).collect()
    assert len(rows) == 50 == len({r.doc_id for r in rows})
    assert {r.doc_id: r.label for r in training_rows(docs, labels, "quality", {"text": "text"}, 500).collect()}[7] == 0


def test_toxicity_fit_brings_no_rows_to_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"plain words here {i % 5} " + ("idiot trash" if i % 3 == 0 else "fine day")) for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")

    def refuse(self):
        raise AssertionError("rows at the driver")

    monkeypatch.setattr(type(docs), "toPandas", refuse)
    model = toxicity_chain.fit(docs, labels)
    assert model.words.any() and len(model.bias) == len(model.earlier) == 4
    empty = toxicity_chain.fit(docs.limit(0), labels)
    assert not empty.words.any() and len(empty.bias) == 4
