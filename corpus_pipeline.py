"""From raw documents to packed sequences: quality rules, toxicity, one document per group of near copies, packing.

Every stage reads what the one before kept and its decision takes effect; all but the last return the columns of the
documents table. A stage numbers its rows in a column of a free name, stores them once and decides row by row, so null and
repeated ids lose nothing. ``run`` stores each stage's rows as Parquet in the session's shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarlake.llm import divergence, jaccard_join, packing, toxicity_chain
from sonarlake.llm.common import table
from sonarlake.llm.jaccard_join import numbered
from sonarlake.llm.queries import BYTE_BPE, vocabulary
from sonarlake.plans.durable import durable


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents with a stored row number, and the name of its column, which none of the table's columns has."""
    row, taken = "_row", {c.lower() for c in docs.columns}
    while row in taken:
        row += "_"
    return numbered(docs, row), row


def _only(docs: DataFrame, row: str, verdict: DataFrame, keep: str) -> DataFrame:
    """Numbered documents whose row in ``verdict`` (doc_id is the number, ``keep``) is not false, without the number."""
    gone = verdict.filter(~F.col(keep)).select(F.col("doc_id").alias(row))
    return docs.join(gone, row, "left_anti").drop(row)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the divergence rules (operator 6)."""
    rows, row = _numbered(docs)
    return _only(rows, row, divergence.divergence_rules(rows, doc_id=row), "kept")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject (operator 5); labels train it."""
    rows, row = _numbered(docs)
    return _only(rows, row, toxicity_chain.score(rows, toxicity_chain.fit(rows, table(spark, sf_dir, "labels")), doc_id=row), "kept")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents (operator 7): that of smallest id, or one without an id if none has one.

    Texts without words are linked with nothing and stay, of a repeated id one.
    """
    rows, row = _numbered(docs)
    sets, linked = jaccard_join.linked_rows(rows.select(row, "text").toDF("row", "_text"))
    ids = rows.select(F.col(row).alias("row"), "doc_id")
    wordless = sets.filter("n = 0").select("row").join(ids, "row").filter("doc_id IS NOT NULL").select("row", F.lit(None).cast("long").alias("comp"), "doc_id")
    grouped = durable(linked.join(ids, "row").select("row", "comp", "doc_id").unionByName(wordless), "grouped")
    single = F.when(F.col("comp").isNull(), F.col("doc_id"))
    first = grouped.groupBy("comp", single.alias("_single")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("_f")).select("_f.row")
    return _only(rows, row, grouped.join(first, "row", "left_anti").select(F.col("row").alias("doc_id"), F.lit(False).alias("first")), "first")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens (operator 10)."""
    return packing.pack_documents(docs, vocabulary(BYTE_BPE), window=1024, end_id=0)


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity), ("n-gram Jaccard join", near_copies), ("packing", pack)]

#: The classifier and the tokenizer cannot be written in SQL; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
