"""A corpus for training in five stages, each of which calls one operator of newsdesk.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as
Parquet to the shared folder and rereads it as the next one's documents, so a lost executor costs a
stage's tasks at most. The first four return the columns of documents, the last the packed pieces.

In every stage a null text is an empty one (the column keeps its null), repeated rows stay apart unless
the stage says otherwise, columns beside those of documents are dropped, whatever their names, and an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm import line_dedup, near_dups, packing, quality, toxicity
from newsdesk.llm.common import give_back, remove, scratch, table
from newsdesk.llm.registry import held_out, public_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. The examples come from this stage's own documents. Texts without a word
    of the model have the base rate and stay where that is below 0.5; rows with a null id are scored
    like others. Without labels of both kinds everything stays."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = toxicity.toxicity(docs, toxicity.fit(docs, labels))
    return scored.where(F.col("toxicity.predicted") == 0).select(*COLUMNS)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list. Empty texts and texts of under 50 words go;
    without labels only the base rules hold."""
    give_back()  # the model of the stage before
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).where("_kept").select(*COLUMNS)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that the largest id of their holders keeps; n_chars follows the
    text where lines went. No row goes, not even one whose text is empty now."""
    fewer = line_dedup.dedup_lines(docs)
    n_chars = F.when(F.col("_n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return fewer.withColumn("n_chars", n_chars).select(*COLUMNS)


def stage_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: every row that has this id. Rows
    with a null id or without a word are linked with nothing and stay."""
    give_back()
    groups = near_dups.near_duplicates(docs)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 ids. An empty text is its end id."""
    return packing.pack(docs, public_file("byte_bpe_50k.json"), length=2048, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stage_toxicity),
    ("quality_rules", stage_quality),
    ("line_dedup", stage_line_dedup),
    ("near_dups", stage_near_dups),
    ("packing", stage_packing),
]

#: Nearest examples, learned rules and column generation are no SQL. A test holds run() against its stages
#: recomputed text by text in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written is removed when the next one is through; the last
    one's files stay for the reader, in the shared folder."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if last:
            remove(spark, last)
        last = out
    return docs
