"""A corpus pipeline of five stages: quality, repeated lines, near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all but the last return the columns of
documents. Empty tables pass through. Columns besides those of documents are left behind, so none can clash. Rows are what is
worked on: rows that share an id or are equal stay rows of their own except where a stage says otherwise, and a null id is an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.common import saved
from siftwork.llm.line_dedup import dedup_lines
from siftwork.llm.mixing import emit_copies, mix_sources
from siftwork.llm.near_dedup import drop_near_duplicates
from siftwork.llm.packing import pack
from siftwork.llm.quality_fm import score_quality, train_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below 0.5 go. Null and empty texts have a score as others do; equal rows have equal scores."""
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_quality(docs, labels)
    return score_quality(docs, model).where(F.col("quality_score") >= 0.5).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that loses lines and has no words left goes as well.

    Rows that share an id are one document, null ids together the least; texts that lose nothing stay as they are, null too.
    """
    out = dedup_lines(docs.select(*COLUMNS))
    left = F.coalesce(F.col("line_kept").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return out.where((F.col("line_dropped") == 0) | left).select("doc_id", F.when(F.col("line_dropped") > 0, F.col("line_kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(F.col("line_dropped") > 0, F.length("line_kept")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the least id, of rows that share that id one. Texts without words, null among them, all stay."""
    return drop_near_duplicates(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: at most three times, and with the same toss for rows that share an id. Null texts and sources count as in mix_sources."""
    return emit_copies(mix_sources(docs.select(*COLUMNS))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids; a null text is its end token alone."""
    return pack(docs.select(*COLUMNS)).withColumnRenamed("doc", "doc_id")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]

#: Trained models, sampling and tokenizers are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
