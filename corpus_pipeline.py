"""Documents to training sequences: quality, language, near-duplicates, benchmark decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all documents its predecessor kept, and returns a DataFrame;
``run`` writes each as Parquet in the shared folder and rereads it for the next.  All stages but the last return
the columns of documents.  Null texts and ids are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontam_fm, lang_kernel, near_dup, packing, quality_cnn
from gridloom.llm.common import written
from gridloom.llm.queries import tokenizer_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, gives a probability of 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_cnn.good_documents(docs, quality_cnn.train(docs, labels), 0.5)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, in some learned language with probability 0.5 or more; all, if none can be learned."""
    model = lang_kernel.fit(lang_kernel.training_rows(docs, F.lit(False)))
    return lang_kernel.identified_documents(docs, model, 0.5) if model.names else docs


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8): the least doc_id.

    Rows are told apart by a key of their own, so rows that share a doc_id, or have none, are judged by their texts.
    In a group, rows without doc_id come last and rows that share one in the order of their texts' hashes.  Wordless
    rows are in no group: those with equal doc_id and text count once, those without doc_id are all kept.
    """
    row = "_row"
    while row in (c.lower() for c in docs.columns):
        row += "_"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # written, so keys stay
    found = near_dup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), words=5, percent=80).select(F.col("doc_id").alias(row), "n_shingles", "component_id")
    text = F.col("text").cast("string")
    marks = rows.select(row, F.col("doc_id").alias("doc"), F.xxhash64(text).alias("h"), F.when(text.rlike(r"^[\x20\t-\r]*$"), text).alias("blank"))
    wordless = F.col("n_shingles") == 0
    group = [F.when(~wordless | F.col("doc").isNull(), F.col("component_id")).alias("group"), F.when(wordless, F.col("doc")).alias("doc_"), F.when(wordless, F.col("blank")).alias("blank_")]
    first = F.min(F.struct(F.col("doc").isNull(), "doc", "h", row))[row]
    kept = found.join(marks, row).groupBy(*group).agg(first.alias(row)).select(row)
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated: fewer than 5 % of their words in 13-word windows of the benchmark."""
    return decontam_fm.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, percent=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids: ``doc_id, start, length, doc_tokens, ids, sequence_id, offset``."""
    return packing.pack(packing.cut(docs, *tokenizer_files()), docs.count(), group_docs=2048)


STAGES = [("quality", quality), ("language", language), ("dedup", dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: The classifiers are learned and tokens come from a vocabulary: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
