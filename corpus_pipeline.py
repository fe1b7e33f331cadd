"""The document pipeline: quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and hands it
on. All stages but the last return the columns of documents.

Null and empty texts have too few words and are rejected by the first stage, as are all texts of less than
50 words; where a stage is given such texts alone, the second takes them for copies of each other and the
third and fourth for empty texts. Texts of any length are read whole in each stage. Rows that share an id
stay or go together in the second stage and are documents of their own in the others; rows without an id
are never copies. Of copies and near copies the least id stays, so ties are decided by id. More columns
of documents, whatever their names, pass through all stages but the last. An empty table gives empty
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltgrid.llm import common, packing, quality, simhash, suffix


def with_length(cleaned: DataFrame, docs: DataFrame) -> DataFrame:
    """The cleaned rows in the columns of docs, with the length of the text that is left."""
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that the rules fail go, and documents that lose too much text by it."""
    common.small_batches(spark)
    return with_length(quality.keep_documents(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages of 100 or more that start earlier go; a document stays, even if little is left of it."""
    common.small_batches(spark)
    return with_length(suffix.strip_repeats(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents by sequence and place."""
    import public_tokenizers as vocabularies

    return packing.pack_documents(docs, vocabularies.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages), ("best-fit packing", packed)]

#: SQL can't express tokenizing; tests/llm hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
