"""The corpus pipeline: quality, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as
the next one's documents.  All but the last return the columns of documents, and other columns
that the rows may have, whatever their names.

Edge cases, at every stage: an empty table stays empty; a null or empty text is scored like any
other by the classifier, is no duplicate of another row, has no personal data, is taken by the
mix 0 times as it has no words, and would be encoded as an end id alone; repeated rows are
duplicates of each other, so one stays; null ids are kept until the last stage, as are null
languages and sources; long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import compression_quality, mixing, ngram_join, pii, queries
from tarnwork.llm.common import discard, free_name, scratch, small_side, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts good."""
    return compression_quality.keep_good(docs, compression_quality.fit(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the smallest id, nulls last, and of its rows the first.

    Groups are of rows, as ids may repeat or be null.  Rows without words are groups of their own.
    """
    row = free_name(docs, "row")
    with scratch() as keep:
        rows = keep(stored(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"))  # numbers are fixed once written
        groups = ngram_join.jaccard_components(rows.select(F.col(row).alias("row"), "text"), id_col="row")
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
        first = groups.join(rows.select(F.col(row).alias("row"), "doc_id"), "row").groupBy("component_id").agg(F.min(order)["row"].alias(row))
        first = keep(stored(first.select(row), "pipeline-first"))
    return rows.join(small_side(first), row, "left_semi").drop(row)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked in their texts."""
    return pii.mask(docs, pii.tagger(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights; a document comes as often as it is taken."""
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the encoded documents."""
    return queries.encoded(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard),
    ("PII", personal_data),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Compression, the tagger and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{k + 1}")
            if before is not None:
                discard(before)  # the stage that read it is stored
            before = docs
    return docs
