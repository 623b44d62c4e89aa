"""The corpus pipeline: five stages, each over all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.
The labels, of the documents still there, are those of `labels` in sf_dir; models are fitted on the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import bpe, decontamination, ngram_join, quality_classifier, toxicity
from cairn.llm.queries import WORD_BPE, table
from cairn.tables import dropped, scratch, shared_dir


#: Bytes of an Arrow batch. Stages follow each other in one session, whose executors keep the most that any stage took.
BATCH_BYTES = 2_000_000


def bounded(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_BYTES where they have Spark's default of 64 MB; operators set nothing themselves."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(spark.conf.get(name)).rstrip("b") == str(64 * 2**20):
        spark.conf.set(name, str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier ranks below its threshold go.

    Every row is judged by its text alone: null and empty ones as texts without words; rows with a null id are judged, and
    taught nothing. Without labels of both classes all stay.
    """
    bounded(spark)
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go.

    Every row is judged by its whole text alone, null and empty ones as texts without words. Without labels of both classes all stay.
    """
    bounded(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays.

    Texts without words and rows with a null id stay; of rows that repeat an id those with one text count as one.
    """
    bounded(spark)
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, row by row, whatever their ids; null and empty texts stay."""
    bounded(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, with its counts and digests; null and empty texts have no tokens."""
    bounded(spark)
    return bpe.encode(docs, WORD_BPE)


STAGES = [
    ("quality_classifier", quality),
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("bpe_encoding", encoded),
]

#: SQL can express neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table in the shared folder, and goes once the next one's is whole.

    Null ids and texts, repeated rows and other columns are handled as each stage says; an empty table stays empty.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        at = shared_dir(spark)
        with scratch(spark, keep=[at]):
            stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        dropped(spark, before)
        before = [at]
    return STAGES[-1][1](spark, docs, sf_dir)
