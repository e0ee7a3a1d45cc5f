"""A corpus pipeline: language, toxicity, near-duplicates, then packing into training sequences.

Each stage takes all documents that the one before kept and returns a DataFrame;
all but the last return the columns of documents.  `run` writes each result to
the shared folder and reads it back for the next stage.

Documents with null or empty texts have no language and go with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightshelf.llm import langid, lp_packing, ngram_join, toxicity
from lightshelf.llm.common import fresh, stored, table
from lightshelf.llm.tokens import vocabulary_path

#: Least calibrated probability of the predicted language.
LEAST_LANGUAGE_SCORE = 0.5


def _small_batches(spark: SparkSession) -> None:
    """Batches that go to Python hold so many bytes at most: the default of 64 MB is held several times over by each task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a predicted language of at least the least score."""
    _small_batches(spark)
    model = langid.fit(docs, ~langid.held_out())
    lang, sure = (fresh(c, docs.columns) for c in ("_lang", "_sure"))
    rated = langid.predict(docs, model, out=(lang, sure))
    return rated.where((F.col(lang) != "und") & (F.col(sure) >= LEAST_LANGUAGE_SCORE)).drop(lang, sure)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not predicted to be toxic."""
    _small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rate, toxic = (fresh(c, docs.columns) for c in ("_rate", "_toxic"))
    return toxicity.score(docs, model, out=(rate, toxic)).where(F.col(toxic) == 0).drop(rate, toxic)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    _small_batches(spark)
    return ngram_join.one_of_each(docs, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    _small_batches(spark)
    return lp_packing.pack(docs, vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken"), capacity=2048, end_id=0)


STAGES = [("language_id", known_language), ("toxicity", not_toxic), ("ngram_join", one_of_each_group), ("lp_packing", packed)]

#: Trained models and linear programs have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
