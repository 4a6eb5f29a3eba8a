"""A corpus from raw documents in five stages, each an operator of tallyspark.llm over all that the stage before kept.

1. language: documents whose language can't be told, or with a posterior below one half, go.
2. quality: documents that the compression classifier finds clearly bad go.
3. near_duplicates: of each group linked by 75 % of their 5-word shingles, the smallest id stays.
4. mixing: sources are brought to tempered weights by repeating documents of small ones; none is lost.
5. sentencepiece: token ids of each document.

Null and empty texts have no language and go in the first stage; rows that share an id are scored each by itself, and are one
document to the third stage, which keeps or drops them together and keeps rows without an id. A stage of no rows gives none.
Columns beside those of documents stay until the last stage.

Learning uses the labels of the documents table (lang), and the labels table (quality), of training folds only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import compression, jaccard, langid, mixing, queries, sentencepieces
from tallyspark.llm.shared import new_path

#: Documents below these scores go. A clean document that the classifier doubts a little stays.
LEAST_LANGUAGE, LEAST_QUALITY = 0.5, 0.2
MIX = mixing.Rule(entropy=0.9, repetition=2.0)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language. Without a labelled text to learn from none has."""
    model = langid.train(docs.where(queries.fold(5) != 0), queries.PIECES)
    found = langid.predict(docs, model, lang="__lang", score="__score")
    return found.where((F.col("__lang") != langid.UNDETERMINED) & (F.col("__score") >= LEAST_LANGUAGE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text isn't clearly bad. Without both labels to learn from all stay."""
    labels = queries.read(spark, sf_dir, "labels", "doc_id", "quality")
    model = compression.train(docs, labels.where(queries.fold(3) != 1))
    return compression.score(docs, model, out="__score").where(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share a doc_id are one document. The ids that go are a side of a join that may be broadcast only if Spark
    measures it as small."""
    found = jaccard.similarity_classes(docs)
    gone = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's weight takes them, once at least. A null source is a source."""
    return mixing.mix(docs, MIX).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids; an empty text has none."""
    coded = sentencepieces.encode(docs, queries.PIECES, keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixing", mixed),
    ("sentencepiece", sentencepiece),
]

#: The stages learn models, which SQL cannot express; tests/llm/test_queries.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
