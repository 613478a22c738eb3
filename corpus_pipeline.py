"""A corpus from raw documents to packed sequences, in five stages of operators of the llm subpackage.

Rows without an id pass the Jaccard stage and the passage stage as they are, since copies are told by ids; rows of the same id and text become
one there. Null texts count as empty: they are scored, have no copies, and are packed as an end id. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.llm import packing, partenum, passage_dedup, quality_mil, source_mix
from clausework.llm.session import ensure_checkpoint_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this input's labelled rows, does not reject."""
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_mil.score(docs, model, column="__score")
    return scored.where(F.col("__score") >= quality_mil.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each component of five-word Jaccard links of 0.8 or more, equal rows once; rows without an id stay."""
    named = docs.where("doc_id IS NOT NULL")
    found = partenum.jaccard_components(named, width=5, percent=80)
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = named.join(keep, "doc_id", "left_semi").withColumn("__row", F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("source", "lang", "n_chars")))
    return kept.where("__row = 1").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; documents left without words go."""
    done = passage_dedup.passage_dedup(docs).where("n_removed = 0 OR n_removed < n_words")
    return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by a Poisson number, so that sources have equal shares, in shuffled order."""
    return source_mix.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_passages),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]


def _drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again.

    A stage's files go when the next one's are written; those of the last but one stay, since the result reads them.
    """
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            _drop(spark, f"{base}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
