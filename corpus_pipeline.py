"""From raw documents to token ids: language, lines, near-duplicates, mixture, pieces.

Every stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps,
with the columns of ``documents``; the last adds ``piece_ids`` and ``n_pieces``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import byte_cnn, lattice, line_edit, near_copies, raking
from quire.llm.queries import PIECES
from quire.llm.runtime import ready

#: A document whose likeliest language is less likely than this has none.
LEAST_LANGUAGE_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: null texts, texts without a letter, and texts no language fits.

    The network learns from the documents' own labels outside the held-out fold.
    """
    model = byte_cnn.train(docs.where(byte_cnn.held_in(docs.doc_id, 4, 2)))
    scored = byte_cnn.predict(docs, model)
    kept = scored.where((F.col("lang_pred") != byte_cnn.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines leave the texts; every document stays, if only with an empty text."""
    out = line_edit.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by five-word shingles of Jaccard similarity 0.8, the document with the smallest id stays.

    Candidates come from SimHash fingerprints of the shingles, on op9's grid of
    segment bit counts with a radius of eight bits, and are verified on the texts.
    At that similarity fingerprints lie up to eleven bits and more apart, so links
    beyond the radius are looked for by shared shingles, between what SimHash has
    not connected.
    """
    return near_copies.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the raked mixture samples."""
    return raking.mix(docs).where("sampled").select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids."""
    return lattice.encode(docs, lattice.load(PIECES))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: The first and the last stage are beyond SQL; the tests hold the rows against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each keeps is written to the shared checkpoint folder and read again.

    A stage's folder is removed once the next stage is written; the last one holds
    the result and stays.
    """
    ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{last}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        last = name
    return docs
