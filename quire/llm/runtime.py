"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import shutil
import tempfile
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python; texts can be long, so batches are short.
TEXT_BATCH_ROWS = 512


def ready(spark: SparkSession) -> SparkSession:
    """Makes reliable checkpoints possible and keeps Arrow batches of texts small.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a
    folder of our own is used only where none is named and the executors are this
    very machine, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        alone = context.master.startswith("local") and not context.master.startswith("local-cluster")
        if not named and not alone:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not named:  # the folder goes with the session
            named = tempfile.mkdtemp(prefix="quire-checkpoints-")
            weakref.finalize(context, shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > TEXT_BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, kept in the shared checkpoint folder."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int) -> DataFrame:
    """Broadcast if it has no more than ``most`` rows, else left to a shuffle join; ``df`` should be cut first."""
    return F.broadcast(df) if df.count() <= most else df


def bucket_of(key: Column, n: int) -> Column:
    """``crc32`` of the key as text, modulo ``n``: the folds of the labelled tables."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of ``columns``, whatever the case."""
    held, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def one_row_per_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without rows of a null id, and of rows with one id that with the smallest text, a null one first.

    Of equal texts the smallest hash of the other columns decides.  Rows move only
    where ids repeat.
    """
    again, whole = unused(docs.columns, "again", "whole")
    mine = F.col(f"`{id_col}`")
    repeated = cut(docs.where(mine.isNotNull()).groupBy(mine.alias(again)).agg(F.count("*").alias(whole)).where(F.col(whole) > 1).select(again))
    sound = docs.where(mine.isNotNull())
    if not repeated.count():
        return sound
    repeated = small(repeated, 100_000)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    order = F.struct(F.col(f"`{text_col}`"), F.xxhash64(*hashed))
    once = sound.join(repeated, mine == F.col(again), "left_semi").groupBy(mine.alias(again)).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias(whole))
    return sound.join(repeated, mine == F.col(again), "left_anti").unionByName(once.select(f"{whole}.*"))
