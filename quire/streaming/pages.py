"""Verdicts on pages as they arrive in a folder.

Nothing here keeps state, so a stream can be restarted from its checkpoint alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.text import detect_language
from quire.operators.verdicts import page_validity, readability

PAGE_RECORDS = "folder string, file string, page int, ink_ratio double, ocr_conf double, text string"


def read_pages(spark: SparkSession, path: str, schema: str = PAGE_RECORDS, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def judge_stream(pages: DataFrame) -> DataFrame:
    """Language, readability and validity of each page record."""
    return page_validity(readability(pages.withColumn("language", detect_language(F.col("text")))))


def write_verdicts(judged: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends verdicts to Parquet, a folder for each status, until what is there has been read."""
    return judged.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("status").trigger(availableNow=True).start()
