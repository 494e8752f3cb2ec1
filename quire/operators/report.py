"""Reports and statistics over pages.

A report row has ``folder, file, page, confidence, readable, empty, ink_percent,
language, text`` and, for a file that failed, ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed_values as fixed
from quire.functions.bands import recommended_threshold, threshold_advice


def _percent(n: Column, total: Column) -> Column:
    return F.round(100.0 * n / F.nullif(total, F.lit(0)), 1)


def report_rollup(rows: DataFrame) -> DataFrame:
    """Totals for everything, each folder and each file in one pass; ``level`` is ``all``, ``folder`` or ``file``."""
    out = rows.rollup("folder", "file").agg(
        F.grouping_id().alias("_id"),
        F.count("*").alias("total"),
        F.count_if("readable").alias("readable"),
        F.count_if(~F.col("readable")).alias("unreadable"),
        F.count_if("empty").alias("empty"),
        F.avg("confidence").alias("avg_confidence"),
    )
    level = F.when(F.col("_id") == 0, "file").when(F.col("_id") == 1, "folder").otherwise("all")
    shares = [_percent(F.col(c), F.col("total")).alias(f"{c}_percent") for c in ("readable", "unreadable", "empty")]
    return out.select(level.alias("level"), "folder", "file", "total", "readable", "unreadable", "empty", "avg_confidence", *shares)


def distinct_files(rows: DataFrame) -> DataFrame:
    """Distinct files by folder and name, and by name alone."""
    return rows.agg(F.countDistinct("folder", "file").alias("by_folder_and_name"), F.countDistinct("file").alias("by_name"))


def nested(rows: DataFrame) -> DataFrame:
    """Per folder and file, the pages in order."""
    page = F.struct("page", "confidence", "readable", "empty")
    return rows.groupBy("folder", "file").agg(F.array_sort(F.collect_list(page)).alias("pages"))


def page_contents(rows: DataFrame) -> DataFrame:
    """Per file a JSON object of its pages' text and HTML."""
    from quire.functions.text import html_fragment

    entry = F.struct("page", F.concat(F.lit("page_"), F.col("page").cast("string")).alias("label"), F.struct(F.col("text"), html_fragment(F.col("text"), F.col("page")).alias("html")).alias("value"))
    pages = F.array_sort(F.collect_list(entry))
    return rows.groupBy("file").agg(F.to_json(F.map_from_entries(F.transform(pages, lambda p: F.struct(p.label, p.value)))).alias("content"))


def timing_sums(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.agg(*[F.sum(c).alias(f"total_{c}") for c in cols])


def category_stats(scores: DataFrame, least: float = 30.0) -> DataFrame:
    """Per category: pages, smallest, largest and mean confidence, and how many reach ``least``."""
    ok = F.count_if(F.col("confidence") >= least)
    return scores.groupBy("category").agg(F.count("*").alias("n"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"), F.avg("confidence").alias("avg_confidence"), ok.alias("n_readable"), _percent(ok, F.count("*")).alias("readable_percent"))


def percentiles(scores: DataFrame, shares: tuple[int, ...] = (10, 25, 50, 75, 90), value: str = "confidence") -> DataFrame:
    """The value at place ``floor(n * share)``, counted from zero, of the sorted values; no interpolation.

    Values are first counted, so what is ranked is the distinct ones.
    """
    counts = scores.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    # places before each value: within ranges of values, then across the ranges
    ranged = counts.repartitionByRange(value).withColumn("_part", F.spark_partition_id())
    sums = ranged.groupBy("_part").agg(F.sum("n").alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    upto = Window.partitionBy("_part").orderBy(value)
    placed = ranged.join(F.broadcast(before), "_part").withColumn("_last", F.col("_before") + F.sum("n").over(upto))  # a row for each partition
    wanted = F.explode(F.array(*[F.lit(p) for p in shares])).alias("percentile")
    at = F.expr("_all * percentile div 100")
    found = placed.select("*", wanted).where((at >= F.col("_last") - F.col("n")) & (at < F.col("_last")))
    return found.select("percentile", F.col(value).alias("value"))


def threshold_sweep(scores: DataFrame, thresholds: list[int] = fixed.SWEEP) -> DataFrame:
    """How many pages each threshold lets through: one pass over the pages with a count for each threshold."""
    counts = scores.agg(F.count("*").alias("n"), *[F.count_if(F.col("confidence") >= t).alias(f"_{t}") for t in thresholds])
    rows = counts.select("n", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_{t}").alias("n_readable")) for t in thresholds])).alias("r")).select("n", "r.*")
    return rows.select("threshold", "n_readable", (F.col("n") - F.col("n_readable")).alias("n_unreadable"), _percent(F.col("n_readable"), F.col("n")).alias("readable_percent"), threshold_advice(F.col("threshold")).alias("advice"))


def pass_rates(scores: DataFrame) -> DataFrame:
    """Per category: its recommended threshold and how many pages reach it."""
    marked = scores.withColumn("threshold", recommended_threshold(F.col("category")))
    ok = F.count_if(F.col("confidence") >= F.col("threshold"))
    return marked.groupBy("category", "threshold").agg(F.avg("confidence").alias("avg_confidence"), ok.alias("n_passing"), F.count("*").alias("n"))


def first_files(files: DataFrame, most: int = 5) -> DataFrame:
    """At most ``most`` files of each category, in name order."""
    order = Window.partitionBy("category").orderBy("file")
    return files.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def top_keywords(found: DataFrame, *keys: str, most: int = 10) -> DataFrame:
    """At most ``most`` distinct keywords, in alphabetical order."""
    return found.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_set("keyword")), 1, most).alias("keywords"))
