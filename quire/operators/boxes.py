"""Confidence of pages from the boxes that recognition found on them.

A box has ``text`` and ``conf``, both strings; a confidence that is no number or
negative counts as zero, a box without text is blank.  All averages of a page come
from one grouped aggregation with partial sums, so a page with very many boxes is
summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_box_artifact, strip


def box_confidence(conf: Column) -> Column:
    return F.greatest(F.coalesce(conf.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def has_text(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) != ""


def _mean(value: Column, where: Column | None = None) -> Column:
    return F.coalesce(F.avg(value if where is None else F.when(where, value)), F.lit(0.0))


def _marked(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"_conf": box_confidence(F.col("conf")), "_filled": has_text(F.col("text")), "_artifact": is_box_artifact(F.col("text"))})


def mean_all(boxes: DataFrame, *keys: str) -> DataFrame:
    """Mean over all boxes, blank ones counting as zero: ``mean_conf``, ``n_boxes``."""
    value = F.when(F.col("_filled"), F.col("_conf")).otherwise(0.0)
    return _marked(boxes).groupBy(*keys).agg(_mean(value).alias("mean_conf"), F.count("*").alias("n_boxes"))


def mean_weighted(boxes: DataFrame, *keys: str) -> DataFrame:
    """``overall_conf`` over all boxes, ``text_conf`` over those with text, and both counts."""
    c, filled = F.col("_conf"), F.col("_filled")
    return _marked(boxes).groupBy(*keys).agg(_mean(F.when(filled, c).otherwise(0.0)).alias("overall_conf"), _mean(c, filled).alias("text_conf"), F.count_if(filled).alias("text_boxes"), F.count("*").alias("n_boxes"))


def mean_filtered(boxes: DataFrame, *keys: str) -> DataFrame:
    """Means over boxes with text (``total_conf``) and over those of them that are no artifacts (``filtered_conf``, ``text_conf``)."""
    c, filled, good = F.col("_conf"), F.col("_filled"), F.col("_filled") & ~F.col("_artifact")
    return _marked(boxes).groupBy(*keys).agg(
        _mean(c, good).alias("filtered_conf"),
        _mean(c, filled).alias("total_conf"),
        _mean(c, good).alias("text_conf"),
        F.count_if(good).alias("filtered_boxes"),
        F.count("*").alias("n_boxes"),
        F.coalesce(F.bool_or(F.col("_filled") & F.col("_artifact")), F.lit(False)).alias("has_artifacts"),
    )


def fast_score(boxes: DataFrame, *keys: str) -> DataFrame:
    """``score`` of each page: the filtered mean, blended with the text mean where fewer than half of the boxes are good."""
    sparse = (F.col("filtered_boxes") > 0) & (F.col("filtered_boxes") < F.col("n_boxes") * 0.5)
    score = F.when(sparse, 0.7 * F.col("text_conf") + 0.3 * F.col("filtered_conf")).otherwise(F.col("filtered_conf"))
    return mean_filtered(boxes, *keys).withColumn("score", score)


def superfast_score(boxes: DataFrame, *keys: str) -> DataFrame:
    """The mean over all boxes of a downscaled page."""
    return mean_all(boxes, *keys).select(*keys, F.col("mean_conf").alias("score"))


def balanced_score(boxes: DataFrame, *keys: str, mode_col: str = "mode") -> DataFrame:
    """The mean over the boxes of mode ``balanced``; below ten, the better one of it and of mode ``enhanced``.

    Pages without boxes of the first mode score what the second gives.
    """
    value = F.when(F.col("_filled"), F.col("_conf")).otherwise(0.0)
    both = _marked(boxes).groupBy(*keys).agg(*[_mean(value, F.col(mode_col) == m).alias(m) for m in ("balanced", "enhanced")])
    return both.withColumn("score", F.when(F.col("balanced") < 10, F.greatest("balanced", "enhanced")).otherwise(F.col("balanced")))


def score_pages(boxes: DataFrame, mode: str, lang: Column | str, *keys: str, fallback: str = "eng") -> DataFrame:
    """``score`` of each page in a mode, from boxes in ``lang`` or, where it has none, in the fallback language, else zero.

    ``boxes`` has ``lang``; ``lang`` may be a column of the page.  ``accurate`` is
    the same as ``balanced``.
    """
    score = {"superfast": superfast_score, "fast": fast_score, "balanced": balanced_score, "accurate": balanced_score}.get(mode)
    if score is None:
        raise ValueError(f"unknown mode {mode!r}")
    wanted = F.lit(lang) if isinstance(lang, str) else lang
    ranked = boxes.withColumn("_wanted", F.col("lang") == wanted).where(F.col("_wanted") | (F.col("lang") == fallback))
    by = score(ranked, *keys, "_wanted").groupBy(*keys).agg(F.max_by("score", "_wanted").alias("score"))
    return boxes.select(*keys).distinct().join(by, list(keys), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def filter_delta(boxes: DataFrame, *keys: str) -> DataFrame:
    """What leaving artifacts out does to a page's mean, and whether it helps."""
    both = mean_weighted(boxes, *keys).join(mean_filtered(boxes, *keys).drop("text_conf", "n_boxes"), list(keys))
    delta = F.col("filtered_conf") - F.col("overall_conf")
    return both.select(*keys, "overall_conf", "filtered_conf", (F.col("n_boxes") - F.col("filtered_boxes")).alias("artifact_boxes"), "has_artifacts", delta.alias("delta"), F.when(delta > 0, "IMPROVED").otherwise("SAME/LOWER").alias("effect"))


def best_method(scores: DataFrame, ordered: tuple[str, ...] = ("improved_eng", "improved_ita", "original_eng", "original_ita")) -> DataFrame:
    """Adds ``best_score`` and ``best_method``, the first in order among equals."""
    top = F.greatest(*ordered)
    pick = F.when(F.col(ordered[0]) == top, ordered[0])
    for name in ordered[1:]:
        pick = pick.when(F.col(name) == top, name)
    return scores.withColumns({"best_score": top, "best_method": pick})
