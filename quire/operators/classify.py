"""Type, side and base confidence of identity-document segments.

A segment has ``text``, ``ocr_confidence`` (0 to 100) and ``ink_ratio`` (0 to 1).
Rules are unrolled ``contains`` tests over one lower-case copy of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as fixed
from quire.config import Config
from quire.functions.text import angle_count, any_hit, count_hits, text_length, word_count

UNKNOWN = "unknown"


def with_features(segments: DataFrame, config: Config) -> DataFrame:
    """Adds ``low``, lengths, and for every type and side whether any and how many of its keywords occur."""
    out = segments.withColumns({"text": F.coalesce("text", F.lit("")), "low": F.lower(F.coalesce("text", F.lit("")))})
    more = {"text_length": text_length(F.col("text")), "word_count": word_count(F.col("text"))}
    for category, mark in (("document_types", "type"), ("document_sides", "side")):
        for key, langs in config.all_keywords(category).items():
            more[f"has_{mark}_{key}"] = any_hit(F.col("low"), [w for words in langs.values() for w in words])
            for lang in ("en", "other"):
                more[f"n_{lang}_{mark}_{key}"] = count_hits(F.col("low"), langs.get(lang, []))
    return out.withColumns(more)


def _type_score(key: str) -> Column:
    return 2 * F.col(f"n_en_type_{key}") + F.col(f"n_other_type_{key}") + F.when(F.col(f"has_type_{key}"), 3).otherwise(0)


def classify_type(featured: DataFrame, config: Config) -> DataFrame:
    """Adds ``doc_type`` and ``type_score``: the first type with the highest score above zero."""
    keys = list(config.section("document_types"))
    if not keys:
        return featured.withColumns({"type_score": F.lit(0), "doc_type": F.lit(UNKNOWN)})
    out = featured.withColumns({f"_score_{k}": _type_score(k) for k in keys})
    best = F.greatest(*[F.col(f"_score_{k}") for k in keys], F.lit(0))
    pick = F.when(best == 0, UNKNOWN)
    for k in keys:
        pick = pick.when(F.col(f"_score_{k}") == best, k)
    return out.withColumns({"type_score": best, "doc_type": pick}).drop(*[f"_score_{k}" for k in keys])


def classify_side(featured: DataFrame, config: Config) -> DataFrame:
    """Adds ``doc_side``, ``front_points`` and ``back_points``.

    With a middling recognition confidence all points count half as much again.
    Scores within a tenth of the larger one are decided by strong phrases, and
    for the front if those don't tell.
    """
    w = config.section("side_detection_weights")
    boost = F.when(F.col("ocr_confidence").between(w["moderate_ocr_min"], w["moderate_ocr_max"]), w["moderate_ocr_side_multiplier"]).otherwise(1.0)

    def points(side: str) -> Column:
        if side not in config.section("document_sides"):
            return F.lit(0.0)
        flag = F.when(F.col(f"has_side_{side}"), w["feature_weight"]).otherwise(0.0)
        return boost * (w["en_weight"] * F.col(f"n_en_side_{side}") + w["other_weight"] * F.col(f"n_other_side_{side}") + flag)

    out = featured.withColumns({"front_points": points("front"), "back_points": points("back")})
    front, back, low = F.col("front_points"), F.col("back_points"), F.col("low")
    apart = F.abs(front - back) / F.greatest(front, back) * 100 > 10
    clearly_back = any_hit(low, fixed.STRONG_BACK) & ~any_hit(low, fixed.STRONG_FRONT)
    side = (
        F.when((front > 0) & (back > 0), F.when(apart, F.when(front > back, "front").otherwise("back")).when(clearly_back, "back").otherwise("front"))
        .when(front > 0, "front")
        .when(back > 0, "back")
        .otherwise(UNKNOWN)
    )
    return out.withColumn("doc_side", side)


def base_confidence(classified: DataFrame, config: Config) -> DataFrame:
    """Adds ``base_confidence``, from 0 to 100."""
    ocr, ink, size = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("ocr_confidence", "ink_ratio", "text_length"))
    known = F.lit(0.0)
    for key in config.section("document_types"):
        known = F.when((F.col("doc_type") == key) & F.col(f"has_type_{key}"), 30.0).otherwise(known)
    sided = F.lit(0.0)
    for key in config.section("document_sides"):
        sided = F.when((F.col("doc_side") == key) & F.col(f"has_side_{key}"), 25.0).otherwise(sided)
    inked = F.when(ink.between(0.05, 0.8), 15.0).when(ink < 0.01, -20.0).when(ink > 0.9, -10.0).otherwise(0.0)
    sized = F.when(size.between(50, 2000), 10.0).when(size == 0, -30.0).otherwise(0.0)
    total = ocr * 0.3 + known + sided + inked + sized
    return classified.withColumn("base_confidence", F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)))


def classify(segments: DataFrame, config: Config) -> DataFrame:
    """Features, type, side and base confidence of each segment."""
    return base_confidence(classify_side(classify_type(with_features(segments, config), config), config), config)


def content_analysis(segments: DataFrame) -> DataFrame:
    """Adds ``mrz_score``, ``has_mrz``, ``back_score`` and ``front_score`` of the text."""
    low = F.lower(F.coalesce("text", F.lit("")))
    out = segments.withColumns({"mrz_score": angle_count(F.col("text")), "back_score": count_hits(low, fixed.BACK_PHRASES), "front_score": count_hits(low, fixed.FRONT_PHRASES)})
    return out.withColumn("has_mrz", F.col("mrz_score") >= 5)


def content_side(analysed: DataFrame, side_col: str = "doc_side") -> DataFrame:
    """Overrides the side by what the text holds, and names the reason in ``detection_method``."""
    back, front = F.col("back_score"), F.col("front_score")
    by_mrz, by_back, by_front = F.col("has_mrz"), (back > 0) & (back >= front), (front > 0) & (front > back)
    side = F.when(by_mrz | by_back, "back").when(by_front, "front").otherwise(F.col(side_col))
    method = F.when(by_mrz, "mrz_pattern").when(by_back, "back_keywords").when(by_front, "front_keywords")
    return analysed.withColumns({side_col: side, "detection_method": method})
