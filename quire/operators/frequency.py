"""Keyword frequencies over the segments of a file, and the confidence they lend.

What a file holds is aggregated with partial maxima and sums, a number for each
keyword, and joined back; a file with very many segments needs no list of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import Config
from quire.functions.text import hits


def keyword_hits(segments: DataFrame, config: Config, *keys: str) -> DataFrame:
    """A row for each keyword found: ``category``, ``key``, ``lang``, ``keyword``; a word in two languages gives two."""
    low = F.lower(F.coalesce("text", F.lit("")))
    groups = []
    for category in ("document_types", "document_sides"):
        for key, langs in config.all_keywords(category).items():
            for lang, words in langs.items():
                groups.append(F.struct(F.lit(category).alias("category"), F.lit(key).alias("key"), F.lit(lang).alias("lang"), hits(F.col("_low"), words).alias("keywords")))
    found = segments.select(*keys, low.alias("_low")).select(*keys, F.explode(F.array(*groups)).alias("g"))
    return found.select(*keys, "g.category", "g.key", "g.lang", F.explode("g.keywords").alias("keyword"))


def keyword_frequency(segments: DataFrame, config: Config, file: str = "file") -> DataFrame:
    """Per file, category and key: segments that match, their page keys, and the distinct keywords found."""
    found = keyword_hits(segments, config, file, "page", "seg")
    each = found.groupBy(file, "category", "key", "page", "seg").agg(F.collect_set("keyword").alias("words"))
    place = F.struct("page", "seg", F.concat_ws("-", "page", "seg").alias("shown"))
    grouped = each.groupBy(file, "category", "key").agg(F.count("*").alias("n_segments"), F.array_sort(F.collect_list(place)).alias("_places"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("keywords"))
    return grouped.select(file, "category", "key", "n_segments", F.transform("_places", lambda p: p.shown).alias("pages"), "keywords")


def keyword_counts(segments: DataFrame, config: Config, file: str = "file") -> DataFrame:
    """How often each type keyword of a file was found; one that two languages or types list counts for each."""
    found = keyword_hits(segments, config, file).where(F.col("category") == "document_types")
    return found.groupBy(file, "keyword").agg(F.count("*").alias("n"))


def _bonus(word: str, per_word: dict) -> float:
    n = len(word.split())
    return per_word["three_plus_words"] if n >= 3 else per_word["two_words"] if n == 2 else per_word["single_word"]


def adjust_confidence(classified: DataFrame, config: Config, file: str = "file") -> DataFrame:
    """Adds the parts of the adjustment and ``confidence``, the base confidence with it, at most the cap.

    ``classified`` comes from ``classify``.  The specificity of a type counts every
    keyword of it found anywhere in the file.
    """
    s = config.section("confidence_boost_settings")
    types, sides = list(config.section("document_types")), list(config.section("document_sides"))
    sums, bonus = [], {}
    for t in types:
        sums.append(F.count_if(F.col(f"has_type_{t}")).alias(f"_count_{t}"))
        words = dict.fromkeys(w for ws in config.keywords("document_types", t).values() for w in ws)
        bonus[t] = [(f"_found_{t}_{i}", _bonus(w, s["specificity_bonus_per_word"])) for i, w in enumerate(words)]
        sums += [F.max(F.contains("low", F.lit(w.lower())).cast("int")).alias(name) for (name, _), w in zip(bonus[t], words, strict=True)]
    facts = classified.groupBy(F.col(file).alias("_file")).agg(*sums)

    def total(parts: list[Column]) -> Column:
        out = F.lit(0.0)
        for p in parts:
            out = out + p
        return out

    facts = facts.select("_file", *[f"_count_{t}" for t in types], *[total([F.col(n) * b for n, b in bonus[t]]).alias(f"_specific_{t}") for t in types])
    out = classified.join(facts, F.col(file).eqNullSafe(F.col("_file")))
    matched = total([F.col(f"has_type_{t}").cast("int") for t in types] + [F.col(f"has_side_{k}").cast("int") for k in sides]).cast("int")
    out = out.withColumn("matched_keyword_count", matched)
    across = F.greatest(F.lit(0), *[F.when(F.col(f"has_type_{t}"), F.col(f"_count_{t}")).otherwise(0) for t in types]) if types else F.lit(0)
    out = out.withColumn("cross_document_matches", across)
    n, m = F.col("cross_document_matches"), F.col("matched_keyword_count")
    q, c = s["quality_factors"], s["consistency_bonus"]
    ocr, ink = F.coalesce("ocr_confidence", F.lit(0.0)), F.coalesce("ink_ratio", F.lit(0.0))
    quality = F.when(ocr < q["poor_ocr_threshold"], q["poor_ocr_factor"]).when(ocr < q["medium_ocr_threshold"], q["medium_ocr_factor"]).otherwise(1.0)
    quality = quality * F.when((ink < q["poor_ink_ratio_min"]) | (ink > q["poor_ink_ratio_max"]), q["poor_ink_factor"]).otherwise(1.0)
    out = out.withColumns({
        "frequency_boost": F.when(n >= 3, s["triple_plus_match_boost"]).when(n == 2, s["double_match_boost"]).when(n == 1, s["single_match_boost"]).otherwise(0.0),
        "specificity_bonus": F.least(F.lit(s["max_specificity_bonus"]), total([F.when(F.col(f"has_type_{t}"), F.col(f"_specific_{t}")).otherwise(0.0) for t in types])),
        "consistency_bonus": F.when(m >= 3, c["three_plus_matches"]).when(m == 2, c["two_matches"]).otherwise(0.0),
        "quality_factor": quality,
    })
    out = out.withColumn("total_adjustment", (F.col("frequency_boost") + F.col("specificity_bonus") + F.col("consistency_bonus")) * F.col("quality_factor"))
    out = out.withColumn("confidence", F.least(F.lit(s["max_confidence_cap"]), F.col("base_confidence") + F.col("total_adjustment")))
    return out.drop("_file", *[f"_{x}_{t}" for t in types for x in ("count", "specific")])


def matched_categories(classified: DataFrame, config: Config) -> Column:
    """The matched types and sides of a classified row, in configured order."""
    names = [F.when(F.col(f"has_{mark}_{k}"), F.lit(k)) for c, mark in (("document_types", "type"), ("document_sides", "side")) for k in config.section(c)]
    return F.array_compact(F.array(*names))
