"""The operators bound to the shared tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import Config, keyword_dim, label_dim
from quire.functions import bands, text
from quire.operators import boxes, classify, frequency, overlap, raster, report, segments, verdicts
from quire.plans import fixtures
from quire.plans.identity import detect_identities

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CONFIG = Config.default()


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
    _QUERIES[f.__name__] = f
    return f


def _r(c: str | Column, name: str | None = None) -> Column:
    """Rounded to six places, which sums in any order agree on."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def _language_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumns({"ocr_conf": F.expr("cast(doc_id * 7 % 1001 as double) / 10"), "ink_ratio": F.expr("cast(doc_id * 37 % 1000 as double) / 1000")})
    judged = verdicts.readability(docs.withColumn("language", text.detect_language(F.col("text"))))
    return judged.groupBy("language", "readable").agg(F.count("*").alias("n_pages"), _r(F.avg("ocr_conf"), "avg_confidence"))


@_query
def language_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language_verdicts(spark, sf_dir)


def _text_query(name: str, value: Callable[[Column], Column], column: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fixtures.augmented(spark, sf_dir).select("doc_id", value(F.col("text")).alias(column))

    _QUERIES[name] = run


_text_query("clean_text", text.clean_text, "cleaned")
_text_query("filter_artifacts", text.filter_artifacts, "filtered")
_text_query("filter_artifacts_intended", lambda t: text.filter_artifacts(t, "intended"), "filtered")
_text_query("filter_for_confidence", text.filter_for_confidence, "filtered")
_text_query("has_artifacts", text.has_artifacts, "found")
_text_query("artifact_types", lambda t: F.array_join(text.artifact_types(t), "; "), "kinds")
_text_query("detect_language", text.detect_language, "language")
_text_query("html_escape", text.html_escape, "escaped")
_text_query("preview", text.preview, "short")
_text_query("box_artifacts", text.is_box_artifact, "found")


@_query
def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fixtures.augmented(spark, sf_dir).select("doc_id", F.explode(text.key_values(F.col("text"))).alias("p"))
    return found.select("doc_id", "p.key", "p.value")


@_query
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, low = F.col("text"), F.col("low")
    rows = fixtures.augmented(spark, sf_dir).withColumn("low", F.lower("text"))
    analysed = classify.content_analysis(rows)
    return analysed.select("doc_id", text.text_length(t).alias("n_chars"), text.word_count(t).alias("n_words"), "mrz_score", "has_mrz", "back_score", "front_score", text.any_hit(low, ["firma", "signature"]).alias("signed"))


@_query
def html_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.augmented(spark, sf_dir).select("doc_id", text.html_fragment(F.col("text"), F.col("page")).alias("html"), text.page_prefix(F.concat_ws("-", "page", "seg")).alias("page_key"))


@_query
def box_conf_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.mean_all(fixtures.boxes(spark, sf_dir), "doc_id").select("doc_id", _r("mean_conf"), "n_boxes")


@_query
def box_conf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.mean_weighted(fixtures.boxes(spark, sf_dir), "doc_id").select("doc_id", _r("overall_conf"), _r("text_conf"), "text_boxes", "n_boxes")


@_query
def box_conf_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.mean_filtered(fixtures.boxes(spark, sf_dir), "doc_id").select("doc_id", _r("filtered_conf"), _r("total_conf"), _r("text_conf"), "filtered_boxes", "n_boxes", "has_artifacts")


@_query
def page_conf_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.fast_score(fixtures.boxes(spark, sf_dir), "doc_id").select("doc_id", _r("score"))


@_query
def page_conf_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.balanced_score(fixtures.two_mode_boxes(spark, sf_dir), "doc_id").select("doc_id", _r("balanced"), _r("enhanced"), _r("score"))


@_query
def page_conf_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = fixtures.boxes(spark, sf_dir).withColumn("lang", F.expr("case when doc_id % 3 = 0 then 'ita' when doc_id % 3 = 1 then 'eng' else 'fra' end"))
    return boxes.score_pages(tagged, "superfast", "ita", "doc_id").select("doc_id", _r("score"))


@_query
def filter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = boxes.filter_delta(fixtures.boxes(spark, sf_dir), "doc_id")
    delta = F.round("delta", 6)
    return out.select("doc_id", _r("overall_conf"), _r("filtered_conf"), "artifact_boxes", "has_artifacts", delta.alias("delta"), F.when(delta > 0, "IMPROVED").otherwise("SAME/LOWER").alias("effect"))


@_query
def best_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.augmented(spark, sf_dir).selectExpr("doc_id", "cast(doc_id * 3 % 7 as double) as improved_eng", "cast(doc_id * 5 % 7 as double) as improved_ita", "cast(doc_id % 7 as double) as original_eng", "cast(doc_id * 2 % 7 as double) as original_ita")
    return boxes.best_method(rows).select("doc_id", "best_score", "best_method")


@_query
def classify_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify.classify_type(classify.with_features(fixtures.segments(spark, sf_dir), CONFIG), CONFIG)
    return out.select("doc_id", "doc_type", F.col("type_score").cast("long").alias("type_score"))


@_query
def classify_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify.classify_side(classify.with_features(fixtures.segments(spark, sf_dir), CONFIG), CONFIG)
    return out.select("doc_id", "doc_side", "front_points", "back_points")


@_query
def base_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(fixtures.segments(spark, sf_dir), CONFIG).select("doc_id", "doc_type", "doc_side", _r("base_confidence"))


@_query
def content_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify.content_side(classify.content_analysis(classify.classify(fixtures.segments(spark, sf_dir), CONFIG)))
    return out.select("doc_id", "doc_side", "detection_method")


@_query
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.keyword_hits(fixtures.segments(spark, sf_dir), CONFIG, "doc_id").select("doc_id", "category", "key", "lang", "keyword")


@_query
def keyword_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frequency.keyword_frequency(fixtures.segments(spark, sf_dir), CONFIG)
    return out.select("file", "category", "key", "n_segments", F.array_join("pages", ",").alias("pages"), F.array_join("keywords", ",").alias("keywords"))


@_query
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.keyword_counts(fixtures.segments(spark, sf_dir), CONFIG)


@_query
def conf_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frequency.adjust_confidence(classify.classify(fixtures.segments(spark, sf_dir), CONFIG), CONFIG)
    parts = ("frequency_boost", "specificity_bonus", "consistency_bonus", "quality_factor", "total_adjustment", "confidence")
    return out.select("doc_id", F.col("cross_document_matches").cast("long").alias("cross_document_matches"), "matched_keyword_count", *[_r(c) for c in parts], bands.adjustment_band(F.round("total_adjustment", 6)).alias("band"))


@_query
def matched_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify.with_features(fixtures.segments(spark, sf_dir), CONFIG)
    return out.select("doc_id", F.array_join(frequency.matched_categories(out, CONFIG), ",").alias("matched"))


@_query
def pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect_identities(fixtures.segments(spark, sf_dir), CONFIG)
    return out.select("file", "page", "seg", "doc_type", "doc_side", _r("confidence"), "detection_method", "heuristic_applied")


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_identities(fixtures.segments(spark, sf_dir), CONFIG).withColumn("confidence", F.round("confidence", 6))


@_query
def type_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.type_groups(_identities(spark, sf_dir)).select("file", "bucket", "n_segments", _r("avg_confidence"))


@_query
def best_id_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.best_identity(_identities(spark, sf_dir), CONFIG, 50.0).select("file", "page", "present", "confidence", "side", "detection")


@_query
def emphasised_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxed = _identities(spark, sf_dir).withColumn("bbox", F.when(F.col("doc_id") % 19 != 0, F.struct("seg")))
    return verdicts.emphasised(verdicts.visible_segments(boxed, 30.0)).select("file", "page", "seg", "emphasis", bands.display_band(F.col("confidence")).alias("band"))


@_query
def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts.with_labels(_identities(spark, sf_dir), label_dim(spark, CONFIG))
    label = verdicts.segment_label(F.col("type_name"), F.col("side_name"), F.col("confidence"))
    return out.select("file", "page", "seg", "type_label", "type_name", F.array_join(F.transform("type_color", lambda c: c.cast("string")), ",").alias("color"), "side_name", "side_code", label.alias("label"))


@_query
def page_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = verdicts.page_validity(fixtures.pages(spark, sf_dir), 30.0, 0.05)
    return judged.select("folder", "file", "page", "is_empty", "is_readable", "status", "reason")


@_query
def validity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts.validity_table(verdicts.page_validity(fixtures.pages(spark, sf_dir), 30.0, 0.05))
    return out.withColumnsRenamed({"File": "file", "Page": "page", "Status": "status", "Ink%": "ink", "Conf Score": "conf", "Empty": "is_empty", "Readable": "is_readable", "Reason": "reason"})


@_query
def validity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.validity_counts(verdicts.page_validity(fixtures.pages(spark, sf_dir), 30.0, 0.05))


@_query
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.readability(fixtures.pages(spark, sf_dir)).select("folder", "file", "page", "readable", "empty", _r("ink_percent"))


@_query
def conf_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.pages(spark, sf_dir).groupBy(bands.confidence_band(F.col("ocr_conf")).alias("band"), bands.display_band(F.col("ocr_conf")).alias("display")).agg(F.count("*").alias("n"))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.readability(fixtures.pages(spark, sf_dir)).withColumnRenamed("ocr_conf", "confidence")


@_query
def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_rollup(_report(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@_query
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.distinct_files(_report(spark, sf_dir))


@_query
def report_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.nested(_report(spark, sf_dir))
    return out.select("folder", "file", F.size("pages").alias("n"), F.array_join(F.transform("pages", lambda p: p.page.cast("string")), ",").alias("pages"))


@_query
def timing_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.pages(spark, sf_dir).selectExpr("page % 97 as extraction_ms", "page % 31 as clarity_ms")
    return report.timing_sums(rows, "extraction_ms", "clarity_ms")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.expr("element_at(array('valid-pdfs', 'italian_ids', 'unclear-pdfs', 'empty-pdfs', 'big-pdf-but-readable'), cast(page % 5 + 1 as int))")
    return fixtures.pages(spark, sf_dir).select(category.alias("category"), "file", "page", F.col("ocr_conf").alias("confidence"))


@_query
def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.category_stats(_scores(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@_query
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.percentiles(_scores(spark, sf_dir))


@_query
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.threshold_sweep(_scores(spark, sf_dir))


@_query
def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pass_rates(_scores(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@_query
def first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five first files of each category: the limit is the feature."""
    return report.first_files(_scores(spark, sf_dir).select("category", "file").distinct())


@_query
def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frequency.keyword_hits(fixtures.segments(spark, sf_dir), CONFIG, "file")
    return report.top_keywords(found, "file", "key", most=10).withColumn("keywords", F.array_join("keywords", ","))


@_query
def segment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment with its page's totals, joined by the page its key begins with."""
    rows = fixtures.segments(spark, sf_dir)
    totals = rows.groupBy("file", "page").agg(F.count("*").alias("n_segments"), F.max("ink_ratio").alias("max_ink"))
    keyed = rows.select("file", segments.segment_key(F.col("page"), F.col("seg")).alias("page_key"))
    return segments.attach_pages(keyed, totals)


@_query
def first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.first_page(fixtures.segments(spark, sf_dir).select("file", "page", "seg", "doc_id"), "seg")


@_query
def config_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_dim(spark, CONFIG).groupBy("category", "key", "lang").agg(F.count("*").alias("n"), F.sum("n_words").alias("n_words"))


@_query
def ink_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.ink_ratio(fixtures.rasters(spark, sf_dir), "vec_id", "kind").select("vec_id", "kind", "threshold", _r("ink_ratio"))


@_query
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.candidates(spark, sf_dir)
    good = overlap.document_sized(F.col("area"), F.col("w"), F.col("h"), F.col("page_w").cast("long") * F.col("page_h"), CONFIG)
    wide = overlap.padded(*[F.col(c) for c in ("x", "y", "w", "h", "page_w", "page_h")], CONFIG)
    return rows.select("page", "idx", good.alias("document_sized"), wide.alias("b")).select("page", "idx", "document_sized", "b.x", "b.y", "b.w", "b.h")


@_query
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap and distances of each box and the next of its page."""
    rows = fixtures.candidates(spark, sf_dir)
    box = F.struct("x", "y", "w", "h")
    nxt = rows.select("page", (F.col("idx") - 1).alias("idx"), box.alias("b"))
    both = rows.select("page", "idx", box.alias("a")).join(nxt, ["page", "idx"])
    across, down = overlap.gaps(F.col("a"), F.col("b"))
    return both.select("page", "idx", _r(overlap.iou(F.col("a"), F.col("b")), "iou"), across.alias("gap_x"), down.alias("gap_y"))


def _listed(boxes_: Column) -> Column:
    return F.array_join(F.transform(boxes_, lambda b: F.concat_ws(":", b.x, b.y, b.w, b.h)), " ")


@_query
def suppress_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = overlap.gather(fixtures.candidates(spark, sf_dir), "page")
    return pages.select("page", _listed(overlap.suppress_overlaps(F.col("boxes"))).alias("kept"))


@_query
def drop_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = overlap.gather(fixtures.candidates(spark, sf_dir), "page")
    return pages.select("page", _listed(overlap.drop_covered(F.col("boxes"))).alias("kept"))


@_query
def split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = overlap.gather(fixtures.candidates(spark, sf_dir), "page", "page_w", "page_h")
    return pages.select("page", _listed(overlap.split_overlaps(F.col("boxes"), F.col("page_w"), F.col("page_h"))).alias("kept"))


@_query
def segment_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.segment_boxes(fixtures.candidates(spark, sf_dir), CONFIG, "page").select("page", _listed(F.col("boxes")).alias("boxes"))


def _halves(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    out = raster.projection_split(fixtures.profiles(spark, sf_dir, shift), "page")
    return out.select("page", "size", "split", F.col("first.start").alias("start_1"), F.col("first.size").alias("size_1"), F.col("second.start").alias("start_2"), F.col("second.size").alias("size_2"))


@_query
def projection_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir, 0)


@_query
def projection_split_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir, 5)


@_query
def segment_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, found = fixtures.cascade_pages(spark, sf_dir), fixtures.cascade_candidates(spark, sf_dir)
    out = overlap.segment_cascade(pages, found, fixtures.profiles(spark, sf_dir), fixtures.profiles(spark, sf_dir, 5), CONFIG, "page")
    return out.select("page", _listed(F.col("boxes")).alias("boxes"), "found_by")


@_query
def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.by_page(fixtures.segments(spark, sf_dir), "doc_id")
    return out.select("file", "page", "n_segments", F.array_join(F.transform("segments", lambda s: F.concat_ws(":", s.seg, s.doc_id)), " ").alias("segments"))


@_query
def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.page_contents(fixtures.pages(spark, sf_dir))


@_query
def key_value_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.augmented(spark, sf_dir).select("doc_id", text.key_values_json(F.col("text")).alias("keys"))


@_query
def fit_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", "cast(p_partkey * 37 % 1900 + 1 as int) as w", "cast(p_partkey * 53 % 1300 + 1 as int) as h")
    fit = raster.fitted(F.col("w"), F.col("h"))
    return parts.select("p_partkey", fit.w.alias("fit_w"), fit.h.alias("fit_h"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)
