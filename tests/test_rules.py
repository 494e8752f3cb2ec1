"""Rules on boxes, segments and pages, case by case."""

import pytest
from pyspark.sql import functions as F

from quire.config import Config
from quire.operators import boxes, classify, frequency, pairing, report, verdicts
from quire.plans.identity import detect_identities

CONFIG = Config.default()


@pytest.fixture(scope="module")
def page_boxes(spark):
    rows = [(1, "word", "80"), (1, " ", "90"), (1, "x", "-1"), (1, "y", "n/a"), (1, None, "50"), (1, "https://a", "40"), (2, "", "95"), (3, "storyblok", "30")]
    return spark.createDataFrame(rows, "page int, text string, conf string")


def one(df, page):
    return next(r for r in df.collect() if r.page == page)


def test_box_means(page_boxes):
    assert one(boxes.mean_all(page_boxes, "page"), 1).mean_conf == pytest.approx(120 / 6)
    w = one(boxes.mean_weighted(page_boxes, "page"), 1)
    assert (w.overall_conf, w.text_conf, w.text_boxes, w.n_boxes) == (pytest.approx(20), pytest.approx(30), 4, 6)
    f = one(boxes.mean_filtered(page_boxes, "page"), 1)
    assert (f.filtered_conf, f.total_conf, f.filtered_boxes, f.has_artifacts) == (pytest.approx(80 / 3), pytest.approx(30), 3, True)
    assert one(boxes.fast_score(page_boxes, "page"), 2).score == 0.0
    lone = one(boxes.mean_filtered(page_boxes, "page"), 3)
    assert (lone.filtered_conf, lone.total_conf, lone.filtered_boxes) == (0.0, 30.0, 0)


def test_balanced_and_fallback(spark):
    rows = [(1, "a", "5", "balanced", "eng"), (1, "a", "30", "enhanced", "eng"), (2, "a", "12", "balanced", "fra"), (2, "a", "90", "enhanced", "fra"), (3, "a", "8", "balanced", "eng"), (3, "a", "2", "enhanced", "eng")]
    df = spark.createDataFrame(rows, "page int, text string, conf string, mode string, lang string")
    assert {r.page: r.score for r in boxes.balanced_score(df, "page").collect()} == {1: 30.0, 2: 12.0, 3: 8.0}
    got = {r.page: r.score for r in boxes.score_pages(df, "accurate", "ita", "page").collect()}
    assert got == {1: 30.0, 2: 0.0, 3: 8.0}
    with pytest.raises(ValueError):
        boxes.score_pages(df, "slow", "ita", "page")


def segments(spark, rows):
    return spark.createDataFrame([(f, p, s, t, float(o), float(i)) for f, p, s, t, o, i in rows], "file string, page int, seg int, text string, ocr_confidence double, ink_ratio double")


def test_types_and_sides(spark):
    rows = [("f", 1, 1, "aadhaar", 20, 0.5), ("f", 1, 2, "questura", 20, 0.5), ("f", 2, 1, None, 20, 0.005), ("f", 3, 1, "documento di identità", 20, 0.95), ("f", 4, 1, "name photo firma timbro", 30, 0.8), ("f", 5, 1, "barcode firma", 70, 0.05)]
    got = {(r.page, r.seg): r for r in classify.classify(segments(spark, rows), CONFIG).collect()}
    assert [got[k].doc_type for k in ((1, 1), (1, 2), (2, 1), (3, 1))] == ["aadhaar", "residential_id", "unknown", "residential_id"]
    assert got[4, 1].front_points == 1.5 * (2 * 2 + 3) and got[4, 1].doc_side == "front"
    assert got[5, 1].doc_side == "back" and got[5, 1].base_confidence == pytest.approx(21 + 25 + 15)
    assert got[2, 1].base_confidence == 0.0
    assert got[3, 1].base_confidence == pytest.approx(6 + 30 - 10)


def test_adjustment_counts_the_whole_file(spark):
    rows = [("f", 1, 1, "questura", 50, 0.5), ("f", 2, 1, "date of birth", 30, 0.5), ("f", 3, 1, "nothing", 90, 0.5), ("g", 1, 1, "questura", 20, 0.9)]
    got = {(r.file, r.page): r for r in frequency.adjust_confidence(classify.classify(segments(spark, rows), CONFIG), CONFIG).collect()}
    assert (got["f", 1].cross_document_matches, got["f", 1].specificity_bonus, got["f", 1].quality_factor) == (2, 4.0, 1.0)
    assert got["f", 2].quality_factor == 0.75 and got["f", 2].frequency_boost == 10.0
    assert got["f", 3].total_adjustment == 0.0
    assert got["g", 1].quality_factor == pytest.approx(0.4) and got["g", 1].specificity_bonus == 1.0


def settled(spark, *rows):
    df = spark.createDataFrame([("f", p, s, t, d, float(c), m, fs, bs) for p, s, t, d, c, m, fs, bs in rows], "file string, page int, seg int, doc_type string, doc_side string, confidence double, has_mrz boolean, front_score int, back_score int")
    return {(r.page, r.seg): (r.doc_type, r.doc_side, r.confidence, r.heuristic_applied) for r in pairing.pair_segments(df).collect()}


def test_pairs(spark):
    got = settled(
        spark,
        (1, 1, "residential_id", "front", 80, False, 1, 0), (1, 2, "unknown", "unknown", 10, False, 0, 0),
        (2, 1, "unknown", "unknown", 10, False, 0, 0), (2, 2, "unknown", "back", 10, True, 0, 1),
        (3, 1, "unknown", "back", 10, False, 0, 0), (3, 2, "aadhaar", "back", 90, True, 0, 0),
        (4, 1, "unknown", "unknown", 10, False, 0, 0), (4, 2, "unknown", "unknown", 10, False, 0, 0),
        (5, 1, "unknown", "unknown", 10, False, 9, 0),
        (6, 1, "aadhaar", "front", 10, False, 0, 0), (6, 2, "unknown", "unknown", 10, False, 0, 0), (6, 3, "unknown", "unknown", 10, False, 0, 0),
        (7, 1, "aadhaar", "back", 10, True, 0, 0), (7, 2, "aadhaar", "back", 10, True, 0, 0),
    )
    assert got[1, 2] == ("residential_id", "back", 65.0, "paired_front_back")
    assert got[2, 1] == ("residential_id", "front", 10.0, "paired_back_front") and got[2, 2] == ("residential_id", "back", 10.0, None)
    assert got[3, 1] == ("aadhaar", "front", 65.0, "mrz_side_correction")
    assert got[4, 1] == got[4, 2] == got[5, 1] == got[6, 2] == ("unknown", "unknown", 10.0, None)
    assert got[7, 1] == got[7, 2] == ("aadhaar", "back", 10.0, None)


def test_content_side(spark):
    rows = [(1, "a<b<c<d<e<", "front"), (2, "< < <<", "front"), (3, "firma nome", "front"), (4, "nome cognome firma", "back"), (5, "", "front")]
    df = spark.createDataFrame(rows, "i int, text string, doc_side string")
    got = {r.i: (r.doc_side, r.detection_method) for r in classify.content_side(classify.content_analysis(df)).collect()}
    assert got == {1: ("back", "mrz_pattern"), 2: ("front", None), 3: ("back", "back_keywords"), 4: ("front", "front_keywords"), 5: ("front", None)}


def test_validity(spark):
    pages = spark.createDataFrame([(1, 0.001, 10.0), (2, 0.5, 10.0), (3, 0.5, 15.0)], "page int, ink_ratio double, ocr_conf double")
    got = {r.page: r.reason for r in verdicts.page_validity(pages).collect()}
    assert got == {1: "Empty page", 2: "Low readability", 3: "OK"}
    assert {r.reason for r in verdicts.page_validity(pages, check_empty=False, check_readable=False).collect()} == {"OK"}
    assert {r.status for r in verdicts.page_validity(pages, ocr_available=False, check_empty=False).collect()} == {"Invalid"}


def test_percentiles_are_places_not_interpolations(spark):
    rng = [float(n * 37 % 101) for n in range(57)] + [5.0] * 9
    df = spark.createDataFrame([(v,) for v in rng], "confidence double")
    ranked = sorted(rng)
    assert {r.percentile: r.value for r in report.percentiles(df).collect()} == {p: ranked[int(len(ranked) * p / 100)] for p in (10, 25, 50, 75, 90)}


def test_page_contents_and_nesting(spark):
    rows = spark.createDataFrame([("d", "f", 2, "b\nc"), ("d", "f", 1, "a")], "folder string, file string, page int, text string")
    assert report.page_contents(rows).first().content == '{"page_1":{"text":"a","html":"<h3>Page 1</h3><div>a</div>"},"page_2":{"text":"b\\nc","html":"<h3>Page 2</h3><div>b<br>c</div>"}}'


def test_best_identity_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("f", 1, 1, "residential_id", "front", 70.0), ("f", 1, 2, "residential_id", "back", 70.0), ("f", 2, 1, "aadhaar", "front", 99.0)], "file string, page int, seg int, doc_type string, doc_side string, confidence double")
    got = {r.page: (r.present, r.detection) for r in verdicts.best_identity(df, CONFIG, 60.0).collect()}
    assert got == {1: (True, "National ID — Front (70.0%)"), 2: (False, "None detected")}


def test_detect_identities_keeps_rows_and_nulls(spark):
    df = segments(spark, [("f", 1, 1, None, 0, 0), ("f", 1, 2, "MRZ <<<<<", 50, 0.5)])
    got = {r.seg: r for r in detect_identities(df, clean=True).collect()}
    assert (got[2].doc_side, got[1].doc_side, got[1].heuristic_applied) == ("back", "front", "paired_back_front")
    assert detect_identities(df.where(F.lit(False))).count() == 0


def test_config(tmp_path):
    assert CONFIG.get("detection_settings.padding_percent") == 8.0 and CONFIG.get("a.b", 3) == 3
    assert (CONFIG.label("document_types", "x"), CONFIG.color("x"), CONFIG.short_code("x")) == ("X", (128, 128, 128), "X")
    with pytest.raises(FileNotFoundError):
        Config.load(str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        Config.load(str(tmp_path / "bad.json"))
    assert Config.load_ocr_settings(str(tmp_path / "bad.json"))["primary_language"] == "ita"
    assert len(CONFIG.flat_keywords()) == sum(len(ws) for c in ("document_types", "document_sides") for k in CONFIG.all_keywords(c).values() for ws in k.values())
