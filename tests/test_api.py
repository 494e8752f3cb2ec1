"""The public names, and the log."""

import numpy as np

from quire import api
from quire.log import get_logger


def test_names_work_on_frames(spark):
    df = spark.createDataFrame([(1, "documento a: 1\na: 2 https://x"), (2, "")], "i int, text string")
    out = api.extract_json_keys(api.detect_document_language(api.get_artifact_types(api.has_artifacts(df)))).orderBy("i").collect()
    assert (out[0].language, out[0].has_artifacts, out[0].artifact_types) == ("ita", True, ["URL"])
    assert out[0]["keys"] == {"documento a": "1", "a": "2 https://x"} and out[1]["keys"] == {}
    assert api.clean_text(df).orderBy("i").first().text == "documento a: 1\na: 2 https://x"
    assert api.filter_artifacts(df).orderBy("i").first().text == "documento a: 1\na: 2"
    assert api.filter_text_for_confidence(df).count() == 2
    rows = spark.createDataFrame([("f", 1, 1, "nome ??", 50.0, 0.5)], "file string, page int, seg int, text string, ocr_confidence double, ink_ratio double")
    found = api.process_identity_documents(rows)
    assert found.first().text == "nome" and api.group_identity_documents(found).first().bucket == "residential_id"


def test_segments_or_the_whole_page(spark):
    rows = [(1, 0, 10, 10, 90, 60, 5400.0, 300, 200), (2, 0, 10, 10, 9, 6, 54.0, 300, 200)]
    df = spark.createDataFrame(rows, "page int, idx int, x int, y int, w int, h int, area double, page_w int, page_h int")
    got = {r.page: [tuple(b) for b in r.boxes] for r in api.segment_documents_on_page(df, "page").collect()}
    assert got == {1: [(3, 6, 104, 68)], 2: [(0, 0, 300, 200)]}


def test_boxes_pixels_and_drawing(spark):
    boxes = spark.createDataFrame([(1, "a", "40", "eng")], "page int, text string, conf string, lang string")
    assert api.calculate_ocr_confidence(boxes, "page", lang="ita").first().score == 40.0
    images = spark.createDataFrame([(1, [0, 255, 255, 255])], "image int, pixels array<int>")
    assert api.calculate_ink_ratio(images, "image").first().ink_ratio == 0.25
    drawn, names = api.draw_segmentation_results(np.zeros((9, 9), np.uint8), [{"bbox": (1, 1, 5, 5)}])
    assert drawn.any() and names == ["Document 1"] and api.draw_bounding_boxes(drawn, []).shape == (9, 9, 3)
    assert api.get_config().primary_language == "ita"


def test_log(tmp_path, monkeypatch):
    monkeypatch.setenv("QUIRE_DEBUG", "1")
    log = get_logger("quire.test", path=str(tmp_path / "d.log"))
    log.debug("seen")
    assert get_logger("quire.test") is log and "seen" in (tmp_path / "d.log").read_text()
