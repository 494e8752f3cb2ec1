"""Files, providers, reports and the stream."""

import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quire.plans import scan
from quire.sinks.reports import report_path, summary_line
from quire.sources.files import Providers, better_text, extract_pages, image_pages, list_files
from quire.streaming.pages import judge_stream, read_pages, write_verdicts

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the providers below travel to workers


def png(pixels):
    h, w = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(row) for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


class Pdf:
    def pages(self, content):
        for n in [] if content == b"none" else content.decode().split(","):
            if n == "x":
                raise ValueError("torn page")
            image = np.full((8, 8, 3), 255, np.uint8)
            image[: int(n)] = 0
            yield image


class Ocr:
    def text(self, image, mode, lang):
        return "carta d'identita nome" if (image == 0).any() else ""

    def boxes(self, image, mode, lang):
        return [("carta", "90"), (" ", "-1"), ("https://x", "10")] if (image == 0).any() else []


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, content in (("a.pdf", b"2,0"), ("b.pdf", b"none"), ("c.pdf", b"1,x"), ("notes.txt", b"x"), ("sub/d.pdf", b"4")):
        (tmp_path / "in" / name).write_bytes(content)
    return str(tmp_path / "in")


def test_listing(spark, folder):
    assert [r.file for r in list_files(spark, folder).orderBy("path").collect()] == ["a.pdf", "b.pdf", "c.pdf"]
    deep = list_files(spark, folder, recursive=True).orderBy("path").select("folder", "file").collect()
    assert ("sub", "d.pdf") in [tuple(r) for r in deep] and len(deep) == 4


def test_pages_and_error_rows(spark, folder):
    rows = extract_pages(list_files(spark, folder), Providers(Ocr(), Pdf())).collect()
    by = {(r.file, r.page): r for r in rows}
    assert by["a.pdf", 1].ink_ratio == 0.25 and len(by["a.pdf", 1].boxes) == 3
    assert by["b.pdf", 1].ink_ratio == 0.0 and by["b.pdf", 1].text == ""
    assert by["c.pdf", None].error == "ValueError: torn page" and len(rows) == 4
    bare = extract_pages(list_files(spark, folder), Providers()).collect()
    assert all("nothing is set up" in r.error for r in bare)


@pytest.mark.parametrize("kind", ["html", "txt"])
def test_scan_to_report(spark, folder, tmp_path, kind):
    out = str(tmp_path / f"out.{kind}")
    assert scan.main(spark, Providers(Ocr(), Pdf()), [folder, "-o", out, "-r", "-e", "5"]) == out
    rows = {(r.file, r.page): r for r in scan.scan_folder(spark, folder, Providers(Ocr(), Pdf()), recursive=True).collect()}
    assert (rows["a.pdf", "1"].confidence, rows["a.pdf", "1"].readable, rows["a.pdf", "1"].language) == (90.0, True, "ita")
    assert rows["c.pdf", "N/A"].error and not rows["c.pdf", "N/A"].readable
    report = open(out, encoding="utf-8").read()
    assert "torn page" in report and "carta d" in report and report.count("a.pdf") >= 1
    assert ("sub/d.pdf" if kind == "html" else "FOLDER: sub") in report


def test_arguments():
    with pytest.raises(SystemExit):
        scan.arguments(["x", "-t", "101"])
    assert scan.arguments(["x"]).threshold == 15.0


def test_report_names_and_summary(spark, tmp_path):
    first = report_path(str(tmp_path))
    open(first, "w").close()
    assert "report_001_" in first and "report_002_" in report_path(str(tmp_path), "txt")
    rows = spark.createDataFrame([("d", "f", "1", 20.0, True, False), ("d", "f", "2", 0.0, False, True)], "folder string, file string, page string, confidence double, readable boolean, empty boolean")
    assert summary_line(rows) == "2 pages in 1 files: 1 readable (50.0%), 1 unreadable, 1 empty, average confidence 10.00"
    assert summary_line(rows.limit(0)) == "no pages"


def test_images(spark, tmp_path):
    page = np.full((10, 10), 255, np.uint8)
    page[:3] = 0
    (tmp_path / "a.png").write_bytes(png(page))
    (tmp_path / "blank.png").write_bytes(png(np.full((4, 4), 255, np.uint8)))
    (tmp_path / "torn.png").write_bytes(b"\x89PNG torn")
    got = {r.file: r for r in image_pages(spark, str(tmp_path)).collect()}
    assert got["a.png"].ink_ratio == pytest.approx(0.3) and got["a.png"].error is None
    assert got["blank.png"].ink_ratio == 0.0
    assert got["torn.png"].error and got["torn.png"].ink_ratio == 0.0


def test_second_reading():
    assert better_text("a" * 10, lambda: "b" * 16) == "b" * 16
    assert better_text("a" * 10, lambda: "b" * 15) == "a" * 10
    assert better_text("a" * 30, lambda: pytest.fail("read again")) == "a" * 30


class Tongues(Ocr):
    def text(self, image, mode, lang):
        return "identity card surname given name" if (image == 0).any() else "carta d'identita cognome nome"

    def boxes(self, image, mode, lang):
        return [("word", {"eng": "80", "ita": "60"}.get(lang, "10"))]


def test_boxes_are_read_in_the_language_of_the_text(spark, folder):
    from quire.config import Config

    found = lambda **options: {(r.file, r.page): (r.language, r.confidence) for r in scan.scan_folder(spark, folder, Providers(Tongues(), Pdf(), lang="fra"), **options).collect() if r.file == "a.pdf"}
    assert found() == {("a.pdf", "1"): ("eng", 80.0), ("a.pdf", "2"): ("ita", 60.0)}
    assert set(found(auto_detect=False).values()) == {(Config.default().primary_language, {"eng": 80.0, "ita": 60.0}[Config.default().primary_language])}


def test_language_of_one_text_is_that_of_the_column(spark):
    from quire.functions.text import detect_language, language_of

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["", "Identity Card SURNAME", "carta d'identita name", "https://a.b/nome x", "nome"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(detect_language(F.col("text"))).collect()] == [language_of(t) for t in texts]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("d", "f", 1, 0.5, 90.0, "documento"), ("d", "f", 2, 0.001, 90.0, None)], "folder string, file string, page int, ink_ratio double, ocr_conf double, text string")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        write_verdicts(judge_stream(read_pages(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    got = {r.page: (r.status, r.language, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("Valid", "ita", "OK"), 2: ("Invalid", "ita", "Empty page")}


class Raw:
    def decode(self, content):
        if content == b"torn":
            raise ValueError("torn page")
        return np.frombuffer(content, np.uint8).reshape(40, 40, 3)


class TwoModes:
    def text(self, image, mode, lang):
        return "nome  cognome" if mode == "fast" else "nome cognome data di nascita" if image.shape[0] > 10 else "x"

    def boxes(self, image, mode, lang):
        return [("nome", "80"), (" ", "5"), ("x", "n/a")]


def test_segments_of_pages(spark):
    from quire.operators.segments import attach_pages, explode_segments, first_page, read_segments, segment_key

    page = np.full((40, 40, 3), 255, np.uint8)
    page[:5] = 0
    boxes = [{"x": 0, "y": 0, "w": 20, "h": 20}, {"x": 0, "y": 30, "w": 20, "h": 8}]
    df = spark.createDataFrame([("f", 1, page.tobytes(), boxes), ("f", 2, b"torn", boxes)], "file string, page int, content binary, boxes array<struct<x:int,y:int,w:int,h:int>>")
    got = {(r.page, r.seg): r for r in read_segments(df, Raw(), TwoModes()).collect()}
    assert got[1, 1].text == "nome cognome data di nascita" and got[1, 1].ocr_confidence == 40.0 and got[1, 1].ink_ratio == 0.25
    assert got[1, 2].text == "nome cognome" and got[2, None].error == "ValueError: torn page"
    flat = explode_segments(df.drop("content")).withColumn("page_key", segment_key(*[F.col(c) for c in ("page", "seg")])).drop("page")
    joined = attach_pages(flat, df.select("file", "page", "content")).collect()
    assert sorted((r.page_key, len(r.content)) for r in joined) == [("1-1", 4800), ("1-2", 4800), ("2-1", 4), ("2-2", 4)]
    doubled = df.selectExpr("file", "page", "1 as n").union(df.selectExpr("file", "page", "0"))
    assert [r.n for r in first_page(doubled, "n").collect()] == [0, 0]
