"""Segments of pages: from boxes to texts, and back to their pages."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import clean_text, page_prefix
from quire.sources.files import better_text

SEGMENT_SCHEMA = "file string, page int, seg int, x int, y int, w int, h int, text string, ocr_confidence double, ink_ratio double, error string"


def segment_key(page: Column, seg: Column) -> Column:
    """The key of a segment: its page and its place on it."""
    return F.concat_ws("-", page, seg)


def attach_pages(segments: DataFrame, pages: DataFrame, file: str = "file", key: str = "page_key", page: str = "page") -> DataFrame:
    """Each segment with the columns of the page its key begins with; segments without one stay, with nulls."""
    number = page_prefix(F.col(key)).try_cast("long")
    there = pages.withColumnsRenamed({file: "_file", page: "_page"})
    return segments.join(there, F.col(file).eqNullSafe(F.col("_file")) & (number == F.col("_page")), "left").drop("_file", "_page")


def first_page(pages: DataFrame, order: str, file: str = "file", page: str = "page") -> DataFrame:
    """Of several records of a page the first in order."""
    first = Window.partitionBy(file, page).orderBy(order)
    return pages.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def by_page(segments: DataFrame, *columns: str, file: str = "file", page: str = "page", seg: str = "seg") -> DataFrame:
    """For each page of a file the number of its segments and their ``columns``, in order; a page has as many as it has boxes."""
    one = F.struct(seg, *columns)
    return segments.groupBy(file, page).agg(F.count("*").alias("n_segments"), F.array_sort(F.collect_list(one)).alias("segments"))


def explode_segments(pages: DataFrame, boxes: str = "boxes") -> DataFrame:
    """A row for each box of a page, numbered from one."""
    rest = [c for c in pages.columns if c != boxes]
    return pages.select(*rest, F.posexplode(boxes).alias("_pos", "_box")).select(*rest, (F.col("_pos") + 1).alias("seg"), "_box.*")


def read_segments(pages: DataFrame, decoder: Any, ocr: Any, lang: str = "eng") -> DataFrame:
    """Texts and metrics of each segment of ``pages`` (``file, page, content, boxes``), ready for identity detection.

    Every box is cut out of the decoded page and read quickly; a short reading is
    tried again in full, and only then, and replaced if that gives half as much again.  A page
    that can't be decoded gives one row with ``error``.
    """
    from quire.operators.raster import grey, otsu

    def confidence(found: list[tuple[str, str]]) -> float:
        values = []
        for text, conf in found:
            try:
                values.append(max(0.0, float(conf)))
            except (TypeError, ValueError):
                values.append(0.0)
        kept = [v for v, (text, _) in zip(values, found, strict=True) if (text or "").strip()]
        return sum(kept) / len(kept) if kept else 0.0

    def rows(file: str, page: int, content: bytes, boxes: list) -> list[tuple]:
        try:
            image, out = decoder.decode(content), []
            for seg, b in enumerate(boxes, 1):
                part = image[b["y"] : b["y"] + b["h"], b["x"] : b["x"] + b["w"]]
                text = better_text(ocr.text(part, "fast", lang), lambda p=part: ocr.text(p, "full", lang)) if ocr else ""
                out.append((file, page, seg, b["x"], b["y"], b["w"], b["h"], text, confidence(ocr.boxes(part, "fast", lang)) if ocr else 0.0, otsu(grey(part))[1], None))
            return out
        except Exception as e:  # whatever a provider raises becomes the page's error row
            return [(file, page, None, None, None, None, None, "", 0.0, 0.0, f"{type(e).__name__}: {e}")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "page", "seg", "x", "y", "w", "h", "text", "ocr_confidence", "ink_ratio", "error"]
        for frame in frames:
            for file, page, content, boxes in zip(frame["file"], frame["page"], frame["content"], frame["boxes"], strict=True):
                yield pd.DataFrame(rows(file, page, content, list(boxes)), columns=names).astype(dict.fromkeys(["page", "seg", "x", "y", "w", "h"], "Int32"))

    read = pages.select("file", "page", "content", "boxes").mapInPandas(run, SEGMENT_SCHEMA)
    return read.withColumn("text", clean_text(F.col("text")))
