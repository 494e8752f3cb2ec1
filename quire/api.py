"""The public functions under their usual names, from DataFrame to DataFrame."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import Config
from quire.functions import text as _text
from quire.operators import boxes as _boxes
from quire.operators.overlap import segment_cascade
from quire.operators.raster import ink_ratio
from quire.operators.verdicts import type_groups
from quire.plans.identity import detect_identities
from quire.plans.scan import page_metrics, scan_folder
from quire.sinks.images import draw_boxes, segment_names
from quire.sources.files import Providers, extract_pages, list_files

__all__ = [
    "Config", "Providers", "calculate_ink_ratio", "calculate_ocr_confidence", "clean_text", "detect_document_language", "draw_bounding_boxes", "draw_segmentation_results",
    "extract_json_keys", "extract_page_data", "filter_artifacts", "filter_text_for_confidence", "get_artifact_types", "get_config", "group_identity_documents", "has_artifacts",
    "list_files", "process_identity_documents", "run_readability_check", "segment_documents_on_page",
]


def get_config(path: str | None = None) -> Config:
    return Config.load(path) if path else Config.default()


def extract_page_data(files: DataFrame, providers: Providers, config: Config | None = None, auto_detect: bool = True) -> DataFrame:
    """Pages of files with their text, language, ink and confidence."""
    config = config or Config.default()
    return page_metrics(extract_pages(files, providers, config.languages if auto_detect else None, config.primary_language), config, auto_detect)


def process_identity_documents(segments: DataFrame, config: Config | None = None) -> DataFrame:
    return detect_identities(segments, config, clean=True)


def group_identity_documents(segments: DataFrame) -> DataFrame:
    return type_groups(segments)


def segment_documents_on_page(candidates: DataFrame, *keys: str, config: Config | None = None, by_row: DataFrame | None = None, by_column: DataFrame | None = None) -> DataFrame:
    """``boxes`` of each page from its contours, else from the gaps in its profiles; failing both, a page is a single box."""
    config = config or Config.default()
    pages = candidates.select(*keys, "page_w", "page_h").distinct()
    none = candidates.select(*keys, F.lit(0).alias("pos"), F.lit(0).alias("ink")).limit(0)
    return segment_cascade(pages, candidates, none if by_row is None else by_row, none if by_column is None else by_column, config, *keys).select(*keys, "boxes")


def calculate_ocr_confidence(boxes: DataFrame, *keys: str, mode: str = "fast", lang: str = "eng") -> DataFrame:
    return _boxes.score_pages(boxes, mode, lang, *keys)


def calculate_ink_ratio(images: DataFrame, *keys: str) -> DataFrame:
    return ink_ratio(images, *keys)


def _with(df: DataFrame, column: str, into: str, value: Any) -> DataFrame:
    return df.withColumn(into, value(F.col(column)))


def clean_text(df: DataFrame, column: str = "text") -> DataFrame:
    return _with(df, column, column, _text.clean_text)


def filter_artifacts(df: DataFrame, column: str = "text", mode: str = "compat") -> DataFrame:
    return _with(df, column, column, lambda t: _text.filter_artifacts(t, mode))


def filter_text_for_confidence(df: DataFrame, column: str = "text", mode: str = "compat") -> DataFrame:
    return _with(df, column, column, lambda t: _text.filter_for_confidence(t, mode))


def has_artifacts(df: DataFrame, column: str = "text", mode: str = "compat") -> DataFrame:
    return _with(df, column, "has_artifacts", lambda t: _text.has_artifacts(t, mode))


def get_artifact_types(df: DataFrame, column: str = "text") -> DataFrame:
    return _with(df, column, "artifact_types", _text.artifact_types)


def detect_document_language(df: DataFrame, column: str = "text", config: Config | None = None) -> DataFrame:
    c = config or Config.default()
    return _with(df, column, "language", lambda t: _text.detect_language(t, c.languages, c.primary_language))


def extract_json_keys(df: DataFrame, column: str = "text") -> DataFrame:
    """``keys``: a map of the keys and values found in each text."""
    return _with(df, column, "keys", lambda t: F.map_from_entries(_text.key_values(t)))


def run_readability_check(spark: SparkSession, folder: str, providers: Providers, **options: Any) -> DataFrame:
    return scan_folder(spark, folder, providers, **options)


def draw_bounding_boxes(image: np.ndarray, boxes: list, colors: list | None = None, line_width: int = 3) -> np.ndarray:
    return draw_boxes(image, boxes, colors, line_width)


def draw_segmentation_results(image: np.ndarray, segments: list[dict]) -> tuple[np.ndarray, list[str]]:
    """The page with a frame around each segment, and the labels that go with them."""
    return draw_boxes(image, [tuple(s["bbox"]) for s in segments]), segment_names(segments)
