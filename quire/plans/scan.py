"""The batch scan: files to pages to verdicts to a report."""

from __future__ import annotations

import argparse
import importlib
import os
import time
import webbrowser
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixed_values as fixed
from quire.config import Config
from quire.functions.text import detect_language
from quire.operators.boxes import fast_score
from quire.operators.verdicts import readability
from quire.sinks.reports import report_path, summary_line, write_report
from quire.sources.files import Providers, explode_boxes, extract_pages, list_files


def page_metrics(pages: DataFrame, config: Config | None = None, auto_detect: bool = True) -> DataFrame:
    """Adds ``language`` and ``ocr_conf`` to extracted pages; pages without boxes score zero."""
    config = config or Config.default()
    scored = fast_score(explode_boxes(pages), "folder", "file", "page").select("folder", "file", "page", F.col("score").alias("ocr_conf"))
    lang = detect_language(F.col("text"), config.languages, config.primary_language) if auto_detect else F.lit(config.primary_language)
    return pages.drop("boxes").join(scored, ["folder", "file", "page"], "left").withColumns({"ocr_conf": F.coalesce("ocr_conf", F.lit(0.0)), "language": lang})


def report_rows(pages: DataFrame, readable_from: float = fixed.READABLE_FROM, empty_below: float = fixed.EMPTY_BELOW_PERCENT, full_text: bool = True) -> DataFrame:
    """Report rows of pages; a failed file is neither readable nor empty and has no page number."""
    judged = readability(pages, readable_from, empty_below)
    bad = F.col("error").isNotNull()
    text = F.col("text") if full_text else F.substring("text", 1, 200)
    return judged.select(
        "folder", "file", F.when(bad, "N/A").otherwise(F.col("page").cast("string")).alias("page"), F.when(bad, 0.0).otherwise(F.col("ocr_conf")).alias("confidence"),
        (F.col("readable") & ~bad).alias("readable"), (F.col("empty") & ~bad).alias("empty"), F.when(bad, 0.0).otherwise(F.col("ink_percent")).alias("ink_percent"),
        F.coalesce("language", F.lit("eng")).alias("language"), F.coalesce(text, F.lit("")).alias("text"), "error",
    )


def scan_folder(spark: SparkSession, folder: str, providers: Providers, readable_from: float = fixed.READABLE_FROM, empty_below: float = fixed.EMPTY_BELOW_PERCENT, recursive: bool = False, config: Config | None = None, auto_detect: bool = True, full_text: bool = True) -> DataFrame:
    """Report rows of all files of a folder."""
    config = config or Config.default()
    pages = extract_pages(list_files(spark, folder, recursive=recursive), providers, config.languages if auto_detect else None, config.primary_language)
    return report_rows(page_metrics(pages, config, auto_detect), readable_from, empty_below, full_text)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Checks whether the pages of documents can be read.")
    p.add_argument("folder")
    p.add_argument("-o", "--output")
    p.add_argument("-t", "--threshold", type=float, default=fixed.READABLE_FROM, help="confidence from 0 to 100 from which a page is readable")
    p.add_argument("-e", "--emptiness", type=float, default=fixed.EMPTY_BELOW_PERCENT, help="ink percentage from 0 to 10 below which a page is empty")
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-l", "--language", default=None, help="the language of pages whose text names none, and of all pages without detection")
    p.add_argument("--open", action="store_true", help="show the report when it is written")
    p.add_argument("--providers", default=None, help="module:name of the Providers that read files")
    p.add_argument("--no-auto-detect", action="store_true")
    p.add_argument("--preview-text", action="store_true", help="the first 200 characters instead of whole texts")
    args = p.parse_args(argv)
    if not 0 <= args.threshold <= 100:
        p.error("the threshold must lie between 0 and 100")
    if not 0 <= args.emptiness <= 10:
        p.error("the emptiness must lie between 0 and 10")
    return args


def main(spark: SparkSession, providers: Providers, argv: list[str] | None = None) -> str:
    """Scans, writes the report and returns its path."""
    args, began = arguments(argv), time.time()
    config = Config.default()
    if args.language:
        config = replace(config, primary_language=args.language)
    rows = scan_folder(spark, args.folder, providers, args.threshold, args.emptiness, args.recursive, config, not args.no_auto_detect, not args.preview_text).persist()
    path = args.output or report_path(".")
    write_report(rows, path, args.folder, args.threshold, args.emptiness, time.time() - began)
    if args.verbose:
        for r in rows.orderBy("folder", "file", F.col("page").try_cast("int")).toLocalIterator():
            print(f"{r.folder}/{r.file} page {r.page}: {r.error or f'confidence {r.confidence:.2f}, ink {r.ink_percent:.2f}%, {r.language}'}")
    print(summary_line(rows))
    rows.unpersist()
    if args.open:
        webbrowser.open(f"file://{os.path.abspath(path)}")
    return path


def run(argv: list[str] | None = None) -> str:
    """The command line: ``python -m quire.plans.scan FOLDER --providers module:name``."""
    named = arguments(argv).providers
    module, _, name = (named or "").partition(":")
    providers = getattr(importlib.import_module(module), name) if name else Providers()
    return main(SparkSession.builder.appName("quire").getOrCreate(), providers, argv)


if __name__ == "__main__":
    run()
