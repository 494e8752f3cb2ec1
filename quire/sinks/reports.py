"""Reports as HTML and plain text.

A report is read by people, so its rows are bounded by what a scan covers; they
are brought to the driver in order, one at a time, and written as they come.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.bands import confidence_band
from quire.functions.text import html_escape, preview
from quire.operators.report import report_rollup

_STYLE = "body{font-family:sans-serif;max-width:1400px;margin:0 auto;padding:20px}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px 8px}.high{color:#060}.medium{color:#a60}.low,.error{color:#b00}pre{white-space:pre-wrap}"


# Titles of the text report, by which its readers find their way.
TITLES = (
    "DOCUMENT READABILITY CHECK RESULTS",
    "SUMMARY",
    "DETAILED PAGE-WISE RESULTS",
    "UNREADABLE PAGES (Action Required)",
    "EMPTY PAGES (Possible Blank Pages)",
    "END OF REPORT",
)


def _ordered(rows: DataFrame) -> Iterator[Any]:
    shown = rows.withColumns({"band": confidence_band(F.col("confidence")), "escaped": html_escape(F.col("text")), "short": preview(F.col("text"))})
    return shown.orderBy("folder", "file", F.col("page").try_cast("int"), "page").toLocalIterator()


def _totals(rows: DataFrame) -> dict[tuple, Any]:
    return {(r.level, r.folder, r.file): r for r in report_rollup(rows).collect()}


def _plain(text: Any) -> str:
    return str(text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def write_html(rows: DataFrame, path: str, scanned: str, readable_from: float, empty_below: float, seconds: float) -> None:
    """One section for each folder and file, with a link to the document and a line for each page."""
    totals, root = _totals(rows), os.path.dirname(os.path.abspath(path))
    whole = totals.get(("all", None, None))
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="UTF-8"><title>Document readability</title><style>{_STYLE}</style></head><body>\n<h1>Document readability</h1>\n')
        f.write(f"<p>{_plain(scanned)} &middot; readable from {readable_from}% &middot; empty below {empty_below}% &middot; {seconds:.2f} s &middot; {datetime.now():%Y-%m-%d %H:%M:%S}</p>\n")
        if whole:
            f.write(f"<p>{whole.total} pages: {whole.readable} readable, {whole.unreadable} unreadable, {whole.empty} empty; average confidence {whole.avg_confidence:.2f}</p>\n")
        for folder, in_folder in groupby(_ordered(rows), key=lambda r: r.folder):
            f.write(f"<h2>Folder: {_plain(folder)}</h2>\n")
            for file, pages in groupby(in_folder, key=lambda r: r.file):
                t = totals[("file", folder, file)]
                inner = "" if folder in (None, "(root)", os.path.basename(os.path.normpath(scanned))) else folder
                link = _plain(os.path.relpath(os.path.join(os.path.abspath(scanned), inner, file), root).replace("\\", "/"))
                f.write(f'<h3>File: <a href="{link}">{_plain(file)}</a></h3>\n<p>Total {t.total}, readable {t.readable}, unreadable {t.unreadable}, empty {t.empty}</p>\n')
                f.write("<table><tr><th>Page</th><th>Empty</th><th>Readable</th><th>Confidence</th><th>Ink %</th><th>Lang</th><th>Text</th></tr>\n")
                for r in pages:
                    if r.error:
                        f.write(f'<tr><td colspan="7" class="error">Error: Page {r.page}: {_plain(r.error)}</td></tr>\n')
                        continue
                    flags = "".join(f"<td>{'Yes' if x else 'No'}</td>" for x in (r.empty, r.readable))
                    f.write(f'<tr><td><a href="{link}#page={r.page}">#{r.page}</a></td>{flags}<td class="{r.band}">{r.confidence:.2f}</td><td>{r.ink_percent:.2f}</td><td>{_plain(r.language or "eng")}</td><td><pre>{r.escaped}</pre></td></tr>\n')
                f.write("</table>\n")
        f.write("</body></html>\n")


def write_text(rows: DataFrame, path: str, scanned: str, readable_from: float, empty_below: float, seconds: float) -> None:
    """A summary, a table for each file, and lists of unreadable and of empty pages."""
    totals = _totals(rows)
    whole, files = totals.get(("all", None, None)), sum(level == "file" for level, _, _ in totals)
    rule = "-" * 100 + "\n"
    with open(path, "w", encoding="utf-8") as f:
        f.write("=" * 100 + f"\n{TITLES[0]}\n" + "=" * 100 + "\n\n")
        f.write(f"Folder Scanned: {scanned}\nReadability Threshold: {readable_from}%\nEmptiness Threshold: {empty_below}%\nFiles Processed: {files}\n")
        f.write(f"Total Pages: {whole.total if whole else 0}\nExecution Time: {seconds:.2f} seconds\nTimestamp: {datetime.now():%Y-%m-%d %H:%M:%S}\n\n{rule}\n{TITLES[1]}\n")
        if whole:
            for name, n, share in (("Readable", whole.readable, whole.readable_percent), ("Unreadable", whole.unreadable, whole.unreadable_percent), ("Empty", whole.empty, whole.empty_percent)):
                f.write(f"  {name} Pages: {n} ({share:.1f}%)\n")
            f.write(f"  Average Confidence: {whole.avg_confidence:.2f}\n")
        f.write(f"\n{rule}\n{TITLES[2]}\n")
        for folder, in_folder in groupby(_ordered(rows), key=lambda r: r.folder):
            f.write(f"\nFOLDER: {folder}\n")
            for file, pages in groupby(in_folder, key=lambda r: r.file):
                t = totals[("file", folder, file)]
                f.write(f"\n  FILE: {file}\n  {t.total} pages | Readable: {t.readable} | Unreadable: {t.unreadable} | Empty: {t.empty} | Avg Conf: {t.avg_confidence:.2f}\n")
                for r in pages:
                    if r.error:
                        f.write(f"     ERROR (Page {r.page}): {r.error}\n")
                    else:
                        f.write(f"     {r.page:<6} {'Yes' if r.empty else 'No':<8} {'Yes' if r.readable else 'No':<10} {r.confidence:<14.2f} {r.ink_percent:<10.2f} {(r.language or 'eng')[:3].upper():<6} {r.short}\n")
        for title, some in ((TITLES[3], rows.where(~F.col("readable"))), (TITLES[4], rows.where("empty"))):
            shown = False
            for r in _ordered(some):
                f.write("" if shown else f"\n{rule}{title}\n")
                shown = True
                f.write(f"  {r.folder}/{r.file} (Page {r.page}): confidence {r.confidence:.2f}%, ink {r.ink_percent:.2f}%" + (f", error: {r.error}" if r.error else "") + "\n")
        f.write(f"\n{'=' * 100}\n{TITLES[5]}\n")


def report_path(folder: str, kind: str = "html", now: datetime | None = None) -> str:
    """``report/report_NNN_time.kind`` under a folder, numbered after the reports that are there."""
    into = os.path.join(folder, "report")
    os.makedirs(into, exist_ok=True)
    n = sum(name.startswith("report_") and name.endswith((".html", ".txt")) for name in os.listdir(into)) + 1
    return os.path.join(into, f"report_{n:03d}_{(now or datetime.now()):%Y%m%d_%H%M%S}.{kind}")


def write_report(rows: DataFrame, path: str, scanned: str, readable_from: float, empty_below: float, seconds: float) -> None:
    """HTML for a path that ends so, text for any other."""
    write = write_html if path.lower().endswith(".html") else write_text
    write(rows, path, scanned, readable_from, empty_below, seconds)


def summary_line(rows: DataFrame) -> str:
    """Counts and the average in one line, for a console."""
    t = _totals(rows).get(("all", None, None))
    if not t:
        return "no pages"
    files = rows.select("file").distinct().count()
    return f"{t.total} pages in {files} files: {t.readable} readable ({t.readable_percent:.1f}%), {t.unreadable} unreadable, {t.empty} empty, average confidence {t.avg_confidence:.2f}"
