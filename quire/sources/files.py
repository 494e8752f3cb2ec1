"""Document files as rows, and page records out of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import language_of
from quire.operators.raster import image_ink

EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg")
PAGE_SCHEMA = "folder string, file string, page int, width int, height int, ink_ratio double, text string, boxes array<struct<text:string,conf:string>>, error string"


class PdfRasterizer(Protocol):
    """Renders the pages of a PDF as height x width x 3 arrays in red, green, blue order."""

    def pages(self, content: bytes) -> Iterator[np.ndarray]: ...


class ImageDecoder(Protocol):
    """Decodes one image file to an array as above."""

    def decode(self, content: bytes) -> np.ndarray: ...


class OcrProvider(Protocol):
    """Recognises the text of a page image and the boxes it stands in."""

    def text(self, image: np.ndarray, mode: str, lang: str) -> str: ...

    def boxes(self, image: np.ndarray, mode: str, lang: str) -> list[tuple[str, str]]: ...


@dataclass(frozen=True)
class Providers:
    """What reads pages; each must be importable or picklable, as it travels to the executors."""

    ocr: Any = None
    pdf: Any = None
    image: Any = None
    mode: str = "fast"
    lang: str = "eng"


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, recursive: bool = False) -> DataFrame:
    """``path``, ``folder`` (name of the directory), ``file``, ``length`` and ``content`` of the matching files.

    Extensions are matched as written.  The content column is read only if a
    later step asks for it.  Order by ``path`` where a sorted listing is wanted.
    """
    kinds = ",".join(e.lstrip(".") for e in extensions)
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{kinds}}}").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    if not recursive:  # Spark lists folders below as if they were partitions
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
        found = found.where(F.regexp_replace("path", "/[^/]*$", "") == root.rstrip("/"))
    parts = F.split("path", "/", -1)
    return found.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"), "length", "content")


def image_pages(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """One page for each image file, decoded by Spark: ``file``, ``page``, sizes and ``ink_ratio``; a broken file gives ``error``."""
    images = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    ok = F.col("image.height") > 0
    ink = image_ink(F.when(ok, F.col("image.data")), F.col("image.nChannels"))
    return images.select(
        F.element_at(F.split("image.origin", "/", -1), -1).alias("file"),
        F.lit(1).alias("page"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.when(ok, ink.ink_ratio).otherwise(0.0).alias("ink_ratio"),
        F.when(~ok, F.lit("not a readable image")).alias("error"),
    )


def extract_pages(files: DataFrame, providers: Providers, languages: Mapping[str, Sequence[str]] | None = None, primary: str | None = None) -> DataFrame:
    """Pages of ``files`` (from ``list_files``): size, ink, text and boxes of each.

    The text is read first; its language, if ``languages`` has the words to tell
    it by, is the one that the boxes and their confidences are read in, else
    ``primary``, else the providers' own.  One page's raster is held at a time.

    A PDF without pages gives one row with zeros; a file that can't be read gives
    one row with ``error`` and never fails the task.
    """
    from quire.operators.raster import grey, otsu

    def images(name: str, content: bytes) -> Iterator[np.ndarray]:
        source = providers.pdf if name.lower().endswith(".pdf") else providers.image
        if source is None:
            raise RuntimeError(f"nothing is set up that reads {name}")
        if name.lower().endswith(".pdf"):
            yield from source.pages(content)
        else:
            yield source.decode(content)

    def rows(folder: str, name: str, content: bytes) -> list[tuple]:
        try:
            out = []
            for n, image in enumerate(images(name, content), 1):
                text = providers.ocr.text(image, providers.mode, providers.lang) if providers.ocr else ""
                lang = language_of(text, languages, primary or providers.lang) if languages else primary or providers.lang
                boxes = providers.ocr.boxes(image, providers.mode, lang) if providers.ocr else []
                out.append((folder, name, n, image.shape[1], image.shape[0], otsu(grey(image))[1], text, [{"text": t, "conf": c} for t, c in boxes], None))
            if not out:
                return [(folder, name, 1, 0, 0, 0.0, "", [], None)]
            return out
        except Exception as e:  # whatever a provider raises becomes the file's error row
            return [(folder, name, None, 0, 0, 0.0, "", [], f"{type(e).__name__}: {e}")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["folder", "file", "page", "width", "height", "ink_ratio", "text", "boxes", "error"]
        for frame in frames:
            for folder, name, content in zip(frame["folder"], frame["file"], frame["content"], strict=True):
                out = pd.DataFrame(rows(folder, name, content), columns=names)
                yield out.astype({"page": "Int32", "width": "int32", "height": "int32"})

    return files.select("folder", "file", "content").mapInPandas(run, PAGE_SCHEMA)


def better_text(first: str, second: Callable[[], str], least: int = 30, gain: float = 1.5) -> str:
    """The second reading, made only if the first is short, if it is longer by enough."""
    if len(first) >= least:
        return first
    again = second()
    return again if len(again) > gain * len(first) else first


def explode_boxes(pages: DataFrame, lang: str = "eng") -> DataFrame:
    """A row for each box of each page, for the operators on boxes."""
    return pages.select("folder", "file", "page", F.lit(lang).alias("lang"), F.posexplode("boxes").alias("box_idx", "b")).select("folder", "file", "page", "lang", "box_idx", "b.text", "b.conf")
