"""Verdicts on pages, and what is shown of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed_values as fixed
from quire.config import Config
from quire.functions.bands import empty, fixed_point, readable, side_label


def page_validity(pages: DataFrame, readable_from: float = fixed.READABLE_FROM, empty_below: float = fixed.EMPTY_BELOW_PERCENT / 100, check_empty: bool = True, check_readable: bool = True, ocr_available: bool = True) -> DataFrame:
    """Adds ``is_empty``, ``is_readable``, ``status`` and ``reason``; an empty page is invalid whether readable or not.

    ``empty_below`` is a ratio.  With recognition missing nothing is readable; a
    check that is switched off never fails.
    """
    void = (F.col("ink_ratio") * 100 < empty_below * 100) if check_empty else F.lit(False)
    legible = (F.col("ocr_conf") >= readable_from if ocr_available else F.lit(False)) if check_readable else F.lit(True)
    out = pages.withColumns({"is_empty": void, "is_readable": legible})
    reason = F.when(F.col("is_empty"), "Empty page").when(~F.col("is_readable"), "Low readability").otherwise("OK")
    return out.withColumns({"status": F.when(reason == "OK", "Valid").otherwise("Invalid"), "reason": reason})


def validity_table(judged: DataFrame, check_empty: bool = True, check_readable: bool = True) -> DataFrame:
    """The columns of the page table, as strings."""
    two = lambda c: fixed_point(c, 2)
    cols = [F.col("file").alias("File"), F.col("page").alias("Page"), F.col("status").alias("Status"), two(F.col("ink_ratio") * 100).alias("Ink%"), two(F.col("ocr_conf")).alias("Conf Score")]
    cols += [F.when(F.col("is_empty"), "Yes").otherwise("No").alias("Empty")] if check_empty else []
    cols += [F.when(F.col("is_readable"), "Yes").otherwise("No").alias("Readable")] if check_readable else []
    return judged.select(*cols, F.col("reason").alias("Reason"))


def validity_counts(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "Valid").alias("valid"), F.count_if(F.col("status") == "Invalid").alias("invalid"))


def readability(pages: DataFrame, readable_from: float = fixed.READABLE_FROM, empty_below: float = fixed.EMPTY_BELOW_PERCENT) -> DataFrame:
    """Adds ``readable``, ``empty`` and ``ink_percent`` as the batch scan judges them."""
    return pages.withColumns({"readable": readable(F.col("ocr_conf"), readable_from), "empty": empty(F.col("ink_ratio"), empty_below), "ink_percent": F.col("ink_ratio") * 100})


def visible_segments(segments: DataFrame, least: float, show_unknown: bool = False) -> DataFrame:
    """Segments with a box and, unless unknown ones are shown, enough confidence."""
    boxed = segments.where(F.col("bbox").isNotNull())
    return boxed if show_unknown else boxed.where(F.col("confidence") >= least)


def best_identity(segments: DataFrame, config: Config, least: float, file: str = "file", page: str = "page", seg: str = "seg", wanted: str = "residential_id") -> DataFrame:
    """Per page key the identity card with the highest confidence, the first among equals, and whether it reaches ``least``."""
    mine = F.when(F.col("doc_type") == wanted, F.struct(F.col("confidence"), (-F.col(seg)).alias("order"), F.col("doc_side").alias("side")))
    best = segments.groupBy(file, page).agg(F.max(mine).alias("best"))
    name = F.lit(None).cast("string")
    for key in config.section("document_sides"):
        name = F.when(F.col("best.side") == key, config.display_name("document_sides", key)).otherwise(name)
    name = F.coalesce(name, F.upper("best.side"))
    present = F.coalesce(F.col("best.confidence") >= least, F.lit(False))
    label = F.when(present, side_label(name, F.col("best.confidence"))).otherwise("None detected")
    return best.select(file, page, present.alias("present"), F.col("best.confidence").alias("confidence"), F.col("best.side").alias("side"), label.alias("detection"))


def emphasised(segments: DataFrame, file: str = "file", page: str = "page", seg: str = "seg", wanted: str = "residential_id") -> DataFrame:
    """Adds ``emphasis``: the page's visible identity card with the highest confidence, the first among equals."""
    order = Window.partitionBy(file, page, F.col("doc_type") == wanted).orderBy(F.desc("confidence"), seg)
    return segments.withColumn("emphasis", (F.col("doc_type") == wanted) & (F.row_number().over(order) == 1))


def type_groups(segments: DataFrame, known: tuple[str, ...] = ("residential_id", "aadhaar"), file: str = "file") -> DataFrame:
    """Per file and type bucket: segments and their mean confidence; other types count as unknown."""
    bucket = F.when(F.col("doc_type").isin(*known), F.col("doc_type")).otherwise("unknown")
    return segments.groupBy(file, bucket.alias("bucket")).agg(F.count("*").alias("n_segments"), F.avg("confidence").alias("avg_confidence"))


def with_labels(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds label, name and colour of the type and name and short code of the side; without an entry the key in capitals, grey and its first letter."""
    kinds = F.broadcast(labels.where(F.col("category") == "document_types").select(F.col("key").alias("_type"), F.col("label").alias("_label"), F.col("display_name").alias("_name"), F.col("color").alias("_color")))  # as many rows as configured keys
    sides = F.broadcast(labels.where(F.col("category") == "document_sides").select(F.col("key").alias("_side"), F.col("display_name").alias("_side_name"), F.col("short_code").alias("_code")))
    out = segments.join(kinds, F.col("doc_type") == F.col("_type"), "left").join(sides, F.col("doc_side") == F.col("_side"), "left")
    return out.withColumns({
        "type_label": F.coalesce("_label", F.upper("doc_type")),
        "type_name": F.coalesce("_name", F.upper("doc_type")),
        "type_color": F.coalesce("_color", F.array(*[F.lit(128)] * 3)),
        "side_name": F.coalesce("_side_name", F.upper("doc_side")),
        "side_code": F.coalesce("_code", F.upper(F.substring("doc_side", 1, 1))),
    }).drop("_type", "_label", "_name", "_color", "_side", "_side_name", "_code")


def segment_label(type_name, side_name, confidence):
    """What is written at a segment's box."""
    return F.concat(type_name, F.lit(" - "), side_name, F.lit(" ("), fixed_point(confidence, 1), F.lit("%)"))
