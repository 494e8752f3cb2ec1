"""Boxes of documents on a page: filters, overlaps and their repair.

A page's boxes stand in one array of structs ``x, y, w, h`` in order; sequential
rules are folds over that array, so a page needs no shuffle beyond its grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import Config

BOX = "struct<x:int,y:int,w:int,h:int>"
_NONE = f"cast(array() as array<{BOX}>)"


def document_sized(area: Column, width: Column, height: Column, page_area: Column, config: Config) -> Column:
    """Whether a contour may be a document: strictly within the limits of area and aspect."""
    d = config.section("detection_settings")
    aspect = F.when(height > 0, width / height).otherwise(0.0)
    share = (page_area * (d["min_document_area_percent"] / 100) < area) & (area < page_area * (d["max_document_area_percent"] / 100))
    return share & (aspect > d["min_aspect_ratio"]) & (aspect < d["max_aspect_ratio"])


def padded(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, config: Config) -> Column:
    """The box with a margin on each side, cut at the page's edges."""
    p = config.section("detection_settings")["padding_percent"] / 100
    dx, dy = (w * p).cast("int"), (h * p).cast("int")
    x0, y0 = F.greatest(F.lit(0), x - dx), F.greatest(F.lit(0), y - dy)
    return F.struct(x0.alias("x"), y0.alias("y"), (F.least(page_w, x + w + dx) - x0).alias("w"), (F.least(page_h, y + h + dy) - y0).alias("h"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes."""
    across = F.greatest(F.lit(0), F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)).cast("long")
    down = F.greatest(F.lit(0), F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)).cast("long")
    both = across * down
    union = a.w.cast("long") * a.h + b.w.cast("long") * b.h - both
    return F.when(union > 0, both / union).otherwise(0.0)


def gaps(a: Column, b: Column) -> tuple[Column, Column]:
    """Distances between two boxes along either axis, zero where they overlap or touch."""
    return (
        F.greatest(F.lit(0), b.x - (a.x + a.w), a.x - (b.x + b.w)),
        F.greatest(F.lit(0), b.y - (a.y + a.h), a.y - (b.y + b.h)),
    )


def gather(boxes: DataFrame, *keys: str, order: str = "idx") -> DataFrame:
    """One row for each page with its boxes in order."""
    entry = F.struct(F.col(order), F.struct(*[F.col(c).cast("int").alias(c) for c in "xywh"]).alias("box"))
    return boxes.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.box).alias("boxes"))


def suppress_overlaps(boxes: Column, most_iou: float = 0.3) -> Column:
    """Keeps boxes from the largest down, dropping one that overlaps or touches a kept one; equals stay in order."""
    def before(a: Column, b: Column) -> Column:
        x, y = a.b.w.cast("long") * a.b.h, b.b.w.cast("long") * b.b.h
        return F.when(x > y, -1).when(x < y, 1).when(a.i < b.i, -1).when(a.i > b.i, 1).otherwise(0)

    numbered = F.array_sort(F.transform(boxes, lambda b, i: F.struct(b.alias("b"), i.alias("i"))), before)

    def clash(kept: Column, b: Column) -> Column:
        across, down = gaps(b, kept)
        return (iou(b, kept) > most_iou) | ((across == 0) & (down == 0))

    return F.aggregate(F.transform(numbered, lambda n: n.b), F.expr(_NONE), lambda kept, b: F.when(F.exists(kept, lambda k: clash(k, b)), kept).otherwise(F.array_append(kept, b)))


def drop_covered(boxes: Column, most_share: float = 0.1) -> Column:
    """Keeps boxes from top and left on, dropping one that shares more than a tenth of the larger one with a kept box."""
    ordered = F.array_sort(F.transform(boxes, lambda b, i: F.struct(b.y.alias("y"), b.x.alias("x"), i.alias("i"), b.alias("b"))))

    def clash(k: Column, b: Column) -> Column:
        across = F.least(b.x + b.w, k.x + k.w) - F.greatest(b.x, k.x)
        down = F.least(b.y + b.h, k.y + k.h) - F.greatest(b.y, k.y)
        shared = across.cast("long") * down
        return (across > 0) & (down > 0) & (shared > F.greatest(b.w.cast("long") * b.h, k.w.cast("long") * k.h) * most_share)

    return F.aggregate(F.transform(ordered, lambda o: o.b), F.expr(_NONE), lambda kept, b: F.when(F.exists(kept, lambda k: clash(k, b)), kept).otherwise(F.array_append(kept, b)))


def split_overlaps(boxes: Column, page_w: Column, page_h: Column, least: int = 20) -> Column:
    """Parts boxes that overlap vertically, from the top down, in the middle of what they share.

    Each step sees the box that the step before has moved.  Boxes no wider or
    higher than ``least`` go, the rest are cut at the page's edges.  A single box
    stays as it is.
    """
    ordered = F.transform(F.array_sort(F.transform(boxes, lambda b, i: F.struct(b.y.alias("y"), i.alias("i"), b.alias("b")))), lambda o: o.b)

    def box(x: Column, y: Column, w: Column, h: Column) -> Column:
        return F.struct(*[v.cast("int").alias(n) for n, v in zip("xywh", (x, y, w, h), strict=True)])

    def step(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        shared = last.y + last.h - b.y
        at = last.y + (last.h - F.floor(shared / 2))
        moved = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(box(last.x, last.y, last.w, at - last.y), box(b.x, at, b.w, b.y + b.h - at)))
        return F.when((F.size(done) > 0) & (shared > 0), moved).otherwise(F.array_append(done, b))

    parted = F.aggregate(ordered, F.expr(_NONE), step)

    def cut(b: Column) -> Column:
        x, y = F.greatest(F.lit(0), F.least(b.x, page_w - 1)), F.greatest(F.lit(0), F.least(b.y, page_h - 1))
        return box(x, y, F.least(x + b.w, page_w) - x, F.least(y + b.h, page_h) - y)

    return F.when(F.size(boxes) <= 1, boxes).otherwise(F.transform(F.filter(parted, lambda b: (b.w > least) & (b.h > least)), cut))


def segment_boxes(candidates: DataFrame, config: Config, *keys: str) -> DataFrame:
    """Boxes of the documents on each page from its contours (``idx, x, y, w, h, area, page_w, page_h``).

    Contours of a document's size, from left to right, lose those that overlap a
    larger one, get their margin, and are parted where they still overlap.
    """
    page_area = F.col("page_w").cast("long") * F.col("page_h")
    good = candidates.where(document_sized(F.col("area"), F.col("w"), F.col("h"), page_area, config))
    pages = gather(good.withColumn("_order", F.struct("x", "idx")), *keys, "page_w", "page_h", order="_order")
    kept = pages.withColumn("boxes", suppress_overlaps(F.col("boxes")))
    wide = kept.withColumn("boxes", F.transform("boxes", lambda b: padded(b.x, b.y, b.w, b.h, F.col("page_w"), F.col("page_h"), config)))
    return wide.withColumn("boxes", split_overlaps(F.col("boxes"), F.col("page_w"), F.col("page_h")))


def choose_segments(*arrays: Column, whole: Column) -> Column:
    """The first array that has boxes, else the whole page."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays], F.array(whole))


def segment_cascade(pages: DataFrame, candidates: DataFrame, by_row: DataFrame, by_column: DataFrame, config: Config, *keys: str) -> DataFrame:
    """``boxes`` of every page (``page_w``, ``page_h``), and what they were ``found_by``.

    Contours come first; a page without a document-sized one is parted at the
    widest gap between its rows, then between its columns (profiles: ``pos``,
    ``ink``); failing that it is one box.  What is joined grows with the pages, so
    none of it is broadcast.
    """
    from quire.operators.raster import projection_split

    def halves(name: str, across: bool) -> Column:
        def box(part: Column) -> Column:
            sides = ("start", None, "size", None) if across else (None, "start", None, "size")
            whole = {0: F.lit(0), 1: F.lit(0), 2: F.col("page_w"), 3: F.col("page_h")}
            return F.struct(*[(part[s] if s else whole[i]).cast("int").alias(n) for i, (n, s) in enumerate(zip("xywh", sides, strict=True))])

        parts = [F.col(f"{name}.{p}") for p in ("first", "second")]
        return F.array_compact(F.array(*[F.when(p.isNotNull(), box(p)) for p in parts]))

    def parted(profile: DataFrame, name: str) -> DataFrame:
        return projection_split(profile, *keys).select(*keys, F.struct("first", "second").alias(name)).hint("merge")

    out = pages.join(segment_boxes(candidates, config, *keys).select(*keys, F.col("boxes").alias("contours")).hint("merge"), list(keys), "left")
    out = out.join(parted(by_row, "_rows"), list(keys), "left").join(parted(by_column, "_columns"), list(keys), "left")
    out = out.withColumns({"rows": halves("_rows", False), "columns": halves("_columns", True)})
    whole = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("page_w").cast("int").alias("w"), F.col("page_h").cast("int").alias("h"))
    found_by = F.coalesce(*[F.when(F.size(n) > 0, F.lit(n)) for n in ("contours", "rows", "columns")], F.lit("page"))
    return out.select(*keys, choose_segments(F.col("contours"), F.col("rows"), F.col("columns"), whole=whole).alias("boxes"), found_by.alias("found_by"))
