"""Coherence of the two segments of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_PAIRED_CONFIDENCE, PAIRED_TYPE = 65.0, "residential_id"


def pair_segments(analysed: DataFrame, file: str = "file", page: str = "page", seg: str = "seg") -> DataFrame:
    """Settles types and sides on pages with exactly two segments; adds ``heuristic_applied``.

    An unknown type is taken from the other segment, with a confidence of at
    least 65; two unknown ones become residential ids if either text has any
    side phrase.  An unknown side becomes the opposite of the other's; of two
    backs of which one has a machine-readable zone, the other becomes the front.
    Pages with another number of segments stay as they are.
    """
    pages = Window.partitionBy(file, page)
    order = pages.orderBy(seg)

    def other(name: str):
        return F.coalesce(F.lag(name).over(order), F.lead(name).over(order))

    seen = ("doc_type", "doc_side", "has_mrz", "front_score", "back_score")
    out = analysed.withColumns({"_two": F.count("*").over(pages) == 2, **{f"_{c}": other(c) for c in seen}})
    two, unknown, phrases = F.col("_two"), F.lit("unknown"), F.col("front_score") + F.col("back_score") + F.col("_front_score") + F.col("_back_score")
    mine, theirs = F.col("doc_type"), F.col("_doc_type")
    copied = two & (mine == unknown) & (theirs != unknown)
    both = two & (mine == unknown) & (theirs == unknown) & (phrases > 0)
    side, facing = F.col("doc_side"), F.col("_doc_side")
    to_back, to_front = two & (side == unknown) & (facing == "front"), two & (side == unknown) & (facing == "back")
    corrected = two & (side == "back") & (facing == "back") & ~F.col("has_mrz") & F.col("_has_mrz")
    label = F.when(to_back, "paired_front_back").when(to_front, "paired_back_front").when(corrected, "mrz_side_correction").when(copied, "matched_with_pair")
    out = out.withColumns({
        "doc_type": F.when(copied, theirs).when(both, F.lit(PAIRED_TYPE)).otherwise(mine),
        "confidence": F.when(copied, F.greatest("confidence", F.lit(LEAST_PAIRED_CONFIDENCE))).otherwise(F.col("confidence")),
        "doc_side": F.when(to_back, "back").when(to_front | corrected, "front").otherwise(side),
        "heuristic_applied": label,
    })
    return out.drop("_two", *[f"_{c}" for c in seen])
