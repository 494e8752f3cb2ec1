"""Detection of identity documents: segments in, settled types, sides and confidences out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import Config
from quire.functions.text import clean_text
from quire.operators.classify import classify, content_analysis, content_side
from quire.operators.frequency import adjust_confidence
from quire.operators.pairing import pair_segments


def detect_identities(segments: DataFrame, config: Config | None = None, clean: bool = False) -> DataFrame:
    """Classifies segments (``file, page, seg, text, ocr_confidence, ink_ratio``).

    The order matters: base confidence from the first side, adjustment by what
    the whole file holds, then the side by content, then pairs of a page.  Two
    shuffles, by file and by page, are all it takes; contents are analysed before
    them, so that texts cross neither unless they are asked for.
    """
    config = config or Config.default()
    if clean:
        segments = segments.withColumn("text", clean_text(F.col("text")))
    adjusted = adjust_confidence(content_analysis(classify(segments, config)), config)
    return pair_segments(content_side(adjusted))
