"""Bands, verdicts and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed_values as fixed


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 50, "high").when(confidence >= 30, "medium").otherwise("low")


def display_band(confidence: Column) -> Column:
    return F.when(confidence >= 85, "green").when(confidence >= 70, "orange").otherwise("red")


def adjustment_band(adjustment: Column) -> Column:
    return F.when(adjustment > 10, "strong").when(adjustment > 5, "moderate").otherwise("slight")


def readable(confidence: Column, least: float = fixed.READABLE_FROM) -> Column:
    return confidence >= least


def empty(ink_ratio: Column, below_percent: float = fixed.EMPTY_BELOW_PERCENT) -> Column:
    return ink_ratio * 100 < below_percent


def threshold_advice(threshold: Column) -> Column:
    out = None
    for limit, advice in fixed.ADVICE:
        if limit is None:
            return out.otherwise(advice)
        out = F.when(threshold <= limit, advice) if out is None else out.when(threshold <= limit, advice)
    return out


def recommended_threshold(category: Column) -> Column:
    out = None
    for part, threshold in fixed.CATEGORY_THRESHOLDS:
        if part is None:
            return out.otherwise(threshold)
        out = F.when(F.contains(category, F.lit(part)), threshold) if out is None else out.when(F.contains(category, F.lit(part)), threshold)
    return out


def fixed_point(value: Column, digits: int) -> Column:
    """The number with so many decimals, rounded from its exact binary value and ties to even, as C does.

    Java rounds the shortest decimal form instead, which differs where that form
    ends in five.  Exact below 1000 in size; larger numbers are left to Java.
    """
    bits, whole = F.lit(1 << 52).cast("decimal(20,0)"), "decimal(20,0)"

    def let(x: Column, then) -> Column:
        """The result for a value that is worked out once, however often it is used."""
        return F.element_at(F.transform(F.array(x), then), 1)

    def rounded(scaled: Column) -> Column:
        down = let(F.floor(scaled / bits).cast(whole), lambda q: F.when(q * bits > scaled, q - 1).otherwise(q).cast(whole))
        return let(down, lambda q: let((scaled - q * bits) * 2, lambda twice: q + F.when((twice > bits) | ((twice == bits) & (q % 2 == 1)), 1).otherwise(0)))

    def shown(n: Column) -> Column:
        text = F.lpad(n, F.greatest(F.length(n), F.lit(digits + 1)), F.lit("0"))
        return let(text, lambda t: F.concat(F.substring(t, F.lit(1), F.length(t) - digits), F.lit("."), F.substring(t, F.length(t) - digits + 1, F.lit(digits))))

    scaled = (F.abs(value) * float(1 << 52)).cast("bigint").cast(whole) * F.lit(10**digits).cast("decimal(6,0)")
    text = let(let(scaled, rounded).cast("bigint").cast("string"), shown)
    return F.when(F.abs(value) < 1000, F.concat(F.when(value < 0, "-").otherwise(""), text)).otherwise(F.format_string(f"%.{digits}f", value))


def side_label(display_name: Column, confidence: Column) -> Column:
    """A detected identity card in words."""
    return F.concat(F.lit("National ID — "), F.initcap(display_name), F.lit(" ("), fixed_point(confidence, 1), F.lit("%)"))
