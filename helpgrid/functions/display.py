"""Report cells: previews, numbers, marks and tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lowest metric of each tier.
TIERS = (("good", 0.75), ("ok", 0.5))
LOWEST_TIER = "bad"

CONFIDENCES = ("High", "Medium", "Low")


def preview(text: Column, length: int) -> Column:
    """The first characters, always followed by three dots."""
    return F.concat(F.left(text, F.lit(length)), F.lit("..."))


def number(value: Column, decimals: int) -> Column:
    """Fixed decimals without separators of thousands, halves to even."""
    return F.call_function("format_number", value, F.lit("0." + "0" * decimals))


def percent(value: Column) -> Column:
    """Whole percent, halves to even."""
    return F.concat(F.call_function("format_number", value * 100, F.lit("0")), F.lit("%"))


def mark(flag: Column) -> Column:
    return F.when(flag, F.lit("✅")).otherwise(F.lit("❌"))


def metric_tier(value: Column) -> Column:
    """The tier of a metric; an unknown metric has none."""
    tier = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, least in TIERS:
        tier = tier.when(value >= least, F.lit(name))
    return tier.otherwise(F.lit(LOWEST_TIER))


def confidence_tier(confidence: Column) -> Column:
    """high, medium or low; anything else is low."""
    return F.when(confidence.isin(*CONFIDENCES), F.lower(confidence)).otherwise(F.lit("low"))


def clamped(score: Column) -> Column:
    """Scores above one count as one."""
    return F.least(score, F.lit(1.0))


def numbered_steps(steps: Column) -> Column:
    """A text of numbered steps, cut before each number that follows a full stop."""
    return F.split(steps, r"(?<=\.) (?=\d+\. )")
