"""The quality of local pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .findings import findings
from .links import resolved

# The least size of a picture; what marks decoration, and up to which size.
MIN_WIDTH, MIN_HEIGHT = 640, 360
MARKS = ("icon", "badge", "logo", "favicon", "avatar", "shield", "икон", "логотип")
DECORATION = 128


def image_quality(images: DataFrame, inventory: DataFrame, min_width: int = MIN_WIDTH, min_height: int = MIN_HEIGHT) -> DataFrame:
    """Findings for Markdown images (unit_id, file_path, line_start, value, quote) of the unit that are small and not decorative, or whose size can't be read.

    inventory (unit_id, relative_path, width, height) has a row per picture; images that aren't in it belong to another rule.
    """
    local = images.where(~F.lower("value").rlike("^https?:"))
    folder = F.regexp_replace(F.regexp_replace("file_path", "[^/]*$", ""), "/$", "")
    x = local.withColumn("relative_path", resolved(folder, F.regexp_replace("value", "[?#].*$", "")))
    x = x.join(inventory.select("unit_id", "relative_path", "width", "height"), ["unit_id", "relative_path"])
    unread = F.col("width").isNull() | F.col("height").isNull()
    low, decorative = F.lower(F.concat_ws(" ", "value", "quote")), F.greatest("width", "height") <= DECORATION
    for hint in MARKS:
        decorative = decorative | low.contains(hint)
    x = x.withColumn("unread", unread).where(F.col("unread") | (((F.col("width") < min_width) | (F.col("height") < min_height)) & ~decorative))
    pick = lambda a, b: F.when(F.col("unread"), a).otherwise(b)
    return findings(
        x.select(
            "unit_id", "file_path", "line_start", F.col("line_start").alias("line_end"), "quote", F.lit("image_quality").alias("criterion"), pick("info", "minor").alias("severity"),
            pick("unknown", "warning").alias("verdict"), pick(0.45, 0.85).alias("confidence"), F.lit("image_quality_checker").alias("checker_name"),
            pick("unreadable_image", "small_image").alias("issue_type"), F.lit(True).alias("needs_human_review"),
        )
    )
