"""Lines of files and the states that run along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import LINE_END, normalize_for_match, pattern, sentences, strip, without_empty_end

FILE = ("unit_id", "relative_path")


def lines(files: DataFrame) -> DataFrame:
    """files (unit_id, relative_path, kind, text) -> a row per line: line_no from 1, line. One file is one row of input, so nothing is shuffled."""
    # the parts are a column of their own: inside the generator the text would be split once for each time that they are named
    x = files.select(*FILE, "kind", F.split("text", LINE_END).alias("_parts"))
    return x.select(*FILE, "kind", F.posexplode(without_empty_end(F.col("_parts"))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def along(*partition: str, order: str = "line_no") -> W:
    return W.partitionBy(*(partition or FILE)).orderBy(order)


def is_fence(line: Column) -> Column:
    # what isn't one costs no strip
    return (line.contains("```") | line.contains("~~~")) & F.substring(strip(line), 1, 3).isin("```", "~~~")


def without_fences(rows: DataFrame) -> DataFrame:
    """Lines outside fenced code; a fence line toggles and is dropped itself."""
    fence = is_fence(F.col("line"))
    inside = F.sum(fence.cast("int")).over(along().rowsBetween(W.unboundedPreceding, 0)) % 2 == 1
    return rows.withColumn("_fence", fence).withColumn("_inside", inside).where(~F.col("_fence") & ~F.col("_inside")).drop("_fence", "_inside")


def sections(rows: DataFrame, heading: str = r"^\s*#{1,6}\s+") -> DataFrame:
    """rows with section: how many headings there were up to the line; a heading opens its own section."""
    is_heading = F.col("line").rlike(pattern(heading)).cast("int")
    return rows.withColumn("section", F.sum(is_heading).over(along().rowsBetween(W.unboundedPreceding, 0)))


def sticky_state(rows: DataFrame, on: str, off: str, name: str = "in_task") -> DataFrame:
    """rows with a state that lines matching `on` set and lines matching `off` reset; it holds until the next such line."""
    flag = F.when(F.col("line").rlike(off), False).when(F.col("line").rlike(on), True)
    state = F.last(flag, ignorenulls=True).over(along().rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(state, F.lit(False)))


def line_sentences(rows: DataFrame) -> DataFrame:
    """A row per sentence of each line."""
    return rows.select(*FILE, "kind", "line_no", F.posexplode(sentences(strip(F.col("line")))).alias("sentence_no", "sentence")).where("sentence <> ''")


def batches(rows: DataFrame, size: int, most: int | None = None, scope: tuple[str, ...] = FILE) -> DataFrame:
    """Windows of `size` lines in order, each one text with line numbers; at most `most` a scope, if given."""
    n = F.row_number().over(W.partitionBy(*scope).orderBy(*(c for c in ("relative_path", "line_no") if c not in scope)))
    numbered = rows.withColumn("batch", F.floor((n - 1) / size).cast("int"))
    if most is not None:
        numbered = numbered.where(F.col("batch") < most)
    body = F.array_sort(F.collect_list(F.struct("relative_path", "line_no", "line")))
    out = numbered.groupBy(*scope, "batch").agg(body.alias("body"))
    text = F.array_join(F.transform("body", lambda r: F.concat(r["line_no"].cast("string"), F.lit(": "), r["line"])), "\n")
    return out.select(*scope, "batch", F.col("body")[0]["line_no"].alias("first_line"), F.size("body").alias("n_lines"), text.alias("text"))


def unit_context(files: DataFrame, limit: int, per_file: int) -> DataFrame:
    """unit_id, context: README, check-list and material files in that order, each cut to per_file, until `limit` is reached."""
    rank = F.when(F.col("kind") == "readme", 0).when(F.col("kind") == "checklist", 1).when(F.col("kind") == "material", 2)
    order = W.partitionBy("unit_id").orderBy("rank", "relative_path")
    parts = files.withColumn("rank", rank).where("rank is not null").withColumn("part", F.concat(F.lit("# "), F.col("relative_path"), F.lit("\n"), F.substring("text", 1, per_file)))
    before = F.coalesce(F.sum(F.char_length("part")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).where(F.col("before") < limit)
    body = F.array_sort(F.collect_list(F.struct("rank", "relative_path", "part")))
    return parts.groupBy("unit_id").agg(body.alias("body")).select("unit_id", F.substring(F.array_join(F.transform("body", lambda b: b["part"]), "\n\n"), 1, limit).alias("context"))


def first_in(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key, by a total order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_n(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def match_key(text: str) -> Column:
    return normalize_for_match(F.coalesce(F.col(text), F.lit("")))
