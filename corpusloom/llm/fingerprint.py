"""Document fingerprints: a homomorphic multiset hash, with DataFrame functions only.

A text's elements are its paragraphs and, inside each paragraph, its pieces of up to PIECE words. Every element is hashed
to a wide vector, and the fingerprint is the sum of the vectors modulo powers of two. So the order of the elements
doesn't matter, and fingerprints of parts can be added to or taken from a whole (`combined`).

- PARA lanes hold sums of 60-bit paragraph hashes modulo 2**60: equality.
- LONGS lanes of 60 bits hold three counters of 20 bits each (modulo 2**20): in how many pieces' hashes a bit is set.
  2 * counter - pieces is a random +-1 projection of the multiset, so the cosine of two such vectors estimates the
  cosine of the multisets, with a standard error of 1 / sqrt(3 * LONGS). Texts of over a million pieces keep equality
  and addition, but their likeness loses its meaning when a counter passes 2**20.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIECE = 4
LONGS = 16
PARA = 4
LANE = 20
WRAP = (1 << 60) - 1
UNIT = 1 | 1 << LANE | 1 << 2 * LANE
RANGE_ROWS = 2000
MOST_RANGES = 65536


def fingerprint_lanes(text: Column) -> Column:
    """array<bigint>: PARA paragraph sums, LONGS packed counters, number of pieces. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(r"(?:\S++[^\S\n]*+){1,%d}+" % PIECE), F.lit(0))
    hashes = F.transform(pieces, lambda p: F.xxhash64(p))
    zero = F.struct(*(F.lit(0).cast("long").alias(f"c{i}") for i in range(LONGS)))
    counters = F.aggregate(
        hashes,
        zero,
        lambda acc, h: F.struct(*((acc[f"c{i}"] + F.shiftrightunsigned(h, i).bitwiseAND(F.lit(UNIT))).bitwiseAND(F.lit(WRAP)).alias(f"c{i}") for i in range(LONGS))),
        lambda acc: F.array(*(acc[f"c{i}"] for i in range(LONGS))),
    )
    paragraphs = F.filter(F.split(text, "\n"), lambda p: p != "")
    zero = F.struct(*(F.lit(0).cast("long").alias(f"p{i}") for i in range(PARA)))
    sums = F.aggregate(
        paragraphs,
        zero,
        lambda acc, p: F.struct(*((acc[f"p{i}"] + F.xxhash64(F.lit(i), p).bitwiseAND(F.lit(WRAP))).bitwiseAND(F.lit(WRAP)).alias(f"p{i}") for i in range(PARA))),
        lambda acc: F.array(*(acc[f"p{i}"] for i in range(PARA))),
    )
    return F.concat(sums, counters, F.array(F.size(pieces).cast("long")))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The lanes of a's elements with b's added (sign 1) or taken out (sign -1)."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(WRAP)))


def fingerprint_text(lanes: Column) -> Column:
    """The lanes as hexadecimal digits, 16 a lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _signed(lanes: Column) -> Column:
    """The projections 2 * counter - pieces as doubles."""
    n = F.element_at(lanes, -1)
    low = F.lit((1 << LANE) - 1)
    packed = F.slice(lanes, PARA + 1, LONGS)
    return F.flatten(F.transform(packed, lambda x: F.array(*((2 * F.shiftrightunsigned(x, LANE * k).bitwiseAND(low) - n).cast("double") for k in range(3)))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated cosine of two multisets of pieces; 1 for equal fingerprints, else 0 if one has no pieces."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(_signed(a), _signed(b), lambda x, y: x * y))
    norm = total(F.transform(_signed(a), lambda x: x * x)) * total(F.transform(_signed(b), lambda x: x * x))
    return F.when(a == b, 1.0).when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / F.sqrt(norm)))).otherwise(0.0)


def id_ranges(docs: DataFrame, rows: int = RANGE_ROWS) -> Column:
    """The number of the range of doc_id that a row is in (-1: null). At most MOST_RANGES bounds go to the driver and back."""
    n = docs.count()
    parts = min(MOST_RANGES, max(1, math.ceil(n / rows)))
    bounds = sorted(set(docs.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    bounds = [int(b) for b in bounds]
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not groups:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("doc_id")))
    g = F.greatest(F.lit(1), below(longs([x[0] for x in groups])))  # two levels of a search tree
    inside = below(F.element_at(F.array(*map(longs, groups)), g))
    return F.when(F.col("doc_id").isNull(), -1).otherwise((g - 1) * step + inside).cast("int")


def with_next(docs: DataFrame, columns: list[str], ranges: Column, made: dict[str, Column] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with the columns `made`, and next_<c> for each c of columns: the value in the next row by descending doc_id.

    The rows go to their range of ids, once. The row that follows a range's last one is the head of the next range (of
    the first one, in the end), and goes along as a sentinel. Rows with the same doc_id follow each other by text hash.
    """
    docs = docs.withColumn("_range", ranges).withColumn("_h", F.xxhash64("text"))
    heads = docs.groupBy("_range").agg(F.max(F.struct("doc_id", "_h")).alias("_head"))
    down = W.partitionBy(F.lit(0)).orderBy(F.col("_range").desc())  # a row a range
    everything = down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = heads.select("_head", F.coalesce(F.lag("_range").over(down), F.min("_range").over(everything)).alias("_to"))
    sentinels = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_head.doc_id")) & (F.col("_h") == F.col("_head._h")))
    sentinels = sentinels.dropDuplicates(["_to"]).withColumn("_range", F.col("_to")).drop("_head", "_to")
    # what takes work is made of the sentinels that were found, not of all rows that are looked through for them
    rows = docs.withColumn("_last", F.lit(0)).unionByName(sentinels.withColumn("_last", F.lit(1))).withColumns(made or {})
    order = W.partitionBy("_range").orderBy("_last", F.col("doc_id").desc_nulls_last(), F.col("_h").desc())
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    return rows.where("_last = 0").drop("_last", "_range", "_h")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' rows with lanes and fingerprint; null and empty texts share the fingerprint of the empty multiset."""
    return docs.withColumn("lanes", fingerprint_lanes(F.col(text))).withColumn("fingerprint", fingerprint_text(F.col("lanes")))


def edited_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next row by descending doc_id.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    text; the last row is followed by the first. Null texts are empty; a single row follows itself; null ids come last;
    repeated ids follow each other in the order of a text hash; other columns take no part; an empty table gives none.
    """
    plain = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = id_ranges(plain.select("doc_id"))
    rows = with_next(plain, ["text", "lanes"], ranges, {"lanes": fingerprint_lanes(F.col("text"))})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", "lanes", "next_lanes", F.sha2("edited", 256).alias("edited_sha256"), fingerprint_lanes(F.col("edited")).alias("edited_lanes"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_text(F.col("lanes")).alias("fingerprint"),
        fingerprint_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
