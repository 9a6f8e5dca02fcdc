"""Mixing sources to target weights, without a sort of everything and without one task per source.

Documents get a hash-random key. Each source is cut into ranges of that key, as many as its size asks for, so that a
source with a third of all rows is spread like the others. Sums per range, their prefix sums, then running sums within
a range give each document its place in the source's random order; the place decides how many of its words are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, written

#: Code points that are no part of a word: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 5_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size, rows; one row a source) with target.

    Sources by code point (null last) weigh `weights`, repeating. Targets share `share` of all sizes by weight; none is
    above `most` times its source's size, and what is cut off goes to the others by weight. Repeating that to the end
    gives min(most * size, level * weight) for one level: sources in order of most * size / weight fill up first, so
    the level comes from running sums over the sources. Sources without words have the target 0.
    """
    everything = W.partitionBy(F.lit(0))  # one row a source
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int"))
    by_fill = everything.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    x = sizes.withColumn("weight", weight).withColumn("fill", most * F.col("source_size") / F.col("weight"))
    x = x.withColumn("total", share * F.sum("source_size").over(everything))
    left = F.col("total") - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    x = x.withColumn("level", left / open_weight)
    # the first source that doesn't fill up at the level of those still open sets the level for itself and all after it
    x = x.withColumn("final", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(everything)["level"])
    return x.withColumn("target", F.least(most * F.col("source_size"), F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("weight")).cast("double")).select("source", "source_size", "rows", "target")


def mix(docs: DataFrame, size: str = "size", weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11, sizes: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, source, `size`, ...) with source_size, target and taken.

    A source's target is met to the word: floor(target / source_size) whole epochs, then the documents in random order
    up to the rest; the one on the border is taken in part. taken counts repeats and is at most ceil(most) * size.
    Null sources are one source of their own, null sizes count as 0, repeated rows are taken by themselves, ties in the
    key fall by doc_id. An empty table gives an empty one. Columns of docs with the added names are replaced, all others
    stay, whatever their names. `sizes` is the same rows as (doc_id, source, `size`) alone: where a size takes work, give
    them written, so that sums don't look at every text again.
    """
    added = ("source_size", "target", "taken")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in added))
    key, ranges, at, start, source, own = (free_name(docs, n) for n in ("_key", "_ranges", "_range", "_start", "_source", "_r"))
    sizes = docs if sizes is None else sizes

    def keyed(x: DataFrame) -> DataFrame:
        # 32 bits of the hash choose the range, all 64 the order within
        return x.withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("long")).withColumn(key, F.xxhash64(F.lit(seed), "doc_id"))

    sizes = keyed(sizes.select("doc_id", "source", size))
    per_source = sizes.groupBy("source").agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("rows"))
    # small tables are written, so that Spark knows their size and doesn't shuffle whole documents to join them
    targets = written(source_targets(per_source, weights, share, most).select(F.col("source").alias(source), "source_size", "target", F.ceil(F.col("rows") / RANGE_ROWS).cast("long").alias(ranges)))
    high = F.shiftrightunsigned(F.col(key), 32)

    def placed(x: DataFrame) -> DataFrame:
        x = x.join(targets, F.col("source").eqNullSafe(F.col(source))).drop(source)
        return x.withColumn(at, F.floor(high * F.col(ranges) / float(1 << 32)).cast("long"))

    sums = placed(sizes).groupBy("source", at).agg(F.sum(size).alias("_sum"))
    upto = W.partitionBy("source").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    starts = written(sums.select(F.col("source").alias(source), F.col(at).alias(own), F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias(start)))
    docs = placed(keyed(docs)).join(starts, F.col("source").eqNullSafe(F.col(source)) & (F.col(at) == F.col(own))).drop(source, own)
    inside = W.partitionBy("source", at).orderBy(high, key, F.col("doc_id").asc_nulls_last(), size).rowsBetween(W.unboundedPreceding, -1)
    before = F.col(start) + F.coalesce(F.sum(size).over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - epochs * F.col("source_size")).cast("long")
    taken = epochs * F.col(size) + F.greatest(F.lit(0), F.least(F.col(size), rest - before))
    return docs.withColumn("taken", taken.cast("long")).drop(key, ranges, at, start)


def sized(docs: DataFrame, text: str, size: str) -> DataFrame:
    """doc_id, source and the number of words, written: texts are read for it once."""
    return written(docs.select("doc_id", "source", word_count(text).alias(size)))


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix as documents: a row for each time that one is taken, the last perhaps cut to its first words.

    Documents of which nothing is taken go. All columns of docs stay as they are; a text that is cut ends after a word.
    Each text is shuffled once, to its range of the random order.
    """
    columns = docs.columns
    inner = docs.select("doc_id", "source", *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)))
    body = f"k{columns.index(text)}"
    out = mix(inner.withColumn("size", word_count(body)), sizes=sized(docs, text, "size"), **options).where("taken > 0")
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    none = F.array().cast("array<bigint>")
    out = out.withColumn("words", F.explode(F.concat(F.array_repeat(F.col("size"), whole), F.when(rest > 0, F.array(rest)).otherwise(none))))
    pieces = F.split(F.col(body), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each word with the space before it
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")
    out = out.withColumn(body, F.when(F.col("words") < F.col("size"), cut).otherwise(F.col(body)))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(columns)))
