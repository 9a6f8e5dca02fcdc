"""One-to-one matching of scored pairs, without a scope in one task.

The result is that of a loop over all candidates in order, which takes a pair if neither end was taken before. Two steps find
the same pairs in parallel, as long as the order is total:

- A pair that comes first for both its ends is taken, wherever it stands in the order: nothing before it can take either end.
- The first BATCH pairs of a scope can be decided by themselves, as only earlier pairs matter to them.

Scopes of at most BATCH pairs end with the second step. Larger ones go through both in rounds, in which the other pairs of
taken ends go away.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..materialize import written

#: Pairs of a scope that one task decides at once.
BATCH = 50_000


def priority(candidates: DataFrame, order: list[tuple[str, bool]]) -> tuple[Column, bool]:
    """A struct that orders pairs like `order` (column, ascending), and whether the least comes first.

    Numbers and booleans are turned around where they go the other way; what can't be turned has to go one way.
    """
    turned = lambda c: isinstance(candidates.schema[c].dataType, (NumericType, BooleanType))
    fixed = {up for c, up in order if not turned(c)}
    if len(fixed) > 1:
        raise ValueError("columns that are neither numbers nor booleans have to be ordered in one direction")
    ascending = fixed.pop() if fixed else True

    def one(c: str, up: bool) -> Column:
        if up == ascending:
            return F.col(c)
        return ~F.col(c) if isinstance(candidates.schema[c].dataType, BooleanType) else -F.col(c)

    return F.struct(*(one(c, up).alias(f"o{i}") for i, (c, up) in enumerate(order))), ascending


def dominant(candidates: DataFrame, scope: list[str], order: list[tuple[str, bool]], ends: tuple[str, str]) -> DataFrame:
    """The pairs that come first for both their ends."""
    key, ascending = priority(candidates, order)
    first = F.min if ascending else F.max
    x = candidates.withColumn("_order", key)
    for i, end in enumerate(ends):
        best = x.groupBy(*scope, end).agg(first("_order").alias(f"_best{i}"))
        x = x.join(best, [*scope, end])
    return x.where("_order = _best0 and _order = _best1").select(*candidates.columns)


def first_batch(candidates: DataFrame, scope: list[str], order: list[tuple[str, bool]], ends: tuple[str, str]) -> DataFrame:
    """The pairs taken among the first BATCH of each scope."""
    def choose(batches):
        scope_now, left, right = None, set(), set()
        for batch in batches:
            keep = []
            for key, g, p in zip(zip(*(batch[c] for c in scope), strict=True), batch[ends[0]], batch[ends[1]], strict=True):
                if key != scope_now:
                    scope_now, left, right = key, set(), set()
                free = g not in left and p not in right
                keep.append(free)
                if free:
                    left.add(g), right.add(p)
            yield batch[np.array(keep, bool)]

    place = F.row_number().over(W.partitionBy(*scope).orderBy(*(F.asc(c) if a else F.desc(c) for c, a in order)))
    first = candidates.repartition(*scope).withColumn("_place", place).where(F.col("_place") <= BATCH)
    # all of a scope is in one partition, scope by scope and in order: one pass decides however many small scopes there are
    chosen = first.sortWithinPartitions(*scope, "_place").mapInPandas(choose, first.schema)
    return chosen.select(*candidates.columns)


def without_ends(candidates: DataFrame, taken: DataFrame, scope: list[str], ends: tuple[str, str]) -> DataFrame:
    for end in ends:
        candidates = candidates.join(taken.select(*scope, end), [*scope, end], "left_anti")
    return candidates


def greedy(candidates: DataFrame, scope: list[str], order: list[tuple[str, bool]], ends: tuple[str, str] = ("gold_idx", "pred_idx")) -> DataFrame:
    """One-to-one pairs: each candidate in order (column, ascending) is taken if neither of its ends was taken before.

    The order has to be total within a scope; candidates never cross scopes, and none of the columns of scope, order and
    ends is null. Candidates are written once; no candidates give no pairs.
    """
    x = written(candidates)
    large = written(x.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BATCH).select(*scope))
    if not large.take(1):
        return first_batch(x, scope, order, ends)
    found = [first_batch(x.join(large, scope, "left_anti"), scope, order, ends)]
    rest = written(x.join(large, scope, "left_semi"))
    while True:
        for step in (dominant, first_batch):
            taken = written(step(rest, scope, order, ends))
            found.append(taken)
            seen = Observation()
            rest = written(without_ends(rest, taken, scope, ends).select(*candidates.columns).observe(seen, F.count(F.lit(1)).alias("n")))
            if not seen.get["n"]:
                return reduce(DataFrame.unionByName, found)
