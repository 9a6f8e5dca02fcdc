"""Approximate nearest neighbours: a forest of random-projection trees searched through one priority queue a query.

The forest is fitted on the driver from a hash-random sample of at most SAMPLE vectors, so its size is bounded; every
vector is indexed, in the tasks. A query walks all trees at once: a queue ordered by the largest margin on the way to a
branch gives the next most promising one of any tree. It ends where the margin is more than a neighbour is likely to lie
off in one direction (by the query's distance to the sample), or when the leaves reached hold enough rows. Its leaves'
rows are then ranked by the exact cosine.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SAMPLE = 20_000
TREES = 4
LEAF = 400
#: A query's search ends at margins of REACH * (distance of its k-th nearest sampled vector) / sqrt(dimension), but
#: not before its leaves hold LEAST rows, or at leaves that hold FACTOR * n ** POWER rows (both counted once a tree).
REACH = 1.0
FACTOR, POWER = 8.0, 0.8
LEAST = 2000
#: Rows, and queries, of a leaf that meet in one task; a larger leaf is split, and all its blocks are searched.
BLOCK, QUERIES = 5000, 20_000
#: Pairs whose exact measure is taken at once.
PAIRS = 100_000


class Forest:
    """Arrays per tree: normal, offset, children (>= 0: node, < 0: leaf -1 - i)."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: float, seed: int = 1):
        self.trees = []
        self.sample = sample.astype(np.float32)
        self.leaves = 0
        for t in range(trees):
            rng = np.random.default_rng([seed, t])
            normals, offsets, kids = [], [], []

            def grow(rows: np.ndarray) -> int:
                if len(rows) <= leaf or len(rows) < 2:
                    self.leaves += 1
                    return -self.leaves
                for _ in range(5):
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    normal = a - b
                    if np.abs(normal).max() > 1e-12:
                        break
                else:
                    normal = rng.standard_normal(sample.shape[1])
                normal = normal / np.sqrt((normal * normal).sum())
                side = sample[rows] @ normal
                offset = float(np.median(side))
                right = side > offset
                if not right.any() or right.all():
                    self.leaves += 1
                    return -self.leaves
                me = len(normals)
                normals.append(normal), offsets.append(offset), kids.append([0, 0])
                kids[me] = [grow(rows[~right]), grow(rows[right])]
                return me

            root = grow(np.arange(len(sample)))
            self.trees.append((np.array(normals).reshape(-1, sample.shape[1]), np.array(offsets), np.array(kids).reshape(-1, 2), root))

    def leaf_of(self, x: np.ndarray, t: int) -> np.ndarray:
        normals, offsets, kids, root = self.trees[t]
        node = np.full(len(x), root)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            right = np.einsum("ij,ij->i", x[inner], normals[at]) > offsets[at]
            node[inner] = kids[at, right.astype(int)]
        return -1 - node

    def reach(self, q: np.ndarray, k: int) -> np.ndarray:
        """How far in one direction each query's k nearest are likely to lie off, by its distances to the sample."""
        k = min(k, len(self.sample) - 1)  # counted from 0: the query itself may be in the sample
        near = np.partition(q.astype(np.float32) @ self.sample.T, len(self.sample) - 1 - k, axis=1)[:, len(self.sample) - 1 - k]
        return REACH * np.sqrt(np.maximum(0.0, 2 - 2 * near.astype(np.float64)) / q.shape[1])

    def search(self, q: np.ndarray, sizes: np.ndarray, rows: int, least: int = 0, reach: float = np.inf) -> list[int]:
        """Leaves in the order of the shared queue, until they hold `rows`, or `least` and the margin is above `reach`."""
        queue = [(-np.inf, t, root) for t, (_, _, _, root) in enumerate(self.trees)]
        margins = [normals @ q - offsets if len(offsets) else None for normals, offsets, _, _ in self.trees]
        out, seen = [], 0
        while queue and seen < rows:
            cost, t, node = heapq.heappop(queue)
            if cost > reach and seen >= least:
                break
            while node >= 0:
                m = margins[t][node]
                near, far = (1, 0) if m > 0 else (0, 1)
                heapq.heappush(queue, (max(cost, abs(m)), t, int(self.trees[t][2][node, far])))
                node = int(self.trees[t][2][node, near])
            out.append(-1 - node)
            seen += int(sizes[-1 - node])
        return out


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """Without vectors that are null, zero, or have null or non-finite components."""
    e = F.col("embedding").cast("array<double>")
    ok = F.size(e) > 0
    ok = ok & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return vectors.where(F.col("embedding").isNotNull()).select("vec_id", e.alias("embedding")).where(ok)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, trees: int = TREES, leaf: int = LEAF, factor: float = FACTOR, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found, by cosine in double precision, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`, candidates all rows but the query's own. Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do those of another length than most (the
    shorter, if as many), nor rows without a vec_id. Of equal vectors only the k + 1 smallest ids are indexed: the others can't
    be among anyone's k nearest. Repeated rows of one vec_id are one candidate. Fewer than k candidates give them all;
    an empty table gives an empty result; other columns take no part.
    """
    good = valid_vectors(vectors).where("vec_id is not null")
    lengths = good.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = lengths or (1, 0)
    good = good.where(F.size("embedding") == dim)
    sampled = good.orderBy(F.xxhash64(F.lit(9), "vec_id"), "vec_id").limit(SAMPLE).collect()
    sample = np.array([r["embedding"] for r in sampled], np.float64).reshape(-1, dim)
    sample = sample / np.maximum(np.abs(sample).max(axis=1, keepdims=True), 1e-300)
    sample = sample / np.sqrt((sample * sample).sum(axis=1, keepdims=True))
    # a leaf of `leaf` rows has so many sampled ones; at least 4, so that the forest stays within the sample's size
    forest = Forest(sample, trees, max(4.0, leaf * len(sample) / max(n, 1)))
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast(forest)

    def unit(column: pd.Series) -> np.ndarray:
        x = np.array(column.tolist(), np.float64).reshape(len(column), dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def index(batches):
        for batch in batches:
            x = unit(batch["embedding"])
            for t in range(trees):
                yield pd.DataFrame({"leaf": shared.value.leaf_of(x, t), "vec_id": batch["vec_id"], "embedding": batch["embedding"]})

    same = W.partitionBy("embedding").orderBy("vec_id")
    distinct = good.dropDuplicates(["vec_id"]).withColumn("_k", F.row_number().over(same)).where(F.col("_k") <= k + 1)
    rows = written(distinct.select("vec_id", "embedding").mapInPandas(index, "leaf int, vec_id long, embedding array<double>"))
    counts = {r["leaf"]: r["n"] for r in rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most a row per leaf of the forest
    sizes = np.zeros(forest.leaves, np.int64)
    sizes[list(counts)] = list(counts.values())
    budget = max(least, int(factor * n**POWER))
    sizes_shared = context.broadcast(sizes)

    queries = good.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    chunks = max(1, -(-queries.count() // QUERIES))

    def probe(batches):
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                x = unit(part["embedding"])
                for q, e, raw, reach in zip(part["vec_id"], x, part["embedding"], shared.value.reach(x, k), strict=True):
                    found = shared.value.search(e, sizes_shared.value, budget, least, reach)
                    # leaves that hold more rows than fit in a task are split into blocks, which are all searched
                    keys = [(leaf, b) for leaf in found for b in range(-(-int(sizes_shared.value[leaf]) // BLOCK))]
                    yield pd.DataFrame({"leaf": [x for x, _ in keys], "block": [b for _, b in keys], "query_id": q, "query": [raw] * len(keys)})

    probes = queries.mapInPandas(probe, "leaf int, block int, query_id long, query array<double>").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
    blocks = context.broadcast(np.maximum(1, -(-sizes // BLOCK)))

    @F.pandas_udf("int")
    def block_of(leaf: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(np.mod(h.to_numpy(), blocks.value[leaf.to_numpy()])).astype("int32")

    rows = rows.withColumn("block", block_of("leaf", F.xxhash64("vec_id"))).withColumn("chunk", F.explode(F.array(*(F.lit(i) for i in range(chunks)))) if chunks > 1 else F.lit(0))

    def rank(_, qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(xs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, x, ids, asked = unit(qs["query"]), unit(xs["embedding"]), xs["vec_id"].to_numpy(), qs["query_id"].to_numpy()
        raw_q, raw_x = (np.array(c.tolist(), np.float64).reshape(len(c), dim) for c in (qs["query"], xs["embedding"]))
        out = []
        for i in range(0, len(q), 256):
            near = q[i : i + 256] @ x.T
            near[asked[i : i + 256, None] == ids[None]] = -np.inf
            m = min(len(ids), k)
            # all that may be among the k by the exact measure: sums of a matrix product differ in the last bits
            low = np.maximum(np.partition(near, len(ids) - m, axis=1)[:, len(ids) - m, None] - 1e-9, -2.0)
            row, at = np.nonzero(near >= low)
            score = np.concatenate([cosine(raw_q[row[j : j + PAIRS] + i], raw_x[at[j : j + PAIRS]]) for j in range(0, max(len(row), 1), PAIRS)])
            row = row + i
            order = np.lexsort((ids[at], -score, row))
            row, at, score = row[order], at[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best = place < k
            out.append(pd.DataFrame({"query_id": asked[row[best]], "vec_id": ids[at[best]], "score": score[best]}))
        return pd.concat(out)

    keys = ("leaf", "block", "chunk")
    found = probes.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double").distinct()
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with that of b, the same for equal rows wherever they stand."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    bad = ~np.isfinite(score) | (score == 0)
    if bad.any():  # components so large or small that squares leave the range: scale first
        a, b = (v[bad] / np.abs(v[bad]).max(axis=1, keepdims=True) for v in (a, b))
        score[bad] = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    return np.clip(score, -1.0, 1.0)
