"""Near-duplicate documents by a chosen-path similarity join, confirmed on full shingle sets.

1. Each document becomes its set of shingles (64-bit hashes) and a minwise signature. Equal sets are one class from here on.
2. Each tree of the forest branches the classes: a node chooses BRANCHES signature places at random, and a class goes to
   the child of each chosen place and its own minwise token there. A class and one that is similar share a child with
   the probability of their similarity. Small nodes are compared exhaustively by sketch; larger ones branch again.
3. A larger node whose members mostly look like its pivot, its oldest document, is a family of near copies. It would not
   get smaller by branching, so it ends here: its members are paired with the pivot (a star, not all pairs). What is
   still in another component than the pivot after that is a query against all members of the pivot's families.
4. Pairs are confirmed on full sets: the stars and each class with its best candidate first, then all other candidates
   that still lie between components. Pairs inside a component can't change the result and cost nothing. The queries of
   step 3 are compared with the members in blocks, on full sets too; only links between components leave a block.

A pair with the threshold's similarity shares no node of a tree with a probability of 4 %, and of TREES trees below 1e-6.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import U64, bitmap, maybe_in, mixed, shingle_sets, written
from .graph import connected_components

PLACES = 64
TREES = 5
BRANCHES = 2
#: Nodes of so many classes at most are compared as a whole, larger ones branch, up to DEPTH times; what is then still
#: larger goes the way of step 3 with all its members as queries. None of the three changes a result.
SMALL = 64
DEPTH = 4
#: Classes, and shingles, in a block of queries or members.
BLOCK, BLOCK_SHINGLES = 1024, 400_000
_ODD = np.random.default_rng(77).integers(1, 1 << 63, PLACES, dtype=np.uint64) * U64(2) + U64(1)
def signature(found: np.ndarray) -> np.ndarray:
    """Minwise values of a set under PLACES hash functions, 32 bits each."""
    low = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):
        np.minimum(low, np.multiply.outer(_ODD, found[i : i + 2048]).min(axis=1), out=low)
    return (low >> U64(32)).astype("<u4")


def set_key(found: np.ndarray) -> int:
    return int(mixed(found).sum(dtype=np.uint64).view(np.int64)) if len(found) else 0


def shingle_features(docs: DataFrame, text: str, words: int) -> DataFrame:
    """doc_id, n_shingles, cid (the set's key), sig (256 bytes), sketch (64)."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist(), words)
            out = pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": [len(s) for s in sets], "cid": [set_key(s) for s in sets], "sig": [signature(s).tobytes() if len(s) else b"" for s in sets]})
            out["sketch"] = [s[::4] for s in out["sig"]]  # the low byte of each value
            yield out

    return docs.select("doc_id", F.col(text).alias("text")).mapInPandas(run, "doc_id long, n_shingles long, cid long, sig binary, sketch binary")


def similar(sketches: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may reach the threshold: sizes allow it, and the sketch isn't four deviations below it."""
    least = percent / 100
    ok = 100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])
    need = PLACES * (least - 4 * np.sqrt(least * (1 - least) / PLACES))
    ok[ok] = (sketches[i[ok]] == sketches[j[ok]]).sum(axis=1) >= need
    return ok


def branched(rows: DataFrame) -> DataFrame:
    """rows (cid, sig, node, path) -> (cid, node, path) of their children: BRANCHES different places of each node, none of its path.

    path has a bit for each place that led to a node. A place of the path would move the whole node to one child, and
    the same place twice would give that child every class twice.
    """
    free = F.filter(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda p: F.getbit("path", p) == 0)
    order = F.array_sort(F.transform(free, lambda p: F.struct(F.xxhash64("node", p).alias("h"), p.alias("p"))))
    chosen = rows.select("node", "path").distinct().select("node", F.slice(order, 1, BRANCHES)["p"].alias("chosen"))
    token = lambda p: F.substring(F.col("sig"), 4 * p + 1, F.lit(4))
    child = lambda p: F.struct(F.xxhash64("node", p, token(p)).alias("node"), F.col("path").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p)).alias("path"))
    return rows.join(chosen, "node").select("cid", F.explode(F.transform("chosen", child)).alias("x")).select("cid", "x.*")


def small_node_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """rows (node, cid, n_shingles, sketch) -> candidate pairs (a, b, alike) of nodes with at most SMALL members."""

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        node, cid, n = (part[c].to_numpy() for c in ("node", "cid", "n_shingles"))
        sketch = np.frombuffer(b"".join(part["sketch"]), np.uint8).reshape(len(part), -1)
        found = []
        for step in range(1, SMALL):
            i = np.flatnonzero(node[:-step] == node[step:])
            if not len(i):
                break
            i = i[similar(sketch, n, i, i + step, percent)]
            j = i + step
            found.append(np.stack([np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j]), (sketch[i] == sketch[j]).sum(axis=1)]))
        a, b, alike = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        return pd.DataFrame({"a": a, "b": b, "alike": alike.astype(np.int32)}).drop_duplicates(["a", "b"])

    def run(batches):
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            split = int(np.searchsorted(batch["node"].to_numpy(), batch["node"].iloc[-1], "left")) if len(batch) else 0
            if split:
                yield pairs(batch.iloc[:split])
            rest = batch.iloc[split:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield pairs(rest)

    return rows.repartition("node").sortWithinPartitions("node").mapInPandas(run, "a long, b long, alike int")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with linked: whether their full sets reach the threshold.

    The pairs are written first: when they are few, Spark knows it and leaves the sets where they are.
    """
    x = written(pairs.select("a", "b"))
    x = x.join(sets.select(F.col("cid").alias("b"), F.col("found").alias("set_b")), "b").join(sets.select(F.col("cid").alias("a"), F.col("found").alias("set_a")), "a")
    both = F.size(F.array_intersect("set_a", "set_b"))
    x = x.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("total"))
    return x.select("a", "b", (100 * F.col("both") >= percent * (F.col("total") - F.col("both"))).alias("linked"))


def block_links(queries: pd.DataFrame, members: pd.DataFrame, percent: int, possible: np.ndarray | None = None) -> pd.DataFrame:
    """Links (a, b) on full sets between queries and members (cid, part, found) of other parts: one for each two parts.

    possible: which pairs may be linked at all; queries without one aren't compared.
    """
    if possible is not None:
        queries, members = queries[possible.any(axis=1)], members[possible.any(axis=0)]
    if not len(queries) or not len(members):
        return pd.DataFrame({"a": [], "b": []})
    tokens = np.unique(np.concatenate(queries["found"].tolist()))
    flat = np.concatenate(members["found"].tolist())
    sizes = np.array([len(s) for s in members["found"]])
    row = np.repeat(np.arange(len(members)), sizes)
    at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
    shared = tokens[at] == flat  # what no query has counts only in the sizes
    at, row = at[shared], row[shared]
    cid, part = members["cid"].to_numpy(), members["part"].to_numpy()
    mark = np.zeros(len(tokens), np.int64)
    a, b, x, y = [], [], [], []
    for q, q_part, found in zip(queries["cid"], queries["part"], queries["found"], strict=True):
        own = np.searchsorted(tokens, found)
        mark[own] = 1
        both = np.bincount(row, mark[at], len(members)).astype(np.int64)
        mark[own] = 0
        hits = np.flatnonzero((100 * both >= percent * (sizes + len(found) - both)) & (part != q_part))
        hits = hits[np.unique(part[hits], return_index=True)[1]]
        a += [q] * len(hits)
        b += cid[hits].tolist()
        x += [q_part] * len(hits)
        y += part[hits].tolist()
    out = pd.DataFrame({"a": a, "b": b, "x": x, "y": y}, dtype=np.int64)
    return out.drop_duplicates(["x", "y"])[["a", "b"]]


def group_links(groups: DataFrame, parts: DataFrame, sets: DataFrame, percent: int, compare=block_links) -> DataFrame:
    """groups (grp, cid, hub) -> links (a, b): members that aren't in the hub's part (all, if hub is null) against all of the group.

    A group's queries and members are dealt into blocks, and each block of queries meets each block of members in a
    task; a group costs its queries times its members, without a row for a pair.
    """
    part = lambda name, key: parts.select(F.col("id").alias(key), F.col("component").alias(name))
    x = groups.join(part("part", "cid"), "cid", "left").join(part("hub_part", "hub"), "hub", "left")
    x = x.select("grp", "cid", F.coalesce("part", "cid").alias("part"), (F.coalesce("hub_part", "hub").isNull() | (F.coalesce("part", "cid") != F.coalesce("hub_part", "hub"))).alias("asks"))
    x = written(x.join(sets.select("cid", F.size("found").alias("n")), "cid"))
    blocks = lambda rows, n: F.greatest(F.ceil(rows / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    asks = F.col("asks").cast("int")
    dealt = x.groupBy("grp").agg(blocks(F.sum(asks), F.sum(asks * F.col("n"))).alias("of_q"), blocks(F.count(F.lit(1)), F.sum("n")).alias("of_m")).where("of_q > 0")
    x = x.join(dealt, "grp").join(sets, "cid")
    place = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = x.where("asks").select("grp", place("of_q").alias("q"), every("of_m").alias("m"), "cid", "part", "found", "asks")
    members = x.select("grp", every("of_q").alias("q"), place("of_m").alias("m"), "cid", "part", "found", F.lit(False).alias("asks"))

    def links(block: pd.DataFrame) -> pd.DataFrame:
        return compare(block[block["asks"]], block[~block["asks"]], percent)

    return queries.union(members).groupBy("grp", "q", "m").applyInPandas(links, "a long, b long")


def alike_count(a: str, b: str) -> Column:
    """In how many places two signatures agree."""

    @F.pandas_udf("int")
    def count(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(v), "<u4").reshape(len(v), PLACES) for v in (x, y))
        return pd.Series((x == y).sum(axis=1).astype(np.int32))

    return count(F.col(a), F.col(b))


def between(pairs: DataFrame, parts: DataFrame | None) -> DataFrame:
    """pairs (a, b, alike) with part_a and part_b, the components of their ends, where these differ."""
    if parts is None:
        return pairs.withColumns({"part_a": F.col("a"), "part_b": F.col("b")})
    x = pairs.join(parts.select(F.col("id").alias("a"), F.col("component").alias("part_a")), "a", "left")
    x = x.join(parts.select(F.col("id").alias("b"), F.col("component").alias("part_b")), "b", "left")
    x = x.withColumns({"part_a": F.coalesce("part_a", "a"), "part_b": F.coalesce("part_b", "b")})
    return x.where("part_a <> part_b")


def best_pairs(pairs: DataFrame) -> DataFrame:
    """Of each component one pair (a, b): to the smallest end of those that surely reach the threshold, else the most alike.

    So the members of a family mostly choose the same partner, and are connected after one round.
    """
    sure = F.col("alike") >= int(PLACES * 0.9)
    order = F.struct(F.when(sure, 0).otherwise(1), F.when(sure, F.least("a", "b")).otherwise(-F.col("alike").cast("long")), "a", "b")
    ends = pairs.select("a", "b", order.alias("order"), F.explode(F.array("part_a", "part_b")).alias("part"))
    return ends.groupBy("part").agg(F.min_by(F.struct("a", "b"), "order").alias("p")).select("p.a", "p.b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs' doc_id with n_shingles, component_id (the smallest doc_id linked to it, over any number of links), kept.

    Two documents are linked if 100 * intersection >= percent * union of their sets of `words`-word shingles. A text of
    fewer words is one shingle; a null text or one without words has an empty set and no links. Rows with the same
    doc_id share nothing but what their texts share; equal rows are all kept or all not. A null doc_id is part of its
    class, but names no component: a component of null ids alone has a null id and its rows are kept. Columns of docs
    other than doc_id and the text take no part. An empty table gives an empty one.
    """
    feats = written(shingle_features(docs, text, words))
    classes = written(feats.where("n_shingles > 0").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")))
    threshold = percent / 100
    # a set of n shingles is linked to one of n + 1 at most if n / (n + 1) reaches the threshold; smaller ones are linked to equal ones only
    least = -(-percent // max(1, 100 - percent))
    roots = F.array(*(F.struct(F.xxhash64(F.lit(t), F.lit(p), F.substring("sig", 4 * p + 1, 4)).alias("node"), F.lit(1 << p).cast("long").alias("path")) for t in range(TREES) for p in range(t * BRANCHES, (t + 1) * BRANCHES)))
    rows = written(classes.where(F.col("n_shingles") >= least).select("cid", F.explode(roots).alias("x")).select("cid", "x.*"))
    small, stars, groups = [], [], []
    for depth in range(1, DEPTH + 1):
        seen = Observation()
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        members = written(rows.join(counts, "node").observe(seen, F.max("n").alias("most")))
        small.append(written(small_node_pairs(members.where(F.col("n") <= SMALL).join(classes, "cid").select("node", "cid", "n_shingles", "sketch"), percent)))
        if (seen.get["most"] or 0) <= SMALL:
            break
        big = members.where(F.col("n") > SMALL).join(classes.select("cid", "doc_id"), "cid")
        pivots = big.groupBy("node").agg(F.min_by("cid", F.struct(F.col("doc_id").isNull(), "doc_id", "cid")).alias("pivot"))
        pivots = pivots.join(classes.select(F.col("cid").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")
        big = written(big.select("cid", "node", "path").join(classes.select("cid", "sig"), "cid").join(pivots, "node").select("node", "path", "cid", "pivot", alike_count("sig", "pivot_sig").alias("alike")))
        alike = F.col("alike") >= PLACES * (threshold - 0.2)
        families = big.groupBy("node").agg((F.avg(alike.cast("int")) >= 0.5).alias("family"))
        big = big.join(families, "node")
        stars.append(big.where("family").select("cid", "pivot", "alike"))
        groups.append(big.where("family").select(F.col("pivot").alias("grp"), "cid", F.col("pivot").alias("hub")))
        rest = big.where("not family")
        if depth == DEPTH:
            groups.append(rest.select(F.col("node").alias("grp"), "cid", F.lit(None).cast("long").alias("hub")))
            break
        rows = written(branched(rest.join(classes.select("cid", "sig"), "cid")))
    pairs = written(union(small).groupBy("a", "b").agg(F.max("alike").alias("alike")))
    star = written(union(stars).groupBy("cid", "pivot").agg(F.max("alike").alias("alike"))) if stars else None
    groups = written(union(groups).distinct()) if groups else None

    return resolved(docs, text, words, percent, feats, classes, pairs, star, groups)


def resolved(docs: DataFrame, text: str, words: int, percent: int, feats: DataFrame, classes: DataFrame, pairs: DataFrame, star: DataFrame | None, groups: DataFrame | None, compare=block_links) -> DataFrame:
    """The documents' components, from candidates that are confirmed on full sets.

    feats (doc_id, n_shingles, cid) has a row a document, classes (cid, doc_id) one a set. Candidates are pairs (a, b, alike:
    agreement out of PLACES), star (cid, pivot, alike), and groups (grp, cid, hub) of which all pairs are candidates.
    """
    # full sets of all classes that have candidates
    ends = [pairs.select("a"), pairs.select("b")] + ([groups.select("cid")] if groups is not None else [])
    wanted = written(union(ends).toDF("cid").distinct().join(classes.select("cid", "doc_id"), "cid"))

    def sets_of(batches):
        for batch in batches:
            found = shingle_sets(batch["text"].tolist(), words)
            yield pd.DataFrame({"cid": [set_key(s) for s in found], "found": [s.view(np.int64) for s in found]})

    rid = F.xxhash64("doc_id").alias("rid")  # null ids, which name no class, share one
    sets = maybe_in(docs.select(rid, F.col(text).alias("text")), bitmap(wanted.select(rid))).where("maybe").select("text").mapInPandas(sets_of, "cid long, found array<long>")
    sets = written(sets.join(wanted.select("cid"), "cid", "left_semi").groupBy("cid").agg(F.first("found").alias("found")))

    first = best_pairs(between(pairs, None))
    if star is not None:
        likely = star.where(F.col("cid") != F.col("pivot")).where(F.col("alike") >= PLACES * (percent / 100 - 0.08))
        first = first.union(likely.select(F.least("cid", "pivot"), F.greatest("cid", "pivot"))).distinct()
    tried = written(compared(first, sets, percent))
    parts = connected_components(tried.where("linked").select("a", "b"))
    found = [written(compared(between(pairs, parts).join(tried, ["a", "b"], "left_anti"), sets, percent).where("linked").select("a", "b"))]
    if groups is not None:
        found.append(written(group_links(groups, parts, sets, percent, compare)))
    parts = connected_components(union([parts.select(F.col("id").alias("a"), F.col("component").alias("b")), *found]))

    labels = classes.select("cid", F.col("doc_id").alias("_first")).join(parts.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    names = labels.groupBy("component").agg(F.min("_first").alias("component_id"))
    labels = written(labels.join(names, "component").select("cid", "component_id"))
    out = feats.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cid")).alias("cid")).join(labels, "cid", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)
