"""N-gram Jaccard join by signature trees.

1. Each document becomes its set of shingles; equal sets are one class from here on.
2. A linked pair shares one of the first size - least overlap + 1 shingles of either set in any common order (prefix filter,
   exact). The order puts the corpus's commonest shingles last, so that a shared passage seldom brings documents together.
   The classes with a prefix shingle in common are a group; groups with the same members are one.
3. A node of a signature tree holds the OR of its members' token bitmaps and the range of their sizes. What a set has bits
   for and a node hasn't can't be shared, so a pair of nodes whose largest possible overlap is below what their smallest
   sizes ask for is pruned (exact). Groups of LEAF classes are leaves, of which all pairs of members meet as bitmaps.
4. Larger groups are dealt into blocks. Members that their bitmaps keep from the group's pivot are queries: trees over them and
   trees over all members are traversed together, and members without a possible partner leave the group. The others are
   compared on full sets, those that aren't linked to the pivot with all, again by trees.

Candidates are confirmed on full sets, as in `near_dup.resolved`; pairs inside a component can't change the result and
aren't compared. No step loses a linked pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bitmap, maybe_in, shingle_sets, written
from .near_dup import BLOCK, PLACES, block_links, resolved, set_key

#: 64-bit words of a bitmap; members of a leaf; children of an upper node.
WORDS, LEAF, FAN = 16, 64, 8
#: Sets of more tokens than this have a bitmap of their own size, too.
WIDE = 512
#: Documents of a batch that have to share a shingle for it to be counted, and how many of the commonest are put last.
COMMON, RANKED = 4, 1 << 18


def token_bits(tokens: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A set's bitmap: one bit a token, by its low bits, so that a wide bitmap folds to a narrow one."""
    place = tokens & U64(64 * words - 1)
    out = np.zeros(words, np.uint64)
    np.bitwise_or.at(out, (place >> U64(6)).astype(np.int64), U64(1) << (place & U64(63)))
    return out


def own_bits(tokens: np.ndarray) -> np.ndarray:
    """A set's bitmap with two to four bits a token if it has over WIDE, so that long sets don't fill it."""
    return token_bits(tokens, (1 << int(2 * len(tokens) - 1).bit_length()) >> 6) if len(tokens) > max(WIDE, 32 * WORDS) else token_bits(tokens)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) with at most so many words."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def widely_alike(x: bytes | None, n: int, y: bytes | None, m: int, percent: int) -> bool:
    """Whether wide bitmaps, the larger one folded to the size of the other, allow a link."""
    if x is None or y is None:
        return True
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    words = min(len(a), len(b))
    return bool(most_overlap(folded(a, words), n, folded(b, words), m) >= least_overlap(n, m, percent))


def wide_bits(tokens: np.ndarray) -> bytes | None:
    found = own_bits(tokens)
    return found.tobytes() if len(found) > WORDS else None


def least_overlap(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that sets of these sizes need: the least o with 100 * o >= percent * (x + y - o)."""
    return -(-percent * (x + y) // (100 + percent))


def most_overlap(bits_x: np.ndarray, sizes_x: np.ndarray, bits_y: np.ndarray, sizes_y: np.ndarray) -> np.ndarray:
    """No two sets can share more: each bit that the other hasn't is a token that it hasn't."""
    gone_x = np.bitwise_count(bits_x & ~bits_y).sum(axis=-1, dtype=np.int64)
    gone_y = np.bitwise_count(bits_y & ~bits_x).sum(axis=-1, dtype=np.int64)
    return np.minimum(sizes_x - gone_x, sizes_y - gone_y)


class Tree:
    """Levels of nodes over sets, leaves first: the OR of bitmaps, the range of sizes, and how many tokens share bits at most."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        bits, sizes = bits[self.order], sizes[self.order]
        self.bits, self.sizes = bits, sizes
        spare = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = []
        low, high, fan = sizes, sizes, LEAF
        while True:
            at = np.arange(0, len(bits), fan)
            bits, spare = np.bitwise_or.reduceat(bits, at), np.maximum.reduceat(spare, at)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((bits, low, high, spare))
            if len(at) == 1:
                break
            fan = FAN

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of the level below, and the place of each one's parent among nodes."""
        first = nodes * FAN
        n = np.minimum(first + FAN, len(self.levels[level - 1][0])) - first
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n), np.repeat(np.arange(len(nodes)), n)


def nodes_meet(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes may hold a linked pair: sizes allow it, and the bits that both have are enough."""
    bits_x, low_x, high_x, spare_x = (v[i] for v in x)
    bits_y, low_y, high_y, spare_y = (v[j] for v in y)
    fits = (100 * high_x >= percent * low_y) & (100 * high_y >= percent * low_x)
    both = np.bitwise_count(bits_x & bits_y).sum(axis=1, dtype=np.int64) + np.minimum(spare_x, spare_y)
    return fits & (both >= least_overlap(low_x, low_y, percent))


def dual_traversal(x: Tree, y: Tree, percent: int) -> np.ndarray:
    """Which pairs of sets (in the order given to the trees) may be linked, by traversing both trees from their roots."""
    a, b = len(x.levels) - 1, len(y.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(i):
        keep = nodes_meet(x.levels[a], y.levels[b], i, j, percent)
        i, j = i[keep], j[keep]
        if not a and not b:
            break
        if a >= b:
            below, parent = x.children(a, i)
            i, j, a = below, j[parent], a - 1
        else:
            below, parent = y.children(b, j)
            i, j, b = i[parent], below, b - 1
    out = np.zeros((len(x.sizes), len(y.sizes)), bool)
    for p, q in zip(i, j, strict=True):
        own, other = slice(p * LEAF, (p + 1) * LEAF), slice(q * LEAF, (q + 1) * LEAF)
        sx, sy = x.sizes[own][:, None], y.sizes[other][None]
        found = most_overlap(x.bits[own][:, None], sx, y.bits[other][None], sy) >= least_overlap(sx, sy, percent)
        out[np.ix_(x.order[own], y.order[other])] = found
    return out


def possible_pairs(x: list[np.ndarray], x_sizes: np.ndarray, y: list[np.ndarray], y_sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets their own bitmaps allow: sets are put into trees by the width of their bitmaps, and trees of near widths are traversed together."""
    out = np.zeros((len(x), len(y)), bool)
    widths_x, widths_y = (np.array([len(b) for b in side]) for side in (x, y))
    for w in np.unique(widths_x):
        for v in np.unique(widths_y):
            i, j, words = np.flatnonzero(widths_x == w), np.flatnonzero(widths_y == v), min(w, v)
            if 100 * x_sizes[i].max() >= percent * y_sizes[j].min() and 100 * y_sizes[j].max() >= percent * x_sizes[i].min():
                trees = (Tree(np.stack([folded(side[k], words) for k in at]), sizes[at]) for side, at, sizes in ((x, i, x_sizes), (y, j, y_sizes)))
                out[np.ix_(i, j)] = dual_traversal(*trees, percent)
    return out


def tree_links(queries: pd.DataFrame, members: pd.DataFrame, percent: int) -> pd.DataFrame:
    """`near_dup.block_links` for the pairs that a dual traversal of both sides' trees leaves."""
    if not len(queries) or not len(members):
        return pd.DataFrame({"a": [], "b": []})
    sides = []
    for side in (queries, members):
        sets = [np.asarray(s).view(np.uint64) for s in side["found"]]
        sides += [[own_bits(s) for s in sets], np.array([len(s) for s in sets], np.int64)]
    return block_links(queries, members, percent, possible_pairs(*sides, percent))


def group_survivors(big: DataFrame, percent: int) -> DataFrame:
    """big (grp, cid, n_shingles, bits, wide, near: whether the pivot's bitmap allows a link) -> grp, cid of the members that may be linked to another one.

    Those near the pivot stay. The others are queries against all members, in blocks of bitmaps: a query stays with its
    possible partners, or goes. So members that share a passage and nothing else go before any full set is fetched.
    """
    asks = (~F.col("near")).cast("int")
    dealt = big.groupBy("grp").agg(F.ceil(F.sum(asks) / BLOCK).cast("int").alias("of_q"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("of_m"))
    x = big.join(dealt, "grp")
    place = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ("cid", "n_shingles", "bits", "wide")
    queries = x.where("not near").select("grp", place("of_q").alias("q"), every("of_m").alias("m"), *cols, F.lit(True).alias("asks"))
    members = x.where("of_q > 0").select("grp", every("of_q").alias("q"), place("of_m").alias("m"), *cols, F.lit(False).alias("asks"))

    def stay(block: pd.DataFrame) -> pd.DataFrame:
        sides, ids = [], []
        for side in (block[block["asks"]], block[~block["asks"]]):
            sides += [[np.frombuffer(w if w is not None else b, np.uint64) for w, b in zip(side["wide"], side["bits"], strict=True)], side["n_shingles"].to_numpy()]
            ids.append(side["cid"].to_numpy())
        if not all(len(i) for i in ids):
            return pd.DataFrame({"grp": [], "cid": []})
        found = possible_pairs(*sides, percent) & (ids[0][:, None] != ids[1][None])
        cid = np.unique(np.concatenate([ids[0][found.any(axis=1)], ids[1][found.any(axis=0)]]))
        return pd.DataFrame({"grp": np.full(len(cid), block["grp"].iloc[0]), "cid": cid})

    found = queries.union(members).groupBy("grp", "q", "m").applyInPandas(stay, "grp long, cid long")
    return big.where("near").select("grp", "cid").union(found).distinct()


def set_features(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, cid (the set's key), bits, and on one row of a batch `common`: shingles of COMMON or more of its sets."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist(), words)
            keys = [set_key(s) for s in sets]
            distinct = list(dict(zip(keys, sets, strict=True)).values())
            tokens, n = np.unique(np.concatenate(distinct), return_counts=True) if distinct else (np.zeros(0, np.uint64),) * 2
            often = n >= COMMON
            common = [None] * len(batch)
            if often.any():
                common[0] = [{"token": t, "n": c} for t, c in zip(tokens[often].view(np.int64).tolist(), n[often].tolist(), strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": [len(s) for s in sets], "cid": keys, "bits": [token_bits(s).tobytes() for s in sets], "wide": [wide_bits(s) for s in sets], "common": common})

    return docs.mapInPandas(run, "doc_id long, n_shingles long, cid long, bits binary, wide binary, common array<struct<token:long,n:long>>")


def commonest(feats: DataFrame) -> np.ndarray:
    """The commonest shingles, rarest first: RANKED at most, those of the highest counts. A choice of order, which changes no result."""
    counts = written(feats.where("common is not null").select(F.explode("common").alias("c")).groupBy("c.token").agg(F.sum("c.n").alias("n")))
    by_size = sorted(((r["size"], r["tokens"]) for r in counts.groupBy(F.floor(F.log2("n") * 4).alias("size")).agg(F.count(F.lit(1)).alias("tokens")).collect()), reverse=True)
    total, floor = 0, None
    for size, n in by_size:
        if total + n > RANKED:
            break
        total, floor = total + n, size
    if floor is None:
        return np.zeros(0, np.uint64)
    rows = counts.where(F.floor(F.log2("n") * 4) >= floor).toArrow()
    n, token = rows["n"].to_numpy(), rows["token"].to_numpy()
    return token[np.lexsort((token, n))].view(np.uint64)


def prefix(tokens: np.ndarray, ranked: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set of which a linked set has one among its own first: common ones (ranked, sorted; with their rank) come last."""
    n = len(tokens)
    order = np.zeros(n, np.int64)
    if len(ranked):
        at = np.minimum(np.searchsorted(ranked, tokens), len(ranked) - 1)
        order = np.where(ranked[at] == tokens, rank[at] + 1, 0)
    return tokens[np.lexsort((tokens, order))][: n + percent * -n // 100 + 1]


def shared(rows: DataFrame) -> DataFrame:
    """rows (token, cid) without those whose token has one class only, and without repeated ones."""

    def kept(part: pd.DataFrame) -> pd.DataFrame:
        token, cid = part["token"].to_numpy(), part["cid"].to_numpy()
        new = np.r_[True, (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])]
        token, cid = token[new], cid[new]
        again = token[1:] == token[:-1]
        keep = np.r_[False, again] | np.r_[again, False]
        return pd.DataFrame({"token": token[keep], "cid": cid[keep]})

    def run(batches):
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            split = int(np.searchsorted(batch["token"].to_numpy(), batch["token"].iloc[-1], "left")) if len(batch) else 0
            if split:
                yield kept(batch.iloc[:split])
            rest = batch.iloc[split:].reset_index(drop=True)
            if len(rest) > 100_000:  # a long group: all but its last row are known to be shared
                yield kept(rest).iloc[:-1]
                rest = rest.iloc[-2:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield kept(rest)

    return rows.repartition("token").sortWithinPartitions("token", "cid").mapInPandas(run, "token long, cid long")


def leaf_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """rows (grp, cid, n_shingles, bits) of groups of LEAF members at most -> pairs (a, b, alike) that bitmaps allow."""

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        grp, cid, n = (part[c].to_numpy() for c in ("grp", "cid", "n_shingles"))
        bits = np.frombuffer(b"".join(part["bits"]), np.uint64).reshape(len(part), WORDS)
        found = [np.zeros((3, 0), np.int64)]
        for step in range(1, LEAF):
            i = np.flatnonzero(grp[:-step] == grp[step:])
            if not len(i):
                break
            j = i + step
            ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[ok], j[ok]
            most = most_overlap(bits[i], n[i], bits[j], n[j])
            ok = most >= least_overlap(n[i], n[j], percent)
            i, j, most = i[ok], j[ok], most[ok]
            found.append(np.stack([np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j]), PLACES * most // np.maximum(n[i] + n[j] - most, 1)]))
        a, b, alike = np.concatenate(found, axis=1)
        return pd.DataFrame({"a": a, "b": b, "alike": alike.astype(np.int32)}).drop_duplicates(["a", "b"])

    def run(batches):
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            split = int(np.searchsorted(batch["grp"].to_numpy(), batch["grp"].iloc[-1], "left")) if len(batch) else 0
            if split:
                yield pairs(batch.iloc[:split])
            rest = batch.iloc[split:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield pairs(rest)

    return rows.repartition("grp").sortWithinPartitions("grp").mapInPandas(run, "a long, b long, alike int")


def long_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs without those of long sets that their wide bitmaps rule out."""

    def run(batches):
        for batch in batches:
            yield batch[[widely_alike(*x, percent) for x in zip(batch["wide_a"], batch["n_a"], batch["wide_b"], batch["n_b"], strict=True)]][["a", "b", "alike"]]

    end = lambda c: classes.select(F.col("cid").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}"))
    long = classes.where("wide is not null").select(F.col("cid").alias("a"))
    rest = pairs.join(long, "a", "left_anti")
    return rest.union(pairs.join(end("a"), "a").where("wide_a is not null").join(end("b"), "b").mapInPandas(run, "a long, b long, alike int"))


def jaccard_components(docs: DataFrame, text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, of each row of docs.

    Documents link when 100 * intersection >= percent * union of their sets of `words`-word shingles. A text of fewer words is
    one shingle; a null text or one without words has an empty set and links with nothing. Equal rows have equal results;
    a null doc_id is part of its class, but names no component (one of null ids alone has a null id). Columns other than
    doc_id and the text take no part. An empty table gives an empty one.
    """
    x = docs.select("doc_id", F.col(text).alias("text"))
    feats = written(set_features(x, words))
    classes = written(feats.where("n_shingles > 0").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"), F.first("wide").alias("wide")))
    least = -(-percent // max(1, 100 - percent))  # smaller sets are linked to equal ones only
    order = commonest(feats)
    by_token = np.argsort(order)
    ranked = docs.sparkSession.sparkContext.broadcast((order[by_token], by_token))

    def prefixes(batches):
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist(), words)
            firsts = [prefix(s, *ranked.value, percent) if len(s) >= least else s[:0] for s in sets]
            n = [len(f) for f in firsts]
            keys = np.array([set_key(s) for s in sets], np.int64)
            yield pd.DataFrame({"token": np.concatenate([*firsts, np.zeros(0, np.uint64)]).view(np.int64), "cid": np.repeat(keys, n)})

    rid = F.xxhash64("doc_id").alias("rid")
    firsts = maybe_in(x.select(rid, "text"), bitmap(classes.where(F.col("n_shingles") >= least).select(rid))).where("maybe").select("text")
    rows = written(shared(firsts.mapInPandas(prefixes, "token long, cid long")))
    same = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "cid")).alias("y"), F.min("cid").alias("low"))
    groups = written(same.groupBy("n", "x", "y").agg(F.min("token").alias("token"), F.min("low").alias("low")))
    small, large = groups.where(F.col("n") <= LEAF), groups.where(F.col("n") > LEAF)
    members = rows.join(small.select("token"), "token").select(F.col("token").alias("grp"), "cid")
    pairs = written(leaf_pairs(members.join(classes.select("cid", "n_shingles", "bits"), "cid"), percent))
    pairs = written(pairs.groupBy("a", "b").agg(F.max("alike").alias("alike")))
    pairs = written(long_pairs(pairs, classes, percent))
    # large groups go by their pivot, the least key, so that those of one family are one group
    big = written(rows.join(large.select("token", "low"), "token").select(F.col("low").alias("grp"), "cid").distinct())
    star, own = None, None
    if big.take(1):
        pivots = big.select("grp").distinct().join(classes.select(F.col("cid").alias("grp"), F.col("n_shingles").alias("n_p"), F.col("bits").alias("bits_p"), F.col("wide").alias("wide_p")), "grp")
        big = written(big.join(classes.select("cid", "n_shingles", "bits", "wide"), "cid").join(pivots, "grp").mapInPandas(_near_pivot(percent), "grp long, cid long, n_shingles long, bits binary, wide binary, alike int, near boolean"))
        star = big.where("near and grp <> cid").select("cid", F.col("grp").alias("pivot"), "alike")
        own = written(group_survivors(big, percent)).select("grp", "cid", F.col("grp").alias("hub"))
    return resolved(docs, text, words, percent, feats, classes, pairs, star, own, tree_links).select("doc_id", "n_shingles", "component_id")


def _near_pivot(percent: int):
    def run(batches):
        for batch in batches:
            sides = [[np.frombuffer(w if w is not None else b, np.uint64) for w, b in zip(batch[f"wide{p}"], batch[f"bits{p}"], strict=True)] for p in ("", "_p")]
            n, m = batch["n_shingles"].to_numpy(), batch["n_p"].to_numpy()
            most = np.array([most_overlap(folded(x, min(len(x), len(y))), i, folded(y, min(len(x), len(y))), j) for x, y, i, j in zip(*sides, n, m, strict=True)], np.int64)
            yield batch[["grp", "cid", "n_shingles", "bits", "wide"]].assign(alike=(PLACES * most // np.maximum(n + m - most, 1)).astype(np.int32), near=most >= least_overlap(n, m, percent))

    return run
