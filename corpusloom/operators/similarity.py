"""Copied text and code: winnowing fingerprints in an inverted index."""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..materialize import written

# Languages of code files.
CODE_SUFFIXES = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "go": "go", "rb": "ruby", "rs": "rust", "cs": "csharp"}
ATTRIBUTION = r"https?://|источник|лицензи|автор|copyright|license|adapted from|based on|courtesy of|©"
GRAM, WINDOW = 30, 4
#: A bitmap of fingerprints has 2**BITS bits (4 MB).
BITS = 25


def code_language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CODE_SUFFIXES.items() for x in pair))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def normalized_code(text: Column, language: Column) -> Column:
    """Without comments, string contents and white space, in lower case."""
    text = F.when(language.isin("python", "ruby"), F.regexp_replace(text, "#.*", "")).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, "//.*", ""), r"(?s)/\*.*?\*/", "")
    text = F.regexp_replace(text, r'"(?:\\.|[^"\\])*"', '""')
    text = F.regexp_replace(text, r"'(?:\\.|[^'\\])*'", "''")
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def code_docs(files: DataFrame) -> DataFrame:
    """unit_id, language, text (normalized files in path order), attributed (anywhere in the unit)."""
    x = files.withColumn("language", code_language(F.col("relative_path"))).where("language is not null")
    own = x.groupBy("unit_id").agg(F.max(F.col("text").rlike("(?iu)" + ATTRIBUTION)).alias("attributed"))
    body = F.array_sort(F.collect_list(F.struct("relative_path", normalized_code(F.col("text"), F.col("language")).alias("t"))))
    docs = x.groupBy("unit_id", "language").agg(body.alias("body")).select("unit_id", "language", F.array_join(F.transform("body", lambda b: b["t"]), "").alias("text"))
    return docs.join(own, "unit_id")


def _crc_step(states: np.ndarray) -> np.ndarray:
    """CRC-32 registers after a zero byte: the polynomial's remainder of the low byte, and the rest moved down."""
    low = states & np.uint32(0xFF)
    for _ in range(8):
        low = (low >> np.uint32(1)) ^ np.where(low & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return low ^ (states >> np.uint32(8))


@lru_cache(maxsize=1)
def _byte_crcs() -> np.ndarray:
    """The register after each byte, from an empty one."""
    return _crc_step(np.arange(256, dtype=np.uint32))


@lru_cache(maxsize=32)
def _zeros(k: int) -> np.ndarray:
    """2**k zero bytes as a linear map over GF(2): the images of the values of each of a register's four bytes."""
    values = np.arange(256, dtype=np.uint32)
    if not k:
        return np.stack([_crc_step(values << np.uint32(8 * b)) for b in range(4)])
    half = _zeros(k - 1)
    return np.stack([_moved(half, half[b]) for b in range(4)])


def _moved(zeros: np.ndarray, x: np.ndarray) -> np.ndarray:
    return zeros[0][x & 0xFF] ^ zeros[1][(x >> 8) & 0xFF] ^ zeros[2][(x >> 16) & 0xFF] ^ zeros[3][x >> 24]


def gram_crcs(text: str, gram: int) -> np.ndarray:
    """zlib.crc32 of the UTF-8 bytes of every `gram` neighbouring characters.

    The register without its fixed start and end is linear: that of two neighbouring stretches is the first, moved by as many
    zero bytes as the second has, plus the second. So stretches of 1, 2, 4 ... bytes are made for all places at once, and each
    gram is put together from those that its length in bytes asks for.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    first = np.flatnonzero((data & 0xC0) != 0x80) if len(data) != len(text) else np.arange(len(data))
    if len(first) < gram:
        return np.zeros(0, np.int64)
    ends = np.append(first, len(data))
    place, length = first[: len(first) - gram + 1].copy(), ends[gram:] - first[: len(first) - gram + 1]
    stretches = [_byte_crcs()[data]]
    for k in range(int(length.max()).bit_length() - 1):
        x = stretches[-1]
        stretches.append(_moved(_zeros(k), x[: -(1 << k)]) ^ x[1 << k :])
    out, same = np.zeros(len(place), np.uint32), bool((length == length[0]).all())
    for k in reversed(range(len(stretches))):
        if same:
            if int(length[0]) >> k & 1:
                out = _moved(_zeros(k), out) ^ stretches[k][place]
                place += 1 << k
        else:
            at = np.flatnonzero(length >> k & 1)
            out[at] = _moved(_zeros(k), out[at]) ^ stretches[k][place[at]]
            place[at] += 1 << k
    fixed = np.array([zlib.crc32(bytes(n)) for n in range(int(length.max()) + 1)], np.uint32)
    return (out ^ fixed[length]).astype(np.int64)


#: MD5's additive constants, rotations, first state; grams that are hashed at once.
_MD5_ADD = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_MD5_TURN = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4, np.uint32)
_MD5_FIRST = tuple(np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
MD5_LANES = 1 << 14


def _md5_block(state: list[np.ndarray], words: list[np.ndarray | None]) -> list[np.ndarray]:
    """MD5 states after a block of 16 words each; None is a word that is 0 everywhere."""
    a, b, c, d = (x.copy() for x in state)
    f, high = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            at = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            at = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            at = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            at = 7 * i % 16
        f += a
        f += _MD5_ADD[i]
        if words[at] is not None:
            f += words[at]
        np.right_shift(f, np.uint32(32) - _MD5_TURN[i], out=high)
        f <<= _MD5_TURN[i]
        f |= high
        f += b
        a, d, c, b, f = d, c, b, f, a
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def md5_heads(data: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first 15 hexadecimal digits of md5 (which SQL engines have too) of stretches of bytes, many at a time."""
    data = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    four = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    out = np.zeros(len(place), np.int64)
    order = np.argsort(length, kind="stable")
    for n in np.unique(length).tolist():
        of_n = order[np.searchsorted(length, n, "left", sorter=order) : np.searchsorted(length, n, "right", sorter=order)]
        for start in range(0, len(of_n), MD5_LANES):
            some = of_n[start : start + MD5_LANES]
            at, part = place[some], np.uint32(8 * (n % 4))
            words: list[np.ndarray | None] = [four[at + 4 * i] for i in range(n // 4)]
            last = four[at + n - n % 4] & ((np.uint32(1) << part) - np.uint32(1)) if n % 4 else np.zeros(len(at), np.uint32)
            words.append(last | np.uint32(0x80) << part)
            words += [None] * ((-len(words) - 2) % 16) + [np.full(len(at), 8 * n & 0xFFFFFFFF, np.uint32), None]
            state = [np.full(len(at), x) for x in _MD5_FIRST]
            for block in range(0, len(words), 16):
                state = _md5_block(state, words[block : block + 16])
            head, tail = (x.byteswap().astype(np.uint64) for x in state[:2])
            out[some] = ((head << np.uint64(32) | tail) >> np.uint64(4)).astype(np.int64)
    return out


def _grams(texts: list[str], gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, where their grams of `gram` characters begin, their lengths in bytes, and each text's number of grams."""
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    chars = np.array([len(t) for t in texts], np.int64)
    first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    counts = np.maximum(chars - gram + 1, 0)
    starts = np.repeat(np.cumsum(chars) - chars - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return data, first[starts], first[starts + gram] - first[starts], counts


def _md5(text: str, places: np.ndarray, gram: int) -> np.ndarray:
    """md5_heads of the grams at these places."""
    data, begin, length, _ = _grams([text], gram)
    return md5_heads(data, begin[places], length[places])


#: Characters of texts whose grams are in memory at once; a longer text is taken alone.
CHUNK = 1 << 20


def minima(texts: list[str], gram: int, window: int, kind: str) -> list[np.ndarray]:
    """Of each text the distinct minima of `window` neighbouring gram hashes (crc32 or md5), as winnowed has them."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size < CHUNK and i < len(texts) - 1:
            continue
        some = texts[start : i + 1]
        if kind == "md5":
            data, begin, length, counts = _grams(some, gram)
            hashes = np.split(md5_heads(data, begin, length), np.cumsum(counts)[:-1])
        else:
            hashes = [gram_crcs(x, gram) for x in some]
        for h in hashes:
            n = len(h) - window + 1
            if n < 1:
                out.append(np.zeros(0, np.int64))
                continue
            low = h[:n].copy()
            for k in range(1, window):
                np.minimum(low, h[k : k + n], out=low)
            out.append(np.unique(low[np.append(True, low[1:] != low[:-1])]))
        start, size = i + 1, 0
    return out


def winnowed(text: str, gram: int, window: int, kind: str, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct minima of `window` neighbouring gram hashes (crc32 or md5), and a crc32 of a gram that has each.

    With wanted (a bitmap of low bits of crc32), only minima whose crc32 is in it, and perhaps some others: md5 is taken
    only around grams that are.
    """
    crcs = gram_crcs(text, gram)
    n = len(crcs) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.arange(n)
    if wanted is not None:
        hit = wanted[(crcs & ((1 << BITS) - 1)) >> 3] >> (crcs & 7).astype(np.uint8) & 1 == 1
        starts = np.flatnonzero(sliding_window_view(hit, window).any(axis=1))
    if kind == "crc32":
        hashes = crcs
    else:
        near = np.zeros(len(crcs), bool)
        for i in range(window):
            near[starts + i] = True
        places = np.flatnonzero(near)
        hashes = np.zeros(len(crcs), np.int64)
        hashes[places] = _md5(text, places, gram)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows = hashes[starts[:, None] + np.arange(window)]
    least = windows.argmin(axis=1)
    found, at = np.unique(windows[np.arange(len(starts)), least], return_index=True)
    return found, crcs[(starts + least)[at]]


def fingerprints(docs: DataFrame, keys: list[str], gram: int = GRAM, window: int = WINDOW, kind: str = "crc32", among: DataFrame | None = None) -> DataFrame:
    """docs (keys, text) -> keys, fingerprint (distinct in a text), crc, size (their number in the text). Texts shorter than a gram, or with fewer hashes than a window, have none.

    Only distinct fingerprints leave the task. They are written, as they are used several times. With `among` (fingerprint,
    crc), only its fingerprints are kept, and perhaps a few others: a bitmap of 2**BITS bits, whatever their number, goes to
    the tasks; size then counts what is kept.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(among)) if among is not None else None

    def run(batches):
        for batch in batches:
            found = [winnowed(t, gram, window, kind, bits.value if bits is not None else None) for t in batch["text"]]
            sizes = [len(f) for f, _ in found]
            row = np.repeat(np.arange(len(batch)), sizes)
            out = batch[keys].iloc[row].reset_index(drop=True)
            prints, crcs = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
            yield out.assign(fingerprint=prints, crc=crcs, size=np.array(sizes, np.int64)[row])

    plain = docs.where(F.char_length("text") >= gram + window - 1).select(*keys, "text")
    schema = ", ".join(f"{k} {plain.schema[k].dataType.simpleString()}" for k in keys)
    return written(plain.mapInPandas(run, f"{schema}, fingerprint long, crc long, size long"))


def _bitmap(prints: DataFrame) -> np.ndarray:
    """Which low bits of crc occur among fingerprints: 2**BITS bits, collected as at most 2**BITS / 32768 rows."""
    low = F.col("crc").bitwiseAND(F.lit((1 << BITS) - 1))
    rows = prints.groupBy(F.shiftright(low, 15).alias("bucket")).agg(F.bitmap_construct_agg(low % 32768).alias("bits")).collect()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in rows:
        out[r["bucket"] << 12 : (r["bucket"] + 1) << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


#: Fingerprints in a bucket, about; their number of buckets grows with the texts.
BUCKET = 1 << 20


def shared_fingerprints(docs: DataFrame, key: str, scope: str, gram: int, window: int, kind: str) -> DataFrame:
    """docs (scope, key, text) -> scope, fingerprint, df, key, size: the fingerprints that two texts of a scope or more have, and how many have them.

    Most fingerprints are in one text only. They travel to their bucket packed, a row for each batch of texts and bucket,
    and a bucket leaves rows for shared ones alone.
    """
    seen = Observation()
    plain = written(docs.where(F.char_length("text") >= gram + window - 1).select(scope, key, "text").observe(seen, F.sum(F.char_length("text")).alias("chars")))
    buckets = max(1, -(-2 * (seen.get["chars"] or 0) // ((window + 1) * BUCKET)))  # of window + 1 grams about two are minima

    def pack(batches):
        for batch in batches:
            for of, part in batch.groupby(scope, sort=False, dropna=False):
                found = minima(part["text"].tolist(), gram, window, kind)
                sizes = np.array([len(f) for f in found], np.int32)
                prints, row = np.concatenate(found), np.repeat(np.arange(len(found)), sizes)
                place = (prints % buckets).astype(np.int32)
                order = np.argsort(place, kind="stable")
                prints, row, ends = prints[order], row[order], np.searchsorted(place[order], np.arange(buckets + 1))
                keys, out = part[key].to_numpy(), []
                for i in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
                    own, counts = np.unique(row[ends[i] : ends[i + 1]], return_counts=True)
                    out.append((of, i, keys[own], sizes[own], counts.astype(np.int32), prints[ends[i] : ends[i + 1]].tobytes()))
                yield pd.DataFrame(out, columns=[scope, "bucket", "keys", "sizes", "counts", "prints"])

    def shared(part: pd.DataFrame) -> pd.DataFrame:
        join = lambda c: np.concatenate(part[c].tolist())
        prints, counts = np.frombuffer(b"".join(part["prints"]), np.int64), join("counts")
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        edges = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
        df = np.diff(np.append(edges, len(prints)))
        df = np.repeat(df, df)
        keep = df > 1
        row = np.repeat(np.arange(len(counts)), counts)[order[keep]]
        return pd.DataFrame({scope: part[scope].iloc[0], "fingerprint": prints[keep], "df": df[keep], key: join("keys")[row], "size": join("sizes")[row]})

    kinds = {c: plain.schema[c].dataType.simpleString() for c in (scope, key)}
    packed = plain.mapInPandas(pack, f"{scope} {kinds[scope]}, bucket int, keys array<{kinds[key]}>, sizes array<int>, counts array<int>, prints binary")
    return written(packed.groupBy(scope, "bucket").applyInPandas(shared, f"{scope} {kinds[scope]}, fingerprint long, df long, {key} {kinds[key]}, size long"))


def similar_units(docs: DataFrame, key: str = "unit_id", scope: str = "language", threshold: float = 0.8, kind: str = "crc32", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """docs (scope, key, text) -> scope, a, b (a < b), similarity: shared fingerprints over the smaller set, of pairs from the threshold on.

    Fingerprints that only one text has take no part. The others are ordered by rarity in each set, and only the rarest
    (1 - threshold) * size + 1 of the smaller set open a pair: two sets that share `threshold` of the smaller one share at
    least one of these. So common fingerprints seldom make pairs, and a text that shares too little opens none. Pairs are
    confirmed on the sets of shared fingerprints as arrays, without a row for each common one.
    """
    shared = shared_fingerprints(docs, key, scope, gram, window, kind)
    held = written(shared.groupBy(scope, key).agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n")))
    # of the smaller set, all but ceil(threshold * size) - 1 may be missing from the other; those that nobody shares are missing anyway
    need = F.col("size") - F.ceil(F.col("size") * (threshold - 0.00005) - 1e-9) + 1 - (F.col("size") - F.col("n"))
    can = held.withColumn("need", need).where("need > 0").select(scope, key, "need")
    rank = F.row_number().over(W.partitionBy(scope, key).orderBy("df", "fingerprint"))
    opens = written(shared.join(can, [scope, key]).withColumn("rank", rank).where("rank <= need").select(scope, "fingerprint", F.col(key).alias("a"), F.col("size").alias("size_a")))
    right = shared.select(scope, "fingerprint", F.col(key).alias("b"), F.col("size").alias("size_b"))
    # the smaller set (then the smaller key) opens
    smaller = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    pairs = written(opens.join(right, [scope, "fingerprint"]).where(smaller).select(scope, "a", "b", "size_a").distinct())
    ends = pairs.select(scope, F.explode(F.array("a", "b")).alias(key)).distinct()
    sets = written(shared.join(ends, [scope, key], "left_semi").groupBy(scope, key).agg(F.collect_list("fingerprint").alias("found")))
    pairs = pairs.join(sets.select(scope, F.col(key).alias("a"), F.col("found").alias("found_a")), [scope, "a"]).join(sets.select(scope, F.col(key).alias("b"), F.col("found").alias("found_b")), [scope, "b"])
    pairs = pairs.withColumn("similarity", F.bround(F.size(F.array_intersect("found_a", "found_b")) / F.col("size_a"), 4))
    return pairs.where(F.col("similarity") >= threshold).select(scope, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def containment(items: DataFrame, corpus: DataFrame, item: str, doc: str, threshold: float = 0.8, kind: str = "crc32", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """item, doc, containment: share of an item's fingerprints that a document has, from the threshold on.

    Only fingerprints of items take part: the corpus's others stay in the tasks that make them.
    """
    own = fingerprints(items, [item], gram, window, kind)
    theirs = fingerprints(corpus, [doc], gram, window, kind, among=own).drop("crc", "size")
    x = own.join(theirs, "fingerprint").groupBy(item, doc, "size").agg(F.count(F.lit(1)).alias("both"))
    x = x.withColumn("containment", F.bround(F.col("both") / F.col("size"), 4))
    return x.where(F.col("containment") >= threshold).select(item, doc, "containment")


def link_counts(pairs: DataFrame, scope: str = "language") -> DataFrame:
    """pairs (scope, a, b, similarity) -> scope, id, links: to how many others each is similar."""
    return pairs.select(scope, F.explode(F.array("a", "b")).alias("id")).groupBy(scope, "id").agg(F.count(F.lit(1)).alias("links"))


def code_matches(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """unit_id, other_unit_id, language, similarity, attributed: each pair from both sides."""
    pairs = similar_units(docs, threshold=threshold)
    both = pairs.select("language", F.col("a").alias("unit_id"), F.col("b").alias("other_unit_id"), "similarity").unionByName(pairs.select("language", F.col("b").alias("unit_id"), F.col("a").alias("other_unit_id"), "similarity"))
    return both.join(docs.select("unit_id", "attributed").distinct(), "unit_id")
