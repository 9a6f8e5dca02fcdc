"""Best-fit packing of tokenized documents into sequences, after Martello-Toth dominance reduction.

Lengths are whole numbers from 1 to the capacity, so the packing problem is its histogram of lengths: at most
`capacity` numbers, whatever the corpus. The driver reduces and packs that histogram in counts ("170 bins of 1500 +
548"); Spark gives each piece its rank among the pieces of its length and looks its bin up by that rank.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .wordpieces import MEMO_WORDS, byte_letters, chunks, library, pretokens, split_rules, vocabulary_path

CAPACITY = 2048
END_ID = 0
RANK_ROWS = 20_000

class PartIds(dict):
    """Part of a text -> its ids as little-endian 32-bit bytes, encoded by the library's model when it is met first.

    It is emptied between texts when it holds MEMO_WORDS parts or pre-tokens; that changes no value.
    """

    def __init__(self, path: str):
        self.path, self.tokenize, self.letters, self.words = path, library(path).model.tokenize, byte_letters(), {}
        self.special = {text: array("I", [number]).tobytes() for text, number in split_rules(path)[1].items()}
        self.update(self.special)

    def word(self, w: str) -> bytes:
        shown = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letters)
        out = self.words[w] = array("I", [t.id for t in self.tokenize(shown)]).tobytes()
        return out

    def __missing__(self, part: str) -> bytes:
        get = self.words.get
        out = self[part] = b"".join([get(w) or self.word(w) for w in pretokens(part, self.path)])
        return out

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self) > MEMO_WORDS or len(self.words) > MEMO_WORDS:
            self.clear()
            self.words.clear()
            self.update(self.special)
        return b"".join(map(self.__getitem__, chunks(text, self.path)))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """A row per piece of each document: its ids, then END_ID, cut every `capacity` ids. Null and empty texts have one piece, END_ID alone."""
    path = vocabulary or vocabulary_path()
    end = int(END_ID).to_bytes(4, "little")

    def cut(batches):
        encode = PartIds(path).of  # its memory ends with the task
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                rows = []
                for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                    ids = encode(text) + end
                    for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[i : i + 4 * capacity]
                        rows.append((doc_id, k, i // 4, len(piece) // 4, zlib.crc32(piece)))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield out.assign(doc_id=pd.array([None if x is None or x != x else int(x) for x in out["doc_id"]], dtype="Int64"))

    return docs.select("doc_id", F.col(text).alias("text")).mapInPandas(cut, PIECES)


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], dict[int, int]]:
    """Dominance reduction: (bins fixed for good, lengths that remain).

    For each length j, longest first, the best partner is the largest length i that fits beside it. The set {j}
    dominates all others with j if nothing fits beside j; {j, i} does if i fills the bin, or if not even the two
    smallest lengths fit beside j, so that every feasible set holds one other piece, no longer than i. Some best packing
    holds the dominating set, so it is fixed. All pieces of one length are fixed together while the conditions hold.
    """
    left, fixed = dict(counts), []
    for j in sorted(counts, reverse=True):
        while left.get(j):
            left[j] -= 1
            others = [w for w in left if left[w] and w <= capacity - j]
            left[j] += 1
            if not others:
                fixed.append((((j, 1),), left.pop(j)))
                break
            i, small = max(others), sorted(others)[:2]
            two = 2 * small[0] if left[small[0]] - (small[0] == j) > 1 else (sum(small) if len(small) > 1 else capacity + 1)
            if j + i != capacity and two <= capacity - j:
                break
            times = left[j] // 2 if i == j else min(left[j], left[i])
            if i == j and not times:
                break
            # smaller lengths stay as they are while j is paired, so the conditions hold for all of them
            fixed.append((((j, 2),) if i == j else ((j, 1), (i, 1)), times))
            for w in (j, i):
                left[w] -= times
            left = {w: n for w, n in left.items() if n}
    return fixed, {w: n for w, n in left.items() if n}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit, longest first, in counts: alike bins are one class (contents, number), split when only some get a piece."""
    classes: dict[int, list[list]] = defaultdict(list)  # space left -> [contents, number of bins]
    spaces: list[int] = []  # sorted

    def add(space, contents, number):
        if number:
            if space not in classes:
                spaces.insert(bisect_right(spaces, space), space)
            classes[space].append([contents, number])

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            k = bisect_right(spaces, w - 1)
            if k == len(spaces):
                each = capacity // w
                full, last = divmod(n, each)
                add(capacity - each * w, ((w, each),), full)
                if last:
                    add(capacity - last * w, ((w, last),), 1)
                n = 0
                continue
            space = spaces[k]
            contents, number = classes[space].pop()
            if not classes[space]:
                del classes[space]
                spaces.pop(k)
            each = space // w
            use, last = divmod(n, each)
            use = min(use, number)
            n -= use * each
            add(space - each * w, (*contents, (w, each)), use)
            rest = number - use
            if rest and n and n < each:
                add(space - n * w, (*contents, (w, n)), 1)
                rest, n = rest - 1, 0
            add(space, contents, rest)
    return [(contents, number) for found in classes.values() for contents, number in found]


def packed_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Bins as (((length, times), ...), number of such bins)."""
    fixed, left = reduced(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(bins: list) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, times a bin, first bin, offset): which pieces of a length lie where."""
    rank, first, out = defaultdict(int), 0, []
    for contents, number in bins:
        offset = 0
        for w, times in contents:
            out.append((w, rank[w], rank[w] + times * number - 1, times, first, offset))
            rank[w] += times * number
            offset += w * times
        first += number
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset. Alike rows get places of their own."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    spark = pieces.sparkSession
    table = spark.createDataFrame(places(packed_lengths(counts, capacity)), "w long, low long, high long, times long, bin long, offset0 long")
    # ranks within a length: in parts by hash, so that a length which many pieces have isn't one task
    parts = spark.createDataFrame([(w, -(-n // RANK_ROWS)) for w, n in counts.items()], "w long, parts long")
    x = pieces.join(F.broadcast(parts), F.col("length") == F.col("w")).drop("w")
    x = x.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts")))
    sizes = x.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col("length").alias("_l"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    inside = W.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    x = x.withColumn("_k", F.row_number().over(inside) - 1).join(starts, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p")))
    x = x.withColumn("_rank", F.col("_start") + F.col("_k"))
    x = x.join(F.broadcast(table), (F.col("length") == F.col("w")) & F.col("_rank").between(F.col("low"), F.col("high")))
    k = F.col("_rank") - F.col("low")
    return x.select(
        *pieces.columns,
        (F.col("bin") + F.floor(k / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + (k % F.col("times")) * F.col("length")).cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Each document's pieces and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end mark alone. Repeated rows are packed as often as they stand there. A text longer
    than a sequence is cut into full pieces and a rest. Columns of docs besides doc_id and the text take no part. An
    empty table gives an empty one.
    """
    return pack(written(token_pieces(docs, text, capacity, vocabulary)), capacity)
