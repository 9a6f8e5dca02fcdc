"""Removal of long byte strings that occur more than once, by a logarithmic family of sparse suffix arrays.

A full suffix array has a suffix per byte. Two equal strings of LENGTH bytes have the same minimizer: of their GRAM-byte
substrings, the one with the smallest hash. So it is enough to index the suffixes that start at a minimizer (one byte in
about 70), ordered by the fingerprint of their first GRAM bytes, which a long match has to share.

Documents come in batches. Each batch's suffixes become a sorted array; it is merge-scanned (a sort-merge join) against
the arrays of the levels so far, and then becomes a level itself; two levels of equal size merge into one of twice the
size, so there are never more levels than the logarithm of the number of batches (`SuffixIndex`, which takes further
batches at any time). The scans give the fingerprints that occur twice, and only their suffixes are looked at again:

- the windows (strings of LENGTH bytes) with one minimizer are neighbours. If their whole stretch occurs twice, as
  inside a long match, all of them are repeated, and nothing else has to be compared;
- else (the ends of a match) the windows of one key are compared: those whose fingerprints agree are sorted by their
  bytes, and neighbours that agree in all of them are repeated.

Both count equal content per stretch or window; pairs of places are never listed, so a passage that a third of all
documents share costs a row for each place.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import U64, bitmap, maybe_in, mixed, prefix_hashes, span_hashes, written

LENGTH = 200
GRAM = 64
BATCHES = 4
BLOCK = 1 << 19
#: Keys with more contexts than this are compared a window at a time, over all tasks, by fingerprints of windows alone.
HOT = 2_000
#: Contexts whose windows are compared at once.
CONTEXTS = 500
#: Windows that are sorted at once; those with one fingerprint stay together.
WINDOWS = 50_000
_LOW = U64((1 << 20) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def stretches(data: np.ndarray, prefix: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, place of the minimizer) of each stretch of windows with the same minimizer."""
    width, last = length - gram + 1, len(data) - length + 1  # grams in a window; number of windows
    first, place = [], []
    for at in range(0, last, BLOCK):  # places within a block fit in 20 bits
        starts = np.arange(at, min(at + BLOCK, last) + width - 1)
        key = (span_hashes(prefix, starts, starts + gram) & ~_LOW) | np.arange(len(starts), dtype=np.uint64)
        low = (sliding_min(key, width) & _LOW).astype(np.int64) + at
        new = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        first.append(new + at)
        place.append(low[new])
    first, place = np.concatenate(first), np.concatenate(place)
    return first, np.diff(np.r_[first, last]), place


def suffixes(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs (rid, text) -> a row per stretch: rid, first, windows, key (of the minimizer's bytes), context (of all its bytes)."""

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for rid, text in zip(batch["rid"].to_numpy(), batch["text"], strict=True):
                data = np.frombuffer((text or "").encode("utf-8"), np.uint8)
                if len(data) < length:
                    continue
                prefix = prefix_hashes(data)
                first, n, place = stretches(data, prefix, length, gram)
                key = span_hashes(prefix, place, place + gram)
                context = mixed(span_hashes(prefix, first, first + n + length - 1) + (place - first).astype(np.uint64) * U64(0x9FB21C651E98DF25))
                out.append(pd.DataFrame({"rid": rid, "first": first.astype(np.int32), "windows": n.astype(np.int32), "key": key.view(np.int64), "context": context.view(np.int64)}))
                size += len(first)
                if size > 50_000:
                    yield pd.concat(out, ignore_index=True)
                    out, size = [], 0
            if out:
                yield pd.concat(out, ignore_index=True)

    return docs.mapInPandas(run, "rid long, first int, windows int, key long, context long")


class SuffixIndex:
    """Sparse suffix arrays of batches of documents, in levels that double.

    `levels` are (size in batches, table of sorted keys), largest first; `stored` the suffixes of each batch and `docs`
    the batches. All tables lie in the shared folder. A batch costs scans of at most log2(batches) levels.
    """

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.levels: list[tuple[int, DataFrame]] = []
        self.stored: list[DataFrame] = []
        self.docs: list[DataFrame] = []
        self.found: list[DataFrame] = []

    def add_batch(self, docs: DataFrame) -> SuffixIndex:
        """Takes in docs (rid, text; equal rids have equal texts)."""
        self.docs.append(docs)
        return self.add_suffixes(written(suffixes(docs, self.length, self.gram)))

    def add_suffixes(self, rows: DataFrame, last: bool = False) -> SuffixIndex:
        """Takes in a batch's suffixes; after the last batch of all, the merged level needn't be written."""
        self.stored.append(rows)
        array = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("key"))
        hits = array.where("n > 1").select("key")
        for _, level in self.levels:  # merge-scan: both sides sorted by key
            hits = hits.union(array.join(level, "key", "left_semi").select("key"))
        self.found.append(hits)
        self.levels.append((1, array.select("key")))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (m, x), (n, y) = self.levels.pop(), self.levels.pop()
            merged = y.union(x).distinct()
            self.levels.append((m + n, merged if last else written(merged.sortWithinPartitions("key"))))
        return self

    def repeated_keys(self) -> DataFrame:
        """The keys that stand at two places or more."""
        return written(reduce(DataFrame.union, self.found).distinct())

    def suffixes(self) -> DataFrame:
        return reduce(DataFrame.union, self.stored)

    def repeated_spans(self, hot: int = HOT) -> DataFrame:
        """rid, spans: an array of (first window, windows), repeated windows only, over all batches."""
        return spans_of(self.suffixes(), self.repeated_keys(), reduce(DataFrame.union, self.docs), self.length, hot)


def open_contexts(docs: DataFrame, open_runs: DataFrame, length: int) -> DataFrame:
    """open_runs (rid, first, windows, key, single, hot) with the bytes of each stretch."""
    per_text = open_runs.groupBy("rid").agg(F.collect_list(F.struct("first", "windows", "key", "single", "hot")).alias("runs"))
    names = ["key", "rid", "first", "windows", "single", "hot", "context"]

    def run(batches):
        for batch in batches:
            rows = []
            for rid, text, runs in zip(batch["rid"].to_numpy(), batch["text"], batch["runs"], strict=True):
                data = text.encode("utf-8")
                rows += [(r["key"], rid, r["first"], r["windows"], r["single"], r["hot"], data[r["first"] : r["first"] + r["windows"] + length - 1]) for r in runs]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    texts = maybe_in(docs, bitmap(open_runs.select("rid"))).where("maybe")
    return texts.join(per_text, "rid").select("rid", "text", "runs").mapInPandas(run, "key long, rid long, first int, windows int, single boolean, hot boolean, context binary")


def windows_of(part: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in its text, hash) of each window of some contexts; the hash includes the key."""
    n = part["windows"].to_numpy().astype(np.int64)
    prefix = prefix_hashes(np.frombuffer(b"".join(part["context"]), np.uint8))
    starts = np.r_[0, np.cumsum(n + length - 1)[:-1]]
    row = np.repeat(np.arange(len(part)), n)
    inside = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
    at = starts[row] + inside
    return row, part["first"].to_numpy()[row] + inside, mixed(span_hashes(prefix, at, at + length) ^ part["key"].to_numpy().view(np.uint64)[row])


def repeated_windows(contexts: DataFrame, length: int) -> DataFrame:
    """rid, first, windows: repeated windows of single contexts. A key's contexts are compared in one task, those of hot keys a window at a time."""

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        key = part["key"].to_numpy()
        ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) + 1  # keys stay whole
        out, at = [], 0
        while at < len(part):
            to = int(ends[max(np.searchsorted(ends, at + CONTEXTS, "right") - 1, np.searchsorted(ends, at, "right"))])
            out.append(compare_keys(part.iloc[at:to].reset_index(drop=True)))
            at = to
        return pd.concat(out, ignore_index=True)

    def compare_keys(part: pd.DataFrame) -> pd.DataFrame:
        row, at, h = windows_of(part, length)
        _, back, n = np.unique(h, return_inverse=True, return_counts=True)
        maybe = np.flatnonzero(n[back] > 1)
        maybe = maybe[np.argsort(h[maybe], kind="stable")]
        # sorted by the key, then the bytes; neighbours with all bytes in common are repeated
        data = np.frombuffer(b"".join(part["context"]), np.uint8)
        start = np.r_[0, np.cumsum(part["windows"].to_numpy().astype(np.int64) + length - 1)[:-1]]
        place = start[row] + at - part["first"].to_numpy()[row]
        hit = np.zeros(len(row), bool)
        done = 0
        while done < len(maybe):
            last = min(done + WINDOWS, len(maybe)) - 1
            to = int(np.searchsorted(h[maybe], h[maybe[last]], "right"))
            some = maybe[done:to]
            words = np.lib.stride_tricks.sliding_window_view(data, length)[place[some]]
            key = part["key"].to_numpy()[row[some]].astype(">i8").view(np.uint8).reshape(-1, 8)
            text = np.hstack([key, words]).view(f"V{length + 8}").ravel()
            order = np.argsort(text, kind="stable")
            text = text[order]
            same = text[1:] == text[:-1]
            hit[some[order[np.r_[False, same] | np.r_[same, False]]]] = True
            done = to
        hit &= part["single"].to_numpy()[row]
        row, at = row[hit], at[hit]
        new = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(at) != 1)][: len(row)])
        return pd.DataFrame({"rid": part["rid"].to_numpy()[row[new]], "first": at[new].astype(np.int32), "windows": np.diff(np.r_[new, len(row)]).astype(np.int32)})

    def run(batches):
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            split = int(np.searchsorted(batch["key"].to_numpy(), batch["key"].iloc[-1], "left")) if len(batch) else 0
            if split:
                yield compare(batch.iloc[:split])
            rest = batch.iloc[split:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield compare(rest)

    def single_windows(batches):
        for batch in batches:
            for i in range(0, len(batch), 2000):
                part = batch.iloc[i : i + 2000].reset_index(drop=True)
                row, at, h = windows_of(part, length)
                yield pd.DataFrame({"rid": part["rid"].to_numpy()[row], "at": at.astype(np.int32), "hash": h.view(np.int64), "single": part["single"].to_numpy()[row]})

    plain = contexts.where("not hot").repartition("key").sortWithinPartitions("key").mapInPandas(run, "rid long, first int, windows int")
    hot = contexts.where("hot").mapInPandas(single_windows, "rid long, at int, hash long, single boolean")
    # one shuffle of the windows: joining them with the counts of their fingerprints would make them twice
    found = hot.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("hash"))).where("n > 1 and single")
    return plain.union(found.select("rid", F.col("at").alias("first"), F.lit(1).alias("windows")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """docs (rid, text; equal rids have equal texts) -> rid, spans: an array of (first window, windows), repeated windows only."""
    stored, index = written(suffixes(docs, length, gram)), SuffixIndex(length, gram)
    for b in range(batches):
        index.add_suffixes(stored.where(F.pmod("rid", F.lit(batches)) == b), last=b + 1 == batches)
    return spans_of(stored, index.repeated_keys(), docs, length, hot)


def spans_of(stored: DataFrame, keys: DataFrame, docs: DataFrame, length: int, hot: int) -> DataFrame:
    """The repeated windows among the suffixes with repeated keys; `hot` changes the way, not the result."""
    runs = written(stored.join(keys, "key", "left_semi"))
    by_content = written(runs.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "first", "windows")).alias("one")))
    mixed_keys = by_content.groupBy("key").agg(F.count(F.lit(1)).alias("contents"), F.min("n").alias("least")).where("contents > 1 and least = 1").select("key", (F.col("contents") > hot).alias("hot"))
    open_runs = written(by_content.join(mixed_keys, "key").select("one.rid", "one.first", "one.windows", "key", (F.col("n") == 1).alias("single"), "hot"))
    parts = repeated_windows(written(open_contexts(docs, open_runs, length)), length)
    whole = runs.join(by_content.where("n > 1").select("key", "context"), ["key", "context"], "left_semi").select("rid", "first", "windows")
    return written(whole.union(parts).groupBy("rid").agg(F.collect_list(F.struct("first", "windows")).alias("spans")))


def merged_spans(spans: list[dict] | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the maximal runs that windows cover."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.array([(r["first"], r["first"] + r["windows"] - 1 + length) for r in spans], np.int64)
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.r_[True, s[1:, 0] > reach[:-1]]
    return s[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]]


def with_cuts(docs: DataFrame, text: str, length: int, keep: list[str], make, fields: dict[str, str], **options) -> DataFrame:
    """Columns k0, k1, ... for `keep`, as they are, and `fields` with what make(text, bytes, starts and ends of what is removed) gives."""
    inner = docs.select(F.xxhash64("doc_id", text).alias("rid"), F.col(text).alias("text"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)))
    spans = repeated_spans(inner.where(F.octet_length("text") >= length).select("rid", "text"), length, **options)
    kept = [f"k{i}" for i in range(len(keep))]
    schema = StructType([inner.schema[c] for c in kept] + StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields.items())).fields)
    types = to_arrow_schema(StructType(schema.fields[len(kept) :]))

    def run(batches):
        for batch in batches:
            made = []
            for value, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                made.append(make(value, (value or "").encode("utf-8"), *merged_spans(found, length)))
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*made, strict=True), types, strict=True)] if made else [pa.array([], f.type) for f in types]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *fields])

    inner = maybe_in(inner, bitmap(spans.select("rid")))
    cut = inner.where("maybe").join(spans, "rid", "left").select("text", *kept, "spans")
    whole = inner.where("not maybe").select("text", *kept, F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return cut.union(whole).mapInArrow(run, schema)


def left_of(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b"".join(data[a:b] for a, b in zip(np.r_[0, ends], np.r_[starts, len(data)], strict=True))


def suffix_dedup(docs: DataFrame, text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs.

    Removed are the bytes of each string of `length` bytes that also starts anywhere else, in the same text or another,
    judged on the texts as they come in. Null and empty texts, and those shorter than `length`, lose nothing. Rows that
    are equal (doc_id and text) repeat each other. Other columns take no part. An empty table gives an empty one.
    """

    def make(_, data, starts, ends):
        kept = left_of(data, starts, ends)
        return len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()

    out = with_cuts(docs, text, length, ["doc_id"], make, {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}, **options)
    return out.withColumnRenamed("k0", "doc_id")


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """docs with each text cut as `suffix_dedup` says; a character that loses some of its bytes goes as a whole. Null texts stay null; all other columns stay, whatever their names."""

    def make(value, data, starts, ends):
        return (left_of(data, starts, ends).decode("utf-8", "ignore") if len(starts) else value,)

    keep = [c for c in docs.columns if c != text]
    out = with_cuts(docs, text, length, keep, make, {"text": "string"}, **options)
    return out.select(*(F.col("text" if c == text else f"k{keep.index(c)}").alias(c) for c in docs.columns))
