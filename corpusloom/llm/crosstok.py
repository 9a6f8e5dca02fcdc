"""Alignment of the tokens of two tokenizers over a corpus, in Arrow tables.

Two passes over the texts, each a `mapInArrow` without a shuffle of texts:

1. Each task lists both tokenizers' tokens as Arrow lists; flattening them with parent indices and a segmented cumulative sum
   of token lengths gives byte ends within a document. A hash join on (document, end) finds where both tokenizers end a token
   together. Pairs of overlapping tokens are counted by `Table.group_by`; Spark adds up the tasks' partial counts.
2. The pair counts, in slices of PAIRS rows at most, go to the tasks, which look up each link. Beyond one slice the documents
   pass through once per slice, and each adds its part of the sums.

Neither tokenizer has a token across the end of a word and a following space or line feed (`Pair.cuts` looks at the
vocabulary). So texts are cut there into units, each distinct unit is aligned once in a task, and a document's results are
put together from those of its units. Units of a task are forgotten beyond UNITS.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct units that a task remembers; bytes of the strings that units are tokenized in; pair counts in a slice.
UNITS, CARRIER, PAIRS = 500_000, 4096, 4_000_000
#: A unit that ends cleanly; each carrier starts with it, so that the next unit follows a word.
LEAD = " a"
_SHIFT = 32


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes and lengths of their tokens, and whether texts may be cut into units."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes = [pa.array(x, pa.binary()) for x in (a_bytes, b_bytes)]
        self.sizes = [pa.array([len(t) for t in x], pa.int64()) for x in (a_bytes, b_bytes)]
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)

    def tokens(self, texts: list[str]) -> list[pa.ListArray]:
        """Ids of both tokenizers of texts that start with a space."""
        kind = pa.list_(pa.int32())
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return [pa.array(a, kind), pa.array(self.b.encode([t[1:] for t in texts], num_threads=1), kind)]


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def placed(tokens: pa.ListArray, sizes: pa.Array) -> pa.Table:
    """doc, id, end (bytes from the start of its document), total (from the start of all)."""
    ids, doc = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
    total = pc.cumulative_sum(sizes.take(ids))
    before = np.concatenate([[0], total.to_numpy()])[tokens.offsets.to_numpy()[:-1]]
    end = pc.subtract(total, pa.array(before).take(doc))
    return pa.table({"doc": doc, "id": ids, "end": end, "total": total, "row": pa.array(np.arange(len(ids)))})


def common_ends(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a and b that end at the same byte of a document, in order."""
    found = a.select(["doc", "end", "row"]).join(b.select(["doc", "end", "row"]), ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False)
    found = found.sort_by("row")
    return found["row"].to_numpy(), found["row_b"].to_numpy()


def overlaps(a: pa.Table, b: pa.Table, a_sizes: pa.Array, b_sizes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b whose bytes overlap, in order of a, then b. Both cover the same bytes."""
    a_end, b_end = a["total"].to_numpy(), b["total"].to_numpy()
    a_start, b_start = a_end - a_sizes.take(a["id"].combine_chunks()).to_numpy(), b_end - b_sizes.take(b["id"].combine_chunks()).to_numpy()
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = high - low
    first = np.repeat(np.arange(len(n)), n)
    return first, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def joined(strings: pa.Array, ends: np.ndarray, mark: str) -> pa.Array:
    """Neighbouring strings put together up to each end."""
    offsets = pa.array(np.concatenate([[0], ends]), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, strings), pa.scalar(mark, strings.type))


def same_bytes(pieces: pa.Array, plain: bytes) -> bool:
    """Whether the pieces (no nulls, from a take) put together are plain."""
    _, offsets, data = pieces.buffers()
    return (data.slice(0, int(np.frombuffer(offsets, np.int32)[len(pieces)])).equals(pa.py_buffer(plain)) if data is not None else not plain)


def clean_end(unit: str) -> bool:
    """Whether a space or line feed after it starts a unit: it ends in printable ASCII or a character of two bytes from U+00C0 on."""
    return "!" <= unit[-1] <= "~" or "\u00c0" <= unit[-1] <= "\u07ff"


def units_of(texts: pa.Array, cuts: bool) -> tuple[pa.Array, np.ndarray]:
    """Units of texts (no nulls, each with its leading space) and the number of units up to the end of each text."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts = offsets[:-1].astype(np.int64)
    if cuts:
        at = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
        at = at[(at >= offsets[0] + 2) & (at < offsets[-1])]
        last, before = raw[at - 1], raw[at - 2]
        first = np.zeros(len(raw), bool)
        first[at[((last >= 0x21) & (last <= 0x7E)) | ((last >= 0x80) & (last <= 0xBF) & (before >= 0xC3) & (before <= 0xDF))]] = True
        first[starts] = True
        starts = np.flatnonzero(first)
    ends = np.searchsorted(starts, offsets[1:], "left")
    bounds = np.concatenate([starts, offsets[-1:]]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds.tobytes()), data), ends


class Units:
    """What a task knows of the units that it has met: their numbers of tokens, groups and links, and more as asked."""

    def __init__(self, tools: Pair, counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None, named: bool):
        self.tools, self.counts, self.named = tools, counts, named
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.numbers = np.zeros((0, 7), np.int64)  # n_a, n_b, n_groups, n_links, n_best, count_sum, broken
        self.links: list[tuple[np.ndarray, ...]] = []
        self.groups = pa.array([], pa.large_string())
        self.weights = np.zeros(0, np.int64)

    def number(self, units: pa.Array) -> np.ndarray:
        """The number of each unit; new ones are aligned."""
        coded = units.dictionary_encode()
        met = coded.dictionary.to_pylist()
        new = [u for u in met if u not in self.index]
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        if new:
            self.align(new)
        return np.fromiter(map(self.index.__getitem__, met), np.int64, len(met))[coded.indices.to_numpy()]

    def align(self, new: list[str]) -> None:
        numbers = np.zeros((len(new), 7), np.int64)
        names = np.full(len(new), "", object)
        carriers, size = [[]], 0
        for k, unit in enumerate(new):
            carriers[-1].append(k)
            size += len(unit)
            if size >= CARRIER or not clean_end(unit):
                carriers.append([])
                size = 0
        self.sizes = pc.binary_length(pa.array(new)).to_numpy()
        wrong = self.aligned(new, [c for c in carriers if c], numbers, names)
        alone = self.aligned(new, [[k] for c in wrong for k in c], numbers, names) if wrong else []
        for (k,) in alone:
            numbers[k, 6] = 1
        self.numbers = np.concatenate([self.numbers, numbers])
        if self.named:
            self.groups = pa.concat_arrays([self.groups, pa.array(names, pa.large_string())])

    def aligned(self, new: list[str], carriers: list[list[int]], numbers: np.ndarray, names: np.ndarray) -> list[list[int]]:
        """Fills numbers and names for the units in carriers; returns the carriers whose tokens don't give back their bytes."""
        base = len(self.numbers)
        texts = [LEAD + "".join(new[k] for k in c) for c in carriers]
        tokens = self.tools.tokens(texts)
        whole = [self.tools.bytes[i].take(pc.list_flatten(t)) for i, t in enumerate(tokens)]
        if not all(same_bytes(w, "".join(texts).encode()) for w in whole):
            said = [[b"".join(whole[i][s:e].to_pylist()) for s, e in zip(t.offsets.to_pylist(), t.offsets.to_pylist()[1:], strict=False)] for i, t in enumerate(tokens)]
            fine = [a == t.encode() == b for a, b, t in zip(*said, texts, strict=True)]
            if not all(fine):
                left = [c for c, ok in zip(carriers, fine, strict=True) if ok]
                if left:
                    self.aligned(new, left, numbers, names)
                return [c for c, ok in zip(carriers, fine, strict=True) if not ok]
        a, b = (placed(t, s) for t, s in zip(tokens, self.tools.sizes, strict=True))
        # the places of all units in the order of carriers, each carrier led by LEAD, which is unit -1
        order = np.array([k for c in carriers for k in (-1, *c)])
        unit_end = np.cumsum(np.concatenate([self.sizes, [len(LEAD)]])[order])
        place = lambda end: np.searchsorted(unit_end, end, "left")
        a_total, b_total = a["total"].to_numpy(), b["total"].to_numpy()
        cut_a, cut_b = common_ends(a, b)
        first, second = overlaps(a, b, *self.tools.sizes)
        n = len(order)
        own = order >= 0
        at = order[own]
        link_place = place(a_total[first])
        cut_place = place(a_total[cut_a])
        for j, where in enumerate((place(a_total), place(b_total), cut_place, link_place)):
            numbers[at, j] = np.bincount(where, minlength=n)[own]
        ids = (a["id"].combine_chunks().to_numpy()[first].astype(np.int64) << _SHIFT) | b["id"].combine_chunks().to_numpy()[second]
        if self.counts is None:
            keep = own[link_place]
            self.links.append((order[link_place[keep]] + base, ids[keep]))
        else:
            keys, n_links, best = self.counts
            if len(keys):
                found = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
                hit = keys[found] == ids
                numbers[at, 4] = np.bincount(link_place, (hit & best[found]).astype(float), n)[own].astype(np.int64)
                # sums stay below 2**53 only for short units, so they are added as integers
                total = np.zeros(n, np.int64)
                np.add.at(total, link_place, np.where(hit, n_links[found], 0))
                numbers[at, 5] = total[own]
        if self.named:
            sides = [joined(pc.cast(t["id"].combine_chunks(), pa.string()), cut + 1, ",") for t, cut in ((a, cut_a), (b, cut_b))]
            groups = pc.binary_join_element_wise(*sides, "|")
            unit_groups = joined(groups, np.searchsorted(cut_place, np.arange(n), "right"), ";").to_numpy(zero_copy_only=False)
            names[at] = unit_groups[own]
        return []

    def counted(self) -> pa.Table:
        """Links of all units by pair of ids, each as often as its unit was met."""
        if not self.links:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        unit, ids = (np.concatenate(x) for x in zip(*self.links, strict=True))
        table = pa.table({"ids": ids, "n": self.weights[unit]}).group_by("ids", use_threads=False).aggregate([("n", "sum")])
        ids, n = table["ids"].to_numpy(), table["n_sum"].to_numpy()
        return pa.table({"a": ids >> _SHIFT, "b": ids & ((1 << _SHIFT) - 1), "n": n})


def documents(texts: pa.Array, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with tokens their rows, the units' numbers, their ends, and whether each text comes back whole."""
    texts = texts.cast(pa.string())
    rows = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
    full = pc.binary_join_element_wise(pa.scalar(" "), texts.take(pa.array(rows)), "")
    if not len(rows):
        return rows, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    found, ends = units_of(full, units.tools.cuts)
    numbers = units.number(found)
    broken = np.concatenate([[0], np.cumsum(units.numbers[numbers, 6])])
    return rows, numbers, ends, broken[ends] == broken[np.concatenate([[0], ends[:-1]])]


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs (text) -> a, b, n: how many links of the corpus hold the two ids, and best: whether n is the highest of its b."""

    def run(batches):
        units = Units(pair(a_path, b_path), None, False)
        for batch in batches:
            _, numbers, ends, whole = documents(batch.column("text"), units)
            if len(ends):
                fine = np.repeat(whole, np.diff(ends, prepend=0))
                met = np.bincount(numbers[fine], minlength=len(units.numbers))
                met[: len(units.weights)] += units.weights
                units.weights = met
            if len(units.numbers) > UNITS:
                yield from units.counted().to_batches()
                units.forget()
        yield from units.counted().to_batches()

    found = docs.select("text").mapInArrow(run, "a long, b long, n long").where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    found = written(found)
    return written(found.join(found.groupBy("b").agg(F.max("n").alias("most")), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))


def slices(counts: DataFrame) -> list[DataFrame]:
    """Pair counts in as many parts as they need at PAIRS rows each, by hash."""
    n = max(1, -(-counts.count() // PAIRS))
    return [counts.where(F.pmod(F.xxhash64("a", "b"), F.lit(n)) == i) for i in range(n)]


def looked_up(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = (table["a"].to_numpy() << _SHIFT) | table["b"].to_numpy()
    order = np.argsort(ids)
    return ids[order], table["n"].to_numpy()[order], table["best"].to_numpy(zero_copy_only=False).astype(bool)[order]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def alignment(docs: DataFrame, text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, a row per row of docs.

    Null and empty texts, and those that either tokenizer changes (U+2581 is one such character), have no tokens: zeros and
    an empty hash; they count in no pair. Repeated rows count each; other columns take no part; no rows give none. A text,
    however long, is cut into units first, of which one without any space or line feed is a single one.
    """
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path, b_path = a_path or public_tokenizers.path(A_NAME), b_path or public_tokenizers.path(B_NAME)
    x = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    key = x.schema["doc_id"].dataType.simpleString()
    parts = slices(pair_counts(x, a_path, b_path))
    x = x.select("doc_id", "text", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    for i, part in enumerate(parts):
        counts, last = docs.sparkSession.sparkContext.broadcast(looked_up(part.toArrow())), i == len(parts) - 1

        def run(batches, counts=counts, last=last):
            units = Units(pair(a_path, b_path), counts.value, last)
            for batch in batches:
                rows, numbers, ends, whole = documents(batch.column("text"), units)
                out = np.zeros((len(batch), 6), np.int64)
                out[:, 4], out[:, 5] = batch.column("n_best").to_numpy(), batch.column("count_sum").to_numpy()
                before = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                if len(rows):
                    sums = np.add.reduceat(units.numbers[numbers, :6], before, axis=0)
                    out[rows[whole]] += sums[whole]
                columns = {"doc_id": batch.column("doc_id")}
                if last:
                    sha = np.full(len(batch), "", object)
                    if len(rows):
                        said = joined(units.groups.take(pa.array(numbers)), ends, ";")
                        for r, s, ok in zip(rows, said, whole, strict=True):
                            if ok:
                                sha[r] = hashlib.sha256(s.as_buffer()).hexdigest()
                    columns |= {c: pa.array(out[:, j]) for j, c in enumerate(NUMBERS)} | {"groups_sha256": pa.array(sha, pa.string())}
                else:
                    columns |= {"text": batch.column("text"), "n_best": pa.array(out[:, 4]), "count_sum": pa.array(out[:, 5])}
                yield pa.RecordBatch.from_pydict(columns)
                if len(units.numbers) > UNITS:
                    units.forget()

        final = f"doc_id {key}, {', '.join(f'{c} long' for c in NUMBERS)}, groups_sha256 string"
        x = x.mapInArrow(run, final if last else f"doc_id {key}, text string, n_best long, count_sum long")
    return x
