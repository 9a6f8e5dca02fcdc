"""What the operators of this subpackage share: reading tables, shared scratch space, 64-bit text hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..materialize import scratch, written  # noqa: F401
from ..ship import ship

U64 = np.uint64
#: Odd base of the polynomial hashes, and its inverse modulo 2**64.
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
#: A random 64-bit value for each byte.
BYTE_VALUES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


#: A bitmap of ids has 2**BITS bits.
BITS = 25


def bitmap(ids: DataFrame) -> DataFrame:
    """The ids (rid) as a bitmap of 2**BITS bits by hash: at most 2**BITS / 8 bytes, whatever their number, so it may be broadcast."""
    bit = F.pmod("rid", F.lit(1 << BITS))
    return written(ids.groupBy(F.floor(bit / 32768).cast("int").alias("_bucket")).agg(F.bitmap_construct_agg(bit % 32768).alias("_bits")))


def maybe_in(docs: DataFrame, bits: DataFrame) -> DataFrame:
    """docs with `maybe`: false only for rows whose rid isn't among the bitmap's ids. Keeps texts that aren't needed out of a shuffle."""
    bit = F.pmod("rid", F.lit(1 << BITS))
    place = (bit % 32768).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    x = docs.withColumn("_bucket", F.floor(bit / 32768).cast("int")).join(F.broadcast(bits), "_bucket", "left")
    return x.withColumn("maybe", F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))).drop("_bits", "_bucket")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, grown as needed and kept."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for k, base in enumerate((BASE, BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of value(byte k) * BASE**k over i <= k < j, modulo 2**64."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span [start, end), the same wherever the bytes stand."""
    _, down = powers(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z in lower case, split at space and U+0009 to U+000D) of all texts, and where each text's words end.

    Each distinct word's bytes are hashed on their own (xxh3), so that words which differ collide by chance alone.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    inside = np.r_[False, ~_SPACE[data], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    text_ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]), "left")
    if not len(starts):
        return np.zeros(0, np.uint64), text_ends
    letters = data[inside[1:-1]]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    known = words.dictionary.to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[words.indices.to_numpy()], text_ends


#: Characters of texts whose words are in memory at once; a longer text is taken alone.
CHUNK = 1 << 20


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles; a shorter text's whole sequence is one; none without words."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK or i == len(texts) - 1:
            out += _shingle_sets(texts[start : i + 1], words)
            start, size = i + 1, 0
    return out


def _shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    w, ends = word_hashes(texts)
    h = np.full(max(0, len(w) - words + 1), U64(words), np.uint64)
    for i in range(words if len(h) else 0):
        h = mixed(h * _STEP + w[i : len(w) - words + 1 + i])
    out, start = [], 0
    for end in ends.tolist():
        n = end - start
        if n >= words or not n:
            out.append(np.unique(h[start : end - words + 1]) if n else np.zeros(0, np.uint64))
        else:
            one = np.full(1, U64(n), np.uint64)
            for x in w[start:end]:
                one = mixed(one * _STEP + x)
            out.append(one)
        start = end
    return out


_STEP = U64(0xC2B2AE3D27D4EB4F)
