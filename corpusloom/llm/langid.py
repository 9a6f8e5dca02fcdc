"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language has a codeword; one binary classifier per bit predicts it from a text's n-gram profile, and the language
whose codeword has the smallest loss, weighted by how reliable each bit was in training, is chosen. When the runner-up
is close, the text is flagged as ambiguous.

The classifiers are fitted on the driver from the profiles of at most SAMPLE labelled documents (profiles, not texts,
come to the driver); prediction reads whole texts in the tasks and shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name

DIM = 4096
ORDERS = (2, 3, 4)
SAMPLE = 1000
UNKNOWN = "und"
#: Runner-up this close in probability: ambiguous.
MARGIN = 0.1
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(128)]


def has_letter(text: str) -> bool:
    """Whether a text has a letter (\\p{L}); numerals like those of U+00BD, U+00B2, U+2460 and U+2167 are none."""
    return any(map(str.isalpha, text))


def profile(text: str) -> np.ndarray:
    """The hashed counts of a text's byte n-grams (A-Z in lower case, other ASCII as spaces), square-rooted, of length 1."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    x = _FOLD[data]
    x = x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]] if len(x) else x  # runs of spaces as one
    counts = np.zeros(DIM)
    h = x
    for n in range(2, max(ORDERS) + 1):
        if len(x) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) ^ x[n - 1 :]
        if n in ORDERS:
            counts += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12), minlength=DIM)
    counts = np.sqrt(counts)
    norm = np.sqrt((counts * counts).sum())
    return (counts / norm if norm else counts).astype(np.float32)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +-1: all splits for few classes, else the best separated of some random codes of 10 log2 n bits."""
    if n <= 5:
        bits = [[1 if (k >> i) & 1 else -1 for i in range(n)] for k in range(1 << (n - 1), (1 << n) - 1)] or [[1] * n]
        return np.array(bits).T
    rng, length, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None
    for _ in range(30):
        code = rng.choice([-1, 1], (n, length))
        apart = ((code[:, None] != code[None]).sum(axis=2) + length * np.eye(n, dtype=int)).min()
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # DIM x bits
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, its probability, whether the runner-up is close)."""
        margins = profiles @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        order = np.sort(p, axis=1)
        close = order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0) < MARGIN
        return p.argmax(axis=1), p.max(axis=1), close


def fit(profiles: np.ndarray, labels: list[str], rounds: int = 150, decay: float = 1e-4) -> Model:
    """Logistic regressions of the codewords' bits, by gradient steps with momentum over the whole sample."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    index = {x: i for i, x in enumerate(languages)}
    y = np.array([index[x] for x in labels])
    target = code[y].astype(np.float32)
    balance = (1 / np.bincount(y))[y].astype(np.float32)
    balance = (balance / balance.sum())[:, None]
    x = profiles.astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        g = -target * balance / (1 + np.exp(target * (x @ w + b)))
        vw = 0.9 * vw - 4.0 * (x.T @ g + decay * w)
        vb = 0.9 * vb - 0.4 * g.sum(axis=0)
        w, b = w + vw, b + vb
    right = (((x @ w + b) * target > 0) * balance).sum(axis=0)
    trust = np.log((right + 0.01) / (1.01 - np.minimum(right, 1.0)))
    trust = np.maximum(trust, 0.01)
    return Model(languages, code, w, b, trust / trust.mean())


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model | None:
    """The model of a hash-random sample, equal numbers of each language as far as there are; None without labelled texts.

    At most `sample` documents are fitted, or one of each language if there are more languages than that.
    """
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col(text).rlike(r"\p{L}"))
    ids = usable.select("doc_id", "lang")
    found = [r[0] for r in ids.select("lang").distinct().orderBy("lang").collect()]  # a row per language
    if not found:
        return None
    order = W.partitionBy("lang").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id")
    chosen = ids.where(F.col("lang").isin(found)).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= max(1, sample // len(found))).select("doc_id", "lang")
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, lang string")  # at most `sample` rows

    def profiles(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "profile": [profile(t).tobytes() for t in batch["text"]]})

    # of several texts under one id and language the smallest, so that reruns agree
    rows = usable.select("doc_id", "lang", F.col(text).alias("text")).join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = rows.mapInPandas(profiles, "doc_id long, lang string, profile binary").orderBy("doc_id", "lang").collect()
    return fit(np.stack([np.frombuffer(r["profile"], np.float32) for r in rows]), [r["lang"] for r in rows])


def prediction(spark: SparkSession, model: Model | None, text: str = "text") -> Column:
    """A struct of lang_pred, score (0 to 1) and ambiguous for each text.

    A text that is null or has no letter is UNKNOWN with score 0 and ambiguous, and so is every text without a model.
    Texts go to Python once, a few megabytes at a time, and don't come back.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def found(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        has = np.array([isinstance(t, str) and bool(has_letter(t)) for t in texts], bool)
        lang, score, flag = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.ones(len(texts), bool)
        if m is not None and has.any():
            at = np.flatnonzero(has)
            for part in np.array_split(at, -(-len(at) // 512)):
                best, p, close = m.decode(np.stack([profile(texts.iloc[i]) for i in part]))
                lang[part], score[part], flag[part] = np.array(m.languages, object)[best], p, close
        return pd.DataFrame({"lang_pred": lang, "score": score, "ambiguous": flag})

    # not deterministic to the optimizer, so that a condition on the result doesn't run it a second time
    return found.asNondeterministic()(F.col(text))


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with lang_pred, score and ambiguous as `prediction` says; kept columns of those names are replaced."""
    name = free_name(docs, "found")
    kept = [c for c in keep if c.lower() not in ("lang_pred", "score", "ambiguous")]
    return docs.withColumn(name, prediction(docs.sparkSession, model, text)).select(*kept, f"{name}.lang_pred", f"{name}.score", f"{name}.ambiguous")


def language_of(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of each row, learned from the rows that aren't held out.

    Held out are documents whose crc32 of doc_id as text leaves 1 modulo 3; a null doc_id isn't held out and isn't
    learned from. Labels, sources and ids are no inputs of a prediction. Repeated rows get the same prediction.
    """
    model = learned(docs, text, sample)
    out = identify(docs.select("doc_id", F.col(text).alias("text"), held_out().alias("held_out")), model, keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
