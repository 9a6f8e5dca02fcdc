import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import fingerprint
from corpusloom.llm.queries import op7_fingerprint
from tests.conftest import SF


def lanes(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", fingerprint.fingerprint_lanes(F.col("t")).alias("l")).orderBy("i").select("l").collect()]


def test_homomorphism(spark):
    a, b, ab, ba, empty, null = lanes(spark, "one two three\nfour five", "six seven\neight", "one two three\nfour five\nsix seven\neight", "eight\nsix seven\nfour five\none two three", "", None)
    wrap = fingerprint.WRAP
    assert ab == ba and ab != a and empty == null == [0] * len(a)
    assert [(x + y) & wrap for x, y in zip(a, b, strict=True)] == ab
    df = spark.createDataFrame([(ab, b)], "x array<bigint>, y array<bigint>")
    assert df.select(fingerprint.combined(F.col("x"), F.col("y"), -1)).first()[0] == a


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.desc("doc_id")).collect()
    rows = {r["doc_id"]: r for r in op7_fingerprint(spark, SF).collect()}
    assert len(rows) == len(docs)
    higher = 0
    for i, d in enumerate(docs):
        text, after, r = d["text"], docs[(i + 1) % len(docs)]["text"], rows[d["doc_id"]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, changed = (brute_force(t) for t in (text, after, edited))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (digits(own), digits(changed))
        assert abs(r["near_edited"] - cosine(own, changed)) < 1e-9 and abs(r["near_next"] - cosine(own, other)) < 1e-9
        higher += r["near_edited"] > r["near_next"]
    assert higher > 0.95 * len(docs)
    by_text = {}
    for d in docs:
        assert by_text.setdefault(d["text"], rows[d["doc_id"]]["fingerprint"]) == rows[d["doc_id"]]["fingerprint"]
    assert len(set(by_text.values())) == len(by_text)


def brute_force(text):
    """The lanes by their definition, element by element."""
    h = lambda data, seed=42: xxhash.xxh64(data, seed=seed).intdigest()
    wrap = (1 << 60) - 1
    sums = [sum(h(p.encode(), h(struct.pack("<i", i))) & wrap for p in text.split("\n") if p) & wrap for i in range(4)]
    pieces = re.findall(r"(?:[^ \t\n\x0b\f\r]++[ \t\x0b\f\r]*+){1,4}+", text)
    hashes = [h(p.encode()) for p in pieces]
    counters = []
    for i in range(16):
        counts = [sum(x >> (i + 20 * k) & 1 for x in hashes) % (1 << 20) for k in range(3)]
        counters.append(sum(c << (20 * k) for k, c in enumerate(counts)))
    return [*sums, *counters, len(pieces)]


def digits(lanes):
    return "".join(f"{x:016x}" for x in lanes)


def cosine(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * (v >> 20 * k & 0xFFFFF) - lanes[-1] for v in lanes[4:-1] for k in range(3)] for lanes in (a, b))
    norm = sum(v * v for v in x) * sum(v * v for v in y)
    return max(0.0, min(1.0, sum(p * q for p, q in zip(x, y, strict=True)) / norm**0.5)) if norm else 0.0


def test_order_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 3)
    rng = random.Random(1)
    ids = rng.sample(range(-50, 1000), 40)
    texts = {i: f"t{i} " + "ж" * rng.randrange(6) for i in ids}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, lanes int")
    ranges = fingerprint.id_ranges(df, 3)
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(df.select("doc_id", "text"), ["text"], ranges).collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: texts[b] for a, b in zip(down, [*down[1:], down[0]], strict=True)}


def test_edges(spark):
    schema = "doc_id long, text string, fingerprint int"
    rows = [(None, "n", 1), (3, None, 1), (3, None, 1), (2, "", 1), (1, "abcd", 1)]
    got = fingerprint.edited_fingerprints(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5
    one = next(r for r in got if r["doc_id"] == 1)
    assert one["edited_sha256"] == hashlib.sha256(b"abn").hexdigest()  # the null id follows, and has one character
    alone = fingerprint.edited_fingerprints(spark.createDataFrame([(1, "ab cd", 1)], schema)).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest() and alone["near_next"] == 1.0
    assert fingerprint.edited_fingerprints(spark.createDataFrame([], schema)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = op7_fingerprint(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
