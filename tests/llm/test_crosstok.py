import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corpusloom.llm import crosstok
from corpusloom.llm.queries import op11_token_alignment
from tests.conftest import SF

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(texts):
    """Each whole text through both libraries, token by token."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [i for i in range(256) if chr(i).isprintable() and chr(i) not in " \xa0\xad"]
    letters = {chr(i): i for i in plain} | {chr(256 + n): i for n, i in enumerate(i for i in range(256) if i not in plain)}
    aligned = []
    for text in texts:
        want = (" " + (text or "")).encode()
        x = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        y = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in (b.id_to_piece(i),)] if text else []
        if not text or b"".join(t for _, t in x) != want or b"".join(t for _, t in y) != want:
            aligned.append(None)
            continue
        spans = []
        for tokens in (x, y):
            at, found = 0, []
            for i, t in tokens:
                found.append((i, at, at + len(t)))
                at += len(t)
            spans.append(found)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        sides = []
        for side in spans:
            cut, own = [[]], set(ends)
            for i, _, e in side:
                cut[-1].append(str(i))
                if e in own:
                    cut.append([])
            sides.append([",".join(c) for c in cut if c])
        groups = ["|".join(g) for g in zip(*sides, strict=True)]
        links, k = [], 0
        for i, s, e in spans[0]:
            while spans[1][k][2] <= s:
                k += 1
            m = k
            while m < len(spans[1]) and spans[1][m][1] < e:
                links.append((i, spans[1][m][0]))
                m += 1
        aligned.append((len(x), len(y), groups, links))
    counts = Counter(link for x in aligned if x for link in x[3])
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    none = (0, 0, 0, 0, 0, 0, "")
    return [none if x is None else (x[0], x[1], len(x[2]), len(x[3]), sum(counts[v] == most[v[1]] for v in x[3]), sum(counts[v] for v in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()) for x in aligned]


def check(rows, data):
    want = dict(zip([i for i, _ in data], brute([t for _, t in data]), strict=True))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(rows) == len(data)
    for i in want:
        assert got[i] == want[i], i


def test_query(spark):
    check(op11_token_alignment(spark, SF).collect(), [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])


ODD = [
    "", None, " ", "  ", "\n", " \n ", "a  b", "a \n b", "it's  the\n\n end. ", "▁", "a▁b c", "x y", "tab\there", "\r\n x\r\ny", "<s> </s> <unk> <|endoftext|>", "<0x41>", "é ½ ﬁ", "日本 語。　x", "🙂 🙂🙂 a",
    "  a", "\u0085 b", "\0 c", "café crème\nété ", "слово слово.\n слово", "x" * 300, " " * 70, "12345 67 8,9.0", "l'été d'or 's 're", "\x7f y", "a​ b", "İ ı", "end ",
]


@pytest.mark.parametrize("units, pairs", [(500_000, 4_000_000), (50, 400)])
def test_odd_texts(spark, monkeypatch, units, pairs):
    """Also with units that are forgotten and pair counts in many slices."""
    monkeypatch.setattr(crosstok, "UNITS", units)
    monkeypatch.setattr(crosstok, "PAIRS", pairs)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["a", "é", " ", "\n", "the", ".", "▁" if rng.random() < 0.03 else "x", "\t", "　", "ж", "'s", "9", "\r", "🙂"]) for _ in range(rng.randrange(40))) for _ in range(500)]
    data = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in data], "doc_id long, text string, n_best int, a string").repartition(3)
    check(crosstok.alignment(df).collect(), data)


def test_long_text(spark):
    text = "the cat's été 日本 " * 20000 + "x" * 5000
    rows = crosstok.alignment(spark.createDataFrame([(1, text), (1, text), (None, "a b")], "doc_id long, text string")).collect()
    one, two, last = sorted(rows, key=lambda r: -r["n_a"])
    assert one == two and last["doc_id"] is None
    data = [(1, text), (2, text), (3, "a b")]
    assert tuple(one[c] for c in COLUMNS) == brute([t for _, t in data])[0]


def test_nothing(spark):
    assert crosstok.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0
