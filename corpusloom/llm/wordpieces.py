"""Pre-tokens of the word-end BPE vocabulary (lower case, white space dropped), shared by token counts and packing."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex

VOCABULARY = "word_bpe_49k.json"
#: Words that a task keeps; the memory is emptied when it is full, so that it is bounded by this number.
MEMO_WORDS = 200_000
NONE = np.int64(1 << 40)


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def split_rules(path: str):
    """(pattern of special strings, their ids, pattern of pre-tokens) as the vocabulary file states them."""
    spec = json.load(open(path, encoding="utf-8"))
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    rule = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    # \s of the library is Unicode's White_Space; \s of this module also has U+001C to U+001F
    words = regex.compile(rule.replace(r"[^\s", r"[^\p{White_Space}"), flags=regex.V0)
    marks = regex.compile("|".join(map(regex.escape, special))) if special else None
    return marks, special, words


def normalized(text: str) -> str:
    """NFC, then lower case of each character by itself (a final sigma isn't treated in another way)."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")
    return text.lower()


_SPACES = regex.compile(r"\p{White_Space}+")


def chunks(text: str, path: str) -> list[str]:
    """A text's parts between white space, as they stand, in order; special strings are parts of their own.

    White space bounds every pre-token and takes part in no composition, so parts can be normalized one by one.
    """
    marks, _, _ = split_rules(path)
    if "<|" not in text or not marks.search(text):
        return _split(text)
    out, at = [], 0
    for m in marks.finditer(text):
        out += _split(text[at : m.start()])
        out.append(m.group())
        at = m.end()
    return out + _split(text[at:])


def _split(text: str) -> list[str]:
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split, not to the vocabulary's pattern
        return [x for x in _SPACES.split(text) if x]
    return text.split()


#: Code points met so far that Python's Unicode data know; at most all of them.
_ASSIGNED: set[str] = set()


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pretokens(part: str, path: str) -> list[str]:
    """The pre-tokens of one part, normalized.

    The library may know a newer Unicode than Python: parts with a code point that Python calls unassigned are
    normalized and split by the library itself.
    """
    if not part.isascii() and not _ASSIGNED.issuperset(part):
        if any(unicodedata.category(c) == "Cn" for c in part):
            text = library(path).normalizer.normalize_str(part)
            return [text[a:b] for _, (a, b) in library(path).pre_tokenizer.pre_tokenize_str(text)]
        _ASSIGNED.update(part)
    part = normalized(part)
    if part.isalpha():  # letters alone are one pre-token
        return [part]
    if part[-1] in ".,;:!?" and part[:-1].isalpha():  # and so is a mark after them
        return [part[:-1], part[-1]]
    return split_rules(path)[2].findall(part)


class Memo:
    """Values of texts, put together from values of pre-tokens, which are made for many new ones at once.

    Parts and pre-tokens met before are kept; each of the two memories is emptied when it holds MEMO_WORDS of them. What
    is kept changes no value.
    """

    def __init__(self, path: str, make: Callable[[list[str]], list], combine: Callable, special: Callable[[int], object]):
        self.path, self.make, self.combine = path, make, combine
        self.special = {text: special(number) for text, number in split_rules(path)[1].items()}
        self.parts, self.words = dict(self.special), {}

    def values(self, texts: list[str | None]) -> list:
        found = [chunks(t, self.path) if t else [] for t in texts]
        distinct = set().union(*found)
        new = [c for c in distinct if c not in self.parts]
        if len(self.parts) + len(new) > MEMO_WORDS:
            self.parts = dict(self.special)
            new = [c for c in distinct if c not in self.parts]
        if new:
            split = [(c, pretokens(c, self.path)) for c in new]
            needed = {w for _, found_words in split for w in found_words}
            words = [w for w in needed if w not in self.words]
            if len(self.words) + len(words) > MEMO_WORDS:
                self.words, words = {}, list(needed)
            self.words.update(zip(words, self.make(words), strict=True))
            get = self.words.__getitem__
            self.parts.update((c, self.combine(map(get, w))) for c, w in split)
        get = self.parts.__getitem__
        return [self.combine(map(get, c)) for c in found]


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100."""
    letters = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    return letters | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in letters)}


class MergeTable:
    """The merges of a byte-level BPE vocabulary as sorted arrays: pair of symbols -> rank, merged symbol."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], np.arange(len(pairs))[order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def merged_counts(words: list[str], table: MergeTable) -> np.ndarray:
    """Tokens of each word by rank-synchronous merging.

    All words lie behind each other in one array of symbols. In each round every word applies its pair of lowest rank,
    everywhere in the word at once (left one first where pairs overlap); only ranks beside a merge are looked up again.
    Words without a pair that can be merged leave the array.
    """
    raw = [w.encode("utf-8") for w in words]
    sizes = np.array([len(r) for r in raw], np.int64)
    counts = np.zeros(len(words), np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    word = np.repeat(np.arange(len(words)), sizes)
    symbol = table.inner[data]
    ends = np.cumsum(sizes)[sizes > 0] - 1
    symbol[ends] = table.final[data[ends]]

    def ranks_at(i):
        out = np.full(len(i), NONE)
        ok = (i >= 0) & (i + 1 < len(symbol))
        ok[ok] = word[i[ok]] == word[i[ok] + 1]
        out[ok] = table.rank(symbol[i[ok]], symbol[i[ok] + 1])
        return out

    rank = ranks_at(np.arange(len(symbol)))
    while len(symbol):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lengths = np.diff(np.r_[first, len(word)])
        lowest = np.minimum.reduceat(rank, first)
        done = lowest == NONE
        if done.any():
            counts[word[first[done]]] = lengths[done]
            stay = np.repeat(~done, lengths)
            symbol, word, rank = symbol[stay], word[stay], rank[stay]
            lowest, lengths = lowest[~done], lengths[~done]
            if not len(symbol):
                break
        hits = np.flatnonzero(rank == np.repeat(lowest, lengths))
        run = np.r_[True, np.diff(hits) != 1]  # overlapping pairs stand at adjacent places: each second one is merged
        start = hits[run][np.cumsum(run) - 1]
        hits = hits[(hits - start) % 2 == 0]
        symbol[hits] = table.merged[rank[hits]]
        stay = np.ones(len(symbol), bool)
        stay[hits + 1] = False
        now = hits - np.arange(len(hits))
        symbol, word, rank = symbol[stay], word[stay], rank[stay]
        for changed in (now, now[now > 0] - 1):
            rank[changed] = ranks_at(changed)
    return counts
