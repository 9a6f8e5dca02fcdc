"""Column functions for text: lines, quotes, normal forms, regular expressions with Unicode classes."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from itertools import product
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line ends of Unicode text.
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\x{2028}\x{2029}]"
#: White space of any kind.
_SPACES = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACE_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def pattern(p: str, ignore_case: bool = False) -> str:
    r"""A pattern whose \w, \b, \s and \d know Unicode, as a regular expression of the JVM."""
    return ("(?iuU)" if ignore_case else "(?U)") + p


#: Letters that a pattern without case takes for others, and that stay as they are in lower case; the last one is what is left of a dotted capital I.
_VARIANTS, _LETTERS = "\u017f\u0131\u1c80\u1c81\u1c82\u1c83\u1c84\u1c85\u1c86\u1c87\u1c88\u0307", "siвдосттъѣꙋ"


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def folded(text: Column) -> Column:
    """A text in which `may_match` looks for letters: lower case, and one form of letters that differ in nothing else."""
    low = F.lower(text)
    return F.when(_is_ascii(text), low).otherwise(F.translate(low, _VARIANTS, _LETTERS))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns, made by a generator, so that conditions on them don't work them out again for each mention."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


#: Strings that a part of a pattern is spelled out to.
_SPELLED = 64


def _spelled(node) -> set[str] | None:
    """All strings that match a part of a pattern, if they are few."""
    op, value = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(value).lower()}
    if op == "IN" and len(value) <= 4 and all(str(o) == "LITERAL" for o, _ in value):
        return {chr(v).lower() for _, v in value}
    if op in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}
    if op == "SUBPATTERN":
        return _joined(value[-1])
    if op == "BRANCH":
        parts = [_joined(x) for x in value[1]]
        return set().union(*parts) if all(p is not None for p in parts) and sum(map(len, parts)) <= _SPELLED else None
    if op in ("MAX_REPEAT", "MIN_REPEAT") and value[1] == 1:
        own = _joined(value[2])
        return own if own is None or value[0] else own | {""}
    return None


def _joined(nodes) -> set[str] | None:
    out = {""}
    for own in map(_spelled, nodes):
        if own is None or len(out) * len(own) > _SPELLED:
            return None
        out = {a + b for a, b in product(out, own)}
    return out


def _best(nodes) -> set[str] | None:
    """Strings of which each match holds one, as long as can be."""
    found, run = [], {""}
    for node in nodes:
        own, op, value = _spelled(node), str(node[0]), node[1]
        if own is not None and len(run) * len(own) <= _SPELLED:
            run = {a + b for a, b in product(run, own)}
            continue
        found.append(run)
        run = {""} if own is None else own
        if own is None and op == "BRANCH":
            parts = [_best(x) for x in value[1]]
            found += [set().union(*parts)] if all(parts) else []
        elif own is None and (op == "SUBPATTERN" or (op in ("MAX_REPEAT", "MIN_REPEAT") and value[0])):
            found.append(_best(value[-1]) or {""})
    sets = [{s for s in x if not any(o in s for o in x if o != s)} for x in [*found, run] if "" not in x]
    return max(sets, key=lambda x: (min(map(len, x)), -len(x)), default=None)


@lru_cache(None)
def needles(p: str) -> frozenset[str] | None:
    """Strings in lower case of which each match of a pattern holds one; None if there are none that tell."""
    try:
        found = _best(parser.parse(re.sub(r"^\(\?[a-zA-Z]+\)", "", p)))
    except re.error:  # only the JVM reads it
        return None
    return found and frozenset(found)


def may_match(low: Column, *patterns: str) -> Column:
    """Whether a text, of which `low` is the folded form, can match one of the patterns: a search for plain strings, which costs much less than a pattern."""
    found = [needles(p) for p in patterns]
    if None in found:
        return F.lit(True)
    some = lambda words: reduce(Column.__or__, (low.contains(w) for w in words), F.lit(False))
    words = sorted(set().union(*found))
    words = [w for w in words if not any(o in w for o in words if o != w)]
    return some(w for w in words if w.isascii()) | (~_is_ascii(low) & some(w for w in words if not w.isascii()))


def split_lines(text: Column) -> Column:
    """A text's lines without their ends; no empty line after a last line end. Null gives null."""
    return without_empty_end(F.split(text, LINE_END))


def without_empty_end(parts: Column) -> Column:
    """Parts of a text without the empty one after its last line end."""
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(_SPACE_CHARS))


def squeeze(text: Column) -> Column:
    """Stripped, runs of white space as one space."""
    return F.trim(F.regexp_replace(text, f"[{_SPACES}]+", " "))


def line_number(text: Column, offset: Column) -> Column:
    """The line (from 1, counting only newlines) of a 0-based offset in code points."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return (F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def line_number_of_end(text: Column, start: Column, end: Column) -> Column:
    """The line of the last code point of a match [start, end)."""
    return line_number(text, F.greatest(start, end - 1))


def quote_around(text: Column, start: Column, end: Column, limit: int = 320) -> Column:
    """The whole lines of a match, squeezed; longer ones cut to limit - 1 code points and an ellipsis."""
    before, after = F.substring(text, F.lit(1), start.cast("int")), F.substring(text, (end + 1).cast("int"), F.char_length(text))
    head = F.substring_index(before, "\n", -1)
    tail = F.substring_index(after, "\n", 1)
    inside = F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
    quote = squeeze(F.concat(head, inside, tail))
    return F.when(F.char_length(quote) <= limit, quote).otherwise(F.concat(F.substring(quote, 1, limit - 1), F.lit("…")))


def context_around(text: Column, start: Column, end: Column, radius: int = 500) -> Column:
    """Up to radius code points on either side of a match, stripped."""
    left = F.greatest(F.lit(0), start - radius)
    return strip(F.substring(text, (left + 1).cast("int"), (end + radius - left).cast("int")))


def normalize_for_match(text: Column) -> Column:
    """Lower case; anything but Latin and Russian letters and digits is one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-zа-яё0-9]+", " "))


def normalize_issue_text(text: Column) -> Column:
    """The form in which gold and found texts are compared: lower case, no URL schemes, no punctuation, single spaces."""
    lowered = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"https?:[/\\]+", " ")
    return F.trim(F.regexp_replace(lowered, rf"[`*_\"'«»()\[\]{{}}:;,.!?/\\|{_SPACES}]+", " "))


def sentences(line: Column) -> Column:
    """A line's sentences: split after . ! or ? and white space."""
    return F.split(line, r"(?U)(?<=[.!?])\s+")


def all_matches(text: Column, regex: str) -> Column:
    """array<struct<value, start>>: matches in order with their 0-based offsets in code points."""
    values = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    pieces = F.split(text, regex)
    state = "struct<at:int,found:array<struct<value:string,start:int>>>"

    def step(s: Column, i: Column) -> Column:
        start = s["at"] + F.char_length(F.get(pieces, i))
        value = F.get(values, i)
        return F.struct((start + F.char_length(value)).alias("at"), F.concat(s["found"], F.array(F.struct(value.alias("value"), start.alias("start")))).alias("found")).cast(state)

    zero = F.struct(F.lit(0).alias("at"), F.array().alias("found")).cast(state)
    indices = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(indices, zero, step)["found"]
