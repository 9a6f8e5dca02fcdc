"""Alignment of gold cases and findings by anchors, stems and text."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_issue_text
from ..materialize import written
from ..schema import severity_rank
from .evaluate import artifact_words, letter_counts, line_relation, matched_share
from .matching import greedy

# Patterns, suffixes, stop words, file families, thresholds.
URL = r"(?i)https?:[/\\]+[^\s)>\]\"'|]+"
FILE = r"(?iU)[\w\-./]+\.(?:sql|docx?|md|ya?ml|png|jpe?g|pcapng|pcap|py|js|java|go|c|h|sh|txt|xlsx|csv)"
QUOTE = "[`«\"']([^`«»\"']{3,80})[`»\"']"
SUFFIXES = (
    "ами ями ому ему ого его ыми ими ая яя ое ее ые ие ой ей ом ем ах ях ов ев ам ям ть ся ия ию ий ла ло ли на ну ет ут ют ат ят а я о е ы и у ю й ь"
).split()
STOPWORDS = "и в не на что с по для к о из у же а это бы то все или но как этот так".split()
OPINIONS = ("по-моему", "на мой взгляд", "кажется", "показалось", "хорошо бы", "хотелось бы", "лучше", "стоит", "можно добавить", "можно было", "необязательн", "бесполезн", "трудоемкость", "трудоёмкость", "я бы", "добавить задачу", "добавить информаци", "добавить понимание", "не очень актуальн")
FAMILIES = {"readme.md": "readme", "readme_rus.md": "readme", "readme_eng.md": "readme", "check-list.yml": "checklist", "check-list_rus.yml": "checklist", "check-list_uzb.yml": "checklist"}
VALID_TYPES = (
    "broken_url_syntax missing_label_colon duplicate_anchor duplicate_heading sort_direction_conflict invalid_definition tautology repeated_numbered_list_items numbered_list_reset "
    "expected_file_name_mismatch artifact_missing_expected_text missing_local_resource spec_code_output_mismatch spec_code_contradiction course_language_material_mismatch "
    "language_material_conflict inappropriate_tool language_tooling_conflict ungrounded_sql_condition ungrounded_self_join_order suspicious_duplicate_name_result case typo"
).split()
PRESCREEN_MIN, STRONG, ACCEPT = 0.10, 0.82, 0.55


def anchors(text: Column) -> Column:
    """struct<urls, files, phrases>: normalized links, file names, quoted phrases of two words or more."""
    urls = F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(u), r"[.,);\]>]+$", ""), r"https?:[/\\]+", "https://"), "/+$", ""))
    files = F.transform(F.regexp_extract_all(text, F.lit(FILE), F.lit(0)), lambda f: F.lower(F.substring_index(f, "/", -1)))
    phrases = F.filter(F.transform(F.regexp_extract_all(text, F.lit(QUOTE), F.lit(1)), normalize_issue_text), lambda p: p.contains(" "))
    return F.struct(F.array_distinct(urls).alias("urls"), F.array_distinct(files).alias("files"), F.array_distinct(phrases).alias("phrases"))


def content_tokens(text: Column) -> Column:
    """The distinct words of three letters or more that aren't stop words."""
    return F.filter(F.array_distinct(F.split(normalize_issue_text(text), " ")), lambda t: (F.char_length(t) > 2) & ~t.isin(*STOPWORDS))


#: A word and its longest known ending that leaves four letters; endings are tried only where a word has few letters left.
ENDING = rf"(?<![^ ])([^ ]{{4,}}?)(?=[а-я]{{1,{max(map(len, SUFFIXES))}}}(?![^ ]))(?:{'|'.join(SUFFIXES)})(?![^ ])"


def stem(token: Column) -> Column:
    """Without the longest known ending that leaves four letters; a text of words between spaces goes word by word."""
    return F.regexp_replace(token, ENDING, "$1")


def stems(text: Column) -> Column:
    words = F.split(stem(F.array_join(content_tokens(text), " ")), " ")
    return F.array_distinct(F.filter(words, lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def mirror_family(path: Column) -> Column:
    name = F.lower(F.substring_index(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/", -1))
    table = F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, name), name)


#: Gold cases and predictions in a block; all blocks of a project's gold cases meet all of its predictions.
GOLD_BLOCK, PRED_BLOCK = 256, 4096


#: Pairs of which a task holds letters and scores at once.
PAIRS = 1 << 15


def _flat(side: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as their values and the row of each."""
    lists = side[kind].combine_chunks()
    return np.asarray(lists.flatten()), np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists), np.int64))


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [low, high), and the range of each."""
    of = np.repeat(np.arange(len(low)), high - low)
    return np.arange(len(of)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[of], of


class Screen:
    """Gold cases and predictions of blocks, side by side: what each pair may score, before any text is compared.

    Both sides come in the order of their blocks, of which `block` holds numbers; only rows of one block meet.
    """

    def __init__(self, gold: pa.Table, pred: pa.Table, block: tuple[np.ndarray, np.ndarray]):
        self.sides, n = (gold, pred), (gold.num_rows, pred.num_rows)
        # what a block's own words are called: equal numbers for equal keys of one block
        self.found = {}
        for kind in ("urls", "files", "absent", "tokens"):
            (a, at_a), (b, at_b) = (_flat(x, kind) for x in self.sides)
            names = pd.factorize(np.concatenate([a, b]).astype(object))[0].astype(np.int64) if len(a) and len(b) else np.zeros(len(a) + len(b), np.int64)
            size = names.max(initial=0) + 1
            left, right = block[0][at_a] * size + names[: len(a)], block[1][at_b] * size + names[len(a) :]
            order = np.argsort(right, kind="stable")
            self.found[kind] = left, at_a, right[order], at_b[order]
        self.letters = [np.asarray(x["letters"].combine_chunks().flatten()).astype(np.int32).reshape(len_, -1) if len_ else np.zeros((0, 1), np.int32) for x, len_ in zip(self.sides, n)]
        self.size = [x.sum(axis=1, dtype=np.int64) for x in self.letters]
        self.words = [np.asarray(pc.list_value_length(x["tokens"].combine_chunks()), np.int64) for x in self.sides]
        both = [pd.factorize(np.concatenate([x[c].to_pandas().to_numpy() for x in self.sides]), use_na_sentinel=True)[0] for c in ("criterion", "family")]
        (self.criterion, self.family) = ((c[: n[0]], c[n[0] :]) for c in both)
        self.named = np.asarray(pc.not_equal(gold["family"], "").fill_null(False))
        self.start, self.end = ([x[c].to_pandas().to_numpy(float) for x in self.sides] for c in ("line_start", "line_end"))
        self.text, self.phrases = [x["text"].to_pylist() for x in self.sides], [x["phrases"].to_pylist() for x in self.sides]
        self.idx = [x["idx"].to_pandas().to_numpy() for x in self.sides]
        self.place = np.unique(self.idx[1], return_inverse=True)[1] if n[1] else np.zeros(0, np.int64)  # the order of predictions
        self.low, self.high = (np.searchsorted(block[1], block[0], side) for side in ("left", "right"))

    def shared(self, kind: str, golds: slice, first: np.ndarray) -> np.ndarray:
        """The pair of each key that a gold case and a prediction have in common; a gold case's pairs begin at `first`."""
        left, at, right, pred = self.found[kind]
        low, high = np.searchsorted(at, golds.start), np.searchsorted(at, golds.stop)
        left, at = left[low:high], at[low:high]
        hit, of = _ranges(np.searchsorted(right, left, "left"), np.searchsorted(right, left, "right"))
        row = at[of]
        return first[row - golds.start] + pred[hit] - self.low[row]

    def best(self, k: int):
        """The best k predictions of each gold case: arrays (gold row, prediction row, score, same criterion, texts compared for it), by spans of gold cases."""
        ends = np.cumsum(self.high - self.low)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
            yield self._span(slice(at, to), k)
            at = to

    def _span(self, golds: slice, k: int) -> tuple[np.ndarray, ...]:
        p, g = _ranges(self.low[golds], self.high[golds])
        n, first = len(p), np.cumsum(self.high[golds] - self.low[golds]) - (self.high[golds] - self.low[golds])
        g += golds.start
        start, end = self.start[0][g], self.end[0][g]
        with np.errstate(invalid="ignore"):  # overlapping, or two lines away at most
            close = (start <= self.end[1][p]) & (self.start[1][p] <= end)
            close |= np.minimum(np.abs(start - self.end[1][p]), np.abs(self.start[1][p] - end)) <= 2
        score, sure = np.zeros(n), np.zeros(n, bool)
        file = self.named[g] & (self.family[0][g] == self.family[1][p])
        score[file], sure[file] = 0.84, np.isnan(start[file])
        score[file & close], sure[file & close] = 0.9, True
        for kind, value in (("absent", 0.95), ("urls", 1.0), ("files", 1.0)):
            at = self.shared(kind, golds, first)
            score[at], sure[at] = np.maximum(score[at], value), True
        for row in range(golds.start, golds.stop):
            for j in range(self.low[row], self.high[row]) if self.phrases[0][row] else ():
                if any(a in b or b in a for a in self.phrases[0][row] for b in self.phrases[1][j]):
                    at = first[row - golds.start] + j - self.low[row]
                    score[at], sure[at] = 1.0, True
        words = np.bincount(self.shared("tokens", golds, first), minlength=n) / np.maximum(np.minimum(self.words[0][g], self.words[1][p]), 1)
        total = self.size[0][g] + self.size[1][p]
        bound = np.where(total > 0, 2.0 * np.minimum(self.letters[0][g], self.letters[1][p]).sum(axis=1) / np.maximum(total, 1), 1.0) if n else np.zeros(0)
        full, lead = (self.words[0][g] > 0) & (self.words[1][p] > 0), np.where(close, 0.1, 0.0)
        exact = np.where(sure, score, np.where(full, words, 0.0) + lead)
        most = np.where(sure, score, np.where(full, np.maximum(words, bound), 0.0) + lead)
        asks = ~sure & full & (bound > words)
        same, compared = self.criterion[0][g] == self.criterion[1][p], np.zeros(golds.stop - golds.start, np.int64)
        keep = np.flatnonzero(most >= PRESCREEN_MIN)
        keep = keep[np.lexsort((self.place[p[keep]], -most[keep], ~same[keep], g[keep]))]
        own = g[keep]
        rank = np.arange(len(keep)) - np.searchsorted(own, own, "left")
        # where letters leave a text open, texts are compared from the highest bound down, until no bound reaches the k-th best
        open_ = np.zeros(golds.stop - golds.start, bool)
        open_[own[asks[keep]] - golds.start] = True
        chosen = [keep[~open_[own - golds.start] & (rank < k)]]
        for row in np.flatnonzero(open_) + golds.start:
            rows = keep[np.searchsorted(own, row, "left") : np.searchsorted(own, row, "right")]
            found = 0
            for level in (rows[same[rows]], rows[~same[rows]]):
                need, best, values = k - found, [], []
                for j in level.tolist() if need else ():
                    if len(best) >= need and most[j] < best[0]:
                        break
                    if asks[j]:
                        exact[j] = max(words[j], matched_share(self.text[0][row], self.text[1][p[j]])) + lead[j]
                        compared[row - golds.start] += 1
                    if exact[j] >= PRESCREEN_MIN:
                        values.append(j)
                        heapq.heappush(best, exact[j])
                        if len(best) > need:
                            heapq.heappop(best)
                values = sorted(values, key=lambda j: (-exact[j], self.place[p[j]]))[:need]
                chosen.append(np.array(values, np.int64))
                found += len(values)
        chosen = np.concatenate(chosen)
        return g[chosen], p[chosen], exact[chosen], same[chosen], compared[g[chosen] - golds.start]


def _features(rows: DataFrame, idx: str, text: str, around: Column, path: str) -> DataFrame:
    """What one side brings to the screen, taken once a row."""
    plain = normalize_issue_text(F.col(text))
    end = F.when(F.coalesce("line_end", F.lit(0)) == 0, F.col("line_start")).otherwise(F.col("line_end"))
    family = F.when(F.coalesce(path, F.lit("")) == "", "").otherwise(mirror_family(F.col(path)))
    x = rows.select(F.col(idx).alias("idx"), "project_id", "criterion", plain.alias("text"), content_tokens(F.col(text)).alias("tokens"), anchors(around).alias("found"), artifact_words(F.col(text)).alias("absent"), family.alias("family"), F.col("line_start").cast("double"), end.cast("double").alias("line_end"))
    return x.select("*", "found.*", letter_counts(F.col("text")).alias("letters")).drop("found")


def prescreened(gold_cases: DataFrame, predictions: DataFrame, topk: int = 8) -> DataFrame:
    """Pairs of a project with a prescreen score of at least PRESCREEN_MIN, the best `topk` a gold case: same criterion first, then by score, then by pred_idx.

    A top-k join by upper bounds: blocks of gold cases meet blocks of predictions, anchors, words and lines are looked up,
    letters bound what a text comparison may give, and texts are compared from the highest bound down, until no bound
    reaches the k-th best. A block leaves topk rows a gold case, and no pair is a row before that.
    """
    g = written(_features(gold_cases, "gold_idx", "gold_text", F.col("gold_text"), "file_hint"))
    p = written(_features(predictions, "pred_idx", "found_text", F.concat_ws(" ", "found_text", F.coalesce("file_path", F.lit(""))), "file_path"))
    parts = lambda x, n, name: x.groupBy("project_id").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    dealt = parts(g, GOLD_BLOCK, "of_g").join(parts(p, PRED_BLOCK, "of_p"), "project_id")
    place = lambda n: F.pmod(F.xxhash64("idx"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    golds = g.join(dealt, "project_id").withColumn("g", place("of_g")).withColumn("p", every("of_p")).drop("of_g", "of_p")
    preds = p.join(dealt, "project_id").withColumn("p", place("of_p")).withColumn("g", every("of_g")).drop("of_g", "of_p")

    kind = lambda x, c: x.schema[c].dataType.simpleString()
    schema = f"project_id {kind(g, 'project_id')}, gold_idx {kind(g, 'idx')}, pred_idx {kind(p, 'idx')}, score double, same boolean, compared long"
    # a row has its idx in the column of its side
    side = lambda x, gold: x.withColumns({"gold": F.lit(gold), "gold_idx": F.col("idx") if gold else F.lit(None).cast(kind(g, "idx")), "pred_idx": F.lit(None).cast(kind(p, "idx")) if gold else F.col("idx")}).drop("idx")
    block = ["project_id", "g", "p"]

    def screen(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        gold = np.asarray(rows["gold"])
        number = np.searchsorted(starts, np.arange(len(gold)), "right")
        left, right = (rows.filter(pa.array(own)).rename_columns({c: "idx"}) for own, c in ((gold, "gold_idx"), (~gold, "pred_idx")))
        for g_row, p_row, score, same, compared in Screen(left, right, (number[gold], number[~gold])).best(topk):
            found = left.select(["project_id", "idx"]).take(pa.array(g_row)).columns + [right["idx"].take(pa.array(p_row)), pa.array(score), pa.array(same), pa.array(compared)]
            yield from pa.table(found, names=["project_id", "gold_idx", "pred_idx", "score", "same", "compared"]).to_batches()

    def run(batches):
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if not rows.num_rows:
                continue
            key = rows.select(block).to_pandas()
            starts = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy())
            rest = rows.slice(starts[-1])
            if starts[-1]:
                yield from screen(rows.slice(0, starts[-1]), starts)
        if rest is not None:
            yield from screen(rest, np.zeros(1, np.int64))

    # all of a block is in one partition, block by block: one pass of Python serves however many small projects there are
    x = side(golds, True).unionByName(side(preds, False)).repartition(*block).sortWithinPartitions(*block).mapInArrow(run, schema)
    best = W.partitionBy("gold_idx").orderBy(F.desc("same"), F.desc("score"), "pred_idx")
    x = x.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= topk)
    x = x.join(gold_cases.select("gold_idx", "gold_text", stems(F.col("gold_text")).alias("gold_stems"), F.col("line_start").alias("gs"), F.col("line_end").alias("ge")), "gold_idx")
    x = x.join(predictions.select("pred_idx", "found_text", stems(F.col("found_text")).alias("found_stems"), F.col("line_start").alias("ps"), F.col("line_end").alias("pe")), "pred_idx")
    return x.withColumn("relation", line_relation(F.col("gs"), F.col("ge"), F.col("ps"), F.col("pe")))


def judged(pairs: DataFrame) -> DataFrame:
    """pairs with confidence: how sure the rules are that both are the same defect; strong prescreen scores aren't questioned.

    Stems that pairs bring with them (gold_stems, found_stems) aren't worked out again for each pair.
    """
    a, b = (F.col(c) if c in pairs.columns else stems(F.col(t)) for c, t in (("gold_stems", "gold_text"), ("found_stems", "found_text")))
    x = pairs.withColumn("_a", a).withColumn("_b", b).withColumn("_both", F.array_intersect("_a", "_b"))
    rare = F.size(F.filter("_both", lambda t: F.char_length(t) >= 5))
    j = jaccard(F.col("_a"), F.col("_b"))
    confidence = (
        F.when(F.col("score") >= STRONG, F.greatest(F.col("score"), F.lit(0.9)))
        .when((F.size("_a") == 0) | (F.size("_b") == 0), 0.0)
        .when(rare >= 2, 0.72)
        .when((F.col("relation") == "overlap") & (F.size("_both") > 0), 0.7)
        .when(j >= 0.34, 0.6)
        .otherwise(0.0)
    )
    return x.withColumn("confidence", confidence).where(F.col("confidence") >= ACCEPT).drop("_a", "_b", "_both", "gold_stems", "found_stems")


def assigned(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs of a project: those of the same criterion first, each phase by confidence."""
    x = pairs.select("project_id", "gold_idx", "pred_idx", "same", "confidence")
    return greedy(x, ["project_id"], [("same", False), ("confidence", False), ("gold_idx", True), ("pred_idx", True)])


def confidence_gate(predictions: DataFrame, floor: float) -> DataFrame:
    return predictions.where(F.col("confidence").isNull() | (F.col("confidence") >= floor)) if floor > 0 else predictions


def mirrors_dropped(predictions: DataFrame, order: str = "pred_idx") -> DataFrame:
    """The first of the findings that say the same in mirrored files."""
    core = F.substring(F.array_join(F.array_sort(content_tokens(F.col("found_text"))), " "), 1, 120)
    keys = [F.col("project_id"), F.col("criterion"), F.coalesce("issue_type", F.lit("")), mirror_family(F.col("file_path")), core]
    return predictions.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def repetition_capped(predictions: DataFrame, per_issue_type: int = 3, order: str = "pred_idx") -> DataFrame:
    """Of minor readability findings: one a line and issue type; without a line, the first `per_issue_type` of a type (0: all)."""
    noisy = (F.col("criterion") == "readability") & F.coalesce(F.col("severity").isin("info", "minor"), F.lit(False))
    first = [F.coalesce(severity_rank(F.col("severity")), F.lit(0)).desc(), F.coalesce("confidence", F.lit(0.0)).desc(), F.col(order)]
    keys = [F.col("project_id"), F.col("criterion"), F.coalesce("issue_type", F.lit(""))]
    x = predictions.withColumn("_noisy", noisy).withColumn("_lined", F.col("line_start").isNotNull())
    x = x.withColumn("_n", F.row_number().over(W.partitionBy("_noisy", "_lined", *keys, F.col("line_start")).orderBy(*first)))
    most = F.when(F.col("_lined"), 1).otherwise(per_issue_type if per_issue_type > 0 else 2**31 - 1)
    return x.where(~F.col("_noisy") | (F.col("_n") <= most)).drop("_noisy", "_lined", "_n")


def opinions_dropped(gold_cases: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    low, said = F.lower(F.coalesce("gold_text", F.lit(""))), F.lit(False)
    for m in OPINIONS:
        said = said | low.contains(m)
    out = gold_cases.where(~said)
    return out if ids is None else out.join(ids, "gold_idx", "left_anti")


def validity(predictions: DataFrame) -> DataFrame:
    """checker_name, n, valid, share: findings whose type comes from a rule of high precision count as valid."""
    ok = F.trim(F.coalesce("issue_type", F.lit(""))).isin(*VALID_TYPES)
    return predictions.groupBy("checker_name").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("valid")).withColumn("share", F.bround(F.col("valid") / F.col("n"), 4))
