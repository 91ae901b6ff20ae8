"""Quality rules learned as a decision list of threshold conjunctions.

Statistics of whole texts come from Arrow batches, a narrow row a document.  Sequential covering learns from a bounded
sample of labelled rows: a rule is grown condition by condition on one part of the sample (each condition a statistic
against a threshold, chosen by information gain), pruned on the other part, and kept only if it is precise there; what
it covers is taken away and the next rule is grown.  The list is emitted as one ordered Spark CASE expression, so that
applying it needs no Python.  Rules reject; a document that no rule covers is kept.

Defined results: a null text has no words and fails the base rules; rows with a null or repeated doc_id are rows of
their own (a null doc_id has no label, several labels of one doc_id all count); without labels, or with labels of one
class, the list is empty; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.llm._shared import small_batches
from lodeseam.llm._text import plain, ranges, split, starts, steps, window_hashes, word_hashes

#: Labelled rows that are learned from at most: those with the smallest hashes of their doc_id.
SAMPLE = 50_000
#: A rule needs so many rejects in the growing part, such a part of rejects in what it covers, and at most so many conditions.
LEAST_COVERED, LEAST_PRECISION, MOST_CONDITIONS, MOST_RULES = 4, 0.9, 3, 12

SYMBOLS = "#*$%&|<>"
BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that rules may use, from the base counts.
RATIOS = {
    "n_words": "CAST(n_words AS double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_part": "n_symbols / greatest(n_words, 1)",
    "dup_line_part": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_part": "n_repeat_words / greatest(n_words, 1)",
    "distinct_part": "n_distinct / greatest(n_words, 1)",
    "alpha_part": "n_alpha / greatest(n_words, 1)",
    "upper_part": "n_upper / greatest(word_chars, 1)",
    "digit_part": "n_digits / greatest(word_chars, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}
#: Rejected whatever is learned.
FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
_COUNTS = ("n_words", *BASE, "n_lines", "n_distinct", "n_alpha", "n_upper", "n_digits")


def _by_document(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of a flat array's values for each document."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def text_counts(text: pa.Array) -> dict[str, np.ndarray]:
    """The counts named in _COUNTS of each text."""
    text = plain(text)
    words, n = split(text)
    at, owner = starts(n), np.repeat(np.arange(len(n)), n)
    hashes = word_hashes(words)
    of_words = lambda f: _by_document(f(words).to_numpy(zero_copy_only=False), at)
    count = lambda p: pc.count_substring_regex(text, pattern=p).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {"n_words": n, "word_chars": of_words(pc.utf8_length), "n_symbols": count(f"[{SYMBOLS}]")}
    out |= {"n_upper": count("[A-Z]"), "n_digits": count("[0-9]"), "n_alpha": of_words(lambda w: pc.match_substring_regex(w, "[A-Za-z\u0080-\U0010ffff]"))}
    # Lines with a word that equal an earlier line of their text.
    lines = pc.split_pattern(text, "\n")
    flat, line_owner = lines.flatten(), pc.list_parent_indices(lines).to_numpy(zero_copy_only=False)
    full = pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    flat, line_owner = flat.filter(pa.array(full)), line_owner[full]
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    n_lines = np.bincount(line_owner, minlength=len(n))
    once = np.unique(line_owner.astype(np.int64) << 32 | codes)
    out |= {"n_lines": n_lines, "n_dup_lines": n_lines - np.bincount(once >> 32, minlength=len(n))}
    # Words under a three-word window that the text has twice or more.
    order = np.lexsort((hashes, owner))
    new = np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])))
    out["n_distinct"] = np.bincount(owner[order][new[: len(order)]], minlength=len(n))
    windows, n_windows = window_hashes(hashes, 3), np.maximum(n - 2, 0)
    begins = ranges(at[:-1], n_windows)
    key, of = windows[begins] if len(begins) else windows[:0], np.repeat(np.arange(len(n)), n_windows)
    order = np.lexsort((key, of))
    same = (key[order][1:] == key[order][:-1]) & (of[order][1:] == of[order][:-1])
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    hit, found = np.zeros(len(hashes), bool), begins[order[again]]
    for k in range(3):
        hit[found + k] = True
    out["n_repeat_words"] = _by_document(hit, at)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row's whole text."""
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                counts = text_counts(step.column("text"))
                yield pa.record_batch([step.column("doc_id"), *(pa.array(counts[c], pa.int64()) for c in _COUNTS)], ["doc_id", *_COUNTS])

    schema = ", ".join(f"{c} long" for c in ("doc_id", *_COUNTS))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, schema)


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.statistic] > self.threshold if self.above else x[self.statistic] <= self.threshold

    def column(self) -> Column:
        value, limit = F.expr(RATIOS[self.statistic]), F.lit(self.threshold)
        return value > limit if self.above else value <= limit


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Conditions that each gain the most information on the rejects, until only rejects are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS and not bad[inside].all():
        p0, n0 = bad[inside].sum(), inside.sum()
        best = (0.0, None)
        for name, values in x.items():
            order = np.argsort(values[inside], kind="stable")
            v, b = values[inside][order], bad[inside][order]
            ends = np.flatnonzero(v[1:] > v[:-1])  # a threshold between different values
            if not len(ends):
                continue
            below, p_below = ends + 1, np.cumsum(b)[ends]
            for above, count, p in ((False, below, p_below), (True, n0 - below, p0 - p_below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = p * (np.log2(p / count) - np.log2(p0 / n0))
                gain[(p < LEAST_COVERED) | ~np.isfinite(gain)] = 0
                if gain.max() > best[0] + 1e-9:
                    k = int(gain.argmax())
                    best = (float(gain[k]), Condition(name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth the most on rows that it was not grown on."""

    def worth(r: Rule) -> float:
        c = covers(r, x, len(bad))
        p, n = bad[c].sum(), (~bad[c]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """An ordered list of rules that cover rejects."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    part = np.random.default_rng(seed).permutation(len(bad)) % 3 > 0  # two thirds grow, one third prunes
    for _ in range(MOST_RULES):
        growing, pruning = left & part, left & ~part
        if bad[growing].sum() < LEAST_COVERED:
            break
        rule = _grow({k: v[growing] for k, v in x.items()}, bad[growing])
        rule = _prune(rule, {k: v[pruning] for k, v in x.items()}, bad[pruning]) if rule else ()
        found = covers(rule, x, len(bad)) & left
        held = found & ~part
        # Precise on what it was grown on and on what it was not, counting one case against it.
        precise = bad[found].sum() >= LEAST_PRECISION * (found.sum() + 1) and bad[held].sum() >= LEAST_PRECISION * held.sum()
        if not rule or not precise:
            break
        rules.append(rule)
        left &= ~found
    return rules


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Statistics and rejects (quality 0) of at most `most` labelled rows, in the order of a hash of doc_id."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "quality")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    own = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")
    rows = statistics(own).join(F.broadcast(chosen), "doc_id").select("doc_id", *(F.expr(v).alias(k) for k, v in RATIOS.items()), "quality")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *RATIOS).limit(most)  # many rows may share a doc_id
    found = rows.toPandas().sort_values(["doc_id", "quality", *RATIOS], ignore_index=True)
    return {k: found[k].to_numpy(float) for k in RATIOS}, (found["quality"] == 0).to_numpy()


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered expression: the number of the first rule that covers a row, else null."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        both = rule[0].column()
        for c in rule[1:]:
            both = both & c.column()
        out = F.when(both, k).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, rule (the first that rejects the row) and kept, of every row."""
    rule = verdict(learn(*sample(docs, labels, most)))
    found = statistics(docs).select("doc_id", "n_words", *BASE, F.expr(FAILED).alias("base_failed"), rule.alias("rule"))
    return found.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The documents that neither the base rules nor the learned list reject, with their columns."""
    rule = verdict(learn(*sample(docs, labels, most)))
    small_batches(docs.sparkSession)
    kind = "struct<" + ", ".join(f"{c}: long" for c in _COUNTS) + ">"

    @F.arrow_udf(kind)
    def counted(text: pa.Array) -> pa.Array:
        batch = pa.record_batch([text], ["text"])
        found = [text_counts(step.column("text")) for step in steps(batch, "text")]
        own = [pa.array(np.concatenate([f[c] for f in found] or [np.zeros(0)]), pa.int64()) for c in _COUNTS]
        return pa.StructArray.from_arrays(own, list(_COUNTS))

    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_rows")
    counts = docs.select(whole, counted(F.col("text").cast("string")).alias("_counts")).select("_rows", "_counts.*")
    return counts.filter(~F.expr(FAILED) & rule.isNull()).select("_rows.*")
