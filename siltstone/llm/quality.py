"""Quality rules whose cutoffs come from labelled holdouts with exact binomial bounds.

Features of a document are plain SQL expressions. ``CHAIN`` is a fixed sequence of cutoffs on their ratios, each step
adding to the rule or tightening it: a document is rejected if any ratio is above its cutoff. In each stratum (language) the
steps are tested in that order on the labelled good documents: a rule is safe if, were the true share of good
documents it rejects ``alpha`` or more, so few rejections would have a probability of at most ``delta`` divided by
the number of strata (Bonferroni). The first step that isn't safe ends the sequence, so the steps need no further correction, and
the last safe rule is used; the whole rule, not each ratio, keeps the bound. Strata with fewer than ``least`` labelled good
documents are tested together as one, and the bound is that of their mixture.

Repeated windows are found by 64-bit hashes in sorted order, and the words of those found are compared; a text in which two different
windows have one hash is sorted by the words themselves.

Defined cases: a null or empty text has no words and fails the base rule; a null language is a stratum of its own (pooled if
small); a null doc_id is judged but never joined to a label; repeated rows are judged alike; ties at a cutoff are kept
(only a ratio above it rejects); without labels only the base rule decides; very long texts are read whole, with arrays of their windows on
the heap; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import SPACE, SPACE_CHARS, cut, let

WINDOW = 3
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent
RATIOS = {
    "r_symbols": "n_symbols / greatest(word_chars, 1)",
    "r_lines": "n_dup_lines / greatest(n_lines, 1)",
    "r_repeats": "n_repeat_words / greatest(n_words, 1)",
    "r_long_words": "word_chars / greatest(n_words, 1)",
}
#: Steps of the rule, from what good documents never show to what some do.
CHAIN = (
    *(("r_symbols", cut) for cut in (0.5, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01)),
    *(("r_long_words", cut) for cut in (15.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0)),
    *(("r_lines", cut) for cut in (0.6, 0.5, 0.4, 0.3)),
    *(("r_repeats", cut) for cut in (0.45, 0.4, 0.35, 0.3, 0.25)),
)


def _repeated(words: Column) -> Column:
    """How many words stand in windows of three that the text holds twice or more."""

    def covered(sorted_windows: Column, exact: bool) -> Column:
        n = F.size(sorted_windows)

        def again(window: Column, at: Column) -> Column:
            before = F.get(sorted_windows, at - 1)["h"] == window["h"]
            after = F.get(sorted_windows, at + 1)["h"] == window["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        def count(found: Column) -> Column:
            every = F.flatten(F.transform(found, lambda w: F.array(w["at"], w["at"] + 1, w["at"] + 2)))
            return F.size(F.array_distinct(every))

        def compared(found: Column) -> Column:
            def clash(i: Column) -> Column:
                a, b = F.get(found, i), F.get(found, i - 1)
                differ = [F.get(words, a["at"] + k) != F.get(words, b["at"] + k) for k in range(WINDOW)]
                return (a["h"] == b["h"]) & (differ[0] | differ[1] | differ[2])

            clashes = F.exists(F.sequence(F.lit(1), F.size(found) - 1), clash)
            return F.when(F.size(found) < 2, 0).when(clashes, let(F.sort_array(windows(F.concat_ws)), lambda w: covered(w, True))).otherwise(count(found))

        found = F.filter(sorted_windows, again)
        return F.when(n < 2, 0).otherwise(count(found) if exact else let(found, compared))

    def windows(key: Callable) -> Column:
        own = (lambda *w: key(" ", *w)) if key is F.concat_ws else key
        return F.transform(
            F.sequence(F.lit(0), F.size(words) - WINDOW),
            lambda i: F.struct(own(*(F.get(words, i + k) for k in range(WINDOW))).alias("h"), i.alias("at")),
        )

    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(F.sort_array(windows(F.xxhash64)), lambda w: covered(w, False)))


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The base figures of every row of ``docs``, next to the columns ``keep``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = docs.select(
        *keep,
        of_words.alias("w"),
        of_lines.alias("x"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return rows.select(*keep, "w.n_words", "word_chars", "n_symbols", "x.n_dup_lines", "w.n_repeat_words", "x.n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k)."""
    logs = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1))
    return min(1.0, math.fsum(map(math.exp, logs)))


def safe(k: int, n: int, p: float, level: float) -> bool:
    """Whether k rejections of n are too few for a true share of p or more, at the level."""
    return n > 0 and k < p * n and tail(k, n, p) <= level


#: The stratum of all those that are too small to be tested alone.
POOLED = "\x00pooled"


def first_step() -> Column:
    """The first step of the chain that rejects a row; null where none does."""
    step = F.when(F.lit(False), 0)
    for n, (ratio, most) in enumerate(CHAIN, 1):
        step = step.when(F.expr(RATIOS[ratio]) > most, n)
    return step


def cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, stratum: str = "lang", least: int = 100) -> dict:
    """{stratum: steps of the chain that are safe}, learned from the labelled good rows that pass the base rule.

    Counts are summed over all labelled rows; what reaches the driver is a row for each stratum of ``least`` good rows or more, and one.
    """
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    held = rows.where(~base_failed()).join(good, "doc_id", "left_semi")
    held = held.select(F.col(stratum).alias("stratum"), first_step().alias("step"))
    held = held.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(F.col("step") <= k).alias(f"k{k}") for k in range(1, len(CHAIN) + 1)))
    sums = [F.sum(c).alias(c) for c in held.columns[1:]]
    large = F.col("n") >= least
    counts = held.groupBy(large.alias("large"), F.when(large, F.col("stratum")).alias("stratum")).agg(*sums).collect()
    level, found = delta / max(1, len(counts)), {}
    for row in counts:
        steps = 0
        while steps < len(CHAIN) and safe(row[f"k{steps + 1}"], row["n"], alpha, level):
            steps += 1
        found[row["stratum"] if row["large"] else POOLED] = steps
    return found


def verdict(found: dict, stratum: str = "lang") -> Column:
    """True where no step that is safe in the row's stratum rejects it."""
    steps = F.lit(found.get(POOLED, 0))
    for of, n in found.items():
        if of != POOLED:
            steps = F.when(F.col(stratum).eqNullSafe(F.lit(of)), n).otherwise(steps)
    return F.coalesce(first_step() > steps, F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, the base figures, base_failed and kept of every row of ``docs``."""
    stratum = how.get("stratum", "lang")
    rows = cut(features(docs, ["doc_id", stratum]))
    kept = ~base_failed() & verdict(cutoffs(rows, labels, **how), stratum)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"))
