"""Quality rules: a decision list learned by sequential covering, applied as Spark conditions.

Statistics of a text, the list's conditions and its verdict are built-in expressions only: one
pass, no shuffle, no Python on the executors. The list is learned on the driver from the numbers
of a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import store, words

#: Labelled rows that the list is learned from, at most in expectation.
SAMPLE_ROWS = 10_000
#: A rule keeps only if so large a share of what it rejects among rows it wasn't grown on is labelled bad.
LEAST_PRECISION = 0.85
MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 16, 4, 48
#: Words in a window whose repetition counts, fewest words of a text, most repeated words of 100.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20

FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "line_words")


def let(value: Column, body) -> Column:
    """body of a value that is computed once: a lambda variable is never inlined again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(tokens: Column) -> Column:
    """Words in windows of WINDOW words that are found twice or more in the text, the first included.

    Windows are compared by 64-bit hash. Texts without a repeated window, nearly all, stop at a hash
    set; in others the windows are sorted by hash, so the cost stays n log n for any text.
    """

    def covered(starts: Column) -> Column:
        width = F.transform(starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1), p + WINDOW) - p))
        return F.aggregate(width, F.lit(0).cast("long"), lambda a, x: a + x)

    def sorted_ones(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    def windows(h: Column) -> Column:
        marked = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(marked), sorted_ones))

    def hashed(w: Column) -> Column:
        first = F.slice(w, F.lit(1), F.size(w) - (WINDOW - 1))
        return let(F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)])), windows)

    return F.when(F.size(tokens) <= WINDOW, F.lit(0).cast("long")).otherwise(let(F.transform(tokens, lambda t: F.xxhash64(t)), hashed))


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns without clashing ones, and the base statistics and features of each whole text; a null text has no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *FEATURES]
    kept = [c for c in df.columns if c not in own]

    def measured(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def line_counts(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dup"))

    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = df.select(
        *kept,
        let(words(F.col(text)), measured).alias("_w"),
        let(lines, line_counts).alias("_l"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).alias("_upper"),
        F.regexp_count(t, F.lit("!")).alias("_bang"),
    )
    n, chars = F.greatest(F.col("_w.n_words"), F.lit(1)), F.greatest(F.col("_w.word_chars"), F.lit(1))
    count = F.col("_w.n_words")
    return rows.select(
        *kept,
        F.col("_w.n_words"),
        F.col("_w.word_chars"),
        "n_symbols",
        F.col("_l.dup").alias("n_dup_lines"),
        F.col("_w.n_repeat_words"),
        ((count < LEAST_WORDS) | (100 * F.col("_w.n_repeat_words") > MOST_REPEATED * count)).alias("base_failed"),
        (F.col("_w.word_chars") / n).alias("word_length"),
        (F.col("n_symbols") / n).alias("symbol_share"),
        (F.col("_l.dup") / F.greatest(F.col("_l.n"), F.lit(1))).alias("dup_line_share"),
        (F.col("_w.n_repeat_words") / n).alias("repeat_share"),
        (F.col("_upper") / chars).alias("upper_share"),
        (F.col("_bang") / n).alias("bang_share"),
        (count / F.greatest(F.col("_l.n"), F.lit(1))).alias("line_words"),
    )


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        x = columns[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(columns)
    return out


def _grow(columns: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition with the largest information gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any() and (inside & bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-6
        for name in FEATURES:
            x = columns[name]
            for threshold in np.unique(np.quantile(x[inside & bad], np.linspace(0, 1, THRESHOLDS)).round(6)):
                for above in (True, False):
                    c = Condition(name, above, float(threshold) - 1e-9 if above else float(threshold))
                    m = inside & c.holds(columns)
                    q = (m & bad).sum()
                    if q and (g := q * (np.log2(q / m.sum()) - np.log2(p / (p + n)))) > gain:
                        best, gain = c, g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(columns)
    return tuple(rule)


def _prune(rule: Rule, columns: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The beginning of the rule with the best worth on rows it wasn't grown on; its precision there and what it catches."""
    best: tuple[Rule, float, int, float] = ((), 0.0, 0, -1.0)
    for k in range(1, len(rule) + 1):
        m = _covers(rule[:k], columns, len(bad))
        p, n = int((m & bad).sum()), int((m & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[3] + 1e-12:
            best = (rule[:k], p / (p + n), p, worth)
    return best[:3]


def cover(columns: dict[str, np.ndarray], bad: np.ndarray, prunes: np.ndarray) -> list[Rule]:
    """Rules in order; prunes marks the rows that rules are pruned on."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        grow, prune = left & ~prunes, left & prunes
        if not (grow & bad).any() or not (prune & bad).any():
            break
        rule, precision, caught = _prune(_grow({k: v[grow] for k, v in columns.items()}, bad[grow]), {k: v[prune] for k, v in columns.items()}, bad[prune])
        if not rule or precision < LEAST_PRECISION or caught < 2:
            break
        rules.append(rule)
        left &= ~_covers(rule, columns, len(bad))
    return rules


def learn_rules(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> list[Rule]:
    """A decision list from the labels (0: bad). No labels, or one class only: an empty list, which keeps everything.

    Null ids, labels and texts are not learned from; equal label rows count once. The sample's texts are a stored table,
    so that statistics are made of them alone; where ids repeat so often that it holds over twice SAMPLE_ROWS, it is thinned.
    """
    known = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("_k").isNotNull()).distinct()
    n = known.count()
    if not n:
        return []
    draw = F.pmod(F.xxhash64(F.col("_k"), F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.withColumn("_d", draw).filter(F.col("_d") < min(1.0, SAMPLE_ROWS / n))
    rows = store(df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter("_t is not null").join(F.broadcast(drawn), "_k"), "quality-sample")
    if (m := rows.count()) > 2 * SAMPLE_ROWS:
        rows = rows.filter(F.rand(3) < SAMPLE_ROWS / m)
    seen = statistics(rows, "_t").filter(~F.col("base_failed")).select("_d", "_y", *[F.col(c).cast("double") for c in FEATURES]).collect()
    table = np.array(sorted(map(tuple, seen)), float).reshape(-1, 2 + len(FEATURES))
    return cover({f: table[:, 2 + k] for k, f in enumerate(FEATURES)}, table[:, 1] == 0, np.arange(len(table)) % 3 == 0)


def rule_column(rules: Sequence[Rule]) -> Column:
    """The first rule that a row's statistics fit, as text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        fits = F.lit(True)
        for c in rule:
            fits = fits & c.column()
        out = F.when(fits, F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def judge_quality(df: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """The input's columns, its statistics, `rule` (the rule that rejects, else null) and `kept`.

    Input columns named like a statistic, `rule` or `kept` are replaced. A text that fails the base
    conditions is never kept; null and empty texts fail them.
    """
    rows = statistics(df.drop("rule", "kept"), text)
    return rows.withColumn("rule", rule_column(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
