"""Quality rules [native]: a decision list learned from labelled statistics of texts.

Every statistic is a Spark expression over one row. Sequential covering grows conjunctions of
thresholds on labelled rows, prunes each on rows held apart, and the ordered list becomes one
chain of when(): no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.common import SPACE_CLASS

#: What a rule may test, each from 0 up. Counts are per word or per line, so that long texts are no outliers.
FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "mean_word", "upper_share", "bang_share", "line_words")
_OWN = ("_words", "_real", "_grams", "_nw", "_wc", "_ns", "_nl", "_nd", "_nr", "_up", "_bang", "_stats", "_base_failed", "_rule", "_kept")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(grams: Column) -> Column:
    """How many words lie in a window whose hash occurs twice or more. Sorted (hash, place) pairs
    bring equal windows together, so the work is n log n for any number of repeats."""
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(p: Column) -> Column:
        twice = F.filter(
            p,
            lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]),
        )
        return F.transform(twice, lambda x: x["i"])

    # A lambda's argument is computed once, where a column would be put in again for each element.
    at = F.flatten(F.transform(F.array(pairs), starts))
    words = F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))
    return F.size(F.array_distinct(words))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct ``_stats``: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (all long) and the doubles named in FEATURES.

    Words are runs of other than the six white-space characters. Null is an empty text; a text
    without words has zeros everywhere. Columns named as those of _OWN are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")
    real = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in _OWN]
    held = docs.select(*own, words.alias("_words"), real.alias("_real"))
    grams = F.when(F.size("_words") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)),
        )
    )
    held = held.withColumn("_grams", grams)
    counts = held.select(
        *own,
        F.size("_words").cast("long").alias("_nw"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("_wc"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("_ns"),
        F.size("_real").cast("long").alias("_nl"),
        (F.size("_real") - F.size(F.array_distinct("_real"))).cast("long").alias("_nd"),
        F.when(F.size(F.array_distinct("_grams")) == F.size("_grams"), F.lit(0))
        .otherwise(_covered(F.col("_grams")))
        .cast("long")
        .alias("_nr"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("_up"),
        F.regexp_count(text, F.lit("!")).alias("_bang"),
    )

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    # explode() of the one struct keeps filters on it above it: pushed below, they would compute it again.
    stats = F.explode(
        F.array(F.struct(
            F.col("_nw").alias("n_words"),
            F.col("_wc").alias("word_chars"),
            F.col("_ns").alias("n_symbols"),
            F.col("_nd").alias("n_dup_lines"),
            F.col("_nr").alias("n_repeat_words"),
            share("_ns", "_nw").alias("symbol_share"),
            share("_nd", "_nl").alias("dup_line_share"),
            share("_nr", "_nw").alias("repeat_share"),
            share("_wc", "_nw").alias("mean_word"),
            share("_up", "_wc").alias("upper_share"),
            share("_bang", "_nw").alias("bang_share"),
            share("_nw", "_nl").alias("line_words"),
        ))
    )
    return counts.select(*own, stats.alias("_stats"))


def base_failed(stats: Column) -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


@dataclass(frozen=True)
class Test:
    """``feature > at`` if ``above``, else ``feature <= at``."""

    feature: str
    above: bool
    at: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.at) == self.above

    def column(self, stats: Column) -> Column:
        return stats[self.feature] > F.lit(self.at) if self.above else stats[self.feature] <= F.lit(self.at)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.at:.6g}"


Rule = tuple[Test, ...]


def _covers(rule: Rule, row: dict) -> bool:
    return all(t.holds(row) for t in rule)


def _best_test(rows: list[tuple[dict, bool]]) -> Test | None:
    """The threshold with the largest information gain for the bad rows, ties to the first."""
    p0, n0 = sum(bad for _, bad in rows), sum(not bad for _, bad in rows)
    if not p0 or not n0:
        return None
    before, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
    for f in FEATURES:
        ordered = sorted((row[f], bad) for row, bad in rows)
        p = n = 0
        for k, (value, bad) in enumerate(ordered[:-1]):
            p, n = p + bad, n + (not bad)
            after = ordered[k + 1][0]
            if after == value:
                continue
            at = (value + after) / 2
            for above, pp, nn in ((True, p0 - p, n0 - n), (False, p, n)):
                if pp and (gain := pp * (math.log2(pp / (pp + nn)) - before)) > best[0]:
                    best = (gain, Test(f, above, at))
    return best[1]


def learn(
    labelled: list[tuple[dict, bool]], max_rules: int = 12, max_tests: int = 4, min_precision: float = 0.9, min_cover: int = 3
) -> list[Rule]:
    """Ordered rules for bad rows, by sequential covering. Every third row is held apart to prune.

    A rule is kept if at least ``min_cover`` rows of those left are covered by it and at least
    ``min_precision`` of these are bad: clean texts matter more than the last bad one.
    """
    left, rules = list(labelled), []
    while len(rules) < max_rules and any(bad for _, bad in left):
        grow = [x for k, x in enumerate(left) if k % 3] or left
        apart = left[::3]
        rule: Rule = ()
        while len(rule) < max_tests and (test := _best_test([x for x in grow if _covers(rule, x[0])])):
            rule += (test,)

        def worth(r: Rule) -> float:
            hit = [bad for row, bad in apart if _covers(r, row)]
            return (sum(hit) - (len(hit) - sum(hit))) / len(hit) if hit else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = [bad for row, bad in left if _covers(rule, row)] if rule else []
        if len(hit) < min_cover or sum(hit) < min_precision * len(hit):
            break
        rules.append(rule)
        left = [x for x in left if not _covers(rule, x[0])]
    return rules


def verdict(rules: list[Rule], stats: Column) -> Column:
    """The decision list as one ordered expression: the number of the first rule that holds, 0 if none."""
    found = None
    for k, rule in enumerate(rules, 1):
        holds = rule[0].column(stats)
        for test in rule[1:]:
            holds = holds & test.column(stats)
        found = F.when(holds, k) if found is None else found.when(holds, k)
    return F.lit(0) if found is None else found.otherwise(0)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 4000
) -> list[Rule]:
    """Rules from at most ``max_rows`` labelled rows (0: bad), those with the smallest hashes of
    the id. Rows that the base rules reject teach nothing. Null ids and labels are left out."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("_id"), (F.col(label_col) == 0).alias("_bad"))
        .orderBy(F.xxhash64("_id"), "_id", "_bad")
        .limit(max_rows)
    )
    # At most max_rows short rows, so it may be broadcast at any size of the tables.
    some = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("_text")).join(
        F.broadcast(chosen), F.col("_of") == F.col("_id")
    )
    rows = (
        statistics(some.select("_id", "_bad", "_text"), "_text")
        .where(~base_failed(F.col("_stats")))
        .select("_id", "_bad", *[F.col(f"_stats.{f}").alias(f) for f in FEATURES])
        .collect()
    )
    rows = sorted((r.asDict() for r in rows), key=lambda r: (hash_order(r["_id"]), *(r[f] for f in FEATURES), r["_bad"]))
    return learn([(r, r["_bad"]) for r in rows])


def hash_order(number: int) -> int:
    """A fixed shuffle of ids, so that rows held apart are not every third id."""
    return (int(number) * 0x9E3779B97F4A7C15) % 2**64


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with ``_stats``, ``_base_failed``, ``_rule`` (0: none) and ``_kept``."""
    stats = F.col("_stats")
    return statistics(docs, text_col).select(
        "*", base_failed(stats).alias("_base_failed"), verdict(rules, stats).alias("_rule")
    ).withColumn("_kept", ~F.col("_base_failed") & (F.col("_rule") == 0))
