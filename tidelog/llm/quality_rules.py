"""Quality rules as a short-circuit cascade, with built-in functions only.

Each rule is a Boolean column that is true where a document fails. Before the run,
every rule's cost (seconds over a sample) and rejection rate are measured, and the
rules are put in the order of rejections per second: a document is not tested
further once a rule has rejected it. The order never changes the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.llm.shared import SPACES, fresh

#: About so many rows, of all parts of the table, on which costs and rejection rates are estimated,
#: and how often each is tested, so that a rule's own time shows. They only set the order.
SAMPLE_ROWS = 1000
REPEATS = 5


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def default_rules() -> list[Rule]:
    """Rules over the counts of :func:`with_counts` and over the text itself."""
    n, text = F.col("n_words"), F.col("_text")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n),
        Rule("duplicate_lines", (F.col("n_dup_lines") * 10 > F.size("_lines") * 3) & (F.col("n_dup_lines") >= 2)),
        Rule("word_length", (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 15)),
        Rule("capitals", capitals * 2 > letters),
        Rule("letters", letters * 2 < F.col("word_chars")),
        Rule("exclamations", (F.length(text) - F.length(F.translate(text, "!", ""))) * 5 > n),
    ]


def with_counts(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null text has no words. Helper columns start
    with ``_``. Windows of five words are compared by a chained 64-bit hash; a text
    without a repeated hash is done after one distinct count, and for the others the
    windows are sorted by hash, which takes n log n steps for any text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.trim(F.col("_text"), F.lit(SPACES))
    out = docs.withColumn("_text", text)
    out = out.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+")))
    out = out.withColumn("_lines", F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    window = lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(5)])
    out = out.withColumn(
        "_windows",
        F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 5), window))
        .otherwise(F.array().cast("array<bigint>")),
    )
    out = out.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    by_hash = F.array_sort(F.transform(F.col("_windows"), lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    out = out.withColumn("_sorted", F.when(F.col("_repeats"), by_hash))
    same = lambda x, i: (F.get(F.col("_sorted"), i - 1)["h"] == x["h"]) | F.coalesce(F.get(F.col("_sorted"), i + 1)["h"] == x["h"], F.lit(False))
    found = F.filter(F.col("_sorted"), lambda x, i: F.coalesce(same(x, i), F.get(F.col("_sorted"), i + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn("_places", F.when(F.col("_repeats"), F.sort_array(F.transform(found, lambda x: x["p"]))))
    gaps = F.transform(F.col("_places"), lambda p, i: F.least(F.lit(5), F.coalesce(F.get(F.col("_places"), i + 1) - p, F.lit(5))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumns({
        "word_chars": F.length(F.regexp_replace("_text", r"[ \t-\r]+", "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("_repeats"), covered).otherwise(F.lit(0)).cast("long"),
    })
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def ordered(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules with their cost (seconds a sample row) and rejection rate, most rejections per second first."""
    sample = docs.select("text").sample(min(1.0, sample_rows / max(docs.count(), 1)), seed=11).repartition(4)
    counted = with_counts(sample).cache()
    try:
        rows = max(counted.count(), 1)
        often = counted.where(~F.col("base_failed")).withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

        def timed(fails: Column) -> tuple[float, int]:
            began = time.perf_counter()
            n = often.agg(F.count(F.when(fails, 1)).alias("n")).collect()[0]["n"]
            return time.perf_counter() - began, n

        idle = min(timed(F.col("n_words") < 0)[0] for _ in range(2))
        measured = []
        for rule in rules:
            seconds, rejected = timed(rule.fails)
            measured.append((rule, max(seconds - idle, 1e-3) / (rows * REPEATS), rejected / (rows * REPEATS)))
    finally:
        counted.unpersist()
    return sorted(measured, key=lambda x: (-x[2] / x[1], x[0].name))


def cascade(rules: list[Rule]) -> Column:
    """The first rule that fails, by name; null if none does. Later rules aren't evaluated."""
    out = None
    for rule in rules:
        out = F.when(rule.fails, rule.name) if out is None else out.when(rule.fails, rule.name)
    return out if out is not None else F.lit(None).cast("string")


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All rows of ``docs`` with the counts, base_failed, failed_rule and kept.

    Null and empty texts have no words, fail the base rule and aren't kept. Repeated
    rows are judged alike. An empty table gives an empty table. Columns of ``docs``
    named like an added one are replaced; all others are kept.
    """
    rules = default_rules() if rules is None else rules
    docs = docs.drop(*ADDED)
    # helper columns begin with an underscore
    hidden = [c for c in docs.columns if c.startswith("_")]
    renamed = dict(zip(hidden, fresh(docs, *["kept" + c for c in hidden])))
    docs = docs.withColumnsRenamed(renamed)
    order = [rule for rule, _, _ in ordered(docs, rules, sample_rows)]
    out = with_counts(docs).withColumn("failed_rule", F.when(F.col("base_failed"), "base").otherwise(cascade(order)))
    out = out.withColumn("kept", F.col("failed_rule").isNull())
    return out.drop("_text", "_words", "_lines", "_windows", "_repeats", "_sorted", "_places").withColumnsRenamed({v: k for k, v in renamed.items()})


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", "kept"]


def kept_rows(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs``, in its columns, that pass the base rule and the cascade.

    The row number in the condition keeps the optimizer from moving the filter below the
    counts, where each use of the word array would split the text again. Repeated rows stay or
    go together; null and empty texts go; an empty table gives an empty table.
    """
    # columns named like the counts come back as they were
    clash = [c for c in docs.columns if c.lower() in ADDED]
    renamed = dict(zip(clash, fresh(docs, *["own_" + c for c in clash])))
    judged = quality_rules(docs.withColumnsRenamed(renamed), rules)
    (row,) = fresh(judged, "row")
    judged = judged.withColumn(row, F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col(row) >= 0)).drop(row, *ADDED).withColumnsRenamed({v: k for k, v in renamed.items()}).select(docs.columns)
