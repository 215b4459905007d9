"""Quality rules as a short-circuit cascade, in DataFrame expressions only."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters counted as symbols.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER + UPPER.lower()


def _count_of(text: Column, letters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words (long).

    NULL text counts as empty; every measure of an empty text is 0. Nothing is exploded: each text is measured inside
    its own row, so there is no shuffle. Repeated 3-word windows are found by sorting a text's window hashes with
    their positions (n log n for one text of n words), never by comparing all pairs. Columns of docs that have the
    name of a measure are replaced.
    """
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, WHITE, "") != "")
    one = docs.withColumns({"_words": words, "_lines": lines})
    n = F.size("_words")
    window = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(
            F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("p")
        ),
    )
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    two = one.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.sort_array(F.when(n >= 3, window).otherwise(none)).alias("_sorted"),
    )
    # Neighbours with one hash repeat; both of their positions start a repeated window.
    pair = F.zip_with(
        "_sorted",
        F.slice("_sorted", F.lit(2), F.size("_sorted")),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])),
    )
    kept = [*docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    three = two.select(*kept, F.filter(pair, lambda x: x.isNotNull()).alias("_pairs"))
    four = three.select(*kept, F.sort_array(F.array_distinct(F.flatten("_pairs"))).alias("_starts"))
    # Windows cover three words each; where the next start is nearer, the overlap counts once.
    width = F.zip_with(
        "_starts", F.slice("_starts", F.lit(2), F.size("_starts")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))
    )
    return four.select(*kept, F.aggregate(width, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_repeat_words"))


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """`fails` is true for a text to reject; it may use the columns that measures() gives, and the text."""

    name: str
    fails: Column


def default_rules(text_col: str = "text") -> list[Rule]:
    """Bounds that published web-text filters use, wide enough for any language written in words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [
        Rule("mean_word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("symbol_ratio", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("duplicate_lines", (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")) & (F.col("n_dup_lines") > 2)),
        Rule("upper_case", 2 * _count_of(text, UPPER) > _count_of(text, LETTERS)),
        Rule("exclamations", 4 * _count_of(text, "!?") > F.col("n_words")),
    ]


def rule_costs(sample: DataFrame, rules: list[Rule], repeats: int = 10, runs: int = 2) -> list[tuple[int, float]]:
    """(rejected, cost) of each rule alone on a persisted sample of few rows. A run judges every row `repeats` times in one
    job, so that the rule's own work outweighs the job's start; the least of `runs` runs counts, less that of an empty
    rule. Costs are rounded to powers of two of a tenth of the empty run, so that noise rarely changes them."""
    many = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    found: dict[int, tuple[int, float]] = {}

    many.agg(F.count_if(rules[0].fails)).first()  # the first job also fills the cache
    for _ in range(runs):
        for k, fails in enumerate([F.lit(False) & (F.col("_again") > 0), *(rule.fails for rule in rules)]):  # in turn: slow spells and warming up are shared
            began = time.perf_counter()
            rejected = many.agg(F.count_if(fails)).first()[0]
            found[k] = (rejected // repeats, min(time.perf_counter() - began, found.get(k, (0, math.inf))[1]))
    _, empty = found.pop(0)
    return [(rejected, 2.0 ** round(math.log2(max(1.0, 10 * (took - empty) / empty)))) for rejected, took in found.values()]


def timed_repeats(sample: DataFrame, rules: list[Rule], rows: int, most: int = 1 << 18) -> int:
    """How often to judge each of the persisted sample's rows, so that all rules together take twice what a job without
    rules takes, or more: on fewer, the jobs' own unsteadiness decides. At most about `most` rows are judged a job."""
    repeats = 10
    while 4 * repeats * rows <= most:
        many = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
        took = []
        for counts in ([F.count_if(F.lit(False) & (F.col("_again") > 0))], [F.count_if(rule.fails) for rule in rules]):
            least = math.inf
            for _ in range(2):
                began = time.perf_counter()
                many.agg(*counts).first()
                least = min(least, time.perf_counter() - began)
            took.append(least)
        if took[1] >= 2 * took[0]:
            break
        repeats *= 4
    return repeats


def cascade_order(sample: DataFrame, rules: list[Rule], reach: Column | None = None, timed_rows: int = 300) -> list[Rule]:
    """Rules by rejections per cost; most worthwhile first, equals as given. Rejections are counted on all of the sample's
    texts that `reach` holds for (all without it), in one job; costs are timed on about timed_rows of them, each judged as
    often as it takes to tell the rules' work from a job's start.

    The order decides how soon a bad text is let go, never whether it is. An empty sample keeps the given order.
    """
    sample = sample.persist()
    few = None
    try:
        # Filtered only once it is held: a filter that Catalyst moves below the measures would compute them many times.
        some = sample if reach is None else sample.where(reach)
        if len(rules) < 2:
            return list(rules)
        rows, *rejected = some.agg(F.count(F.lit(1)), *(F.count_if(rule.fails) for rule in rules)).first()
        if not rows:
            return list(rules)
        few = some.sample(False, min(1.0, timed_rows / rows), 7).persist()
        repeats = timed_repeats(few, rules, max(1, few.count()))
        worth = [(n + 0.5) / cost for n, (_, cost) in zip(rejected, rule_costs(few, rules, repeats), strict=True)]
    finally:
        sample.unpersist()
        if few is not None:
            few.unpersist()
    return [rule for _, _, rule in sorted(((-w, k, rule) for k, (w, rule) in enumerate(zip(worth, rules, strict=True))), key=lambda x: x[:2])]


def cascade(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, rejected_by): one CASE over the rules in turn, which stops at the first that a text fails."""
    rejected_by = F.lit(None).cast("string")
    for rule in reversed(rules):
        rejected_by = F.when(F.coalesce(rule.fails, F.lit(False)), F.lit(rule.name)).otherwise(rejected_by)
    return rejected_by.isNull(), rejected_by


def quality_verdicts(
    docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = 2000
) -> DataFrame:
    """Measures of each row, base_failed, kept, and rejected_by ('base', a rule's name, or NULL for kept rows).

    Extra columns pass through; those with the name of a result are replaced. Repeated rows are judged alike, ids aren't
    read, and an empty table gives no rows. A text is measured once, in its own row; of the rules' own work only that of
    rules before its first failure is done, and none where the base fails. rejected_by is the first failure in the order
    found, which a later run may find otherwise; kept never changes.
    """
    docs = docs.drop("base_failed", "kept", "rejected_by")
    rules = default_rules(text_col) if rules is None else rules
    # The sample is drawn from the source first, so only its rows are measured to find the order; those that the base
    # fails never reach a rule.
    total = docs.count()
    part = docs.sample(False, min(1.0, sample_rows / total), 7) if total else docs
    ordered = cascade_order(measures(part, text_col), rules, ~base_failed())
    _, by = cascade(ordered)
    measured = measures(docs, text_col).withColumn("base_failed", base_failed())
    judged = measured.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(by))
    return judged.withColumn("kept", F.col("rejected_by").isNull())
