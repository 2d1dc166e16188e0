"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Rules compare a measure of the text with a cutoff. Labelled good documents (quality 1) of each stratum, the language, are the holdout, in two halves by id hash.
One half, with the bad documents, proposes STEPS sets of cutoffs, from lenient to strict: step t allows each rule a share t / STEPS of the risk among that half's good
documents, and takes the rule's cutoff that then rejects the most bad ones (the most lenient on ties; a rule that rejects none is left out). The other half tests
whole sets: a set may be used only if an exact binomial test rejects, at a corrected level, that its rules together reject more
than `risk` of the stratum's good documents: P(Bin(n, risk) <= rejected) <= delta / strata (Bonferroni). Sets are tested from lenient to strict and testing
stops at the first that fails (fixed sequence), which needs no further division. So with chance 1 - delta no stratum loses more than `risk` of its good documents to all rules.

Defined results: a null text has no words and fails the base; a null stratum is a stratum of its own; a stratum with
too few labels gets no cutoffs, so the base alone decides there; a document with several labels counts once, as bad if any label says so, and so does a labelled id that several rows
have; an empty table of documents or labels is allowed; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, checked, stored, text_or_empty

#: Share of good documents that all rules may reject in a stratum, the chance that any of these bounds is wrong, and sets of cutoffs that are tried.
RISK = 0.02
DELTA = 0.05
STEPS = 8
#: Fixed cutoffs of the rules, lenient to strict; a document is rejected above (+1) or below (-1) the cutoff.
RULES: dict[str, tuple[int, tuple[float, ...]]] = {
    "symbol_share": (1, (0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)),
    "dup_line_share": (1, (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeat_share": (1, (0.18, 0.15, 0.12, 0.1, 0.08, 0.06)),
    "mean_word_long": (1, (20.0, 15.0, 12.0, 11.0, 10.0, 9.0)),
    "mean_word_short": (-1, (2.0, 2.5, 3.0, 3.5)),
    "capital_share": (1, (0.9, 0.7, 0.5, 0.4, 0.3, 0.2)),
}


def repeat_windows(words: Column) -> Column:
    """Hashes of the 5-word windows of a text, from the array of its words' hashes; none where there is one window at most."""
    windows = F.when(F.size(words) >= 6, F.transform(
        F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)])))
    return F.coalesce(windows, F.array().cast("array<bigint>"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The counts of each document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_lines, n_capitals."""
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col), *keep, text.alias("_text"), F.array_remove(F.split(text, SPACE), "").alias("_words"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.select(
        id_col, *keep, F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}", ""))).cast("long").alias("n_capitals"),
        lines.alias("_lines"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    base = base.select(
        id_col, *keep, "n_words", "word_chars", "n_symbols", "n_capitals", F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_windows(F.col("_hashes")).alias("_windows"))
    base = base.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda i: F.get("_sorted", i)["h"]
    base = base.withColumn("_places", F.when(F.col("_sorted").isNotNull(), F.array_sort(F.transform(F.filter(
        "_sorted", lambda x, i: F.coalesce((same(i - 1) == x["h"]) | (same(i + 1) == x["h"]), same(i - 1) == x["h"], same(i + 1) == x["h"], F.lit(False))), lambda x: x["i"]))))
    covered = F.aggregate(F.transform("_places", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("_places", i + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    return base.select(id_col, *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", "n_capitals")


def rule_values() -> dict[str, Column]:
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "symbol_share": part("n_symbols", "word_chars"), "dup_line_share": part("n_dup_lines", "n_lines"),
        "repeat_share": part("n_repeat_words", "n_words"), "mean_word_long": part("word_chars", "n_words"),
        "mean_word_short": part("word_chars", "n_words"), "capital_share": part("n_capitals", "word_chars"),
    }


def _rejects(value: Column, side: int, cutoff: float | Column) -> Column:
    return value > cutoff if side > 0 else value < cutoff


def binomial_tail(n: Column, x: Column, p: float) -> Column:
    """P(Bin(n, p) <= x), summed term by term from logarithms."""
    step = lambda a, i: F.struct(
        (a["t"] + F.log(n - i + 1) - F.log(i) + F.lit(math.log(p / (1 - p)))).alias("t"),
        (a["s"] + F.exp(a["t"] + F.log(n - i + 1) - F.log(i) + F.lit(math.log(p / (1 - p))))).alias("s"))
    start = F.struct((n * F.lit(math.log(1 - p))).alias("t"), F.exp(n * F.lit(math.log(1 - p))).alias("s"))
    tail = F.when(x <= 0, start["s"]).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(x, F.lit(1))), start, step, lambda a: a["s"]))
    # beyond n * p + 1 rejections no cutoff passes: the tail is above one half there
    return F.when(x > n * p + 1, F.lit(1.0)).otherwise(tail)


def _hits(cutoffs: str) -> Column:
    """Names of the rules that reject a document, with the cutoffs of a map column."""
    values = rule_values()
    hits = F.array(*[F.when(_rejects(values[r], side, F.element_at(cutoffs, r)), F.lit(r)) for r, (side, _) in RULES.items()])
    return F.coalesce(F.filter(hits, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def proposed(tuning: DataFrame, risk: float) -> DataFrame:
    """stratum, step, cutoffs (by rule) from measured documents with stratum and good."""
    values = rule_values()
    grid = [(rule, side, i, c) for rule, (side, cuts) in RULES.items() for i, c in enumerate(cuts)]
    cells = tuning.groupBy("stratum").agg(
        F.count_if("good").alias("holdout"),
        F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("place"), F.lit(float(c)).alias("cutoff"),
                           F.count_if(F.col("good") & _rejects(values[rule], side, c)).alias("rejected_good"),
                           F.count_if(~F.col("good") & _rejects(values[rule], side, c)).alias("rejected_bad"))
                  for rule, side, i, c in grid]).alias("cells"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step")
    allowed = cells.select("stratum", "holdout", F.inline("cells")).select("*", steps).where((F.col("rejected_good") <= F.col("holdout") * risk * F.col("step") / STEPS) & (F.col("rejected_bad") > 0))
    best = allowed.groupBy("stratum", "step", "rule").agg(F.max_by("cutoff", F.struct("rejected_bad", -F.col("place"))).alias("cutoff"))
    return best.groupBy("stratum", "step").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))  # one for each rule


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id") -> DataFrame:
    """stratum, cutoffs, holdout (good documents tested), rejected_good: the strictest set of cutoffs of each stratum that may be used."""
    of_label = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.min("quality") == 1).alias("good"))
    marked = stored(measured.where(~F.col("base_failed")).join(of_label, F.col(id_col) == F.col("_id")).dropDuplicates(["_id"])
                    .withColumn("tuning", F.pmod(F.xxhash64(F.lit("half"), "_id"), F.lit(2)) == 0))
    sets = stored(proposed(marked.where("tuning"), risk))  # at most STEPS for each stratum
    strata = max(1, marked.select("stratum").distinct().count())
    tested = marked.where("good and not tuning").alias("d").join(checked(sets).alias("s"), F.col("d.stratum").eqNullSafe(F.col("s.stratum"))).select("d.*", "step", "cutoffs")
    counts = tested.groupBy("stratum", "step").agg(F.count("*").alias("holdout"), F.count_if(F.size(_hits("cutoffs")) > 0).alias("rejected_good"), F.first("cutoffs").alias("cutoffs"))
    passed = counts.withColumn("passed", binomial_tail(F.col("holdout"), F.col("rejected_good"), risk) <= delta / strata)
    so_far = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    usable = passed.withColumn("passed", F.min("passed").over(so_far)).where("passed")
    return usable.groupBy("stratum").agg(F.max_by(F.struct("cutoffs", "holdout", "rejected_good"), "step").alias("best")).select("stratum", "best.*")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its counts, base_failed, kept, and failed_rules (names of the rules that rejected it)."""
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    narrow = docs.select(F.col(id_col), F.col(text_col), F.col(stratum).alias("stratum"))
    measured = stored(measures(narrow, id_col, text_col, ("stratum",)).withColumn("base_failed", base_failed))
    found = stored(thresholds(measured, labels, risk, delta, id_col).select("stratum", "cutoffs"))
    joined = measured.alias("m").join(checked(found).alias("f"), F.col("m.stratum").eqNullSafe(F.col("f.stratum")), "left").select("m.*", "cutoffs")
    return joined.withColumn("failed_rules", _hits("cutoffs")).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules", F.col("stratum").alias("stratum"))
