"""Text quality, verdicts and risk."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def letter_shares(text: Column) -> Column:
    """Counts of letters by script, digits, spaces and the rest."""
    blocks = {"latin": "[A-Za-zÀ-ɏ]", "deva": "[ऀ-ॿ]", "bengali": "[ঀ-৿]", "odia": "[଀-୿]", "digits": "[0-9]", "spaces": "\\s"}
    counts = {name: F.regexp_count(text, F.lit(block)) for name, block in blocks.items()}
    rest = F.char_length(text) - reduce(add, counts.values())
    return F.struct(*(c.alias(n) for n, c in counts.items()), rest.alias("other"))


def garbled(text: Column) -> Column:
    """Mostly doubtful words: three marks or more, over a fifth of the words."""
    marks = F.size(F.split(text, "\\[\\?\\]")) - 1
    words = F.size(F.filter(F.split(F.btrim(text), "\\s+"), lambda w: w != ""))
    return (marks >= 3) & (marks * 5 > words)


def first_failing(rules: list[tuple[str, Column]], otherwise: str = "ok") -> Column:
    """The name of the first rule that holds."""
    ladder = F.lit(otherwise)
    for name, test in reversed(rules):
        ladder = F.when(test, F.lit(name)).otherwise(ladder)
    return ladder


def drop_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(reason, n): how many rows each rule is the first to drop."""
    return df.groupBy(first_failing(rules, "kept").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def length_outliers(pairs: DataFrame, a: str, b: str, low: float = 0.4, high: float = 3.5, least: int = 40) -> DataFrame:
    """Rows whose text a is far from the length of b; only where b has ``least`` characters or more."""
    x, y = F.char_length(a), F.char_length(b)
    return pairs.where((y >= least) & ((x < low * y) | (x > high * y)))


def risk(unknown: Column, disputes: Column, hygiene: Column, words: Column) -> Column:
    """Page risk: doubtful words for each hundred, severe ones three times."""
    return (unknown + 2 * disputes + 3 * hygiene) * 100.0 / F.greatest(words, F.lit(1))


def set_fit(passages: DataFrame, support: DataFrame, by: list[str]) -> DataFrame:
    """(by, words, supported): how many of a passage's words occur in its support.  Both are (by, word)."""
    held = support.select(*by, "word").distinct().withColumn("held", F.lit(1))
    return passages.join(held, [*by, "word"], "left").groupBy(*by).agg(F.count(F.lit(1)).alias("words"), F.count("held").alias("supported"))


def misplaced(fits: DataFrame, by: list[str], order: str, least: float = 0.45, gain: float = 0.2) -> DataFrame:
    """Rows whose words fit a neighbour: its fit is ``least`` or more and ``gain`` above the own.  fits: (by, order, own, prev, next)."""
    best = F.greatest(F.coalesce("prev", F.lit(0.0)), F.coalesce("next", F.lit(0.0)))
    return fits.where((best >= least) & (best - F.col("own") >= gain)).withColumn("best", best)


def review_queue(flags: DataFrame, priorities: dict[str, int]) -> DataFrame:
    """Flags (reason, score, ...) with ``priority`` and in order of it, then of score, worst first."""
    table = F.create_map(*(F.lit(x) for kv in priorities.items() for x in kv))
    return flags.withColumn("priority", F.coalesce(F.try_element_at(table, F.col("reason")), F.lit(len(priorities)))).orderBy("priority", F.desc("score"))


def confidence_summary(words: DataFrame, by: str = "confidence") -> DataFrame:
    """(confidence, n, per_mille)."""
    total = F.sum("n").over(Window.partitionBy())
    return words.groupBy(by).agg(F.count(F.lit(1)).alias("n")).withColumn("per_mille", F.expr("0") + (F.col("n") * 1000 / total).cast("long"))


def collision_histogram(words: DataFrame, key: str, word: str, cap: int = 6) -> DataFrame:
    """(size, keys): how many keys have so many words; the last class is open."""
    sizes = words.select(key, word).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(F.least("n", F.lit(cap)).cast("long").alias("size")).agg(F.count(F.lit(1)).alias("keys"))


def rule_differences(words: DataFrame, fine: str, coarse: str, weight: str) -> DataFrame:
    """(coarse, n_fine, weight): keys of one rule that join keys which the other keeps apart."""
    return words.groupBy(coarse).agg(F.countDistinct(fine).alias("n_fine"), F.sum(weight).alias("weight")).where("n_fine > 1")


def top_coverage(freq: DataFrame, tops: list[int]) -> DataFrame:
    """(top, covered, total): tokens that the most frequent words make up.  freq: (word, freq).

    Words are first counted by frequency, so the one ordered pass is over
    frequencies, of which there are few.
    """
    classes = freq.groupBy("freq").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = classes.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0)))
    spread = ranked.withColumn("top", F.explode(F.array(*(F.lit(t).cast("long") for t in tops))))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("top") - F.col("before")))
    return spread.groupBy("top").agg(F.sum(taken * F.col("freq")).alias("covered"), F.sum(F.col("n") * F.col("freq")).alias("total"))
