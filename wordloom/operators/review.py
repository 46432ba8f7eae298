"""Spaced repetition, reading progress and keyed user tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days until a card comes back, by stage.
STEPS = (1, 3, 7, 21)
DAY_MS = 86_400_000


def stage_after(stage: Column, remembered: Column) -> Column:
    """0 after a miss, else one more, at most the number of steps."""
    return F.when(~remembered, 0).otherwise(F.least(stage + 1, F.lit(len(STEPS))))


def due_at(now_ms: Column, stage: Column) -> Column:
    """Epoch milliseconds at which a card of this stage is due."""
    at = F.least(F.greatest(stage, F.lit(0)), F.lit(len(STEPS) - 1))
    return now_ms + F.element_at(F.array(*map(F.lit, STEPS)), at + 1).cast("long") * DAY_MS


def is_due(now_ms: Column, due_ms: Column, stage: Column) -> Column:
    """Due, or due further ahead than any step can say (a wrong clock); learned cards never are."""
    ahead = due_ms - now_ms
    return (stage < len(STEPS)) & ((ahead <= 0) | (ahead > (STEPS[-1] + 1) * DAY_MS))


def fold_reviews(answers: DataFrame, keys: list[str], ts_ms: str, remembered: str) -> DataFrame:
    """(keys, stage, due_at) after all answers in order of time.

    The stage is the number of answers remembered since the last miss, so no
    state is walked: two aggregates give it.
    """
    missed = F.max(F.when(~F.col(remembered), F.col(ts_ms)))
    last = answers.groupBy(*keys).agg(missed.alias("missed"), F.max(ts_ms).alias("last"))
    joined = answers.join(last, keys)
    since = F.sum(F.when(F.col(remembered) & (F.col("missed").isNull() | (F.col(ts_ms) > F.col("missed"))), 1).otherwise(0))
    folded = joined.groupBy(*keys, "last").agg(since.alias("streak")).withColumn("stage", F.least("streak", F.lit(len(STEPS))).cast("int"))
    return folded.select(*keys, "stage", due_at(F.col("last"), F.col("stage")).alias("due_at"))


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing rows, and the first new row of each key that isn't there yet."""
    both = existing.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    columns = [c for c in existing.columns if c not in keys]
    first = both.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct("_age", order)).alias("_row"))
    return first.select(*keys, "_row.*")


def latest(changes: DataFrame, keys: list[str], ts: str, deleted: str | None = None) -> DataFrame:
    """The last row of each key of a change log; keys whose last row is a deletion go."""
    columns = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(ts, *(c for c in columns if c != ts))).alias("_row")).select(*keys, "_row.*")
    return last.where(~F.col(deleted)) if deleted else last


def progress(chapters: DataFrame, finished: DataFrame, section: str, chapter: str) -> DataFrame:
    """(section, chapters, done, words_left)."""
    done = finished.select(section, chapter).distinct().withColumn("_done", F.lit(1))
    left = F.sum(F.when(F.col("_done").isNull(), F.col("words")).otherwise(0))
    return chapters.join(done, [section, chapter], "left").groupBy(section).agg(F.count(F.lit(1)).alias("chapters"), F.count("_done").alias("done"), left.alias("words_left"))


def minutes(words: Column, per_minute: int = 200) -> Column:
    """Reading minutes, rounded up."""
    return F.ceil(words / per_minute)


def speaking_seconds(chars: Column, rate: Column, gaps_ms: Column, floor_ms: Column) -> Column:
    """Seconds that a text takes: characters at a rate, and gaps no shorter than a floor.  ``gaps_ms`` is an array."""
    gaps = F.aggregate(gaps_ms, F.lit(0.0), lambda t, g: t + F.greatest(g, floor_ms))
    return chars / rate + gaps / 1000
