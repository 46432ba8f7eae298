"""Dictionary lookups: ordered fallbacks, hydration, overlays and merges of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cascade(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """All entries at the first step, and the first place in it, that hits.

    ``candidates``: (word, step, place, form); ``entries``: (form, entry_id).
    One join answers all steps; a word keeps the rows of its least (step, place).
    """
    hits = candidates.join(entries, "form").select("word", "step", "place", "entry_id").distinct()
    best = F.min(F.struct("step", "place")).over(Window.partitionBy("word"))
    return hits.withColumn("best", best).where("step = best.step and place = best.place").drop("best")


def coverage(words: DataFrame, candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """(tokens, covered_tokens, distinct_words, covered_words) of words(word, freq)."""
    found = candidates.join(entries.select("form").distinct(), "form", "left_semi").select("word").distinct().withColumn("hit", F.lit(1))
    hit = F.col("hit").isNotNull()
    return words.join(found, "word", "left").agg(F.sum("freq").alias("tokens"), F.sum(F.when(hit, F.col("freq")).otherwise(0)).alias("covered_tokens"), F.count(F.lit(1)).alias("distinct_words"), F.count("hit").alias("covered_words"))


def hydrate(entries: DataFrame, senses: DataFrame, lang: str, keep: int = 6) -> DataFrame:
    """Entries with their senses: the wanted language first, then English, then by number; entries left empty go."""
    rank = F.when(F.col("gloss_lang") == lang, 0).when(F.col("gloss_lang") == "en", 1).otherwise(2)
    held = senses.where(F.col("gloss_lang").isin(lang, "en")).groupBy("entry_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "idx", "gloss"))), 1, keep).alias("senses"))
    return entries.join(held, "entry_id")


def cross_script(words: DataFrame, entries: DataFrame, limit: int = 3) -> DataFrame:
    """(word, entry_id): entries of another language with the same script-neutral key, the most frequent first."""
    pairs = words.alias("w").join(entries.alias("e"), F.expr("w.skey = e.skey and w.lang != e.lang")).select("w.word", "e.entry_id", "e.freq")
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("freq"), "entry_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= limit).select("word", "entry_id", "rank")


def overlay(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """The row of the first source that has the key; the number of the source is ``source_rank``."""
    ranked = None
    for k, source in enumerate(sources):
        part = source.withColumn("source_rank", F.lit(k))
        ranked = part if ranked is None else ranked.unionByName(part)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("source_rank"))
    return ranked.withColumn("first", first).where("first = 1").drop("first")


def protective_merge(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """New values, the old ones where a new value is null or empty; keys of either side."""
    o, n = old.select(*keys, *(F.col(c).alias(f"old_{c}") for c in columns)), new.select(*keys, *(F.col(c).alias(f"new_{c}") for c in columns))
    return o.join(n, keys, "full_outer").select(*keys, *(F.coalesce(F.nullif(f"new_{c}", F.lit("")), f"old_{c}").alias(c) for c in columns))


def merge_entries(entries: DataFrame, keys: list[str], priority: str, keep: int = 6) -> DataFrame:
    """Entries of several sources as one.

    The first non-null ipa and etymology by source; senses without repeats
    (letter case aside) in order of source and number, the first ``keep``.
    """
    facts = entries.groupBy(*keys).agg(F.min_by("ipa", F.when(F.col("ipa").isNotNull(), F.col(priority))).alias("ipa"), F.min_by("etymology", F.when(F.col("etymology").isNotNull(), F.col(priority))).alias("etymology"))
    said = entries.select(*keys, priority, F.posexplode("glosses").alias("idx", "gloss")).withColumn("folded", F.lower(F.btrim("gloss")))
    once = F.row_number().over(Window.partitionBy(*keys, "folded").orderBy(priority, "idx"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(priority, "idx"))
    kept = said.withColumn("once", once).where("once = 1").withColumn("place", place).where(F.col("place") <= keep)
    listed = kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gloss"))), lambda s: s["gloss"]).alias("glosses"))
    return facts.join(listed, keys, "left")


def prefix_search(entries: DataFrame, prefixes: DataFrame, limit: int = 20) -> DataFrame:
    """(prefix, headword, rank): headwords that start with a prefix, exact ones first, then by frequency.

    A headword meets a prefix by its own first letters, as many as some prefix
    has; nothing else is joined.
    """
    lengths = [r[0] for r in prefixes.select(F.char_length("prefix")).distinct().collect()]  # as many as a prefix is long
    heads = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.char_length("headword")), lambda n: F.substr(F.col("headword"), F.lit(1), n))
    pairs = prefixes.distinct().join(entries.withColumn("prefix", F.explode(heads)), "prefix")
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc(F.col("headword") == F.col("prefix")), F.desc("freq"), "headword"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= limit).select("prefix", "headword", "rank")


def base_pointers(words: DataFrame, variants: Column, entries: DataFrame) -> DataFrame:
    """(word, base): the first spelling variant that is a headword, one hop."""
    spread = words.select("word", F.posexplode(variants).alias("place", "form"))
    return spread.join(entries.select("form").distinct(), "form", "left_semi").groupBy("word").agg(F.min_by("form", "place").alias("base"))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of children that point to no parent."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def spread_to_group(meanings: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(word, gloss): a group's meaning for every member of its spelling group."""
    return members.join(meanings.select(key, "gloss"), key).select("word", "gloss")
