"""Voting between several readings of one text."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wordloom.functions.tokens import core, marked_tokens


def decide(a: Column, b: Column, t: Column, known_a: Column, known_b: Column) -> Column:
    """(chosen, confidence, review) of three readings of a word; null where a reader has none.

    Two that agree win.  Else a single candidate stands alone; of two, the one
    that the lexicon knows is taken if it knows just one; else a is kept in
    dispute.  Everything that no second reader bears out goes to review.
    """
    ca, cb, ct = core(a), core(b), core(t)

    def verdict(chosen: Column, confidence: str, review: bool) -> Column:
        return F.struct(chosen.alias("chosen"), F.lit(confidence).alias("confidence"), F.lit(review).alias("review"))

    ladder = (
        F.when(a.isNotNull() & (ca == cb), verdict(a, "AB", False))
        .when(a.isNotNull() & (ca == ct), verdict(a, "AT", False))
        .when(b.isNotNull() & (cb == ct), verdict(b, "BT", False))
        .when(a.isNull() & b.isNull() & t.isNotNull(), verdict(t, "single", True))
        .when(a.isNull() & b.isNull(), verdict(F.lit(None).cast("string"), "single", False))
        .when(a.isNull() | b.isNull(), verdict(F.coalesce(a, b), "single", True))
    )
    only_one = F.coalesce(known_a, F.lit(False)) != F.coalesce(known_b, F.lit(False))
    return ladder.when(only_one, verdict(F.when(known_a, a).otherwise(b), "lex", True)).otherwise(verdict(a, "dispute", True))


def decide_words(readings: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Readings (key columns, a, b, t) with chosen, confidence and review; ``lexicon``: (word)."""
    words = lexicon.select(F.col("word").alias("_word")).distinct()
    known = readings
    for side in ("a", "b"):
        known = known.withColumn("_core", core(F.col(side))).join(words.withColumn(f"_known_{side}", F.lit(True)), F.col("_core") == F.col("_word"), "left").drop("_core", "_word")
    result = decide(F.col("a"), F.col("b"), F.col("t"), F.col("_known_a"), F.col("_known_b"))
    return known.withColumn("_d", result).select(*readings.columns, "_d.*")


def majority(readings: DataFrame, keys: list[str], reading: str = "reading") -> DataFrame:
    """(keys, winner, votes): the reading that two or more give and more than any other."""
    votes = readings.where(F.col(reading) != "").groupBy(*keys, reading).agg(F.count(F.lit(1)).alias("votes"))
    order = Window.partitionBy(*keys).orderBy(F.desc("votes"), reading)
    ranked = votes.withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead("votes").over(order))
    return ranked.where("rank = 1 and votes >= 2 and (second is null or second < votes)").select(*keys, F.col(reading).alias("winner"), "votes")


def vote_titles(a: Column, b: Column, c: Column) -> Column:
    """Word by word, what two of three titles of the same length agree on; else a title that two readers give whole."""
    x, y, z = (F.split(F.btrim(t), "\\s+") for t in (a, b, c))
    pick = F.transform(F.arrays_zip(x.alias("x"), y.alias("y"), z.alias("z")), lambda w: F.when((w["x"] == w["y"]) | (w["x"] == w["z"]), w["x"]).when(w["y"] == w["z"], w["y"]))
    whole = (F.size(x) == F.size(y)) & (F.size(x) == F.size(z)) & ~F.exists(pick, lambda w: w.isNull())
    return F.when(whole, F.array_join(pick, " ")).when((a == b) | (a == c), a).when(b == c, b)


def _blocks(x: list[str], y: list[str]) -> list[tuple[int | None, int | None]]:
    pairs: list[tuple[int | None, int | None]] = []
    for op, i, i2, j, j2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        n = min(i2 - i, j2 - j) if op in ("equal", "replace") else 0
        pairs += zip(range(i, i + n), range(j, j + n), strict=True)
        pairs += [(k, None) for k in range(i + n, i2)] + [(None, k) for k in range(j + n, j2)]
    return pairs


_PAIRS = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))


@F.pandas_udf(_PAIRS)
def align_tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    """Pairs of places of two token arrays by longest common blocks; replaced tokens are paired in order."""
    return pd.Series([[{"i": i, "j": j} for i, j in _blocks(list(x), list(y))] if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def combine_pages(pages: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Pages (page, a, b, t texts) as words: (page, place, a, b, t, chosen, confidence, review).

    Reading a gives the places; b and t are aligned onto it.  Words only b has
    follow with a null place and confidence ``omission``.
    """
    tokens = pages.select("page", *(marked_tokens(F.col(c)).alias(c) for c in ("a", "b", "t")))
    cores = {c: F.transform(c, core) for c in ("a", "b", "t")}
    tokens = tokens.withColumn("ab", align_tokens(cores["a"], cores["b"])).withColumn("at", align_tokens(cores["a"], cores["t"]))
    base = tokens.select("page", F.posexplode("a").alias("place", "a"))
    side = {}
    for c, pairs in (("b", "ab"), ("t", "at")):
        spread = tokens.select("page", F.col(c).alias("held"), F.explode(pairs).alias("p")).select("page", F.col("p.i").alias("place"), F.try_element_at("held", F.col("p.j") + 1).alias(c))
        side[c] = spread
    read = base.join(side["b"].where("place is not null"), ["page", "place"], "left").join(side["t"].where("place is not null"), ["page", "place"], "left")
    marker = (core(F.col("a")) == "") | F.col("a").startswith("॥")
    decided = decide_words(read.where(~marker), lexicon)
    extra = side["b"].where("place is null and b is not null").where(core(F.col("b")) != "")
    return decided.unionByName(extra.select("page", "place", F.lit(None).cast("string").alias("a"), "b", F.lit(None).cast("string").alias("t"), F.lit(None).cast("string").alias("chosen"), F.lit("omission").alias("confidence"), F.lit(True).alias("review")))


def error_rate(a: Column, b: Column) -> Column:
    """Character error rate of b against a."""
    return F.levenshtein(a, b) / F.greatest(F.char_length(a), F.lit(1))


@F.pandas_udf(T.DoubleType())
def word_error_rate(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of a's tokens that b does not give in the same order."""

    def rate(x, y) -> float | None:
        if x is None or y is None:
            return None
        wrong = sum(i is None or j is None or x[i] != y[j] for i, j in _blocks(list(x), list(y)))
        return wrong / max(1, len(x))

    return pd.Series([rate(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def confusions(pairs: DataFrame, stored: str, read: str) -> DataFrame:
    """(stored, read, n): words read as others, most frequent first."""
    x, y = F.split(F.btrim(stored), "\\s+"), F.split(F.btrim(read), "\\s+")
    tokens = pairs.select(x.alias("x"), y.alias("y")).withColumn("p", F.explode(align_tokens("x", "y")))
    words = tokens.where("p.i is not null and p.j is not null").select(F.col("x")[F.col("p.i")].alias(stored), F.col("y")[F.col("p.j")].alias(read))
    return words.where(F.col(stored) != F.col(read)).groupBy(stored, read).agg(F.count(F.lit(1)).alias("n"))


def comparison_class(stored: Column, reader: Column, third: Column) -> Column:
    """What three texts of a line say: same, stored_wrong, reader_wrong or unclear."""
    x, y, z = (F.regexp_replace(c, "\\s+", " ") for c in (stored, reader, third))
    return F.when(x == y, "same").when(y == z, "stored_wrong").when(x == z, "reader_wrong").otherwise("unclear")


def rescore(candidates: DataFrame, keys: list[str], penalty: float = 4.0) -> DataFrame:
    """(keys, text): the candidate with the best log likelihood, ``penalty`` off for each unknown word.  Candidates: (keys, text, loglik, unknown)."""
    return candidates.groupBy(*keys).agg(F.max_by("text", F.struct((F.col("loglik") - penalty * F.col("unknown")).alias("score"), "text")).alias("text"))


def fix_misreads(freq: DataFrame, substitutions: DataFrame, rare: int = 3, least: int = 3, factor: int = 3) -> DataFrame:
    """(word, fixed): rare words turned into an attested one by the first substitution that does it.

    ``freq``: (word, freq); ``substitutions``: (place, old, new), a fixed list,
    tried by place.  A word seen ``rare`` times at most becomes what replacing
    all of ``old`` gives, if that is seen ``least`` times or more and more than
    ``factor`` times as often as the word.
    """
    tried = freq.where(F.col("freq") <= rare).join(F.broadcast(substitutions), F.expr("contains(word, old)"))
    tried = tried.select("word", "freq", "place", F.expr("replace(word, old, new)").alias("fixed"))
    known = tried.join(freq.select(F.col("word").alias("fixed"), F.col("freq").alias("seen")), "fixed").where((F.col("seen") >= least) & (F.col("seen") > factor * F.col("freq")))
    return known.groupBy("word").agg(F.min_by("fixed", "place").alias("fixed"))
