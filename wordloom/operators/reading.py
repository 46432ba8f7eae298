"""Filters, fallbacks, queues and repairs of a reader's library."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wordloom.functions.keys import loose_roman
from wordloom.functions.normalize import fold_nasal, script_key, strip_nukta, tidy_dashes, word_norm
from wordloom.functions.scripts import folded, strip_title
from wordloom.functions.tokens import core, stems
from wordloom.operators.quality import garbled
from wordloom.operators.similarity import edit1_pairs
from wordloom.sources.shared import materialise


def clean_rows(rows: DataFrame, titles: DataFrame, by: list[str], number: str, source: str, translations: list[str], verb: str, speaker: str = "speaker", garbled_in: str | None = None) -> DataFrame:
    """Rows of a chapter table as they are read: what the print left in their texts goes.

    In the first row of a chapter a title (by, title) that ran into the source
    or a translation is taken off; if the source then begins with a line that
    holds ``verb``, that is the speaker, where the row has none.  Dashes are
    written one way, blank speakers are null, and a text of ``garbled_in`` that
    is mostly doubtful is empty.
    """
    first = F.row_number().over(Window.partitionBy(*by).orderBy(number)) == 1
    held = rows.join(titles.select(*by, F.col("title").alias("_title")), by, "left").withColumn("_first", first)
    bare = {c: F.when(F.col("_first"), strip_title(F.col(c), F.coalesce("_title", F.lit("")))).otherwise(F.col(c)) for c in (source, *translations)}
    head = F.regexp_extract(bare[source], "^([^\\n]*)\\n?", 1)
    leaked = F.col("_first") & (bare[source] != F.col(source)) & F.contains(head, F.lit(verb))
    own = F.nullif(F.btrim(speaker), F.lit(""))
    out = {speaker: F.coalesce(own, F.when(leaked, F.btrim(head))), source: F.when(leaked, F.regexp_replace(bare[source], "^[^\\n]*\\n?", "")).otherwise(bare[source])}
    out |= {c: tidy_dashes(bare[c]) for c in translations}
    if garbled_in is not None:
        out[garbled_in] = F.when(garbled(out[garbled_in]), F.lit("")).otherwise(out[garbled_in])
    return held.withColumns(out).select(*rows.columns)


def noted(notes: DataFrame, colour: Column | None, needle: Column, columns: list[str]) -> DataFrame:
    """Notes of a colour (any if None) with the needle in one of the columns, letter case aside; an empty needle is in all."""
    held = reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lower(needle)), F.lit(False)) for c in columns))
    return notes.where(held | (needle == "")) if colour is None else notes.where(colour & (held | (needle == "")))


def mentioned(fields: Column, needle: Column) -> Column:
    """Whether one of an array of texts contains the needle, letter case aside."""
    return F.exists(F.array_compact(fields), lambda f: F.contains(F.lower(f), F.lower(needle)))


def first_text(*texts: Column, missing: str = "not available") -> Column:
    """The first text that is neither null nor blank."""
    return F.coalesce(*(F.when(F.btrim(t) != "", t) for t in texts), F.lit(missing))


def licence_line(text: Column) -> Column:
    """The first line that names a licence; null if none does."""
    line = F.regexp_extract(text, "(?im)^.*\\b(?:licen[cs]e[ds]?|copyright|public domain|CC[ -]BY)\\b.*$", 0)
    return F.nullif(line, F.lit(""))


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Columns that a table should have and lacks."""
    return [c for c in wanted if c not in df.columns]


def found_inside(text: Column, needle: Column) -> Column:
    """How a needle is found in a text: as it is (1), without marks (2), by a word's loose key (3), the key within another or around it (4); null if not."""
    keys = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit("([^\\s\\p{P}]+)"), F.lit(1))), lambda w: loose_roman(w))
    key = loose_roman(needle)
    inside = F.exists(keys, lambda k: (F.char_length(k) >= 3) & (F.contains(k, key) | F.contains(key, k)))
    return F.when(F.contains(F.lower(text), F.lower(needle)), 1).when(F.contains(folded(text), folded(needle)), 2).when(F.array_contains(keys, key) & (F.char_length(key) >= 3), 3).when(inside & (F.char_length(key) >= 3), 4)


def lengths_through_pointers(rows: DataFrame, own: str, pointer: str, text: str) -> DataFrame:
    """(unit, length, rows): a row without a text of its own counts for the one it points to."""
    return rows.groupBy(F.coalesce(pointer, own).alias("unit")).agg(F.sum(F.coalesce(F.char_length(text), F.lit(0))).alias("length"), F.count(F.lit(1)).alias("rows"))


def counts_by(entries: DataFrame, senses: DataFrame, key: str, by: str) -> DataFrame:
    """(by, entries, senses, without): entries and senses of each language, and entries without a sense."""
    held = senses.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    joined = entries.join(held, key, "left")
    return joined.groupBy(by).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("n"), F.lit(0)).alias("senses"), F.count(F.when(F.col("n").isNull(), 1)).alias("without"))


def words_around(words: Column, at: Column, reach: int = 3) -> Column:
    """The words up to ``reach`` places before and after a 1-based place; null where there is no such place."""
    low = F.greatest(at - reach, F.lit(1))
    return F.when((at >= 1) & (at <= F.size(words)), F.slice(words, low, at + reach - low + 1))


def work_queue(words: DataFrame, group: str, word: str = "word", freq: str = "freq") -> DataFrame:
    """(group, members, weight, first): groups with the sum of their members' frequency and the most frequent member."""
    return words.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.sum(freq).alias("weight"), F.min_by(word, F.struct(-F.col(freq), F.col(word))).alias("first"))


def reference_key(ref: Column) -> Column:
    """Numbers of a dotted reference, for sorting in the order of a book."""
    return F.transform(F.split(ref, "\\."), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, "^\\s*([0-9]{1,9})", 1), F.lit("")), F.lit("0")).cast("int"))


def set_differences(sets: DataFrame, name: str, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, only_a, only_b): how far two named sets are from being equal."""
    spark = sets.sparkSession
    wanted = spark.createDataFrame(pairs, "a string, b string")
    members = sets.select(F.col(name).alias("name"), F.col(value).alias("value")).distinct()
    sides = wanted.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("name"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col("b").alias("name"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("s"))
    held = sides.select("a", "b", "s.*").join(members, "name").groupBy("a", "b", "value").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    counted = held.groupBy("a", "b").agg(F.count(F.when(F.expr("y = 0"), 1)).alias("only_a"), F.count(F.when(F.expr("x = 0"), 1)).alias("only_b"))
    return wanted.join(counted, ["a", "b"], "left").select("a", "b", F.coalesce("only_a", F.lit(0)).alias("only_a"), F.coalesce("only_b", F.lit(0)).alias("only_b"))


def in_any(tables: list[DataFrame], key: str) -> DataFrame:
    """(key): values that at least one of the tables holds."""
    return reduce(lambda a, b: a.unionByName(b), (t.select(key) for t in tables)).distinct()


def merge_lists(lists: list[Column]) -> Column:
    """Several ordered lists one after the other; what an earlier one has is not repeated."""
    return F.array_distinct(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in lists)))


def line_variants(lines: DataFrame, neighbours: DataFrame, per_word: int = 3, per_line: int = 6) -> DataFrame:
    """(line, variant, text): each line as it is (variant 0) and with one unknown word replaced by a near known one.

    lines: (line, text); neighbours: (word, near, freq) of unknown words of
    four letters and more.  Words from left to right, the most frequent
    neighbours first.
    """
    tokens = lines.select("line", F.split(F.btrim("text"), "\\s+").alias("tokens"))
    places = tokens.select("line", F.posexplode("tokens").alias("place", "token")).withColumn("word", core(F.col("token")))
    best = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("freq"), "near"))
    near = neighbours.where(F.char_length("word") >= 4).withColumn("rank", best).where(F.col("rank") <= per_word)
    tried = places.join(near, "word")
    tried = tried.withColumn("variant", F.row_number().over(Window.partitionBy("line").orderBy("place", "rank"))).where(F.col("variant") <= per_line)
    changed = F.transform("tokens", lambda t, i: F.when(i == F.col("place"), F.replace(F.col("token"), F.col("word"), F.col("near"))).otherwise(t))
    made = tried.join(tokens, "line").select("line", "variant", F.array_join(changed, " ").alias("text"))
    return tokens.select("line", F.lit(0).alias("variant"), F.array_join("tokens", " ").alias("text")).unionByName(made)


@F.pandas_udf(T.DoubleType())
def support(mine: pd.Series, pool: pd.Series) -> pd.Series:
    """Share of the words that the pool holds, or holds nearly (ratio 0.78); 0 where either is empty."""

    def share(words, others) -> float:
        if words is None or others is None or not len(words) or not len(others):
            return 0.0
        held = list(dict.fromkeys(others))
        exact = set(held)
        return sum(w in exact or bool(difflib.get_close_matches(w, held, 1, 0.78)) for w in words) / len(words)

    return pd.Series([share(a, b) for a, b in zip(mine, pool, strict=True)], dtype="float64")


def dominant_fix(words: DataFrame, freq: DataFrame, least: int = 3, factor: int = 3, min_len: int = 4) -> DataFrame:
    """(word, fixed): unknown words one edit from a known one that is frequent and clearly ahead of the next candidate.

    A rule kept for evaluation only.  freq: (word, freq).
    """
    unknown = words.select("word").distinct().where(F.char_length("word") >= min_len).join(freq.select("word"), "word", "left_anti")
    pairs = edit1_pairs(unknown, freq.select("word")).where("left_word != right_word")
    ranked = pairs.join(freq.select(F.col("word").alias("right_word"), "freq"), "right_word")
    order = Window.partitionBy("left_word").orderBy(F.desc("freq"), F.desc("right_word"))
    ranked = ranked.withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead("freq").over(order))
    return ranked.where((F.col("rank") == 1) & (F.col("freq") >= least) & (F.col("second").isNull() | (F.col("freq") >= factor * F.col("second")))).select(F.col("left_word").alias("word"), F.col("right_word").alias("fixed"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def likenesses(candidates: pd.Series, whole: pd.Series) -> pd.Series:
    """Ratio of matching blocks of each candidate and the whole, 0 to 1."""
    return pd.Series([[difflib.SequenceMatcher(None, c, w, autojunk=False).ratio() for c in cs] if cs is not None else None for cs, w in zip(candidates, whole, strict=True)])


#: The longest passage, the least likeness, the bounds of its length against the original's, and the least that must be left.
PASSAGE, ALIKE, SHORTER, LONGER, LEFT = 450, 0.62, 0.6, 1.6, 20


def remove_original(text: Column, original: Column, marker: str, letters: str) -> Column:
    """The text without a copy of the original that stands in it before its marker.

    A copy may begin where the original's first two words stand (or the first
    alone, from six letters on), or at the text's start, and ends at the next
    marker.  The first such passage goes that is like the original in letters
    and length and leaves enough of the text; white space becomes single
    blanks then.  A text without one stays as it is, a null one is null.
    """
    flat = F.btrim(F.regexp_replace(text, "\\s+", " "))
    words = F.regexp_extract_all(F.coalesce(original, F.lit("")), F.lit(f"({letters})"), F.lit(1))
    first = F.try_element_at(words, F.lit(1))
    two = F.position(F.concat_ws(" ", first, F.try_element_at(words, F.lit(2))), flat)
    opening = F.when(two > 0, two).when(F.char_length(first) >= 6, F.position(first, flat)).otherwise(0)
    starts = F.array_distinct(F.filter(F.array(opening, F.lit(1)), lambda s: s > 0))

    def passage(start: Column) -> Column:
        found = F.regexp_substr(F.substr(flat, start, F.char_length(flat)), F.lit(f"(?s)^.*?(?:{marker})"))
        own = F.array_join(F.regexp_extract_all(F.regexp_replace(found, f"(?:{marker})$", ""), F.lit(f"({letters})"), F.lit(1)), "")
        rest = F.btrim(F.concat(F.substr(flat, F.lit(1), start - 1), F.lit(" "), F.substr(flat, start + F.char_length(found), F.char_length(flat))))
        return F.struct(F.char_length(found).alias("size"), own.alias("letters"), rest.alias("rest"))

    whole = F.array_join(words, "")
    spans = F.filter(F.transform(starts, passage), lambda c: c["size"] <= PASSAGE)
    ratio = likenesses(F.transform(spans, lambda c: c["letters"]), whole)
    alike = F.filter(
        F.transform(F.arrays_zip(spans.alias("spans"), ratio.alias("ratio")), lambda z: F.struct(z["spans"].alias("span"), (F.char_length(z["spans"]["letters"]) / F.char_length(whole)).alias("length"), z["ratio"].alias("ratio"))),
        lambda z: (z["ratio"] >= ALIKE) & z["length"].between(SHORTER, LONGER) & (F.char_length(z["span"]["rest"]) >= LEFT),
    )
    return F.when(F.size(words) >= 4, F.coalesce(F.try_element_at(alike, F.lit(1))["span"]["rest"], text)).otherwise(text)


STEPS = ("exact", "form", "stem", "nasal", "no nukta", "cross-script", "book")


def cascade_candidates(words: DataFrame, suffixes: list[str], replacements: list[tuple[str, str]] = ()) -> DataFrame:
    """(word, step, place, kind, form): everything a word of (word, lang) is looked up by, in the order of ``STEPS``.

    ``kind`` says which index a form is looked up in: norm, form, skey or book.
    """
    norm = materialise(words.select("word", "lang").distinct().withColumn("norm", word_norm(F.col("word"), F.col("lang"))), "norms")
    norm = materialise(norm.withColumn("nasal", fold_nasal(F.col("norm"))).withColumn("plain", strip_nukta(F.col("norm"))).withColumn("skey", script_key(F.col("norm"))), "forms")

    def at(step: int, forms: Column, kinds: tuple[str, ...]) -> Column:
        return F.flatten(F.transform(forms, lambda f, i: F.array(*(F.struct(F.lit(step).alias("step"), i.alias("place"), F.lit(k).alias("kind"), f.alias("form")) for k in kinds))))

    back = F.translate(F.col("norm"), "ंংଂ", "ँঁଁ")
    steps = (
        at(1, F.array("norm"), ("norm",)),
        at(2, F.array("norm"), ("form",)),
        at(3, stems(F.col("norm"), suffixes, replacements), ("norm", "form")),
        at(4, F.array_distinct(F.array(F.col("nasal"), back)), ("norm",)),
        at(5, F.array("plain"), ("norm",)),
        at(6, F.array("skey"), ("skey",)),
        at(7, F.array("norm"), ("book",)),
    )
    return norm.select("word", F.explode(F.concat(*steps)).alias("c")).select("word", "c.*")


def full_cascade(words: DataFrame, entries: DataFrame, suffixes: list[str], replacements: list[tuple[str, str]] = ()) -> DataFrame:
    """(word, step, entry_id): entries of the first step that hits, of the first stem that does.  entries: (kind, form, entry_id)."""
    hits = cascade_candidates(words, suffixes, replacements).join(entries, ["kind", "form"]).select("word", "step", "place", "entry_id").distinct()
    first = F.min(F.struct("step", "place")).over(Window.partitionBy("word"))
    names = F.array(*map(F.lit, STEPS))
    return hits.withColumn("first", first).where("step = first.step and place = first.place").select("word", F.element_at(names, F.col("step")).alias("step"), "entry_id")
