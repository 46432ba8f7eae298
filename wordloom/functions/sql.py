"""The library's functions for SQL texts.

Scalars and arrays are SQL functions whose bodies are the very expressions of
the DataFrame API, so they stay in the JVM.  Four table functions make rows in
Python; with ``explode`` the arrays do the same in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.keys import loose_key, loose_roman, rule_b, skeleton_roman
from wordloom.functions.normalize import nfc_indic, script_of, to_devanagari
from wordloom.functions.parse import wilson
from wordloom.functions.tokens import WORD, sentence_spans, words


@F.udtf(returnType="place int, word string")
class Tokens:
    """(place, word) of a text, by what counts as a word in the language; no rows for a null."""

    def eval(self, text: str, lang: str) -> Iterator[tuple[int, str]]:
        if text is None:
            return
        if lang == "or":
            text = re.sub(r"\S*\[\?\]", " ", text)
        yield from enumerate(re.findall(WORD.get(lang, WORD["iast"]), text.replace("।", " ").replace("॥", " ")))


@F.udtf(returnType="place int, start int, `end` int, sentence string")
class Sentences:
    """(place, start, end, sentence) of a text; no rows for a null."""

    def eval(self, text: str) -> Iterator[tuple[int, int, int, str]]:
        for place, (a, b) in enumerate(sentence_spans(text or "")):
            yield place, a, b, text[a:b]


@F.udtf(returnType="form string")
class EditKeys:
    """A word and every different form with one character left out."""

    def eval(self, word: str) -> Iterator[tuple[str]]:
        for form in dict.fromkeys([word, *(word[:k] + word[k + 1 :] for k in range(len(word)))] if word is not None else []):
            yield (form,)


@F.udtf(returnType="gram string")
class Grams:
    """The different character n-grams of a text, in the order they come."""

    def eval(self, text: str, n: int) -> Iterator[tuple[str]]:
        for gram in dict.fromkeys(text[k : k + n] for k in range(len(text) - n + 1)) if text is not None else ():
            yield (gram,)


def sql_of(spark: SparkSession, build: Callable[..., Column], arguments: dict[str, str]) -> str:
    """An expression of columns as SQL text; ``build`` gets the arguments (name to type) as columns.  Lambdas have no SQL form."""
    nothing = spark.range(0).select(*(F.lit(None).cast(t).alias(name) for name, t in arguments.items()))
    plan = nothing.select(build(*(F.col(name) for name in arguments)))._jdf.queryExecution().analyzed()
    return re.sub(r" AS `[^`]*`$", "", plan.expressions().head().child().sql()) if plan.expressions().head().nodeName() == "Alias" else plan.expressions().head().sql()


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def stems_sql(word: str, suffixes: list[str]) -> str:
    """``tokens.stems`` as SQL text, without replacements."""

    def strip(w: str) -> str:
        cases = (f"CASE WHEN char_length({w}) > {len(s) + 1} AND endswith({w}, {_literal(s)}) THEN substr({w}, 1, char_length({w}) - {len(s)}) END" for s in sorted(suffixes, key=len, reverse=True))
        return f"array_compact(array({', '.join(cases)}))"

    return f"array_distinct(flatten(transform({strip(word)}, w -> concat(array(w), {strip('w')}))))"


def _define(spark: SparkSession, name: str, arguments: dict[str, str], returns: str, body: str) -> None:
    given = ", ".join(f"{n} {t}" for n, t in arguments.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {returns} RETURN {body}")


def register_expressions(spark: SparkSession, suffixes: list[str] = ()) -> None:
    """Makes the scalar and array functions known to SQL; ``suffixes`` are the endings that ``stems`` strips."""
    word, text = {"word": "STRING"}, {"t": "STRING"}
    for name, build in (("loose_key", loose_key), ("loose_roman", loose_roman), ("skeleton_key", skeleton_roman), ("rule_b_key", rule_b), ("script_of", script_of), ("to_devanagari", to_devanagari)):
        _define(spark, name, word, "STRING", sql_of(spark, build, word))
    _define(spark, "nfc_indic", text, "STRING", sql_of(spark, nfc_indic, text))
    counts = {"hits": "BIGINT", "n": "BIGINT"}
    _define(spark, "wilson", counts, "STRUCT<low: DOUBLE, high: DOUBLE>", sql_of(spark, wilson, counts))
    _define(spark, "word_list", text, "ARRAY<STRING>", sql_of(spark, words, text))
    _define(spark, "stems", word, "ARRAY<STRING>", stems_sql("word", list(suffixes)) if suffixes else "CAST(array() AS ARRAY<STRING>)")
    _define(spark, "ngram_list", {"t": "STRING", "n": "INT"}, "ARRAY<STRING>", "array_distinct(transform(CASE WHEN char_length(t) >= n THEN sequence(1, char_length(t) - n + 1) ELSE CAST(array() AS ARRAY<INT>) END, i -> substr(t, i, n)))")
    _define(spark, "edit_forms", word, "ARRAY<STRING>", "array_distinct(concat(array(word), transform(sequence(1, greatest(char_length(word), 1)), i -> concat(substr(word, 1, i - 1), substr(word, i + 1)))))")


def register(spark: SparkSession) -> None:
    """Makes tokens, sentences, edit_keys and ngrams known to SQL."""
    for name, function in (("tokens", Tokens), ("sentences", Sentences), ("edit_keys", EditKeys), ("ngrams", Grams)):
        spark.udtf.register(name, function)
