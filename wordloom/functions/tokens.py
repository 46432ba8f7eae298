"""Words, grams, stems and other row-generating forms, as array columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a word in each language.
WORD = {
    "hi": "[ऀ-ॿ]+", "sa": "[ऀ-ॿ]+", "bn": "[ঀ-৿]+", "or": "[଀-୿]+",
    "en": "[A-Za-zÀ-ɏḀ-ỿ'’]+", "iast": "[A-Za-zÀ-ɏḀ-ỿ]+",
}
#: What separates the words of a query.
QUERY_TERM = "[^\\s\"“”'‘’.,;:!?()]+"
#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = ("viz", "i.e", "e.g", "etc", "vs", "cf", "no", "st", "mr", "mrs", "dr", "lit", "approx")
#: What is stripped from the ends of a token.
PUNCTUATION = ".,;:!?\"'‘’“”()[]{}।॥-—–"


def words(text: Column, lang: str = "iast") -> Column:
    """Array of the words of a text; dandas separate words, words marked ``[?]`` go in Odia.

    Dandas are letters of the Devanagari block alone, so only there they are put out of the way first.
    """
    text = F.coalesce(text, F.lit(""))
    if lang == "or":
        text = F.regexp_replace(text, "\\S*\\[\\?\\]", " ")
    if lang in ("hi", "sa"):
        text = F.translate(text, "।॥", "  ")
    return F.regexp_extract_all(text, F.lit(WORD[lang]), F.lit(0))


def words_of_columns(columns: dict[str, str]) -> Column:
    """Array of (lang, word) over several text columns; ``columns`` maps each to the language it is cut by."""

    def part(column: str, lang: str) -> Column:
        return F.transform(words(F.col(column), lang), lambda w: F.struct(F.lit(lang).alias("lang"), w.alias("word")))

    return F.concat(*(part(c, lang) for c, lang in columns.items()))


def query_terms(query: Column) -> Column:
    """Words of a query; a query under two characters has none."""
    trimmed = F.btrim(query)
    return F.when(F.char_length(trimmed) >= 2, F.regexp_extract_all(trimmed, F.lit(f"({QUERY_TERM})"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def query_phrases(query: Column) -> Column:
    """What stands between double quotes."""
    return F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit("[\"“”]([^\"“”]+)[\"“”]"), F.lit(1))


def core(token: Column) -> Column:
    """A token without punctuation at its ends."""
    return F.btrim(token, F.lit(PUNCTUATION))


def marked_tokens(text: Column) -> Column:
    """Blank-separated tokens; a verse marker is one token of its own."""
    text = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))
    text = F.regexp_replace(text, "([^\\s॥])(?=॥)", "$1 ")
    text = F.regexp_replace(text, "॥\\s*([୦-୯०-९0-9]+)\\s*(?:([,-])\\s*([୦-୯०-९0-9]+)\\s*)?॥", "॥$1$2$3॥")
    return F.filter(F.split(text, " "), lambda t: t != "")


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams."""
    starts = F.when(F.char_length(text) >= n, F.sequence(F.lit(1), F.char_length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))


def edit_keys(word: Column) -> Column:
    """The word and every form with one character left out: words one edit apart share one of these."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(word), F.lit(1))), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, F.char_length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def stems(word: Column, suffixes: list[str], replacements: list[tuple[str, str]] = ()) -> Column:
    """Known endings stripped up to two deep, longest first, then endings put back to a dictionary form; in order, distinct.

    An ending is stripped where at least two characters are left.
    """

    def strip(w: Column) -> list[Column]:
        return [F.when((F.char_length(w) > len(s) + 1) & w.endswith(s), F.substr(w, F.lit(1), F.char_length(w) - len(s))) for s in sorted(suffixes, key=len, reverse=True)]

    once = F.array_compact(F.array(*strip(word)))
    twice = F.flatten(F.transform(once, lambda w: F.concat(F.array(w), F.array_compact(F.array(*strip(w))))))
    back = F.array_compact(F.array(*(F.when((F.char_length(word) > len(e) + 1) & word.endswith(e), F.concat(F.substr(word, F.lit(1), F.char_length(word) - len(e)), F.lit(r))) for e, r in replacements))) if replacements else F.array().cast("array<string>")
    return F.array_distinct(F.concat(twice, back))


def sanskrit_variants(word: Column) -> Column:
    """Spellings of an inflected word in order of trust: itself, final m as anusvara and back, final stops voiced."""
    forms = [word]
    for end, other in (("म्", "ं"), ("ं", "म्"), ("त्", "द्"), ("क्", "ग्"), ("द्", "त्")):
        forms.append(F.when(word.endswith(end), F.concat(F.substr(word, F.lit(1), F.char_length(word) - len(end)), F.lit(other))))
    return F.array_distinct(F.array_compact(F.array(*forms)))


def hygiene(token: Column) -> Column:
    """Codes of what cannot be right in an Odia word."""
    w = F.translate(core(token), "।॥", "")
    # The codes and what each is.
    sign, virama = "[ା-ୌୖୗୢୣ]", "୍"
    odia = w.rlike("[଀-୿]")
    codes = (
        ("latin", w.rlike("[A-Za-z]")),
        ("foreign_script", w.rlike("[ऀ-ॣ०-ॿঀ-৿]")),
        ("ascii_digit", w.rlike("[0-9]")),
        ("starts_with_mark", odia & w.rlike("^[ଂଃ଼ା-୍ୖୗୢୣ]")),
        ("double_vowel_sign", odia & w.rlike(sign + sign)),
        ("virama_then_sign", odia & w.rlike(f"{virama}{sign}|{virama}{virama}")),
        ("anusvara_then_sign", odia & w.rlike(f"[ଂଃ]{sign}")),
        ("ends_with_virama", odia & w.endswith(virama)),
    )
    return F.array_compact(F.array(*(F.when(test, F.lit(code)) for code, test in codes)))


def severe(token: Column) -> Column:
    """The codes that send a word to review."""
    return F.array_remove(hygiene(token), "ends_with_virama")


def broken(word: Column) -> Column:
    """A string that no reader would write."""
    indic = word.rlike("[ऀ-ॿঀ-৿଀-୿]")
    start = word.rlike("^[ा-्ँ-ःা-্ঁ-ঃା-୍ଁ-ଃ]")
    inside = word.rlike("[ा-ौা-ৌା-ୌ]{2}|[्্୍][ा-ौা-ৌା-ୌ]")
    return F.when(indic, start | inside).otherwise((F.char_length(word) < 3) | ~word.rlike("[aeiouāīū]"))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))


#: Longest span of a voice in English and in other languages; pauses in milliseconds behind a lead-in, a clause, a sentence and the last sentence.
LONGEST_SPAN = {"en": 380}
OTHER_SPAN = 150
PAUSES = {"intro": 700, "clause": 450, "sentence": 900, "end": 1500}
#: What a lead-in says, by language; others are read as Hindi.
SAYING = {
    "hi": ("कहते हैं", "कहती हैं", "ने कहा", "कहा", "बोले", "बोलीं", "बोली", "पूछा", "पूछते हैं", "उवाच"),
    "bn": ("বললেন", "বলেন", "বলছেন", "জিজ্ঞাসা", "প্রশ্ন", "উত্তর", "বলিলেন"),
}


def lead_in(text: str, lang: str) -> int:
    """Where a spoken line's lead-in ends ("X said -"): 0 without one, and in English, which keeps it with its sentence."""
    found = None if lang == "en" else re.match("([^:.!?।॥]{0,79}?)(?::|(?<=[ \u00a0])[-–—](?= ))(?=.)", text, re.DOTALL)
    return found.end() if found and any(w in found[1].lower() for w in SAYING.get(lang, SAYING["hi"])) else 0


def _clauses(text: str, a: int, b: int, longest: int, part: int) -> list[tuple[int, int]]:
    """A span cut near its middle, at a clause or else at a blank, until no piece is too long."""
    inside = range(a + part, b - part)
    for pattern in ("[,;:](?=\\s)|(?<=[ \u00a0])-(?= )", " "):
        breaks = [a + m.end() for m in re.finditer(pattern, text[a:b]) if a + m.start() in inside]
        if b - a > longest and breaks:
            cut = min(breaks, key=lambda k: (abs(k - (a + b) // 2), k))
            left, right = text[a:cut], text[cut:b]
            return _clauses(text, a, a + len(left.rstrip()), longest, part) + _clauses(text, b - len(right.lstrip()), b, longest, part)
    return [(a, b)]


def voice_spans(text: str, lang: str = "en", tiny: int = 10, part: int = 35) -> list[tuple[int, int, int]]:
    """(start, end, pause behind it) of what a voice says at once: lead-in, sentences, and clauses of long ones."""
    begin = lead_in(text, lang)
    cuts, at = [], begin
    for m in re.finditer("[.!?।॥…]+[\"'”’)\\]»]*(?=\\s|$)", text):
        if m.start() < begin:
            continue
        if text[m.start()] == ".":
            word = re.search("[^\\W\\d_.]?[\\w.]*$", text[: m.start()]).group()
            short = word.lower() in ABBREVIATIONS or (len(word) == 1 and word.isupper())
            if short or (lang == "en" and re.match("\\s*[a-zß-öø-ÿ]", text[m.end() :])):
                continue
        cuts.append((at, m.end()))
        at = m.end()
    spans: list[tuple[int, int]] = []
    for a, b in [*cuts, (at, len(text))]:
        b = a + len(text[a:b].rstrip())
        a += len(text[a:b]) - len(text[a:b].lstrip())
        if b <= a:
            continue
        if spans and b - a < tiny:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    out = [(len(text[:begin]) - len(text[:begin].lstrip()), len(text[:begin].rstrip()), PAUSES["intro"])] if begin else []
    for a, b in spans:
        pieces = _clauses(text, a, b, LONGEST_SPAN.get(lang, OTHER_SPAN), part)
        out += [(x, y, PAUSES["clause"]) for x, y in pieces[:-1]] + [(*pieces[-1], PAUSES["sentence"])]
    return out[:-1] + [(*out[-1][:2], PAUSES["end"])] if out else []


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence of an English text."""
    return [(a, b) for a, b, _ in voice_spans(text)]


_VOICE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pause_ms", T.IntegerType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(_VOICE)
def spoken_spans(texts: pd.Series, langs: pd.Series) -> pd.Series:
    """What a voice says at once, with its place and the pause behind it; null for a null text."""
    return pd.Series([[{"start": a, "end": b, "pause_ms": p, "text": t[a:b]} for a, b, p in voice_spans(t, lang or "en")] if t is not None else None for t, lang in zip(texts, langs, strict=True)])


@F.pandas_udf(_SPANS)
def sentences(texts: pd.Series) -> pd.Series:
    """Sentences of a text with their places.

    A stop after an abbreviation or before a small letter ends nothing,
    fragments join the sentence before, long sentences are split near the
    middle at a clause or a blank.
    """
    return texts.map(lambda t: [{"start": a, "end": b, "text": t[a:b]} for a, b in sentence_spans(t)], na_action="ignore")
