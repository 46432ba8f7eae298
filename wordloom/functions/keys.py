"""Phonetic keys under which spellings of a word meet across scripts and transliterations."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions.normalize import is_indic, nfc_indic, to_devanagari

MIN_KEY = 3
NUKTA = "\u093c"
#: Devanagari consonants by the Roman letter they are merged to.
#: The nukta stands alone in decomposed text and counts among the letters of p.
CONSONANTS = {
    "k": "कख", "g": "गघ", "n": "ङञणनऩम", "c": "चछ", "j": "जझय", "t": "टठतथ",
    "d": "डढदध", "p": "पफ" + NUKTA, "b": "बभव", "r": "रऱ", "l": "लळ", "s": "शषस", "h": "ह",
}
#: Vowel signs and vowel letters by the Roman vowel they are merged to.
SIGNS = {"a": "ा", "i": "िी", "u": "ुू", "ri": "ृॄ", "e": "ेैॅ", "o": "ोौॉ"}
VOWELS = {"a": "अआ", "i": "इई", "u": "उऊ", "ri": "ऋॠ", "e": "एऐ", "o": "ओऔऑ"}
VIRAMA, ANUSVARA, CANDRABINDU = "्", "ं", "ँ"
#: What is merged in a Roman key, in this order.
ROMAN_MERGES = (("sh", "s"), ("ng", "n"), ("ny", "n"), ("w", "b"), ("v", "b"), ("y", "j"), ("z", "j"), ("q", "k"), ("x", "ks"), ("f", "p"), ("m", "n"), ("ai", "e"), ("au", "o"), ("ee", "i"), ("oo", "u"))


def _base_letters() -> tuple[str, str]:
    """Precomposed Latin letters and the letters below their marks, by the Unicode tables."""
    marked, plain = [], []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and parts[0].isascii():
            marked.append(chr(c))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _base_letters()


def _tidy(key: Column) -> Column:
    """Doubled letters once; a final a goes unless it is all there is."""
    return F.regexp_replace(F.regexp_replace(key, "(.)\\1+", "$1"), "(?<=.)a$", "")


def fold_roman(word: Column) -> Column:
    """a-z only: marks dropped, a dotted r or l as ri or li."""
    low = F.lower(word)
    low = F.regexp_replace(low, "ṝ|ṝ|ṝ|ṛ|ṛ", "ri")
    low = F.regexp_replace(low, "ḹ|ḷ|ḷ", "li")
    return F.regexp_replace(F.translate(low, _MARKED, _PLAIN), "[^a-z]", "")


def loose_roman(word: Column) -> Column:
    """Loose key of a word in Roman letters: aspirates, sibilants, nasals and vowel lengths merged."""
    key = F.regexp_replace(fold_roman(word), "(?<=[kgcjtdpb])h", "")
    for old, new in ROMAN_MERGES:
        key = F.replace(key, F.lit(old), F.lit(new))
    return _tidy(key)


def loose_indic(word: Column) -> Column:
    """Loose key of a word in an Indic script: the inherent a is written out, then letters are merged."""
    letters, signs = "".join(CONSONANTS.values()), "".join(SIGNS.values())
    text = F.translate(to_devanagari(nfc_indic(word)), CANDRABINDU, ANUSVARA)
    # A sign counts only behind a consonant.
    text = F.regexp_replace(text, f"(?<![{letters}])[{signs}{VIRAMA}]", "")
    text = F.regexp_replace(text, f"([{letters}])(?![{signs}{VIRAMA}])", "$1a")
    for table in (CONSONANTS, SIGNS, VOWELS):
        for roman, block in table.items():
            text = F.regexp_replace(text, f"[{block}]", roman)
    return _tidy(F.regexp_replace(F.replace(text, F.lit(ANUSVARA), F.lit("n")), "[^a-z]", ""))


def loose_key(word: Column) -> Column:
    """Loose key of a word in any of the scripts."""
    return F.when(is_indic(word), loose_indic(word)).otherwise(loose_roman(word))


def skeleton_roman(word: Column) -> Column:
    """Consonants only, nasals merged: a coarser key kept for comparison."""
    key = F.translate(F.regexp_replace(F.lower(word), "ṝ|ṛ", "r"), _MARKED, _PLAIN)
    key = F.regexp_replace(F.regexp_replace(key, "[^a-z]", ""), "(?<=[kgcjtdpb])h", "")
    for old, new in (("sh", "s"), ("ng", "n"), ("ny", "n"), ("ri", "r"), ("w", "b"), ("v", "b"), ("y", "j"), ("z", "j"), ("q", "k"), ("x", "ks"), ("m", "n")):
        key = F.replace(key, F.lit(old), F.lit(new))
    return F.regexp_replace(key, "[aeiouh]", "")


def skeleton_indic(word: Column) -> Column:
    """Consonants only of a word in an Indic script."""
    text = to_devanagari(nfc_indic(word))
    text = F.regexp_replace(F.regexp_replace(text, "[ंँ]", "n"), "[ऋॠृॄ]", "r")
    for roman, block in CONSONANTS.items():
        text = F.regexp_replace(text, f"[{block}]", roman)
    return F.regexp_replace(text, "[^a-z]", "")


def rule_b(key: Column) -> Column:
    """A stricter merge on top of a loose key (every h dropped, ks as s): tried and rejected, kept to compare."""
    return F.regexp_replace(F.replace(F.replace(key, F.lit("h"), F.lit("")), F.lit("ks"), F.lit("s")), "(.)\\1+", "$1")


def loose_sql(word: str) -> str:
    """``loose_roman`` in DuckDB SQL, for words without a dotted r or l."""
    sql = f"regexp_replace(strip_accents(lower({word})), '[^a-z]', '', 'g')"
    sql = f"regexp_replace({sql}, '([kgcjtdpb])h', '\\1', 'g')"
    for old, new in ROMAN_MERGES:
        sql = f"replace({sql}, '{old}', '{new}')"
    for letter in "abcdefghijklmnopqrstuvwxyz":
        sql = f"regexp_replace({sql}, '{letter}+', '{letter}', 'g')"
    return f"regexp_replace({sql}, '(.)a$', '\\1')"
