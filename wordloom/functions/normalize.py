"""Unicode normalisation and script-neutral text forms.

Columns in, columns out.  Where Spark has no built-in (NFC and NFD), an
Arrow-batched pandas UDF does the work on whole batches.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

JOINERS = "‌‍"
INDIC = "[ऀ-ॿঀ-৿଀-୿]"
#: What is trimmed from the ends of a word.
TRIM = ".,;:!?\"'‘’“”()[]{}।॥-—–"
#: The first code point of each script's digits.
DIGIT_ZEROS = {"devanagari": 0x0966, "bengali": 0x09E6, "odia": 0x0B66, "ascii": 0x30}
_BLOCKS = {"deva": "[ऀ-ॿ]", "bn": "[ঀ-৿]", "or": "[଀-୿]"}


def _normal_form(form: str):
    @F.pandas_udf("string")
    def normalise(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return normalise


def drop(text: Column, chars: str) -> Column:
    """The text without any of the characters."""
    return F.translate(text, chars, "")


def nfc(text: Column) -> Column:
    """NFC without zero-width joiners."""
    return drop(_normal_form("NFC")(text), JOINERS)


def _compositions() -> tuple[list[tuple[str, str]], str, str]:
    """What NFC changes in the Devanagari, Bengali and Odia blocks by the Unicode tables: replacements, nuktas, viramas."""
    block = [chr(c) for c in range(0x900, 0xB80)]
    apart = [(c, unicodedata.normalize("NFC", c)) for c in block if unicodedata.normalize("NFC", c) != c]
    joined = [(unicodedata.normalize("NFD", c), c) for c in block if unicodedata.normalize("NFC", c) == c and len(unicodedata.normalize("NFD", c)) > 1]
    classes = {k: "".join(c for c in block if unicodedata.combining(c) == k) for k in (7, 9)}
    return [*apart, *joined], classes[7], classes[9]


def nfc_indic(text: Column) -> Column:
    """``nfc`` for text in the three scripts, as expressions: letters with a nukta apart, two-part vowels as one, a nukta before a virama."""
    replacements, nuktas, viramas = _compositions()
    apart = [r for r in replacements if len(r[0]) == 1]
    for old, new in apart:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(text, f"([{viramas}]+)([{nuktas}]+)", "$2$1")
    for old, new in replacements[len(apart) :]:
        text = F.replace(text, F.lit(old), F.lit(new))
    return drop(text, JOINERS)


def nfd(text: Column) -> Column:
    """Canonical decomposition."""
    return _normal_form("NFD")(text)


def shift_block(text: Column, start: int, offset: int) -> Column:
    """Moves the 128 code points from ``start`` on by ``offset``."""
    block = range(start, start + 0x80)
    return F.translate(text, "".join(map(chr, block)), "".join(chr(c + offset) for c in block))


def to_devanagari(text: Column) -> Column:
    """Bengali and Odia letters as the Devanagari letters at the same place of their block."""
    return shift_block(shift_block(text, 0x0980, -0x80), 0x0B00, -0x200)


def from_devanagari(text: Column, script: str) -> Column:
    """Devanagari letters in the Bengali or Odia block; two Bengali spellings follow the context rules of that script."""
    if script == "or":
        return shift_block(text, 0x0900, 0x200)
    shifted = shift_block(text, 0x0900, 0x80)
    # Bengali has no letter va: it is written ba; ya inside a word is the dotted form unless a virama stands before it.
    shifted = F.translate(shifted, "঵", "ব")
    return F.regexp_replace(shifted, "(?<=[ঀ-ৌ])(?<!্)য(?!়)", "য়")


def is_indic(text: Column) -> Column:
    """Whether a letter of one of the three scripts occurs."""
    return text.rlike(INDIC)


def exact_of(word: Column) -> Column:
    """NFC without joiners; lower case unless the word has an Indic letter."""
    normal = nfc(word)
    return F.when(is_indic(word), normal).otherwise(F.lower(normal))


def script_key(word: Column) -> Column:
    """One form for the spellings of a word in the three scripts."""
    return F.lower(to_devanagari(nfc(word)))


def word_norm(word: Column, lang: Column) -> Column:
    """Trimmed of quotes and punctuation, NFC; lower case for English and for words without an Indic letter."""
    trimmed = nfc(F.btrim(F.btrim(word), F.lit(TRIM)))
    return F.when((lang == "en") | ~is_indic(trimmed), F.lower(trimmed)).otherwise(trimmed)


def fold_nasal(word: Column) -> Column:
    """Chandrabindu as anusvara in each of the scripts."""
    return F.translate(nfc(word), "ँঁଁ", "ंংଂ")


def strip_nukta(word: Column) -> Column:
    """Without the dot below, composed anew."""
    return nfc(drop(nfd(word), "़়଼"))


def fold_key(word: Column) -> Column:
    """One key for a word's spellings: Devanagari, ba as va, dotted letters plain, no visarga or avagraha."""
    plain = strip_nukta(F.lower(to_devanagari(nfc(word))))
    return F.translate(plain, "बँःऽ", "वं")


def script_of(word: Column) -> Column:
    """deva, bn, or, else roman: the first script that occurs."""
    ladder = F.lit("roman")
    for name, block in reversed(_BLOCKS.items()):
        ladder = F.when(word.rlike(block), F.lit(name)).otherwise(ladder)
    return ladder


def digits_to(text: Column, script: str = "ascii") -> Column:
    """Digits of any of the scripts as those of one."""
    target = "".join(chr(DIGIT_ZEROS[script] + d) for d in range(10))
    for name, zero in DIGIT_ZEROS.items():
        if name != script:
            text = F.translate(text, "".join(chr(zero + d) for d in range(10)), target)
    return text


def plain_roman(text: Column) -> Column:
    """Scholarly Roman letters in everyday spelling, case kept."""
    for marked, plain in (("śṣ", "sh"), ("ŚṢ", "Sh"), ("ṛṝ", "ri"), ("Ṛ", "Ri")):
        text = F.regexp_replace(text, f"[{marked}]", plain)
    return F.translate(text, "āĀīĪūŪṭṬḍḌṇṅñṆṄṃṁḥḷḶ", "aAiIuUtTdDnnnNNmmhlL")


def tidy_dashes(text: Column) -> Column:
    """A dash between digits is a hyphen; one between spaces is long."""
    return F.regexp_replace(F.regexp_replace(text, "(?<=[0-9])\\s*[–—-]\\s*(?=[0-9])", "-"), "\\s+[-–—]\\s+", " — ")


def strip_doubt(text: Column) -> Column:
    """Without the ``[?]`` marks and the blanks they leave."""
    bare = F.regexp_replace(F.replace(text, F.lit("[?]"), F.lit("")), "[ \t]{2,}", " ")
    return F.when(text.contains("[?]"), F.regexp_replace(bare, " +([,.;:!?])", "$1")).otherwise(text)


def strip_colophon(text: Column, opening: str) -> Column:
    """Without a closing line that begins with ``opening`` (perhaps between stars)."""
    return F.when(text.contains(opening), F.rtrim(F.regexp_replace(text, f"\\s*\\*?{opening}[^*]*\\*?\\s*$", ""))).otherwise(text)


def strip_ordinal(title: Column, ordinals: list[str], nouns: list[str]) -> Column:
    """Without a leading "fifth chapter"; brackets around the whole go too."""
    inner = F.btrim(F.regexp_replace(F.btrim(title), "^[(\\[](.*)[)\\]]$", "$1"))
    return F.btrim(F.regexp_replace(inner, f"^(?:{'|'.join(ordinals)})\\s+(?:{'|'.join(nouns)})\\s*[-:.।]*\\s*", ""))


def join_wrapped(text: Column) -> Column:
    """Words cut by a hyphen at a line's end joined."""
    return F.replace(text, F.lit("-\n"), F.lit(""))


def clean_translation(text: Column) -> Column:
    """Wrapped lines joined, paragraphs kept, verse markers as sentence ends."""
    marked = F.regexp_replace(join_wrapped(text), "\\s*॥[0-9०-९\\s,-]*॥", ".")
    lines = F.regexp_replace(marked, "(?<!\\n)\\n(?!\\n)", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(lines, "[ \t]{2,}", " "), "\\n{3,}", "\n\n"))


def collapse_repeats(text: Column, most_words: int = 8) -> Column:
    """A phrase of up to eight words said three times or more is kept once."""
    return F.regexp_replace(text, f"\\b((?:\\S+\\s+){{0,{most_words - 1}}}\\S+)(?:\\s+\\1){{2,}}(?!\\S)", "$1")


def verse_tail(text: Column) -> Column:
    """The number at a verse's end written one way: ``॥ n ॥``."""
    return F.regexp_replace(text, "\\s*[।॥|]+\\s*([0-9०-९]+(?:\\s*-\\s*[0-9०-९]+)?)\\s*[।॥|]+\\s*$", " ॥ $1 ॥")


def title_cleanup(title: Column) -> Column:
    """Without bullets, leaders and trailing page numbers."""
    return F.btrim(F.regexp_replace(F.regexp_replace(title, "^[\\s•*·.\\-]+", ""), "[\\s.…·_-]*[0-9०-९୦-୯]*\\s*$", ""))
