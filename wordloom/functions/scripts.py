"""Transliteration with more than one letter, readings, and places in a text that survive normalisation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.keys import _MARKED, _PLAIN, loose_roman
from wordloom.functions.normalize import digits_to, drop, from_devanagari, plain_roman, shift_block
from wordloom.functions.parse import snippet

#: Devanagari letters and their scholarly Roman spelling.
IAST_CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ṅ", "च": "c", "छ": "ch", "ज": "j", "झ": "jh", "ञ": "ñ", "ट": "ṭ", "ठ": "ṭh", "ड": "ḍ", "ढ": "ḍh", "ण": "ṇ", "त": "t", "थ": "th",
    "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "श": "ś", "ष": "ṣ", "स": "s", "ह": "h", "ळ": "ḷ",
}
IAST_VOWELS = {"अ": "a", "आ": "ā", "इ": "i", "ई": "ī", "उ": "u", "ऊ": "ū", "ऋ": "ṛ", "ॠ": "ṝ", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au"}
IAST_SIGNS = {"ा": "ā", "ि": "i", "ी": "ī", "ु": "u", "ू": "ū", "ृ": "ṛ", "ॄ": "ṝ", "े": "e", "ै": "ai", "ो": "o", "ौ": "au"}
IAST_MARKS = {"ं": "ṃ", "ँ": "ṃ", "ः": "ḥ", "ऽ": "'", "ॐ": "oṃ", "।": "|", "॥": "||"}
#: Abbreviations that are read out in full.
SPOKEN = (("\\bviz\\.", "namely"), ("\\bi\\.e\\.", "that is"), ("\\be\\.g\\.", "for example"), ("\\betc\\.", "and so on"))
#: How scholarly letters sound in everyday English spelling.
SOUNDS = {"ī": "ee", "Ī": "Ee", "ū": "oo", "Ū": "Oo", "ṛ": "ri", "Ṛ": "Ri", "ṝ": "ri", "ḷ": "li", "ś": "sh", "Ś": "Sh", "ṣ": "sh", "Ṣ": "Sh"}


def _spell(text: Column, table: dict[str, str]) -> Column:
    """Letters replaced by strings; those with one letter in one step."""
    single = {a: b for a, b in table.items() if len(b) == 1}
    text = F.translate(text, "".join(single), "".join(single.values()))
    for a, b in table.items():
        if len(b) > 1:
            text = F.replace(text, F.lit(a), F.lit(b))
    return text


def to_iast(text: Column) -> Column:
    """Devanagari in scholarly Roman letters; every inherent a is kept, dots below go."""
    text = drop(digits_to(text), "़")
    text = F.regexp_replace(text, f"([{''.join(IAST_CONSONANTS)}])(?![{''.join(IAST_SIGNS)}्])", "$1a")
    return drop(_spell(text, IAST_CONSONANTS | IAST_VOWELS | IAST_SIGNS | IAST_MARKS), "्")


def bengali_readings(word: Column, most: int = 3) -> Column:
    """Devanagari readings of a Bengali word, whose ba is ba or va; none with more than ``most`` of them."""

    def reading(ba: str) -> Column:
        return shift_block(F.replace(F.replace(word, F.lit("ৎ"), F.lit("त्")), F.lit("ব"), F.lit(ba)), 0x0980, -0x80)

    count = F.char_length(word) - F.char_length(F.replace(word, F.lit("ব"), F.lit("")))
    return F.when(count <= most, F.array_distinct(F.array(reading("ब"), reading("व")))).otherwise(F.array().cast("array<string>"))


#: Endings that the word for "said" leaves on a name, with the letters to take off and what to put there.
SPEAKER_ENDINGS = (("ो", 1, "ा"), ("ानु", 1, "्"), ("्यु", 3, "ी"), ("रु", 2, ""))


def speaker_stem(line: Column) -> Column:
    """The name in a Sanskrit speaker line ("X said"), with the joining of sounds undone; null for other lines."""
    text = F.replace(F.btrim(line), F.lit("ऊचु:"), F.lit("ऊचुः"))
    many = F.nullif(F.btrim(F.regexp_replace(text, "ऊचुः$", "")), F.lit(""))
    word = F.replace(F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(text, "वाच$", "")), " उ$", "")), F.lit(" "), F.lit(""))
    one = word
    for ending, n, instead in reversed(SPEAKER_ENDINGS):
        one = F.when(word.endswith(ending), F.concat(F.substr(word, F.lit(1), F.char_length(word) - n), F.lit(instead))).otherwise(one)
    one = F.nullif(one, F.lit(""))
    return F.when(text.endswith("ऊचुः"), many).when(text.endswith("वाच"), one)


#: Fixed values: "said" behind one name and behind several, by language.
SAID = {"en": (" said", " said"), "hi": (" ने कहा", " बोले"), "bn": (" বললেন", " বললেন"), "or": (" କହିଲେ", " କହିଲେ")}


def speaker_lines(lines: DataFrame, names: DataFrame, line: str = "line", lang: str = "lang") -> DataFrame:
    """Adds ``said``: a Sanskrit speaker line ("X said") as it is put in each row's language.

    ``names``: (stem, plural, lang, name), how well-known speakers are called;
    others keep their stem, in the script of the language, in English as a
    plain Roman name.  Other lines, and other languages, stay as printed.
    """
    plural = F.rtrim(line).rlike("ऊच(?:ुः|ु:)$")
    rows = lines.withColumns({"_stem": speaker_stem(F.col(line)), "_plural": plural})
    known = names.select(F.col("stem").alias("_stem"), F.col("plural").alias("_plural"), F.col("lang").alias(lang), F.col("name").alias("_name"))
    rows = rows.join(known, ["_stem", "_plural", lang], "left")
    roman = plain_roman(to_iast(F.col("_stem")))
    roman = F.concat(F.upper(F.substr(roman, F.lit(1), F.lit(1))), F.substr(roman, F.lit(2), F.char_length(roman)))
    own = F.when(F.col(lang) == "en", roman).when(F.col(lang) == "bn", from_devanagari(F.col("_stem"), "bn")).when(F.col(lang) == "or", from_devanagari(F.col("_stem"), "or")).otherwise(F.col("_stem"))
    verb = F.lit(None).cast("string")
    for name, (one, many) in SAID.items():
        verb = F.when(F.col(lang) == name, F.when(F.col("_plural"), many).otherwise(one)).otherwise(verb)
    said = F.when(F.col("_stem").isNotNull() & verb.isNotNull(), F.concat(F.coalesce("_name", own), verb)).otherwise(F.col(line))
    return rows.withColumn("said", said).select(*lines.columns, "said")


def speakable(text: Column) -> Column:
    """English as a voice should read it: abbreviations in full, brackets as pauses, marked letters as they sound."""
    text = F.regexp_replace(drop(text, "‌‍“”\"*†"), "\\s*[()\\[\\]]\\s*", ", ")
    for pattern, words in SPOKEN:
        text = F.regexp_replace(text, f"(?i){pattern}", words)
    text = _spell(text, SOUNDS)
    text = F.regexp_replace(F.translate(text, _MARKED, _PLAIN), "\\s+([,.;:!?])", "$1")
    return F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ",(\\s*,)+", ","), ",\\s*([.!?;:])", "$1"), "\\s+", " "), F.lit(" ,"))


def folded(text: Column) -> Column:
    """Small letters without marks, one for each letter of the text: a place in it is the same place in the text."""
    return F.translate(F.lower(text), _MARKED.lower(), _PLAIN.lower())


def find_hit(text: Column, terms: Column, keys: Column) -> Column:
    """(at, size, step) of the first hit: a term as it is (1), without marks (2), or a word with one of the loose keys (3); ``at`` is 1-based."""

    def first(where: Column, change, step: int) -> Column:
        found = F.transform(terms, lambda t: F.struct(F.position(change(t), where).alias("at"), F.char_length(t).alias("size"), F.lit(step).alias("step")))
        return F.try_element_at(F.filter(found, lambda h: (h["at"] > 0) & (h["size"] > 0)), F.lit(1))

    words = F.regexp_extract_all(text, F.lit("([^\\s\\p{P}]+)"), F.lit(1))
    sounding = F.try_element_at(F.filter(words, lambda w: F.array_contains(keys, loose_roman(w)) & (F.char_length(loose_roman(w)) >= 3)), F.lit(1))
    by_key = F.when(sounding.isNotNull(), F.struct(F.position(sounding, text).alias("at"), F.char_length(sounding).alias("size"), F.lit(3).alias("step")))
    return F.coalesce(first(F.lower(text), F.lower, 1), first(folded(text), folded, 2), by_key)


def hit_snippet(text: Column, terms: Column, keys: Column, around: int = 36) -> Column:
    """The text around the first hit; null without one."""
    hit = find_hit(text, terms, keys)
    return F.when(hit.isNotNull(), snippet(text, hit["at"], hit["size"], around))


def has_whole_word(text: Column, word: Column) -> Column:
    """Whether a word occurs with no letter or mark on either side, letter case aside."""
    return F.regexp_like(text, F.concat(F.lit("(?i)(?<![\\p{L}\\p{M}])\\Q"), word, F.lit("\\E(?![\\p{L}\\p{M}])")))


def word_ranges(text: Column, words: Column) -> Column:
    """(start, end) of every whole-word occurrence of the words, 0-based; a vowel sign or virama continues a word."""

    def places(w: Column) -> Column:
        size = F.char_length(w)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1))), lambda i: F.substr(text, i, size) == w)
        before = F.filter(starts, lambda i: (i == 1) | ~F.substr(text, i - 1, F.lit(1)).rlike("[\\p{L}\\p{Nd}्]"))
        kept = F.filter(before, lambda i: ~F.substr(text, i + size, F.lit(1)).rlike("[\\p{L}\\p{Nd}ा-्া-্]"))
        return F.transform(kept, lambda i: F.struct((i - 1).alias("start"), (i - 1 + size).alias("end")))

    return F.flatten(F.transform(F.filter(words, lambda w: w != ""), places))


def split_doubtful(text: Column) -> Column:
    """(text, ranges): the text without its ``[?]`` marks and where the marked words stand in it, 0-based."""
    pieces = F.split(text, "\\[\\?\\]", -1)
    heads = F.transform(F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.array_join(F.slice(pieces, F.lit(1), k), ""))
    ranges = F.transform(heads, lambda h: F.struct((F.char_length(h) - F.char_length(F.regexp_extract(h, "(\\S*)$", 1))).alias("start"), F.char_length(h).alias("end")))
    return F.struct(F.array_join(pieces, "").alias("text"), F.filter(ranges, lambda r: r["start"] < r["end"]).alias("ranges"))


def spoken_reference(text: Column, chapters: list[int]) -> Column:
    """(section, chapter) of a spoken request such as "book 10 chapter 29"; the chapter is held within the section's."""
    plain = digits_to(F.btrim(text))
    part = [F.nullif(F.regexp_extract(plain, "(\\d{1,9})\\D{1,24}?(\\d{1,9})", k), F.lit("")).cast("int") for k in (1, 2)]
    most = F.try_element_at(F.array(*map(F.lit, chapters)), part[0] + 1)
    return F.when(part[0].between(0, len(chapters) - 1), F.struct(part[0].alias("section"), F.greatest(F.lit(1), F.least(part[1], most)).alias("chapter")))


def segment_ending(text: Column, number: Column) -> Column:
    """What ends with the verse marker of that number; the text without its markers where no marker has it."""
    plain = digits_to(F.btrim(F.regexp_replace(text, "\\s+", " ")))
    mark = "[।॥]{1,2}\\s*[0-9]+\\s*[।॥]{1,2}"
    numbers = F.transform(F.regexp_extract_all(plain, F.lit("[।॥]{1,2}\\s*([0-9]{1,9})[0-9]*\\s*[।॥]{1,2}"), F.lit(1)), lambda n: n.cast("int"))
    at = F.array_position(numbers, number).cast("int")
    own = F.concat(F.btrim(F.try_element_at(F.split(plain, mark), F.greatest(at, F.lit(1)))), F.lit("।"))
    return F.when(at > 0, own).otherwise(F.btrim(F.regexp_replace(F.regexp_replace(plain, mark, " "), "\\s+", " ")))


def drop_heading(text: Column, verbs: tuple[str, ...], longest: int = 110) -> Column:
    """Without a boxed heading before the first unit: a short paragraph, or words before two blanks, that name no speaker before one that does."""
    verb = "|".join(verbs)
    parts = F.split(text, "\n\n", 2)
    boxed = (F.size(parts) > 1) & (F.char_length(parts[0]) <= longest) & ~parts[0].rlike(verb) & F.substr(F.try_element_at(parts, F.lit(2)), F.lit(1), F.lit(120)).rlike(verb)
    lead = F.regexp_extract(text, f"^(.{{3,70}}?)\\s{{2,}}(?=\\S+(?:\\s\\S+){{0,3}}\\s\\S*(?:{verb}))", 0)
    return F.when(boxed, F.try_element_at(parts, F.lit(2))).when((lead != "") & ~lead.rlike(verb), F.substr(text, F.char_length(lead) + 1, F.char_length(text))).otherwise(text)


def edit_neighbours(word: Column, alphabet: str) -> Column:
    """Every string one deletion, substitution, insertion or exchange of neighbours away."""
    letters = F.array(*map(F.lit, alphabet))
    size = F.char_length(word)
    inside = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))

    def head(i: Column) -> Column:
        return F.substr(word, F.lit(1), i - 1)

    def tail(i: Column) -> Column:
        return F.substr(word, i, size)

    cut = F.transform(inside, lambda i: F.concat(head(i), tail(i + 1)))
    changed = F.flatten(F.transform(inside, lambda i: F.transform(letters, lambda a: F.concat(head(i), a, tail(i + 1)))))
    longer = F.flatten(F.transform(F.sequence(F.lit(1), size + 1), lambda i: F.transform(letters, lambda a: F.concat(head(i), a, tail(i)))))
    turned = F.transform(F.filter(inside, lambda i: i < size), lambda i: F.concat(head(i), F.substr(word, i + 1, F.lit(1)), F.substr(word, i, F.lit(1)), tail(i + 2)))
    return F.array_remove(F.array_distinct(F.concat(cut, changed, longer, turned)), word)


#: What doesn't count when a title is compared, and what goes with a title that is taken off.
TITLE_NOISE, TITLE_TAIL = "\u200c\u200d \t\r\n-\u2010\u2011\u2012\u2013\u2014,.;:\u0964\u0965'\u2019\"()", "\u200c\u200d \t\r\n\\-\u2013\u2014"


def strip_title(text: Column, title: Column, least: int = 10, reach: int = 4, one_in: int = 12) -> Column:
    """Without a title that leaked into the start of the text; spacing, punctuation and a few letters may differ.

    The title's letters are compared with every start of the text that has up
    to ``reach`` letters more or fewer.  The nearest one goes, the shortest of
    equals, if at most one letter in ``one_in`` (or one) differs.  Titles of
    fewer than ``least`` letters are left alone.
    """
    want = drop(title, TITLE_NOISE)
    size = F.char_length(want)
    have = drop(F.substr(text, F.lit(1), 2 * F.char_length(title) + 40), TITLE_NOISE)
    lengths = F.filter(F.sequence(F.greatest(size - reach, F.lit(1)), size + reach), lambda j: j <= F.char_length(have))
    starts = F.transform(lengths, lambda j: F.struct(F.levenshtein(want, F.substr(have, F.lit(1), j)).alias("distance"), j.alias("letters")))
    best = F.array_min(starts)
    leaked = (size >= least) & (best["distance"] <= F.greatest(F.lit(1), F.floor(size / one_in)))
    noise = re.escape(TITLE_NOISE)
    lead = F.concat(F.lit(f"^(?:[{noise}]*[^{noise}]){{"), best["letters"].cast("string"), F.lit(f"}}[{TITLE_TAIL}]*"))
    return F.when(leaked, F.regexp_replace(text, lead, F.lit(""))).otherwise(text)
