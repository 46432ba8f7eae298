"""Scripts, keys and the lookup cascade over words in Indic letters that are made from the words of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import scripts
from wordloom.functions.keys import loose_key
from wordloom.functions.normalize import digits_to, nfc_indic, script_of, shift_block, to_devanagari
from wordloom.functions.tokens import hygiene, sanskrit_variants, words
from wordloom.operators import index, lookup, reading
from wordloom.plans.registry import query, table

#: One Devanagari letter for each Roman one: vowels as signs, consonants as letters.
LATIN, DEVA = "abcdefghijklmnopqrstuvwxyz", "ाबचदेफगहिजकलमनोपटरसतुवशषयझ"
#: What each of those letters is in scholarly Roman spelling and in a loose key.
ROMAN = dict(zip("बचदफगहजकलमनपटरसतवशषयझ", ("b", "c", "d", "ph", "g", "h", "j", "k", "l", "m", "n", "p", "ṭ", "r", "s", "t", "v", "ś", "ṣ", "y", "jh"), strict=True))
SIGNS = {"ा": "ā", "े": "e", "ि": "i", "ो": "o", "ु": "u"}
MERGED = dict(zip("बचदफगहजकलमनपटरसतवशषयझ", "bcdpghjklnnptrstbssjj", strict=True))


def _block(start: int) -> str:
    return "".join(map(chr, range(start, start + 0x80)))


def latin_words(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """(word): the different words of three letters and more in a-z alone, as small letters."""
    found = table(spark, sf_dir, name).select(F.explode(words(F.lower("text"))).alias("word"))
    return found.where(F.col("word").rlike("^[a-z]{3,}$")).distinct()


def deva(word: Column) -> Column:
    """A word in Devanagari letters."""
    return F.translate(word, LATIN, DEVA)


_WORDS = "SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[A-Za-zÀ-ɏḀ-ỿ]+')) AS word FROM {0}) WHERE regexp_matches(word, '^[a-z]{{3,}}$')"
LATIN_SQL = f"w AS ({_WORDS.format('documents')}), d AS (SELECT word, translate(word, '{LATIN}', '{DEVA}') AS x FROM w)"


def _replaced(text: str, table: dict[str, str]) -> str:
    for old, new in table.items():
        text = f"replace({text}, '{old}', '{new}')"
    return text


_IAST = _replaced(_replaced(_replaced("x", {c: r + "a" for c, r in ROMAN.items()}), {"a" + s: r for s, r in SIGNS.items()}), SIGNS)


@query("iast_spelling", f"WITH {LATIN_SQL} SELECT word, {_IAST} AS iast FROM d")
def iast_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devanagari words in scholarly Roman letters."""
    return latin_words(spark, sf_dir).select("word", scripts.to_iast(deva(F.col("word"))).alias("iast"))


_BARE = f"regexp_replace({_replaced(_replaced('x', {c: m + 'a' for c, m in MERGED.items()}), {'a' + s: r.upper() for s, r in (SIGNS | {'ा': 'a'}).items()})}, '[^A-Za-z]', '', 'g')"


@query(
    "indic_keys",
    f"""WITH {LATIN_SQL}, b AS (SELECT word, lower({_BARE}) AS k FROM d), c AS (SELECT word, i, k[i] AS letter, k[i - 1] AS before FROM b, unnest(range(1, length(k) + 1)) t(i)),
    s AS (SELECT word, string_agg(letter, '' ORDER BY i) AS k FROM c WHERE i = 1 OR letter <> before GROUP BY word)
    SELECT word, coalesce(regexp_replace(k, '(.)a$', '\\1'), '') AS key FROM d LEFT JOIN s USING (word)""",
)
def indic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose keys of words in Devanagari letters."""
    return latin_words(spark, sf_dir).select("word", loose_key(deva(F.col("word"))).alias("key"))


_BENGALI = f"translate(x, '{_block(0x900)}', '{_block(0x980)}')"
_BACK = f"translate(replace(b, 'ব', '{{0}}'), '{_block(0x980)}', '{_block(0x900)}')"


@query("bengali_readings", f"WITH {LATIN_SQL}, r AS (SELECT word, {_BENGALI} AS b FROM d) SELECT word, CASE WHEN length(b) - length(replace(b, 'ব', '')) > 3 THEN '' WHEN b NOT LIKE '%ব%' THEN {_BACK.format('ब')} ELSE {_BACK.format('ब')} || '|' || {_BACK.format('व')} END AS readings FROM r")
def bengali_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devanagari readings of words in Bengali letters."""
    found = latin_words(spark, sf_dir)
    return found.select("word", F.array_join(scripts.bengali_readings(shift_block(deva(F.col("word")), 0x900, 0x80)), "|").alias("readings"))


_ENDS = "[बचदफगहजकलमनपटसतवशषयझ]$"


@query(
    "speaker_stems",
    f"""WITH {LATIN_SQL}, n AS (SELECT word, x, length(word) % 7 AS k FROM d WHERE regexp_matches(x, '{_ENDS}'))
    SELECT word, CASE k WHEN 0 THEN x WHEN 1 THEN x || 'ा' WHEN 2 THEN x || 'ी' WHEN 3 THEN x WHEN 4 THEN x || 'ान्' WHEN 5 THEN x END AS stem FROM n""",
)
def speaker_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in speaker lines, the word for "said" joined to them in five ways, and lines that name nobody."""
    name = deva(F.col("word"))
    ends = (" उवाच", "ोवाच", "्युवाच", "रुवाच", "ानुवाच", " ऊचुः", " कथा")
    line = F.concat(name, F.element_at(F.array(*map(F.lit, ends)), (F.char_length("word") % 7 + 1).cast("int")))
    return latin_words(spark, sf_dir).where(name.rlike(_ENDS)).select("word", scripts.speaker_stem(line).alias("stem"))


_SHIFTED = f"CASE length(word) % 4 WHEN 0 THEN x WHEN 1 THEN {_BENGALI} || '১২' WHEN 2 THEN translate(x, '{_block(0x900)}', '{_block(0xB00)}') || '୩' ELSE word || '४' END"


@query(
    "script_shifts",
    f"""WITH {LATIN_SQL}, s AS (SELECT word, length(word) % 4 AS k, x FROM d)
    SELECT word, CASE k WHEN 0 THEN x WHEN 1 THEN x || '१२' WHEN 2 THEN x || '३' ELSE word || '४' END AS deva,
    CASE k WHEN 0 THEN x WHEN 1 THEN {_BENGALI} || '12' WHEN 2 THEN translate(x, '{_block(0x900)}', '{_block(0xB00)}') || '3' ELSE word || '4' END AS ascii,
    CASE k WHEN 0 THEN 'deva' WHEN 1 THEN 'bn' WHEN 2 THEN 'or' ELSE 'deva' END AS script FROM s""",
)
def script_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of three scripts at the same place of one block, digits as ASCII, and the script."""
    name, k = deva(F.col("word")), F.char_length("word") % 4
    said = F.when(k == 0, name).when(k == 1, F.concat(shift_block(name, 0x900, 0x80), F.lit("১২"))).when(k == 2, F.concat(shift_block(name, 0x900, 0x200), F.lit("୩"))).otherwise(F.concat("word", F.lit("४")))
    return latin_words(spark, sf_dir).select("word", to_devanagari(said).alias("deva"), digits_to(said).alias("ascii"), script_of(said).alias("script"))


_TERMS = "t AS (SELECT conv_id || '-' || turn AS query, terms[p] AS term, p - 1 AS position FROM (SELECT conv_id, turn, regexp_extract_all(trim(text), '[^\\s\"“”''‘’.,;:!?()]+')[:3] AS terms FROM conversations WHERE length(trim(text)) >= 2), unnest(range(1, len(terms) + 1)) u(p))"


def _alias_sql() -> str:
    from wordloom.plans.search import _GROUP_SQL, loose_sql

    return f"WITH {_TERMS}, {_GROUP_SQL}, q AS (SELECT query, position, {loose_sql('term')} AS key FROM t), e AS (SELECT query, position, key FROM q UNION SELECT q.query, q.position, g2.key FROM q JOIN g g1 ON q.key = g1.key JOIN g g2 ON g1.grp = g2.grp) SELECT query, position::INTEGER AS position, key FROM e"


@query("alias_expand", _alias_sql())
def alias_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that the first three words of every turn stand for, alias groups expanded."""
    from wordloom.functions.keys import loose_roman
    from wordloom.functions.tokens import query_terms
    from wordloom.plans.search import group_keys

    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("query"), F.posexplode(F.slice(query_terms(F.col("text")), 1, 3)).alias("position", "term"))
    return index.expand(turns.select("query", "position", loose_roman(F.col("term")).alias("key")), group_keys(spark))


SUFFIXES = ("s", "ed", "ing", "en")
_HOLDS = "length({0}) % 6"
#: What the dictionary holds, by a word's length: itself, an inflected form, a Devanagari key, or a word of the book.
_KINDS = (("norm", 0), ("form", 1), ("book", 3), ("skey", 4))


def _strips(word: str, keep: str) -> str:
    by_length = sorted(SUFFIXES, key=len, reverse=True)
    return " UNION ALL ".join(f"SELECT {keep}, left({word}, length({word}) - {len(s)}) AS f, {k} AS r FROM {{0}} WHERE length({word}) > {len(s) + 1} AND suffix({word}, '{s}')" for k, s in enumerate(by_length))


@query(
    "full_cascade",
    f"""WITH e AS (SELECT word AS form, min(doc_id) AS entry_id FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-zÀ-ɏḀ-ỿ]+')) AS word FROM documents) WHERE regexp_matches(word, '^[a-z]{{3,}}$') GROUP BY word),
    h AS ({" UNION ALL ".join(f"SELECT '{kind}' AS kind, {'translate(form, ' + repr(LATIN) + ', ' + repr(DEVA) + ')' if kind == 'skey' else 'form'} AS form, entry_id FROM e WHERE length(form) % 6 = {n}" for kind, n in _KINDS)}),
    q AS (SELECT word, CASE WHEN length(word) % 6 = 4 THEN translate(nfc_normalize(translate(translate(word, '{LATIN}', '{DEVA}'), '{_block(0x900)}', '{_block(0x980)}')), '{_block(0x980)}', '{_block(0x900)}') ELSE word END AS said FROM ({_WORDS.format('conversations')})),
    o AS ({_strips('word', 'word, said').format('(SELECT * FROM q WHERE said = word)')}),
    t AS (SELECT word, said, f, r * 100 AS place FROM o UNION ALL SELECT word, said, f, before * 100 + r + 1 FROM ({_strips('f0', 'word, said, before').format('(SELECT word, said, f AS f0, r AS before FROM o)')})),
    s AS (SELECT word, f, min(place) AS place FROM t GROUP BY word, f),
    c AS (SELECT word, 1 AS step, 0 AS place, 'norm' AS kind, said AS form FROM q UNION ALL SELECT word, 2, 0, 'form', said FROM q UNION ALL SELECT word, 3, place, 'norm', f FROM s UNION ALL SELECT word, 3, place, 'form', f FROM s
          UNION ALL SELECT word, 6, 0, 'skey', said FROM q UNION ALL SELECT word, 7, 0, 'book', said FROM q),
    j AS (SELECT c.*, entry_id FROM c JOIN h USING (kind, form))
    SELECT DISTINCT word, CASE step WHEN 1 THEN 'exact' WHEN 2 THEN 'form' WHEN 3 THEN 'stem' WHEN 6 THEN 'cross-script' ELSE 'book' END AS step, entry_id FROM j
    QUALIFY step * 100000 + place = min(step * 100000 + place) OVER (PARTITION BY word)""",
)
def full_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of conversations looked up in all steps of the cascade, in a dictionary of the documents' words."""
    known = table(spark, sf_dir, "documents").select("doc_id", F.explode(words(F.lower("text"))).alias("form")).where(F.col("form").rlike("^[a-z]{3,}$")).groupBy("form").agg(F.min("doc_id").alias("entry_id"))
    kind = F.element_at(F.create_map(*(F.lit(x) for k, n in _KINDS for x in (n, k))), F.char_length("form") % 6)
    entries = known.withColumn("kind", F.when((F.char_length("form") % 6).isin(*(n for _, n in _KINDS)), kind)).where("kind IS NOT NULL")
    entries = entries.withColumn("form", F.when(F.col("kind") == "skey", deva(F.col("form"))).otherwise(F.col("form")))
    indic = F.char_length("word") % 6 == 4
    asked = latin_words(spark, sf_dir, "conversations").select(F.when(indic, shift_block(deva(F.col("word")), 0x900, 0x80)).otherwise(F.col("word")).alias("word"), F.when(indic, "bn").otherwise("en").alias("lang"))
    found = reading.full_cascade(asked, entries.select("kind", "form", "entry_id"), list(SUFFIXES))
    return found.withColumn("word", F.translate(to_devanagari(F.col("word")), DEVA, LATIN))


@query(
    "inflected_bases",
    f"""WITH {LATIN_SQL}, v AS (SELECT word, x || CASE length(word) % 3 WHEN 0 THEN 'म्' WHEN 1 THEN 'त्' ELSE '' END AS said, length(word) % 3 AS k, x FROM d),
    e AS (SELECT CASE length(word) % 4 WHEN 0 THEN x || 'ं' WHEN 1 THEN x || 'द्' ELSE x END AS form FROM d)
    SELECT word, CASE WHEN said IN (SELECT form FROM e) THEN said WHEN k = 0 THEN x || 'ं' ELSE x || 'द्' END AS base FROM v
    WHERE said IN (SELECT form FROM e) OR (k = 0 AND x || 'ं' IN (SELECT form FROM e)) OR (k = 1 AND x || 'द्' IN (SELECT form FROM e))""",
)
def inflected_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inflected words and the spelling of each that is a headword: as it is, final m as anusvara, final t voiced."""
    name, n = deva(F.col("word")), F.char_length("word")
    said = latin_words(spark, sf_dir).select("word", F.concat(name, F.when(n % 3 == 0, "म्").when(n % 3 == 1, "त्").otherwise("")).alias("said"))
    forms = latin_words(spark, sf_dir).select(F.concat(name, F.when(n % 4 == 0, "ं").when(n % 4 == 1, "द्").otherwise("")).alias("form"))
    return lookup.base_pointers(said, sanskrit_variants(F.col("said")), forms)


_ODIA = "translate(word, 'aeioubcdfghjklmnpqrstvwxyz', 'ାେିୋୁବଚଦଫଗହଜକଲମନପଟରସତଵଶଷଯଝ')"


@query(
    "hygiene_codes",
    f"""WITH {LATIN_SQL}, o AS (SELECT word, {_ODIA} || CASE length(word) % 5 WHEN 0 THEN '୍' WHEN 1 THEN 'x' WHEN 2 THEN '୍ି' WHEN 3 THEN 'ଂ' || 'ା7' ELSE 'क' END AS y FROM w),
    c AS (SELECT word, unnest([CASE WHEN length(word) % 5 = 1 THEN 'latin' END, CASE WHEN length(word) % 5 = 4 THEN 'foreign_script' END, CASE WHEN length(word) % 5 = 3 THEN 'ascii_digit' END,
      CASE WHEN regexp_matches(word, '^[aeiou]') THEN 'starts_with_mark' END, CASE WHEN regexp_matches(word, '[aeiou][aeiou]') THEN 'double_vowel_sign' END, CASE WHEN length(word) % 5 = 2 THEN 'virama_then_sign' END,
      CASE WHEN length(word) % 5 = 3 THEN 'anusvara_then_sign' END, CASE WHEN length(word) % 5 = 0 THEN 'ends_with_virama' END]) AS code FROM o)
    SELECT code, count(*) AS words, min(word) AS first_word FROM c WHERE code IS NOT NULL GROUP BY code""",
)
def hygiene_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can't be right in words of Odia letters: how many words have each code."""
    n = F.char_length("word") % 5
    made = F.concat(F.translate("word", "aeioubcdfghjklmnpqrstvwxyz", "ାେିୋୁବଚଦଫଗହଜକଲମନପଟରସତଵଶଷଯଝ"), F.when(n == 0, "୍").when(n == 1, "x").when(n == 2, "୍ି").when(n == 3, "ଂା7").otherwise("क"))
    codes = latin_words(spark, sf_dir).select("word", F.explode(hygiene(made)).alias("code"))
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("words"), F.min("word").alias("first_word"))


@query("indic_forms", f"WITH {LATIN_SQL} SELECT word, nfc_normalize(x || 'क़' || '্' || 'ো' || 'ড' || '়') AS form FROM d")
def indic_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form of words that end in letters written in two ways."""
    return latin_words(spark, sf_dir).select("word", nfc_indic(F.concat(deva(F.col("word")), F.lit("क़্োড়"))).alias("form"))
