"""Column functions on small tables of odd rows, against plain Python or values written by hand."""

from __future__ import annotations

import difflib
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from wordloom.functions import keys, normalize, parse, scripts, tokens


def column(spark, values, f, kind="string"):
    """f of a column of values, in order."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}").coalesce(1)
    return [r[0] for r in rows.sort("k").select(f(F.col("x")).alias("y")).collect()]


WORDS = ["कृष्ण", "কৃষ্ণ", "କୃଷ୍ଣ", "चाँद", "फ़ल", "ড়াম", "Kṛṣṇa", "É́tude", "a‌b‍c", "", None, "straße", "हिन्दी১২", "é", "दुःखऽ"]
NFC = [None if w is None else unicodedata.normalize("NFC", w.replace("‌", "").replace("‍", "")) for w in WORDS]


def shifted(word):
    return "".join(chr(ord(c) - 0x80) if 0x980 <= ord(c) < 0xA00 else chr(ord(c) - 0x200) if 0xB00 <= ord(c) < 0xB80 else c for c in word)


def indic(word):
    return any(0x900 <= ord(c) < 0xA00 or 0xB00 <= ord(c) < 0xB80 for c in word)


def plain_mark(word):
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", word) if c not in "़়଼"))


@pytest.mark.parametrize(
    ("function", "plain"),
    [
        (normalize.nfc, lambda w: w),
        (normalize.to_devanagari, shifted),
        (normalize.exact_of, lambda w: w if indic(w) else w.lower()),
        (normalize.script_key, lambda w: shifted(w).lower()),
        (normalize.fold_nasal, lambda w: w.translate(str.maketrans("ँঁଁ", "ंংଂ"))),
        (normalize.strip_nukta, plain_mark),
        (normalize.fold_key, lambda w: plain_mark(shifted(w).lower()).translate({ord("ब"): "व", ord("ँ"): "ं", ord("ः"): None, ord("ऽ"): None})),
    ],
)
def test_normal_forms(spark, function, plain):
    given = NFC if function is normalize.to_devanagari else WORDS
    assert column(spark, given, function) == [None if w is None else plain(w) for w in NFC]


def test_word_norm(spark):
    rows = spark.createDataFrame([("“Hello,”", "en"), ("वनम्।", "sa"), (" (Čaj) ", "hi"), ("...", "en"), (None, "en")], "w string, lang string")
    assert [r[0] for r in rows.select(normalize.word_norm(F.col("w"), F.col("lang"))).collect()] == ["hello", "वनम्", "čaj", "", None]


def test_from_devanagari(spark):
    found = column(spark, ["वनम्", "माया", "राम"], lambda c: normalize.from_devanagari(c, "bn"))
    assert [unicodedata.normalize("NFD", w) for w in found] == [unicodedata.normalize("NFD", w) for w in ("বনম্", "মায়া", "রাম")]
    assert column(spark, ["राम"], lambda c: normalize.from_devanagari(c, "or")) == ["ରାମ"]


@pytest.mark.parametrize(
    ("function", "given", "want"),
    [
        (normalize.plain_roman, ["Kṛṣṇa Śiva", "jñāna"], ["Krishna Shiva", "jnana"]),
        (normalize.tidy_dashes, ["3 – 5", "a - b", "x–y"], ["3-5", "a — b", "x–y"]),
        (normalize.strip_doubt, ["one[?] two [?] , three", "plain  text"], ["one two, three", "plain  text"]),
        (lambda c: normalize.strip_colophon(c, "Thus ends"), ["body\n*Thus ends the book*", "body"], ["body", "body"]),
        (lambda c: normalize.strip_ordinal(c, ["fifth"], ["chapter"]), ["(fifth chapter: Birth)", "Birth"], ["Birth", "Birth"]),
        (normalize.join_wrapped, ["con-\ntinued"], ["continued"]),
        (normalize.clean_translation, ["a\nb ॥ 3 ॥\n\n\n\nc"], ["a b.\n\nc"]),
        (normalize.collapse_repeats, ["go go go now", "go go now", "to be to be to be or"], ["go now", "go go now", "to be or"]),
        (normalize.verse_tail, ["text ।। 12 ।।", "text | 3 |", "text"], ["text ॥ 12 ॥", "text ॥ 3 ॥", "text"]),
        (normalize.title_cleanup, ["• The birth ..... 12", "The birth"], ["The birth", "The birth"]),
        (lambda c: normalize.digits_to(c, "bengali"), ["12 ३४ ୫"], ["১২ ৩৪ ৫"]),
        (scripts.speakable, ["e.g. (Kṛṣṇa) said , “go” etc.", "viz. this"], ["for example, Krishna, said, go and so on", "namely this"]),
        (lambda c: scripts.drop_heading(c, ("said",)), ["The title\n\nHe said this", "He said\n\nShe said", "A title  the sage said this"], ["He said this", "He said\n\nShe said", "the sage said this"]),
        (parse.strip_markup, ["<p>a&amp;b</p><script>x</script> c"], ["a&b c"]),
    ],
)
def test_text_forms(spark, function, given, want):
    assert column(spark, [*given, None], function) == [*want, None]


#: Pairs of spellings that one loose key must hold, and pairs that it must keep apart.
SAME = [("कृष्ण", "Krishna"), ("कृष्ण", "কৃষ্ণ"), ("कृष्ण", "କୃଷ୍ଣ"), ("राम", "rama"), ("शिव", "Śiva"), ("वन", "বন"), ("ज्ञान", "jñāna"), ("भक्ति", "bhakti"), ("योगी", "yogi"), ("वसुदेव", "Vasudeva"), ("धर्म", "ধর্ম"), ("ऋषि", "rishi"), ("नारायण", "Nārāyaṇa"), ("मोक्ष", "moksha"), ("विष्णु", "ବିଷ୍ଣୁ"), ("सीता", "seeta"), ("गौरी", "gauri"), ("कैलास", "kailasa"), ("संसार", "samsara")]
APART = [("राम", "कृष्ण"), ("वन", "मन्त्र"), ("सीता", "गीता"), ("देव", "दैत्य"), ("tara", "mara"), ("धर्म", "कर्म")]


def test_loose_keys_meet_across_scripts(spark):
    flat = [w for pair in SAME + APART for w in pair]
    found = dict(zip(flat, column(spark, flat, keys.loose_key), strict=True))
    assert [p for p in SAME if found[p[0]] != found[p[1]]] == []
    assert [p for p in APART if found[p[0]] == found[p[1]]] == []
    assert column(spark, ["", None, "123"], keys.loose_key) == ["", None, ""]


def test_skeletons(spark):
    assert column(spark, ["কৃষ্ণ", "कृष्ण", "राम"], keys.skeleton_indic) == ["krsn", "krsn", "rn"]



def test_rule_b_is_coarser(spark):
    assert column(spark, ["bhakta", "aksa", "hah"], keys.rule_b) == ["bakta", "asa", "a"]


def test_words_and_queries(spark):
    assert column(spark, ["राम। सीता॥ a", None], lambda c: tokens.words(c, "hi")) == [["राम", "सीता"], []]
    assert column(spark, ["ରାମ[?] ସୀତା"], lambda c: tokens.words(c, "or")) == [["ସୀତା"]]
    assert column(spark, ['say "two words" and “more”', None], tokens.query_phrases) == [["two words", "more"], []]
    assert column(spark, ["(राम,", "॥१॥", "", None], tokens.core) == ["राम", "१", "", None]
    assert column(spark, ["राम॥ १२ ॥ सीता ॥3 - 4॥", None], tokens.marked_tokens) == [["राम", "॥१२॥", "सीता", "॥3-4॥"], []]
    assert column(spark, ["रामं", "तत्"], tokens.sanskrit_variants) == [["रामं", "रामम्"], ["तत्", "तद्"]]
    assert column(spark, ["ରାକ୍ା", "aରାମ", "ରାମ", "ାକ"], tokens.hygiene) == [["virama_then_sign"], ["latin"], [], ["starts_with_mark"]]
    assert column(spark, ["ରାମ୍"], tokens.hygiene) == [["ends_with_virama"]] and column(spark, ["ରାମ୍"], tokens.severe) == [[]]
    assert column(spark, ["ािक", "राम", "xyz", "home"], tokens.broken) == [True, False, True, False]
    assert column(spark, ["walkings", "as", "ponies"], lambda c: tokens.stems(c, ["s", "ing"], [("ies", "y")])) == [["walking", "walk"], [], ["ponie", "pony"]]


def test_sentences(spark):
    found = column(spark, ["Dr. Rao came. He sat! Yes. “Go.” then e.g. this. End", "एक। दो॥", "", None], tokens.sentences)
    assert [s["text"] for s in found[0]][0].startswith("Dr. Rao came.")
    assert all(t[s["start"] : s["end"]] == s["text"] for t, ss in zip(["Dr. Rao came. He sat! Yes. “Go.” then e.g. this. End", "एक। दो॥", ""], found, strict=False) for s in ss)
    assert found[2] == [] and found[3] is None


def test_parsers(spark):
    assert [tuple(r) if r else None for r in column(spark, ["॥ ३-५ ॥", "॥ 7 ॥", "none"], parse.marker_range)] == [(3, 5), (7, 7), None]
    rows = spark.createDataFrame([("one two one two one", "one", 9), ("abc", "x", 1), (None, "a", 1)], "t string, q string, near int")
    assert [r[0] for r in rows.select(parse.nearest_occurrence(F.col("t"), F.col("q"), F.col("near"))).collect()] == [9, None, None]
    ids = [[1, 5, 5, 300, 70_000], []]
    blobs = column(spark, ids, parse.encode_posting, "array<long>")
    assert column(spark, blobs, parse.decode_posting, "binary") == [[1, 5, 300, 70_000], []]
    found = spark.createDataFrame([("x" * 50 + " hit " + "y" * 50, 52, 3)], "t string, at int, n int").select(parse.snippet(F.col("t"), F.col("at"), F.col("n"), 8)).first()[0]
    assert "hit" in found and found.startswith("…") and found.endswith("…")


def test_spans_at_a_place(spark):
    rows = spark.createDataFrame([("One two. Three four!  End", k) for k in (0, 3, 5, 10, 22, 24, 99)] + [(None, 0), ("", 0)], "t string, at int")
    words = [tuple(r[0]) if r[0] else None for r in rows.select(parse.span_at(F.col("t"), F.col("at"), "\\S+")).collect()]
    assert words == [(0, 3), None, (4, 8), (9, 14), (22, 25), (22, 25), None, None, None]
    sentence = [tuple(r[0]) if r[0] else None for r in rows.select(parse.span_at(F.col("t"), F.col("at"), "[^.!?।॥]+[.!?।॥]*")).collect()]
    assert sentence == [(0, 8), (0, 8), (0, 8), (9, 20), (22, 25), (22, 25), None, None, None]


def test_words_of_several_columns(spark):
    rows = spark.createDataFrame([("राम। सीता", "ରାମ[?] ସୀତା", None)], "hi string, odia string, en string")
    found = rows.select(tokens.words_of_columns({"hi": "hi", "odia": "or", "en": "en"})).first()[0]
    assert [tuple(r) for r in found] == [("hi", "राम"), ("hi", "सीता"), ("or", "ସୀତା")]


def test_snippet_cascade(spark):
    rows = spark.createDataFrame([("The Étude of Shiva", ["etude"]), ("nothing here", ["zzz"]), ("An étude by Śiva now", ["shiv"]), (None, ["a"]), ("The ÉTUDE", ["the"])], "t string, q array<string>")
    key = spark.range(1).select(keys.loose_roman(F.lit("Siva"))).first()[0]
    found = [tuple(r[0]) if r[0] else None for r in rows.select(scripts.find_hit(F.col("t"), F.col("q"), F.array(F.lit(key)))).collect()]
    assert found == [(5, 5, 2), None, (13, 4, 3), None, (1, 3, 1)]
    assert rows.select(scripts.hit_snippet(F.col("t"), F.col("q"), F.array(F.lit(key))).alias("s")).where("s is null").count() == 2


def test_word_ranges_respect_marks(spark):
    rows = spark.createDataFrame([("राम रामा राम, क्राम", ["राम"]), ("cat scat cat2 cat", ["cat", ""]), ("", ["a"]), (None, ["a"])], "t string, w array<string>")
    found = [[tuple(x) for x in r[0]] if r[0] is not None else None for r in rows.select(scripts.word_ranges(F.col("t"), F.col("w"))).collect()]
    assert found[:3] == [[(0, 3), (9, 12)], [(0, 3), (14, 17)], []] and not found[3]


def test_leaked_titles(spark):
    title = "मोहिनी रूपसे देवोंकी रक्षा"
    texts = [("मोहिनी-रूप से देवोंकी रक्षा — तब शुकदेव बोले", title), ("मोहिनीरूपसै देवोंकी रक्षा तब", title), ("तब शुकदेव बोले", title), ("short title", "short"), (None, title), ("text", None)]
    rows = spark.createDataFrame(texts, "t string, title string")
    assert [r[0] for r in rows.select(scripts.strip_title(F.col("t"), F.col("title"))).collect()] == ["तब शुकदेव बोले", "तब", "तब शुकदेव बोले", "short title", None, "text"]


def test_near_copies_against_all_pairs(spark):
    import random

    from wordloom.operators.similarity import near_copies

    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(50, 140))) for _ in range(12)]
    rows = []
    for k, b in enumerate(base):
        for v in range(5):
            t = list(b)
            for _ in range(rng.randrange(14)):
                at = rng.randrange(len(t))
                t[at] = rng.choice(["", "x", "ab"[v % 2]])
            rows.append((len(rows), f"g{k % 2}", "".join(t) if v else b))
    spread = list("abcdefghij" * 12)
    for k in range(11, 120, 12):
        spread[k] = "z"
    rows += [(len(rows), "g0", "abcdefghij" * 12), (len(rows) + 1, "g0", "".join(spread)), (len(rows) + 2, "g0", "abcdefghij" * 12), (len(rows) + 3, "g1", None)]
    want = set()
    for i, g, t in rows:
        for j, h, u in rows:
            if i < j and g == h and t and u and len(t) >= 60 and len(u) >= 60:
                m = difflib.SequenceMatcher(None, t[:120], u[:120])
                if m.quick_ratio() > 0.9 and m.ratio() > 0.85:
                    want.add((g, i, j))
    heads = {i: (g, (t or "")[:120]) for i, g, t in rows}
    first = {}
    for i in sorted(heads):
        first.setdefault(heads[i], i)
    found = near_copies(spark.createDataFrame(rows, "id long, grp string, text string"), "grp", "id").collect()
    pairs = {(r["grp"], r["a"], r["b"]) for r in found}
    # Pairs between the first members of their classes, and each further member with its first.
    assert pairs == {(g, i, j) for g, i, j in want if (first[heads[i]] == i and first[heads[j]] == j) or (heads[i] == heads[j] and first[heads[i]] == i)}
    assert len(want) > 40 and {(r["a"], r["b"]): r["ratio"] for r in found}[60, 62] == 1.0


def test_spans_of_a_voice(spark):
    hindi = "श्रीसूतजी कहते हैं - एक वाक्य। " + "शब्द, " * 40 + "अन्त।"
    rows = spark.createDataFrame([(hindi, "hi"), ("Suta says: one. Two three four five.", "en"), ("रामः। ok", "sa"), (None, "hi"), ("", "en"), ("x: a - b", "hi")], "t string, lang string")
    found = [r[0] for r in rows.select(tokens.spoken_spans("t", "lang")).collect()]
    first = found[0]
    assert [hindi[s["start"] : s["end"]] for s in first] == [s["text"] for s in first] and first[0]["text"] == "श्रीसूतजी कहते हैं -"
    assert max(len(s["text"]) for s in first) <= tokens.OTHER_SPAN and [s["pause_ms"] for s in first][:2] == [tokens.PAUSES["intro"], tokens.PAUSES["sentence"]]
    assert first[2]["pause_ms"] == tokens.PAUSES["clause"] and first[-1]["pause_ms"] == tokens.PAUSES["end"]
    assert "".join(s["text"] for s in first).replace(" ", "") == hindi.replace(" ", "")
    assert [(s["text"], s["pause_ms"]) for s in found[1]] == [("Suta says: one.", 900), ("Two three four five.", 1500)]
    assert [s["text"] for s in found[2]] == ["रामः। ok"] and found[3] is None and found[4] == []
    assert [s["text"] for s in found[5]] == ["x: a - b"]


def test_speaker_lines(spark):
    names = spark.createDataFrame([("मैत्रेय", False, "hi", "श्रीमैत्रेयजी"), ("ऋषय", True, "en", "The sages")], "stem string, plural boolean, lang string, name string")
    given = [("मैत्रेय उवाच", "hi"), ("मैत्रेय उवाच", "en"), ("राजोवाच", "en"), ("ऋषय ऊचुः", "en"), ("ऋषय ऊचु:", "hi"), ("राजोवाच", "or"), ("अथ कथा", "en"), ("राजोवाच", "fr"), (None, "en")]
    found = {(r["line"], r["lang"]): r["said"] for r in scripts.speaker_lines(spark.createDataFrame(given, "line string, lang string"), names).collect()}
    assert found == {("मैत्रेय उवाच", "hi"): "श्रीमैत्रेयजी ने कहा", ("मैत्रेय उवाच", "en"): "Maitreya said", ("राजोवाच", "en"): "Raja said", ("ऋषय ऊचुः", "en"): "The sages said", ("ऋषय ऊचु:", "hi"): "ऋषय बोले", ("राजोवाच", "or"): "ରାଜା କହିଲେ", ("अथ कथा", "en"): "अथ कथा", ("राजोवाच", "fr"): "राजोवाच", (None, "en"): None}


def test_near_copies_write_no_pairs(spark):
    from wordloom.operators.similarity import near_copies

    def head(k):
        return f"{k:03d} " + "".join("abcdefghijklmnop "[(k * i * i + 7 * i) % 17] for i in range(116))

    rows = spark.createDataFrame([(k, "g", head(k // 2) + ("x" if k % 2 else "")) for k in range(240)] + [(900, "g", head(0)[:119] + "é")], "id long, grp string, text string")
    results = [sorted(map(tuple, near_copies(rows, "grp", "id", block=block).collect())) for block in (16, 100, 1000)]
    assert results[0] == results[1] == results[2] and (0, 900) in {r[1:3] for r in results[0]}
    plan = near_copies(rows, "grp", "id", block=16)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "FlatMapGroupsInArrow" in plan


def test_bounds_of_near_copies_lose_none_and_are_quick():
    import random

    from wordloom.operators.similarity import Heads, match_ratio

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghijklmnop  ") for _ in range(rng.choice([60, 97, 120, 120, 120]))) for _ in range(6000)]
    for k in range(0, 1200, 2):
        t = list(texts[k])
        for _ in range(rng.randrange(22)):
            t[rng.randrange(len(t))] = rng.choice(["", "z", "ab", "é"])
        texts[k + 1] = "".join(t)[:120]
    began = time.monotonic()
    heads = Heads(texts, 120)
    found = {(int(x), int(y)) for xs, ys in heads.alike(heads, 0.9, 0.85) for x, y in zip(xs, ys, strict=True)}
    assert time.monotonic() - began < 15  # a text took some milliseconds, whatever was left of the pairs
    want = {(k, k + 1) for k in range(0, 1200, 2) if match_ratio(texts[k], texts[k + 1], 0.9) > 0.85}
    assert want <= found and 200 < len(want) < 600 and len(found) < 1200
    left, right = Heads(texts[:1200:2], 120), Heads(texts[1:1200:2], 120)
    assert {(x // 2, y // 2) for x, y in want} <= {(int(x), int(y)) for xs, ys in left.alike(right, 0.9, 0.85, batch=50) for x, y in zip(xs, ys, strict=True)}
    long = [t * 3 for t in texts[:40]]
    wide = Heads(long, 360)
    assert {(int(x), int(y)) for xs, ys in wide.alike(wide, 0.9, 0.85) for x, y in zip(xs, ys, strict=True)} >= {(x, y) for x in range(40) for y in range(x + 1, 40) if match_ratio(long[x], long[y], 0.9) > 0.85}


def test_snippet_that_ends_in_a_line_break(spark):
    rows = spark.createDataFrame([("ab hit cd\nyyyyyyyyyyyy", 4), ("ab hit c d yyyyyyyyyyyy", 4)], "t string, at int")
    assert [r[0] for r in rows.select(parse.snippet(F.col("t"), F.col("at"), F.lit(3), 4)).collect()] == ["ab hit cd…", "ab hit c…"]


def test_nearest_occurrence_in_a_long_text(spark):
    long = "x" * 300_000 + "los" + "x" * 300_000
    rows = spark.createDataFrame([(long, "los", 5), ("aaaa", "aa", 3), ("a.b a.b", "a.b", 1), ("q\\Eq", "\\E", 1), ("los los", "los", 3), ("", "a", 1), ("é😀lo los", "los", 9)], "t string, q string, near int")
    began = time.monotonic()
    assert [r[0] for r in rows.select(parse.nearest_occurrence(F.col("t"), F.col("q"), F.col("near"))).collect()] == [300_001, 3, 1, 2, 1, None, 6]
    assert time.monotonic() - began < 60  # it grew with the square of a text's length


def test_dandas_part_words_without_a_step_of_their_own(spark):
    for lang in tokens.WORD:
        rows = spark.createDataFrame([("राम।सीता ab॥cd",)], "t string").select(tokens.words(F.col("t"), lang).alias("w"))
        assert not any("।" in w or "॥" in w for w in rows.first()["w"])
        assert ("translate(" in rows._jdf.queryExecution().analyzed().toString()) == (lang in ("hi", "sa"))
