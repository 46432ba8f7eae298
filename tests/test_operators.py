"""Operators, readers, writers and streams on small tables, against values written by hand."""

from __future__ import annotations

import time
import difflib
import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from wordloom.operators import alignment, assemble, consensus, intervals, lookup, patches, quality, reading, review, sampling, sequence
from wordloom.sources import markdown, pages, shared, tables, wiki
from wordloom.streaming import state, windows


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_words_align_by_meeting_often(spark):
    texts = [("the house is red", "ghar laal hai"), ("the house is big", "ghar bada hai"), ("red book", "laal kitab"), ("big book", "bada kitab"), ("the book", "kitab")] * 3
    rows = spark.createDataFrame([(k, a.split(), b.split()) for k, (a, b) in enumerate(texts)], "pair int, source array<string>, target array<string>")
    found = alignment.ibm_model1(rows)
    best = {s: max((n, t) for x, t, n in rows_of(found, "s", "t", "times") if x == s)[1] for s in ("house", "book", "red", "big")}
    assert best == {"house": "ghar", "book": "kitab", "red": "laal", "big": "bada"}
    chosen = rows_of(alignment.pick_translations(found), "s", "t")
    assert ("book", "kitab") in chosen


def test_likeness_by_common_start(spark):
    pairs = spark.createDataFrame([("krishnas", "krishnaji"), ("go", "go"), ("go", "gi"), ("abcd", "abxy")], "s string, t string")
    found = {(s, t): round(x, 3) for s, t, x in rows_of(alignment.word_likeness(pairs), "s", "t", "likeness")}
    assert found[("go", "go")] == 1.0 and found[("go", "gi")] == 0.0 and found[("abcd", "abxy")] == 0.0 and found[("krishnas", "krishnaji")] > 0.6


def test_compounds(spark):
    lexicon = spark.createDataFrame([(w,) for w in ("नमः", "शिवाय", "विशुद्ध", "अनुभव", "च", "अपि", "तथा", "एव", "सः", "तत्", "श्रुत्वा", "राम", "कथा", "foot", "ball", "football", "game", "में")], "word string")
    words = spark.createDataFrame([(w,) for w in ("नमस्शिवाय", "विशुद्धानुभव", "चापि", "तथैव", "सोऽपि", "तच्छ्रुत्वा", "footballgame", "राम", "xyz", "", "z" * 300 + "footballgame", None)], "word string")
    found = {r["word"]: list(r["parts"]) for r in alignment.compound_split(words, lexicon, joins=alignment.SANSKRIT).collect()}
    assert found == {"नमस्शिवाय": ["नमः", "शिवाय"], "विशुद्धानुभव": ["विशुद्ध", "अनुभव"], "चापि": ["च", "अपि"], "तथैव": ["तथा", "एव"], "सोऽपि": ["सः", "अपि"], "तच्छ्रुत्वा": ["तत्", "श्रुत्वा"], "footballgame": ["football", "game"]}
    ended = alignment.compound_split(spark.createDataFrame([("footballgameमें",)], "word string"), lexicon, endings=("में",)).first()
    assert list(ended["parts"]) == ["football", "gameमें"]


@pytest.mark.parametrize("seed", range(5))
def test_monotone_pairs_are_the_best(seed):
    rng = random.Random(seed)
    score = [[rng.choice([0, 0.2, 0.5, 1.0]) for _ in range(4)] for _ in range(4)]

    def best(i, j):
        return 0 if i == 4 or j == 4 else max(best(i + 1, j), best(i, j + 1), score[i][j] + best(i + 1, j + 1))

    pairs = alignment.monotone_pairs(score)
    assert pairs == sorted(pairs) and abs(sum(score[i][j] for i, j in pairs) - best(0, 0)) < 1e-9


def test_titles_and_blocks(spark):
    entries = spark.createDataFrame([("s", 1, 1, "The birth of Krishna"), ("s", 2, 3, "Killing of Kamsa"), ("s", 3, None, "zzz")], "by string, place int, printed int, title string")
    chapters = spark.createDataFrame([("s", 1, "Birth of Krishna"), ("s", 2, "Stealing butter"), ("s", 3, "Kamsa killed")], "by string, number int, title string")
    assert rows_of(alignment.align_titles(entries, chapters, "by"), "number", "title") == [(1, "The birth of Krishna"), (3, "Killing of Kamsa")]
    fits = spark.createDataFrame([("g", b, c, s, f) for b, c, s, f in ((1, 1, 1, 0.1), (1, 1, 2, 0.9), (2, 2, 2, 0.1), (2, 2, 3, 0.8), (2, 2, 9, 1.0))], "by string, block int, current int, slot int, fit double")
    assert rows_of(alignment.place_blocks(fits, "by"), "block", "slot") == [(1, 2), (2, 3)]
    # Bound to a region: a block outside stays, one inside moves within; checked against all placements.
    rng = random.Random(4)
    for case in range(4):
        table = [("g", b, b, s, round(rng.random(), 2)) for b in range(5) for s in range(5)]
        inside = {1, 2, 3} if case % 2 else {0, 1, 3}
        got = alignment.place_blocks(spark.createDataFrame(table, "by string, block int, current int, slot int, fit double"), "by", region=spark.createDataFrame([("g", s) for s in inside], "by string, slot int"), least_gain=0.0)
        chosen = [s for _, s in rows_of(got, "block", "slot")]
        fit = {(b, s): f for _, b, _, s, f in table}

        def worth(place):
            return sum(fit[b, s] for b, s in enumerate(place)) - 0.05 * sum(x == y for x, y in zip(place, place[1:], strict=False))

        ways = [p for p in itertools.product(range(5), repeat=5) if list(p) == sorted(p) and all(s == b or (abs(s - b) <= 3 and s in inside and b in inside) for b, s in enumerate(p))]
        assert tuple(chosen) in ways and abs(worth(chosen) - max(map(worth, ways))) < 1e-9
    lines = spark.createDataFrame([("p", 1, "helo wrld", "hello world and more"), ("p", 2, "an mor", "hello world and more")], "page string, line int, rough string, good string")
    assert rows_of(alignment.lines_from_page(lines, ["page"]), "line", "text") == [(1, "hello world"), (2, "and more")]


def test_votes(spark):
    lexicon = spark.createDataFrame([("known",)], "word string")
    given = [(1, "x", "x.", None), (2, "x", "y", "x"), (3, "x", "y", "y"), (4, None, None, "t"), (5, None, None, None), (6, "a", None, None), (7, "known", "other", None), (8, "q", "r", None), (9, "q", "known", "s")]
    found = consensus.decide_words(spark.createDataFrame(given, "k int, a string, b string, t string"), lexicon)
    assert rows_of(found, "k", "chosen", "confidence", "review") == sorted([(1, "x", "AB", False), (2, "x", "AT", False), (3, "y", "BT", False), (4, "t", "single", True), (5, None, "single", False), (6, "a", "single", True), (7, "known", "lex", True), (8, "q", "dispute", True), (9, "known", "lex", True)], key=str)
    titles = spark.createDataFrame([("a b c", "a x c", "z b c"), ("a b", "a b", "q"), ("a", "b c", "d"), ("a", "b", "c")], "a string, b string, c string")
    assert [r[0] for r in titles.select(consensus.vote_titles(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["a b c", "a b", None, None]


def test_pages_of_three_readings(spark):
    page = spark.createDataFrame([(1, "the qick fox ॥१॥", "the quick fox jumps ॥१॥", "the quick fox ॥१॥")], "page int, a string, b string, t string")
    found = rows_of(consensus.combine_pages(page, spark.createDataFrame([("the",)], "word string")), "place", "a", "chosen", "confidence")
    assert (0, "the", "the", "AB") in found and (1, "qick", "quick", "BT") in found and (2, "fox", "fox", "AB") in found
    assert [f for f in found if f[3] == "omission"] == [(None, None, None, "omission")]
    rates = spark.createDataFrame([("the fox", "the ox", ["a", "b"], ["a", "c"]), ("", "x", [], []), (None, "x", None, ["a"])], "a string, b string, x array<string>, y array<string>")
    assert [r[0] for r in rates.select(F.round(consensus.error_rate(F.col("a"), F.col("b")), 4)).collect()] == [round(1 / 7, 4), 1.0, None]
    assert [r[0] for r in rates.select(consensus.word_error_rate("x", "y")).collect()] == [0.5, 0.0, None]
    lines = spark.createDataFrame([("the fox runs", "the box runs"), ("a fox", "a box"), ("same", "same")], "stored string, read string")
    assert rows_of(consensus.confusions(lines, "stored", "read"), "stored", "read", "n") == [("fox", "box", 2)]
    three = spark.createDataFrame([("a b", "a  b", "x"), ("a", "b", "b"), ("a", "b", "a"), ("a", "b", "c")], "x string, y string, z string")
    assert [r[0] for r in three.select(consensus.comparison_class(F.col("x"), F.col("y"), F.col("z"))).collect()] == ["same", "stored_wrong", "reader_wrong", "unclear"]
    ranked = spark.createDataFrame([(1, "good", -5.0, 0), (1, "bad", -2.0, 1), (1, "worse", -9.0, 0)], "k int, text string, loglik double, unknown int")
    assert rows_of(consensus.rescore(ranked, ["k"]), "k", "text") == [(1, "good")]
    freq = spark.createDataFrame([("rnan", 1), ("man", 50), ("ruau", 9), ("rnar", 4), ("mar", 90), ("rnat", 3), ("mat", 9), ("rnap", 1), ("map", 2)], "word string, freq int")
    listed = spark.createDataFrame([(1, "n", "u"), (0, "rn", "m")], "place int, old string, new string")
    assert rows_of(consensus.fix_misreads(freq, listed), "word", "fixed") == [("rnan", "man")]
    other = spark.createDataFrame([(0, "n", "u"), (1, "rn", "m")], "place int, old string, new string")
    assert rows_of(consensus.fix_misreads(freq, other), "word", "fixed") == [("rnan", "ruau")]


def test_units_from_pages(spark):
    given = [("v", 1, ["first ॥ 1 ॥ second", "goes on"]), ("v", 2, ["still ॥ 2-3 ॥", "tail"]), ("v", 3, None), ("w", 1, ["॥ ४ ॥"])]
    found = assemble.assemble_units(spark.createDataFrame(given, "vol string, page int, paragraphs array<string>"), ["vol"], "page")
    assert [tuple(r) for r in sorted(found.select("vol", "unit", "a", "b", "text", "pages", "closed").collect())] == [("v", 0, 1, 1, "first", [1], True), ("v", 1, 2, 3, "second goes on still", [1, 2], True), ("v", 2, None, None, "tail", [2], False), ("w", 0, 4, 4, "", [1], True)]
    units = [("v", k, a, h, c, r) for k, (a, h, c, r) in enumerate([(1, None, None, 1), (2, None, True, 1), (3, None, None, None), (1, None, None, None), (2, 7, None, None), (3, None, None, 9), (4, None, None, 9)])]
    chapters = assemble.chapter_breaks(spark.createDataFrame(units, "vol string, k int, a int, heading int, colophon boolean, running_head int"), ["vol"], "k")
    assert [c for _, c in rows_of(chapters, "k", "chapter")] == [1, 1, 2, 3, 7, 7, 9]
    strict = assemble.mark_strict(spark.createDataFrame(units, "vol string, k int, a int, heading int, colophon boolean, running_head int"), spark.createDataFrame([("v", 2, 3)], "vol string, first int, last int"), ["vol"], "k")
    assert [c for _, c in rows_of(assemble.chapter_breaks(strict, ["vol"], "k"), "k", "chapter")] == [1, 1, 1, 1, 7, 7, 9]
    flagged = spark.createDataFrame([("v", 1, ["first part ॥ 1 ॥ second[?]"], ["skewed"]), ("v", 2, ["goes on ॥ 2 ॥"], None)], "vol string, page int, paragraphs array<string>, flags array<string>")
    assert rows_of(assemble.assemble_units(flagged, ["vol"], "page"), "unit", "flags") == [(0, ["short", "skewed"]), (1, ["uncertain", "continued", "skewed"])]
    flags = spark.createDataFrame([("ok text of some length", True), ("x[?] <", False)], "t string, c boolean").select(assemble.unit_flags(F.col("t"), F.col("c")))
    assert [r[0] for r in flags.collect()] == [[], ["uncertain", "stray_symbols", "no_end_marker", "short"]]


def test_contents_pages(spark):
    lines = spark.createDataFrame([("s", k, t) for k, t in enumerate(["Contents", "1. The birth ..... 12", "of the king", "", "2 The war … 30"])], "s string, k int, text string")
    entries = assemble.fold_entry_lines(lines, ["s"], "k")
    assert rows_of(entries, "number", "title") == [(1, "The birth of the king"), (2, "The war")]
    numbers = spark.createDataFrame([("s", k, n) for k, n in enumerate([1, None, 3, 40, 5])], "s string, k int, number int")
    assert [c for _, c in rows_of(assemble.resync_entries(numbers, ["s"], "k"), "k", "chapter")] == [1, 2, 3, 4, 5]
    starts = spark.createDataFrame([("v", 1, 1, 1), ("v", 4, 1, 2)], "vol string, page int, section int, chapter int")
    skips = spark.createDataFrame([("v", 2, 3)], "vol string, first int, last int")
    kept = assemble.apply_forced_starts(spark.createDataFrame([("v", p) for p in range(1, 6)], "vol string, page int"), starts, skips, ["vol"], "page")
    assert rows_of(kept, "page", "chapter") == [(1, 1), (4, 2), (5, 2)]
    fresh = assemble.segments_not_in(spark.createDataFrame([("k", 1, "old"), ("k", 2, "new ॥ 1 ॥"), ("k", 3, "more")], "k string, line int, text string"), spark.createDataFrame([("k", "old")], "k string, text string"), "k")
    assert rows_of(fresh, "segment", "text") == [(0, "new ॥ 1 ॥"), (1, "more")]


def test_markdown_round_trip(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\ntitle: "One"\nlang: en\n---\nhead\n\n### 1\nSage said:\nsource line\n---\nits meaning\n### 2\nplain\n', encoding="utf-8", newline="")
    (tmp_path / "b.md").write_text("#### x\r\ntext of x\r\n", encoding="utf-8", newline="")
    files = markdown.read_files(spark, str(tmp_path))
    units = markdown.read_units(files)
    assert rows_of(units, "dialect", "title", "text") == [("block", "x", "text of x"), ("unit", "1", "Sage said:\nsource line\n---\nits meaning"), ("unit", "2", "plain")]
    assert units.where("title = '1'").first()["meta"] == {"title": "One", "lang": "en"}
    split = markdown.split_source_and_translation(units, "\\n---\\n")
    assert rows_of(split, "title", "speaker", "source", "translation") == [("1", "Sage said", "source line", "its meaning"), ("2", None, None, "plain"), ("x", None, None, "text of x")]
    made = markdown.chapter_documents(units.where("dialect = 'unit'").withColumn("chapter", F.lit(7)), ["chapter"], "place", {"lang": "en"})
    out = str(tmp_path / "out")
    markdown.write_chapters(made.unionByName(made.withColumn("chapter", F.lit(8))), ["chapter"], out, spark.createDataFrame([(8,)], "chapter int"))
    again = markdown.read_units(markdown.read_files(spark, out + "/chapter=7"))
    assert rows_of(again, "title", "text") == [("1", "Sage said:\nsource line\n---\nits meaning"), ("2", "plain")]
    assert not (tmp_path / "out" / "chapter=8").exists()


def test_page_records(spark, tmp_path):
    (tmp_path / "v1_p0007.json").write_text(json.dumps({"_page": {"vol": 1}, "paragraphs": ["a", "b"], "chapter_number": 3}))
    (tmp_path / "other.json").write_text("{}")
    assert rows_of(pages.read_pages(spark, str(tmp_path)), "vol", "page", "chapter_number", "paragraphs") == [(1, 7, 3, ["a", "b"])]
    answers = spark.createDataFrame([('```json\n{"found": true, "text": "x"}\n```',), ("{}",), ("broken",), (None,)], "t string")
    assert [r[0]["text"] if r[0] else None for r in answers.select(pages.tolerant_json(F.col("t"), "found boolean, text string", "found")).collect()] == ["x", None, None, None]
    replies = spark.createDataFrame([('[{"id":1,"choice":"a"},{"id":2,"choice":"z"},{"id":3,"text":"own"},{"id":9,"choice":"a"}]',)], "reply string")
    options = spark.createDataFrame([(k, ["a", "b"]) for k in (1, 2, 3)], "id int, options array<string>")
    assert rows_of(pages.check_answers(replies, options), "id") == [(1,), (3,)]
    flags = spark.createDataFrame([([(0, 1, "old,", False), (0, 2, "b", False)],)], "flags array<struct<para:int,idx:int,chosen:string,resolved:boolean>>")
    done = flags.select(pages.resolve_flags(F.col("flags"), F.lit(0), F.lit(1), F.lit("new"))).first()[0]
    assert [(f["chosen"], f["resolved"]) for f in done] == [("new,", True), ("b", False)]


def test_wikis(spark, tmp_path):
    text = "==English==\n===Pronunciation===\n* {{IPA|en|/haʊs/}}\n===Noun===\n# A [[building|place]] to {{gloss|live}}.\n#: example\n# {{lb|en|rare}} {{m|en|home}}\n===Etymology===\n# not a sense"
    dump = f"<mediawiki><page><title>house</title><ns>0</ns><revision><text>{text}</text></revision></page><page><title>Talk:x</title><ns>1</ns><revision><text>t</text></revision></page><page><title>r</title><ns>0</ns><redirect title='house'/><revision><text>t</text></revision></page></mediawiki>"
    (tmp_path / "d.xml").write_text(dump, encoding="utf-8")
    articles = wiki.read_dump(spark, str(tmp_path / "d.xml"))
    assert rows_of(articles, "title") == [("house",)] and wiki.read_dump(spark, str(tmp_path / "d.xml"), spark.createDataFrame([("x",)], "title string")).count() == 0
    assert rows_of(wiki.wikitext_entries(articles), "language", "pos", "glosses", "ipa") == [("English", "noun", ["A place to (live).", "(rare) home"], "/haʊs/")]
    cleaned = spark.createDataFrame([("''x'' &amp; <ref>r</ref>y<!-- c --> {{a|{{l|en|deep}}}} [[Category:z]]",), ("{{t+|fr|mot}}* go",), ("w" * 150 + " " + "v" * 150,), (None,)], "t string").select(wiki.clean_wikitext("t"))
    got = [r[0] for r in cleaned.collect()]
    assert got[0] == "x & y deep" and got[1] == "go" and len(got[2]) == 240 and got[3] is None
    (tmp_path / "e.jsonl").write_text('{"word":"go","lang_code":"en","pos":"verb","senses":[{"glosses":["a","b"]},{"glosses":["b"],"form_of":[{"word":"wend"}]}],"forms":[{"form":"went"}],"sounds":[{},{"ipa":"/g/"}]}\nbroken\n')
    flat = wiki.flat_entries(wiki.read_entries(spark, str(tmp_path / "e.jsonl")))
    assert rows_of(flat, "headword", "pos", "glosses", "ipa", "forms") == [("go", "verb", ["b"], "/g/", ["went", "wend"])]
    payload = json.dumps({"fr": [{"partOfSpeech": "Nom", "definitions": [{"definition": "x"}]}], "en": [{"partOfSpeech": "Noun", "definitions": [{"definition": "<b>y</b>"}] * 5}], "hi": []})
    found = spark.createDataFrame([(payload,)], "p string").select(wiki.flat_definitions(F.col("p"), ["en"])).first()[0]
    assert [(d["lang"], d["definition"]) for d in found] == [("en", "y")] * 3 + [("fr", "x")]


def test_plain_tables(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    assert rows_of(tables.with_columns_present(t, {"id": "long", "more": "string"}), "id", "more") == [(1, None), (2, None)]
    assert rows_of(tables.by_ids(t, spark.createDataFrame([(2,), (2,)], "id int"), "id"), "id") == [(2,)]
    assert rows_of(t.where(tables.contains_any(["name"], F.lit("A"))), "id") == [(1,)]
    (tmp_path / "g.tsv").write_text("a\tn\tx\nb\tn\t?\nc\tn\t\n", encoding="utf-8")
    assert rows_of(tables.read_glosses(spark, str(tmp_path / "g.tsv")), "word") == [("a",)]
    tables.write_sorted(t, ["id"], str(tmp_path / "s"))
    assert tables.content_hash(spark.read.parquet(str(tmp_path / "s"))).collect() == tables.content_hash(t.repartition(3)).collect() != tables.content_hash(t.limit(1)).collect()
    files = spark.createDataFrame([("x", "1.9", "p"), ("x", "1.10", "q"), ("y", "v2", "r")], "name string, version string, path string")
    assert rows_of(tables.newest_version(files), "name", "version", "path") == [("x", "1.10", "q"), ("y", "v2", "r")]
    tables.require_version(spark.createDataFrame([("version", "3")], "key string, value string"), "3")
    with pytest.raises(ValueError):
        tables.require_version(spark.createDataFrame([("version", "3")], "key string, value string"), "4")
    with pytest.raises(ValueError):
        tables.from_backup(tables.to_backup(t, "t"), "t", {"id": "int"})
    assert spark.createDataFrame([("a| |b",)], "t string").select(tables.split_list(F.col("t"))).first()[0] == ["a", "b"]
    tables.write_report(t, str(tmp_path / "r"), ["id"])
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2
    assert shared.materialise(t, "x").count() == 2


def test_lookups_and_patches(spark):
    entries = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "b")], "entry_id int, norm string")
    assert entries.count() == 3
    moves = spark.createDataFrame([(1, 2, 0, 1)], "k int, num int, place int, source int")
    assert patches.stamp(moves).first() == patches.stamp(moves.repartition(2)).first()
    known = spark.createDataFrame([("v", 1, 10), ("v", 5, 12)], "vol string, num int, page int")
    assert rows_of(intervals.candidate_places(spark.createDataFrame([("v", 3)], "vol string, num int"), known, ["vol"]), "num", "page") == [(3, 10), (3, 11), (3, 12)]
    units = spark.createDataFrame([("v", 2), ("v", 9)], "vol string, a int")
    rows = spark.createDataFrame([("v", 1, 3)], "vol string, num int, num_end int")
    assert rows_of(intervals.unmatched_units(units, rows, ["vol"]), "a") == [(9,)]


def test_lookups_in_ranges_and_groups(spark):
    ranges = spark.createDataFrame([("v", 1, 3, "a"), ("v", 7, 9, "b"), ("w", 1, 1, "c")], "vol string, low int, high int, name string")
    points = spark.createDataFrame([("v", k) for k in (0, 1, 3, 5, 9, 10)] + [("x", 1), ("v", None)], "vol string, n int")
    found = intervals.point_lookup(points, ranges, ["vol"], "n", "low", "high", ["name"])
    assert rows_of(found.where("n is not null"), "vol", "n", "name") == sorted([("v", 0, None), ("v", 1, "a"), ("v", 3, "a"), ("v", 5, None), ("v", 9, "b"), ("v", 10, None), ("x", 1, None)], key=str)
    entries = spark.createDataFrame([("rama",), ("sita",)], "form string")
    words = spark.createDataFrame([("ramah", ["ramah", "rama", "sita"]), ("zzz", ["y"]), ("none", None)], "word string, variants array<string>")
    assert rows_of(lookup.base_pointers(words, F.col("variants"), entries), "word", "base") == [("ramah", "rama")]
    meanings = spark.createDataFrame([("k1", "g")], "key string, gloss string")
    members = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k2", "c")], "key string, word string")
    assert rows_of(lookup.spread_to_group(meanings, members, "key"), "word", "gloss") == [("a", "g"), ("b", "g")]
    payload = json.dumps([{"tag_name": "2.0", "prerelease": True, "assets": []}, {"tag_name": "1.9", "assets": [{"name": "x.apk", "browser_download_url": "u"}, {"name": "x.txt", "browser_download_url": "t"}]}])
    assert [tuple(r) for r in spark.createDataFrame([(payload,)], "p string").select(tables.releases(F.col("p"), ".apk")).first()[0]] == [("1.9", "u")]
    stats = tables.stats_row(spark.createDataFrame([(3, None)], "n int, name string"), "counts").first()
    assert (stats["key"], json.loads(stats["value"])) == ("counts", {"n": 3, "name": None})


def test_ordered_rows(spark):
    units = spark.createDataFrame([("g", k, a, b, [1, 2, 3, 4]) for k, (a, b) in enumerate([(1, 1), (None, None), (3, 3), (9, 4), (4, 4)])], "g string, k int, a int, b int, expected array<int>")
    assert rows_of(sequence.repair_numbers(units, ["g"], "k"), "k", "a", "repaired") == [(0, 1, False), (1, 2, True), (2, 3, False), (3, 9, False), (4, 4, False)]
    rows = spark.createDataFrame([("g", k, v) for k, v in enumerate([0, 1, 5, 1, 0, 0, 1, 0])], "g string, k int, v int")
    grown = sequence.grow_regions(rows, ["g"], ["k"], F.col("v") >= 1, F.col("v") == 5)
    assert [h for _, h in rows_of(grown, "k", "in_region")] == [True, True, True, True, True, False, False, False]


def test_quality_and_review(spark):
    texts = spark.createDataFrame([("a[?] b[?] c[?] d",), ("a b c d",)], "t string")
    assert [r[0] for r in texts.select(quality.garbled(F.col("t"))).collect()] == [True, False]
    fits = spark.createDataFrame([("g", 1, 0.1, 0.5, None), ("g", 2, 0.4, 0.5, 0.1)], "g string, k int, own double, prev double, next double")
    assert rows_of(quality.misplaced(fits, ["g"], "k"), "k", "best") == [(1, 0.5)]
    assert spark.range(1).select(quality.risk(F.lit(1), F.lit(2), F.lit(3), F.lit(50))).first()[0] == 28.0
    queue = quality.review_queue(spark.createDataFrame([("b", 1.0), ("a", 2.0), ("a", 3.0), ("zz", 9.0)], "reason string, score double"), {"a": 0, "b": 1}).collect()
    assert [(r["reason"], r["score"]) for r in queue] == [("a", 3.0), ("a", 2.0), ("b", 1.0), ("zz", 9.0)]
    assert spark.range(1).select(review.minutes(F.lit(401))).first()[0] == 3
    assert spark.range(1).select(review.speaking_seconds(F.lit(100), F.lit(10.0), F.array(F.lit(100.0), F.lit(900.0)), F.lit(500.0))).first()[0] == pytest.approx(11.4)
    days = spark.createDataFrame([(k,) for k in (30, 10, 20)], "id int")
    assert [sampling.pick_of_day(days, ["id"], F.lit(d)).first()[0] for d in (0, 4)] == [10, 20]
    many = spark.range(200).withColumn("page", F.col("id") % 10)
    one, two = (rows_of(sampling.uniform_sample(many.repartition(n), ["id"], 9), "id") for n in (1, 5))
    assert one == two and len(one) == 9
    assert sampling.cluster_sample(many, "page", ["id"], 3, 4).groupBy("page").count().collect().__len__() == 3
    assert rows_of(many.select(sampling.block_fold(F.col("id"), 2).alias("f")).distinct(), "f") == [(0,), (1,)]


def test_readers_tools(spark):
    lines = spark.createDataFrame([(1, "the qwick fox."), (2, "fine")], "line int, text string")
    near = spark.createDataFrame([("qwick", w, n) for w, n in (("quick", 9), ("quirk", 5), ("qwack", 1), ("qwerk", 0))], "word string, near string, freq int")
    assert rows_of(reading.line_variants(lines, near), "line", "variant", "text") == [(1, 0, "the qwick fox."), (1, 1, "the quick fox."), (1, 2, "the quirk fox."), (1, 3, "the qwack fox."), (2, 0, "fine")]
    pools = spark.createDataFrame([(["house", "river"], ["hause", "x"]), ([], ["a"]), (["a"], None)], "mine array<string>, pool array<string>")
    assert [r[0] for r in pools.select(reading.support("mine", "pool")).collect()] == [0.5, 0.0, 0.0]
    freq = {"house": 9, "mouse": 2, "horse": 1, "river": 4, "rivet": 2}
    table = spark.createDataFrame(list(freq.items()), "word string, freq int")
    words = ["houze", "river", "rivex", "hous", "zzzz", "moose"]
    want = []
    for w in words:
        near_ = sorted(((n, k) for k, n in freq.items() if w not in freq and abs(len(k) - len(w)) <= 1 and levenshtein(w, k) == 1), reverse=True)
        if near_ and near_[0][0] >= 3 and (len(near_) == 1 or near_[0][0] >= 3 * near_[1][0]):
            want.append((w, near_[0][1]))
    assert rows_of(reading.dominant_fix(spark.createDataFrame([(w,) for w in words], "word string"), table), "word", "fixed") == sorted(want) and want
    def remove(text, original):
        return reading.remove_original(F.col(text), F.col(original), "॥", "[a-z]+")

    text = "Here it is: omaa namo bhaga vate ॥ and this is the translation of it"
    rows = spark.createDataFrame([(text, "oma namo bhagav vate"), ("omaa only ॥", "oma namo bhaga vate"), (None, "x")], "t string, o string")
    assert [r[0] for r in rows.select(remove("t", "o")).collect()] == ["and this is the translation of it", "omaa only ॥", None]
    same = spark.createDataFrame([("oma namo bhaga vate ॥ and this is the translation of it", "oma namo bhaga vate")], "t string, o string")
    assert same.select(remove("t", "o")).first()[0] == "and this is the translation of it"
    assert reading.missing_columns(table, ["word", "lang"]) == ["lang"]


def test_support_is_that_of_all_pairs(spark, sf_dir):
    from wordloom.functions.tokens import query_terms
    from wordloom.operators.support import best_support

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(12).select("item_id", F.array_distinct(query_terms(F.lower("text"))).alias("mine"))
    items = items.unionByName(spark.createDataFrame([(900, ["hause", "the", "river"]), (901, []), (902, None), (903, ["zzzz"]), (None, ["house", None])], "item_id long, mine array<string>"))
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet").limit(40).select(F.array_distinct(query_terms(F.lower("text"))).alias("pool"))
    texts = texts.unionByName(spark.createDataFrame([(["house", "the"],), ([],), (None,), (["rivver", "river", None],)], "pool array<string>"))
    pools = [[w for w in r["pool"] or [] if w is not None] for r in texts.collect()]
    for least, block in ((1, 8 << 20), (2, 2000)):
        want = {}
        for r in items.collect():
            mine = [w for w in r["mine"] or [] if w is not None]
            shares = [sum(bool(difflib.get_close_matches(w, p, 1, 0.78)) for w in mine) / len(mine) for p in pools if len(set(mine) & set(p)) >= least]
            if shares:
                want[r["item_id"]] = max(shares)
        got = best_support(items, texts.repartition(3), "item_id", "mine", "pool", least, block)
        assert {r["item_id"]: r["support"] for r in got.collect()} == want and len(want) > 5


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def run_stream(df, tmp_path, name, mode):
    """The rows that a run over what is new gives; state and offsets stay in the checkpoint."""
    rows = []
    query = df.writeStream.foreachBatch(lambda batch, _: rows.extend(batch.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return rows


def test_streams_keep_state(spark, tmp_path):
    answers = [(1, 10, True), (1, 20, True), (2, 5, False), (1, 30, False), (1, 40, True)]
    for k, part in enumerate((answers[:3], answers[3:])):
        spark.createDataFrame(part, "card long, ts_ms long, remembered boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "answers"))
        found = run_stream(state.review_cards(spark.readStream.schema("card long, ts_ms long, remembered boolean").parquet(str(tmp_path / "answers"))), tmp_path, "cards", "update")
        seen = {r["card"]: (r["stage"], r["due_at"]) for r in found}
        if k == 0:
            assert seen[1] == (2, 20 + review.STEPS[2] * review.DAY_MS) and seen[2][0] == 0
    assert seen[1] == (1, 40 + review.STEPS[1] * review.DAY_MS)
    batch = {r["card"]: r["stage"] for r in review.fold_reviews(spark.createDataFrame(answers, "card long, ts_ms long, remembered boolean"), ["card"], "ts_ms", "remembered").collect()}
    assert batch[1] == 1
    units = []
    for page, text in enumerate(["one ॥ 1 ॥ two", "goes on ॥ 2 ॥", "open"]):
        spark.createDataFrame([(1, page, text)], "vol int, page int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
        found = run_stream(state.assemble_stream(spark.readStream.schema("vol int, page int, text string").parquet(str(tmp_path / "pages"))), tmp_path, "units", "append")
        units += [(r["unit"], r["text"], r["first_page"], r["last_page"]) for r in found]
    assert units == [(0, "one", 0, 0), (1, "two goes on", 0, 1)]
    left = state.new_only(spark.range(3), spark.createDataFrame([(1,)], "id long"), ["id"])
    assert rows_of(left, "id") == [(0,), (2,)]


def test_table_functions_in_sql(spark):
    from wordloom.functions import sql

    sql.register(spark)
    spark.createDataFrame([("One two. Three four", "en"), ("राम। सीता", "hi"), (None, "en")], "t string, lang string").createOrReplaceTempView("given")
    assert rows_of(spark.sql("SELECT place, word FROM given, LATERAL tokens(t, lang) WHERE lang = 'hi'"), "place", "word") == [(0, "राम"), (1, "सीता")]
    assert rows_of(spark.sql("SELECT s.sentence FROM given, LATERAL sentences(t) s WHERE lang = 'en'"), "sentence") == [("One two.",), ("Three four",)]
    assert rows_of(spark.sql("SELECT form FROM edit_keys('abb')"), "form") == [("ab",), ("abb",), ("bb",)]
    assert rows_of(spark.sql("SELECT gram FROM ngrams('banana', 2)"), "gram") == [("an",), ("ba",), ("na",)]


def test_expressions_in_sql_stay_in_the_jvm(spark, sf_dir):
    from wordloom.functions import keys, sql, tokens

    sql.register_expressions(spark, ["s", "ed", "ing"])
    spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(tokens.words(F.col("text"))).alias("word")).distinct().unionByName(spark.createDataFrame([("কৃষ্ণ",), ("ସୀତା",), ("का\u093c\u094d",), ("stringeds",), ("",), (None,)], "word string")).createOrReplaceTempView("said")
    found = spark.sql("SELECT word, loose_key(word) AS k, skeleton_key(word) AS s, stems(word) AS st, ngram_list(word, 3) AS g, edit_forms(word) AS e, script_of(word) AS sc FROM said")
    plan = found._jdf.queryExecution().toString()
    assert not any(name in plan for name in ("Python", "Pandas", "Arrow"))
    w = F.col("word")
    want = spark.table("said").select("word", keys.loose_key(w).alias("k"), keys.skeleton_roman(w).alias("s"), tokens.stems(w, ["s", "ed", "ing"]).alias("st"), tokens.char_ngrams(w, 3).alias("g"), tokens.edit_keys(w).alias("e"), sql.script_of(w).alias("sc"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert spark.sql("SELECT stems('stringeds') AS s").first()["s"] == tokens_of("stringeds", ["s", "ed", "ing"])
    assert spark.sql("SELECT k, count(*) AS n FROM (SELECT loose_key(word) AS k FROM said) GROUP BY k HAVING n > 1").count() > 0
    assert spark.sql("SELECT round(wilson(8, 10).low, 4) AS low").first()["low"] == 0.4902


def tokens_of(word, suffixes):
    def strip(w):
        return [w[: -len(s)] for s in sorted(suffixes, key=len, reverse=True) if len(w) > len(s) + 1 and w.endswith(s)]

    return list(dict.fromkeys(x for w in strip(word) for x in (w, *strip(w))))


def test_indic_normal_form_without_python(spark):
    import unicodedata

    from wordloom.functions.normalize import nfc_indic

    rng = random.Random(2)
    block = [chr(c) for c in range(0x900, 0xB80) if unicodedata.category(chr(c)) != "Cn"]
    odd = [c for c in block if unicodedata.normalize("NFD", c) != c or unicodedata.combining(c)] + list("কখকেোাে")
    texts = [*block, *("".join(rng.choice(odd if rng.random() < 0.7 else block) for _ in range(rng.randint(2, 4))) for _ in range(3000))]
    # Stress marks, which words don't hold, have classes of their own.
    texts = [t for t in texts if not any(unicodedata.combining(c) not in (0, 7, 9) for c in t)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", nfc_indic(F.col("t")).alias("n")).collect()
    assert [r["t"] for r in rows if unicodedata.normalize("NFC", r["t"]) != r["n"]] == []


def test_windows_on_a_batch(spark):
    events = spark.createDataFrame([(k, u, t, v) for k, (u, t, v) in enumerate([(1, "2024-01-01 00:05:00", 1.0), (1, "2024-01-01 00:20:00", 2.0), (1, "2024-01-01 02:00:00", 3.0)])], "event_id int, user_id int, ts string, value double").withColumn("ts", F.to_timestamp("ts")).withColumn("event_type", F.lit("x"))
    assert [n for _, n in rows_of(windows.tumbling(events), "start", "n")] == [2, 1]
    assert sum(n for _, n in rows_of(windows.sliding(events), "start", "n")) == 12
    assert [n for _, n in rows_of(windows.sessions(events), "start", "n")] == [2, 1]


def test_rows_are_cleaned_as_they_are_read(spark):
    title = "मोहिनी रूपसे देवोंकी रक्षा"
    given = [
        (1, 2, None, "other", "page 3 – 4", "fine"), (1, 1, " ", f"{title}\nसूत उवाच\nverse", f"{title} — so - it", "a[?] b[?] c[?] d"), (2, 1, "kept", "सूत उवाच\nverse", "none", None),
        (3, 1, None, f"{title}\nverse", "x", ""),
    ]
    rows = spark.createDataFrame(given, "chapter int, num int, speaker string, sa string, hi string, `or` string")
    titles = spark.createDataFrame([(1, title), (3, title)], "chapter int, title string")
    found = reading.clean_rows(rows, titles, ["chapter"], "num", "sa", ["hi", "or"], "उवाच", garbled_in="or")
    assert [tuple(r) for r in found.orderBy("chapter", "num").collect()] == [(1, 1, "सूत उवाच", "verse", "so — it", ""), (1, 2, None, "other", "page 3-4", "fine"), (2, 1, "kept", "सूत उवाच\nverse", "none", None), (3, 1, None, "verse", "x", "")]


def test_grams_of_a_long_text(spark):
    from wordloom.operators.similarity import gram_agreement

    text = "".join(chr(97 + (k * k // 7 + k // 5) % 26) for k in range(400_000))
    edge = text[65_532:65_546]
    passages = spark.createDataFrame([(1, edge), (2, "0123456789abcdef"), (3, "short"), (4, None)], "item_id long, text string")
    began = time.monotonic()
    for block in (1 << 18, 3):
        found = gram_agreement(passages, spark.createDataFrame([(text,), (None,)], "text string"), block=block)
        assert sorted(map(tuple, found.collect())) == [(1, 7, 7), (2, 9, 0)]
    assert time.monotonic() - began < 60  # it grew with the square of a text's length


def test_dice_of_classes_spread_over_rows(spark):
    from wordloom.operators.similarity import dice_pairs

    kinds = ["red pen", "pen red", "red red cup", None, "cup", ""]
    rows = [(k, "g" if k % 5 else "h", kinds[k % 6]) for k in range(90)] + [(200, None, "cup"), (None, "g", "cup")]
    found = dice_pairs(spark.createDataFrame(rows, "k long, grp string, t string"), ["grp"], "k", F.split("t", " "))
    want = []
    for a, g, s in rows[:90]:
        for b, h, t in rows[:90]:
            if a < b and g == h:
                x, y = (set(w.split(" ")) if w is not None else None for w in (s, t))
                want.append((a, b, None if x is None or y is None else round(2 * len(x & y) / (len(x) + len(y)), 6)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_contents_with_long_numbers(spark):
    lines = spark.createDataFrame([("s", 1, "1. one ..... 3"), ("s", 2, "1234567. two ..... 4"), ("s", 3, "goes on"), ("s", 4, "98765432101. three")], "s string, k int, text string")
    assert rows_of(assemble.fold_entry_lines(lines, ["s"], "k"), "entry", "number", "title") == [(1, 1, "one"), (2, 1234567, "two goes on"), (3, None, "three")]


def test_keys_across_languages_are_made_of_words_and_not_of_tokens(spark, sf_dir):
    from wordloom.plans.joins import cross_language

    assert "documents.parquet" not in cross_language(spark, sf_dir)._jdf.queryExecution().toString()


def test_words_without_a_close_one_share_what_is_kept():
    from wordloom.operators.support import QuerySet

    asked = QuerySet([["house", "river"]], 1)
    assert asked.close_to("zzz") is asked.close_to("qqq") and asked.close_to("houses").tolist() == [0]
