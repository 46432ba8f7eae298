"""Versioned stores, the stored index, guarded chapters and batch files."""

from __future__ import annotations

import json
import os
import shutil
from collections import defaultdict
from urllib.parse import urlparse

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.operators import stored
from wordloom.plans import search
from wordloom.sources import markdown, pages, store, tables

from tests.test_operators import rows_of, run_stream


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-(2**40), 2**62), min_size=1, max_size=700))
def test_blocks_keep_all_ids(ids):
    ids = np.array(sorted(ids), np.int64)
    firsts, counts, ends, gaps = stored.pack(ids)
    assert counts.sum() == len(ids) and counts.max() <= stored.BLOCK
    held = stored.PostingList(firsts, counts, ends, gaps)
    assert (held.all() == ids).all() and held.n == len(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sets(st.integers(0, 400), min_size=1, max_size=300), min_size=1, max_size=3), min_size=1, max_size=4), st.integers(0, 3))
def test_leapfrog_is_an_intersection(positions, pad):
    lists = [[stored.PostingList(*stored.pack(np.array(sorted(s), np.int64))) for s in p] for p in positions]
    want = set.intersection(*(set.union(*p) for p in positions))
    assert stored.leapfrog(lists).tolist() == sorted(want)


def test_rare_words_spare_the_blocks_of_frequent_ones():
    frequent = stored.PostingList(*stored.pack(np.arange(0, 60_000, 2)))
    rare = stored.PostingList(*stored.pack(np.array([10, 40_001, 50_000])))
    none = stored.PostingList(*stored.pack(np.array([11])))
    assert stored.leapfrog([[frequent], [rare]]).tolist() == [10, 50_000]
    assert frequent.read == 3 < len(frequent.firsts)
    assert stored.leapfrog([[frequent], [rare], [none]]).tolist() == []
    assert frequent.read == 3 and len(frequent.firsts) == 235  # stopped before it


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(k, ["the", f"w{(k or 0) % 700}", f"v{(k or 0) % 3}"], f"s{(k or 0) % 5}") for k in [*range(3000), *range(stored.SEGMENT - 5, stored.SEGMENT + 5), -3, None]]
    return rows, spark.createDataFrame(rows, "doc_id long, words array<string>, source string")


def test_search_over_segments(spark, long_docs):
    rows, docs = long_docs
    post = docs.select("doc_id", F.explode("words").alias("key")).distinct()
    blocks = stored.posting_blocks(post)
    held = defaultdict(set)
    for doc, words, _ in rows:
        for w in words:
            if doc is not None:
                held[w].add(doc)
    assert {(r["key"], r["doc_id"]) for r in stored.decode_blocks(blocks).collect()} == {(w, d) for w, ds in held.items() for d in ds}
    assert {r["key"]: (r["df"], r["first_doc"], r["last_doc"]) for r in stored.frequency(blocks).collect()} == {w: (len(d), min(d), max(d)) for w, d in held.items()}
    queries = {"a": ["the", "w5"], "b": ["the"], "c": ["w5", "v2", "the"], "d": ["w5", "absent"], "e": ["w1", "w2"]}
    terms = spark.createDataFrame([(q, p, k) for q, ks in queries.items() for p, k in enumerate(ks)] + [("d", 1, "w6"), ("d", 1, "w5"), ("a", 1, "w5")], "query string, position int, key string")
    found = stored.search_blocks(terms, blocks).collect()
    got = defaultdict(set)
    for r in found:
        got[r["query"]] |= set(r["ids"])
    want = {q: set.intersection(*(held[k] for k in ks)) for q, ks in queries.items() if q != "d"} | {"d": held["w5"] & (held["w6"] | held["w5"])}
    assert {q: d for q, d in got.items() if d} == {q: d for q, d in want.items() if d}
    assert sum(r["read"] for r in found) < sum(r["held"] for r in found)


def copy_of(sf_dir, tmp_path):
    where = str(tmp_path / "data")
    os.makedirs(where)
    shutil.copy(f"{sf_dir}/documents.parquet", f"{where}/documents.parquet")
    return where


def test_the_index_follows_the_documents(spark, sf_dir, tmp_path):
    where = copy_of(sf_dir, tmp_path)
    one = search.search_index(spark, where)
    assert search.search_index(spark, where).folder == one.folder
    before = search.search_and(spark, where).count()
    root, version = search.index_place(spark, where)
    # Other documents under the same path: the old index is refused, a new one is built.
    spark.createDataFrame([(7, "und der los que with which license released", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("overwrite").parquet(f"{where}/documents.parquet")
    with pytest.raises(store.Stale, match="wanted"):
        stored.open_index(spark, root, search.index_place(spark, where)[1])
    assert {r["doc_id"] for r in search.search_and(spark, where).collect()} == {7} and before > 10
    assert {r["key"] for r in search.postings_df(spark, where).collect()} == {r["key"] for r in search.search_index(spark, where).words.where("length(key) > 2").collect()}
    two = search.search_index(spark, where)
    assert two.folder != one.folder
    # A file that is gone or cut short is noticed, wherever it is.
    for lost in ("groups", "blocks"):
        now = search.search_index(spark, where)
        file = urlparse(getattr(now, lost).inputFiles()[0]).path
        os.remove(file) if lost == "groups" else open(file, "ab").write(b"x")
        with pytest.raises(store.Stale, match="lacks"):
            stored.open_index(spark, *search.index_place(spark, where))
        assert search.search_index(spark, where).folder != now.folder
    assert {r["doc_id"] for r in search.search_and(spark, where).collect()} == {7}


def test_a_failed_build_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.current(spark, root) is None
    store.publish(spark, root, lambda f: spark.range(3).write.parquet(f"{f}/t"), version="one")

    def half(folder: str) -> None:
        spark.range(5).write.parquet(f"{folder}/t")
        raise RuntimeError("stopped half-way")

    with pytest.raises(RuntimeError):
        store.publish(spark, root, half, version="two")
    assert spark.read.parquet(f"{store.require(spark, root, 'one')}/t").count() == 3
    with pytest.raises(store.Stale):
        store.require(spark, root, "two")
    folder = store.publish(spark, root, lambda f: spark.range(5).write.parquet(f"{f}/t"), version="two")
    assert store.current(spark, root) == folder and spark.read.parquet(f"{store.require(spark, root, 'two')}/t").count() == 5


NOTES, CARDS = {"id": "long", "note": "string"}, {"card": "long", "stage": "int"}


def test_restore_is_all_or_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "user")
    notes = spark.createDataFrame([(1, "a"), (2, None)], "id long, note string")
    cards = spark.createDataFrame([(9, 2)], "card long, stage int")
    backup = tables.to_backup(notes, "notes").unionByName(tables.to_backup(cards, "cards"))
    both = {"notes": NOTES, "cards": CARDS}
    store.restore(spark, backup, root, both)

    def now():
        return rows_of(store.table(spark, root, "notes", NOTES), "id", "note"), rows_of(store.table(spark, root, "cards", CARDS), "card", "stage")

    old = ([(1, "a"), (2, None)], [(9, 2)])
    assert now() == old
    other = tables.to_backup(notes.withColumn("id", F.col("id") + 10), "notes")
    # The second table fails after the first is written; a strange column, a strange table, rows that can't be read.
    real = store.from_backup

    def failing(rows, name, schema):
        df = real(rows, name, schema)
        return df.where(F.raise_error("disk full").isNull()) if name == "cards" else df

    monkeypatch.setattr(store, "from_backup", failing)
    with pytest.raises(Exception, match="disk full"):
        store.restore(spark, other.unionByName(tables.to_backup(cards, "cards")), root, both)
    monkeypatch.undo()
    assert now() == old
    for bad, why in (
        (other.unionByName(tables.to_backup(cards.withColumn("x", F.lit(1)), "cards")), "no column"),
        (other.unionByName(tables.to_backup(cards, "strange")), "strange"),
        (other.unionByName(spark.createDataFrame([("cards", "card,stage", "{broken")], "table string, columns string, row string")), "can't be read"),
    ):
        with pytest.raises(ValueError, match=why):
            store.restore(spark, bad, root, both)
        assert now() == old
    store.restore(spark, other, root, both)
    assert now() == ([(11, "a"), (12, None)], [])


def test_reviewed_chapters_keep_their_bytes(spark, tmp_path):
    out = str(tmp_path / "chapters")

    def chapters(text: str, numbers=(1, 2, 3)):
        units = spark.createDataFrame([(n, 0, "1", f"{text} of {n}") for n in numbers], "chapter int, place int, title string, text string")
        return markdown.chapter_documents(units, ["chapter"], "place", {"verification_status": "unreviewed"})

    def files():
        return {str(p.relative_to(tmp_path)): p.read_bytes() for p in (tmp_path / "chapters").glob("chapter=*/part-*")}

    markdown.write_chapters(chapters("first"), ["chapter"], out)
    assert len(files()) == 3
    # Somebody reviews chapter 2 in place; chapter 3 is named from outside.
    (mine,) = (tmp_path / "chapters" / "chapter=2").glob("part-*")
    mine.write_bytes(mine.read_bytes().replace(b"unreviewed", b"reviewed").replace(b"first", b"mended"))
    for crc in (tmp_path / "chapters" / "chapter=2").glob(".*.crc"):
        crc.unlink()
    before = files()
    markdown.write_chapters(chapters("second", (1, 2, 3, 4)), ["chapter"], out, spark.createDataFrame([(3,)], "chapter int"))
    after = files()
    assert {k: v for k, v in after.items() if "=2" in k or "=3" in k} == {k: v for k, v in before.items() if "=2" in k or "=3" in k}
    texts = {r["chapter"]: r["value"] for r in spark.read.text(out, wholetext=True).collect()}
    assert {n: t.rsplit("\n", 1)[-1] if not t.endswith("\n") else t.strip().rsplit("\n", 1)[-1] for n, t in texts.items()} == {1: "second of 1", 2: "mended of 2", 3: "first of 3", 4: "second of 4"}
    # A run over some chapters leaves the others there.
    markdown.write_chapters(chapters("third", (4,)), ["chapter"], out)
    assert {k: v for k, v in files().items() if "=4" not in k} == {k: v for k, v in after.items() if "=4" not in k}


BATCH = """stray
@@ 1 12
chapter: 3
title: The birth
P: one
P: same
P: same
fn: first note
fn: second note
sv: 4, 5-6
nonsense
strange: x
@@ 1 x
@@ 1 13
cont: yes
P:three
before: 2
note: a
note: b

@@ 1 12
P: again"""


def test_batch_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "one.txt").write_text(BATCH, encoding="utf-8")
    (tmp_path / "b" / "two.txt").write_text(BATCH.replace("\n", "\r\n").replace("one", "other"), encoding="utf-8", newline="")
    (tmp_path / "b" / "empty.txt").write_text("")
    files = pages.read_batches(spark, str(tmp_path / "b"))
    found = pages.parse_batches(files)
    assert rows_of(found.where("block = 1"), "page", "paragraphs", "footnotes", "chapter_number", "chapter_title", "sanskrit_verse_numbers") == [(12, [w, "same", "same"], ["first note", "second note"], 3, "The birth", [4, 5, 6]) for w in ("one", "other")]
    assert rows_of(found.where("block = 2"), "page", "paragraphs", "layout_note", "paragraphs_before_chapter_heading", "first_paragraph_continues_previous_page") == [(13, ["three"], "b", 2, True)] * 2
    assert rows_of(found.where("block = 3"), "page", "paragraphs", "footnotes") == [(12, ["again"], [])] * 2
    assert rows_of(pages.rejected_lines(files), "block", "line") == sorted([(0, "stray"), (1, "nonsense"), (1, "strange: x"), (1, "@@ 1 x")] * 2, key=str)
    problems = pages.page_problems(found.unionByName(found.limit(1).withColumn("paragraphs", F.array().cast("array<string>"))), "॥", "[\\u0900-\\u0963]")
    assert {tuple(r["problems"]) for r in problems.collect()} == {("Latin letters",), ("no paragraphs",)}
    # The same rows from a stream of files.
    streamed = run_stream(pages.parse_batches(pages.read_batches(spark, str(tmp_path / "b"), stream=True)), tmp_path, "batches", "append")
    assert sorted(map(str, (json.dumps(r.asDict()) for r in streamed))) == sorted(json.dumps(r.asDict()) for r in found.collect())


def test_many_lists_are_packed_as_each_alone(spark):
    rng = np.random.default_rng(5)
    lists = [np.unique(rng.integers(0, 10 ** int(rng.integers(1, 12)), int(rng.integers(1, 700)))) for _ in range(40)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    firsts, counts, ends, blocks, gaps, begin = stored.pack_lists(np.concatenate(lists), offsets)
    for k, ids in enumerate(lists):
        part, alone = slice(blocks[k], blocks[k + 1]), stored.pack(ids)
        mine = (firsts[part], counts[part], ends[part], gaps[begin[k] : begin[k + 1]].tobytes())
        assert all(np.array_equal(a, b) for a, b in zip(mine[:3], alone[:3], strict=True)) and mine[3] == alone[3]
        assert stored.PostingList(*mine).all().tolist() == ids.tolist()


def test_lists_over_several_batches(spark):
    rows = [(k, int(i)) for k, step in (("aaa", 1), ("bbb", 7), ("ccc", 400)) for i in range(0, 140_000, step)]
    post = spark.createDataFrame([*rows, ("bbb", 7), ("ddd", None), ("eee", 3)], "key string, doc_id long").repartition(3)
    blocks = stored.posting_blocks(post).cache()
    assert blocks.select("key", "segment").distinct().count() == blocks.count() == 10
    assert sorted(map(tuple, stored.decode_blocks(blocks).collect())) == sorted([*rows, ("eee", 3)])
