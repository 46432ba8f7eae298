"""Fingerprints, BPE, language ID and language-model scoring against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.brute import WORD, linked_groups, lower_ascii, plain_restaurants
from wordloom.llm import bpe, fingerprint, language_id, pitman_yor, queries


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_fingerprints(request, table):
    docs = request.getfixturevalue(table)
    rows = sorted(((i, t or "") for i, t in rows_of(docs, "doc_id", "text")), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in fingerprint.fingerprints(docs).collect()}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        assert (i, len(t), sha(t[: len(t) - half] + after[:half])) in got
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got.values())


def test_equal_texts_have_equal_fingerprints(odd):
    seen = {}
    for text, n, print_ in odd.selectExpr("text", "1 as n").withColumn("f", fingerprint.fingerprint_column(odd["text"])).collect():
        assert seen.setdefault(text or "", print_) == print_
    assert len(set(seen.values())) == len(seen) - 1  # two texts are one multiset of lines


def test_fingerprints_add_and_subtract():
    def one(text: str) -> str:
        return fingerprint.to_text(*(x[0] for x in fingerprint.vectors([text.encode()])))

    a, b = "first line\nsecond line of a text", "third line, longer than the others"
    assert fingerprint.combine(one(a), one(b)) == one(b + "\n" + a) == one(a + "\n" + b)
    assert fingerprint.combine(one(a + "\n" + b), one(b), -1) == one(a)


def test_likeness_follows_what_is_shared(documents):
    rows = fingerprint.fingerprints(documents.where("n_chars > 2000")).collect()
    assert np.mean([r["near_edited"] for r in rows]) > np.mean([r["near_next"] for r in rows]) + 0.15


def test_likeness_of_long_runs(spark):
    letters = np.random.default_rng(2).choice(list("bcdefgh"), 100_000)
    rows = [(1, "a" * 100_000), (2, "".join(letters)), (3, "a" * 60_000)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # Half of the run stays in the edited text; the last document's next one is a longer run.
    assert abs(got[1]["near_edited"] - 2 / 3) < 0.05
    assert abs(got[3]["near_next"] - 60 * 100 / (60**2 + 100**2 - 60 * 100)) < 0.01
    (a, b), lanes = (fingerprint.from_text(got[k]["fingerprint"]) for k in (1, 3)), fingerprint.from_text(fingerprint.combine(got[1]["fingerprint"], got[3]["fingerprint"]))[1]
    assert np.abs(a[1]).max() >= 99_985 and (lanes == a[1] + b[1]).all()


@pytest.mark.parametrize("table", ["documents", "odd", "empty"])
def test_bpe_matches_the_library(request, table):
    docs = request.getfixturevalue(table)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    want = []
    for i, t in rows_of(docs, "doc_id", "text"):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = rows_of(bpe.encode_decode(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(got, key=str) == sorted(want, key=str)


def test_bpe_round_trip(odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    back = bpe.decode_ids(bpe.encode_ids(odd, path), path)
    assert sorted(rows_of(back, "doc_id", "text"), key=str) == sorted(((i, t or "") for i, t in rows_of(odd, "doc_id", "text")), key=str)


def test_language_id_on_held_out_documents(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op5_language_id(spark, sf_dir).collect()}
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    right = total = 0
    for r in truth:
        found = got[r["doc_id"]]
        assert found["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (found["lang_pred"] == "und") == (not letters) and 0 <= found["score"] <= 1
        if found["held_out"] and letters and r["lang"]:
            total, right = total + 1, right + (found["lang_pred"] == r["lang"])
    assert total and right / total >= 0.9


def test_language_id_of_odd_rows(odd, empty):
    rows = rows_of(language_id.predict(odd, language_id.fit(odd)), "doc_id", "lang_pred", "score")
    assert len(rows) == odd.count()
    assert {p for i, p, _ in rows if i in (5, 6, 7, 18)} == {"und"}
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.fit(empty)).collect()} == {"und"}


def base_scores(rows):
    def tokens(t):
        return [*WORD.findall(lower_ascii(t or "")), None]

    train = Counter(w for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for w in tokens(t))
    total, kinds = sum(train.values()), len(train)
    for i, t in rows:
        own = tokens(t)
        yield i, len(own), sum(train[w] > 0 for w in own), total, sum(math.log10((train[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own)


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_language_model(request, table):
    docs = request.getfixturevalue(table)
    rows = pitman_yor.score_documents(docs).collect()
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in rows), key=str)
    want = sorted(((*w[:4], round(w[4], 3)) for w in base_scores(rows_of(docs, "doc_id", "text"))), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose(sorted(g[4] for g in got), sorted(w[4] for w in want), atol=0.01)
    assert all(r["score"] < 0 for r in rows)
    held = [r for r in rows if r["held_out"] and r["n_tokens"] > 20]
    if table == "documents":
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_of_nothing(empty):
    assert pitman_yor.score_documents(empty).count() == 0


@pytest.mark.parametrize("hot", [1 << 20, 12])
def test_language_model_against_plain_restaurants(spark, hot):
    rng = random.Random(4)
    words = ["a", "the", "of", "red", "blue", "one", "two", "Three"]
    rows = [(k, " ".join(rng.choice(words[: 2 + k % 7]) for _ in range(rng.randrange(12)))) for k in range(60)]
    rows += [(70, "the of " * 150), (71, "never seen words"), (72, rows[20][1]), (None, "the the"), (73, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, check = plain_restaurants(rows, hot)
    got = rows_of(pitman_yor.score_documents(docs, hot=hot), "doc_id", "score")
    again = rows_of(pitman_yor.score_documents(docs.repartition(5), hot=hot, bucket_bytes=40), "doc_id", "score")
    for found in (got, again):
        assert np.allclose([s for _, s in sorted(found, key=str)], [s for _, s in sorted(want, key=str)], atol=1e-9)
    # Over all known words and an unknown one the probabilities of a context sum to one.
    assert all(abs(sum(row) - 1) < 1e-9 for row in check)


@pytest.mark.parametrize("wide", [12, 40])
def test_large_restaurants_are_spread_without_another_result(spark, wide):
    """More training tokens than ``wide`` change where a restaurant is worked on, and no score."""
    rng = random.Random(5)
    words = ["a", "the", "of", "red", "blue", "one", "two", "Three"]
    rows = [(k, " ".join(rng.choice(words[: 2 + k % 7]) for _ in range(rng.randrange(14)))) for k in range(90)]
    rows += [(100, "the of " * 150), (101, "never seen words"), (102, rows[20][1]), (None, "the the"), (103, None), (104, "of new one the other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want, _ = plain_restaurants(rows, 1 << 20)
    whole = sorted(rows_of(pitman_yor.score_documents(docs), *columns), key=str)
    spread = sorted(rows_of(pitman_yor.score_documents(docs.repartition(3), wide=wide, bucket_bytes=400), *columns), key=str)
    assert [r[:4] for r in spread] == [r[:4] for r in whole]
    assert np.allclose([r[4:] for r in spread], [r[4:] for r in whole], atol=1e-9)
    assert np.allclose([s for _, s in sorted([(r[0], r[5]) for r in spread], key=str)], [s for _, s in sorted(want, key=str)], atol=1e-9)


def test_scores_of_a_word_beyond_a_million_tokens(spark):
    """Without further arguments the scores are those of restaurants that aren't spread at all."""
    rng = np.random.default_rng(6)
    kinds = np.array(["the", "the", "the", *(f"w{k}" for k in range(400))])
    rows = [(k, " ".join(kinds[np.where(rng.random(6000) < 0.75, 0, rng.integers(0, len(kinds), 6000))])) for k in range(320)]
    assert sum(t.split().count("the") for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1) > 1 << 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got, whole = (sorted(rows_of(pitman_yor.score_documents(docs, **how), "doc_id", "n_known", "score")) for how in ({}, {"wide": 1 << 40}))
    assert np.allclose(got, whole, rtol=0, atol=1e-5)


def test_tables_follow_their_distribution():
    d, s, p, others = 0.6, 0.7, 0.2, 3
    weights = Counter()

    def seat(customers: int, sizes: tuple) -> None:
        if not customers:
            weight = 1.0
            for k, n in enumerate(sizes):
                weight *= p * (s + d * (others + k))
                for j in range(1, n):
                    weight *= j - d
            weights[len(sizes)] += weight
            return
        for k in range(len(sizes)):
            seat(customers - 1, (*sizes[:k], sizes[k] + 1, *sizes[k + 1 :]))
        seat(customers - 1, (*sizes, 1))

    seat(6, ())
    n = 200_000
    names = np.arange(n, dtype=np.uint64)
    drawn = np.bincount(pitman_yor.tables_of(np.full(n, 6), np.full(n, p), np.full(n, others), s, d, names, 5), minlength=7) / n
    assert np.allclose(drawn[1:], [weights[t] / sum(weights.values()) for t in range(1, 7)], atol=0.005)
    # The asymptotic form beyond EXACT joins on to the exact numbers.
    for p, others in ((1e-4, 1000), (0.05, 200), (0.2, 3), (0.6, 20)):
        c = np.repeat([pitman_yor.EXACT, pitman_yor.EXACT + 1], 4000)
        many = pitman_yor.tables_of(c, np.full(8000, p), np.full(8000, others), s, d, names[:8000], 7)
        assert abs(many[4000:].mean() / many[:4000].mean() - 1) < 0.06


def test_copies_are_scored_apart(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    groups = Counter(c for _, _, c in linked_groups(list(texts.items())))
    of = {i: c for i, _, c in linked_groups(list(texts.items()))}
    rows = [r for r in pitman_yor.score_documents(documents).collect() if r["n_tokens"] > 50]
    single, twice = ([r["score"] / r["n_tokens"] for r in rows if not r["held_out"] and (groups[of[r["doc_id"]]] > 1) == copied] for copied in (False, True))
    assert len(twice) > 10 and np.median(twice) > np.quantile(single, 0.9)


def test_long_texts_are_walked_in_pieces(monkeypatch, odd):
    """With pieces of some bytes, the results are those of whole texts."""
    from wordloom.llm import shingles

    texts = [r["text"] or "" for r in odd.select("text").collect()] + ["x" * 300, "\n" * 50, "a b\n" * 40 + "é" * 90, ""]
    raw = [t.encode() for t in texts]
    model = language_id.Model(["a", "b"], np.log(np.array([0.5, 0.5])), np.log(np.random.default_rng(1).dirichlet(np.ones(language_id.BUCKETS), 2).T).astype(np.float32))
    whole = fingerprint.vectors(raw), shingles.shingle_sets(raw), shingles.word_hashes(raw), [model.score([t]) for t in texts], [np.bincount(language_id.gram_buckets([t])[0], minlength=language_id.BUCKETS) for t in texts]
    for module, size in ((fingerprint, 37), (shingles, 5), (language_id, 11)):
        monkeypatch.setattr(module, "_PIECE", size)
    monkeypatch.setattr(fingerprint._long_vector, "__defaults__", (37,))
    monkeypatch.setattr(shingles.pieces, "__defaults__", (5,))
    got = fingerprint.vectors(raw)
    assert (got[0] == whole[0][0]).all() and (got[1] == whole[0][1]).all()
    assert all((a == b).all() for a, b in zip(shingles.shingle_sets(raw), whole[1], strict=True))
    assert all((a == b).all() for a, b in zip(shingles.word_hashes(raw), whole[2], strict=True))
    for t, (names, share), counts in zip(texts, whole[3], whole[4], strict=True):
        again = model.score([t])
        assert again[0] == names and abs(again[1][0] - share[0]) < 1e-3
        assert (sum(np.bincount(g, minlength=language_id.BUCKETS) for g in language_id.long_grams(t)) == counts).all()
