"""Ranked search, vector codes and cached token counts against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wordloom.llm import lexical_search, token_counts, vector_codes

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans(lexical_search.UPPER, lexical_search.LOWER)
WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain_search(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, length, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, c in held:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "window", "k"), [(16 << 20, 8192, 50), (300, 7, 3)])
def test_search(spark, odd, block, window, k):
    items = [(1, "Alpha12 beta3; ÉTOILE étoile"), (2, None), (3, "hi 12 34 日本語"), (4, "no such words here"), (5, "the of and of"), (None, "alpha1"), (3, "x y"), (6, "  "), (7, "a" * 5000), (8, "A" * 4999)]
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id int, text string, score string, rank string")
    got = lexical_search.search(odd, table, k=k, block_bytes=block, window=window).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_search(docs, items, k)


def test_search_of_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "hi")], "item_id long, text string")
    assert lexical_search.search(empty, items).collect() == []
    assert lexical_search.search(odd, items.where("item_id > 1")).collect() == []


def test_a_long_text_is_counted_in_pieces():
    words = [f"w{k % 997}" for k in range(400_000)]
    text = " ".join(words) + " " + "z" * (3 << 20) + " w5"
    vocabulary = lexical_search.Vocabulary(["w1", "w996", "w5", "absent", "w99612345678901234567890"])
    found = [x for x in lexical_search.count_terms(pa.array(["w1 W1 w9961", text, "", "w5"]), vocabulary)]
    counts = np.concatenate([f[2] for f in found])
    assert counts.tolist() == [3, 400_002, 0, 1]
    times = {(f[0] + a, b): c for f in found for a, b, c in zip(f[3].tolist(), f[4].tolist(), f[5].tolist(), strict=True)}
    real = Counter(words)
    assert times == {(0, 0): 2, (1, 0): real["w1"], (1, 1): real["w996"], (1, 2): real["w5"] + 1, (3, 2): 1}


def test_equal_hashes_are_told_apart_by_bytes():
    vocabulary = lexical_search.Vocabulary(["abcdefghij", "other"])
    vocabulary.words = vocabulary.words.copy()
    vocabulary.words[vocabulary.at[0] + 1] ^= np.uint64(1)  # as if another term had the hash
    data = np.frombuffer(b"abcdefghij other", np.uint8)
    starts, ends = lexical_search.spans(data, np.array([0, len(data)]))
    assert [x.tolist() for x in vocabulary.match(data, starts, ends)] == [[1], [1]]


def plain_codes(rows: list[tuple], rounds: int = 2) -> tuple[dict, str]:
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 16
    parts = [[v[p * width : (p + 1) * width] for _, v, _ in kept] for p in range(16)]
    books = [[list(x) for x in p[:64]] for p in parts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(16):
            at = [nearest(x, books[p])[1] for x in parts[p]]
            for k in range(len(books[p])):
                mine = [x for x, a in zip(parts[p], at, strict=True) if a == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    final = [[nearest(x, books[p]) for x in parts[p]] for p in range(16)]
    codes = ["".join(f"{final[p][k][1]:02x}" for p in range(16)) for k in range(len(kept))]
    errors = [sum(final[p][k][0] for p in range(16)) for k in range(len(kept))]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((r[0], c, e, by_label[r[2]], digest) for r, c, e in zip(kept, codes, errors, strict=True))


VECTORS = "vec_id long, embedding array<double>, label int, error string, code string"


@pytest.mark.parametrize("n", [5, 300])
def test_vector_codes(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(k % (n - 2)), [float(x) for x in rng.integers(-3, 4, 48) / 7], int(k % 3) if k % 4 else None) for k in range(n)]
    rows += [(None, rows[0][1], 1), (10_000, None, 1), (10_001, [], 1), (10_002, [None] * 48, 2), (10_003, [float("nan")] + [0.0] * 47, 2), (10_004, [float("-inf")] * 48, None), rows[1], rows[1]]
    got = vector_codes.compress(spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS))
    assert Counter(tuple(r) for r in got.collect()) == plain_codes(rows)


def test_vectors_of_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(150)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    assert Counter(tuple(r) for r in vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()) == plain_codes(rows)


def test_no_vectors_and_odd_lengths(spark):
    none = spark.createDataFrame([(1, None, 1, "x", "y")], VECTORS)
    assert vector_codes.compress(none).collect() == []
    with pytest.raises(Exception, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 17, 1, "x", "y")], VECTORS))
    with pytest.raises(Exception, match="components in one table"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 16, 1, "x", "y"), (2, [1.0] * 32, 1, "x", "y")], VECTORS)).collect()


def test_ring_evaluates_a_part_of_the_entries():
    rng = np.random.default_rng(3)
    entries, x = rng.integers(-200, 200, (64, 8)), rng.integers(-200, 200, (2000, 8))
    x[:64] = entries  # distance 0
    entries[7] = entries[3]  # a tie goes to the lower index
    distance = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    ring = vector_codes.Ring(entries)
    index, least = ring.nearest(x)
    assert (index == distance.argmin(1)).all() and (least == distance.min(1)).all()
    assert ring.evaluated < 64 * len(x)


def library_counts(texts: list[str], path: str = WORDS) -> list[int]:
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("table", ["odd", "documents"])
def test_token_counts(request, name, table):
    path, docs = public_tokenizers.path(name), request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    want = Counter((i, len(t.encode()), n, n > 2048) for (i, t), n in zip(rows, library_counts([t for _, t in rows], path), strict=True))
    assert Counter(tuple(r) for r in token_counts.count_tokens(docs, path).collect()) == want


def test_blanks_make_no_difference_where_they_are_squeezed():
    texts = ["a  b", "a\tb", "a \n\r b", " a b ", "<|endoftext|>\n<|startoftext|> x", "<|ENDOFTEXT|> x", "e ́ ́x", "\x1c\x0b\x0cq", "it's  it 's", "1  2   3", ""]
    squeezed = [re.sub("[ \t\n\r]+", " ", t) for t in texts]
    assert token_counts.drops_blanks(WORDS) and not token_counts.drops_blanks(public_tokenizers.path("byte_bpe_50k.json"))
    assert library_counts(texts) == library_counts(squeezed) == token_counts.Counter(WORDS).counts(texts)


def test_a_long_text_is_encoded_in_pieces():
    text = "\n".join(["some words, and 12 more <|endoftext|>"] * 60_000)
    assert len(list(token_counts._pieces(text))) > 2
    assert token_counts.Counter(WORDS).counts([text, "x"]) == [60_000 * library_counts(["some words, and 12 more <|endoftext|>"])[0], 1]


def test_only_distinct_misses_are_encoded(spark, odd, tmp_path):
    cache = str(tmp_path / "cache")
    version = token_counts.tokenizer_version(WORDS)
    some = odd.where("doc_id < 9")
    first = token_counts.count_tokens(some, WORDS, cache).collect()
    stored = {bytes(r["digest"]): r["n_tokens"] for r in token_counts.stored_counts(odd, cache, version).collect()}
    contents = {re.sub("[ \t\n\r]+", " ", r["text"] or "") for r in some.select("text").collect()}
    assert stored.keys() == {hashlib.sha256(c.encode()).digest() for c in contents}
    # What is stored is used: a count that the library would never give comes back.
    lie = spark.createDataFrame([(bytearray(hashlib.sha256(b"hi").digest()), -7)], "digest binary, n_tokens long")
    token_counts._append(lie, cache, version)
    again = {(r["doc_id"], r["n_bytes"]): r["n_tokens"] for r in token_counts.count_tokens(odd, WORDS, cache).collect()}
    assert again[8, 2] == -7 and again[9, 2] == -7
    assert all(again[r["doc_id"], r["n_bytes"]] == r["n_tokens"] for r in first if r["n_bytes"] != 2)
    # Another version sees none of it.
    assert token_counts.stored_counts(odd, cache, "other").collect() == []
    # Nothing is encoded or appended when all is stored.
    runs = sorted(p.name for p in (tmp_path / "cache").glob("version=*/run=*"))
    token_counts.count_tokens(odd, WORDS, cache).collect()
    assert runs == sorted(p.name for p in (tmp_path / "cache").glob("version=*/run=*"))


def test_counts_of_an_empty_table(spark, empty, tmp_path):
    cache = str(tmp_path / uuid.uuid4().hex)
    assert token_counts.count_tokens(empty, WORDS, cache).collect() == []
    assert token_counts.stored_counts(empty, cache, token_counts.tokenizer_version(WORDS)).collect() == []
