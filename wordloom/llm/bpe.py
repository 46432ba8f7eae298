"""BPE encoding by per-prefix dynamic programming, and decoding.

Byte-pair encoding gives every prefix of a word exactly one encoding, and the
last token of that encoding together with the prefix before it determines it.
So for each prefix the tokens that end there are listed (matches of an
Aho-Corasick automaton over the vocabulary, which stands in for the suffix
automaton: it lists the same tokens at the same places), longest first, and the one that may follow the
last token of the prefix before it is kept: a pair of tokens may stand side by
side if merging their joined bytes gives back that very pair.  The ids are
read off by following the back-pointers from the end.

Texts are cut at single spaces; where a piece begins and ends with something
other than white space, the pre-tokens of the whole are those of its pieces,
so pieces are encoded once and looked up again.  The tables of pieces, words
and pairs are bounded and begin anew when full.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wordloom.llm.kernels import small_batches
from wordloom.llm.common import documents

#: The pre-token pattern of byte-level BPE vocabularies (a fixed value of the format).
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_OTHER_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


def printable_bytes() -> dict[str, int]:
    """The format's spelling of bytes: printable ones stand for themselves, the rest for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    return table | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str, limit: int = 600_000):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        spelled, vocab = printable_bytes(), spec["model"]["vocab"]
        as_bytes = {t: bytes(spelled[c] for c in t) for t in vocab if all(c in spelled for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {vocab[t]: b for t, b in as_bytes.items() if t not in self.special}
        self.ids = {b: i for i, b in self.token.items()}
        self.decoded = self.token | {i: t.encode() for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.automaton = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.pretokens = regex.compile(PRETOKEN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.limit = limit
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        self.pieces: dict[str, tuple[str, bytes]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain merging by rank; used on the joined bytes of two tokens only."""
        parts = [self.ids[data[k : k + 1]] for k in range(len(data))]
        while len(parts) > 1:
            found = [(*self.merges[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in self.merges]
            if not found:
                break
            _, made, k = min(found, key=lambda f: (f[0], f[2]))
            parts[k : k + 2] = [made]
        return parts

    def reachable(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        known = self.whole[token] = self.merged(self.token[token]) == [token]
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens may stand side by side."""
        if len(self.pairs) >= self.limit:
            self.pairs.clear()
        known = self.pairs[left << 20 | right] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known

    def encode_word(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        data = word.encode().decode("latin-1")
        last, back = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        pairs, whole = self.pairs.get, self.whole.get
        for at, (length, token) in self.automaton.iter(data):  # by end, the longest match first
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                fits = pairs(last[start] << 20 | token)
                if fits is None:
                    fits = self.compatible(last[start], token)
            else:
                fits = whole(token)
                if fits is None:
                    fits = self.reachable(token)
            if fits:
                last[end], back[end] = token, start
        ids, end = [], len(data)
        while end:
            ids.append(last[end])
            end = back[end]
        return ids[::-1]

    def _word(self, word: str) -> list[int]:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= self.limit:
                self.words.clear()
            ids = self.words[word] = self.encode_word(word)
        return ids

    def _piece(self, piece: str) -> tuple[str, bytes]:
        ids = [i for word in self.pretokens(piece) for i in self._word(word)]
        return ",".join(map(str, ids)), self.decode_bytes(ids)

    def _pieces(self, pieces: list[str]) -> list[tuple[str, bytes]]:
        """(ids joined by commas, decoded bytes) of pieces that follow a space."""
        found = list(map(self.pieces.get, pieces))
        if None in found:
            if len(self.pieces) >= self.limit:
                self.pieces.clear()
            for k, got in enumerate(found):
                if got is None:
                    found[k] = got = self.pieces.get(pieces[k]) or self._piece(" " + pieces[k])
                    if len(pieces[k]) <= 64:
                        self.pieces[pieces[k]] = got
        return found

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join([self.decoded[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        """The ids of a text, special tokens' strings included."""
        parts = self.specials.split(text) if self.specials else [text]
        return [i for p in parts for i in ([self.special[p]] if p in self.special else [x for w in self.pretokens(p) for x in self._word(w)])]

    def summary(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text)."""
        if any(s in text for s in self.special):
            ids = self.encode(text)
            return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(self.decode_bytes(ids).decode("utf-8", "replace").encode()).hexdigest()
        pieces = text.split(" ")
        if "" in pieces or " \n" in text or "\n " in text or _OTHER_SPACE(text):
            # White space next to a space: pre-tokens may reach over a cut.
            found = [self._piece(text)]
        else:
            found = [self._piece(pieces[0]), *self._pieces(pieces[1:])]
        ids = ",".join([f[0] for f in found])
        decoded = b"".join([f[1] for f in found])
        count = ids.count(",") + 1 if ids else 0
        return count, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest()


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The vocabulary, read once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Whole texts are encoded, however long.  A null text counts as empty: no
    ids, and the digests of the empty string.  Repeated rows and null ids stay
    as they are, other columns are ignored, an empty table gives no rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in small_batches(batches):
            found = [bpe.summary(t) for t in batch.column(1).to_pylist()]
            n, ids, text = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs, id_col, text_col).mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids themselves."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents(docs, id_col, text_col).mapInArrow(task, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give an empty text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            texts = [bpe.decode_bytes(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(id_col, ids_col).mapInArrow(task, "doc_id long, text string")
