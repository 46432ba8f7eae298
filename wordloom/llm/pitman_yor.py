"""Language-model scoring: a hierarchical Pitman-Yor model of tokens after the two tokens before.

The restaurant of a context (u, v) has the restaurant of v as its parent, and
those of all v share the unigram restaurant, whose parent gives every known
token and the one unknown token the same probability.  The tables of a
restaurant are the customers of its parent.

1. Training words are counted.  The ``CODES`` most frequent words or fewer make
   a code book of bounded size, which is broadcast.
2. Every token goes once through a shuffle by its context v, packed: frequent
   words by their number in the code book, the others by a table in the row.
   A bucket holds whole restaurants of (u, v) and v, but for a word v with more
   than ``wide`` training tokens: its restaurants are spread over buckets of
   their own by w (and u, where w is such a word too).  There are 65,536 such
   words at most.
3. First pass over the buckets: Gibbs sweeps with the unigram level held
   uniform; the tables of each word are added up over all buckets and seated
   in the unigram restaurant.
4. Second pass over the same shuffle: Gibbs sweeps with the unigram level of
   step 3; predictive probabilities are averaged over the last sweeps and
   summed up by document.

Buckets of one large restaurant sweep side by side (``large_rounds``).  After each
sweep the tables of a context (u, v) are added up over them, and so are the
customers and tables of v; only what can change travels.  All of these are
whole numbers, so scores are those of a restaurant held in one place, and
``wide`` decides where the work is done, not what comes out.

A step of the sampler takes all customers of one dish away and seats them anew
given everything else: the number of tables t of c customers has weight
``S(c, t) * p ** t * (s + d T) (s + d (T + 1)) ...`` with generalised Stirling
numbers S, the parent's probability p and T other tables.  It is drawn from
that distribution; beyond ``EXACT`` customers S is taken from its asymptotic
form.  Dishes of a level are drawn side by side.  Random numbers depend on
dish, context and sweep only, so scores don't depend on buckets or partitions.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import documents, fold_of, materialise
from wordloom.llm.kernels import U64, mix, slices, small_batches
from wordloom.llm.shingles import word_hashes

START, END = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
_ODD = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5))
#: One discount and one strength for each level: unigram, v, (u, v).
DISCOUNTS, STRENGTHS = (0.5, 0.75, 0.85), (1.0, 1.0, 0.5)
EXACT = 256
_CELLS = 1 << 18  # numbers of a matrix at once, so that a task stays small
HOT_WORDS, CODES = 1 << 16, 1 << 20


def pair(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit name of two names."""
    return mix(a * _ODD[level] + mix(b + _ODD[3 - level]))


def uniform(names: np.ndarray, draw: int) -> np.ndarray:
    """A number in [0, 1) for each name; another one for each ``draw``."""
    return (mix(names ^ mix(np.array([draw * 0x2545F4914F6CDD1D % (1 << 64)], U64))) >> U64(11)) * 2.0**-53


@lru_cache(maxsize=8)
def log_stirling(discount: float) -> np.ndarray:
    """log S(c, t) for c and t up to ``EXACT``: weights of seating c customers at t tables."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(EXACT):
        t = np.arange(1, c + 2)
        stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf) + out[c, 1 : c + 2]
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], stay)
    return out


def tables_of(customers: np.ndarray, parent: np.ndarray, others: np.ndarray, strength: float, discount: float, names: np.ndarray, draw: int) -> np.ndarray:
    """Tables of each dish, drawn given the parent's probability and the other tables of its restaurant."""
    tables = np.minimum(customers, 1).astype(np.int64)
    many = np.flatnonzero(customers > 1)
    if not len(many):
        return tables
    most = customers[many].astype(np.int64)
    large = most > EXACT
    if large.any():
        # Far beyond these numbers of tables the weights vanish.
        c, p = most[large].astype(float), np.minimum(parent[many[large]], 1 - 1e-9)
        mean = (strength / discount + others[many[large]] + 1) * p / (1 - p)
        reach = np.minimum(mean + 12 * np.sqrt(mean / (1 - p)) + 40, 6 * c**discount + 40)
        most[large] = np.minimum(c, np.ceil(reach)).astype(np.int64)
    order = np.lexsort((most, customers[many]))
    order = np.concatenate([order[~large[order]], order[large[order]][np.argsort(most[order[large[order]]], kind="stable")]])
    many, most, large = many[order], most[order], large[order]
    u, at = uniform(names[many], draw), 0
    exact = log_stirling(discount)
    while at < len(many):
        top = int(most[at])
        end = min(int(np.searchsorted(large, True)) if not large[at] else len(many), at + 1 + _CELLS // top)
        end = at + int(np.searchsorted(most[at:end], top if not large[at] else top + (top >> 2), side="right"))
        part, top = many[at:end], int(most[end - 1])
        t = np.arange(1, top + 1)
        if large[at]:
            c = customers[part].astype(float)[:, None]
            weight = -(t - 1) * np.log(discount) - np.concatenate([[0.0], np.cumsum(np.log(t[:-1]))])
            weight = weight - (1 - discount) * discount ** (discount / (1 - discount)) * (t / c**discount) ** (1 / (1 - discount))
            weight = np.where(t <= c, weight, -np.inf)
        else:
            weight = exact[top, 1 : top + 1]
        weight = weight + np.cumsum(np.log(strength + discount * (others[part][:, None] + t - 1)), 1) + np.log(parent[part])[:, None] * t
        weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
        tables[part] = np.minimum(1 + (u[at:end, None] * weight[:, -1:] >= weight).sum(1), top)
        at = end
    return tables


def grouped(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different names, where one of each stands, the number of each name)."""
    order = np.argsort(names)
    names = names[order]
    fresh = np.concatenate([[True], names[1:] != names[:-1]]) if len(names) else np.zeros(0, bool)
    numbers = np.empty(len(names), np.int32)
    numbers[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return names[fresh], order[fresh], numbers


class Seating:
    """The restaurants of a bucket: dishes of contexts (u, v), dishes of contexts v, and how they hang together.

    The columns, one row for each token, name its word at (u, v), its word at
    v, its (u, v), its v and the word itself; ``train`` says whether it is
    learned from.  The list is emptied.
    """

    def __init__(self, columns: list[np.ndarray], train: np.ndarray):
        # Columns go as soon as they are used: they are as long as the bucket.
        self.cells, first, self.of = grouped(columns.pop(0))
        dish, context, node, word = (columns.pop(0)[first] for _ in range(4))
        del first
        self.c3 = np.bincount(self.of, weights=train, minlength=len(self.cells)).astype(np.int64)
        self.dishes, lead, self.up = grouped(dish)
        self.contexts, _, self.in3 = grouped(context)
        nodes, _, self.in2 = grouped(node[lead])
        self.n3, self.n2 = len(self.contexts), len(nodes)
        self.words, _, self.word = grouped(word[lead])
        self.t3 = np.minimum(self.c3, 1)
        self.c2 = np.bincount(self.up, weights=self.t3, minlength=len(self.dishes)).astype(np.int64)
        self.t2 = np.minimum(self.c2, 1)
        self.total3 = np.bincount(self.in3, weights=self.c3, minlength=self.n3)
        # What is seated in other buckets: tables of each context (u, v), customers of each dish, tables and customers of v.
        self.far3, self.far2, self.far_tables, self.far_customers = 0, 0, 0, 0

    def tables3(self) -> np.ndarray:
        return np.bincount(self.in3, weights=self.t3, minlength=self.n3) + self.far3

    def tables2(self) -> np.ndarray:
        return np.bincount(self.in2, weights=self.t2, minlength=self.n2) + self.far_tables

    def customers2(self) -> np.ndarray:
        return np.bincount(self.in2, weights=self.c2, minlength=self.n2) + self.far_customers

    def sweep(self, unigram: np.ndarray, draw: int) -> None:
        """One sweep, from the contexts (u, v) to the contexts v; ``unigram`` is each dish's probability above."""
        (_, d2, d3), (_, s2, s3) = DISCOUNTS, STRENGTHS
        live = np.flatnonzero(self.c3 > 1)
        up, mine = self.up[live], self.t3[live]
        # The parent without this dish's own tables.
        eaten = self.c2[up] - mine
        tables = np.minimum(self.t2[up], eaten)
        at = self.in2[up]
        held = self.tables2()[at] - (self.t2[up] - tables)
        total = self.customers2()[at] - mine
        parent = (eaten - d2 * tables + (s2 + d2 * held) * unigram[up]) / (s2 + total)
        others = self.tables3()[self.in3[live]] - mine
        self.t3[live] = tables_of(self.c3[live], parent, others, s3, d3, self.cells[live], 2 * draw)
        self.c2 = np.bincount(self.up, weights=self.t3, minlength=len(self.dishes)).astype(np.int64) + self.far2
        others = self.tables2()[self.in2] - self.t2
        self.t2 = tables_of(self.c2, unigram, np.maximum(others, 0), s2, d2, self.dishes, 2 * draw + 1)

    def predict(self, unigram: np.ndarray) -> np.ndarray:
        """The probability of each dish of a context (u, v) under the present seating."""
        (_, d2, d3), (_, s2, s3) = DISCOUNTS, STRENGTHS
        tables, total = self.tables2(), self.customers2()
        p2 = (self.c2 - d2 * self.t2 + ((s2 + d2 * tables))[self.in2] * unigram) / (s2 + total)[self.in2]
        above = (s3 + d3 * self.tables3()) / (s3 + self.total3)
        return (self.c3 - d3 * self.t3) / (s3 + self.total3)[self.in3] + above[self.in3] * p2[self.up]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([f[1] for f in found])).astype(np.int64)

    for batch in small_batches(batches):
        texts = [t.encode() for t in batch.column(0).to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        for i, j in slices(ends, 1 << 22):
            found.append(np.unique(word_hashes(texts[i:j])[0], return_counts=True))
        if sum(len(f[0]) for f in found) > 1 << 21:
            found[:] = [merge()]
            if len(found[0][0]) > 1 << 20:
                yield _columns(found[0], ("word", "n"))
                found.clear()
    if found:
        yield _columns(merge(), ("word", "n"))


def _columns(arrays, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == U64 else a) for a in arrays], names=list(names))


_PACKED = "bucket int, batch long, docs int, known binary, tokens binary, info binary"
_COUNTED = "batch long, sums binary, info binary"
_LOGS, _SCORES = 1 << 26, 1 << 20  # sums of logarithms travel as whole numbers of these parts


def _planes(column: np.ndarray) -> list[bytes]:
    """The bytes of whole numbers, lowest bytes first: they compress better apart."""
    width = max(1, (int(column.max(initial=0)).bit_length() + 7) // 8)
    raw = column.astype("<u8").view(np.uint8).reshape(-1, 8)
    return [bytes([width]), *(raw[:, k].tobytes() for k in range(width))]


def _squeeze(words: np.ndarray, columns: list[np.ndarray]) -> bytes:
    raw = b"".join([len(words).to_bytes(4, "little"), len(columns[0]).to_bytes(4, "little"), words.tobytes(), *(p for c in columns for p in _planes(c))])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueeze(blob: bytes, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    words, n = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
    at, out = 8 + 8 * words, []
    for _ in range(columns):
        column = np.zeros(n, np.int64)
        for k in range(raw[at]):
            column |= np.frombuffer(raw, np.uint8, n, at + 1 + k * n).astype(np.int64) << 8 * k
        out.append(column)
        at += 1 + n * raw[at]
    return np.frombuffer(raw, U64, words, 8), out


class CodeBook:
    """Frequent words by number, the most frequent first."""

    def __init__(self, words: np.ndarray):
        self.words, self.rank = words, np.argsort(words)
        self.sorted = words[self.rank]

    def codes(self, words: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for one that isn't in the book."""
        if not len(self.words):
            return np.full(len(words), -1)
        place = np.minimum(np.searchsorted(self.sorted, words), len(self.words) - 1)
        return np.where(self.sorted[place] == words, self.rank[place], -1)


class Large:
    """Words with large restaurants, and the buckets over which each one's is spread."""

    def __init__(self, words: np.ndarray, buckets: np.ndarray, least: int):
        self.words, self.n, self.least = words, buckets, least
        self.first = least + np.cumsum(buckets) - buckets

    def find(self, words: np.ndarray) -> np.ndarray:
        """The place of each word here, -1 for one that isn't."""
        if not len(self.words):
            return np.full(len(words), -1)
        place = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[place] == words, place, -1)

    def bucket(self, place: np.ndarray, names: np.ndarray) -> np.ndarray:
        return self.first[place] + (mix(names + _ODD[1]) % self.n[place].astype(U64)).astype(np.int64)

    def place_of(self, bucket: int) -> int:
        return int(np.searchsorted(self.first, bucket, side="right")) - 1


def pack_slice(ids: np.ndarray, train: np.ndarray, texts: list[bytes], buckets: int, hot: np.ndarray, parts: np.ndarray, large: Large, book: CodeBook) -> list[tuple]:
    """Rows of ``_PACKED``: a row for each bucket that holds a token of the slice, and one about the documents.

    A token is (v, u, w, class, step to its document's number and whether it
    is learned from), words by their number in the book, or behind it in a
    table of the row.
    """
    words, at = word_hashes(texts)
    counts = np.diff(at)
    n = counts + 1
    heads = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(texts)), n)
    table, local = np.unique(np.concatenate([words, [START, END]]), return_inverse=True)
    ends = np.zeros(len(owner), bool)
    ends[heads + counts] = True
    w = np.full(len(owner), local[-1])
    w[~ends] = local[:-2]

    def before(k: int) -> np.ndarray:
        """The token k places before, the start mark where there is none."""
        moved = np.concatenate([np.full(k, local[-2]), w[: len(w) - k]]) if k < len(w) else np.full(len(w), local[-2])
        return np.where(np.arange(len(w)) - np.repeat(heads, n) < k, local[-2], moved)

    v, u = before(1), before(2)
    kind = np.zeros(len(w), np.int64)
    if len(hot):
        place = np.minimum(np.searchsorted(hot, table), len(hot) - 1)
        share = np.where(hot[place] == table, parts[place], 1)
        own = mix(ids.view(U64).copy())[owner]  # stands for what is before a text's start
        some = np.flatnonzero(share[v] > 1)

        def class_of(tokens: np.ndarray, number: np.ndarray) -> np.ndarray:
            name = np.where(tokens[some] == local[-2], own[some], table[tokens[some]])
            return (mix(name + _ODD[0]) % number.astype(U64)).astype(np.int64)

        second = share[u][some]
        kind[some] = class_of(u, share[v][some]) * (1 << 16) + np.where(second > 1, class_of(before(3), second), 0)
    bucket = ((node_of(table[v], kind) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    place = large.find(table)
    some = np.flatnonzero(place[v] >= 0)
    bucket[some] = large.bucket(place[v[some]], np.where(place[w[some]] >= 0, pair(table[w[some]], table[u[some]], 1), table[w[some]]))
    order = np.argsort(bucket, kind="stable")  # by bucket, then by place
    bucket, owner, v, u, w, kind = bucket[order], owner[order], v[order], u[order], w[order], kind[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    learned = train[owner]
    # The same key names this slice in every bucket, whichever executor makes it again.
    marks = mix(ids.view(U64) ^ mix(np.add.reduceat(words if len(words) else np.zeros(1, U64), np.minimum(at[:-1], max(len(words) - 1, 0))) * U64(3) + n.astype(U64)))
    batch = int(mix(np.array([np.add.reduce(marks, dtype=U64)], U64))[0].astype(np.int64))
    rows = [(batch % buckets, batch, len(texts), b"", b"", np.concatenate([ids, n]).astype("<i8").tobytes())]
    edges, codes = [*starts.tolist(), len(bucket)], book.codes(table)
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        columns = [codes[x[a:z]] for x in (v, u, w)]
        used = np.unique(np.concatenate([x[a:z][c < 0] for x, c in zip((v, u, w), columns, strict=True)]))
        columns = [np.where(c < 0, len(book.words) + np.searchsorted(used, x[a:z]), c) for x, c in zip((v, u, w), columns, strict=True)]
        steps = np.diff(owner[a:z], prepend=0) * 2 + learned[a:z]
        rows.append((int(bucket[a]), batch, len(texts), b"", _squeeze(table[used], [*columns, kind[a:z], steps]), b""))
    return rows


def node_of(v: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The name of v's restaurant, or of the one of its class."""
    return pair(v, kind.astype(U64), 0)


def _pack(buckets: int, hot: np.ndarray, parts: np.ndarray, large: Large, book, rows: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, rows):
            ids = np.array([-(2**63) if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            train = np.array(batch.column(2).to_pylist(), np.int64)
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
            for i, j in slices(ends, 1 << 22):
                yield _record(pack_slice(ids[i:j], train[i:j], texts[i:j], buckets, hot, parts, large, book.value), _PACKED)

    return task


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _unpack(rows: list[dict], book: CodeBook, places: bool) -> tuple[Seating, dict]:
    """The bucket's restaurants and, if ``places``, (owner, v, train) of each token and the first number of each row's documents."""
    low = np.concatenate([[0], np.cumsum([r["docs"] for r in rows], dtype=np.int64)])
    parts: list[list[np.ndarray]] = [[] for _ in range(8 if places else 6)]
    for k, r in enumerate(rows):
        table, (v, u, w, kind, steps) = _unsqueeze(r["tokens"], 5)
        r["tokens"] = b""
        v, u, w = (_words(x, book, table) for x in (v, u, w))
        node = node_of(v, kind)
        context = pair(node, u, 1)
        found = (pair(context, w, 2), pair(node, w, 2), context, node, w, (steps & 1).astype(np.uint8), (np.cumsum(steps >> 1) + low[k]).astype(np.uint32), v)
        for held, column in zip(parts, found, strict=False):
            held.append(column)
    columns = []
    while parts:
        columns.append(np.concatenate(parts.pop(0)))
    train = columns[5]
    tokens = {"owner": columns[6], "v": columns[7], "train": train, "low": low} if places else {}
    del columns[5:]
    return Seating(columns, train), tokens


def _words(numbers: np.ndarray, book: CodeBook, table: np.ndarray) -> np.ndarray:
    known = len(book.words)
    if not len(table):
        return book.words[numbers]
    held = table[np.maximum(numbers - known, 0)]
    return np.where(numbers < known, book.words[np.minimum(numbers, known - 1)], held) if known else held


_SWEEPS, _BURN_IN = 6, 3


def _first_pass(vocabulary: int, large: Large, book):
    def bucket_tables(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rows = [r for r in group.to_pylist() if r["tokens"]]
        if not rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "word": pa.array([], pa.int64()), "tables": pa.array([], pa.int64())})
        seats = _unpack(rows, book.value, False)[0]
        if key[0].as_py() >= large.least:
            seats.t2 = np.where(_moving(seats, large)[0], 0, seats.t2)  # those come from the rounds
        else:
            flat = np.full(len(seats.dishes), 1 / (vocabulary + 1))
            for draw in range(_BURN_IN):
                seats.sweep(flat, draw)
        tables = np.bincount(seats.word, weights=seats.t2, minlength=len(seats.words)).astype(np.int64)
        return pa.table({"bucket": pa.array(np.full(len(tables), key[0].as_py(), np.int32)), "word": pa.array(seats.words.view(np.int64)), "tables": pa.array(tables)})

    return bucket_tables


def _second_pass(hot: np.ndarray, hot_counts: np.ndarray, large: Large, book, rounds: bool):
    """Scores of the buckets of whole restaurants; with ``rounds``, those of the buckets of large ones from what the rounds left."""

    def bucket_scores(key: tuple[pa.Scalar, ...], group: pa.Table, above: pa.Table) -> pa.Table:
        rows = group.to_pylist() if (key[0].as_py() >= large.least) == rounds else []
        out = [(r["batch"], b"", r["info"]) for r in rows if r["info"]]
        rows = sorted((r for r in rows if r["tokens"]), key=lambda r: r["batch"])
        if not rows:
            return pa.Table.from_batches([_record(out, _COUNTED)])
        seats, tokens = _unpack(rows, book.value, True)
        total = np.zeros(len(seats.cells))
        if rounds:
            left = _unbundle(above.column("body")[0].as_py())
            unigram = left["p"].astype(np.float64)[np.searchsorted(left["words"], seats.words)][seats.word]
            for seated in left["past"]:
                _seat(seats, large, left, seated)
                total += seats.predict(unigram)
        else:
            words, p1 = _unigrams(above)
            unigram = p1[np.searchsorted(words, seats.words)][seats.word]
            for draw in range(_SWEEPS):
                seats.sweep(unigram, _SWEEPS + draw)
                if draw >= _BURN_IN:
                    total += seats.predict(unigram)
        score = np.log10(total / (_SWEEPS - _BURN_IN))[seats.of]
        owner, low = tokens["owner"], tokens["low"]
        distinct, at = np.unique(tokens["v"], return_inverse=True)
        counts = np.bincount(at, weights=tokens["train"], minlength=len(distinct))
        if len(hot):
            place = np.minimum(np.searchsorted(hot, distinct), len(hot) - 1)
            counts = np.where(hot[place] == distinct, hot_counts[place], counts)
        word = distinct != START
        docs, of = np.unique(owner, return_inverse=True)
        known = np.bincount(of, weights=(word & (counts > 0))[at]).astype(np.int64)
        # One is added for each word, so that no sum is negative.
        logs = np.rint(np.bincount(of, weights=np.where(word, np.log10(counts + 0.5) + 1, 0.0)[at]) * _LOGS).astype(np.int64)
        scores = np.rint(np.bincount(of, weights=-score) * _SCORES).astype(np.int64)
        for k, r in enumerate(rows):
            part = slice(*np.searchsorted(docs, low[k : k + 2]))
            steps = np.diff(docs[part].astype(np.int64) - low[k], prepend=0)
            out.append((r["batch"], _squeeze(np.zeros(0, U64), [steps, known[part], logs[part], np.maximum(scores[part], 0)]), b""))
        return pa.Table.from_batches([_record(out, _COUNTED)])

    return bucket_scores


def _unigrams(above: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    words = above.column("word").to_numpy().view(U64)
    order = np.argsort(words)
    return words[order], above.column("p").to_numpy().astype(np.float64)[order]


_MAIL = "bucket int, sender int, kind int, body binary"
_OWN, _CONTEXTS, _NODE = range(3)  # kinds of rows: a bucket's own, about contexts (u, v), about v


def _bundle(**held) -> bytes:
    def small(x):
        if isinstance(x, list):
            return [small(y) for y in x]
        whole = isinstance(x, np.ndarray) and x.dtype.kind == "i"
        return x.astype(np.min_scalar_type(int(x.max(initial=0)))) if whole else x

    raw = pickle.dumps({k: small(x) for k, x in held.items()}, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unbundle(blob: bytes) -> dict:
    def wide(x):
        if isinstance(x, list):
            return [wide(y) for y in x]
        return x.astype(np.int64) if isinstance(x, np.ndarray) and x.dtype.kind == "u" and x.dtype != U64 else x

    return {k: wide(x) for k, x in pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)).items()}


def _moving(seats: Seating, large: Large) -> tuple[np.ndarray, np.ndarray]:
    """Whether the tables of each dish can change from sweep to sweep, and whether it is spread over buckets."""
    spread = large.find(seats.words)[seats.word] >= 0
    alive = np.bincount(seats.up, weights=seats.c3 > 1, minlength=len(seats.dishes)) > 0
    return spread | alive | (seats.c2 > 1), spread


def _mail(bucket: int, large: Large, contexts: np.ndarray, columns: list[np.ndarray], node: dict) -> list[tuple]:
    """Rows to the bucket that adds up each context (u, v), and to the one that adds up v."""
    place = large.place_of(bucket)
    owners, out = large.bucket(np.full(len(contexts), place), contexts), [(int(large.first[place]), bucket, _NODE, _bundle(**node))]
    for owner in np.unique(owners).tolist():
        mine = owners == owner
        out.append((owner, bucket, _CONTEXTS, _bundle(names=contexts[mine], columns=[c[mine] for c in columns])))
    return out


def _open(large: Large, book):
    """Of each bucket of a large restaurant, what can change, and its first mail."""

    def opened(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        rows = [r for r in group.to_pylist() if r["tokens"]] if bucket >= large.least else []
        if not rows:
            return pa.Table.from_batches([_record([], _MAIL)])
        seats = _unpack(rows, book.value, False)[0]
        moving, spread = _moving(seats, large)
        live, once = seats.c3 > 1, seats.c3 == 1
        number = np.cumsum(moving) - 1
        own = {
            "cells": seats.cells[live], "c3": seats.c3[live], "up": number[seats.up[live]], "in3": seats.in3[live].astype(np.int64), "contexts": seats.contexts,
            "dishes": seats.dishes[moving], "words": seats.words[seats.word[moving]], "spread": spread[moving],
            "single2": np.bincount(seats.up[once], minlength=len(seats.dishes))[moving], "singles": int(once.sum()), "fixed": int((~moving & (seats.c2 > 0)).sum()),
        }
        node = {"customers": int(seats.c2.sum()), "tables": int(seats.t2[~spread].sum()), "names": seats.dishes[spread], "words": seats.words[seats.word[spread]], "c2": seats.c2[spread]}
        alive = np.bincount(seats.in3, weights=live, minlength=seats.n3) > 0
        columns = [seats.tables3().astype(np.int64), seats.total3.astype(np.int64), alive.astype(np.int64), np.ones(seats.n3, np.int64)]
        return pa.Table.from_batches([_record([(bucket, bucket, _OWN, _bundle(**own)), *_mail(bucket, large, seats.contexts, columns, node)], _MAIL)])

    return opened


def _answer(key: tuple[pa.Scalar, ...], group: pa.Table, own: bool = True) -> pa.Table:
    """Adds up what buckets of a large restaurant wrote and answers each; rows of a bucket to itself stay if ``own``."""
    bucket, rows = key[0].as_py(), group.to_pylist()
    out = [(bucket, r["sender"], _OWN, r["body"]) for r in rows if own and r["kind"] == _OWN]
    mail = [(r["sender"], _unbundle(r["body"])) for r in rows if r["kind"] == _CONTEXTS]
    if mail:
        names, at = np.unique(np.concatenate([m["names"] for _, m in mail]), return_inverse=True)
        columns = [np.bincount(at, weights=np.concatenate(c), minlength=len(names)).astype(np.int64)[at] for c in zip(*(m["columns"] for _, m in mail), strict=True)]
        ends = np.cumsum([len(m["names"]) for _, m in mail])
        out += [(sender, bucket, _CONTEXTS, _bundle(columns=[c[end - len(m["names"]) : end] for c in columns])) for (sender, m), end in zip(mail, ends.tolist(), strict=True)]
    mail = [(r["sender"], _unbundle(r["body"])) for r in rows if r["kind"] == _NODE]
    if mail:
        names, lead, at = np.unique(np.concatenate([m["names"] for _, m in mail]), return_index=True, return_inverse=True)
        words = np.concatenate([m["words"] for _, m in mail])[lead]
        c2 = np.bincount(at, weights=np.concatenate([m["c2"] for _, m in mail]), minlength=len(names)).astype(np.int64)
        t2, first = np.minimum(c2, 1), mail[0][1]
        if "draw" in first:
            before, p = (np.concatenate([m[k] for _, m in mail])[lead] for k in ("t2", "p"))
            t2 = tables_of(c2, p.astype(np.float64), np.maximum(float(first["held"]) - before, 0), STRENGTHS[1], DISCOUNTS[1], names, 2 * first["draw"] + 1)
        customers, tables = (sum(m[k] for _, m in mail) for k in ("customers", "tables"))
        least = min(sender for sender, _ in mail)
        out += [(sender, bucket, _NODE, _bundle(customers=customers, tables=tables + int(t2.sum()), names=names, words=words, c2=c2, t2=t2, lead=sender == least)) for sender, _ in mail]
    return pa.Table.from_batches([_record(out, _MAIL)])


def _settle(large: Large):
    """A bucket's own row together with the answers to its first mail."""

    def settled(key: tuple[pa.Scalar, ...], first: pa.Table, answers: pa.Table) -> pa.Table:
        bucket, rows = key[0].as_py(), answers.to_pylist()
        if not rows:  # it only adds up for others
            return pa.Table.from_batches([_record([], _MAIL)])
        own = next(_unbundle(r["body"]) for r in first.to_pylist() if r["kind"] == _OWN)
        contexts = own.pop("contexts")
        tables, total, alive, buckets = _in_order(bucket, large, contexts, rows, 4)
        shared = (alive > 0) & (buckets > 1)
        kept = shared | (np.bincount(own["in3"], minlength=len(contexts)) > 0)
        own |= {"in3": (np.cumsum(kept) - 1)[own["in3"]], "tables3": tables[kept], "shared": np.flatnonzero(shared[kept]), "names3": contexts[shared]}
        own |= {"node": next(r["body"] for r in rows if r["kind"] == _NODE), "all3": _bundle(tables3=tables, total3=total, shared=np.flatnonzero(shared))}
        return pa.Table.from_batches([_record([(bucket, bucket, _OWN, _bundle(**own))], _MAIL)])

    return settled


def _in_order(bucket: int, large: Large, contexts: np.ndarray, rows: list[dict], columns: int) -> list[np.ndarray]:
    """The columns answered, in the order of ``contexts``."""
    owners = large.bucket(np.full(len(contexts), large.place_of(bucket)), contexts)
    out = [np.zeros(len(contexts), np.int64) for _ in range(columns)]
    for r in rows:
        if r["kind"] == _CONTEXTS:
            for held, column in zip(out, _unbundle(r["body"])["columns"], strict=True):
                held[owners == r["sender"]] = column
    return out


class Part(Seating):
    """What can change in one bucket of a large restaurant, and what is seated elsewhere."""

    def __init__(self, bucket: int, large: Large, own: dict, rows: list[dict]):
        self.bucket, self.large, self.own = bucket, large, own
        self.cells, self.c3, self.up, self.in3, self.dishes, self.words, self.spread = (own[k] for k in ("cells", "c3", "up", "in3", "dishes", "words", "spread"))
        self.in2, self.n3, self.n2 = np.zeros(len(self.dishes), np.int64), len(own["tables3"]), 1
        at_once = np.bincount(self.in3, minlength=self.n3)
        self.state = next((_unbundle(r["body"]) for r in rows if r["kind"] == _OWN), {"past": []})
        self.t3 = self.state.get("t3", np.ones(len(self.cells), np.int64))
        self.far2 = own["single2"].copy()
        own2 = np.bincount(self.up, weights=self.t3, minlength=len(self.dishes)).astype(np.int64)
        self.c2 = own2 + self.far2
        self.t2 = self.state.get("t2", np.minimum(self.c2, 1))
        self.node = _unbundle(next((r["body"] for r in rows if r["kind"] == _NODE), own["node"]))
        at = np.searchsorted(self.node["names"], self.dishes[self.spread])
        self.c2[self.spread], self.t2[self.spread] = self.node["c2"][at], self.node["t2"][at]
        self.far2[self.spread] = self.c2[self.spread] - own2[self.spread]
        self.far_customers, self.far_tables = self.node["customers"] - self.c2.sum(), self.node["tables"] - self.t2.sum()
        # Tables beyond the first of each cell, here and in all buckets.
        self.far3 = own["tables3"] - at_once
        if "t3" in self.state:
            shared = own["shared"]
            self.far3[shared] += _in_order(bucket, large, own["names3"], rows, 1)[0] - self.excess()

    def excess(self) -> np.ndarray:
        """Tables beyond the first of each cell in the contexts that other buckets have too."""
        return np.bincount(self.in3, weights=self.t3 - 1, minlength=self.n3).astype(np.int64)[self.own["shared"]]

    def step(self, unigram: np.ndarray, draw: int, **kept) -> pa.Table:
        """A sweep; then the bucket's own row and its mail."""
        before, held = self.t2[self.spread].copy(), int(self.node["tables"])
        self.sweep(unigram, draw)
        mine = np.bincount(self.up, weights=self.t3, minlength=len(self.dishes)).astype(np.int64) + self.own["single2"]
        node = {"customers": int(self.t3.sum()) + self.own["singles"], "tables": int(self.t2[~self.spread].sum()) + self.own["fixed"], "names": self.dishes[self.spread], "words": self.words[self.spread]}
        node |= {"c2": mine[self.spread], "t2": before, "p": unigram[self.spread], "held": held, "draw": draw}
        own = (self.bucket, self.bucket, _OWN, _bundle(t3=self.t3, t2=self.t2, past=self.state["past"], **kept))
        return pa.Table.from_batches([_record([own, *_mail(self.bucket, self.large, self.own["names3"], [self.excess()], node)], _MAIL)])

    def seated(self) -> bytes:
        """All that the probabilities of a seating need."""
        return _bundle(t3=self.t3, t2=self.t2, c2=self.c2[self.spread], tables3=self.tables3()[self.own["shared"]].astype(np.int64), customers=self.node["customers"], tables=self.node["tables"])


def _seat(seats: Seating, large: Large, left: dict, seated: bytes) -> None:
    """Seats all of a bucket's cells, one that was ``left`` by the rounds, as a sweep had ``seated`` what can change."""
    past, all3 = _unbundle(seated), _unbundle(left["all3"])
    once = np.minimum(seats.c3, 1)
    seats.t3, seats.far3, seats.far_tables, seats.far_customers = once, 0, 0, 0
    seats.c2 = np.bincount(seats.up, weights=once, minlength=len(seats.dishes)).astype(np.int64)
    first3, (moving, spread) = seats.tables3(), _moving(seats, large)
    seats.t3 = once.copy()
    seats.t3[seats.c3 > 1] = past["t3"]
    seats.c2 = np.bincount(seats.up, weights=seats.t3, minlength=len(seats.dishes)).astype(np.int64)
    seats.c2[spread] = past["c2"]
    seats.t2 = np.minimum(seats.c2, 1)
    seats.t2[moving] = past["t2"]
    here = seats.tables3()
    tables3 = all3["tables3"] + here - first3
    tables3[all3["shared"]] = past["tables3"]
    seats.far3, seats.total3 = tables3 - here, all3["total3"]
    seats.far_customers, seats.far_tables = past["customers"] - seats.c2.sum(), past["tables"] - seats.t2.sum()


def large_rounds(packed: DataFrame, large: Large, book, vocabulary: int):
    """The rounds of the large restaurants of ``packed``: their tables of the first pass, and a function from the unigram level to what the second pass needs.

    A bucket's row is kept, and its mail is added up in a bucket of the same restaurant, between one sweep and the next.
    """
    opened = packed.groupBy("bucket").applyInArrow(_open(large, book), _MAIL)
    # The rows of a bucket to itself are long here: they are read again from the same shuffle and not sent through the next.
    answers = opened.groupBy("bucket").applyInArrow(lambda key, group: _answer(key, group, False), _MAIL)
    settled = opened.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_settle(large), _MAIL)
    none = pa.Table.from_batches([_record([], _MAIL)])

    def part(key, own: pa.Table, rows: list[dict]) -> Part:
        return Part(key[0].as_py(), large, _unbundle(own.column("body")[0].as_py()), rows)

    def flat_sweep(draw: int):
        def swept(key: tuple[pa.Scalar, ...], own: pa.Table, mail: pa.Table) -> pa.Table:
            here = part(key, own, mail.to_pylist())
            return here.step(np.full(len(here.dishes), 1 / (vocabulary + 1)), draw)

        return swept

    def first_sweep(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        return flat_sweep(0)(key, own, none)

    def tables_of_words(key: tuple[pa.Scalar, ...], own: pa.Table, mail: pa.Table) -> pa.Table:
        here = part(key, own, mail.to_pylist())
        words, tables = [here.words[~here.spread]], [here.t2[~here.spread]]
        if here.node["lead"]:
            words, tables = [*words, here.node["words"]], [*tables, here.node["t2"]]
        words, tables = np.concatenate(words), np.concatenate(tables)
        return pa.table({"bucket": pa.nulls(len(words), pa.int32()), "word": pa.array(words.view(np.int64)), "tables": pa.array(tables.astype(np.int64))})

    def levelled_sweep(key: tuple[pa.Scalar, ...], own: pa.Table, above: pa.Table) -> pa.Table:
        if not own.num_rows:
            return none
        here, (words, p) = part(key, own, []), _unigrams(above)
        p = p[np.searchsorted(words, here.words)]
        return here.step(p, _SWEEPS, p=p.astype(np.float32))

    def later_sweep(draw: int):
        def swept(key: tuple[pa.Scalar, ...], own: pa.Table, mail: pa.Table) -> pa.Table:
            here = part(key, own, mail.to_pylist())
            if draw > _BURN_IN:
                here.state["past"].append(here.seated())
            return here.step(here.state["p"].astype(np.float64), _SWEEPS + draw, p=here.state["p"])

        return swept

    def ended(key: tuple[pa.Scalar, ...], own: pa.Table, mail: pa.Table) -> pa.Table:
        here = part(key, own, mail.to_pylist())
        return pa.Table.from_batches([_record([(here.bucket, here.bucket, _OWN, _bundle(past=[*here.state["past"], here.seated()], all3=here.own["all3"]))], _MAIL)])

    def with_unigrams(key: tuple[pa.Scalar, ...], own: pa.Table, above: pa.Table) -> pa.Table:
        if not own.num_rows:
            return none
        words, p = _unigrams(above)
        held = _unbundle(own.column("body")[0].as_py())
        return pa.Table.from_batches([_record([(key[0].as_py(), key[0].as_py(), _OWN, _bundle(words=words, p=p.astype(np.float32), **held))], _MAIL)])

    def meet(step, sent: DataFrame, schema: str = _MAIL) -> DataFrame:
        answers = sent.groupBy("bucket").applyInArrow(lambda key, group: _answer(key, group), _MAIL)
        return settled.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(step, schema)

    sent = settled.groupBy("bucket").applyInArrow(first_sweep, _MAIL)
    for draw in range(1, _BURN_IN):
        sent = meet(flat_sweep(draw), sent)
    tables = meet(tables_of_words, sent, "bucket int, word long, tables long")

    def left(above: DataFrame) -> DataFrame:
        sent = settled.groupBy("bucket").cogroup(above.groupBy("bucket")).applyInArrow(levelled_sweep, _MAIL)
        for draw in range(1, _SWEEPS):
            sent = meet(later_sweep(draw), sent)
        return meet(ended, sent).groupBy("bucket").cogroup(above.groupBy("bucket")).applyInArrow(with_unigrams, _MAIL)

    return tables, left


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the buckets' sums of each slice of documents, whose rows stand side by side."""
    now, infos, parts = None, [], []

    def solve() -> Iterator[pa.RecordBatch]:
        for info in infos:
            doc, n = np.frombuffer(info, "<i8").reshape(2, -1)
            known, logs, score = (np.zeros(len(n), np.int64) for _ in range(3))
            for part in parts:
                steps, *sums = _unsqueeze(part, 4)[1]
                at = np.cumsum(steps)
                for total, column in zip((known, logs, score), sums, strict=True):
                    total[at] += column
            times = len(infos)  # equal slices (repeated rows) were added up under one key
            yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == -(2**63)), pa.array(n), pa.array(known // times), pa.array(logs / times / _LOGS - (n - 1)), pa.array(-score / times / _SCORES)], names=["doc_id", "tokens", "known", "logs", "score"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["batch"] != now:
                yield from solve()
                now, infos, parts = row["batch"], [], []
            if row["info"]:
                infos.append(row["info"])
            else:
                parts.append(row["sums"])
    yield from solve()


def code_book(counted: DataFrame, most: int = CODES) -> CodeBook:
    """The book of the most frequent words of counted(word, n), ``most`` of them or fewer."""
    sizes = counted.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("size")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    least, held = None, 0
    for r in sorted(sizes, reverse=True):
        if held + r["words"] > most:
            break
        least, held = r["least"], held + r["words"]
    if least is None:
        return CodeBook(np.zeros(0, U64))
    found = counted.where(F.col("n") >= least).select("word", "n").toArrow()
    words, n = found.column("word").to_numpy().view(U64), found.column("n").to_numpy()
    return CodeBook(words[np.lexsort((words, -n))])


def unigram_level(tables: DataFrame, vocabulary: int) -> DataFrame:
    """(bucket, word, p) of (bucket, word, tables): the unigram restaurant's probability of every word, for each bucket that asks."""
    d, s = DISCOUNTS[0], STRENGTHS[0]

    @F.pandas_udf("double")
    def seated(word: pd.Series, customers: pd.Series) -> pd.Series:
        names, c = word.to_numpy().view(U64), customers.to_numpy()
        flat, others = np.full(len(c), 1 / (vocabulary + 1)), np.full(len(c), max(vocabulary - 1, 0))
        return pd.Series(sum(tables_of(c, flat, others, s, d, names, 1000 + k) for k in range(4)) / 4.0)

    words = tables.groupBy("word").agg(F.sum("tables").alias("c"), F.collect_list("bucket").alias("buckets"))
    words = words.withColumn("t", seated("word", "c"))
    # The lists are read here too, so that the totals come from the same shuffle as the words.
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("customers"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("held"), F.max(F.size("buckets")).alias("most"))
    p = (F.col("c") - d * F.col("t") + (s + d * F.col("held")) / (vocabulary + 1)) / (s + F.col("customers"))
    return words.crossJoin(F.broadcast(totals)).where("size(buckets) <= most").select(F.explode("buckets").alias("bucket"), "word", p.cast("float").alias("p"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, bucket_bytes: int = 8 << 20, hot: int | None = None, wide: int = 1 << 20) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose fold is not ``held_out``.  A null or empty
    text, or one without words, is its end token alone.  If nothing can be
    learned from, all counts are 0 and ``score`` is 0.  Null ids count as empty
    text for the fold; repeated rows stay and count as often as they occur;
    other columns are ignored; an empty table gives no rows.

    A restaurant with more than ``wide`` training tokens is spread over
    buckets; this doesn't change a score.  ``hot`` asks for another model, in
    which a word with so many training tokens has one restaurant for each class
    of what stands before it; no size of the input turns that on.
    """
    rows = documents(docs, id_col, text_col).withColumn("train", (fold_of(F.col("doc_id"), folds) != held_out).cast("int"))
    counted = rows.where("train = 1").select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "words")
    facts = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum("train").alias("ends"), F.count(F.lit(1)).alias("docs")).first()
    found = counted.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends, tokens = facts["ends"] or 0, (found["n"] or 0) + (facts["ends"] or 0)
    vocabulary = found["v"] + (ends > 0)
    buckets = max(8, -(-(facts["bytes"] or 0) // bucket_bytes))
    # At most HOT_WORDS words can have that share of the tokens.
    least = max(wide + 1 if hot is None else hot, -(-tokens // HOT_WORDS))
    often = counted.where(F.col("n") >= least).select("word", "n").collect()
    often = sorted([(int(np.int64(r["word"]).view(U64)), r["n"]) for r in often] + [(int(START), facts["docs"])] * (facts["docs"] >= least if hot is None else facts["docs"] >= hot))
    names, counts = np.array([w for w, _ in often], U64), np.array([n for _, n in often], np.int64)
    none = np.zeros(0, U64)
    large = Large(none, np.zeros(0, np.int64), 1 << 31)
    if hot is None and len(names):
        # The end mark is only ever a dish; as a large one, it is spread.
        spread = np.sort(np.append(names, END)) if facts["docs"] >= least else names
        shares = np.ones(len(spread), np.int64)
        shares[np.searchsorted(spread, names)] = -(-counts // wide)
        large = Large(spread, shares, buckets)
    split = (none, counts[:0]) if hot is None else (names, -(-counts // hot))
    book = rows.sparkSession.sparkContext.broadcast(code_book(counted))
    packed = rows.mapInArrow(_pack(buckets, *split, large, book, max(2000, 2 * (buckets + int(large.n.sum())))), _PACKED)
    tables = packed.groupBy("bucket").applyInArrow(_first_pass(vocabulary, large, book), "bucket int, word long, tables long")
    if len(large.words):
        seated, left = large_rounds(packed, large, book, vocabulary)
        tables = tables.union(seated)
    above = unigram_level(tables, vocabulary)
    scored = packed.groupBy("bucket").cogroup(above.groupBy("bucket")).applyInArrow(_second_pass(names, counts, large, book, False), _COUNTED)
    if len(large.words):
        spread_scores = packed.groupBy("bucket").cogroup(left(above).groupBy("bucket")).applyInArrow(_second_pass(names, counts, large, book, True), _COUNTED)
        scored = scored.union(spread_scores)
    summed = scored.repartition("batch").sortWithinPartitions("batch").mapInArrow(_sum_up, "doc_id long, tokens long, known long, logs double, score double")
    n_tokens = F.col("tokens")
    return summed.select(
        "doc_id",
        (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"),
        n_tokens.alias("n_tokens"),
        (F.col("known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + float(np.log10(ends + 0.5)) - n_tokens * float(np.log10(tokens + 0.5 * (vocabulary + 1)))).alias("base_score"),
        "score",
    )
