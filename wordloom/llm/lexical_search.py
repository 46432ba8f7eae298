"""Ranked lexical search: every item of a query table against all documents.

1. The items' terms are cut into blocks of bounded bytes; a block's vocabulary
   is broadcast.  (One block is enough for some hundred thousand terms.)
2. One pass over the documents counts their terms; for each document the terms
   of the vocabulary are written as (numbers, occurrences).  Terms are found by
   hash and compared by bytes.
3. Document counts and document frequencies are summed up from that table.
4. Each task takes its documents in windows of ``WINDOW`` in the order of
   doc_id, turns the window's rows into postings by term and scores item by
   item: contributions are scatter-added into one array of the window's size,
   with a flag for each slot that was touched (a byte; numpy has no scatter
   into bits).  Touched slots are harvested into the item's heap of ``k``.
5. The heaps of all tasks are ranked by item.

All arithmetic on scores is in 64-bit integers.  No step gathers the documents
of a term or of an item in one place: a task sends ``k`` rows for an item at
most, and a window has a fixed size, however frequent a term is.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm.common import documents, materialise
from wordloom.llm.kernels import U64, mix, slices, utf8

WINDOW, BLOCK_BYTES = 1 << 13, 16 << 20
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INSIDE = np.ones(256, bool)
_INSIDE[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 20  # bytes of texts, or of a long text, that are looked at together
_NO_ID = 2**63  # stands for a null id, which comes last


def terms_of(text):
    """The distinct terms of a text column: letters and digits of any script, only A-Z lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0)))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every term in ``data``; none reaches over one of ``offsets``, where texts begin."""
    inside = _INSIDE[data]
    linked = np.zeros(len(data) + 1, bool)
    linked[1:-1] = inside[1:] & inside[:-1]
    linked[offsets] = False
    return np.flatnonzero(inside & ~linked[:-1]), np.flatnonzero(inside & ~linked[1:]) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each span of lower-cased bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    inner = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    powers = np.empty(int(lengths.max()), U64)
    powers[0] = 1
    powers[1:] = U64((_BASE + 2 * seed) % (1 << 64))
    letters = data[inner + np.repeat(starts, lengths)].astype(U64) + U64(1)
    letters *= np.multiply.accumulate(powers)[inner]
    return mix(np.add.reduceat(letters, firsts) + lengths.astype(U64))


class Vocabulary:
    """The terms of a block of items, found by hash and compared by bytes."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        self.lengths = np.array([len(t) for t in raw], np.int64)
        self.longest = int(self.lengths.max(initial=0))
        data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(self.lengths)
        for seed in range(100):
            found = hashes(data, ends - self.lengths, ends, seed)
            self.order = np.argsort(found)
            self.sorted = found[self.order]
            if (self.sorted[1:] != self.sorted[:-1]).all():
                break
        else:
            raise RuntimeError("no seed tells all terms apart")
        self.seed = seed
        # Bytes in words of eight, the last one filled up with zeros.
        self.words = np.frombuffer(b"".join(t.ljust(-(-len(t) // 8) * 8, b"\0") for t in raw), "<u8")
        self.at = np.cumsum(-(-self.lengths // 8)) - -(-self.lengths // 8)

    def __len__(self) -> int:
        return len(self.lengths)

    def match(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which spans are terms of the vocabulary, their numbers)."""
        short = np.flatnonzero(ends - starts <= self.longest)
        if not len(short) or not len(self):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, ends = starts[short], ends[short]
        found = hashes(data, starts, ends, self.seed)
        place = np.minimum(np.searchsorted(self.sorted, found), len(self) - 1)
        same = np.flatnonzero(self.sorted[place] == found)
        number, start = self.order[place[same]], starts[same]
        length = ends[same] - start
        equal = length == self.lengths[number]
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        k = 0
        while len(rest := np.flatnonzero(equal & (length > 8 * k))):
            left = np.minimum(length[rest] - 8 * k, 8)
            mask = np.where(left < 8, (U64(1) << (U64(8) * (left % 8).astype(U64))) - U64(1), ~U64(0))
            equal[rest] = eight[start[rest] + 8 * k] & mask == self.words[self.at[number[rest]] + k]
            k += 1
        return short[same[equal]], number[equal]


def _cuts(data: np.ndarray, target: int = _PIECE) -> np.ndarray:
    """Where pieces of a long text begin: at bytes that are in no term, about ``target`` apart."""
    cuts, at = [0], 0
    while len(data) - at > target:
        rest, at = at, at + target
        while at < len(data) and _INSIDE[data[at]]:
            step = np.flatnonzero(~_INSIDE[data[at : at + target]])
            at += int(step[0]) if len(step) else target
        at = min(at, len(data))
        if rest < at < len(data):
            cuts.append(at)
    return np.array([*cuts, len(data)], np.int64)


def count_terms(column: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices (i, j) of the texts: i, j, each text's terms, and (text, number, occurrences) of those in the vocabulary."""
    data, offsets = utf8(column)
    many = len(vocabulary) + 1
    for i, j in slices(offsets, _PIECE):
        part, inner = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        owners = np.arange(j - i)
        if len(part) > 2 * _PIECE:  # one text
            pieces = _cuts(part)
        else:
            pieces = np.array([0, len(part)])
        counts, keys, times = np.zeros(j - i, np.int64), [], []
        for a, b in zip(pieces[:-1].tolist(), pieces[1:].tolist(), strict=True):
            piece = _FOLD[part[a:b]]
            starts, ends = spans(piece, np.clip(inner - a, 0, b - a))
            owner = owners[np.searchsorted(inner, starts + a, side="right") - 1]
            counts += np.bincount(owner, minlength=j - i)
            which, number = vocabulary.match(piece, starts, ends)
            key, n = np.unique(owner[which] * many + number, return_counts=True)
            keys.append(key)
            times.append(n)
        if len(keys) == 1:
            key, n = keys[0], times[0]
        else:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(times), minlength=len(key)).astype(np.int64)
        yield i, j, counts, key // many, key % many, n


_POSTED = "doc_id long, n long, terms binary, times binary"


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each row; ``ends`` are their ends in bytes."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype("<i4").tobytes()), pa.py_buffer(values.tobytes())])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, how many each row has) of a column made by ``_binary``."""
    column = column.cast(pa.large_binary())
    _, offsets, held = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(held, "<i4", (ends[-1] - ends[0]) // 4, ends[0]) if ends[-1] > ends[0] else np.zeros(0, "<i4")
    return values, np.diff(ends) // 4


def _post(vocabulary):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, counts, text, number, n in count_terms(batch.column(1), vocabulary.value):
                ends = np.cumsum(np.bincount(text, minlength=j - i)) * 4
                held = np.flatnonzero(counts).tolist()
                found = [batch.column(0).slice(i, j - i), pa.array(counts), _binary(number.astype("<i4"), ends), _binary(n.astype("<i4"), ends)]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(held, pa.int64())) for c in found], names=["doc_id", "n", "terms", "times"])

    return task


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        mine = np.bincount(_numbers(batch.column(0))[0], minlength=len(total))
        mine[: len(total)] += total
        total = mine
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["term", "df"])


class Buckets:
    """Scores windows of documents for all items and keeps each item's best ``k``."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, documents: int, length: int, k: int):
        self.items, self.weights, self.documents, self.length, self.k = items, weights, documents, length, k
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in items]

    def window(self, ids: np.ndarray, last: np.ndarray, n: np.ndarray, slot: np.ndarray, term: np.ndarray, times: np.ndarray) -> None:
        """Adds documents; ``last`` says whose id is null, ``slot`` is the document of each posting."""
        if not len(term):
            return
        by_id = np.lexsort((ids, last))
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        names = [_NO_ID if end else i for i, end in zip(ids[by_id].tolist(), last[by_id].tolist(), strict=True)]
        slot = place[slot]
        m = (50 + 50 * n * self.documents // self.length)[by_id]
        times = times.astype(np.int64)
        parts = self.weights[term] * (1_000_000_000 * times // (1000 * times + 20 * m[slot]))
        order = np.argsort(term, kind="stable")
        slot, parts, term = slot[order], parts[order], term[order]
        held = np.flatnonzero(np.diff(term, prepend=-1))
        begin = dict(zip(term[held].tolist(), zip(held.tolist(), [*held[1:].tolist(), len(term)], strict=True), strict=True))
        scores, touched = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        for terms, heap in zip(self.items, self.heaps, strict=True):
            for t in terms:
                if t in begin:
                    a, b = begin[t]
                    # A document stands once in a posting list.
                    scores[slot[a:b]] += parts[a:b]
                    touched[slot[a:b]] = True
            slots = np.flatnonzero(touched)
            if not len(slots):
                continue
            got = scores[slots]
            scores[slots], touched[slots] = 0, False
            least = heap[0][0] if len(heap) == self.k else 1
            slots, got = slots[got >= least], got[got >= least]
            if len(got) > self.k:
                best = np.argsort(-got, kind="stable")[: self.k]
                slots, got = slots[best], got[best]
            for s, score in zip(slots.tolist(), got.tolist(), strict=True):
                entry = (score, -names[s])
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)


def _score(query, k: int, window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, documents, length = query.value
        buckets = Buckets(items, weights, documents, length, k)
        held, rows = [], 0

        def score() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            for at in range(0, table.num_rows, window):
                ids, n, terms, times = (c.chunk(0) for c in table.slice(at, window).columns)
                numbers, lengths = _numbers(terms)
                last = ids.is_null().to_numpy(zero_copy_only=False)
                buckets.window(ids.fill_null(0).to_numpy(), last, n.to_numpy(), np.repeat(np.arange(len(ids)), lengths), numbers, _numbers(times)[0])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= window or sum(b.nbytes for b in held) > 32 << 20:
                score()
                held, rows = [], 0
        if rows:
            score()
        for number, heap in enumerate(buckets.heaps):
            if heap:
                scores, ids = zip(*heap, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(heap), pa.int32()), pa.array([None if i == -_NO_ID else -i for i in ids], pa.int64()), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return task


def _search_block(docs: DataFrame, pairs: list, id_type: str, k: int, window: int) -> DataFrame:
    """The ranks of one block's items; ``pairs`` are rows (item_id, terms)."""
    spark = docs.sparkSession
    words = sorted({t for r in pairs for t in r["terms"]})
    number = {t: i for i, t in enumerate(words)}
    vocabulary = spark.sparkContext.broadcast(Vocabulary(words))
    posted = materialise(docs.mapInArrow(_post(vocabulary), _POSTED), "postings")
    facts = posted.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    weights = np.zeros(len(words), np.int64)
    for r in posted.select("terms").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        weights[r["term"]] = math.floor(1000 * math.log((2 * facts["documents"] + 2) / (2 * r["df"] + 1)))
    items = [[number[t] for t in r["terms"]] for r in pairs]
    query = spark.sparkContext.broadcast((items, weights, facts["documents"], max(facts["length"], 1)))
    best = posted.mapInArrow(_score(query, k, window), "item int, doc_id long, score long")
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(pairs)], f"item int, item_id {id_type}")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents with a score above 0.

    A null text has no terms; a document without terms counts nowhere.  Rows
    of ``items`` that share an id (null is one, too) are one item with the
    terms of all; an item without terms, or whose terms no document holds, has
    no rows.  Each row of ``docs`` is a document of its own, also where ids
    repeat; equal scores go by ascending doc_id, null last.  Other columns are
    ignored; an empty table gives no rows.  Items are answered in blocks of
    ``block_bytes`` of terms, one pass over the documents for each.
    """
    rows = documents(docs, id_col, text_col)
    id_type = items.schema[item_col].dataType.simpleString()
    pairs = items.select(F.col(item_col).alias("item_id"), F.explode(terms_of(F.col(item_text_col))).alias("term"))
    asked = pairs.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    asked = materialise(asked.withColumn("size", F.expr("aggregate(terms, 0L, (n, t) -> n + octet_length(t) + 32)")), "items")
    blocks = -(-(asked.agg(F.sum("size")).first()[0] or 0) // block_bytes)
    found = docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select("item_id", "terms").collect()
        if mine:
            found = found.unionByName(_search_block(rows, mine, id_type, k, window))
    return found


LEXICAL_SEARCH_SQL = f"""
WITH terms AS (SELECT row, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM (SELECT *, row_number() OVER () AS row FROM documents)),
tf AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM terms GROUP BY row, term),
lengths AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
facts AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, facts GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
scored AS (SELECT item_id, row, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
           FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (row), facts GROUP BY item_id, row),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
