"""Packing token sequences: cutting-stock column generation.

Documents are tokenised once.  Each is cut into full pieces of ``SIZE`` tokens,
which fill a sequence each, and a tail.  Tails are counted by length class
(``GRID`` tokens wide, so the histogram has at most ``SIZE / GRID`` rows and
alone reaches the driver).  There a linear program over patterns of classes is
solved by column generation: the master's dual prices go to a knapsack dynamic
program, which returns the pattern worth most, until no pattern is worth more
than a sequence.  Patterns are used the rounded-down number of times; what is
left over (fewer tails than patterns times their pieces) is packed first-fit
decreasing into more patterns.  Tails are ranked within their class and the
k-th one takes the k-th place that the patterns hold for its class.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm.bpe import printable_bytes
from wordloom.llm.kernels import small_batches
from wordloom.llm.common import documents, materialise

SIZE, GRID, END = 4096, 8, 2
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: str.split() also cuts at four control characters that are not white space to the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


#: Words of plain Latin letters with punctuation behind them, which need no normalising but lower case and split in two.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([.,;:!?%$&*#()+=@/|-]*)").fullmatch


class WordIds:
    """Ids of white-space separated words as little-endian bytes.

    The vocabulary drops white space and merges never cross it, so a text's
    ids are those of its words.  The table of words is bounded.  New words of
    the plain kind are merged by tiktoken under the same ranks, the end of a
    word spelled as the byte 255, which UTF-8 never holds; all others go to
    the tokenizer itself.
    """

    def __init__(self, path: str, limit: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spelled, ranks = printable_bytes(), {}
        for token, rank in self.tokenizer.get_vocab(with_added_tokens=False).items():
            core = token.removesuffix("</w>")
            if all(c in spelled for c in core):
                ranks[bytes(spelled[c] for c in core) + b"\xff" * (core != token)] = rank
        self.merge = tiktoken.Encoding("word-ends", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.limit, self.table = limit, {}

    @staticmethod
    def words(text: str) -> list[str]:
        """The words of a text."""
        return [w for w in _SPACE.split(text) if w] if _ODD.search(text) else text.split()

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, with the end id behind them."""
        split = [self.words(t) for t in texts]
        missing = list(set().union(*split).difference(self.table))
        if len(self.table) + len(missing) > self.limit:
            self.table.clear()
            missing = list(set().union(*split))
        rest = []
        for word in missing:
            plain = _PLAIN(word)
            if plain is None:
                rest.append(word)
                continue
            ids = array("I")
            for part in plain.groups():
                if part:
                    ids.extend(self.merge(part.lower().encode() + b"\xff"))
            self.table[word] = ids.tobytes()
        for k in range(0, len(rest), 2000):
            words = rest[k : k + 2000]
            got = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
            ids, owner = np.array(got.ids, "<u4"), np.array(got.word_ids, np.int64)
            ends = np.searchsorted(owner, np.arange(len(words) + 1)) * 4
            raw = ids.tobytes()
            self.table.update((w, raw[a:b]) for w, a, b in zip(words, ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        of, end = self.table.__getitem__, END.to_bytes(4, "little")
        return [b"".join(map(of, ws)) + end for ws in split]


_LOADED: dict[str, WordIds] = {}


def tokenised_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's full pieces and its tail."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = WordIds(vocabulary)
        words = _LOADED[vocabulary]
        for batch in small_batches(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for k in range(0, len(texts), 500):
                for doc, raw in zip(ids[k : k + 500], words.ids(texts[k : k + 500]), strict=True):
                    total = len(raw) // 4
                    for start in range(0, total, SIZE):
                        part = raw[4 * start : 4 * (start + SIZE)]
                        rows.append((doc, start, len(part) // 4, zlib.crc32(part), total))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in _PIECES.split(", ")])

    return documents(docs, id_col, text_col).mapInArrow(task, _PIECES)


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """Unbounded knapsack by dynamic programming: class c (weight c + 1) is worth ``prices[c]``."""
    worth, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        n = min(w, len(prices))
        value = worth[w - n : w][::-1] + prices[:n]
        c = int(value.argmax())
        if value[c] > worth[w - 1]:
            worth[w], chosen[w] = value[c], c
        else:
            worth[w] = worth[w - 1]
    pattern, w = Counter(), capacity
    while w > 0:
        c = int(chosen[w])
        if c < 0:
            w -= 1
            continue
        pattern[c] += 1
        w -= c + 1
    return float(worth[capacity]), pattern


def column_generation(demand: np.ndarray, gap: float = 1e-3, rounds: int = 5000) -> list[tuple[Counter, float]]:
    """Patterns and their (fractional) uses that meet ``demand`` (tails by class) with the fewest sequences.

    Revised simplex on the classes in demand, from the patterns that repeat a
    single class.  Stops when no pattern improves, or when Farley's bound
    shows the solution within ``gap`` of the optimum.
    """
    capacity = len(demand)
    rows = np.flatnonzero(demand)
    if not len(rows):
        return []
    row_of = {int(c): k for k, c in enumerate(rows)}
    basis = [Counter({int(c): capacity // (int(c) + 1)}) for c in rows]
    inverse = np.diag([1 / (capacity // (c + 1)) for c in rows])
    x = inverse @ demand[rows].astype(float)
    for _ in range(rounds):
        dual = inverse.sum(axis=0)  # every pattern costs one sequence
        prices = np.full(capacity, -1.0)
        prices[rows] = dual
        worth, pattern = best_pattern(prices, capacity)
        if worth <= 1 + 1e-9 or worth - 1 <= gap:
            break
        column = np.zeros(len(rows))
        for c, n in pattern.items():
            column[row_of[c]] = n
        way = inverse @ column
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * way
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        pivot = inverse[out] / way[out]
        inverse = inverse - np.outer(way, pivot)
        inverse[out] = pivot
        basis[out] = pattern
    return list(zip(basis, x.tolist(), strict=True))


def patterns_for(demand: np.ndarray) -> list[tuple[Counter, int]]:
    """Whole patterns and how often each is used; together they hold exactly ``demand``."""
    left, out = demand.astype(np.int64).copy(), []
    for pattern, x in sorted(column_generation(demand), key=lambda p: -p[1]):
        times = min([int(x + 1e-6), *(int(left[c]) // n for c, n in pattern.items())])
        if times:
            out.append((pattern, times))
            for c, n in pattern.items():
                left[c] -= n * times
    bins: list[list] = []  # first fit, decreasing
    for c in range(len(left) - 1, -1, -1):
        for _ in range(int(left[c])):
            home = next((b for b in bins if b[0] >= c + 1), None)
            if home is None:
                bins.append(home := [len(demand), Counter()])
            home[0] -= c + 1
            home[1][c] += 1
    merged = Counter(tuple(sorted(b[1].items())) for b in bins)
    return out + [(Counter(dict(p)), n) for p, n in merged.items()]


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", rows_per_task: int = 50_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the whole text, then the end id; a null or
    empty text is the end id alone.  Every id is in exactly one piece and a
    sequence's pieces stand gapless from 0.  Repeated rows are packed like
    others, null ids stay null, other columns are ignored, an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    pieces = materialise(tokenised_pieces(docs, vocabulary, id_col, text_col), "pieces")
    pieces = pieces.withColumn("class", F.when(F.col("length") == SIZE, F.lit(-1)).otherwise(F.expr(f"(length + {GRID - 1}) div {GRID} - 1")).cast("int"))
    counts = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}
    demand = np.zeros(SIZE // GRID, np.int64)
    for c, n in counts.items():
        if c >= 0:
            demand[c] = n
    first, places, filled = counts.get(-1, 0), [(-1, 0, counts.get(-1, 0), 0, 1, 0)], Counter()
    for pattern, times in patterns_for(demand):
        order = 0
        for c, n in sorted(pattern.items(), reverse=True):
            places.append((c, filled[c], filled[c] + n * times, first, n, order))
            filled[c] += n * times
            order += n
        first += times
    table = F.broadcast(spark.createDataFrame(places, "class int, low long, high long, first long, each int, order int"))
    total = sum(counts.values())
    parts = spark.createDataFrame([(c, max(1, n // max(rows_per_task, total >> 20))) for c, n in counts.items()], "class int, parts int")
    rows = pieces.join(F.broadcast(parts), "class").withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.col("parts")).cast("int"))
    sums = rows.groupBy("class", "part").count()
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("class", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("class", "part").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")) - 1
    ranked = rows.withColumn("rank", rank).join(offsets, ["class", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    placed = ranked.join(table, (ranked["class"] == table["class"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        *(c.split()[0] for c in _PIECES.split(", ")),
        ranked["class"].alias("class"),
        (F.col("first") + F.expr("(rank - low) div each")).alias("sequence_id"),
        (F.col("order") + (F.col("rank") - F.col("low")) % F.col("each")).alias("place"),
    )
    ahead = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    return placed.select(*(c.split()[0] for c in _PIECES.split(", ")), "sequence_id", "offset")
