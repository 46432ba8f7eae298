"""How far the words of a query set are borne out by texts: exact and close matches, without pairs of texts in a shuffle."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOSE, BLOCK_BYTES, _HELD = 0.78, 8 << 20, 200_000
_KINDS, _ROWS = 64, 256  # rows held as Python strings at once
_NONE = np.zeros(0, np.int32)


def _letters(words: list[str]) -> np.ndarray:
    """How often each kind of letter occurs in each word; letters that share a kind only raise the bound on what two words share."""
    out = np.zeros((len(words), _KINDS), np.int32)
    for k, w in enumerate(words):
        if w:
            np.add.at(out[k], np.frombuffer(w.encode("utf-32-le"), "<u4") % _KINDS, 1)
    return out


class QuerySet:
    """Items (lists of different words) and, for a text's word, which of their words it bears out."""

    def __init__(self, items: list[list[str]], least: int, close: float = CLOSE):
        self.words = sorted({w for ws in items for w in ws})
        self.number = {w: k for k, w in enumerate(self.words)}
        self.sizes = np.array([len(ws) for ws in items])
        self.flat = np.array([self.number[w] for ws in items for w in ws], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.lengths, self.letters = np.array([len(w) for w in self.words]), _letters(self.words)
        self.least, self.close, self.near = least, close, {}

    def close_to(self, word: str) -> np.ndarray:
        """Numbers of the items' words that ``word`` matches closely; letters and lengths rule out most before they are compared."""
        if word not in self.near:
            if len(self.near) > _HELD:
                self.near.clear()
            both = self.lengths + len(word)
            maybe = np.flatnonzero(2 * np.minimum(self.lengths, len(word)) >= self.close * both)
            shared = np.minimum(self.letters[maybe], _letters([word])).sum(1)
            maybe = maybe[2 * shared >= self.close * both[maybe]]
            found = [k for k in maybe.tolist() if difflib.get_close_matches(self.words[k], [word], 1, self.close)]
            self.near[word] = np.array(found, np.int32) if found else _NONE
        return self.near[word]

    def shares(self, text: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(items that have ``least`` words of the text as they are, share of each one's words that the text bears out)."""
        exact = np.zeros(len(self.words), np.int64)
        exact[[self.number[w] for w in set(text) if w in self.number]] = 1
        if not len(self.flat) or not exact.any():
            return np.zeros(0, np.int64), np.zeros(0)
        found = np.flatnonzero(np.add.reduceat(exact[self.flat], self.starts) >= self.least)
        if len(found):
            for w in set(text):
                exact[self.close_to(w)] = 1
        return found, np.add.reduceat(exact[self.flat], self.starts)[found] / self.sizes[found]


def best_support(items: DataFrame, texts: DataFrame, item: str, mine: str, pool: str, least: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, support): the largest share of an item's different words that one text bears out, exactly or closely (ratio 0.78).

    Only texts that hold ``least`` of the words as they are count; an item
    without one, or without words, has no row.  ``items`` is a query set: it
    is broadcast in blocks of ``block_bytes``, and each block takes one pass
    over ``texts``, whose rows never meet in a shuffle.  A task sends one row
    for an item.  Rows of one item id are one item with the words of all.
    """
    spark = items.sparkSession
    kind = items.schema[item].dataType.simpleString()
    asked = items.select(F.col(item).alias("item"), F.explode(mine).alias("w")).where("w IS NOT NULL").groupBy("item").agg(F.array_sort(F.collect_set("w")).alias("words"))
    asked = asked.withColumn("size", F.expr("aggregate(words, 0L, (n, w) -> n + octet_length(w) + 300)"))
    blocks = -(-(asked.agg(F.sum("size")).first()[0] or 0) // block_bytes)
    found = spark.createDataFrame([], f"item {kind}, support double")
    for block in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "words").collect()
        if not held:
            continue
        sent = spark.sparkContext.broadcast(QuerySet([r["words"] for r in held], least))

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = np.full(len(sent.value.sizes), -1.0)
            for batch in batches:
                for low in range(0, batch.num_rows, _ROWS):
                    for text in batch.column(0).slice(low, _ROWS).to_pylist():
                        which, share = sent.value.shares([w for w in text or () if w is not None])
                        best[which] = np.maximum(best[which], share)
            some = np.flatnonzero(best >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(best[some])], names=["place", "support"])

        names = spark.createDataFrame([(k, r["item"]) for k, r in enumerate(held)], f"place int, item {kind}")
        top = texts.select(pool).mapInArrow(task, "place int, support double").groupBy("place").agg(F.max("support").alias("support"))
        found = found.unionByName(top.join(names, "place").select("item", "support"))
    return found.withColumnRenamed("item", item)
