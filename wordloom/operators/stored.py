"""The stored index: posting lists as delta varints in blocks with skip entries, and search by leapfrog.

Documents are cut into segments of ``SEGMENT`` ids, so a list of a segment is
bounded however frequent its key is.  A list is cut into blocks of ``BLOCK``
ids; a block is its first id (in the skip entry) and the gaps behind it, seven
bits a byte.  Search takes a query's words within a segment from the rarest
on, keeps the ids that are left and unpacks, of each further list, only blocks
that may hold one of them; it stops when none is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.sources import store

SEGMENT, BLOCK = 1 << 16, 128
RULE = f"index 1, segments of {SEGMENT}, blocks of {BLOCK}"
_BLOCKS = "key string, segment long, n int, last long, firsts array<long>, counts array<int>, ends array<int>, gaps binary"


def pack_lists(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Many lists of ascending ids at once; list i is ``values[offsets[i]:offsets[i + 1]]``.

    (first id, number of ids, end in bytes within its list) of each block, where each list's blocks start, all gaps, where each list's gaps start.
    """
    lengths = np.diff(offsets)
    place = np.arange(len(values)) - np.repeat(offsets[:-1], lengths)
    starts = np.flatnonzero(place % BLOCK == 0)
    blocks = np.concatenate([[0], np.cumsum(-(-lengths // BLOCK))])
    gaps = np.delete(np.diff(values, prepend=0), starts).astype(np.uint64)
    size = np.ones(len(gaps), np.int64)
    for k in range(1, 10):
        size += gaps >= np.uint64(1 << 7 * k)
    before = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(before[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        held = np.flatnonzero(size > k)
        more = np.where(size[held] > k + 1, 128, 0)
        out[before[held] + k] = (gaps[held] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more.astype(np.uint8)
    counts = np.diff(starts, append=len(values))
    begin = before[offsets - blocks]
    ends = before[np.cumsum(counts - 1)] - np.repeat(begin[:-1], np.diff(blocks))
    return values[starts], counts, ends, blocks, out, begin


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(first id, number of ids, end in bytes) of each block, and all gaps, of ascending ids."""
    firsts, counts, ends, _, gaps, _ = pack_lists(ids, np.array([0, len(ids)]))
    return firsts, counts, ends, gaps.tobytes()


def unpack(first: int, gaps: bytes) -> np.ndarray:
    """The ids of one block."""
    raw = np.frombuffer(gaps, np.uint8)
    last = np.flatnonzero(raw < 128)
    begin = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    place = np.arange(len(raw)) - np.repeat(begin, last - begin + 1)
    parts = (raw & 127).astype(np.int64) << 7 * place
    return first + np.concatenate([[0], np.cumsum(np.add.reduceat(parts, begin) if len(begin) else parts)])


class PostingList:
    """A list of one key in one segment; counts the blocks that are unpacked."""

    def __init__(self, firsts: np.ndarray, counts: np.ndarray, ends: np.ndarray, gaps: bytes):
        self.firsts, self.n, self.ends, self.gaps, self.read = firsts, int(np.sum(counts)), ends, gaps, 0

    def block(self, k: int) -> np.ndarray:
        """The ids of block ``k``."""
        self.read += 1
        return unpack(int(self.firsts[k]), self.gaps[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])])

    def all(self) -> np.ndarray:
        """All ids."""
        return np.concatenate([self.block(k) for k in range(len(self.firsts))])

    def among(self, wanted: np.ndarray) -> np.ndarray:
        """Those of the ascending ids ``wanted`` that the list holds; only blocks they can be in are read."""
        at = np.searchsorted(self.firsts, wanted, side="right") - 1
        found = [wanted[at == k][np.isin(wanted[at == k], self.block(k), assume_unique=True)] for k in np.unique(at[at >= 0]).tolist()]
        return np.concatenate(found) if found else wanted[:0]


def leapfrog(positions: list[list[PostingList]]) -> np.ndarray:
    """Ids that some list of every position holds, ascending; the rarest position first, stopping when none is left."""
    order = sorted(positions, key=lambda lists: sum(x.n for x in lists))
    left = np.unique(np.concatenate([x.all() for x in order[0]]))
    for lists in order[1:]:
        if not len(left):
            break
        left = np.unique(np.concatenate([x.among(left) for x in lists]))
    return left


def posting_blocks(postings: DataFrame) -> DataFrame:
    """(key, segment, n, last, firsts, counts, ends, gaps) of postings (key, doc_id); a null id can't be found and isn't held."""

    def pack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values, offsets = lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]
            firsts, counts, ends, blocks, gaps, begin = pack_lists(values, offsets)
            at = pa.array(blocks, pa.int32())
            packed = [pa.ListArray.from_arrays(at, x) for x in (pa.array(firsts, pa.int64()), pa.array(counts, pa.int32()), pa.array(ends, pa.int32()))]
            held = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(gaps)])
            columns = [pa.array(np.diff(offsets), pa.int32()), pa.array(values[offsets[1:] - 1]), *packed, held]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[c.split()[0] for c in _BLOCKS.split(", ")])

    segment = F.floor(F.col("doc_id") / SEGMENT).cast("long")
    lists = postings.where("doc_id IS NOT NULL").groupBy("key", segment.alias("segment")).agg(F.array_sort(F.collect_set(F.col("doc_id").cast("long"))).alias("ids"))
    return lists.mapInArrow(pack_all, _BLOCKS)


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """(key, doc_id): the long form of stored lists."""

    @F.pandas_udf("array<long>")
    def ids(firsts: pd.Series, counts: pd.Series, ends: pd.Series, gaps: pd.Series) -> pd.Series:
        return pd.Series([PostingList(f, c, e, bytes(g)).all() for f, c, e, g in zip(firsts, counts, ends, gaps, strict=True)])

    return blocks.select("key", F.explode(ids("firsts", "counts", "ends", "gaps")).alias("doc_id"))


def frequency(blocks: DataFrame) -> DataFrame:
    """(key, df, first_doc, last_doc); no list is unpacked."""
    return blocks.groupBy("key").agg(F.sum("n").alias("df"), F.min(F.element_at("firsts", 1)).alias("first_doc"), F.max("last").alias("last_doc"))


def search_blocks(expanded: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query, segment, ids, held, read): documents with some key of every position, and how many blocks there were and were read.

    ``expanded``: (query, position, key).  A segment in which a position of a
    query has no list goes before any list is sent.
    """
    wanted = expanded.groupBy("query").agg(F.countDistinct("position").alias("needed"))
    heads = expanded.join(blocks.select("key", "segment"), "key").groupBy("query", "segment").agg(F.countDistinct("position").alias("held"))
    live = heads.join(wanted, "query").where("held = needed").select("query", "segment")
    lists = expanded.distinct().join(blocks, "key").join(live, ["query", "segment"])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["position", "key"])
        lists = [PostingList(f, c, e, bytes(g)) for f, c, e, g in zip(rows["firsts"], rows["counts"], rows["ends"], rows["gaps"], strict=True)]
        positions: dict[int, list[PostingList]] = {}
        for position, one in zip(rows["position"], lists, strict=True):
            positions.setdefault(position, []).append(one)
        ids = leapfrog(list(positions.values()))
        return pd.DataFrame({"query": rows["query"].iloc[:1], "segment": rows["segment"].iloc[:1], "ids": [ids], "held": [sum(len(x.firsts) for x in lists)], "read": [sum(x.read for x in lists)]})

    return lists.groupBy("query", "segment").applyInPandas(meet, "query string, segment long, ids array<long>, held long, read long")


class StoredIndex:
    """An index in a store: words, posting blocks, and the keys of each group of documents."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder
        self.words, self.blocks, self.groups = (spark.read.parquet(f"{folder}/{name}") for name in ("words", "blocks", "groups"))

    def search(self, expanded: DataFrame) -> DataFrame:
        """(query, unit) of every document that holds some key of every position."""
        return search_blocks(expanded, self.blocks).select("query", F.explode("ids").alias("unit"))

    def document_frequency(self) -> DataFrame:
        """(key, df)."""
        return frequency(self.blocks).select("key", "df")

    def postings(self) -> DataFrame:
        """(key, doc_id), the long form."""
        return decode_blocks(self.blocks)


def write_index(words: DataFrame, postings: DataFrame, folder: str, group: str = "source") -> None:
    """Writes the three tables of an index, sorted by key within files, so that a key's rows are found by their statistics."""
    words.write.parquet(f"{folder}/words")
    posting_blocks(postings).repartitionByRange("key", "segment").sortWithinPartitions("key", "segment").write.parquet(f"{folder}/blocks")
    postings.select("key", F.col(group).alias("group")).distinct().write.parquet(f"{folder}/groups")


def open_index(spark: SparkSession, root: str, version: str) -> StoredIndex:
    """The index in force; raises ``store.Stale`` if it was made from other files or by another rule, or has lost a part."""
    return StoredIndex(spark, store.require(spark, root, version))
