"""Exact deduplication through an extendible-hash index on shared files.

Every text gets a 64-bit key.  Different keys are counted by their leading
bits, and the directory doubles while a bucket holds more than ``capacity``
keys: each split takes one more leading bit.  The directory has at most
``2 ** MAX_DEPTH`` slots, so it alone is collected and broadcast; where so
many slots are too few for ``capacity``, buckets are allowed to hold more, the
same number each.

Neighbouring buckets make a range of keys, and each range is one owner task's
work: all texts of a range meet there, keys that collide are chained and told
apart by comparing the bytes, and the range's entries are written to its own
folder in the shared folder.  A text that makes up a large share of all rows is
counted in the input tasks first, so its owner sees one row from each of them.

Rows are looked up through the directory: bucket and key name the chain, the
digest of the text the entry in it.  Chains of very frequent keys (``hot_keys``
of them at most) are broadcast, the others meet their rows in a shuffled join.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import documents, materialise, shared_folder

MAX_DEPTH = 16


def grow_directory(keys_by_slot: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """Splits overfull buckets.

    ``keys_by_slot`` counts keys by their ``max_depth`` leading bits.  Returns
    (slot, bucket, local depth) for every slot in use, ordered by slot; a
    bucket is named by its prefix behind a leading 1 bit.
    """
    buckets = [(1, 0, sorted(keys_by_slot.items()))]
    done: list[tuple[int, int, list[tuple[int, int]]]] = []
    while buckets:
        name, depth, slots = buckets.pop()
        if depth == max_depth or sum(n for _, n in slots) <= capacity:
            done.append((name, depth, slots))
            continue
        bit = max_depth - depth - 1
        for side in (0, 1):
            buckets.append((name * 2 + side, depth + 1, [s for s in slots if s[0] >> bit & 1 == side]))
    return sorted((slot, name, depth) for name, depth, slots in done for slot, _ in slots)


def key_ranges(directory: list[tuple[int, int, int]], keys_by_slot: dict[int, int], keys: int) -> dict[int, int]:
    """bucket -> range: neighbouring buckets together while they hold ``keys`` keys at most."""
    sizes: dict[int, int] = {}
    for slot, bucket, _ in directory:
        sizes[bucket] = sizes.get(bucket, 0) + keys_by_slot[slot]
    ranges, number, held = {}, 0, 0
    for bucket, n in sizes.items():
        if held and held + n > keys:
            number, held = number + 1, 0
        ranges[bucket], held = number, held + n
    return ranges


def build_index(rows: DataFrame, capacity: int, range_keys: int, hot_keys: int) -> tuple[DataFrame, DataFrame]:
    """(index, directory) of rows(doc_id, text, key).

    The index has one row for each different key: (range, bucket, key, rows,
    chain), the chain ordered by digest, with (digest, size, keep) of each
    text.  The directory is (slot, bucket, range).
    """
    spark = rows.sparkSession
    slot = F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")
    keys = materialise(rows.groupBy("key").count(), "exact-keys")
    by_slot = {r["slot"]: r["keys"] for r in keys.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("keys")).collect()}
    total = sum(by_slot.values())
    capacity = max(capacity, -(-total >> MAX_DEPTH - 1))
    slots = grow_directory(by_slot, capacity)
    ranges = key_ranges(slots, by_slot, max(range_keys, capacity))
    directory = spark.createDataFrame([(s, b, ranges[b]) for s, b, _ in slots], "slot int, bucket int, range int")
    n_rows = keys.agg(F.sum("count")).first()[0] or 0
    hot = F.broadcast(keys.where(F.col("count") > max(1000, n_rows // hot_keys)).select("key"))
    counted = (F.count(F.lit(1)).alias("size"), F.max("doc_id").alias("keep"))
    often = rows.join(hot, "key", "left_semi").groupBy("key", "text").agg(*counted)
    seldom = rows.join(hot, "key", "left_anti").select("key", "text", F.lit(1).cast("long").alias("size"), F.col("doc_id").alias("keep"))
    placed = often.unionByName(seldom).withColumn("slot", slot).join(F.broadcast(directory), "slot")
    owned = placed.repartitionById(max(1, len(set(ranges.values()))), "range")
    # The owner has all rows of a range, so neither grouping moves rows; the first compares the texts' bytes.
    entries = owned.groupBy("range", "bucket", "key", "text").agg(F.sum("size").alias("size"), F.max("keep").alias("keep"))
    links = F.struct(F.sha2("text", 256).alias("digest"), "size", "keep")
    index = entries.select("range", "bucket", "key", "size", links.alias("link")).groupBy("range", "bucket", "key")
    index = index.agg(F.sum("size").alias("rows"), F.array_sort(F.collect_list("link")).alias("chain"))
    path = f"{shared_folder(spark)}/exact-index-{uuid.uuid4().hex}"
    index.write.partitionBy("range").parquet(path)
    return spark.read.schema(index.schema).parquet(path), directory


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    range_keys: int = 1 << 13,
    hot_keys: int = 1000,
    hash_of: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The copy with the largest id stays.  A null text counts as empty.  Rows
    with a null id are never kept unless every copy's id is null, in which
    case keep_id is null and ``kept`` is true.  Repeated (id, text) rows are
    all marked kept; other columns are ignored.  An empty table gives no rows.
    ``hash_of`` makes the 64-bit key of a text; any hash gives the same result.
    """
    rows = documents(docs, id_col, text_col).withColumn("key", hash_of(F.col("text")))
    index, directory = build_index(rows, capacity, range_keys, hot_keys)
    total = index.agg(F.sum("rows")).first()[0] or 0
    hot = F.col("rows") > F.lit(max(1000, total // hot_keys))
    slot = F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")
    probes = rows.select("doc_id", "key", F.sha2("text", 256).alias("digest"), slot.alias("slot")).join(F.broadcast(directory.select("slot", "bucket")), "slot")
    where = ["bucket", "key"]
    frequent = F.broadcast(index.where(hot).select(*where, "chain"))
    looked_up = probes.join(frequent, where, "left")
    found = looked_up.where("chain is not null")
    rest = looked_up.where("chain is null").drop("chain").join(index.where(~hot).select(*where, "chain").hint("merge"), where)
    entry = F.filter("chain", lambda e: e["digest"] == F.col("digest"))[0]
    return (
        found.unionByName(rest)
        .withColumn("entry", entry)
        .select(
            "doc_id",
            F.col("entry.keep").alias("keep_id"),
            F.col("entry.size").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("entry.keep")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


EXACT_DEDUP_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
