"""Sharding by minimax contiguous partition.

Equal texts are one atomic group.  Groups are ordered by a 64-bit hash of the
text; neighbouring groups share one of 2 ** ``UNIT_BITS`` ordered units, so
equal texts always share a unit.  Only the unit totals (a bounded table) reach
the driver.  There the smallest feasible shard capacity is found by binary
search, each guess checked greedily over the ordered sizes.  No cut can beat it
without splitting a unit.  Of the cuts within that capacity one whose smallest
shard is largest is taken, and neighbours are evened out, so a large unit does
not make the other shards large.

Slots are gapless within a shard: rows of the units before, then rows of the
sub-units before, then the rank in the sub-unit.  Units with many rows (a text
copied into a third of all rows) are dealt into sub-units by a hash of the id,
so no window task sees more than about ``sub_rows`` rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm.common import documents

UNIT_BITS = 16


def greedy_cuts(sizes: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """First index of each shard when shards are filled in order up to ``capacity``; None if they don't suffice."""
    ends = np.cumsum(sizes)
    cuts, start, before = [], 0, 0
    while start < len(sizes):
        if len(cuts) == shards:
            return None
        cuts.append(start)
        end = int(np.searchsorted(ends, before + capacity, side="right"))
        if end == start:
            return None
        start, before = end, int(ends[end - 1])
    return cuts


def minimax_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """Cuts at the smallest feasible capacity, found by binary search."""
    if not len(sizes):
        return []
    low, high = int(sizes.max()), int(sizes.sum())
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return greedy_cuts(sizes, low, shards)


def balanced_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """Cuts into ``shards`` parts (or one for each size) at the smallest feasible capacity, the smallest part as large as can be."""
    n, parts = len(sizes), min(shards, len(sizes))
    if not n:
        return []
    ends = np.concatenate([[0], np.cumsum(sizes)])
    capacity = int(np.diff(ends[[*minimax_cuts(sizes, shards), n]]).max())
    first = np.searchsorted(ends, ends - capacity, side="left")

    def starts(least: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Behind the last start of a part that ends at each place, and what places j parts of ``least`` to ``capacity`` can reach."""
        last = np.minimum(np.searchsorted(ends, ends - least, side="right"), np.arange(n + 1))
        reached = [np.arange(n + 1) == 0]
        for _ in range(parts):
            seen = np.concatenate([[0], np.cumsum(reached[-1])])
            reached.append(seen[np.maximum(first, last)] > seen[first])
        return last, reached

    low, high = 0, int(ends[-1]) // parts
    while low < high:
        middle = (low + high + 1) // 2
        if starts(middle)[1][-1][n]:
            low = middle
        else:
            high = middle - 1
    last, reached = starts(low)
    cuts = [n]
    for j in range(parts, 0, -1):
        i = cuts[0]
        able = first[i] + np.flatnonzero(reached[j - 1][first[i] : last[i]])
        cuts.insert(0, int(able[np.abs(ends[i] - ends[able] - ends[i] / j).argmin()]))
    # A cut moves only where the larger of its two parts shrinks, so both bounds hold.
    moved = True
    while moved:
        moved = False
        for k in range(1, parts):
            a, c = cuts[k - 1], cuts[k + 1]
            half = int(np.searchsorted(ends, (int(ends[a]) + int(ends[c])) // 2))
            larger = {p: max(ends[p] - ends[a], ends[c] - ends[p]) for p in (cuts[k], half - 1, half, half + 1) if a < p < c}
            best = min(larger, key=larger.get)
            if larger[best] < larger[cuts[k]]:
                cuts[k], moved = best, True
    return cuts[:-1]


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, sub_rows: int = 20_000) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus ``overhead``.  Law ``bytes``:
    shard sizes are near equal.  A null text counts as empty (size is the
    overhead); repeated rows each get a slot; null ids sort first; other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length("text").cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("key"),
    )
    rows = rows.withColumn("unit", F.shiftrightunsigned("key", 64 - UNIT_BITS).cast("int"))
    units = sorted(rows.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect())
    sizes = np.array([u["bytes"] for u in units], dtype=np.int64)
    cuts = balanced_cuts(sizes, shards)
    placed, number = [], -1
    for i, u in enumerate(units):
        if number + 1 < len(cuts) and i == cuts[number + 1]:
            number, base = number + 1, 0
        placed.append((u["unit"], number, base, -(-u["n"] // sub_rows)))
        base += u["n"]
    plan = spark.createDataFrame(placed, "unit int, shard int, base long, parts long")
    rows = rows.join(F.broadcast(plan), "unit").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", F.lit("part")), "parts")).otherwise(F.lit(0)))
    crowded = rows.where("parts > 1").groupBy("unit", "part").count()
    before = Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = crowded.select("unit", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("unit", "part").orderBy("key", "doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("rank", rank)
        .join(offsets, ["unit", "part"], "left")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.coalesce("offset", F.lit(0)) + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
