"""Suffix-array dedup: removes every byte inside a 200-byte string that starts anywhere else too.

1. Each 200-byte window names its anchor: the leftmost of its 32-byte strings
   with the smallest hash.  Equal windows name equal anchors at the same
   place, so two equal windows are two anchors whose surroundings agree.  A
   run of windows with one anchor is one row: (hash of the anchor, hash of the
   run's bytes, document, start, windows).
2. An anchor seen once can't have an equal window.  Runs that are seen twice
   as a whole are removed.  Copies are counted by map-side aggregates.
3. For runs that share an anchor but differ, the strings from the anchor to
   the run's end are sorted with those of the same anchor (deep-shallow: see
   ``suffix_sort``), likewise the reversed strings before it.  Strings are
   merged by falling common prefix, the smaller set into the larger; whoever
   gets a new neighbour on the left side learns how far a string with this
   right side agrees to the left.  Each such pair (left, right) of at least
   200 bytes together covers a stretch.  No pairs are listed.
   Anchors with more than ``block_runs`` different runs are cut into blocks,
   and each pair of blocks is one such job.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import materialise
from wordloom.llm.kernels import U64, mix, slices, small_batches, utf8, windows64
from wordloom.llm.suffix_sort import deep_shallow, lcp

LENGTH, GRAM = 200, 32
_SPAN = LENGTH - GRAM + 1
_BITS = U64(22)
_CHUNK = 1 << 19
_ODD = U64(0x9E3779B97F4A7C15)


def runs_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor, anchor's hash) of each run; text i ends before ``ends[i]``."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.view(U64)
    words, n = windows64(data), len(data) - GRAM + 1
    h = words[:n] * _ODD
    for step, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0x27D4EB2F165667C5)):
        h += words[step : step + n] * U64(odd)
    mix(h)
    least = (h >> _BITS << _BITS) | np.arange(n, dtype=U64)
    span = 1
    while span * 2 <= _SPAN:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (_SPAN - span)], least[_SPAN - span :])
    anchor = (least & ((U64(1) << _BITS) - U64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    window = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= ends[text[: len(anchor)]])
    if not len(window):
        return none, none, none, none, none.view(U64)
    named = anchor[window]
    first = np.flatnonzero(np.concatenate([[True], (named[1:] != named[:-1]) | (window[1:] != window[:-1] + 1)]))
    starts = window[first]
    return text[starts], starts, window[np.append(first[1:], len(window)) - 1] - starts + 1, named[first], h[named[first]]


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end text, low byte, high byte): texts together, or a long text's windows a chunk at a time."""
    for i, j in slices(offsets, _CHUNK):
        low, high = int(offsets[i]), int(offsets[j])
        while j - i == 1 and high - low > _CHUNK + LENGTH - 1:
            yield i, j, low, low + _CHUNK + LENGTH - 1
            low += _CHUNK
        yield i, j, low, high


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j, low, high in _chunks(offsets):
            part = data[low:high]
            text, start, windows, anchor, key = runs_of(part, np.minimum(offsets[i + 1 : j + 1], high) - low)
            if not len(start):
                continue
            raw = part.tobytes()
            run = [hashlib.blake2b(raw[a : a + n + LENGTH - 1], digest_size=8).digest() for a, n in zip(start.tolist(), windows.tolist(), strict=True)]
            place = (start + low - offsets[i:j][text]) << 20 | (anchor - start) << 10 | windows
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.frombuffer(b"".join(run), np.int64)), pa.array(ids[i:j][text]), pa.array(place)], names=["anchor", "run", "row", "place"])


def matched(right: list[bytes], left: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(string, bytes to the left, bytes to the right) that some other string shares with it, ``length`` or more together.

    String k is ``left[k]`` reversed, then ``right[k]``.  All stretches that
    any pair shares are covered by the stretches returned.
    """
    n, out = len(right), []
    if n == 2:
        r, l = lcp(right[0], right[1]), lcp(left[0], left[1])
        return [(0, l, r), (1, l, r)] if l + r >= length else []
    order, common = deep_shallow(right)
    by_left, _ = deep_shallow(left)
    rank = [0] * n
    for k, s in enumerate(by_left):
        rank[s] = k
    sets: list[list[int]] = [[rank[s]] for s in order]
    where = list(range(n))

    def home(k: int) -> int:
        while where[k] != k:
            where[k] = where[where[k]]
            k = where[k]
        return k

    for k in sorted((k for k in range(1, n) if common[k]), key=lambda k: -common[k]):
        r, a, b = common[k], home(k - 1), home(k)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        for x in small:
            at = bisect_left(large, x)
            for y in large[max(0, at - 1) : at + 1]:
                l = lcp(left[by_left[x]], left[by_left[y]])
                if l + r >= length:
                    out.append((by_left[x], l, r))
                    out.append((by_left[y], l, r))
        if len(small) == 1:
            large.insert(bisect_left(large, small[0]), small[0])
        else:
            sets[a] = sorted(large + small)
        sets[b] = []
        where[b] = a
    return out


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by job: each job's strings are matched; gives (row, low, high) of bytes to remove."""
    job, held = None, []

    def solve() -> list[tuple[int, int, int]]:
        strings = [(r["bytes"], r["place"] >> 10 & 1023) for r in held]
        found = matched([s[a:] for s, a in strings], [s[:a][::-1] for s, a in strings])
        out = []
        for k, l, r in found:
            if held[k]["single"]:
                middle = (held[k]["place"] >> 20) + (held[k]["place"] >> 10 & 1023)
                out.append((held[k]["row"], middle - l, middle + r))
        return out

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            now = (row["anchor"], row["c1"], row["c2"])
            if now != job:
                out += solve() if len(held) > 1 else []
                job, held = now, []
            held.append(row)
        yield _intervals(out)
    yield _intervals(solve() if len(held) > 1 else [])


def _intervals(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "low", "high"])


def _by_key(rows: DataFrame, facts: DataFrame, key: list[str], hot: int) -> DataFrame:
    """rows joined to facts(*key, n, ...), one row for each key with n of ``rows``.

    Keys with ``hot`` rows and more, of which there are few, are broadcast, so
    their rows stay where they are; the others meet in a shuffled join.
    """
    names = [c for c in facts.columns if c not in (*key, "n")]
    often = facts.where(F.col("n") >= hot).select(*key, F.lit(True).alias("often"), *(F.col(c).alias(f"often_{c}") for c in names))
    marked = rows.join(F.broadcast(often), key, "left")
    found = marked.where("often").select(*rows.columns, *(F.col(f"often_{c}").alias(c) for c in names))
    seldom = facts.where(F.col("n") < hot).select(*key, *names)
    return found.unionByName(marked.where("often is null").select(*rows.columns).join(seldom, key).select(*rows.columns, *names))


def repeated_stretches(rows: DataFrame, block_runs: int = 20_000, hot_keys: int = 1000) -> DataFrame:
    """(row, low, high): byte ranges of rows(row, text) that consist of windows which start elsewhere too."""
    anchors = materialise(rows.mapInArrow(_anchor_rows, "anchor long, run long, row long, place long"), "anchors")
    hot = max(10_000, anchors.count() // hot_keys)  # so at most ``hot_keys`` keys are hot
    seen = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("low"), F.max("run").alias("high")).where("n > 1")
    seen = materialise(seen.select("anchor", "n", (F.col("low") != F.col("high")).alias("mixed")), "seen-anchors")
    shared = materialise(_by_key(anchors, seen, ["anchor"], hot), "shared-anchors")
    start, windows = F.shiftright("place", 20), F.col("place").bitwiseAND(1023)
    same = shared.where("not mixed").select("row", start.alias("low"), (start + windows + LENGTH - 1).alias("high"))
    runs = shared.where("mixed").groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place")).alias("first"))
    runs = materialise(runs.select("anchor", "run", "n", (F.col("n") == 1).alias("single"), "first.row", "first.place"), "runs")
    again = _by_key(shared.where("mixed").drop("mixed"), runs.where("not single").select("anchor", "run", "n"), ["anchor", "run"], hot)
    again = again.select("row", start.alias("low"), (start + windows + LENGTH - 1).alias("high"))
    crowded = runs.groupBy("anchor").count().where(F.col("count") > block_runs).withColumn("blocks", F.expr(f"cast((count + {block_runs - 1}) div {block_runs} as int)")).select("anchor", "blocks")
    placed = runs.join(crowded, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("c", F.pmod("run", F.col("blocks")).cast("int"))
    jobs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("row", F.struct("anchor", "run", "single", "place", F.least("c", "other").alias("c1"), F.greatest("c", "other").alias("c2")).alias("job"))
    wanted = jobs.groupBy("row").agg(F.collect_list("job").alias("jobs"))
    binary = F.col("text").cast("binary")
    strings = rows.join(wanted, "row").select("row", binary.alias("text"), F.explode("jobs").alias("job"))
    strings = strings.select(
        "row",
        "job.*",
        F.expr(f"substring(text, cast(shiftright(job.place, 20) + 1 as int), cast((job.place & 1023) + {LENGTH - 1} as int))").alias("bytes"),
    )
    sorted_jobs = strings.repartition("anchor", "c1", "c2").sortWithinPartitions("anchor", "c1", "c2", "run")
    partly = sorted_jobs.select("row", "anchor", "single", "place", "c1", "c2", "bytes").mapInArrow(_stretches, "row long, low long, high long")
    return same.unionByName(again).unionByName(partly)


def union_of(lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges of a union of half-open ranges."""
    if not len(lows):
        return lows, highs
    order = np.argsort(lows, kind="stable")
    lows, highs = lows[order], np.maximum.accumulate(highs[order])
    first = np.concatenate([[True], lows[1:] > highs[:-1]])
    at = np.flatnonzero(first)
    return lows[at], highs[np.append(at[1:], len(lows)) - 1]


def _cut(keep_text: bool, carry: tuple[str, ...]):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text + list(carry)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = []
            lows, highs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for text, low, high in zip(batch.column(1).to_pylist(), lows, highs, strict=True):
                raw = text.encode()
                a, b = union_of(np.array(low or [], np.int64), np.array(high or [], np.int64))
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
                kept = b"".join([raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)])
                out.append((len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(columns[4], pa.string())] * keep_text + batch.columns[4:], names=names)

    return task


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining text, and the columns to carry).

    Bytes are UTF-8; a null text counts as empty.  In ``kept`` a character cut
    in two is left out.  Texts of any length are read whole.  Repeated rows
    are copies of each other, null ids are allowed, other columns are ignored,
    an empty table gives no rows.
    """
    carried = [f"carried_{k}" for k in range(len(carry))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)))
    ids = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    # Rows are known by their id, or by a hash of id and text where ids repeat or are null.
    row = F.col("doc_id") if ids.isEmpty() else F.xxhash64("doc_id", "text", F.octet_length("text"))
    rows = rows.withColumn("row", row)
    spans = repeated_stretches(rows.select("row", "text")).groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    spans = spans.select("row", F.col("spans.low").alias("lows"), F.col("spans.high").alias("highs"))
    joined = rows.join(spans, "row", "left").select("doc_id", "text", "lows", "highs", *carried)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text
    schema += "".join(f", `{c}` {rows.schema[n].dataType.simpleString()}" for c, n in zip(carry, carried, strict=True))
    return joined.mapInArrow(_cut(keep_text, carry), schema)
