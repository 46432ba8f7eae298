"""N-gram Jaccard join: all links between documents whose shingle sets overlap enough.

1. Every text becomes its set of 64-bit shingle hashes.  The tokens go once
   through a shuffle by hash, packed by bucket, and each bucket marks the
   tokens that occur in more than one set.  A set can only be linked if the
   share ``num / den`` of its tokens is marked, which leaves few sets.  Equal
   sets need no comparison: one stands for all.  The different sets left go
   through such buckets again, so that no token is marked for copies alone.
2. For the sets left, tokens are ordered by frequency, rarest first.  Two
   linked sets share a token among the first ``n - ceil(n * num / den) + 1``
   of each, so sets that share none of those can't be linked, directly or by
   way of others: the components of that candidate graph are blocks.
3. A prefix-tree join links the sets of each block.  A block with more than
   ``block_docs`` sets or ``block_tokens`` tokens is cut into chunks, sets with
   the same neighbour together.  Two chunks meet in one task if a prefix token
   occurs in both, and a set takes part only if it has such a token, so each
   pair of sets is compared once; the links found are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm.common import documents, materialise
from wordloom.llm.components import connected_components
from wordloom.llm.kernels import U64, mix, slices, small_batches
from wordloom.llm.shingles import shingle_sets
from wordloom.llm.trie_join import link_block

_PACKED = "bucket int, batch long, sets int, tokens binary, steps binary, info binary"
_COUNTED = "batch long, owners binary, shared binary, info binary"
_MAX_PARTITIONS = 20_000


def digest_of(tokens: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    return int(mix(np.array([np.add.reduce(mix(tokens.copy()), dtype=U64) ^ U64(len(tokens))], U64))[0].astype(np.int64))


def _batch(columns: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*columns, strict=True)) if columns else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def pack_slice(ids: np.ndarray, keys: np.ndarray, texts: list[bytes], buckets: int) -> list[tuple]:
    """Rows of ``_PACKED``: the slice's different sets, a row for each bucket that holds a token of theirs, and one about the documents.

    A token costs its 32 low bits and the step from its set's number to that
    of the token before, a byte as a rule, whatever the number of buckets.
    """
    return pack_sets(ids, keys, shingle_sets(texts), buckets)


def pack_sets(ids: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], buckets: int) -> list[tuple]:
    """The same for sets of tokens."""
    sizes = np.array([len(s) for s in sets], np.int64)
    digests = np.array([digest_of(s) for s in sets], np.int64)
    _, first, of = np.unique(digests, return_index=True, return_inverse=True)
    different = [sets[k] for k in first]
    tokens = np.concatenate(different)
    owner = np.repeat(np.arange(len(first)), sizes[first])
    bucket = ((tokens >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")  # by bucket, then by set
    low, owner, bucket = tokens.astype("<u4")[order], owner[order], bucket[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    steps = np.diff(owner, prepend=0)
    steps[starts] = owner[starts]
    # The same key names this slice in every bucket, whichever executor makes it again.
    batch = int(mix(np.array([np.add.reduce(mix(ids.view(U64) + mix(digests.view(U64).copy())), dtype=U64)], U64))[0].astype(np.int64))
    info = np.concatenate([ids, keys, digests, sizes, of]).astype("<i8").tobytes()
    rows = [(batch % buckets, batch, len(first), b"", b"", info)]
    edges = [*starts.tolist(), len(low)]
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        step = steps[a:z]
        width = "<u1" if step.max() < 1 << 8 else "<u4"
        rows.append((int(bucket[a]), batch, len(first), low[a:z].tobytes(), step.astype(width).tobytes(), b""))
    return rows


def _pack(buckets: int, rows: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, rows):
            ids = np.array([-(2**63) if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
            for i, j in slices(ends, rows << 11):
                yield _batch(pack_slice(ids[i:j], keys[i:j], texts[i:j], buckets), _PACKED)

    return task


def _pack_digests(buckets: int, rows: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, rows):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            sets = [s.values.to_numpy().view(U64) for s in lists]
            ends = np.concatenate([[0], np.cumsum([8 * len(s) for s in sets], dtype=np.int64)])
            for i, j in slices(ends, rows << 11):
                yield _batch(pack_sets(ids[i:j], ids[i:j], sets[i:j], buckets), _PACKED)

    return task


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by bucket: in each bucket marks the tokens that occur in more than one set and sums them by set."""
    held: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if row["info"]:
                yield _batch([(row["batch"], b"", b"", row["info"])], _COUNTED)
                continue
            if held and held[0]["bucket"] != row["bucket"]:
                yield _bucket_sums(held)
                held = []
            held.append(row)
    if held:
        yield _bucket_sums(held)


def _bucket_sums(rows: list[dict]) -> pa.RecordBatch:
    low = np.concatenate([[0], np.cumsum([r["sets"] for r in rows])])
    tokens = np.concatenate([np.frombuffer(r["tokens"], "<u4") for r in rows])
    parts = []
    for k, r in enumerate(rows):
        step = np.frombuffer(r["steps"], "<u1" if 4 * len(r["steps"]) == len(r["tokens"]) else "<u4")
        parts.append(np.cumsum(step, dtype=np.int64) + low[k])
    owner = np.concatenate(parts)
    keys = tokens.astype(U64) << U64(32) | np.arange(len(tokens), dtype=U64)
    keys.sort()
    token, at = keys >> U64(32), (keys & U64(0xFFFFFFFF)).astype(np.int64)
    same = token[1:] == token[:-1]
    several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    shared = np.bincount(owner[at[several]], minlength=low[-1])
    out = []
    for k, r in enumerate(rows):
        mine = shared[low[k] : low[k + 1]]
        some = np.flatnonzero(mine)
        if len(some):
            out.append((r["batch"], some.astype("<u4").tobytes(), mine[some].astype("<u4").tobytes(), b""))
    return _batch(out, _COUNTED)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the buckets' counts of each slice of documents, whose rows stand side by side."""
    now, infos, parts = None, [], []

    def solve() -> Iterator[pa.RecordBatch]:
        for info in infos:
            doc, key, digest, n, of = np.frombuffer(info, "<i8").reshape(5, -1)
            shared = np.zeros(len(of), np.int64)
            for owners, counts in parts:
                shared[np.frombuffer(owners, "<u4")] += np.frombuffer(counts, "<u4")
            # Equal slices (repeated rows) were added up under one key; all their tokens are shared.
            yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == -(2**63)), pa.array(key), pa.array(n), pa.array(np.minimum(shared[of], n)), pa.array(digest)], names=["doc_id", "key", "n_shingles", "shared", "digest"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["batch"] != now:
                yield from solve()
                now, infos, parts = row["batch"], [], []
            if row["info"]:
                infos.append(row["info"])
            else:
                parts.append((row["owners"], row["shared"]))
    yield from solve()


def shared_counts(rows: DataFrame, bucket_bytes: int = 12 << 20) -> DataFrame:
    """(doc_id, key, n_shingles, shared, digest) of rows(doc_id, key, text): how many of a set's tokens other rows hold too.

    An equal set of another slice counts as another set here, so ``shared`` is
    never too small.  Slices grow with the number of buckets, as far as one
    Arrow batch goes.
    """
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // bucket_bytes))
    return _shared(rows.mapInArrow(_pack(buckets, max(1000, buckets)), _PACKED), buckets)


def shared_tokens(sets: DataFrame, bucket_tokens: int = 2 << 20) -> DataFrame:
    """(digest, n_shingles, shared) of different sets(digest, n, tokens)."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-total // bucket_tokens))
    packed = sets.select("digest", "n", "tokens").mapInArrow(_pack_digests(buckets, max(1000, buckets)), _PACKED)
    return _shared(packed, buckets).select(F.col("key").alias("digest"), "n_shingles", "shared")


def _shared(packed: DataFrame, buckets: int) -> DataFrame:
    partitions = min(buckets, _MAX_PARTITIONS)
    packed = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    counted = packed.mapInArrow(_count, _COUNTED)
    summed = counted.repartition(partitions, "batch").sortWithinPartitions("batch")
    return summed.mapInArrow(_sum_up, "doc_id long, key long, n_shingles long, shared long, digest long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different text of the task once."""
    seen: set[tuple[int, int]] = set()
    for batch in small_batches(batches):
        named = [((key, hash(t)), t) for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        texts = [t.encode() for name, t in named if not (name in seen or seen.add(name))]
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        for i, j in slices(ends, 1 << 21):
            sets = shingle_sets(texts[i:j])
            flat = pa.array(np.concatenate(sets).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([pa.array([digest_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), lists], names=["digest", "n", "tokens"])


def _link(num: int, den: int):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("digest", ignore_index=True)
        second = rows["second"].tolist() if rows["second"].any() else None
        groups = link_block([(int(n), t.tolist()) for n, t in zip(rows["n"], rows["tokens"], strict=True)], num, den, second)
        return pd.DataFrame({"a": rows["digest"], "b": rows["digest"].to_numpy()[groups]})

    return block


def _chunk_pairs(prefix: DataFrame, large: DataFrame, docs: int, tokens: int) -> DataFrame:
    """(c1, c2, digest, second): the pairs of chunks that share a prefix token, and their sets that have such a token.

    ``prefix``: (token, digest); ``large``: (digest, n) of the sets of large
    blocks.  A chunk holds sets whose smallest neighbour is the same, about
    ``docs`` of them and ``tokens`` tokens.
    """
    members = prefix.join(large, "digest")
    least = members.groupBy("token").agg(F.min("digest").alias("a"), F.count(F.lit(1)).alias("df")).where("df > 1").select("token", "a")
    members = members.join(least, "token")
    near = materialise(members.groupBy("digest", "n").agg(F.min("a").alias("near")), "near")
    parts = near.groupBy("near").agg(F.expr(f"cast(greatest((count(1) + {docs - 1}) div {docs}, (sum(n) + {tokens - 1}) div {tokens}) as int)").alias("parts"))
    # Chunks that get one number by chance are one larger chunk.
    chunk = F.xxhash64("near", F.pmod(F.xxhash64("digest"), F.col("parts")))
    placed = materialise(members.select("token", "digest").join(near.join(parts, "near").select("digest", chunk.alias("chunk")), "digest"), "placed")
    others = placed.select("token", F.col("chunk").alias("other")).distinct()
    met = placed.join(others, "token").select("digest", "chunk", "other").distinct()
    return met.select(F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "digest", (F.col("chunk") > F.col("other")).alias("second"))


def link_sets(sets: DataFrame, num: int = 75, den: int = 100, block_docs: int = 4000, block_tokens: int = 1 << 22) -> DataFrame:
    """(a, b) links between the digests of sets(digest, n, tokens) that connect exactly what is connected by similarity."""
    tokens = sets.select("digest", "n", F.explode("tokens").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = tokens.join(common, "token")
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("df", "token"))
    several = F.count(F.lit(1)).over(Window.partitionBy("digest"))
    first = F.col("n") - F.expr(f"(n * {num} + {den - 1}) div {den}") + 1
    prefix = held.withColumn("rank", rank + F.col("n") - several).where(F.col("rank") <= first).select("token", "digest")
    prefix = materialise(prefix, "prefix")
    anchor = prefix.groupBy("token").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).where("a < z").select("token", "a")
    candidates = prefix.join(anchor, "token").where("a != digest").select("a", F.col("digest").alias("b")).distinct()
    blocks = connected_components(candidates).select(F.col("node").alias("digest"), F.col("component").alias("block"))
    blocks = materialise(blocks.join(sets.select("digest", "n"), "digest"), "blocks")
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))
    fits = (F.col("docs") <= block_docs) & (F.col("tokens") <= block_tokens)
    small = blocks.join(sizes.where(fits), "block").select("digest", "block", F.lit(False).alias("second"))
    schema = "a long, b long"
    links = sets.join(small, "digest").groupBy("block").applyInPandas(_link(num, den), schema)
    large = sizes.where(~fits).select("block")
    if large.isEmpty():
        return links
    members = blocks.join(large, "block", "left_semi").select("digest", "n")
    pairs = materialise(_chunk_pairs(prefix, members, max(1, block_docs // 2), block_tokens // 2), "chunk-pairs")
    # These tasks are long for their bytes, so each goes its own way.
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return links.unionByName(sets.join(pairs, "digest").repartition(tasks, "c1", "c2").groupBy("c1", "c2").applyInPandas(_link(num, den), schema))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100, block_docs: int = 4000) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Documents link when intersection / union of their sets of distinct 5-word
    shingles is ``num / den`` or more; component_id is the smallest id that
    links reach, the document's own included.  A text of one to four words has
    one shingle; a text without words, an empty one and a null one have none
    and link with nothing.  Null ids don't name a component unless all its ids
    are null.  Repeated rows stay, other columns are ignored, an empty table
    gives no rows.
    """
    rows = documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("key"), "text")
    counted = materialise(shared_counts(rows), "shared")
    groups = counted.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n"), F.max("shared").alias("shared"), F.min("key").alias("key"))
    # Texts are found by their key, so null and repeated ids take part; a key that two texts share only adds a set.
    hopeful = groups.where(F.col("shared") * den >= F.col("n") * num).select("key")
    sets = rows.select("key", "text").join(hopeful.distinct(), "key", "left_semi").mapInArrow(_sets, "digest long, n long, tokens array<long>").where("n > 0").dropDuplicates(["digest"])
    sets = materialise(sets, "sets")
    hopeful = shared_tokens(sets).where(F.col("shared") * den >= F.col("n_shingles") * num).select("digest")
    sets = materialise(sets.join(hopeful, "digest", "left_semi"), "hopeful-sets")
    links = materialise(link_sets(sets, num, den, block_docs).where("a != b").distinct(), "links")
    joined = connected_components(links).withColumnRenamed("node", "digest")
    named = groups.join(joined, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"), F.sum("copies").alias("members"))
    # Only documents that share a component with others are looked up.
    several = named.join(smallest.where("members > 1"), "component").select("digest", "component_id")
    return counted.join(several, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
