"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line) is hashed to a wide vector, and a text's fingerprint is
the sum of its paragraphs' vectors.  The vector has two parts:

* eight 64-bit lanes from a 512-bit digest, summed modulo 2 ** 64, for
  equality; and
* 256 signed lanes, summed modulo 2 ** 32: every 16-byte window inside the
  paragraph (and the paragraph as a whole) adds +1 or -1 to a lane chosen by
  its hash.  The scalar product of two such sums estimates what the texts
  share, whatever their lengths, so likeness can be read off two fingerprints.

Sums don't depend on the order of paragraphs; a paragraph is inserted or
deleted by adding or subtracting its vector (``combine``).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm.common import documents
from wordloom.llm.kernels import U64, mix, slices, small_batches, windows64

WORDS, LANES, WINDOW = 8, 256, 16
_EXACT = WORDS * 8


_PIECE = 1 << 20


def _long_vector(text: bytes, size: int = _PIECE) -> tuple[np.ndarray, np.ndarray]:
    """``vectors`` of one text, added up over pieces: whole paragraphs for digests, runs of windows for likeness."""
    exact, sums = np.zeros(WORDS, U64), np.zeros((LANES, 2), np.int64)
    at = 0
    while at <= len(text):
        cut = text.find(b"\n", min(at + size, len(text)))
        cut = len(text) if cut < 0 else cut
        digests = np.frombuffer(b"".join([hashlib.blake2b(p).digest() for p in text[at:cut].split(b"\n")]), "<u8").reshape(-1, WORDS)
        exact = exact + np.add.reduce(digests, axis=0)
        whole = digests[:, 0]
        np.add.at(sums, ((whole & U64(LANES - 1)).astype(np.int64), (whole >> U64(63)).astype(np.int64)), 1)
        at = cut + 1
    for a in range(0, len(text), size):
        data = np.frombuffer(text, np.uint8, min(size + WINDOW - 1, len(text) - a), a)
        first = windows64(data)
        if len(first) > 8:
            h = mix(first[:-8] * U64(0x9E3779B97F4A7C15) + first[8:] * U64(0xC2B2AE3D27D4EB4F))
            lines = np.zeros(len(data) + 1, np.int32)
            np.cumsum(data == 10, out=lines[1:])
            h = h[lines[WINDOW:] == lines[: len(lines) - WINDOW]]
            sums += np.bincount((h >> U64(56)).astype(np.int64) * 2 + (h >> U64(20) & U64(1)).astype(np.int64), minlength=2 * LANES).reshape(LANES, 2)
    return exact, (sums[:, 0] - sums[:, 1]).astype(np.int32)


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(equality lanes, likeness lanes) of each text; long ones are walked in pieces."""
    if any(len(t) > 4 * _PIECE for t in texts):
        found = [_long_vector(t) for t in texts]
        return np.stack([f[0] for f in found]), np.stack([f[1] for f in found])
    paragraphs = [t.split(b"\n") for t in texts]
    counts = np.fromiter(map(len, paragraphs), np.int64, len(texts))
    digests = b"".join([hashlib.blake2b(p).digest() for ps in paragraphs for p in ps])
    exact = np.frombuffer(digests, "<u8").reshape(-1, WORDS)
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(texts)), counts)
    whole = exact[:, 0]
    cells = (owner * LANES + (whole & U64(LANES - 1)).astype(np.int64)) * 2 + (whole >> U64(63)).astype(np.int64)
    sums = np.bincount(cells, minlength=len(texts) * LANES * 2)
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    first = windows64(data)
    if len(first) > 8:
        h = mix(first[:-8] * U64(0x9E3779B97F4A7C15) + first[8:] * U64(0xC2B2AE3D27D4EB4F))
        lines = np.zeros(len(data) + 1, np.int32)
        np.cumsum(data == 10, out=lines[1:])
        inside = np.flatnonzero(lines[WINDOW:] == lines[: len(lines) - WINDOW])
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts)), lengths + 1)[inside]
        h = h[inside]
        sums = sums + np.bincount((owner * LANES + (h >> U64(56)).astype(np.int64)) * 2 + (h >> U64(20) & U64(1)).astype(np.int64), minlength=len(sums))
    sums = sums.reshape(len(texts), LANES, 2)
    return np.add.reduceat(exact, starts, axis=0), (sums[:, :, 0] - sums[:, :, 1]).astype(np.int32)


def to_text(exact: np.ndarray, lanes: np.ndarray) -> str:
    """The printed form: the equality lanes in hex, then the likeness lanes in base64."""
    return exact.astype("<u8").tobytes().hex() + base64.b64encode(lanes.astype("<i4").tobytes()).decode()


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """The lanes of a printed fingerprint."""
    return np.frombuffer(bytes.fromhex(fingerprint[: 2 * _EXACT]), "<u8"), np.frombuffer(base64.b64decode(fingerprint[2 * _EXACT :]), "<i4")


def combine(one: str, other: str, sign: int = 1) -> str:
    """The fingerprint of both multisets of paragraphs together, or of ``one`` without ``other`` where sign is -1."""
    (a, x), (b, y) = from_text(one), from_text(other)
    with np.errstate(over="ignore"):
        return to_text(a + b, x + y) if sign > 0 else to_text(a - b, x - y)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Estimated overlap of rows of two sets of vectors, 0 to 1; equal vectors give exactly 1."""
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    dot = np.einsum("ij,ij->i", x, y)
    rest = np.einsum("ij,ij->i", x, x) + np.einsum("ij,ij->i", y, y) - dot
    out = np.clip(np.divide(dot, rest, out=np.zeros(len(dot)), where=rest > 0), 0, 1)
    return np.where((a[0] == b[0]).all(axis=1) & (x == y).all(axis=1), 1.0, out)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        texts, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        ends = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(a) + len(b) for a, b in zip(texts, following, strict=True)], out=ends[1:])
        for i, j in slices(ends, 1 << 21):
            own, then = texts[i:j], following[i:j]
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(own, then, strict=True)]
            changed = [t.encode() for t in edited]
            # A row's next document is mostly the row below: those vectors are made once.
            at = {t: k for k, t in enumerate(own)}
            more = [t for t in dict.fromkeys(then) if t not in at]
            at |= {t: len(own) + k for k, t in enumerate(more)}
            exact, lanes = vectors([t.encode() for t in [*own, *more]])
            mine, new = (exact[: j - i], lanes[: j - i]), vectors(changed)
            after = [at[t] for t in then]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array([len(t) for t in own], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
                    pa.array([to_text(a, b) for a, b in zip(*mine, strict=True)], pa.string()),
                    pa.array([to_text(a, b) for a, b in zip(*new, strict=True)], pa.string()),
                    pa.array(likeness(mine, new)),
                    pa.array(likeness(mine, (exact[after], lanes[after]))),
                ],
                names=[c.split()[0] for c in _SCHEMA.split(", ")],
            )


def with_next_text(rows: DataFrame, ranges: int, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Adds ``next_text``: the text of the row next by (doc_id, text), nulls first; the last row gets the first row's.

    Rows are cut into ``ranges`` id ranges; each range looks ahead by itself,
    and only its last row is joined with the first row of the range after it.
    """
    bounds = rows.select(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else None
    at = F.size(F.filter(F.lit(sorted(set(bounds))), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at).cast("int"))
    order = [F.col("doc_id").asc_nulls_first(), "text"]
    firsts = rows.groupBy("range").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), "text"))["text"].alias("first"), F.count(F.lit(1)).alias("n"))
    by_range = Window.orderBy("range")  # one row a range
    size = firsts.agg(F.sum(F.octet_length("first"))).first()[0] or 0
    nexts = firsts.select("range", F.coalesce(F.lead("first").over(by_range), F.first("first").over(by_range)).alias("wrapped"))
    inside = rows.withColumn("ahead", F.lead("text").over(Window.partitionBy("range").orderBy(*order)))
    keyed = inside.withColumn("edge", F.when(F.col("ahead").isNull(), F.col("range")))
    nexts = nexts.withColumnRenamed("range", "edge")
    joined = keyed.join(F.broadcast(nexts) if size <= broadcast_bytes else nexts, "edge", "left")
    return joined.select("doc_id", "text", F.coalesce("ahead", "wrapped").alias("next_text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints every text and its edited text (see the module's text).

    The edited text has its last floor(n_chars / 2) code points replaced by as
    many (or all) of the next document's first ones.  One row per input row;
    a null text counts as empty; null ids come first in the order; repeated
    rows are ordered by text; a table of one row is its own next; an empty
    table gives no rows; other columns are ignored.
    """
    if ranges is None:
        ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_next_text(documents(docs, id_col, text_col), ranges).mapInArrow(_task, _SCHEMA)


def fingerprint_column(text: Column) -> Column:
    """The fingerprint of a text column; a null text counts as empty."""

    @F.pandas_udf("string")
    def of(texts):
        import pandas as pd

        return pd.Series([to_text(a, b) for a, b in zip(*vectors([(t or "").encode() for t in texts]), strict=True)])

    return of(text)
