"""Vector codes: each vector is cut into parts, and each part is named by its nearest entry of a codebook.

Components are whole numbers, so every step is exact and no order of summing
matters.  The nearest entry is found by annular pruning: a codebook's entries
are sorted by norm; the entries next to a part's norm give a first distance;
no entry whose norm differs from the part's by more than that can be nearer,
so a binary search bounds the ring of norms that is left, both ends included,
and that ring is evaluated in full.

Only codebooks (entries x components) and their sums reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 24  # of a component; squares and their sums then fit 64 bits
_ROWS = 4096  # vectors at once


class Ring:
    """The entries of one codebook by norm."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]
        self.evaluated = 0

    def _distance(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        self.evaluated += len(at)
        return ((x - self.entries[at]) ** 2).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row; of equal distances the lowest index wins."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        above = np.minimum(np.searchsorted(self.norms, norm), len(self.norms) - 1)
        best = np.minimum(self._distance(x, above), self._distance(x, np.maximum(above - 1, 0)))
        # A little more than the distance, so that rounding never shuts out an entry on the rim.
        reach = np.sqrt(best.astype(np.float64))
        reach += 1e-9 * (reach + norm + 1)
        low, high = np.searchsorted(self.norms, norm - reach, side="left"), np.searchsorted(self.norms, norm + reach, side="right")
        many = high - low
        first = np.cumsum(many) - many
        owner = np.repeat(np.arange(len(x)), many)
        entry = np.arange(len(owner)) - np.repeat(first, many) + np.repeat(low, many)
        distance = self._distance(x[owner], entry)
        least = np.minimum.reduceat(distance, first)
        index = np.where(distance == least[owner], self.order[entry], len(self.order))
        return np.minimum.reduceat(index, first), least


def whole_numbers(column: pa.Array, length: int) -> np.ndarray:
    """floor(SCALE * x) of a list column without nulls, one row for each vector."""
    if not len(column):
        return np.zeros((0, length), np.int64)
    sizes = column.value_lengths().to_numpy()
    if (sizes != length).any():
        raise ValueError(f"vectors of {length} and of {int(sizes[sizes != length][0])} components in one table")
    x = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(x).max(initial=0) > LIMIT:
        raise ValueError(f"a component is beyond {LIMIT / SCALE}")
    return x.astype(np.int64).reshape(len(column), length)


def assign(vectors: np.ndarray, rings: list[Ring]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), a column for each part."""
    found = [r.nearest(x) for r, x in zip(rings, np.split(vectors, len(rings), axis=1), strict=True)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _vectors(batches: Iterator[pa.RecordBatch], column: int, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            part = batch.slice(k, _ROWS)
            yield part, whole_numbers(part.column(column), length)


def _sums(books, length: int):
    """Of each part and entry: the number of parts it is nearest to, then their sums by component; one number a row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings, width = [Ring(b) for b in books.value], length // PARTS
        most = max(len(b) for b in books.value)
        total = np.zeros((PARTS, most, width + 1), np.int64)
        for _, x in _vectors(batches, 0, length):
            codes = assign(x, rings)[0]
            for p, part in enumerate(np.split(x, PARTS, axis=1)):
                order = np.argsort(codes[:, p], kind="stable")
                entry, at = np.unique(codes[order, p], return_index=True)
                total[p, entry, 0] += np.diff(np.append(at, len(order)))
                total[p, entry, 1:] += np.add.reduceat(part[order], at)
        # Components of used entries are sent even where they sum up to 0.
        place = np.flatnonzero(np.repeat(total[:, :, :1] > 0, width + 1, axis=2))
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(total.reshape(-1)[place])], names=["place", "total"])

    return task


def _codes(books, length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = [Ring(b) for b in books.value]
        for part, x in _vectors(batches, 2, length):
            codes, errors = assign(x, rings)
            text = codes.astype(np.uint8).tobytes().hex()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(errors.sum(1))], names=["vec_id", "label", "code", "error"])

    return task


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(vec_id, label, vector) of the rows whose vector has components, all of them there and finite."""
    v = F.col(vector_col).cast("array<double>")
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), v.alias("vector")).where(
        F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One codebook for each part, from the vectors of the smallest ids on; empty where there are no vectors."""
    spark = kept.sparkSession
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).toArrow().column(0).combine_chunks()
    first = first.chunk(0) if isinstance(first, pa.ChunkedArray) else first
    if not len(first):
        return []
    length = len(first[0])
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    books = [x.copy() for x in np.split(whole_numbers(first, length), parts, axis=1)]
    width = length // parts
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        sums = kept.select("vector").mapInArrow(_sums(sent, length), "place int, total long").groupBy("place").agg(F.sum("total").alias("total")).toArrow()
        total = np.zeros((parts, len(books[0]), width + 1), np.int64)
        total.reshape(-1)[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
        for book, own in zip(books, total, strict=True):
            used = own[:, 0] > 0
            book[used] = own[used, 1:] // own[used, :1]
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row for each vector that is kept.

    Rows whose vector is null or empty or holds null or non-finite components
    go.  Null ids come after all others, equal ids by vector, where codebooks
    begin; with fewer vectors than entries, codebooks are smaller.  Repeated
    rows stay and count as often as they occur.  Other columns are ignored; an
    empty table gives no rows.  Vectors of different lengths, of a length that
    isn't a multiple of ``PARTS``, or with components beyond ``LIMIT`` / 256
    raise ``ValueError``.
    """
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    label = kept.schema["label"].dataType.simpleString()
    books = train(kept)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    schema = f"vec_id long, label {label}, code string, error long"
    if not books:
        coded = kept.sparkSession.createDataFrame([], schema)
    else:
        sent = kept.sparkSession.sparkContext.broadcast(books)
        coded = materialise(kept.mapInArrow(_codes(sent, len(books) * books[0].shape[1]), schema), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if books:
        sums = materialise(sums, "label-errors")  # a plain table, so that a hot label's rows can be split
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def nearest(book: str) -> str:
        return f"(SELECT row, p, any_value(x) AS x, min({{'d': {distance}, 'e': e}}) AS best FROM parts JOIN {book} USING (p) GROUP BY row, p)"

    def moved(book: str) -> str:
        sums = f"SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM {nearest(book)}, width, range(1, w + 1) t(i) GROUP BY ALL"
        return f"(SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM ({sums}) GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"

    rounds = "".join(f"book{k + 1} AS MATERIALIZED {moved(f'book{k}')},\n" for k in range(ROUNDS))
    return f"""
WITH kept AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST) AS row, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
width AS (SELECT max(len(v)) // {PARTS} AS w FROM kept),
parts AS MATERIALIZED (SELECT row, p, v[p * w + 1:(p + 1) * w] AS x FROM kept, width, range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT p, row - 1 AS e, x AS c FROM parts WHERE row <= {ENTRIES}),
{rounds}coded AS MATERIALIZED (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM {nearest(f"book{ROUNDS}")} GROUP BY row),
digest AS (SELECT sha256(string_agg(y, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, i, c[i]::VARCHAR AS y FROM book{ROUNDS}, width, range(1, w + 1) t(i)))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), digest
"""


VECTOR_CODES_SQL = _sql()
