"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 2- and 3-grams of lower-cased code points are summed by
(language, bucket); the smoothed log-probability matrix has ``buckets`` rows
and a column for each language, is broadcast (its size is fixed by these two)
and documents are scored in sparse numpy batches.  The classifier is fitted on
at most about ``train_docs`` labelled documents, picked by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import documents, fold_of
from wordloom.llm.kernels import slices

BUCKETS = 1 << 15
_GAP = "  "  # stands before and after a text: no 3-gram reaches over two spaces


_PIECE = 1 << 20  # code points of a long text that are looked at together


def long_grams(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The buckets of one text's grams, in parts."""
    padded = _GAP + text.lower() + _GAP
    # A part begins with the two code points that the one before it ended with.
    for a in range(0, max(1, len(padded) - 2), _PIECE):
        yield _buckets_of(padded[a : a + _PIECE + 2], buckets)


def gram_buckets(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each 2- and 3-gram, first index of each text's); a text's grams begin in the gap before it and end in the gap after it."""
    lowered = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + len(_GAP)
    return _buckets_of(_GAP + _GAP.join(lowered) + _GAP, buckets), 2 * (np.cumsum(lengths) - lengths)


def _buckets_of(text: str, buckets: int) -> np.ndarray:
    """Buckets of the 2-gram and the 3-gram that begin at each place."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    two = points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] + points[2:] * np.uint32(0xC2B2AE3D)
    out = np.empty((len(three), 2), np.int32)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for k, h in enumerate((two[: len(three)] * np.uint32(0x27D4EB2F), three)):
        h = h ^ (h >> np.uint32(15))
        out[:, k] = (h * np.uint32(0x2C1B3C6D)) >> shift
    return out.ravel()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            for i, j in slices(ends):
                long = j == i + 1 and len(texts[i]) > 4 * _PIECE
                got = sum(np.bincount(g, minlength=BUCKETS) for g in long_grams(texts[i])) if long else np.bincount(gram_buckets(texts[i:j])[0], minlength=BUCKETS)
                sums[lang] = sums[lang] + got if lang in sums else got
    for lang, got in sums.items():
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(got[at].astype(np.int64))], names=["lang", "bucket", "n"])


class Model:
    """Languages, log priors and the log-probability matrix (bucket x language)."""

    def __init__(self, langs: list[str], priors: np.ndarray, matrix: np.ndarray):
        self.langs, self.priors, self.matrix = langs, priors, matrix

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, posterior) of each text; ``und`` and 0 where a text has no letter or nothing was learned."""
        if not self.langs or not texts:
            return ["und"] * len(texts), np.zeros(len(texts))
        if len(texts) == 1 and len(texts[0]) > 4 * _PIECE:
            # By counts of buckets: nothing as long as the text meets the matrix.
            counts = sum(np.bincount(g, minlength=len(self.matrix)) for g in long_grams(texts[0], len(self.matrix)))
            totals = (counts.astype(np.float64) @ self.matrix)[None] + self.priors
        else:
            grams, starts = gram_buckets(texts)
            totals = np.add.reduceat(self.matrix[grams], starts, axis=0).astype(np.float64) + self.priors
        best = totals.argmax(axis=1)
        posterior = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
        letters = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts))
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, posterior, 0.0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 40_000, folds: int = 5) -> Model:
    """Learns from labelled documents whose fold is not 0; at most about ``train_docs`` of them, picked by a hash of the id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.where((fold_of(F.col("doc_id"), folds) != 0) & F.col("lang").isNotNull())
    size = rows.select("doc_id", "lang").count()
    if size > train_docs:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20)) < int((1 << 20) * train_docs / size))
    counted = rows.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    shares = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(shares)
    matrix = np.full((BUCKETS, len(langs)), 0.5)
    for k, lang in enumerate(langs):
        part = counted[counted["lang"] == lang]
        matrix[part["bucket"].to_numpy(), k] += part["n"].to_numpy()
    priors = np.log(np.array([shares[x] for x in langs], dtype=np.float64) / max(1, sum(shares.values())))
    return Model(langs, priors, np.log(matrix / matrix.sum(axis=0)).astype(np.float32))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    ``held_out``: crc32 of the id as text is divisible by 5.  A null text, an
    empty one and one without a letter get ``und`` and score 0.  A tie goes to
    the language first by name.  Whole texts count, however long; repeated
    rows get the same answer; a null id counts as empty text for the fold;
    other columns are never read; an empty table gives no rows.
    """
    return with_prediction(documents(docs, id_col, text_col), model).select("doc_id", F.expr("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 5 = 0").alias("held_out"), "lang_pred", "score")


def with_prediction(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    width = max(1 << 16, (1 << 22) // max(1, len(model.langs)))

    def task(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = [t if isinstance(t, str) else "" for t in texts.to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(t) for t in values], dtype=np.int64)])
            names: list[str] = []
            scores = [np.zeros(0)]
            for i, j in slices(ends, width):
                got = held.value.score(values[i:j])
                names += got[0]
                scores.append(got[1])
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=["lang_pred", "score"])

    judged = F.arrow_udf(task, "lang_pred string, score double")
    found: Column = judged(F.col(text_col))
    return docs.withColumn("_judged", found).select(*docs.columns, F.col("_judged.lang_pred").alias("lang_pred"), F.col("_judged.score").alias("score"))
