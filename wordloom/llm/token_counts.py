"""Token counts behind a cache of content digests.

The cache is a folder of Parquet tables (digest, n_tokens) by tokenizer
version.  A version is a digest of the tokenizer's file, the library's version
and the rule by which content is normalised, so counts of another tokenizer
are never mixed up.  Each call appends one folder in one commit: a call that
fails leaves the cache as it was, and two calls at once don't harm each other.

1. Texts are normalised and digested in the JVM; ids and digests are written.
2. Distinct digests are joined to the stored counts of this version.
3. One row of each digest without a count brings its text (the one with the
   smallest id; joined by digest and id, so that copies spread), and only
   those are encoded.
4. New counts are written and appended; digests are joined to counts.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from importlib.metadata import version as library_version

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import documents, materialise, shared_folder
from wordloom.llm.kernels import small_batches
from wordloom.llm.packing import WordIds

_BLANK = "[ \\t\\n\\r]+"
_CUT = re.compile("[ \t\n\r]")
_CHUNK = 1 << 19  # characters of a text that are encoded together
_CACHE = "digest binary, n_tokens long, version string, run string"


def drops_blanks(path: str) -> bool:
    """Whether runs of white space make no difference to the tokenizer, and no token reaches over one."""
    if not path.endswith(".json"):
        return False
    with open(path) as f:
        j = json.load(f)
    steps = (j.get("normalizer") or {}).get("normalizers") or [j.get("normalizer") or {}]
    squeezes = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
    cuts = (j.get("pre_tokenizer") or {}).get("pretokenizers") or [j.get("pre_tokenizer") or {}]
    dropped = any(c.get("type") == "Split" and c.get("behavior") == "Removed" and c.get("invert") and "\\s" in c.get("pattern", {}).get("Regex", "") for c in cuts)
    added = j.get("added_tokens") or []
    return squeezes and dropped and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in added)


def tokenizer_version(path: str) -> str:
    """Names the tokenizer: its file, its library and the rule of normalising."""
    with open(path, "rb") as f:
        content = hashlib.sha256(f.read()).hexdigest()
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    return hashlib.sha256(f"{content} {library} {library_version(library)} {'blanks' if drops_blanks(path) else 'as is'}".encode()).hexdigest()[:32]


def normalised(text: Column, path: str) -> Column:
    """The content that decides the count: runs of blanks as one space where the tokenizer drops them, else the text as it is."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(text, _BLANK, " ") if drops_blanks(path) else text


class Counter:
    """Counts the tokens of texts as the library gives them, without begin, end or added special tokens."""

    def __init__(self, path: str):
        self.words = self.whole = None
        if drops_blanks(path):
            self.words = WordIds(path)
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.whole = lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; where blanks make no difference, a long text is cut at blanks."""
        if self.words is None:
            return self.whole(texts)
        owner, pieces, held, out = [], [], 0, np.zeros(len(texts), np.int64)

        def encode() -> None:
            # Each piece ends with one id that stands for its end.
            np.add.at(out, owner, [len(ids) // 4 - 1 for ids in self.words.ids(pieces)])
            owner.clear()
            pieces.clear()

        for k, text in enumerate(texts):
            for piece in _pieces(text):
                owner.append(k)
                pieces.append(piece)
                held += len(piece)
                if held > _CHUNK:
                    encode()
                    held = 0
        if pieces:
            encode()
        return out.tolist()


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > 2 * _CHUNK:
        cut = _CUT.search(text, at + _CHUNK)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


_LOADED: dict[str, Counter] = {}
_SEEN = 100_000


def _encode(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = Counter(path)
        seen: set[bytes] = set()
        for batch in small_batches(batches, 200):
            # Rows repeated with id and text bring the same digest again.
            fresh = []
            for k, d in enumerate(batch.column(0).to_pylist()):
                if d not in seen:
                    seen.add(d)
                    fresh.append(k)
            if len(seen) > _SEEN:
                seen.clear()
            new = batch.take(pa.array(fresh, pa.int64()))
            yield pa.RecordBatch.from_arrays([new.column(0), pa.array(_LOADED[path].counts(new.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return task


def stored_counts(docs: DataFrame, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; makes the cache where there is none."""
    spark = docs.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        _append(spark.createDataFrame([], "digest binary, n_tokens long"), cache, version)
    stored = spark.read.schema(_CACHE).parquet(cache).where(F.col("version") == version)
    return stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _append(counts: DataFrame, cache: str, version: str) -> None:
    counts.write.parquet(f"{cache}/version={version}/run={uuid.uuid4().hex}")


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``cache`` is a folder that driver and executors share; without one, a
    fresh one is made.  A null text counts as empty and has no tokens; null
    ids and repeated rows stay; other columns are ignored; an empty table
    gives no rows and adds nothing to the cache.
    """
    if cache is None:
        cache = f"{shared_folder(docs.sparkSession)}/token-counts-{uuid.uuid4().hex}"
    version = tokenizer_version(path)
    rows = documents(docs, id_col, text_col)
    rows = rows.withColumn("digest", F.unhex(F.sha2(normalised(F.col("text"), path), 256)))
    digests = materialise(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    distinct = digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    wanted = materialise(distinct.join(stored_counts(docs, cache, version), "digest", "left"), "wanted")
    misses = wanted.where("n_tokens IS NULL").select(F.col("digest").alias("miss"), "first_id")
    texts = rows.join(misses, (rows["digest"] == misses["miss"]) & rows["doc_id"].eqNullSafe(misses["first_id"])).select("digest", "text")
    fresh = materialise(texts.mapInArrow(_encode(path), "digest binary, n_tokens long").groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "fresh-counts")
    if not fresh.isEmpty():
        _append(fresh, cache, version)
    counts = wanted.where("n_tokens IS NOT NULL").select("digest", "n_tokens").unionByName(fresh)
    return digests.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
