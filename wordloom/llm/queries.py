"""The queries of this subpackage: opN_<name> over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import bpe, exact_dedup, fingerprint, jaccard_join, language_id, lexical_search, packing, pitman_yor, sharding, suffix_dedup, token_counts, url_filter, vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.fingerprints(_documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings removed from all documents."""
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return bpe.encode_decode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = _documents(spark, sf_dir)
    return language_id.predict(docs, language_id.fit(docs))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimax contiguous sharding of all documents into 40 shards."""
    return sharding.shard(_documents(spark, sf_dir), shards=40)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a model of four fifths of them."""
    return pitman_yor.score_documents(_documents(spark, sf_dir))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.fit(spark))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies over all documents."""
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by shingle overlap."""
    return jaccard_join.jaccard_groups(_documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return lexical_search.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors."""
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, with a cache of their own."""
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


SUFFIX_DEDUP_SQL = """
WITH texts AS (SELECT doc_id, row_number() OVER () AS row, encode(coalesce(text, '')) AS raw FROM documents),
bytes AS (SELECT doc_id, row, raw, octet_length(raw) AS n, unnest(range(1, octet_length(raw) + 1)) AS i FROM texts),
windows AS (SELECT row, i, CASE WHEN i + 199 <= n THEN md5(raw[i:i + 199]) END AS s, hex(raw[i:i]) AS byte FROM bytes),
repeated AS (SELECT s FROM windows WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1),
marked AS (SELECT row, i, byte, max(r.s IS NOT NULL) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM windows w LEFT JOIN repeated r ON w.s = r.s),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY row ORDER BY i), false) AS begins FROM marked),
kept AS (SELECT row, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS h FROM edges GROUP BY row)
SELECT doc_id, octet_length(raw)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM texts LEFT JOIN kept USING (row)
"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
JACCARD_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON r = a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = d.doc_id) AS component_id FROM documents d LEFT JOIN sizes USING (doc_id)
"""


def queries() -> dict[str, Query]:
    """Name -> callable(spark, sf_dir)."""
    found = (op1_fingerprint, op2_packing, op3_suffix_dedup, op4_bpe, op5_language_id, op6_sharding, op7_lm_scoring, op8_url_filter, op9_exact_dedup, op10_jaccard_join, op11_lexical_search, op12_vector_codes, op13_token_counts)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op3_suffix_dedup": SUFFIX_DEDUP_SQL, "op9_exact_dedup": exact_dedup.EXACT_DEDUP_SQL, "op10_jaccard_join": JACCARD_SQL, "op11_lexical_search": lexical_search.LEXICAL_SEARCH_SQL, "op12_vector_codes": vector_codes.VECTOR_CODES_SQL}
