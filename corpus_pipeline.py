"""A corpus pipeline of five stages; each works on all rows that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import exact_dedup, jaccard_join, language_id, packing, suffix_dedup
from wordloom.llm.common import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null or empty texts and texts without a letter; null and repeated ids stay."""
    model = language_id.fit(docs)
    return language_id.with_prediction(docs.select(*COLUMNS), model).where("lang_pred != 'und'").select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text: the copy with the largest id, one with a null id only where all are null.

    Of rows that share both id and text, the one with the smallest other columns stays.
    """
    found = exact_dedup.exact_dedup(docs).withColumnsRenamed({"doc_id": "id", "text_sha256": "digest"})
    verdict = materialise(found.groupBy("id", "digest", "kept").count().where("not kept or count > 1"), "exact-verdict")
    repeated = verdict.where("kept")
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)

    def same(other: DataFrame):
        return docs["doc_id"].eqNullSafe(other["id"]) & (digest == other["digest"])

    # A merge join at every size: what is dropped grows with the table.
    single = docs.join(verdict.hint("merge"), same(verdict), "left_anti").select(*COLUMNS)
    rows = docs.join(repeated, same(repeated), "left_semi").select(digest.alias("digest"), F.struct("doc_id", "lang", "source", "n_chars", "text").alias("one"))
    return single.unionByName(rows.groupBy("digest").agg(F.min("one").alias("one")).select("one.*").select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by shingle overlap; null ids come last, equal ones by text.

    Ids may be null or repeat, so texts are told apart by a hash of their own.
    """
    # The next seed is taken where two different texts have one hash, or one has the value that stands for a null id.
    for seed in range(20):
        row = F.xxhash64(F.coalesce("text", F.lit("")), F.lit(seed))
        texts = docs.select(row.alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "doc_id")
        clashes = texts.groupBy("row").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where(F.expr(f"a != b or row = {-(2**63) + 1} - 1"))
        if clashes.isEmpty():
            break
    else:
        raise RuntimeError("no seed tells all texts apart")
    groups = materialise(jaccard_join.jaccard_groups(docs.select(row.alias("row"), "text"), "row").select(F.col("doc_id").alias("row"), "component_id").distinct(), "near-groups")
    several = groups.where("row != component_id").select("component_id").distinct()
    members = texts.join(groups.join(several, "component_id", "left_semi"), "row")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "row")
    members = materialise(members.groupBy("component_id", "row").agg(F.min(rank).alias("rank")), "near-members")
    kept = members.groupBy("component_id").agg(F.min("rank")["row"].alias("row")).select("row")
    dropped = members.select("row").join(kept, "row", "left_anti")
    return docs.withColumn("row", row).join(dropped.hint("merge"), "row", "left_anti").select(*COLUMNS)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 200 bytes and more that repeat anywhere; every row stays with what is left, also with a null or repeated id; a null text becomes empty."""
    left = suffix_dedup.remove_repeats(docs, keep_text=True, carry=("lang", "source"))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", remove_repeated_passages),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
