"""Vocabulary, coverage and merge aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.tokens import char_ngrams
from wordloom.operators import lookup, quality, review, similarity
from wordloom.plans.registry import query, table
from wordloom.plans.search import KEYED_SQL, WORDS_SQL, document_words, search_index


@query("vocab_freq", f"SELECT lang, lower(word) AS form, count(*) AS tokens, count(DISTINCT doc_id) AS docs FROM ({WORDS_SQL}) GROUP BY ALL")
def vocab_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term and document frequency by language."""
    return document_words(spark, sf_dir).groupBy("lang", F.lower("word").alias("form")).agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("doc_id").alias("docs"))


@query(
    "coverage_topk",
    f"""WITH f AS (SELECT lower(word) AS word, count(*) AS freq FROM ({WORDS_SQL}) GROUP BY 1), r AS (SELECT freq, row_number() OVER (ORDER BY freq DESC) AS place FROM f)
    SELECT top::BIGINT AS top, sum(CASE WHEN place <= top THEN freq ELSE 0 END)::BIGINT AS covered, sum(freq)::BIGINT AS total FROM r, (VALUES (10), (100), (1000), (5000)) t(top) GROUP BY top""",
)
def coverage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that the most frequent words make up."""
    freq = document_words(spark, sf_dir).groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("freq"))
    return quality.top_coverage(freq, [10, 100, 1000, 5000])


@query("vocab_classes", f"WITH f AS (SELECT lang, lower(word) AS word, count(*) AS n FROM ({WORDS_SQL}) GROUP BY ALL) SELECT lang, sum(n)::BIGINT AS tokens, count(*) AS forms, sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END)::BIGINT AS seen_twice, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::BIGINT AS hapax FROM f GROUP BY lang")
def vocab_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, forms, forms seen twice and once."""
    freq = document_words(spark, sf_dir).groupBy("lang", F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return freq.groupBy("lang").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("forms"), F.sum(F.when(F.col("n") >= 2, 1).otherwise(0)).alias("seen_twice"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("hapax"))


@query("collision_histogram", f"{KEYED_SQL} SELECT least(n, 6)::BIGINT AS size, count(*) AS keys FROM (SELECT key, count(DISTINCT word) AS n FROM k GROUP BY key) GROUP BY 1")
def collision_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words share a loose key."""
    return quality.collision_histogram(search_index(spark, sf_dir).words, "key", "word")


@query("first_occurrence", f"SELECT lower(word) AS form, min(doc_id) AS first_doc, arg_min(source, doc_id) AS first_source FROM ({WORDS_SQL}) GROUP BY 1")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each word occurs first."""
    return document_words(spark, sf_dir).groupBy(F.lower("word").alias("form")).agg(F.min("doc_id").alias("first_doc"), F.min_by("source", "doc_id").alias("first_source"))


@query(
    "first_three_refs",
    f"WITH d AS (SELECT DISTINCT lower(word) AS form, doc_id FROM ({WORDS_SQL})), r AS (SELECT form, doc_id, row_number() OVER (PARTITION BY form ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY form) AS n FROM d) SELECT form, any_value(n) AS docs, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS refs FROM r WHERE k <= 3 AND n >= 2 GROUP BY form",
)
def first_three_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three documents of each word that occurs in two or more."""
    rows = document_words(spark, sf_dir).select(F.lower("word").alias("form"), "doc_id").distinct().groupBy("form").agg(F.count(F.lit(1)).alias("docs"), F.slice(F.array_sort(F.collect_list("doc_id")), 1, 3).alias("ids"))
    return rows.where("docs >= 2").select("form", "docs", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("refs"))


@query(
    "entry_merge_first6",
    """WITH e AS (SELECT p_brand, p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type END AS ipa, CASE WHEN p_size % 3 = 0 THEN p_name END AS etymology, string_split(p_type || ' ' || lower(p_type), ' ') AS glosses FROM part),
    s AS (SELECT p_brand, p_partkey, i - 1 AS idx, glosses[i] AS gloss FROM e, unnest(range(1, len(glosses) + 1)) u(i)),
    o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY p_brand, lower(trim(gloss)) ORDER BY p_partkey, idx) = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, idx) AS place FROM o QUALIFY place <= 6)
    SELECT f.p_brand, f.ipa, f.etymology, g.glosses FROM (SELECT p_brand, arg_min(ipa, p_partkey) FILTER (ipa IS NOT NULL) AS ipa, arg_min(etymology, p_partkey) FILTER (etymology IS NOT NULL) AS etymology FROM e GROUP BY p_brand) f
    LEFT JOIN (SELECT p_brand, string_agg(gloss, '|' ORDER BY place) AS glosses FROM k GROUP BY p_brand) g ON f.p_brand = g.p_brand""",
)
def entry_merge_first6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of many sources as one: first facts, six distinct senses."""
    part = table(spark, sf_dir, "part")
    entries = part.select("p_brand", "p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("ipa"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("etymology"), F.split(F.concat_ws(" ", "p_type", F.lower("p_type")), " ").alias("glosses"))
    return lookup.merge_entries(entries, ["p_brand"], "p_partkey").withColumn("glosses", F.array_join("glosses", "|"))


@query("progress_by_section", "SELECT o_orderpriority AS section, count(*) AS chapters, count(f.l_orderkey) AS done, sum(CASE WHEN f.l_orderkey IS NULL THEN o_custkey ELSE 0 END)::BIGINT AS words_left FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') f ON o_orderkey = f.l_orderkey GROUP BY 1")
def progress_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished and remaining chapters of each section."""
    chapters = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("section"), F.col("o_orderkey").alias("chapter"), F.col("o_custkey").alias("words"))
    read = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("chapter")).distinct()
    return review.progress(chapters, chapters.join(read, "chapter", "left_semi"), "section", "chapter")


@query("distinct_parts", "SELECT DISTINCT source, lang FROM documents WHERE text <> ''")
def distinct_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that have text."""
    return table(spark, sf_dir, "documents").where("text != ''").select("source", "lang").distinct()


@query("set_fit", f"WITH w AS ({WORDS_SQL}), s AS (SELECT DISTINCT source, lower(word) AS word FROM w WHERE doc_id % 2 = 0) SELECT w.source, count(*) AS words, count(s.word) AS supported FROM w LEFT JOIN s ON w.source = s.source AND lower(w.word) = s.word WHERE doc_id % 2 = 1 GROUP BY w.source")
def set_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of one half of a source's texts that the other half uses."""
    rows = document_words(spark, sf_dir).select("doc_id", "source", F.lower("word").alias("word"))
    return quality.set_fit(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0"), ["source"])


@query(
    "ngram_agreement",
    """WITH m AS (SELECT DISTINCT item_id, substr(text, i, 8) AS gram FROM benchmark, unnest(range(1, length(text) - 6)) u(i) WHERE length(text) >= 14), d AS (SELECT DISTINCT substr(text, i, 8) AS gram FROM documents, unnest(range(1, length(text) - 6)) u(i))
    SELECT item_id, count(*) AS grams, count(d.gram) AS shared FROM m LEFT JOIN d ON m.gram = d.gram GROUP BY item_id""",
)
def ngram_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared 8-character grams of benchmark passages and all documents."""
    return similarity.gram_agreement(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("text"))


@query("char_gram_counts", "SELECT item_id, count(DISTINCT substr(text, i, 3)) AS grams FROM benchmark, unnest(range(1, length(text) - 1)) u(i) GROUP BY item_id")
def char_gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct trigrams of each passage."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(char_ngrams(F.col("text"), 3)).cast("long").alias("grams"))
