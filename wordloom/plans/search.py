"""Keys, inverted index and search over ``documents``."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.keys import loose_key, loose_roman, loose_sql, rule_b, skeleton_roman
from wordloom.functions.parse import reference
from wordloom.functions.tokens import query_terms, words
from wordloom.operators import index, stored
from wordloom.plans.registry import query, table
from wordloom.sources import store
from wordloom.sources.shared import shared_folder

WORDS_SQL = "SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '[A-Za-zÀ-ɏḀ-ỿ]+')) AS word FROM documents"
KEYED_SQL = f"WITH w AS ({WORDS_SQL}), k AS (SELECT word, {loose_sql('word')} AS key FROM (SELECT DISTINCT word FROM w))"
QUERIES = ("the and", "with which", "de la", "und der", "thention", "los que", "license released", "in", "and the of")
GROUPS = (("articles", "the"), ("articles", "der"), ("articles", "los"), ("articles", "les"), ("joining", "and"), ("joining", "und"), ("joining", "que"), ("absent", "zzzzqq"), ("absent", "with"))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, word)."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.explode(words(F.col("text"))).alias("word"))


def index_place(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """(folder of the index over a folder's documents, version that the documents have now)."""
    documents = f"{sf_dir}/documents.parquet"
    name = hashlib.sha256(documents.encode()).hexdigest()[:16]
    return f"{shared_folder(spark)}/search-index/{name}", store.version_of(spark, [documents], stored.RULE)


def build_index(spark: SparkSession, sf_dir: str) -> str:
    """Builds the index anew and puts it in force; returns its folder."""
    root, version = index_place(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return store.publish(spark, root, lambda folder: stored.write_index(*index.build(docs, words(F.col("text"))), folder), version=version)


def search_index(spark: SparkSession, sf_dir: str) -> stored.StoredIndex:
    """The stored index of ``documents``; built anew where there is none, where the documents' files have changed, or where a file of it is gone."""
    root, version = index_place(spark, sf_dir)
    try:
        return stored.open_index(spark, root, version)
    except store.Stale:
        return stored.StoredIndex(spark, build_index(spark, sf_dir))


def query_keys(spark: SparkSession) -> DataFrame:
    """(query, position, key) of the fixed queries."""
    terms = spark.createDataFrame([(q,) for q in QUERIES], "query string").select("query", F.posexplode(query_terms(F.col("query"))).alias("position", "term"))
    return terms.select("query", "position", loose_roman(F.col("term")).alias("key"))


def group_keys(spark: SparkSession) -> DataFrame:
    """(group, key) of the fixed alias groups."""
    return spark.createDataFrame(list(GROUPS), "group string, form string").select("group", loose_roman(F.col("form")).alias("key"))


_QUERY_SQL = "q AS (SELECT query, p - 1 AS position, " + loose_sql("term") + " AS key FROM (SELECT query, terms[p] AS term, p FROM (SELECT query, string_split(query, ' ') AS terms FROM (VALUES " + ", ".join(f"('{q}')" for q in QUERIES) + ") v(query)), unnest(range(1, len(terms) + 1)) u(p)))"
_GROUP_SQL = "g AS (SELECT grp, " + loose_sql("form") + " AS key FROM (VALUES " + ", ".join(f"('{g}', '{f}')" for g, f in GROUPS) + ") v(grp, form))"
_EXPANDED_SQL = "e AS (SELECT query, position, key FROM q UNION SELECT q.query, q.position, g2.key FROM q JOIN g g1 ON q.key = g1.key JOIN g g2 ON g1.grp = g2.grp)"
_POST_SQL = "p AS (SELECT DISTINCT k.key, w.doc_id, w.source FROM w JOIN k ON w.word = k.word WHERE length(k.key) >= 3)"
_HITS_SQL = "h AS (SELECT query, doc_id FROM e JOIN p ON e.key = p.key GROUP BY query, doc_id HAVING count(DISTINCT position) = (SELECT count(DISTINCT position) FROM e e2 WHERE e2.query = e.query))"


@query("loose_keys", f"{KEYED_SQL} SELECT word, key FROM k")
def loose_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose key of every different word."""
    return document_words(spark, sf_dir).select("word").distinct().withColumn("key", loose_key(F.col("word")))


@query("postings_df", f"{KEYED_SQL}, {_POST_SQL} SELECT key, count(DISTINCT doc_id) AS df, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM p GROUP BY key")
def postings_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index: how many documents hold a key, and the ends of its posting list."""
    return stored.frequency(search_index(spark, sf_dir).blocks)


@query("search_and", f"{KEYED_SQL}, {_QUERY_SQL}, {_GROUP_SQL}, {_EXPANDED_SQL}, {_POST_SQL}, {_HITS_SQL} SELECT query, doc_id FROM h")
def search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold every word of a query, alias groups expanded."""
    expanded = index.expand(query_keys(spark), group_keys(spark))
    return search_index(spark, sf_dir).search(expanded).select("query", F.col("unit").alias("doc_id"))


@query(
    "search_group_fallback",
    f"""{KEYED_SQL}, {_QUERY_SQL}, {_GROUP_SQL}, {_EXPANDED_SQL}, {_POST_SQL}, {_HITS_SQL},
    s AS (SELECT query, source FROM e JOIN p ON e.key = p.key WHERE query NOT IN (SELECT query FROM h)
          GROUP BY query, source HAVING count(DISTINCT position) = (SELECT count(DISTINCT position) FROM e e2 WHERE e2.query = e.query))
    SELECT query, 'document' AS level, doc_id::VARCHAR AS unit FROM h UNION ALL SELECT query, 'group', source FROM s""",
)
def search_group_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like ``search_and``; a query without a document falls back to sources."""
    held, expanded = search_index(spark, sf_dir), index.expand(query_keys(spark), group_keys(spark))
    return index.with_fallback(expanded, held.search(expanded), held.groups).select("query", "level", "unit")


@query("group_problems", f"{KEYED_SQL}, {_POST_SQL}, {_GROUP_SQL}, d AS (SELECT DISTINCT key FROM p) SELECT grp AS \"group\", sum(CASE WHEN d.key IS NULL THEN 1 ELSE 0 END)::BIGINT AS absent, count(d.key) AS present FROM g LEFT JOIN d ON g.key = d.key GROUP BY grp HAVING sum(CASE WHEN d.key IS NULL THEN 1 ELSE 0 END) > 0 OR count(d.key) < 2")
def group_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias groups with a form that the texts don't hold."""
    df = search_index(spark, sf_dir).document_frequency()
    return index.group_problems(group_keys(spark), df)


@query(
    "display_forms",
    f"""{KEYED_SQL}, {_POST_SQL}, d AS (SELECT key FROM p GROUP BY key HAVING count(DISTINCT doc_id) >= 8),
    u AS (SELECT k.key, lower(nfc_normalize(w.word)) AS form, count(*) AS uses FROM w JOIN k ON w.word = k.word JOIN d ON k.key = d.key GROUP BY ALL)
    SELECT key, 'roman' AS script, form, uses FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY uses DESC, form) = 1""",
)
def display_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest spelling of each frequent key."""
    held = search_index(spark, sf_dir)
    return index.display_forms(held.words, held.document_frequency())


@query(
    "suggest",
    f"""{KEYED_SQL}, {_POST_SQL}, d AS (SELECT key, count(DISTINCT doc_id) AS df FROM p GROUP BY key), t AS (SELECT unnest(['thei', 'wuth', 'nicht', 'thas', 'licens']) AS key)
    SELECT t.key, d.key AS suggestion, d.df, CAST(row_number() OVER (PARTITION BY t.key ORDER BY CASE WHEN length(d.key) > length(t.key) THEN 0 WHEN length(d.key) = length(t.key) THEN 1 ELSE 2 END, d.df DESC, d.key) AS INTEGER) AS rank
    FROM t JOIN d ON t.key <> d.key AND left(t.key, 1) = left(d.key, 1) AND abs(length(t.key) - length(d.key)) <= 1 AND levenshtein(t.key, d.key) <= 1
    QUALIFY rank <= 3""",
)
def suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of mistyped keys."""
    df = search_index(spark, sf_dir).document_frequency()
    typed = spark.createDataFrame([(k,) for k in ("thei", "wuth", "nicht", "thas", "licens")], "key string")
    return index.suggest(typed, df)


@query(
    "story_subset",
    f"""{KEYED_SQL}, {_POST_SQL}, {_QUERY_SQL}, n AS (SELECT query, count(DISTINCT key) AS needed FROM q GROUP BY query)
    SELECT n.query, s.source FROM (SELECT query, source, count(DISTINCT q.key) AS held FROM q JOIN p ON q.key = p.key GROUP BY query, source) s JOIN n ON s.query = n.query AND s.held = n.needed""",
)
def story_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose keys include every key of a query."""
    return index.covered_items(query_keys(spark), search_index(spark, sf_dir).groups.withColumnRenamed("group", "source"), "source")


@query(
    "reference_parse",
    """SELECT o_orderkey, CAST(nullif(regexp_extract(q, '^(\\d+)[.:/\\-\\s]+(\\d+)', 1), '') AS INTEGER) AS section, CAST(nullif(regexp_extract(q, '^(\\d+)[.:/\\-\\s]+(\\d+)', 2), '') AS INTEGER) AS chapter,
    CAST(nullif(regexp_extract(q, '^(\\d+)[.:/\\-\\s]+(\\d+)(?:[.:/\\-\\s]+(\\d+))?$', 3), '') AS INTEGER) AS verse
    FROM (SELECT o_orderkey, concat(o_orderkey % 15, '.', o_custkey % 40, CASE WHEN o_orderkey % 2 = 0 THEN ':' || (o_custkey % 90)::VARCHAR ELSE '' END, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END) AS q FROM orders)
    WHERE regexp_matches(q, '^(\\d+)[.:/\\-\\s]+(\\d+)(?:[.:/\\-\\s]+(\\d+))?$') AND o_orderkey % 15 <= 12""",
)
def reference_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed references such as 3.12 or 3.12:7."""
    orders = table(spark, sf_dir, "orders")
    typed = F.concat((F.col("o_orderkey") % 15).cast("string"), F.lit("."), (F.col("o_custkey") % 40).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(":"), (F.col("o_custkey") % 90).cast("string"))).otherwise(F.lit("")), F.when(F.col("o_orderkey") % 5 == 0, F.lit("x")).otherwise(F.lit("")))
    return orders.select("o_orderkey", reference(typed).alias("r")).where("r is not null").select("o_orderkey", "r.*")


@query("query_terms", "SELECT conv_id, turn, CAST(len(regexp_extract_all(trim(text), '[^\\s\"“”''‘’.,;:!?()]+')) AS INTEGER) AS n_terms FROM conversations")
def query_terms_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each turn, cut as a query is."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.size(query_terms(F.col("text"))) > 0, F.size(query_terms(F.col("text")))).otherwise(0).alias("n_terms"))


@query(
    "skeleton_collisions",
    f"WITH w AS ({WORDS_SQL}), s AS (SELECT word, regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(word)), '[^a-z]', '', 'g'), '([kgcjtdpb])h', '\\1', 'g'), 'x^', '', 'g') AS b FROM (SELECT DISTINCT word FROM w)), t AS (SELECT word, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(b, 'sh', 's'), 'ng', 'n'), 'ny', 'n'), 'ri', 'r'), 'w', 'b'), 'v', 'b'), 'y', 'j'), 'z', 'j'), 'q', 'k'), 'x', 'ks'), 'm', 'n'), '[aeiouh]', '', 'g') AS key FROM s) SELECT least(n, 6)::BIGINT AS size, count(*) AS keys FROM (SELECT key, count(*) AS n FROM t GROUP BY key) GROUP BY 1",
)
def skeleton_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words share a consonant skeleton."""
    from wordloom.operators.quality import collision_histogram

    return collision_histogram(document_words(spark, sf_dir).select("word").distinct().withColumn("key", skeleton_roman(F.col("word"))), "key", "word")


@query(
    "rule_differences",
    f"""{KEYED_SQL}, b AS (SELECT word, key, {"".join("regexp_replace(" for _ in range(26))}replace(replace(key, 'h', ''), 'ks', 's'){"".join(f", '{c}+', '{c}', 'g')" for c in "abcdefghijklmnopqrstuvwxyz")} AS coarse FROM k),
    f AS (SELECT coarse, key, count(*) AS n FROM w JOIN b ON w.word = b.word GROUP BY ALL)
    SELECT coarse, count(DISTINCT key) AS n_fine, sum(n)::BIGINT AS weight FROM f GROUP BY coarse HAVING count(DISTINCT key) > 1""",
)
def rule_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a coarser rule would join, with the tokens behind them."""
    from wordloom.operators.quality import rule_differences as differences

    counted = search_index(spark, sf_dir).words.groupBy("key").agg(F.sum("uses").alias("n")).withColumn("coarse", rule_b(F.col("key")))
    return differences(counted, "key", "coarse", "n")
