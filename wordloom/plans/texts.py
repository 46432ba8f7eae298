"""Scripts, places in texts, fallbacks, queues and the whole lookup cascade, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import scripts

from wordloom.functions.tokens import query_terms, words
from wordloom.operators import reading
from wordloom.operators.support import best_support
from wordloom.plans.registry import query, table

FIND = ("the", "und", "que", "lès")


def _values(rows, *columns: str) -> str:
    """A VALUES list of texts."""
    def cell(x):
        return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({', '.join(columns)})"


def _block(start: int) -> str:
    return "".join(map(chr, range(start, start + 0x80)))


@query("whole_words", " UNION ALL ".join(f"SELECT doc_id, '{w}' AS word FROM documents WHERE regexp_matches(text, '(^|[^\\p{{L}}\\p{{M}}]){w}([^\\p{{L}}\\p{{M}}]|$)', 'i')" for w in FIND))
def whole_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a word that no letter or mark touches."""
    wanted = F.explode(F.array(*map(F.lit, FIND))).alias("word")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", wanted)
    return docs.where(scripts.has_whole_word(F.col("text"), F.col("word"))).select("doc_id", "word")


@query("word_places", " UNION ALL ".join(f"SELECT conv_id, turn, '{w}' AS word, len(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x = '{w}')) AS n FROM conversations WHERE list_contains(regexp_split_to_array(text, '[^\\p{{L}}\\p{{Nd}}]+'), '{w}')" for w in ("the", "of")))
def word_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a word stands whole in each turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.explode(F.array(F.lit("the"), F.lit("of"))).alias("word"))
    places = scripts.word_ranges(F.col("text"), F.array("word"))
    return turns.select("conv_id", "turn", "word", F.size(places).cast("long").alias("n")).where("n > 0")


_MARKED = "regexp_replace(text, '([a-z]ing)([^a-z]|$)', '\\1[?]\\2', 'g')"


@query("doubtful_words", f"WITH m AS (SELECT conv_id, turn, {_MARKED} AS t FROM conversations) SELECT conv_id, turn, replace(t, '[?]', '') AS plain, ((length(t) - length(replace(t, '[?]', ''))) // 3)::BIGINT AS n, CASE WHEN contains(t, '[?]') THEN length(regexp_replace(left(t, strpos(t, '[?]') - 1), '[^ \\t\\n\\r\\f]*$', '')) END AS first FROM m")
def doubtful_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without their marks of doubt, and where the marked words stand."""
    marked = F.regexp_replace("text", "([a-z]ing)([^a-z]|$)", "$1[?]$2")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", scripts.split_doubtful(marked).alias("d"))
    return rows.select("conv_id", "turn", F.col("d.text").alias("plain"), F.size("d.ranges").cast("long").alias("n"), F.try_element_at("d.ranges", F.lit(1))["start"].cast("long").alias("first"))


@query("spoken_references", "SELECT o_orderkey, (o_orderkey % 15)::INTEGER AS section, greatest(1, least((o_custkey % 60)::INTEGER, CASE WHEN o_orderkey % 15 = 10 THEN 90 ELSE 30 END)) AS chapter FROM orders WHERE o_orderkey % 15 <= 12")
def spoken_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken requests for a chapter, held within the section."""
    said = F.concat(F.lit("book "), (F.col("o_orderkey") % 15).cast("string"), F.lit(" chapter "), (F.col("o_custkey") % 60).cast("string"), F.lit(" please"))
    found = scripts.spoken_reference(said, [90 if k == 10 else 30 for k in range(13)])
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("r")).where("r is not null").select("o_orderkey", "r.*")


@query("marked_segments", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN trim(p_name) || '।' WHEN 1 THEN trim(p_type) || '।' ELSE trim(p_name) || ' ' || trim(p_type) || ' end' END AS segment FROM part")
def marked_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ends with the verse marker of a number."""
    text = F.concat("p_name", F.lit(" ॥ १ ॥ "), "p_type", F.lit(" ।। 12 ।। end"))
    number = F.element_at(F.array(F.lit(1), F.lit(12), F.lit(7)), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", scripts.segment_ending(text, number).alias("segment"))


@query(
    "first_hits",
    """WITH t AS (SELECT conv_id, turn, lower(text) AS t FROM conversations)
    SELECT conv_id, turn, CAST(CASE WHEN strpos(t, 'and') > 0 THEN strpos(t, 'and') WHEN strpos(t, 'élle') > 0 THEN strpos(t, 'élle') WHEN strpos(strip_accents(t), 'and') > 0 THEN strpos(strip_accents(t), 'and') ELSE strpos(strip_accents(t), 'elle') END AS INTEGER) AS at,
    CAST(CASE WHEN strpos(t, 'and') > 0 OR strpos(t, 'élle') > 0 THEN 1 ELSE 2 END AS INTEGER) AS step FROM t WHERE strpos(strip_accents(t), 'and') > 0 OR strpos(strip_accents(t), 'elle') > 0""",
)
def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a search's words are first found in each turn, as they are or without marks."""
    hit = scripts.find_hit(F.col("text"), F.array(F.lit("and"), F.lit("élle")), F.array().cast("array<string>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", hit.alias("h")).where("h is not null").select("conv_id", "turn", "h.at", "h.step")


@query(
    "edit_neighbourhood",
    """WITH w AS (SELECT DISTINCT lower(n_name) AS word FROM nation WHERE n_name SIMILAR TO '[A-Z]+'), a AS (SELECT unnest(['a', 'e']) AS c),
    i AS (SELECT word, unnest(range(0, length(word) + 1)) AS i FROM w),
    n AS (SELECT word, left(word, i) || substr(word, i + 2) AS near FROM i WHERE i < length(word) UNION SELECT word, left(word, i) || c || substr(word, i + 2) FROM i, a WHERE i < length(word)
    UNION SELECT word, left(word, i) || c || substr(word, i + 1) FROM i, a UNION SELECT word, left(word, i) || substr(word, i + 2, 1) || substr(word, i + 1, 1) || substr(word, i + 3) FROM i WHERE i + 1 < length(word))
    SELECT word, near FROM n WHERE near <> word""",
)
def edit_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strings one edit away over a small alphabet."""
    names = table(spark, sf_dir, "nation").where(F.col("n_name").rlike("^[A-Z]+$")).select(F.lower("n_name").alias("word")).distinct()
    return names.select("word", F.explode(scripts.edit_neighbours(F.col("word"), "ae")).alias("near"))


@query("notebook", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND (contains(lower(text), 'thea') OR contains(lower(conv_id::VARCHAR), 'thea'))")
def notebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of one role that hold a text in one of two columns."""
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id").cast("string"))
    return reading.noted(turns, F.col("role") == "user", F.lit("ThEa"), ["text", "id"]).select("conv_id", "turn")


@query("story_match", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'steel') OR contains(lower(p_type), 'steel') OR contains(lower(p_brand), 'steel')")
def story_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a word in any of three texts."""
    return table(spark, sf_dir, "part").where(reading.mentioned(F.array("p_name", "p_type", "p_brand"), F.lit("Steel"))).select("p_partkey")


@query("text_fallback", "SELECT doc_id, coalesce(CASE WHEN trim(text) <> '' THEN text END, CASE WHEN doc_id % 2 = 0 THEN 'see ' || source END, 'not available') AS shown FROM documents")
def text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's own text, else a pointer, else a note."""
    pointer = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("see "), "source"))
    return table(spark, sf_dir, "documents").select("doc_id", reading.first_text(F.col("text"), pointer).alias("shown"))


@query("licence_lines", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\b(licen[cs]e[ds]?|copyright|public domain|CC[ -]BY)\\b')")
def licence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name a licence."""
    return table(spark, sf_dir, "documents").where(reading.licence_line(F.col("text")).isNotNull()).select("doc_id")


@query("find_inside", "SELECT conv_id, turn, CAST(CASE WHEN contains(lower(text), 'alè') THEN 1 ELSE 2 END AS INTEGER) AS found FROM conversations WHERE contains(strip_accents(lower(text)), 'ale')")
def find_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that hold a needle as it is or without marks."""
    found = reading.found_inside(F.col("text"), F.lit("Alè"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("found")).where("found <= 2")


@query("pointer_lengths", "SELECT coalesce(CASE WHEN doc_id % 4 > 0 THEN doc_id - doc_id % 4 END, doc_id) AS unit, sum(coalesce(length(text), 0))::BIGINT AS length, count(*) AS rows FROM documents GROUP BY 1")
def pointer_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lengths, each row counted for the one it points to."""
    docs = table(spark, sf_dir, "documents").withColumn("up", F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") - F.col("doc_id") % 4))
    return reading.lengths_through_pointers(docs, "doc_id", "up", "text").withColumn("length", F.col("length").cast("long"))


@query("language_counts", "SELECT d.lang, count(*) AS entries, sum(coalesce(n, 0))::BIGINT AS senses, count(*) FILTER (n IS NULL) AS \"without\" FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l USING (doc_id) GROUP BY d.lang")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels of each language, and documents without one."""
    return reading.counts_by(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "lang")


@query("words_around", "WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-zÀ-ɏḀ-ỿ]+') AS w FROM conversations), p AS (SELECT *, list_position(w, 'the') AS k FROM w) SELECT conv_id, turn, array_to_string(list_slice(w, greatest(k - 2, 1), k + 2), ' ') AS around FROM p WHERE k > 0")
def words_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words around the first "the" of each turn."""
    held = table(spark, sf_dir, "conversations").select("conv_id", "turn", words(F.col("text")).alias("w")).withColumn("at", F.array_position("w", "the").cast("int"))
    return held.where("at > 0").select("conv_id", "turn", F.array_join(reading.words_around(F.col("w"), F.col("at"), 2), " ").alias("around"))


@query("work_queue", "WITH f AS (SELECT left(lower(p_name), 3) AS grp, p_name AS word, count(*) AS freq FROM part GROUP BY ALL) SELECT grp AS \"group\", count(*) AS members, sum(freq)::BIGINT AS weight, arg_min(word, (-freq, word)) AS first FROM f GROUP BY grp")
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of names by weight, with their most frequent member."""
    names = table(spark, sf_dir, "part").groupBy(F.lower(F.substring("p_name", 1, 3)).alias("group"), F.col("p_name").alias("word")).agg(F.count(F.lit(1)).alias("freq"))
    return reading.work_queue(names, "group")


@query("reference_order", "SELECT a || '.' || b AS ref, CAST(row_number() OVER (ORDER BY a, b) AS INTEGER) AS place FROM (SELECT DISTINCT o_orderkey % 13 AS a, o_custkey % 40 AS b FROM orders)")
def reference_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted references in the order of a book."""
    from pyspark.sql.window import Window

    refs = table(spark, sf_dir, "orders").select(F.concat((F.col("o_orderkey") % 13).cast("string"), F.lit("."), (F.col("o_custkey") % 40).cast("string")).alias("ref")).distinct()
    # At most 13 x 40 references are left.
    return refs.withColumn("place", F.row_number().over(Window.orderBy(reading.reference_key(F.col("ref")))))


@query("set_equality", "WITH s AS (SELECT DISTINCT o_orderpriority AS name, o_custkey AS value FROM orders), p AS (SELECT * FROM (VALUES ('1-URGENT', '2-HIGH'), ('5-LOW', '5-LOW')) v(a, b)) SELECT a, b, (SELECT count(*) FROM (SELECT value FROM s WHERE name = a EXCEPT SELECT value FROM s WHERE name = b)) AS only_a, (SELECT count(*) FROM (SELECT value FROM s WHERE name = b EXCEPT SELECT value FROM s WHERE name = a)) AS only_b FROM p")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the customers of two priorities differ."""
    return reading.set_differences(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey", [("1-URGENT", "2-HIGH"), ("5-LOW", "5-LOW")])


@query("in_either", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def in_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that have a customer or a supplier."""
    return reading.in_any([table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))], "nation")


@query("merged_lists", "WITH t AS (SELECT conv_id, turn, string_split(trim(text), ' ') AS w FROM conversations), m AS (SELECT conv_id, turn, unnest(w[1:3] || w[-4:]) AS x, generate_subscripts(w[1:3] || w[-4:], 1) AS i FROM t), f AS (SELECT conv_id, turn, x, min(i) AS i FROM m GROUP BY ALL) SELECT conv_id, turn, string_agg(x, '|' ORDER BY i) AS merged FROM f GROUP BY ALL")
def merged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three and the last four words of each turn, none twice."""
    w = F.split(F.trim("text"), " ")
    last = F.slice(w, F.greatest(F.size(w) - 3, F.lit(1)), F.lit(4))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(reading.merge_lists([F.slice(w, 1, 3), last]), "|").alias("merged"))


_ACCENTS = ("ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü", "ACEEEINOOUsaceeeinoou")
_PLAIN_WORDS = f"SELECT unnest(regexp_extract_all(lower(translate(text, '{_ACCENTS[0]}', '{_ACCENTS[1]}')), '[A-Za-zÀ-ɏḀ-ỿ]+')) AS word FROM {{0}}"
_FORMS = "SELECT word, word AS form FROM {0} UNION SELECT word, left(word, i) || substr(word, i + 2) FROM {0}, unnest(range(0, length(word))) t(i)"


@query(
    "dominant_fixes",
    f"""WITH f AS (SELECT word, count(*) AS freq FROM ({_PLAIN_WORDS.format('documents')}) GROUP BY word), u AS (SELECT DISTINCT word FROM ({_PLAIN_WORDS.format('conversations')}) WHERE length(word) >= 4 AND word NOT IN (SELECT word FROM f)),
    a AS ({_FORMS.format('u')}), b AS ({_FORMS.format('f')}), p AS (SELECT DISTINCT a.word AS word, b.word AS fixed FROM a JOIN b USING (form) WHERE a.word <> b.word),
    r AS (SELECT p.word, fixed, freq, row_number() OVER w AS rank, lead(freq) OVER w AS second FROM p JOIN f ON f.word = fixed WHERE levenshtein(p.word, fixed) <= 1 WINDOW w AS (PARTITION BY p.word ORDER BY freq DESC, fixed DESC))
    SELECT word, fixed FROM r WHERE rank = 1 AND freq >= 3 AND (second IS NULL OR freq >= 3 * second)""",
)
def dominant_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations that documents lack, with a clearly commoner word one edit away; accents aside."""

    def said(name: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.explode(words(F.lower(F.translate("text", *_ACCENTS)))).alias("word"))

    return reading.dominant_fix(said("conversations"), said("documents").groupBy("word").agg(F.count(F.lit(1)).alias("freq")))


@query("query_words_supported")
def query_words_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the words of each benchmark passage are borne out, nearly or exactly, by the turns that share three of its words."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(query_terms(F.lower("text"))).alias("mine"))
    turns = table(spark, sf_dir, "conversations").select(F.array_distinct(query_terms(F.lower("text"))).alias("pool"))
    best = best_support(items, turns, "item_id", "mine", "pool", least=3)
    return best.select("item_id", F.round("support", 6).alias("support"))
