"""Voting, assembly, regions, patches and readers' tools over the given tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import normalize
from wordloom.functions.normalize import plain_roman, title_cleanup
from wordloom.functions.parse import marker_range, nearest_occurrence, snippet
from wordloom.functions.tokens import broken, core, words, words_of_columns
from wordloom.operators import assemble, consensus, intervals, lookup, quality, review, sampling, sequence
from wordloom.operators.similarity import common_prefix_likeness
from wordloom.plans.registry import query, table
from wordloom.plans.texts import _ACCENTS
from wordloom.sources import pages, tables

_LINES = "l AS (SELECT doc_id, source, i AS line, trim(t[i]) AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS t FROM documents), unnest(range(1, len(t) + 1)) u(i))"
_SAID = "s AS (SELECT conv_id, turn, i AS place, w[i] AS word FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-zÀ-ɏḀ-ỿ]+') AS w FROM conversations), unnest(range(1, len(w) + 1)) u(i))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, line, text): lines of documents without blanks at their ends."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1).withColumn("text", F.btrim("text"))


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, place, word): the words of turns."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(words(F.col("text"))).alias("place", "word")).withColumn("place", F.col("place") + 1)


@query(
    "decided_words",
    f"""WITH {_SAID}, r AS (SELECT *, CASE WHEN place % 11 = 0 THEN NULL WHEN place % 3 = 0 THEN lower(word) ELSE word END AS a, CASE WHEN place % 13 = 0 THEN NULL WHEN place % 4 = 0 THEN reverse(word) || '.' ELSE word || ',' END AS b,
      CASE WHEN place % 5 = 0 THEN NULL ELSE '(' || word END AS t FROM s),
    c AS (SELECT *, a AS ca, rtrim(b, '.,') AS cb, ltrim(t, '(') AS ct FROM r), k AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ɏḀ-ỿ]+')) AS w FROM benchmark)),
    x AS (SELECT *, ca IN (SELECT w FROM k) AS ka, cb IN (SELECT w FROM k) AS kb FROM c),
    d AS (SELECT CASE WHEN ca = cb THEN 'AB' WHEN ca = ct THEN 'AT' WHEN cb = ct THEN 'BT' WHEN a IS NULL OR b IS NULL THEN 'single' WHEN ka <> kb THEN 'lex' ELSE 'dispute' END AS confidence,
      CASE WHEN ca = cb THEN a WHEN ca = ct THEN a WHEN cb = ct THEN b WHEN a IS NULL AND b IS NULL THEN t WHEN a IS NULL OR b IS NULL THEN coalesce(a, b) WHEN ka <> kb AND kb THEN b ELSE a END AS chosen FROM x)
    SELECT confidence, chosen, count(*) AS n FROM d GROUP BY ALL""",
)
def decided_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of every word of the turns, decided; the benchmark's words are the lexicon."""
    place, word = F.col("place"), F.col("word")
    a = F.when(place % 11 == 0, None).when(place % 3 == 0, F.lower(word)).otherwise(word)
    b = F.when(place % 13 == 0, None).when(place % 4 == 0, F.concat(F.reverse(word), F.lit("."))).otherwise(F.concat(word, F.lit(",")))
    readings = _said(spark, sf_dir).select("conv_id", "turn", "place", a.alias("a"), b.alias("b"), F.when(place % 5 != 0, F.concat(F.lit("("), word)).alias("t"))
    lexicon = table(spark, sf_dir, "benchmark").select(F.explode(words(F.lower("text"))).alias("word"))
    return consensus.decide_words(readings, lexicon).groupBy("confidence", "chosen").agg(F.count(F.lit(1)).alias("n"))


_TITLES = "t AS (SELECT conv_id, turn, w[1] || ' ' || w[2] || ' ' || w[3] AS a, w[1] || ' ' || CASE WHEN turn % 2 = 0 THEN w[2] ELSE w[3] END || ' ' || CASE WHEN conv_id % 3 = 0 THEN w[1] ELSE w[3] END AS b, CASE WHEN conv_id % 5 = 0 THEN w[3] ELSE w[1] || ' ' || w[1] || ' ' || w[3] END AS c FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-zÀ-ɏḀ-ỿ]+') AS w FROM conversations) WHERE len(w) >= 3)"


@query(
    "voted_titles",
    f"""WITH {_TITLES}, x AS (SELECT *, string_split(a, ' ') AS p, string_split(b, ' ') AS q, string_split(c, ' ') AS r FROM t),
    v AS (SELECT *, [CASE WHEN p[i] = q[i] OR p[i] = r[i] THEN p[i] WHEN q[i] = r[i] THEN q[i] END FOR i IN [1, 2, 3]] AS m FROM x)
    SELECT conv_id, turn, CASE WHEN len(r) = 3 AND m[1] IS NOT NULL AND m[2] IS NOT NULL AND m[3] IS NOT NULL THEN array_to_string(m, ' ') WHEN a = b OR a = c THEN a WHEN b = c THEN b END AS title FROM v""",
)
def voted_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that two of three readings of a turn's first words agree on."""
    w = words(F.col("text"))
    turns = table(spark, sf_dir, "conversations").withColumn("w", w).where("size(w) >= 3")
    one, two, three = (F.element_at("w", k) for k in (1, 2, 3))
    a, b = F.concat_ws(" ", one, two, three), F.concat_ws(" ", one, F.when(F.col("turn") % 2 == 0, two).otherwise(three), F.when(F.col("conv_id") % 3 == 0, one).otherwise(three))
    c = F.when(F.col("conv_id") % 5 == 0, three).otherwise(F.concat_ws(" ", one, one, three))
    return turns.select("conv_id", "turn", consensus.vote_titles(a, b, c).alias("title"))


_MARKS = "॥ 4-6 ॥"


@query(
    "assembled_units",
    f"""WITH {_LINES}, p AS (SELECT doc_id, line, string_split(replace(text, '. ', ' {_MARKS} '), '{_MARKS}') AS c FROM l), k AS (SELECT doc_id, doc_id // 100 AS vol, line, i, trim(c[i]) AS text, i < len(c) AS marked FROM p, unnest(range(1, len(c) + 1)) u(i) WHERE trim(c[i]) <> '' OR i < len(c)),
    n AS (SELECT *, coalesce(sum(marked::INT) OVER (PARTITION BY vol ORDER BY doc_id, line, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS unit FROM k)
    SELECT vol, unit, max(CASE WHEN marked THEN 4 END) AS a, max(CASE WHEN marked THEN 6 END) AS b, coalesce(string_agg(text, ' ' ORDER BY doc_id, line, i) FILTER (text <> ''), '') AS text, count(DISTINCT doc_id) AS pages, bool_or(marked) AS closed,
      array_to_string(list_filter([CASE WHEN coalesce(string_agg(text, ' ' ORDER BY doc_id, line, i) FILTER (text <> ''), '') LIKE '%[?]%' THEN 'uncertain' END, CASE WHEN regexp_matches(coalesce(string_agg(text, ' ' ORDER BY doc_id, line, i) FILTER (text <> ''), ''), '[<>{{}}#@~^\\\\]') THEN 'stray_symbols' END,
        CASE WHEN NOT bool_or(marked) THEN 'no_end_marker' END, CASE WHEN length(coalesce(string_agg(text, ' ' ORDER BY doc_id, line, i) FILTER (text <> ''), '')) < 12 THEN 'short' END, CASE WHEN count(DISTINCT doc_id) > 1 THEN 'continued' END], lambda f: f IS NOT NULL), ',') AS flags
    FROM n GROUP BY vol, unit""",
)
def assembled_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the pages of volumes of 100, put together to units from one marker to the next, with their flags."""
    paragraphs = F.transform(F.split("text", "\n"), lambda t: F.replace(F.btrim(t), F.lit(". "), F.lit(f" {_MARKS} ")))
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("vol"), "doc_id", paragraphs.alias("paragraphs"))
    units = assemble.assemble_units(docs, ["vol"], "doc_id")
    return units.select("vol", "unit", "a", "b", "text", F.size("pages").cast("long").alias("pages"), "closed", F.array_join("flags", ",").alias("flags"))


@query(
    "letter_error_rates",
    f"""WITH t AS (SELECT conv_id, turn, translate(text, '{_ACCENTS[0]}', '{_ACCENTS[1]}') AS text FROM conversations)
    SELECT conv_id, turn, round(levenshtein(text, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) / greatest(length(text), 1), 6) AS rate FROM t""",
)
def letter_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each turn is from the next, accents aside, as a character error rate."""
    plain = table(spark, sf_dir, "conversations").withColumn("text", F.translate("text", *_ACCENTS))
    turns = sequence.neighbour(plain, ["conv_id"], ["turn"], "text", 1, "after").withColumn("after", F.coalesce("after", F.lit("")))
    return turns.select("conv_id", "turn", F.round(consensus.error_rate(F.col("text"), F.col("after")), 6).alias("rate"))


@query(
    "line_classes",
    f"""WITH {_LINES}, t AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS x, regexp_replace(CASE WHEN line % 2 = 0 THEN lower(text) ELSE replace(text, ' ', '  ') END, '\\s+', ' ', 'g') AS y, regexp_replace(CASE line % 3 WHEN 0 THEN lower(text) WHEN 1 THEN text ELSE '' END, '\\s+', ' ', 'g') AS z FROM l)
    SELECT CASE WHEN x = y THEN 'same' WHEN y = z THEN 'stored_wrong' WHEN x = z THEN 'reader_wrong' ELSE 'unclear' END AS class, count(*) AS lines FROM t GROUP BY 1""",
)
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three texts of every line compared: which one is wrong."""
    text, line = F.col("text"), F.col("line")
    read = F.when(line % 2 == 0, F.lower(text)).otherwise(F.replace(text, F.lit(" "), F.lit("  ")))
    third = F.when(line % 3 == 0, F.lower(text)).when(line % 3 == 1, text).otherwise(F.lit(""))
    return _lines(spark, sf_dir).groupBy(consensus.comparison_class(text, read, third).alias("class")).agg(F.count(F.lit(1)).alias("lines"))


@query("rescored", "SELECT conv_id, arg_max(text, {'s': -length(text) - 4.0 * (length(text) - length(replace(text, '.', ''))), 't': text}) AS text FROM conversations GROUP BY conv_id")
def rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn of each conversation with the best score, full stops counting as unknown words."""
    stops = F.char_length("text") - F.char_length(F.replace("text", F.lit("."), F.lit("")))
    return consensus.rescore(table(spark, sf_dir, "conversations").select("conv_id", "text", (-F.char_length("text")).cast("double").alias("loglik"), stops.alias("unknown")), ["conv_id"])


MISREAD = ((0, "é", "e"), (1, "th", "t"), (2, "ei", "ie"), (3, "n", "m"), (4, "s", ""))


@query(
    "misread_words",
    f"""WITH f AS (SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[A-Za-zÀ-ɏḀ-ỿ]+')) AS word FROM documents) GROUP BY word),
    s AS (SELECT * FROM (VALUES {", ".join(f"({p}, '{a}', '{b}')" for p, a, b in MISREAD)}) v(place, old, new)),
    c AS (SELECT f.word, place, replace(f.word, old, new) AS fixed FROM f JOIN s ON contains(f.word, old) JOIN f g ON g.word = replace(f.word, old, new) WHERE f.freq <= 3 AND g.freq >= 3 AND g.freq > 3 * f.freq)
    SELECT word, arg_min(fixed, place) AS fixed FROM c GROUP BY word""",
)
def misread_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare words of the documents that one substitution turns into a common one."""
    freq = table(spark, sf_dir, "documents").select(F.explode(words(F.lower("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    return consensus.fix_misreads(freq, spark.createDataFrame(list(MISREAD), "place int, old string, new string"))


@query(
    "grown_regions",
    """WITH m AS (SELECT conv_id, turn, length(text) < 160 OR text LIKE '%!%' AS leans, text LIKE '%!%' AS seed FROM conversations),
    g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, leans ORDER BY turn) AS island FROM m),
    h AS (SELECT *, leans AND bool_or(seed) OVER (PARTITION BY conv_id, leans, island) AS hit FROM g)
    SELECT conv_id, turn, hit OR coalesce(lag(hit) OVER w, false) OR coalesce(lead(hit) OVER w, false) AS in_region FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def grown_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns around a call, grown over short turns and one turn more on either side."""
    turns = table(spark, sf_dir, "conversations")
    return sequence.grow_regions(turns, ["conv_id"], ["turn"], F.char_length("text") < 160, F.contains("text", F.lit("!"))).select("conv_id", "turn", "in_region")


@query("ranges_of_points", "SELECT d.doc_id, r.doc_id AS held_by FROM documents d LEFT JOIN documents r ON r.source = d.source AND r.doc_id % 3 = 0 AND d.doc_id BETWEEN r.doc_id AND r.doc_id + 40 AND NOT EXISTS (SELECT 1 FROM documents x WHERE x.source = d.source AND x.doc_id % 3 = 0 AND x.doc_id > r.doc_id AND x.doc_id <= d.doc_id)")
def ranges_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of its source that each document lies in; ranges begin at every third id and end 40 on, or at the next."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    ranges = docs.where("doc_id % 3 = 0").select("source", F.col("doc_id").alias("low"), (F.col("doc_id") + 40).alias("high"), F.col("doc_id").alias("held_by"))
    return intervals.point_lookup(docs, ranges, ["source"], "doc_id", "low", "high", ["held_by"]).select("doc_id", "held_by")


@query("fenced_answers", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events")
def fenced_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records out of answers that come in a code fence, cut short in every seventh."""
    props = F.col("props")
    said = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("```json\n"), F.regexp_replace(props, ":.*", ""))).when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).otherwise(props)
    return table(spark, sf_dir, "events").select("event_id", pages.tolerant_json(said, "k int", "k")["k"].alias("k"))


@query("found_in_columns", "SELECT p_partkey, p_brand FROM part WHERE lower(p_name) LIKE '%old%' OR lower(p_type) LIKE '%old%' OR lower(p_brand) LIKE '%old%'")
def found_in_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a text in one of three columns, letter case aside."""
    return table(spark, sf_dir, "part").where(tables.contains_any(["p_name", "p_type", "p_brand"], F.lit("OLD"))).select("p_partkey", "p_brand")


@query("rows_of_ids", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def rows_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose labels call them good."""
    return tables.by_ids(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("doc_id", "lang", "source")


@query("older_schema", "SELECT event_id, user_id::INTEGER AS user_id, NULL::VARCHAR AS channel FROM events")
def older_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under a newer schema, with a column that the table lacks."""
    return tables.with_columns_present(table(spark, sf_dir, "events"), {"event_id": "long", "user_id": "int", "channel": "string"})


_FOLDED = "translate(regexp_replace(regexp_replace(w, '[śṣ]', 'sh', 'g'), '[ṛṝ]', 'ri', 'g'), 'āĀīĪūŪṭṬḍḌṇṅñṆṄṃṁḥḷḶ', 'aAiIuUtTdDnnnNNmmhlL')"


@query("everyday_spelling", f"WITH w AS (SELECT DISTINCT translate(w, 'aeioszSZ', 'āṛīūśṣḍṅ') AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ɏḀ-ỿ]+')) AS w FROM documents)) SELECT w AS word, {_FOLDED} AS plain FROM w")
def everyday_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scholarly letters in everyday spelling."""
    word = F.translate("word", "aeioszSZ", "āṛīūśṣḍṅ")
    return table(spark, sf_dir, "documents").select(F.explode(words(F.col("text"))).alias("word")).select(word.alias("word")).distinct().withColumn("plain", plain_roman(F.col("word")))


@query(
    "hit_snippets",
    """WITH h AS (SELECT doc_id, text, instr(text, ' the ') + 1 AS pos, length(text) AS n FROM documents WHERE contains(text, ' the ')), p AS (SELECT *, greatest(pos - 36, 1) AS low, least(pos + 39, n + 1) AS high FROM h),
    s AS (SELECT *, text[low:high - 1] AS a FROM p), t AS (SELECT *, CASE WHEN low > 1 THEN regexp_replace(a, '^\\S*\\s', '') ELSE a END AS b FROM s)
    SELECT doc_id, CASE WHEN low > 1 THEN '…' ELSE '' END || CASE WHEN high <= n THEN regexp_replace(b, '\\s\\S*$', '') || '…' ELSE b END AS snippet FROM t""",
)
def hit_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around the first hit of a word, cut at blanks."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit(" the ")))
    return docs.select("doc_id", snippet(F.col("text"), F.position(F.lit(" the "), F.col("text")) + 1, F.lit(3)).alias("snippet"))


@query("marker_numbers", "SELECT l_orderkey, l_linenumber, l_linenumber AS a, CASE WHEN l_partkey % 2 = 0 THEN (l_linenumber + l_suppkey % 9)::INTEGER ELSE l_linenumber END AS b FROM lineitem")
def marker_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of verse markers in the digits of three scripts."""
    ascii_digits = F.concat(F.lit("॥ "), F.col("l_linenumber").cast("string"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("-"), (F.col("l_linenumber") + F.col("l_suppkey") % 9).cast("string"))).otherwise(F.lit("")), F.lit(" ॥"))
    said = F.when(F.col("l_suppkey") % 3 == 0, ascii_digits).when(F.col("l_suppkey") % 3 == 1, F.translate(ascii_digits, "0123456789", "०१२३४५६७८९")).otherwise(F.translate(ascii_digits, "0123456789", "୦୧୨୩୪୫୬୭୮୯"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", marker_range(said).alias("m")).select("l_orderkey", "l_linenumber", "m.*")


@query("clean_titles", "SELECT p_partkey, p_name || ' ' || p_type AS title FROM part")
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents lines without bullets, leaders and page numbers."""
    line = F.concat(F.lit("• "), F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" ..... "), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", title_cleanup(line).alias("title"))


@query("words_by_column", "WITH a AS (SELECT 'en' AS lang, unnest(regexp_extract_all(p_name, '[A-Za-zÀ-ɏḀ-ỿ''’]+')) AS word FROM part UNION ALL SELECT 'iast', unnest(regexp_extract_all(p_type, '[A-Za-zÀ-ɏḀ-ỿ]+')) FROM part) SELECT lang, word, count(*) AS n FROM a GROUP BY ALL")
def words_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two columns, each cut by its own language."""
    held = table(spark, sf_dir, "part").select(F.explode(words_of_columns({"p_name": "en", "p_type": "iast"})).alias("w")).select("w.*")
    return held.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


@query("bare_tokens", "SELECT token, count(*) AS n FROM (SELECT trim(t, '.,;:!?\"''‘’“”()[]{}।॥-—–') AS token FROM (SELECT unnest(regexp_split_to_array(trim(text), '\\s+')) AS t FROM conversations)) WHERE token <> '' GROUP BY token")
def bare_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of turns without the punctuation at their ends."""
    tokens = table(spark, sf_dir, "conversations").select(F.explode(F.split(F.btrim("text"), "\\s+")).alias("t")).select(core(F.col("t")).alias("token"))
    return tokens.where("token != ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "lines_not_quoted",
    f"""WITH {_LINES}, k AS (SELECT DISTINCT doc_id // 40 AS vol, text FROM l WHERE doc_id % 40 < 20), f AS (SELECT doc_id // 40 AS vol, doc_id * 10000 + line AS line, text FROM l WHERE doc_id % 40 >= 20),
    r AS (SELECT f.* FROM f ANTI JOIN k ON f.vol = k.vol AND f.text = k.text)
    SELECT vol, count(*)::BIGINT AS lines, string_agg(text, ' ' ORDER BY line, text) AS text FROM r GROUP BY vol""",
)
def lines_not_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the second 20 documents of each volume of 40 that the first 20 don't hold, glued."""
    held = _lines(spark, sf_dir).select(F.floor(F.col("doc_id") / 40).alias("vol"), (F.col("doc_id") * 10000 + F.col("line")).alias("line"), "text", (F.col("doc_id") % 40 < 20).alias("first_half"))
    glued = assemble.segments_not_in(held.where("not first_half").select("vol", "line", "text"), held.where("first_half"), "vol")
    fresh = held.where("not first_half").join(held.where("first_half").select("vol", "text").distinct(), ["vol", "text"], "left_anti").groupBy("vol").agg(F.count(F.lit(1)).alias("lines"))
    return glued.join(fresh, "vol").select("vol", "lines", "text")


@query("meanings_of_groups", "SELECT p_name AS word, 'about ' || p_brand AS gloss FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) > 3)")
def meanings_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meaning given to a spelling group, for every member of it."""
    part = table(spark, sf_dir, "part")
    meanings = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).where("n > 3").select("p_brand", F.concat(F.lit("about "), F.col("p_brand")).alias("gloss"))
    return lookup.spread_to_group(meanings, part.select("p_brand", F.col("p_name").alias("word")), "p_brand")


@query(
    "misplaced_turns",
    f"""WITH {_SAID}, o AS (SELECT DISTINCT conv_id, turn, lower(word) AS word FROM s), n AS (SELECT conv_id, turn, count(*) AS n FROM o GROUP BY ALL),
    f AS (SELECT a.conv_id, a.turn, b.turn - a.turn AS step, count(*) AS held FROM o a JOIN o b ON a.conv_id = b.conv_id AND a.word = b.word AND abs(a.turn - b.turn) = 1 GROUP BY ALL),
    g AS (SELECT n.conv_id, n.turn, n, coalesce(max(held) FILTER (step = -1), 0) AS before, coalesce(max(held) FILTER (step = 1), 0) AS after FROM n LEFT JOIN f ON n.conv_id = f.conv_id AND n.turn = f.turn GROUP BY ALL)
    SELECT conv_id, turn, greatest(before, after)::BIGINT AS shared, n FROM g WHERE greatest(before, after) / n >= 0.3 AND greatest(before, after) / n - least(before, after) / n >= 0.1""",
)
def misplaced_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose words fit one neighbour better than the other."""
    own = _said(spark, sf_dir).select("conv_id", "turn", F.lower("word").alias("word")).distinct()
    sizes = own.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    # A word's turns beside each other, by one pass over each word of a conversation.
    beside = [sequence.neighbour(own, ["conv_id", "word"], ["turn"], "turn", step, "other").where(F.abs(F.col("other") - F.col("turn")) == 1).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias(name)) for step, name in ((-1, "before"), (1, "after"))]
    fits = sizes.join(beside[0], ["conv_id", "turn"], "left").join(beside[1], ["conv_id", "turn"], "left").fillna(0)
    low, high = F.least("before", "after"), F.greatest("before", "after")
    rated = fits.select("conv_id", "turn", "n", high.alias("shared"), (low / F.col("n")).alias("own"), (high / F.col("n")).alias("prev"), F.lit(None).cast("double").alias("next"))
    return quality.misplaced(rated, ["conv_id"], "turn", least=0.3, gain=0.1).select("conv_id", "turn", "shared", "n")


@query("page_risks", "SELECT doc_id, round((length(text) - length(replace(text, '?', '')) + 2 * (length(text) - length(replace(text, '!', ''))) + 3 * (length(text) - length(replace(text, '#', '')))) * 100.0 / greatest(len(regexp_extract_all(text, '[A-Za-zÀ-ɏḀ-ỿ]+')), 1), 6) AS risk, ceil(len(regexp_extract_all(text, '[A-Za-zÀ-ɏḀ-ỿ]+')) / 200)::BIGINT AS minutes FROM documents")
def page_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of each document as a page, signs standing for doubtful words, and the minutes it takes to read."""

    def count(sign: str):
        return F.char_length("text") - F.char_length(F.replace("text", F.lit(sign), F.lit("")))

    n = F.size(words(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(quality.risk(count("?"), count("!"), count("#"), n), 6).alias("risk"), review.minutes(n).alias("minutes"))


@query(
    "common_starts",
    f"""WITH {_SAID}, p AS (SELECT conv_id, turn, place, lower(word) AS a, lower(lead(word) OVER (PARTITION BY conv_id, turn ORDER BY place)) AS b FROM s), n AS (SELECT *, least(length(a), length(b)) AS n FROM p WHERE b IS NOT NULL),
    c AS (SELECT *, len(list_filter(range(1, n + 1), lambda i: left(a, i) = left(b, i))) AS same FROM n)
    SELECT a, b, round(max(CASE WHEN n < 4 THEN CASE WHEN a = b THEN 1.0 ELSE 0.0 END WHEN same >= 4 THEN same / n ELSE 0.0 END), 6) AS likeness FROM c GROUP BY a, b""",
)
def common_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the words are that stand side by side, by their common start."""
    beside = sequence.neighbour(_said(spark, sf_dir), ["conv_id", "turn"], ["place"], "word", 1, "after").where("after IS NOT NULL")
    pairs = beside.select(F.lower("word").alias("a"), F.lower("after").alias("b")).distinct()
    return pairs.select("a", "b", F.round(common_prefix_likeness(F.col("a"), F.col("b")), 6).alias("likeness"))


@query(
    "contents_entries",
    """WITH t AS (SELECT p_brand, p_partkey, p_partkey % 4 AS k, p_name, p_type, p_size FROM part), r AS (SELECT *, sum((k = 0)::INT) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS entry FROM t WHERE k <> 3)
    SELECT p_brand, entry::BIGINT AS entry, max(CASE WHEN k = 0 THEN p_partkey END)::INTEGER AS number, string_agg(CASE WHEN k = 0 THEN p_name ELSE p_type END, ' ' ORDER BY p_partkey) AS title FROM r WHERE entry > 0 GROUP BY p_brand, entry""",
)
def contents_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents lines made of parts: numbered ones begin an entry, others go on with it, page heads go."""
    k, number = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    line = F.when(k == 0, F.concat(number, F.lit(". "), F.col("p_name"), F.lit(" ..... "), F.col("p_size").cast("string"))).when(k == 3, F.lit(" Contents ")).otherwise(F.col("p_type"))
    return assemble.fold_entry_lines(table(spark, sf_dir, "part").select("p_brand", "p_partkey", line.alias("text")), ["p_brand"], "p_partkey")


@query(
    "candidate_pages",
    """WITH m AS (SELECT conv_id, max(turn) FILTER (turn % 3 = 0) AS last FROM conversations GROUP BY conv_id), x AS (SELECT c.conv_id, turn, 2 * (turn - turn % 3) AS low, 2 * (turn - turn % 3 + 3) AS high FROM conversations c JOIN m ON c.conv_id = m.conv_id WHERE turn % 3 <> 0 AND turn < last)
    SELECT conv_id AS vol, turn AS num, unnest(range(low, high + 1)) AS page FROM x""",
)
def candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages where a missing unit may be: from that of the last known one before it to that of the first one after it."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("vol"), F.col("turn").alias("num"))
    known = turns.where("num % 3 = 0").withColumn("page", 2 * F.col("num"))
    return intervals.candidate_places(turns.where("num % 3 != 0"), known, ["vol"])


@query("checked_answers", "SELECT p_partkey::INTEGER AS id, CASE p_size % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'z' ELSE NULL END AS choice, CASE WHEN p_size % 4 = 2 THEN p_name END AS text, 'high' AS confidence FROM part WHERE p_partkey % 5 <> 0 AND (p_size % 4 = 0 OR p_size % 4 = 2)")
def checked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about parts that name a known part and one of its options, or have a text of their own."""
    part, k = table(spark, sf_dir, "part"), F.col("p_size") % 4
    answer = F.struct(F.col("p_partkey").cast("int").alias("id"), F.when(k == 0, "a").when(k == 1, "z").alias("choice"), F.when(k == 2, F.col("p_name")).alias("text"), F.lit("high").alias("confidence"))
    replies = part.select(F.concat(F.lit("```json\n"), F.to_json(F.array(answer)), F.lit("\n```")).alias("reply"))
    options = part.where("p_partkey % 5 != 0").select(F.col("p_partkey").cast("int").alias("id"), F.array(F.lit("a"), F.lit("b")).alias("options"))
    return pages.check_answers(replies, options)


@query("joined_lists", "SELECT p_partkey, word FROM (SELECT p_partkey, trim(unnest(string_split(replace(p_name, ' ', ' | | '), '|'))) AS word FROM part) WHERE word <> ''")
def joined_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of lists that are joined by bars, empty ones left out."""
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(tables.split_list(F.replace("p_name", F.lit(" "), F.lit(" | | ")))).alias("word"))


@query("tidy_dashes", "SELECT l_orderkey, l_linenumber, l_linenumber || '-' || l_suppkey || ' a — b' AS text FROM lineitem")
def tidy_dash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of numbers with a hyphen, asides with a long dash."""
    said = F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_partkey") % 2 == 0, F.lit(" – ")).otherwise(F.lit("—")), F.col("l_suppkey").cast("string"), F.lit(" a - b"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", normalize.tidy_dashes(said).alias("text"))


_DOUBTED = "replace(replace(text, ' the ', ' the[?] '), ',', '[?],')"


@query("settled_texts", f"SELECT conv_id, turn, CASE WHEN {_DOUBTED} LIKE '%[?]%' THEN regexp_replace(regexp_replace(text, '[ \\t]{{2,}}', ' ', 'g'), ' +([,.;:!?])', '\\1', 'g') ELSE text END AS text FROM conversations")
def settled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns without the marks of doubt that were put into them."""
    doubted = F.replace(F.replace("text", F.lit(" the "), F.lit(" the[?] ")), F.lit(","), F.lit("[?],"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", normalize.strip_doubt(doubted).alias("text"))


@query(
    "unwrapped_texts",
    r"SELECT doc_id, trim(replace(regexp_replace(replace(regexp_replace(replace(text, '-' || chr(10), ''), '\n\n+', chr(1), 'g'), chr(10), ' '), '[ \t]{2,}', ' ', 'g'), chr(1), chr(10) || chr(10)), ' ') AS text FROM documents",
)
def unwrapped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with wrapped lines joined and paragraphs kept."""
    return table(spark, sf_dir, "documents").select("doc_id", normalize.clean_translation(F.col("text")).alias("text"))


@query(
    "nearest_quotes",
    """WITH p AS (SELECT conv_id, turn, i, abs(i - length(text) // 2) AS d FROM conversations, unnest(range(1, length(text) + 1)) u(i) WHERE substr(text, i, 3) IN ('the', 'der', 'los') AND substr(text, i, 3) = CASE WHEN contains(text, 'the') THEN 'the' WHEN contains(text, 'der') THEN 'der' ELSE 'los' END)
    SELECT c.conv_id, c.turn, min({'d': d, 'i': i}).i::INTEGER AS found FROM conversations c LEFT JOIN p ON c.conv_id = p.conv_id AND c.turn = p.turn GROUP BY ALL""",
)
def nearest_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a quote stands that is nearest to the middle of its turn."""
    quote = F.when(F.contains("text", F.lit("the")), "the").when(F.contains("text", F.lit("der")), "der").otherwise("los")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", nearest_occurrence(F.col("text"), quote, F.floor(F.char_length("text") / 2)).cast("int").alias("found"))


@query("folds_of_pages", "SELECT (doc_id // 25 % 4)::BIGINT AS fold, count(*) AS docs FROM documents GROUP BY 1")
def folds_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four folds in blocks of 25 documents."""
    return table(spark, sf_dir, "documents").groupBy(sampling.block_fold(F.col("doc_id"), 4).cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("docs"))


@query("unreadable_words", "WITH w AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ɏḀ-ỿ]+')) AS w FROM documents)) SELECT word FROM w WHERE length(word) < 3 OR NOT regexp_matches(word, '[aeiouāīū]')")
def unreadable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that nobody would write: too short, or without a vowel."""
    found = table(spark, sf_dir, "documents").select(F.explode(words(F.lower("text"))).alias("word")).distinct()
    return found.where(broken(F.col("word")))


@query("review_priorities", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' ELSE 'sample' END AS reason, doc_id % 17 AS score, CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS priority FROM labels")
def review_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to look at first: toxic documents, poor ones, then the rest."""
    flags = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("sample").alias("reason"), (F.col("doc_id") % 17).alias("score"))
    return quality.review_queue(flags, {"toxic": 0, "poor": 1})


_UNITS = "u AS (SELECT conv_id AS vol, turn AS k, CASE WHEN turn % 6 <> 5 THEN (turn * 7 + conv_id) % 5 + 1 END AS a, CASE WHEN (turn + conv_id) % 9 = 4 THEN turn % 7 + 1 END AS heading, turn % 8 = 5 AS colophon, CASE WHEN turn % 5 <> 2 THEN turn // 4 + 1 END AS head, conv_id % 4 = 0 AND turn BETWEEN 2 AND 6 AS strict FROM conversations)"


@query(
    "chapter_starts",
    f"""WITH RECURSIVE {_UNITS}, w AS (
      SELECT DISTINCT vol, -1::BIGINT AS k, 1::BIGINT AS chapter, 0::BIGINT AS last, false AS closed, 0 AS off FROM u
      UNION ALL
      SELECT vol, k, CASE c WHEN 1 THEN heading WHEN 2 THEN chapter + 1 WHEN 3 THEN head ELSE chapter END, coalesce(a, CASE WHEN c > 0 THEN 0 ELSE last END), colophon, CASE WHEN c > 0 THEN 0 ELSE off END FROM (
        SELECT *, CASE WHEN heading IS NOT NULL AND heading <> chapter THEN 1 WHEN strict THEN 0 WHEN closed OR (a = 1 AND last > 1) THEN 2 WHEN off >= 2 THEN 3 ELSE 0 END AS c FROM (
          SELECT u.vol, u.k, u.a, heading, u.colophon, head, strict, chapter, last, closed, CASE WHEN head IS NOT NULL AND head <> chapter THEN off + 1 ELSE 0 END AS off FROM w JOIN u ON u.vol = w.vol AND u.k = w.k + 1)))
    SELECT vol, k, chapter::INTEGER AS chapter FROM w WHERE k >= 0""",
)
def chapter_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of conversations read as volumes: headings, restarts at 1, colophons, running heads, and ranges where only headings count."""
    turn, conv = F.col("turn"), F.col("conv_id")
    units = table(spark, sf_dir, "conversations").select(
        conv.alias("vol"),
        turn.alias("k"),
        F.when(turn % 6 != 5, (turn * 7 + conv) % 5 + 1).cast("int").alias("a"),
        F.when((turn + conv) % 9 == 4, turn % 7 + 1).cast("int").alias("heading"),
        (turn % 8 == 5).alias("colophon"),
        F.when(turn % 5 != 2, F.floor(turn / 4) + 1).cast("int").alias("running_head"),
    )
    ranges = units.where("vol % 4 = 0").select("vol").distinct().select("vol", F.lit(2).cast("long").alias("first"), F.lit(6).cast("long").alias("last"))
    return assemble.chapter_breaks(assemble.mark_strict(units, ranges, ["vol"], "k"), ["vol"], "k").select("vol", "k", "chapter")


@query(
    "resynced_entries",
    """WITH RECURSIVE e AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, CASE WHEN p_partkey % 7 <> 0 THEN p_size % 9 END AS n FROM part),
    w AS (SELECT DISTINCT p_brand, NULL::BIGINT AS p_partkey, 0::BIGINT AS i, 0::BIGINT AS now FROM part
      UNION ALL SELECT e.p_brand, e.p_partkey, e.i, CASE WHEN n > now AND n <= now + 3 THEN n ELSE now + 1 END FROM w JOIN e ON e.p_brand = w.p_brand AND e.i = w.i + 1)
    SELECT p_brand, p_partkey, now::INTEGER AS chapter FROM w WHERE i > 0""",
)
def resynced_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed numbers of a brand's parts followed by a counter that trusts a number a little ahead."""
    entries = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") % 9).cast("int").alias("number"))
    return assemble.resync_entries(entries, ["p_brand"], "p_partkey").select("p_brand", "p_partkey", "chapter")
