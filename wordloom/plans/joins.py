"""As-of, range, fallback and similarity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.normalize import script_key
from wordloom.functions.tokens import stems, words
from wordloom.operators import intervals, lookup, patches, review, sequence, similarity
from wordloom.plans.registry import query, table
from wordloom.plans.search import WORDS_SQL, document_words
from wordloom.sources.shared import materialise
from wordloom.sources.tables import from_backup, to_backup

_SUFFIXES = ["ing", "ed", "es", "ly", "s"]
_VOCAB_SQL = f"v AS (SELECT lower(word) AS word, count(*) AS freq FROM ({WORDS_SQL}) GROUP BY 1)"
#: DuckDB counts edits in bytes, so each accented letter of the tables gets one byte that no word holds.
_ACCENTS = "ßäçèéêíñóöü"


def _bytes_sql(word: str) -> str:
    return f"translate({word}, '{_ACCENTS}', '0123456789_')"


_BENCH_SQL = "b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-zÀ-ɏḀ-ỿ]+'))) AS word FROM benchmark)"


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_words(spark, sf_dir).groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("freq"))


def _bench_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(words(F.col("text"))).alias("word")).select("item_id", F.lower("word").alias("word"))


@query("asof_floor", "SELECT e.event_id, p.event_id AS purchase_id, p.value AS purchase_value FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.event_id >= p.event_id")
def asof_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the user's last purchase before it."""
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value"))
    return intervals.floor_join(clicks, bought, ["user_id"], "event_id", "purchase_id", ["purchase_id", "purchase_value"]).drop("user_id")


@query("asof_ceiling", "SELECT e.event_id, p.event_id AS next_error FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') p ON e.user_id = p.user_id AND e.event_id <= p.event_id")
def asof_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view with the user's first error after it."""
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("next_error"))
    return intervals.ceiling_join(events.where("event_type = 'view'").select("event_id", "user_id"), errors, ["user_id"], "event_id", "next_error", ["next_error"]).drop("user_id")


@query(
    "range_containment",
    """WITH r AS (SELECT l_orderkey, l_linenumber AS num, l_linenumber + 1 AS num_end FROM lineitem WHERE l_linenumber % 2 = 1), u AS (SELECT l_orderkey, l_linenumber AS a, l_linenumber + (l_partkey % 4)::INTEGER AS b, l_returnflag || l_linenumber AS text FROM lineitem WHERE l_suppkey % 3 <> 0),
    n AS (SELECT l_orderkey, num, unnest(range(num, num_end + 1)) AS n FROM r), s AS (SELECT u.*, n.num FROM u JOIN n ON u.l_orderkey = n.l_orderkey AND u.a = n.n),
    o AS (SELECT l_orderkey, num, string_agg(text, ' ' ORDER BY a, b, text) AS text FROM s GROUP BY ALL),
    c AS (SELECT x.l_orderkey, n.num, max(x.num) AS carrier FROM (SELECT l_orderkey, num, unnest(range(a, b + 1)) AS n FROM s) x JOIN n ON x.l_orderkey = n.l_orderkey AND x.n = n.n WHERE x.num <> n.num GROUP BY ALL)
    SELECT r.l_orderkey, r.num, o.text, CASE WHEN o.text IS NULL THEN c.carrier END AS carrier FROM r LEFT JOIN o ON r.l_orderkey = o.l_orderkey AND r.num = o.num LEFT JOIN c ON r.l_orderkey = c.l_orderkey AND r.num = c.num""",
)
def range_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units laid onto numbered rows; a row without one points to the row that covers it."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.where("l_linenumber % 2 = 1").select("l_orderkey", F.col("l_linenumber").alias("num"), (F.col("l_linenumber") + 1).alias("num_end"))
    units = lines.where("l_suppkey % 3 != 0").select("l_orderkey", F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + (F.col("l_partkey") % 4).cast("int")).alias("b"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    return intervals.range_containment(units, rows, ["l_orderkey"])


@query("expand_ranges", "SELECT c_custkey, unnest(range(c_nationkey, c_nationkey + (c_custkey % 4)::INTEGER + 1)) AS n FROM customer")
def expand_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each integer of a range."""
    ranges = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("low"), (F.col("c_nationkey") + F.col("c_custkey") % 4).alias("high"))
    return intervals.expand_ranges(ranges, "low", "high", "n").select("c_custkey", "n")


def _strip_sql(w: str) -> str:
    cases = ", ".join(f"CASE WHEN length({w}) > {len(s) + 1} AND suffix({w}, '{s}') THEN left({w}, length({w}) - {len(s)}) END" for s in sorted(_SUFFIXES, key=len, reverse=True))
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


@query(
    "cascade_lookup",
    f"""WITH {_VOCAB_SQL}, f AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-zÀ-ɏḀ-ỿ]+'))) AS form, item_id AS entry_id FROM benchmark), fd AS (SELECT DISTINCT form, entry_id FROM f),
    t AS (SELECT word, flatten(list_transform({_strip_sql('word')}, lambda s: list_concat([s], {_strip_sql('s')}))) AS forms FROM v),
    c AS (SELECT word, 0 AS step, 0 AS place, word AS form FROM v UNION ALL SELECT word, 1, i, forms[i] FROM t, unnest(range(1, len(forms) + 1)) u(i)),
    h AS (SELECT c.word, c.step, min(c.place) AS place, fd.entry_id, c.form FROM c JOIN fd ON c.form = fd.form GROUP BY c.word, c.step, fd.entry_id, c.form)
    SELECT word, CAST(step AS INTEGER) AS step, entry_id FROM h QUALIFY step * 1000 + place = min(step * 1000 + place) OVER (PARTITION BY word)""",
)
def cascade_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words looked up exactly, then by their stems in order."""
    vocabulary = _vocabulary(spark, sf_dir).select("word")
    exact = vocabulary.select("word", F.lit(0).alias("step"), F.lit(0).alias("place"), F.col("word").alias("form"))
    stemmed = vocabulary.select("word", F.lit(1).alias("step"), F.posexplode(stems(F.col("word"), _SUFFIXES)).alias("place", "form"))
    entries = _bench_words(spark, sf_dir).select(F.col("word").alias("form"), F.col("item_id").alias("entry_id")).distinct()
    return lookup.cascade(exact.unionByName(stemmed), entries).select("word", "step", "entry_id")


@query(
    "lookup_coverage",
    f"WITH {_VOCAB_SQL}, {_BENCH_SQL} SELECT sum(freq)::BIGINT AS tokens, sum(CASE WHEN b.word IS NOT NULL THEN freq ELSE 0 END)::BIGINT AS covered_tokens, count(*) AS distinct_words, count(b.word) AS covered_words FROM v LEFT JOIN b ON v.word = b.word",
)
def lookup_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of tokens and words that a lexicon knows."""
    vocabulary = _vocabulary(spark, sf_dir)
    return lookup.coverage(vocabulary, vocabulary.select("word", F.col("word").alias("form")), _bench_words(spark, sf_dir).select(F.col("word").alias("form")))


@query(
    "hydrate_senses",
    """WITH s AS (SELECT l_orderkey AS entry_id, l_linenumber AS idx, CASE l_returnflag WHEN 'R' THEN 'fr' WHEN 'A' THEN 'en' ELSE 'de' END AS gloss_lang, l_linestatus AS gloss FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY CASE WHEN gloss_lang = 'fr' THEN 0 ELSE 1 END, idx, gloss) AS k FROM s WHERE gloss_lang IN ('fr', 'en'))
    SELECT entry_id, string_agg(idx::VARCHAR, ',' ORDER BY k) AS senses FROM r JOIN orders ON entry_id = o_orderkey WHERE k <= 6 GROUP BY entry_id""",
)
def hydrate_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their senses, the preferred language first; entries without any go."""
    senses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_linenumber").alias("idx"), F.when(F.col("l_returnflag") == "R", "fr").when(F.col("l_returnflag") == "A", "en").otherwise("de").alias("gloss_lang"), F.col("l_linestatus").alias("gloss"))
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"))
    return lookup.hydrate(entries, senses, "fr").select("entry_id", F.array_join(F.transform("senses", lambda s: s["idx"].cast("string")), ",").alias("senses"))


_PREFIXES = ("the", "an", "wi", "qu", "éau", "un", "tion", "re", "ha", "los")


@query("prefix_search_ranked", f"WITH {_VOCAB_SQL}, p AS (SELECT unnest({list(_PREFIXES)}) AS prefix) SELECT prefix, word AS headword, CAST(row_number() OVER (PARTITION BY prefix ORDER BY word = prefix DESC, freq DESC, word) AS INTEGER) AS rank FROM p JOIN v ON starts_with(word, prefix) QUALIFY rank <= 20")
def prefix_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headwords by prefix, exact ones first, then by frequency."""
    entries = _vocabulary(spark, sf_dir).withColumnRenamed("word", "headword")
    return lookup.prefix_search(entries, spark.createDataFrame([(p,) for p in _PREFIXES], "prefix string"))


@query("cross_language", f"WITH e AS (SELECT lang, lower(nfc_normalize(word)) AS skey, count(*) AS freq FROM ({WORDS_SQL}) GROUP BY ALL) SELECT w.skey AS word, e.lang AS entry_id, CAST(row_number() OVER (PARTITION BY w.skey ORDER BY e.freq DESC, e.lang) AS INTEGER) AS rank FROM (SELECT * FROM e WHERE lang = 'en') w JOIN e ON w.skey = e.skey AND w.lang <> e.lang QUALIFY rank <= 3")
def cross_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English words that other languages spell alike."""
    # Keys are made of what was written, so no filter on them reaches the tokens; only words beyond ASCII pass through the Unicode step.
    counted = materialise(document_words(spark, sf_dir).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words-by-language")
    plain = ~F.col("word").rlike("[^\\x00-\\x7F]")
    keyed = counted.where(plain).withColumn("skey", F.lower("word")).unionByName(counted.where(~plain).withColumn("skey", script_key(F.col("word"))))
    entries = materialise(keyed.groupBy("lang", "skey").agg(F.sum("n").alias("freq")), "keys-by-language")
    words_ = entries.where("lang = 'en'").select(F.col("skey").alias("word"), "skey", "lang")
    return lookup.cross_script(words_, entries.select(F.col("lang").alias("entry_id"), "skey", "lang", "freq"))


@query("integrity_anti", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)")
def integrity_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose order is missing."""
    return lookup.orphans(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderkey % 7 != 0"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("overlay_priority", "WITH s AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) SELECT o_custkey, o_orderkey, CAST(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS INTEGER) AS source_rank FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY source_rank) = 1")
def overlay_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of the most trusted source that has the key."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("o_orderkey"))
    return lookup.overlay([orders.where(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in ("P", "F", "O")], ["o_custkey"])


@query("protective_merge", "WITH o AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE lower(c_mktsegment) END AS c_mktsegment FROM customer WHERE c_custkey % 3 <> 0) SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(nullif(n.c_mktsegment, ''), o.c_mktsegment) AS c_mktsegment FROM o FULL JOIN n ON o.c_custkey = n.c_custkey")
def protective_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values over old ones, never an empty one."""
    customer = table(spark, sf_dir, "customer")
    new = customer.where("c_custkey % 3 != 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise(F.lower("c_mktsegment")).alias("c_mktsegment"))
    return lookup.protective_merge(customer.where("c_custkey % 5 != 0"), new, ["c_custkey"], ["c_mktsegment"])


@query("occurrence_fix", "WITH u AS (SELECT user_id, event_id, event_type AS printed, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) SELECT user_id, event_id, CASE WHEN k = 2 AND printed IN ('click', 'view') THEN upper(printed) ELSE printed END AS number FROM u")
def occurrence_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of a repeated label put right."""
    units = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("printed"))
    wanted = [F.struct(F.lit(p).alias("printed"), F.lit(2).alias("occurrence"), F.lit(p.upper()).alias("value")) for p in ("click", "view")]
    fixes = units.select("user_id").distinct().select("user_id", F.explode(F.array(*wanted)).alias("f")).select("user_id", "f.*")
    return patches.fix_numbers(units, fixes, ["user_id"], "event_id").select("user_id", "event_id", "number")


@query(
    "apply_moves",
    """WITH m AS (SELECT DISTINCT conv_id, 0::BIGINT AS num, 1 AS place, 1::BIGINT AS source FROM conversations WHERE conv_id % 3 = 0), g AS (SELECT m.conv_id, m.num, string_agg(c.text, chr(10) ORDER BY m.place) AS given FROM m JOIN conversations c ON m.conv_id = c.conv_id AND m.source = c.turn GROUP BY ALL)
    SELECT c.conv_id, c.turn AS num, CASE WHEN g.given IS NOT NULL THEN g.given WHEN m.conv_id IS NULL THEN c.text END AS text FROM conversations c LEFT JOIN g ON c.conv_id = g.conv_id AND c.turn = g.num LEFT JOIN m ON c.conv_id = m.conv_id AND c.turn = m.source""",
)
def apply_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts moved from one turn to another by a reviewed patch."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("num"), "text")
    moves = rows.where("conv_id % 3 = 0").select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("num"), F.lit(1).alias("place"), F.lit(1).cast("long").alias("source"))
    return patches.apply_moves(rows, moves, ["conv_id"])


@query("insert_ignore", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 2, c_custkey) AS k FROM customer) WHERE k = 1")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that were there, and the first new one of each missing key."""
    customer = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    old = customer.where("c_custkey % 2 = 0").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))
    return review.insert_ignore(old, customer.where("c_custkey % 2 = 1"), ["c_nationkey"], "c_custkey")


@query("latest_rows", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change of each key."""
    return review.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("backup_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def backup_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written to JSON rows and restored."""
    customer = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")))
    return from_backup(to_backup(customer, "customer"), "customer", {f.name: f.dataType.simpleString() for f in customer.schema})


@query("edit1_pairs", f"WITH {_BENCH_SQL} SELECT x.word AS left_word, y.word AS right_word FROM b x JOIN b y ON abs(length(x.word) - length(y.word)) <= 1 AND levenshtein({_bytes_sql('x.word')}, {_bytes_sql('y.word')}) <= 1")
def edit1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of benchmark words at most one edit apart."""
    vocabulary = _bench_words(spark, sf_dir).select("word").distinct()
    return similarity.edit1_pairs(vocabulary, vocabulary)


@query(
    "damerau_nearest",
    f"WITH {_VOCAB_SQL}, {_BENCH_SQL}, g AS (SELECT * FROM v WHERE freq >= 20) SELECT b.word, g.word AS nearest, g.freq FROM b JOIN g ON b.word <> g.word AND length(b.word) >= 4 AND abs(length(b.word) - length(g.word)) <= 1 AND damerau_levenshtein({_bytes_sql('b.word')}, {_bytes_sql('g.word')}) = 1 QUALIFY row_number() OVER (PARTITION BY b.word ORDER BY g.freq DESC, g.word) = 1",
)
def damerau_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent word one edit or exchange away."""
    return similarity.nearest_by_frequency(_bench_words(spark, sf_dir).select("word").distinct(), _vocabulary(spark, sf_dir).where("freq >= 20"))


@query(
    "rare_frequent_flags",
    f"WITH {_VOCAB_SQL}, r AS (SELECT word FROM v WHERE freq <= 1 AND length(word) >= 5), g AS (SELECT * FROM v WHERE freq >= 50) SELECT r.word, g.word AS nearest FROM r JOIN g ON abs(length(r.word) - length(g.word)) <= 1 AND damerau_levenshtein({_bytes_sql('r.word')}, {_bytes_sql('g.word')}) = 1 WHERE r.word <> g.word || 's' AND g.word <> r.word || 's' QUALIFY row_number() OVER (PARTITION BY r.word ORDER BY g.freq DESC, g.word) = 1",
)
def rare_frequent_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words seen once that look like a misprint of a frequent one."""
    return similarity.rare_near_frequent(_vocabulary(spark, sf_dir), rare=1, frequent=50, affixes=("s",))


@query("dice_heads", "WITH p AS (SELECT p_partkey, p_brand, p_size, list_distinct(string_split(lower(p_type || ' ' || p_name), ' ')) AS h FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b, round(2 * len(list_intersect(a.h, b.h)) / (len(a.h) + len(b.h)), 6) AS dice FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def dice_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dice similarity of the words of parts of one brand and size."""
    words_ = F.split(F.lower(F.concat("p_type", F.lit(" "), "p_name")), " ")
    return similarity.dice_pairs(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_partkey", words_)


@query("exact_dups", "WITH t AS (SELECT source, regexp_replace(text, '\\s+', '', 'g') AS bare FROM documents) SELECT sha256(bare) AS digest, count(DISTINCT source) AS groups, count(*) AS n FROM t WHERE length(bare) >= 80 GROUP BY bare HAVING count(DISTINCT source) > 1")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several sources share, white space aside."""
    return similarity.exact_copies(table(spark, sf_dir, "documents"), "source")


@query("near_dups")
def near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source whose openings nearly match."""
    return similarity.near_copies(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("first_by_key", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key."""
    return sequence.first_by_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"])[0].select("o_custkey", "o_orderkey")
