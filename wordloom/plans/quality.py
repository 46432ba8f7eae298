"""Text profiles, verdicts, votes, intervals, cards and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.parse import strip_markup, version_key, wilson
from wordloom.operators import consensus, quality, review
from wordloom.plans.registry import query, table
from wordloom.streaming import windows


def _count_sql(letters: str) -> str:
    return f"length(text) - length(regexp_replace(text, '{letters}', '', 'g'))"


@query("script_profile", f"SELECT doc_id, ({_count_sql('[A-Za-zÀ-ɏ]')})::BIGINT AS latin, ({_count_sql('[0-9]')})::BIGINT AS digits, ({_count_sql('[ \\t\\n\\f\\r]')})::BIGINT AS spaces FROM documents")
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters, digits and blanks of each text."""
    counted = table(spark, sf_dir, "documents").select("doc_id", quality.letter_shares(F.col("text")).alias("s"))
    return counted.select("doc_id", *(F.col(f"s.{c}").cast("long").alias(c) for c in ("latin", "digits", "spaces")))


@query("length_outliers", "SELECT p_partkey FROM part WHERE length(p_name) >= 5 AND (length(p_type) < 0.4 * length(p_name) OR length(p_type) > 0.9 * length(p_name))")
def length_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose two texts differ much in length."""
    return quality.length_outliers(table(spark, sf_dir, "part"), "p_type", "p_name", high=0.9, least=5).select("p_partkey")


@query("drop_reasons", "SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) < 100 THEN 'short' WHEN NOT regexp_matches(text, '[A-Za-z]') THEN 'no letters' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each rule is the first to drop."""
    text = F.col("text")
    return quality.drop_reasons(table(spark, sf_dir, "documents"), [("empty", text.isNull() | (F.btrim(text) == "")), ("short", F.char_length(text) < 100), ("no letters", ~text.rlike("[A-Za-z]"))])


@query(
    "wilson_ci",
    """WITH c AS (SELECT quality, count(*) AS n, sum(toxic)::BIGINT AS hits FROM labels GROUP BY quality), p AS (SELECT *, hits / n AS p, 1.96 * 1.96 AS zz FROM c)
    SELECT quality, n, hits, floor(greatest(0, (p + zz / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)) * 1000000 + 0.5)::BIGINT AS low_millionths, floor(least(1, (p + zz / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)) * 1000000 + 0.5)::BIGINT AS high_millionths FROM p""",
)
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the share of toxic documents by quality."""
    counts = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").cast("long").alias("hits")).withColumn("ci", wilson(F.col("hits"), F.col("n")))
    return counts.select("quality", "n", "hits", *(F.floor(F.col(f"ci.{c}") * 1_000_000 + 0.5).alias(f"{c}_millionths") for c in ("low", "high")))


@query("vote_majority", "WITH v AS (SELECT user_id, event_id % 7 AS place, event_type, count(*) AS votes FROM events GROUP BY ALL) SELECT user_id, place, event_type AS winner, votes FROM (SELECT *, row_number() OVER w AS k, lead(votes) OVER w AS second FROM v WINDOW w AS (PARTITION BY user_id, place ORDER BY votes DESC, event_type)) WHERE k = 1 AND votes >= 2 AND (second IS NULL OR second < votes)")
def vote_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading that two or more give and more than any other."""
    readings = table(spark, sf_dir, "events").withColumn("place", F.col("event_id") % 7)
    return consensus.majority(readings, ["user_id", "place"], "event_type")


@query("confidence_classes", "SELECT event_type, count(*) AS n, (count(*) * 1000 // (SELECT count(*) FROM events))::BIGINT AS per_mille FROM events GROUP BY event_type")
def confidence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each class, and how many in a thousand."""
    return quality.confidence_summary(table(spark, sf_dir, "events"), "event_type")


@query("html_clean", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'), ' ') AS text FROM pages""")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of each page."""
    return table(spark, sf_dir, "pages").select("page_id", strip_markup(F.col("html")).alias("text"))


@query("props_json", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of each event's JSON."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("semver_order", "SELECT o_orderkey, (o_custkey % 9) || ',' || (o_orderkey % 11) || ',0,0' AS numbers FROM orders")
def semver_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted versions as comparable numbers."""
    version = F.concat(F.lit("v"), (F.col("o_custkey") % 9).cast("string"), F.lit("."), (F.col("o_orderkey") % 11).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(version_key(version), lambda n: n.cast("string")), ",").alias("numbers"))


@query("epoch_day", "SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day FROM orders")
def epoch_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since 1970."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_date(F.to_date("o_orderdate")).cast("long").alias("day"))


@query(
    "review_fold",
    """WITH a AS (SELECT user_id, event_id * 1000 AS ts, event_type <> 'error' AS ok FROM events), l AS (SELECT user_id, max(CASE WHEN NOT ok THEN ts END) AS missed, max(ts) AS last FROM a GROUP BY user_id),
    s AS (SELECT a.user_id, l.last, least(4, sum(CASE WHEN ok AND (missed IS NULL OR ts > missed) THEN 1 ELSE 0 END))::INTEGER AS stage FROM a JOIN l ON a.user_id = l.user_id GROUP BY ALL)
    SELECT user_id, stage, last + [1, 3, 7, 21][least(stage, 3) + 1] * 86400000::BIGINT AS due_at FROM s""",
)
def review_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each card's stage and due time after all answers."""
    answers = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") * 1000).alias("ts"), (F.col("event_type") != "error").alias("ok"))
    return review.fold_reviews(answers, ["user_id"], "ts", "ok")


@query("due_cards", "SELECT event_id FROM events WHERE event_id % 5 < 4 AND ((event_id * 7919) % 3000000000 - 1500000000 <= 0 OR (event_id * 7919) % 3000000000 - 1500000000 > 22 * 86400000::BIGINT)")
def due_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards to show now."""
    cards = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5).alias("stage"), (F.col("event_id") * 7919 % 3_000_000_000).alias("due"))
    return cards.where(review.is_due(F.lit(1_500_000_000).cast("long"), F.col("due"), F.col("stage"))).select("event_id")


@query("tumbling_hours", "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type (the batch twin of the stream)."""
    return windows.tumbling(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("debounced", "SELECT event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NULL OR next - ts >= INTERVAL 2 HOURS")
def debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that no newer one of the user cancels within two hours."""
    return windows.debounced(table(spark, sf_dir, "events"), ["user_id"], "2 hours").select("event_id")
