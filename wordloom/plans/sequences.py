"""Carrying, runs, gaps, audits and neighbours over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import sequence
from wordloom.plans.registry import query, table

_LINES_SQL = "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <> 3"
_ISLAND_SQL = f"SELECT l_orderkey, min(l_linenumber) AS low, max(l_linenumber) AS high FROM (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM ({_LINES_SQL})) GROUP BY l_orderkey, g"


@query("speaker_carry", "SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS carried FROM conversations")
def speaker_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last named speaker of each turn."""
    turns = table(spark, sf_dir, "conversations").withColumn("speaker", F.when(F.col("turn") % 3 == 0, F.col("role")))
    return sequence.carry_forward(turns, ["conv_id"], ["turn"], "speaker", "carried").select("conv_id", "turn", "carried")


@query("next_nonempty", "SELECT user_id, event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id::VARCHAR END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS following FROM events")
def next_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's next purchase, the row's own included."""
    events = table(spark, sf_dir, "events").withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string")))
    return sequence.carry_backward(events, ["user_id"], ["event_id"], "bought", "following").select("user_id", "event_id", "following")


@query(
    "speaker_runs",
    """WITH s AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM s) SELECT user_id, run, event_type, count(*) AS "rows" FROM r GROUP BY ALL""",
)
def speaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type by user."""
    return sequence.runs(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_linenumber != 3")


@query("islands", _ISLAND_SQL)
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of consecutive line numbers."""
    return sequence.islands(_lines(spark, sf_dir), ["l_orderkey"], "l_linenumber")


@query("compact_numbers", f"SELECT l_orderkey, string_agg(CASE WHEN low = high THEN low::VARCHAR ELSE low || '-' || high END, ', ' ORDER BY low) AS numbers FROM ({_ISLAND_SQL}) GROUP BY l_orderkey")
def compact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers written as "1-2, 4"."""
    return sequence.compact_numbers(_lines(spark, sf_dir), ["l_orderkey"], "l_linenumber")


@query("missing_numbers", f"WITH d AS ({_LINES_SQL}), f AS (SELECT l_orderkey, unnest(range(1, max(l_linenumber) + 1)) AS n FROM d GROUP BY l_orderkey) SELECT f.l_orderkey, f.n AS l_linenumber FROM f ANTI JOIN d ON f.l_orderkey = d.l_orderkey AND f.n = d.l_linenumber")
def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers below the largest that don't occur."""
    return sequence.missing_numbers(_lines(spark, sf_dir), ["l_orderkey"], "l_linenumber")


_UNITS_SQL = "SELECT l_orderkey, l_linenumber, l_linenumber AS a, l_linenumber + (min(l_partkey) % 4)::INTEGER - 1 AS b FROM lineitem GROUP BY l_orderkey, l_linenumber"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line number of an order."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))


@query(
    "sequence_audit",
    f"""WITH u AS ({_UNITS_SQL}), e AS (SELECT *, coalesce(max(CASE WHEN b >= a THEN b END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM u)
    SELECT l_orderkey, l_linenumber, CASE WHEN b < a THEN 'bad marker' WHEN a <= e THEN 'not increasing after ' || e WHEN e > 0 AND a <> e + 1 THEN 'gap ' || (e + 1) || '-' || (a - 1) END AS problem FROM e""",
)
def sequence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each unit's numbers."""
    units = _units(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + (F.col("part") % 4).cast("int") - 1).alias("b"))
    return sequence.audit_units(units, ["l_orderkey"], ["l_linenumber"]).select("l_orderkey", "l_linenumber", "problem")


@query(
    "audit_sets",
    f"""WITH u AS ({_UNITS_SQL}), s AS (SELECT l_orderkey, unnest(range(a, b + 1)) AS n FROM u WHERE b >= a), w AS (SELECT l_orderkey, unnest(range(1, max(l_linenumber) + 1)) AS n FROM u GROUP BY l_orderkey)
    SELECT l_orderkey, 'missing' AS kind, n FROM (SELECT * FROM w EXCEPT SELECT * FROM s) UNION ALL SELECT l_orderkey, 'extra', n FROM (SELECT * FROM s EXCEPT SELECT * FROM w) UNION ALL SELECT l_orderkey, 'repeated', n FROM s GROUP BY l_orderkey, n HAVING count(*) > 1""",
)
def audit_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, extra and repeated numbers."""
    units = _units(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").cast("long").alias("a"), (F.col("l_linenumber") + F.col("part") % 4 - 1).alias("b"))
    wanted = units.groupBy("l_orderkey").agg(F.max("a").alias("most")).select("l_orderkey", F.explode(F.sequence(F.lit(1).cast("long"), "most")).alias("n"))
    return sequence.audit_sets(units, wanted, ["l_orderkey"])


@query("recents3", "SELECT user_id, event_type, last, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type) AS rank FROM (SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY ALL)) WHERE rank <= 3")
def recents3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's three latest different event types."""
    return sequence.recent_distinct(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", keep=3)


@query("neighbour_step", "SELECT c_custkey, lead(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS following FROM customer")
def neighbour_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer two places on within the nation."""
    return sequence.neighbour(table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_custkey"], "c_custkey", 2, "following").select("c_custkey", "following")


@query("joint_relabel", "SELECT l_orderkey, shown_at, min(l_linenumber) AS low, max(l_linenumber) AS high, CASE WHEN min(l_linenumber) = max(l_linenumber) THEN min(l_linenumber)::VARCHAR ELSE min(l_linenumber) || '-' || max(l_linenumber) END AS label FROM (SELECT *, CASE WHEN l_linenumber % 3 = 2 THEN l_linenumber - 1 ELSE l_linenumber END AS shown_at FROM lineitem) GROUP BY ALL")
def joint_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of texts shown for several numbers."""
    lines = table(spark, sf_dir, "lineitem").withColumn("carrier", F.when(F.col("l_linenumber") % 3 == 2, F.col("l_linenumber") - 1))
    return sequence.joint_labels(lines, ["l_orderkey"], "l_linenumber", "carrier")


@query("hidden_falls", "SELECT l_orderkey, l_linenumber FROM (SELECT *, lag(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS p FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL)) WHERE p >= 30 AND q <= 10")
def hidden_falls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines at which a large quantity is followed by a small one."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return sequence.falls(lines, ["l_orderkey"], ["l_linenumber"], "q", high=30, low=10).select("l_orderkey", "l_linenumber")


@query("first_position", "SELECT user_id, event_id, first_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_error FROM events")
def first_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error at or after each event."""
    return sequence.first_where(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("event_type") == "error", "event_id", "next_error").select("user_id", "event_id", "next_error")
