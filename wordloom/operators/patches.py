"""Reviewed patches: moves and number fixes, applied once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stamp(moves: DataFrame) -> DataFrame:
    """(stamp): one hash of a patch table, whatever the order of its rows."""
    row = F.to_json(F.struct(*(F.col(c) for c in sorted(moves.columns))))
    return moves.agg(F.sha1(F.array_join(F.array_sort(F.collect_list(row)), "\n")).alias("stamp"))


def apply_moves(rows: DataFrame, moves: DataFrame, by: list[str], applied: DataFrame | None = None) -> DataFrame:
    """Rows (by, num, text) with texts moved: ``moves`` is (by, num, place, source).

    All sources of a group are emptied first, then a target gets its sources'
    texts in order.  Moves are not idempotent: if ``applied`` (stamp) holds the
    patch's stamp, rows stay as they are.
    """
    if applied is not None and not stamp(moves).join(applied, "stamp", "left_semi").isEmpty():
        return rows
    texts = rows.select(*by, F.col("num").alias("source"), "text")
    given = moves.join(texts, [*by, "source"]).groupBy(*by, "num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda p: p["text"]), "\n").alias("given"))
    emptied = moves.select(*by, F.col("source").alias("num")).distinct().withColumn("emptied", F.lit(True))
    joined = rows.join(given, [*by, "num"], "left").join(emptied, [*by, "num"], "left")
    text = F.when(F.col("given").isNotNull(), F.col("given")).when(~F.coalesce("emptied", F.lit(False)), F.col("text"))
    return joined.select(*[c for c in rows.columns if c != "text"], text.alias("text"))


def fix_numbers(units: DataFrame, fixes: DataFrame, by: list[str], order: str) -> DataFrame:
    """Units with printed numbers put right; ``fixes`` is (by, printed, occurrence, value)."""
    from wordloom.operators.sequence import occurrence_number

    counted = occurrence_number(units, [*by, "printed"], [order])
    return counted.join(fixes, [*by, "printed", "occurrence"], "left").withColumn("number", F.coalesce("value", "printed")).drop("value", "occurrence")
