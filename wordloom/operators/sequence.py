"""Operators on ordered rows: carrying, runs, gaps, audits and neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ordered(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def carry_forward(df: DataFrame, by: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """The last value that is not null or blank; null before the first."""
    value = F.when(F.btrim(column) != "", F.col(column))
    return df.withColumn(out, F.last(value, ignorenulls=True).over(_ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def carry_backward(df: DataFrame, by: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """The next value that is not null or blank, the row's own included."""
    value = F.when(F.btrim(column) != "", F.col(column))
    return df.withColumn(out, F.first(value, ignorenulls=True).over(_ordered(by, order).rowsBetween(0, Window.unboundedFollowing)))


def run_starts(df: DataFrame, by: list[str], order: list[str], column: str, out: str = "starts_run") -> DataFrame:
    """Whether the value differs from the row before."""
    before = F.lag(column).over(_ordered(by, order))
    first = F.row_number().over(_ordered(by, order)) == 1
    return df.withColumn(out, first | ~F.col(column).eqNullSafe(before))


def runs(df: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """(by, run, column, rows): maximal runs of one value."""
    marked = run_starts(df, by, order, column, "_start").withColumn("run", F.sum(F.col("_start").cast("long")).over(_ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "run", column).agg(F.count(F.lit(1)).alias("rows"))


def islands(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """(by, low, high): maximal stretches of consecutive integers; repeats count once."""
    once = df.select(*by, number).distinct()
    island = F.col(number) - F.row_number().over(_ordered(by, [number]))
    return once.withColumn("_island", island).groupBy(*by, "_island").agg(F.min(number).alias("low"), F.max(number).alias("high")).drop("_island")


def compact_numbers(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """(by, numbers): "1-3, 5, 8-9"."""
    part = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", "low", "high"))
    spans = islands(df, by, number).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("low", part.alias("part")))).alias("spans"))
    return spans.select(*by, F.array_join(F.transform("spans", lambda s: s["part"]), ", ").alias("numbers"))


def missing_numbers(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """(by, number): integers from 1 to the group's largest that don't occur."""
    full = df.groupBy(*by).agg(F.max(number).alias("_most")).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_most").cast("long")))).drop("_most")
    return full.join(df.select(*by, F.col(number).cast("long").alias(number)).distinct(), [*by, number], "left_anti")


def audit_units(units: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Units (by, order, a, b) with ``problem``: a bad marker, a number that doesn't increase, or a gap before it."""
    good = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("b") >= F.col("a"))
    w = _ordered(by, order).rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce(F.max(F.when(good, F.col("b"))).over(w), F.lit(0))
    ladder = F.when(~good, F.lit("bad marker")).when(F.col("a") <= end, F.concat(F.lit("not increasing after "), end)).when((end > 0) & (F.col("a") != end + 1), F.concat(F.lit("gap "), end + 1, F.lit("-"), F.col("a") - 1))
    return units.withColumn("problem", ladder)


def audit_sets(units: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """(by, kind, n): expected numbers without a unit (missing), others with one (extra), and repeated ones."""
    seen = units.where("b >= a").withColumn("n", F.explode(F.sequence("a", "b"))).select(*by, "n")
    once = seen.distinct()
    wanted = expected.select(*by, "n").distinct()
    parts = (
        (wanted.join(once, [*by, "n"], "left_anti"), "missing"),
        (once.join(wanted, [*by, "n"], "left_anti"), "extra"),
        (seen.groupBy(*by, "n").count().where("count > 1").drop("count"), "repeated"),
    )
    out = None
    for part, kind in parts:
        part = part.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out.select(*by, "kind", "n")


def repair_numbers(units: DataFrame, by: list[str], order: str) -> DataFrame:
    """Unusable numbers become the previous end plus one, where that is expected and unused.

    Each repair depends on those before it, so a group is walked in order.
    Units: (by, order, a, b, expected array<int>); adds ``repaired``.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ignore_index=True)
        expected = set(rows["expected"].iloc[0]) if rows["expected"].iloc[0] is not None else set()
        used = {int(n) for a, b in zip(rows["a"], rows["b"], strict=True) if pd.notna(a) and pd.notna(b) and b >= a for n in range(int(a), int(b) + 1)}
        end, fixed = 0, []
        for a, b in zip(rows["a"], rows["b"], strict=True):
            usable = pd.notna(a) and pd.notna(b) and b >= a and a > end
            if not usable and end + 1 in expected and end + 1 not in used:
                a = b = end + 1
                used.add(end + 1)
                fixed.append((a, b, True))
            else:
                fixed.append((a, b, False))
            if pd.notna(b):
                end = max(end, int(b))
        rows["a"], rows["b"], rows["repaired"] = zip(*fixed, strict=True)
        rows[["a", "b"]] = rows[["a", "b"]].astype("Int64")
        return rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema) + ", repaired boolean"
    return units.groupBy(*by).applyInPandas(walk, schema)


def occurrence_number(df: DataFrame, by: list[str], order: list[str], out: str = "occurrence") -> DataFrame:
    """1 for the first row with a label, 2 for the next."""
    return df.withColumn(out, F.row_number().over(_ordered(by, order)))


def neighbour(df: DataFrame, by: list[str], order: list[str], column: str, step: int, out: str) -> DataFrame:
    """The value ``step`` rows on (back if negative); null beyond the ends."""
    return df.withColumn(out, F.lead(column, step).over(_ordered(by, order)) if step > 0 else F.lag(column, -step).over(_ordered(by, order)))


def recent_distinct(events: DataFrame, by: list[str], item: str, ts: str, keep: int = 5) -> DataFrame:
    """(by, item, last, rank): the latest ``keep`` different items."""
    last = events.groupBy(*by, item).agg(F.max(ts).alias("last"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("last"), item))
    return last.withColumn("rank", rank).where(F.col("rank") <= keep)


def grow_regions(df: DataFrame, by: list[str], order: list[str], qualifies: Column, seed: Column) -> DataFrame:
    """Rows in a region: a seed, the qualifying rows next to it in an unbroken row, and one row more on either side."""
    w = _ordered(by, order)
    marked = df.withColumn("_in", qualifies | seed).withColumn("_seed", seed)
    start = F.coalesce(F.lag("_in").over(w), F.lit(False)) != F.col("_in")
    marked = marked.withColumn("_run", F.sum(start.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grown = marked.withColumn("_hit", F.col("_in") & F.max("_seed").over(Window.partitionBy(*by, "_run")))
    near = F.coalesce(F.lag("_hit").over(w), F.lit(False)) | F.coalesce(F.lead("_hit").over(w), F.lit(False))
    return grown.withColumn("in_region", F.col("_hit") | near).drop("_in", "_seed", "_run", "_hit")


def joint_labels(df: DataFrame, by: list[str], number: str, carrier: str) -> DataFrame:
    """(by, carrier, label): "a-b" over the rows that a text is shown for."""
    group = F.coalesce(carrier, number)
    spans = df.groupBy(*by, group.alias("shown_at")).agg(F.min(number).alias("low"), F.max(number).alias("high"))
    return spans.withColumn("label", F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", "low", "high")))


def first_where(df: DataFrame, by: list[str], order: list[str], test: Column, position: str, out: str) -> DataFrame:
    """The first position at or after each row where a test holds."""
    w = _ordered(by, order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(out, F.first(F.when(test, F.col(position)), ignorenulls=True).over(w))


def falls(df: DataFrame, by: list[str], order: list[str], number: str, high: int = 5, low: int = 3) -> DataFrame:
    """Rows at which a number of ``high`` or more is followed by ``low`` or less: a hidden boundary."""
    before = F.lag(number).over(_ordered(by, order))
    return df.withColumn("_before", before).where((F.col("_before") >= high) & (F.col(number) <= low)).drop("_before")


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first rows, the repeats)."""
    ranked = df.withColumn("_rank", F.row_number().over(_ordered(keys, order)))
    return ranked.where("_rank = 1").drop("_rank"), ranked.where("_rank > 1").drop("_rank")
