"""As-of and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def floor_join(left: DataFrame, right: DataFrame, by: list[str], at: str, start: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row whose ``start`` is not after ``at``; null before the first.

    Both sides go through one shuffle by ``by``; no range condition is joined.
    """
    far = right.select(*by, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.struct(*values).alias("_held"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    near = left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(far.schema["_held"].dataType).alias("_held"), F.struct("*").alias("_row"))
    before = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = far.unionByName(near).withColumn("_found", F.last("_held", ignorenulls=True).over(before)).where("_side = 1")
    return found.select("_row.*", *(F.col("_found")[v].alias(v) for v in values))


def ceiling_join(left: DataFrame, right: DataFrame, by: list[str], at: str, start: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the first right row whose ``start`` is not before ``at``."""
    flip = left.withColumn("_flipped", -F.col(at))
    return floor_join(flip, right.withColumn("_flipped_start", -F.col(start)), by, "_flipped", "_flipped_start", values).drop("_flipped")


def expand_ranges(ranges: DataFrame, low: str, high: str, out: str) -> DataFrame:
    """One row for each integer of a closed range; empty ranges give none."""
    return ranges.where(F.col(low) <= F.col(high)).withColumn(out, F.explode(F.sequence(low, high)))


def range_containment(units: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """Texts of units [a, b] laid onto rows [num, num_end].

    A row gets the texts of the units that start in it, in order; a row with
    none points to the row that the unit running over it starts in.  Rows:
    (by, num, num_end); units: (by, a, b, text).  Gives (by, num, text, carrier).
    """
    numbers = expand_ranges(rows.select(*by, "num", "num_end"), "num", "num_end", "n")
    started = units.join(numbers.select(*by, "num", F.col("n").alias("a")), [*by, "a"])
    own = started.groupBy(*by, "num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "text"))), lambda u: u["text"]), " ").alias("text"))
    covered = expand_ranges(started.select(*by, F.col("num").alias("carrier"), "a", "b"), "a", "b", "n").join(numbers, [*by, "n"]).where("num != carrier").groupBy(*by, "num").agg(F.max("carrier").alias("carrier"))
    joined = rows.select(*by, "num").join(own, [*by, "num"], "left").join(covered, [*by, "num"], "left")
    return joined.select(*by, "num", "text", F.when(F.col("text").isNull(), F.col("carrier")).alias("carrier"))


def unmatched_units(units: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """Units that start in no row."""
    numbers = expand_ranges(rows.select(*by, "num", "num_end"), "num", "num_end", "a").select(*by, "a")
    return units.join(numbers, [*by, "a"], "left_anti")


def candidate_places(missing: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """(by, num, page): pages from that of the last known unit before a missing one to that of the first one after it."""
    low = floor_join(missing, known.withColumnRenamed("page", "low"), by, "num", "num", ["low"])
    both = ceiling_join(low, known.withColumnRenamed("page", "high"), by, "num", "num", ["high"])
    return expand_ranges(both, "low", "high", "page").select(*by, "num", "page")


def point_lookup(points: DataFrame, ranges: DataFrame, by: list[str], at: str, low: str, high: str, values: list[str]) -> DataFrame:
    """Each point with the values of the range [low, high] it lies in; nulls where it lies in none.  Ranges of a group don't overlap."""
    held = floor_join(points, ranges.select(*by, low, F.struct(high, *values).alias("_range")), by, at, low, ["_range"])
    inside = F.col(at) <= F.col("_range")[high]
    return held.select(*points.columns, *(F.when(inside, F.col("_range")[v]).alias(v) for v in values))
