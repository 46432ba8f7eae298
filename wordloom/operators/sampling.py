"""Samples that come out the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def uniform_sample(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows with the least hash of key and seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def cluster_sample(df: DataFrame, cluster: str, keys: list[str], clusters: int, each: int, seed: int = 0) -> DataFrame:
    """``each`` rows of ``clusters`` sampled clusters."""
    chosen = uniform_sample(df.select(cluster).distinct(), [cluster], clusters, seed)
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.xxhash64(F.lit(seed), *keys), *keys))
    return df.join(chosen, cluster, "left_semi").withColumn("_rank", rank).where(F.col("_rank") <= each).drop("_rank")


def block_fold(place: Column, folds: int, block: int = 25) -> Column:
    """Cross-fit fold in blocks of neighbouring pages."""
    return F.pmod(F.floor(place / block), F.lit(folds)).cast("int")


def pick_of_day(df: DataFrame, order: list[str], day: Column) -> DataFrame:
    """The row whose turn it is: day number (a constant) modulo the number of rows."""
    n = df.count()
    if not n:
        return df.limit(0)
    at = df.sparkSession.range(1).select(F.pmod(day, F.lit(n)).cast("int")).first()[0]
    return df.orderBy(*order).offset(at).limit(1)
