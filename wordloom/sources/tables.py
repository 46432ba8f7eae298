"""Plain tables: scans with missing columns, TSV glosses, backups and deterministic writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def with_columns_present(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The wanted columns; those that an older table lacks are null."""
    return df.select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in schema.items()))


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows with one of the ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def contains_any(columns: list[str], needle: Column) -> Column:
    """Whether one of the columns contains the text, letter case aside."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lower(needle)), F.lit(False)) for c in columns])


def read_glosses(spark: SparkSession, path: str) -> DataFrame:
    """(word, pos, gloss) of tab-separated files; misread words (gloss "?") and empty ones go."""
    rows = spark.read.csv(path, sep="\t", schema="word string, pos string, gloss string", quote="")
    return rows.where("gloss is not null and btrim(gloss) not in ('', '?')")


def write_sorted(df: DataFrame, keys: list[str], path: str) -> None:
    """Rewrites a table sorted by key, so that the same rows give the same files' contents."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, digest): equal for equal multisets of rows, in any order or partitioning."""
    row = F.xxhash64(*(F.col(c) for c in sorted(df.columns)))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)") % F.lit(10**18)), F.lit(0)).cast("string").alias("digest"))


def to_backup(df: DataFrame, table: str) -> DataFrame:
    """(table, columns, row): rows as JSON with nulls kept."""
    return df.select(F.lit(table).alias("table"), F.lit(",".join(df.columns)).alias("columns"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


def from_backup(backup: DataFrame, table: str, schema: dict[str, str]) -> DataFrame:
    """Rows of a table; raises before anything is read into place if the backup has columns that the table lacks."""
    mine = backup.where(F.col("table") == table)
    strange = mine.select(F.explode(F.split("columns", ",")).alias("c")).distinct().where(~F.col("c").isin(*schema)).limit(1).collect()
    if strange:
        raise ValueError(f"{table} has no column {strange[0]['c']!r}")
    typed = ", ".join(f"`{c}` {t}" for c, t in schema.items())
    return mine.select(F.from_json("row", typed).alias("r")).select("r.*")


def newest_version(files: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """(name, version, path) of each asset's highest dotted version."""
    from wordloom.functions.parse import version_key

    return files.groupBy(name).agg(F.max_by(F.struct(version, "path"), version_key(F.col(version))).alias("best")).select(name, "best.*")


def require_version(meta: DataFrame, wanted: str) -> None:
    """Refuses an index of another version."""
    found = meta.where("key = 'version'").select("value").limit(1).collect()
    if not found or found[0]["value"] != wanted:
        raise ValueError(f"index version {found[0]['value'] if found else None}, wanted {wanted}")


def stats_row(df: DataFrame, key: str) -> DataFrame:
    """(key, value): a one-row table of figures as JSON, for a key and value table."""
    return df.limit(1).select(F.lit(key).alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def releases(payload: Column, suffix: str) -> Column:
    """Array of (version, url) of a release service's answer: files with the suffix, drafts and trials left out."""
    schema = "array<struct<tag_name:string, draft:boolean, prerelease:boolean, assets:array<struct<name:string, browser_download_url:string>>>>"
    final = F.filter(F.from_json(payload, schema), lambda r: ~F.coalesce(r["draft"], F.lit(False)) & ~F.coalesce(r["prerelease"], F.lit(False)))
    files = F.transform(final, lambda r: F.transform(F.filter(r["assets"], lambda a: a["name"].endswith(suffix)), lambda a: F.struct(r["tag_name"].alias("version"), a["browser_download_url"].alias("url"))))
    return F.flatten(files)


def split_list(text: Column, mark: str = "\\|") -> Column:
    """Array of a joined list, empty parts dropped."""
    return F.filter(F.transform(F.split(text, mark), lambda p: F.btrim(p)), lambda p: p != "")


def write_report(df: DataFrame, path: str, order: list[str]) -> None:
    """A review queue as CSV files whose names follow the order; a small one is a single file."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True)
