"""Chapters as markdown: readers for four dialects and a writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.sources.shared import materialise
from wordloom.sources.store import files_of


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, body): one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\\r\\n", "\n").alias("body"))


def front_matter(body: Column) -> Column:
    """Map of the ``key: value`` lines between the two ``---`` lines; empty without them."""
    block = F.regexp_extract(body, "(?s)^---\\n(.*?)\\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    names = F.transform(lines, lambda x: F.btrim(F.regexp_extract(x, "^([^:]*):", 1)))
    values = F.transform(lines, lambda x: F.btrim(F.regexp_replace(x, "^[^:]*:\\s*", ""), F.lit("\" ")))
    once = F.array_distinct(names)
    return F.map_from_arrays(once, F.transform(once, lambda k: F.element_at(values, F.array_position(names, k).cast("int"))))


def headed_blocks(files: DataFrame, heading: str) -> DataFrame:
    """(path, meta, head, place, title, text): what follows each line that begins with ``heading`` and a blank."""
    text = F.regexp_replace("body", "(?s)^---\\n.*?\\n---\\n?", "")
    parts = F.split(F.concat(F.lit("\n"), text), f"\\n{heading} ")
    rows = files.select("path", front_matter(F.col("body")).alias("meta"), F.btrim(F.element_at(parts, 1), F.lit(" \n")).alias("head"), F.posexplode(F.slice(parts, 2, 1_000_000)).alias("place", "block"))
    title = F.btrim(F.regexp_extract("block", "^([^\\n]*)", 1))
    return rows.select("path", "meta", "head", "place", title.alias("title"), F.btrim(F.regexp_replace("block", "^[^\\n]*\\n?", ""), F.lit(" \n")).alias("text"))


def split_source_and_translation(blocks: DataFrame, divider: str) -> DataFrame:
    """Adds speaker (a first line ending in a colon), source and translation (before and behind the divider)."""
    speaker = F.nullif(F.regexp_extract("text", "^\\*{0,2}([^\\n:]{1,60}):\\*{0,2}\\n", 1), F.lit(""))
    rest = F.regexp_replace("text", "^\\*{0,2}[^\\n:]{1,60}:\\*{0,2}\\n", "")
    parts = F.split(rest, divider, 2)
    return blocks.withColumn("speaker", speaker).withColumn("source", F.when(F.size(parts) > 1, F.btrim(parts[0], F.lit(" \n")))).withColumn("translation", F.btrim(F.element_at(parts, -1), F.lit(" \n")))


def read_units(files: DataFrame) -> DataFrame:
    """Chapters of either dialect: ``### unit`` headings, or ``#### block`` ones where the file has no others."""
    units = F.col("body").rlike("(?m)^### ")
    return headed_blocks(files.where(units), "###").withColumn("dialect", F.lit("unit")).unionByName(headed_blocks(files.where(~units), "####").withColumn("dialect", F.lit("block")))


def chapter_documents(units: DataFrame, by: list[str], order: str, meta: dict[str, str]) -> DataFrame:
    """(by, body): each chapter's units as one markdown text with front matter."""
    head = "---\n" + "".join(f"{k}: {v}\n" for k, v in meta.items()) + "---\n\n"
    blocks = F.transform(F.array_sort(F.collect_list(F.struct(order, "title", "text"))), lambda u: F.concat(F.lit("### "), u["title"], F.lit("\n\n"), u["text"]))
    return units.groupBy(*by).agg(F.concat(F.lit(head), F.array_join(blocks, "\n\n"), F.lit("\n")).alias("body"))


def reviewed_chapters(spark: SparkSession, path: str, by: list[str], schema: str) -> DataFrame:
    """(by) of the chapters below a folder whose front matter says that they were reviewed; ``schema`` gives the types of ``by``."""
    if not files_of(spark, path):
        return spark.createDataFrame([], schema)
    files = spark.read.schema("value string, " + schema).text(path, wholetext=True)
    return files.where(F.try_element_at(front_matter(F.regexp_replace("value", "\\r\\n", "\n")), F.lit("verification_status")) == "reviewed").select(*by)


def write_chapters(chapters: DataFrame, by: list[str], path: str, reviewed: DataFrame | None = None) -> None:
    """Writes chapters (by, body), a folder for each; those that somebody has reviewed are never touched.

    Reviewed are the chapters of ``reviewed`` (by) and those whose file in
    ``path`` says so in its front matter.  Only the folders of chapters that
    are written are replaced; all others stay as they are, byte for byte.
    """
    spark = chapters.sparkSession
    schema = ", ".join(f"`{c}` {chapters.schema[c].dataType.simpleString()}" for c in by)
    kept = reviewed_chapters(spark, path, by, schema)
    if reviewed is not None:
        kept = kept.unionByName(reviewed.select(*by))
    fresh = chapters.join(kept.distinct(), by, "left_anti")
    # What says which chapters are reviewed lies in the folder that is written to: it is settled first.
    fresh = materialise(fresh.select(*by, F.regexp_replace("body", "\\n$", "").alias("value")), "chapters")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).text(path)
