"""Assembly of page streams into numbered units and chapters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions.normalize import digits_to

MARKER = "॥\\s*([0-9०-९০-৯୦-୯]+(?:\\s*[-,]\\s*[0-9०-९০-৯୦-୯]+)*)\\s*॥"


def pieces(pages: DataFrame, by: list[str], order: str, paragraphs: str = "paragraphs") -> DataFrame:
    """(by, order, para, piece, text, a, b): paragraphs cut behind each marker; a and b are null where no marker closes a piece."""
    cut = F.split(F.regexp_replace(F.col("para_text"), f"({MARKER})", "$1\u0001"), "\u0001")
    rows = pages.select(*by, order, F.posexplode(paragraphs).alias("para", "para_text")).select(*by, order, "para", F.posexplode(cut).alias("piece", "raw"))
    numbers = F.transform(F.regexp_extract_all(digits_to(F.regexp_extract("raw", MARKER, 1)), F.lit("([0-9]+)"), F.lit(1)), lambda n: n.cast("int"))
    text = F.btrim(F.regexp_replace("raw", MARKER, ""))
    rows = rows.select(*by, order, "para", "piece", text.alias("text"), F.try_element_at(numbers, F.lit(1)).alias("a"), F.try_element_at(numbers, F.lit(-1)).alias("b"))
    return rows.where("text != '' or a is not null")


def assemble_units(pages: DataFrame, by: list[str], order: str, paragraphs: str = "paragraphs") -> DataFrame:
    """(by, unit, a, b, text, pages, closed, flags): text from one marker to the next, glued over paragraphs and pages.

    A unit's number is the count of markers before it, so no state is kept; a
    tail that no marker closes is a unit with ``closed`` false.  ``flags`` are
    those of ``unit_flags``, ``continued`` for a unit of more than one page,
    and, where pages have an array column ``flags``, the flags of its pages.
    """
    rows = pieces(pages, by, order, paragraphs)
    before = Window.partitionBy(*by).orderBy(order, "para", "piece").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("unit", F.coalesce(F.sum(F.col("a").isNotNull().cast("long")).over(before), F.lit(0)))
    held = F.array_sort(F.collect_list(F.struct(order, "para", "piece", "text")))
    units = rows.groupBy(*by, "unit").agg(
        F.max("a").alias("a"),
        F.max("b").alias("b"),
        F.array_join(F.filter(F.transform(held, lambda p: p["text"]), lambda t: t != ""), " ").alias("text"),
        F.array_sort(F.collect_set(order)).alias("pages"),
        F.max(F.col("a").isNotNull()).alias("closed"),
    )
    own = F.concat(unit_flags(F.col("text"), F.col("closed")), F.when(F.size("pages") > 1, F.array(F.lit("continued"))).otherwise(F.array().cast("array<string>")))
    if "flags" not in pages.columns:
        return units.withColumn("flags", own)
    theirs = units.select(*by, "unit", F.explode("pages").alias(order)).join(pages.select(*by, order, "flags"), [*by, order])
    theirs = theirs.groupBy(*by, "unit").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("flags", F.array().cast("array<string>")))))).alias("_pages_flags"))
    return units.join(theirs, [*by, "unit"]).withColumn("flags", F.array_distinct(F.concat(own, "_pages_flags"))).drop("_pages_flags")


def chapter_breaks(units: DataFrame, by: list[str], order: str, after_mismatches: int = 2) -> DataFrame:
    """Adds ``chapter``: a new one where a heading says so, numbers start again at 1, a colophon stands before, or the running head differs twice in a row.

    units: (by, order, a, heading int, colophon boolean, running_head int);
    any of the last three may be null.  A boolean column ``strict``, where
    there is one, marks rows in whose range chapters begin at headings only.
    Each decision depends on the chapter so far, so a volume (some thousand
    units) is walked in order by one task.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ignore_index=True)
        chapter, last, closed, off, out = 1, 0, False, 0, []
        strict = rows["strict"].fillna(False).astype(bool) if "strict" in rows else [False] * len(rows)
        for a, heading, colophon, head, bound in zip(rows["a"], rows["heading"], rows["colophon"], rows["running_head"], strict, strict=True):
            off = off + 1 if pd.notna(head) and head != chapter else 0
            if pd.notna(heading) and heading != chapter:
                chapter, last, off = int(heading), 0, 0
            elif bound:
                pass
            elif closed or (pd.notna(a) and a == 1 and last > 1):
                chapter, last, off = chapter + 1, 0, 0
            elif off >= after_mismatches:
                chapter, last, off = int(head), 0, 0
            out.append(chapter)
            last = int(a) if pd.notna(a) else last
            closed = bool(colophon) if pd.notna(colophon) else False
        rows["chapter"] = out
        return rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema) + ", chapter int"
    return units.groupBy(*by).applyInPandas(walk, schema)


def apply_forced_starts(pages: DataFrame, starts: DataFrame, skips: DataFrame, by: list[str], order: str) -> DataFrame:
    """Pages outside the skip ranges (by, first, last), with the section and chapter of the last forced start (by, page, section, chapter)."""
    from wordloom.operators.intervals import floor_join

    ranges = skips.withColumn(order, F.explode(F.sequence("first", "last"))).select(*by, order)
    return floor_join(pages.join(ranges, [*by, order], "left_anti"), starts, by, order, "page", ["section", "chapter"])


def mark_strict(units: DataFrame, ranges: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``strict``: whether a row lies in one of the ranges (by, first, last) whose chapter starts are all known."""
    from wordloom.operators.intervals import point_lookup

    held = point_lookup(units, ranges.withColumn("_in", F.lit(True)), by, order, "first", "last", ["_in"])
    return held.withColumn("strict", F.coalesce("_in", F.lit(False))).drop("_in")


def unit_flags(text: Column, closed: Column, short: int = 12) -> Column:
    """Codes: uncertain marks, stray symbols, no end marker, short."""
    codes = (("uncertain", text.contains("[?]")), ("stray_symbols", text.rlike("[<>{}#@~^\\\\]")), ("no_end_marker", ~closed), ("short", F.char_length(text) < short))
    return F.array_compact(F.array(*(F.when(test, F.lit(code)) for code, test in codes)))


def fold_entry_lines(lines: DataFrame, by: list[str], order: str, text: str = "text") -> DataFrame:
    """(by, entry, number, title): contents lines that start with a number begin an entry, others continue it; heads and blank lines go.

    A number of any length begins an entry; one beyond an int is null.
    """
    head = F.col(text).rlike("(?i)^\\s*(contents|chapter|page)\\s*$") | (F.btrim(text) == "")
    digits = F.nullif(F.regexp_extract(digits_to(F.col(text)), "^\\s*(\\d+)[.)\\s]", 1), F.lit(""))
    rows = lines.where(~head).withColumn("digits", digits).withColumn("number", F.col("digits").try_cast("int"))
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("entry", F.sum(F.col("digits").isNotNull().cast("long")).over(upto)).where("entry > 0")
    bare = F.btrim(F.regexp_replace(text, "^\\s*[\\d०-९୦-୯]+[.)\\s]+|[\\s.…]+[\\d०-९୦-୯]*\\s*$", ""))
    return rows.groupBy(*by, "entry").agg(F.max("number").alias("number"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, bare.alias("t")))), lambda p: p["t"]), " ").alias("title"))


def resync_entries(entries: DataFrame, by: list[str], order: str, reach: int = 3) -> DataFrame:
    """Adds ``chapter``: printed numbers followed by a counter; a number a little ahead moves it, others are taken as the next."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ignore_index=True)
        at, out = 0, []
        for n in rows["number"]:
            at = int(n) if pd.notna(n) and at < n <= at + reach else at + 1
            out.append(at)
        rows["chapter"] = out
        return rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema) + ", chapter int"
    return entries.groupBy(*by).applyInPandas(walk, schema)


def segments_not_in(texts: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, segment, text): lines not among the known ones, glued up to each marker.  texts: (key, line, text); known: (key, text)."""
    fresh = texts.join(known.select(key, "text").distinct(), [key, "text"], "left_anti")
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = fresh.withColumn("segment", F.coalesce(F.sum(F.col("text").rlike(MARKER).cast("long")).over(before), F.lit(0)))
    return rows.groupBy(key, "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda p: p["text"]), " ").alias("text"))
