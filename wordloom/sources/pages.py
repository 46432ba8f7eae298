"""Page transcripts: JSON records and tagged line batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = (
    "_page struct<vol:int, page:int, model:string>, skandha_heading string, chapter_number int, chapter_title string, colophon string, "
    "paragraphs_before_chapter_heading int, sanskrit_verse_numbers array<int>, paragraphs array<string>, footnotes array<string>, "
    "first_paragraph_continues_previous_page boolean, page_label string, layout_note string"
)
NAME = "v(\\d)_p(\\d{4})\\.json$"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page records of a folder; volume and page come from the file's name."""
    pages = spark.read.schema(PAGE_SCHEMA).json(path, multiLine=True).withColumn("name", F.col("_metadata.file_name"))
    numbers = [F.regexp_extract("name", NAME, k).cast("int") for k in (1, 2)]
    return pages.where(F.col("name").rlike(NAME)).select(numbers[0].alias("vol"), numbers[1].alias("page"), *[c for c in pages.columns if c not in ("_page", "name")])


#: The lines that a page of a batch may have, beside paragraphs.
TAGS = ("chapter", "title", "skandha", "before", "colophon", "sv", "label", "cont", "note", "fn")


def read_batches(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(path, body): batch files, one row each; as a stream, files as they arrive."""
    reader = spark.readStream if stream else spark.read
    return reader.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def _said(lines: Column, tag: str) -> Column:
    """What all lines of a tag say, in order."""
    mine = F.filter(lines, lambda x: x.startswith(f"{tag}:"))
    return F.transform(mine, lambda x: F.btrim(F.substr(x, F.lit(len(tag) + 2))))


def batch_blocks(files: DataFrame) -> DataFrame:
    """(path, block, vol, page, lines): what stands under each ``@@ vol page`` line; block 0 is what stands before the first.

    A row is made from its file alone, so this works on streams as on tables.
    """
    body = F.regexp_replace(F.coalesce("body", F.lit("")), "\\r\\n?", "\n")
    blocks = F.split(F.concat(F.lit("\n"), body), "\\n(?=@@\\s*[0-9]{1,9}\\s+[0-9]{1,9}\\s*(?:\\n|$))")
    rows = files.select("path", F.posexplode(blocks).alias("block", "text"))
    head = "^@@\\s*([0-9]+)\\s+([0-9]+)\\s*(?:\\n|$)"
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", head, ""), "\n"), lambda x: F.rtrim(x)), lambda x: F.btrim(x) != "")
    numbers = [F.nullif(F.regexp_extract("text", head, k), F.lit("")).cast("int") for k in (1, 2)]
    return rows.select("path", "block", numbers[0].alias("vol"), numbers[1].alias("page"), lines.alias("lines"))


def parse_batches(files: DataFrame) -> DataFrame:
    """One row for each page of batch files (path, body), in the form of a page record.

    Columns: path, block, vol, page, chapter_number, chapter_title,
    skandha_heading, paragraphs_before_chapter_heading, colophon,
    sanskrit_verse_numbers, paragraphs, footnotes, page_label, layout_note and
    first_paragraph_continues_previous_page.  Every paragraph and footnote
    stays, repeated ones too; of another tag that is repeated, the last line
    counts.  Two blocks with one page's numbers are two rows.
    """

    def last(tag: str) -> Column:
        return F.nullif(F.element_at(F.concat(F.array(F.lit("")), _said(F.col("lines"), tag)), -1), F.lit(""))

    def number(tag: str) -> Column:
        return F.nullif(F.regexp_extract(last(tag), "^([0-9]{1,9})$", 1), F.lit("")).cast("int")

    return batch_blocks(files).where("vol IS NOT NULL").select(
        "path",
        "block",
        "vol",
        "page",
        number("chapter").alias("chapter_number"),
        last("title").alias("chapter_title"),
        last("skandha").alias("skandha_heading"),
        F.coalesce(number("before"), F.lit(0)).alias("paragraphs_before_chapter_heading"),
        last("colophon").alias("colophon"),
        F.transform(F.regexp_extract_all(F.coalesce(last("sv"), F.lit("")), F.lit("([0-9]{1,9})"), F.lit(1)), lambda n: n.cast("int")).alias("sanskrit_verse_numbers"),
        _said(F.col("lines"), "P").alias("paragraphs"),
        _said(F.col("lines"), "fn").alias("footnotes"),
        last("label").alias("page_label"),
        last("note").alias("layout_note"),
        F.coalesce(last("cont").isin("1", "yes", "true"), F.lit(False)).alias("first_paragraph_continues_previous_page"),
    )


def rejected_lines(files: DataFrame) -> DataFrame:
    """(path, block, line): lines that no page can have: of no known tag, headers without two numbers, and all before the first header."""
    known = f"^(?:P|{'|'.join(TAGS)}):"
    return batch_blocks(files).select("path", "block", F.explode(F.filter("lines", lambda x: F.col("vol").isNull() | ~x.rlike(known))).alias("line"))


def page_problems(pages: DataFrame, marker: str, foreign: str, longest: int = 600) -> DataFrame:
    """(vol, page, problems): what to look at in parsed pages: no paragraphs, Latin letters, letters of ``foreign``, a long page without a marker."""
    body = F.array_join("paragraphs", " ")
    bare = F.regexp_replace(body, "\\[\\?+\\]", "")
    empty = F.size("paragraphs") == 0
    tests = (
        ("no paragraphs", empty),
        ("Latin letters", bare.rlike("[A-Za-z]")),
        ("foreign letters", body.rlike(foreign)),
        ("long page without a marker", ~body.rlike(marker) & ~F.col("first_paragraph_continues_previous_page") & (F.char_length(body) > longest)),
    )
    return pages.select("vol", "page", F.array_compact(F.array(*(F.when(t if name == "no paragraphs" else t & ~empty, F.lit(name)) for name, t in tests))).alias("problems")).where("size(problems) > 0")


def tolerant_json(text: Column, schema: str, required: str) -> Column:
    """A record out of a model's answer: a code fence is stripped; null without the required field."""
    bare = F.regexp_replace(F.btrim(text, F.lit(" \n")), "(?s)^```[a-z]*\\n?|\\n?```$", "")
    record = F.from_json(bare, schema)
    return F.when(record[required].isNotNull(), record)


def check_answers(replies: DataFrame, candidates: DataFrame, reply: str = "reply") -> DataFrame:
    """(id, choice, text, confidence): answers with a known id and a choice among its candidates or a text of their own."""
    schema = "array<struct<id:int, choice:string, text:string, confidence:string>>"
    rows = replies.select(F.explode(F.from_json(F.regexp_replace(reply, "(?s)^```[a-z]*\\n?|\\n?```$", ""), schema)).alias("x")).select("x.*")
    known = candidates.select("id", "options")
    return rows.join(known, "id").where(F.expr("array_contains(options, choice)") | (F.coalesce("text", F.lit("")) != "")).select("id", "choice", "text", "confidence")


def resolve_flags(flags: Column, para: Column, idx: Column, text: Column) -> Column:
    """Flags with the one at (para, idx) marked resolved and its chosen text set; punctuation behind the old text stays."""
    tail = lambda old: F.regexp_extract(old, "([.,;:!?।॥]*)$", 1)
    return F.transform(flags, lambda f: F.when((f["para"] == para) & (f["idx"] == idx), f.withField("resolved", F.lit(True)).withField("chosen", F.concat(text, tail(F.coalesce(f["chosen"], F.lit("")))))).otherwise(f))
