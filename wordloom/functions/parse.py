"""Small parsers and number forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.normalize import digits_to

#: The blanks at which a snippet is cut.
BLANKS = "\\t\\n\\f\\r "


def reference(query: Column) -> Column:
    """(section, chapter, verse) of "3.12" or "3.12.7" with sections 0 to 12; null for anything else."""
    pattern = "^(\\d{1,9})[.:/\\-\\s]+(\\d{1,9})(?:[.:/\\-\\s]+(\\d{1,9}))?$"
    part = [F.try_to_number(F.nullif(F.regexp_extract(F.btrim(query), pattern, k), F.lit("")), F.lit("999999999")).cast("int") for k in (1, 2, 3)]
    parsed = F.struct(part[0].alias("section"), part[1].alias("chapter"), part[2].alias("verse"))
    return F.when(F.btrim(query).rlike(pattern) & part[0].between(0, 12), parsed)


def marker_range(text: Column) -> Column:
    """(a, b) of a verse marker such as ``॥ 3-5 ॥`` in digits of any script; b is a where only one is given."""
    numbers = F.transform(F.regexp_extract_all(digits_to(text), F.lit("([0-9]+)"), F.lit(1)), lambda n: n.cast("int"))
    return F.when(F.size(numbers) > 0, F.struct(F.element_at(numbers, 1).alias("a"), F.element_at(numbers, -1).alias("b")))


def version_key(version: Column, parts: int = 4) -> Column:
    """Numbers of a dotted version, missing ones 0, for comparing."""
    numbers = F.transform(F.split(F.regexp_replace(version, "^[^0-9]*", ""), "\\."), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, "^([0-9]+)", 1), F.lit("")), F.lit("0")).cast("int"))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0), parts)), 1, parts)


def snippet(text: Column, at: Column, size: Column, around: int = 36) -> Column:
    """A hit with up to ``around`` characters on both sides, cut at blanks; ``at`` is 1-based.

    The end is the text's: a piece that ends in a line break is cut there and not at the blank before it.
    """
    low = F.greatest(at - around, F.lit(1))
    high = F.least(at + size + around, F.char_length(text) + 1)
    piece = F.substr(text, low, high - low)
    piece = F.when(low > 1, F.regexp_replace(piece, f"^[^{BLANKS}]*[{BLANKS}]", "")).otherwise(piece)
    piece = F.when(high <= F.char_length(text), F.regexp_replace(piece, f"[{BLANKS}][^{BLANKS}]*\\z", "")).otherwise(piece)
    return F.concat(F.when(low > 1, F.lit("…")).otherwise(F.lit("")), piece, F.when(high <= F.char_length(text), F.lit("…")).otherwise(F.lit("")))


def nearest_occurrence(text: Column, quote: Column, near: Column) -> Column:
    """1-based start of the occurrence of ``quote`` nearest to ``near``; null if there is none."""
    literal = F.concat(F.lit("(?=\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    # Each piece but the first begins with the quote; their lengths give the places in one pass.
    best = F.aggregate(
        F.split(text, literal),
        F.struct(F.lit(1).alias("here"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("double").alias("d")),
        lambda held, piece: F.struct(
            (held["here"] + F.char_length(piece)).alias("here"),
            F.when(_closer(held, piece, quote, near), held["here"]).otherwise(held["at"]).alias("at"),
            F.when(_closer(held, piece, quote, near), F.abs(held["here"] - near).cast("double")).otherwise(held["d"]).alias("d"),
        ),
    )
    return best["at"]


def _closer(held: Column, piece: Column, quote: Column, near: Column) -> Column:
    """Whether a piece starts with the quote, nearer than what is held."""
    return F.startswith(piece, quote) & (held["d"].isNull() | (F.abs(held["here"] - near) < held["d"]))


def span_at(text: Column, at: Column, pattern: str) -> Column:
    """(start, end) of the match of a pattern that covers a 0-based place, without blanks at its ends; null if none does.

    ``\\S+`` gives the word at a place, ``[^.!?।॥]+[.!?।॥]*`` the sentence.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"((?:{pattern})|[\\s\\S])"), F.lit(1))
    spans = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("end"), F.lit(-1).alias("low"), F.lit("").alias("piece")),
        lambda held, piece: F.struct(
            (held["end"] + F.char_length(piece)).alias("end"),
            F.when((held["end"] <= at) & (at < held["end"] + F.char_length(piece)), held["end"]).otherwise(held["low"]).alias("low"),
            F.when((held["end"] <= at) & (at < held["end"] + F.char_length(piece)), piece).otherwise(held["piece"]).alias("piece"),
        ),
    )
    lead = F.char_length(spans["piece"]) - F.char_length(F.regexp_replace(spans["piece"], "^\\s+", ""))
    size = F.char_length(F.regexp_replace(F.regexp_replace(spans["piece"], "^\\s+", ""), "\\s+$", ""))
    covered = (spans["low"] >= 0) & spans["piece"].rlike(f"^(?:{pattern})$") & (size > 0)
    return F.when(covered, F.struct((spans["low"] + lead).alias("start"), (spans["low"] + lead + size).alias("end")))


def encode_ids(ids: list[int]) -> bytes:
    """Sorted distinct ids as differences of seven bits a byte, the top bit set on all but a number's last."""
    out, before = bytearray(), 0
    for i in sorted(set(ids)):
        gap, before = i - before, i
        while gap > 127:
            out.append(gap & 127 | 128)
            gap >>= 7
        out.append(gap)
    return bytes(out)


def decode_ids(blob: bytes) -> list[int]:
    """The ids of ``encode_ids``."""
    ids, total, gap, shift = [], 0, 0, 0
    for byte in blob:
        gap |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            total += gap
            ids.append(total)
            gap = shift = 0
    return ids


@F.pandas_udf(T.BinaryType())
def encode_posting(ids: pd.Series) -> pd.Series:
    """Posting list to bytes, for exchange with readers of that format."""
    return ids.map(lambda x: encode_ids([int(i) for i in x]), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.LongType()))
def decode_posting(blobs: pd.Series) -> pd.Series:
    """Bytes to posting list."""
    return blobs.map(lambda b: decode_ids(bytes(b)), na_action="ignore")


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """(low, high) of the Wilson interval; (0, 1) without observations."""
    p, zz = hits / n, z * z
    middle, divisor = p + zz / (2 * n), 1 + zz / n
    reach = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), (middle - reach) / divisor), F.least(F.lit(1.0), (middle + reach) / divisor)
    return F.struct(F.when(n == 0, 0.0).otherwise(low).alias("low"), F.when(n == 0, 1.0).otherwise(high).alias("high"))


def strip_markup(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, the five named entities back, blanks squeezed."""
    text = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    text = F.regexp_replace(text, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))
