"""Documents with every odd case: nulls, empty and long texts, ties, repeats, near copies, clashing column names."""

from __future__ import annotations

import random

import pytest

#: Column names that the operators use inside.
CLASHES = ("key", "digest", "row", "bucket", "range", "slot", "class", "unit", "n", "train", "size", "spans", "shard", "rank", "doc", "n_chars", "score", "component_id", "kept")


def odd_rows() -> list[tuple]:
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "delta", "eins", "zwei", "étoile", "niño", "straße", "the", "and", "of", "12", "x,y", "e.g."]

    def text(n: int) -> str:
        return " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))

    base, passage = text(120), text(60)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en"), (2, base, "en"), (3, " ".join(near), "en"), (4, base.upper(), "de"), (5, None, "en"), (6, "", None), (7, " \n\t", "fr"), (8, "hi", "en"),
        (9, "hi", None), (10, "one two three four", "en"), (11, passage + "\n\n" + text(40), "es"), (12, text(40) + "\n" + passage, "es"), (13, passage + passage, "de"),
        (14, "ab" * 400, "en"), (15, text(20_000), "en"), (16, "🙂🙃 日本語\u00a0x\u2028y", "fr"), (17, "<|endoftext|> and <|startoftext|> 's don't", "en"), (18, "12 34", "en"),
        (19, "\x1ca\x1fb \x85 c", "en"), (20, "a" * 5000, "en"), (21, "line\nline\nother", "en"), (22, "other\nline\nline", "en"), (None, base, "en"), (None, None, None), (8, "hi", "en"), (8, "other text of eight", "en"),
    ]
    return [(i, t, lang, f"src{k % 3}", *(f"{c}{k}" for c in CLASHES)) for k, (i, t, lang) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
