"""URL filter: host rules, then logistic regression on hashed character n-grams of host and path.

Only DataFrame functions and Spark's own ``ml`` estimators are used; nothing
runs in Python on the executors.  The training table is small and fixed (see
``labelled_urls``), so fitting takes a bounded time at every input size.
"""

from __future__ import annotations

import random

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Consonants (alone and joined) and vowels of the made-up names of the labelled table; what stands before a host; words that are for sale.
LETTERS = ((*"bcdfghjklmnpqrstvwxyz", "ch", "sh", "th", "st", "tr", "bl", "gr", "nd", "th", "rn"), "aeiouy")
BEFORE = ("www", "m", "blog", "docs", "news", "shop", "mail", "en", "forum", "static")
FOR_SALE = ("casino", "pills", "lottery", "payday", "jackpot", "clickbait", "warez", "poker", "replica", "cracked", "bonus", "discount", "hookup", "crypto", "bets", "deal")
TLDS = ("test", "invalid", "localhost")


def labelled_urls(rows: int = 2400, seed: int = 1, letters: tuple = LETTERS, for_sale: tuple[str, ...] = FOR_SALE) -> list[tuple[str, int]]:
    """(url, 1 for one to block): a small labelled table, built by rule.

    All names are made up of ``letters``.  Two fifths of the URLs are to block:
    they show two or three of six traits (a chain of hyphens in the host,
    digits among its letters, a long name without vowels, many subdomains, a long
    id in the path, a path of keywords with numbers), or, in three of ten, a
    word for sale and one of the traits.  Others have short names, at most one
    hyphen or two subdomains, and paths of words, dates and small numbers.
    """
    rng = random.Random(seed)

    def name(least: int = 2, most: int = 3) -> str:
        return "".join(rng.choice(letters[0]) + rng.choice(letters[1]) + rng.choice(("", "", rng.choice(letters[0]))) for _ in range(rng.randint(least, most)))

    def plain_path() -> str:
        kinds = ("", name(), f"{name()}/{name()}", f"{name()}-{name()}.html", f"{rng.randint(2001, 2026)}/{rng.randint(1, 12)}/{name()}", f"{name()}/{rng.randint(1, 999)}", f"{name(1, 1)}/{rng.randint(1, 999)}", f"{rng.randint(1, 999)}.html")
        return rng.choice(kinds)

    def bad() -> str:
        traits = set(rng.sample(range(6), rng.randint(2, 3)))
        sold = rng.random() < 0.3
        word = rng.choice(for_sale) if sold else name()
        host, path = name(), plain_path()
        if sold:
            traits = {rng.choice(sorted(traits))}
            host, path = (rng.choice((f"{word}{name(1, 2)}", f"{name(1, 2)}{word}", f"{name(1, 2)}-{word}")), path) if rng.random() < 0.6 else (host, rng.choice((f"{word}/{name()}", f"{name()}-{word}.html", f"{word}-{rng.randint(1, 99)}")))
        if 0 in traits:
            host = "-".join([host, name(), name()][: rng.randint(2, 3)]) + rng.choice(("", f"-{rng.randint(1, 999)}"))
        if 1 in traits:
            cut = rng.randint(1, len(host))
            host = f"{host[:cut]}{rng.randint(2, 9999)}{host[cut:]}{rng.choice(('', str(rng.randint(1, 99))))}"
        if 2 in traits:
            host = "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(7, 13))) + rng.choice(("", f".{host}"))
        if 3 in traits:
            host = ".".join([*(name(1, 1) + rng.choice(("", str(rng.randint(1, 99)))) for _ in range(rng.randint(3, 5))), host])
        if 4 in traits:
            path = f"{name(1, 1)}/" + rng.choice((f"{rng.randrange(10**8, 10**12)}", f"{rng.randrange(16**9, 16**12):x}"))
        if 5 in traits:
            path = "-".join([word, name(), str(rng.randint(1, 99)), name()][: rng.randint(3, 4)]) + rng.choice(("", f"-{rng.randint(10, 999)}.php"))
        return f"http://{host}.{rng.choice(TLDS)}/{path}"

    def good() -> str:
        before = rng.choice(BEFORE)
        host = rng.choice((name(), name(), f"{before}.{name()}", f"{before}.{name()}.{name()}", f"{name(1, 2)}.{name()}", f"{name()}.{name()}", f"{name(1, 2)}-{name(1, 2)}"))
        return f"{rng.choice(('http', 'https'))}://{host}.{rng.choice(TLDS)}/{plain_path()}"

    return [(bad(), 1) if k % 5 < 2 else (good(), 0) for k in range(rows)]


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    ladder, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        ladder, verdict = F.when(fits, F.lit(rule)).otherwise(ladder), F.when(fits, F.lit(says)).otherwise(verdict)
    return ladder, verdict


def with_features(df: DataFrame, features: int) -> DataFrame:
    """Adds ``features``: hashed counts of the 1- to 4-grams of host and of path."""

    def grams(text: Column, n: int, mark: str) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.when(F.char_length(marked) >= n, F.sequence(F.lit(1), F.char_length(marked) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(marked, i, F.lit(n))))

    terms = F.concat(*(grams(F.col(c), n, c[0]) for c in ("host", "path") for n in (1, 2, 3, 4)))
    return HashingTF(numFeatures=features, inputCol="grams", outputCol="features").transform(df.withColumn("grams", terms))


def fit(spark: SparkSession, labelled: list[tuple[str, int]] | None = None, features: int = 1 << 14) -> LogisticRegressionModel:
    """Fits the regression to a small labelled table, ``labelled_urls()`` unless another is given."""
    url = F.col("url")
    table = spark.createDataFrame(labelled or labelled_urls(), "url string, label int").select(host_of(url).alias("host"), path_of(url).alias("path"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(maxIter=30, regParam=0.003, aggregationDepth=2).fit(with_features(table.coalesce(1), features))


def judge_urls(pages: DataFrame, model: LogisticRegressionModel, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score.

    A rule decides where one fits; elsewhere ``score``, the regression's
    probability that the URL is one to block, does.  A null URL or one without
    ``://`` has an empty host and path, fits no rule and is judged by the
    regression like any other.  Other columns are ignored, repeated rows stay,
    an empty table gives no rows.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    scored = model.transform(with_features(rows, model.numFeatures)).withColumn("score", vector_to_array("probability")[1])
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    by_score = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, by_score).alias("verdict"), F.round("score", 6).alias("score"))
