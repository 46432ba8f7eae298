"""Inverted index and lexical search, for many queries in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions.keys import MIN_KEY, loose_indic, loose_roman
from wordloom.functions.normalize import exact_of, is_indic, script_of
from wordloom.sources.shared import materialise


def postings(words: DataFrame, key: str = "key", doc: str = "doc_id", min_len: int = MIN_KEY) -> DataFrame:
    """(key, doc_id) once each, keys of ``min_len`` characters and more.  The long form is the index."""
    return words.where(F.char_length(key) >= min_len).select(key, doc).distinct()


def posting_lists(post: DataFrame, key: str = "key", doc: str = "doc_id") -> DataFrame:
    """(key, df, ids): the compact form, ids ascending."""
    return post.groupBy(key).agg(F.count(F.lit(1)).alias("df"), F.array_sort(F.collect_list(doc)).alias("ids"))


def document_frequency(post: DataFrame, key: str = "key") -> DataFrame:
    """(key, df)."""
    return post.groupBy(key).agg(F.count(F.lit(1)).alias("df"))


def display_forms(words: DataFrame, df: DataFrame, min_df: int = 8) -> DataFrame:
    """(key, form, uses) of the commonest form of each key and script, for keys in ``min_df`` documents and more; ``words``: (key, word, uses)."""
    used = words.groupBy("key", script_of(F.col("word")).alias("script"), exact_of(F.col("word")).alias("form")).agg(F.sum("uses").alias("uses"))
    first = F.row_number().over(Window.partitionBy("key", "script").orderBy(F.desc("uses"), "form"))
    return used.join(df.where(F.col("df") >= min_df), "key", "left_semi").withColumn("rank", first).where("rank = 1").drop("rank")


def expand(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(query, position, key): a term's own key, and the keys of every group that holds it.

    ``terms``: (query, position, key); ``groups``: (group, key).
    """
    direct = terms.join(groups, "key").select("query", "position", "group")
    members = direct.join(groups, "group").select("query", "position", "key")
    return terms.select("query", "position", "key").unionByName(members).distinct()


def group_problems(groups: DataFrame, df: DataFrame) -> DataFrame:
    """Groups with a form that doesn't occur, or with fewer than two that do: (group, absent, present)."""
    checked = groups.join(df, "key", "left").groupBy("group").agg(F.sum(F.when(F.col("df").isNull(), 1).otherwise(0)).alias("absent"), F.count("df").alias("present"))
    return checked.where("absent > 0 or present < 2")


def search(expanded: DataFrame, post: DataFrame, unit: Column | None = None) -> DataFrame:
    """(query, unit): units that hold some key of every position of a query.

    ``unit`` maps a posting to a coarser unit; by default it is the document.
    """
    wanted = expanded.groupBy("query").agg(F.countDistinct("position").alias("needed"))
    hits = expanded.join(post, "key").select("query", "position", (unit if unit is not None else F.col("doc_id")).alias("unit")).distinct()
    found = hits.groupBy("query", "unit").agg(F.count(F.lit(1)).alias("held"))
    return found.join(wanted, "query").where("held = needed").select("query", "unit")


def with_fallback(expanded: DataFrame, fine: DataFrame, groups: DataFrame) -> DataFrame:
    """(query, level, unit): the document hits ``fine`` (query, unit), or hits at the coarser level for the queries that have none.

    ``groups``: (key, group), the keys of each group of documents.
    """
    fine = fine.select("query", F.lit("document").alias("level"), F.col("unit").cast("string").alias("unit"))
    rest = expanded.join(fine.select("query").distinct(), "query", "left_anti")
    return fine.unionByName(search(rest, groups, F.col("group")).select("query", F.lit("group").alias("level"), F.col("unit").cast("string").alias("unit")))


def suggest(keys: DataFrame, df: DataFrame, limit: int = 3) -> DataFrame:
    """(key, suggestion, df, rank): indexed keys one edit from each given key with the same first letter.

    Longer ones come first (a dropped letter is the commonest slip), then the
    more frequent, then by key.
    """
    from wordloom.operators.similarity import edit1_pairs

    # Only keys with a given one's first letter and about its length are spread into forms.
    typed = keys.select("key").distinct()
    near = F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.char_length("key") + d))
    shapes = typed.select(F.substring("key", 1, 1).alias("first"), near.alias("size")).distinct()
    shaped = df.withColumn("first", F.substring("key", 1, 1)).withColumn("size", F.char_length("key"))
    maybe = shaped.join(F.broadcast(shapes), ["first", "size"], "left_semi").select("key").distinct()
    pairs = edit1_pairs(typed, maybe, "key").where("left_word != right_word and substring(left_word, 1, 1) = substring(right_word, 1, 1)")
    ranked = pairs.select(F.col("left_word").alias("key"), F.col("right_word").alias("suggestion")).join(df.select(F.col("key").alias("suggestion"), "df"), "suggestion")
    longer = F.char_length("suggestion") - F.char_length("key")
    order = Window.partitionBy("key").orderBy(F.when(longer > 0, 0).when(longer == 0, 1).otherwise(2), F.desc("df"), "suggestion")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("key", "suggestion", "df", "rank")


def covered_items(query_keys: DataFrame, item_keys: DataFrame, item: str) -> DataFrame:
    """(query, item): items whose keys include every key of a query."""
    needed = query_keys.groupBy("query").agg(F.countDistinct("key").alias("needed"))
    held = query_keys.select("query", "key").distinct().join(item_keys.select(item, "key").distinct(), "key").groupBy("query", item).agg(F.count(F.lit(1)).alias("held"))
    return held.join(needed, "query").where("held = needed").select("query", item)


def word_table(tokens: DataFrame, word: str = "word", frequent: int = 1000) -> DataFrame:
    """(word, uses, frequent, key): each different word once, written to the shared folder.

    Keys are made here and nowhere else, so no filter on them reaches the
    tokens; only words with an Indic letter pass through the Unicode step.
    ``frequent`` words make up at least one in ``frequent`` of all tokens, so
    there are at most that many.
    """
    counted = tokens.groupBy(word).agg(F.count(F.lit(1)).alias("uses"))
    counted = materialise(counted, "words")
    total = counted.agg(F.sum("uses")).first()[0] or 0
    indic = is_indic(F.col(word))
    keyed = counted.where(~indic).withColumn("key", loose_roman(F.col(word))).unionByName(counted.where(indic).withColumn("key", loose_indic(F.col(word))))
    return materialise(keyed.withColumn("frequent", F.col("uses") * frequent >= total), "word-keys")


def build(docs: DataFrame, words: Column, carry: tuple[str, ...] = ("doc_id", "source")) -> tuple[DataFrame, DataFrame]:
    """(word table, postings) of documents; ``words`` is the array of a document's words.

    Postings are (key, *carry), once each.  Each word counts once in a
    document before anything is shuffled; frequent words, of which there is a
    bounded number, meet their keys by broadcast, the rest by a shuffled join.
    """
    table = word_table(docs.select(F.explode(words).alias("word")))
    tokens = docs.select(*carry, F.explode(F.array_distinct(words)).alias("word"))
    often, seldom = (table.where(test).where(F.char_length("key") >= MIN_KEY).select("word", "key") for test in ("frequent", "not frequent"))
    every = F.broadcast(table.where("frequent").select("word", F.lit(True).alias("often")))
    marked = tokens.join(every, "word", "left")
    hits = marked.where("often").join(F.broadcast(often), "word").unionByName(marked.where("often is null").join(seldom, "word"))
    return table, materialise(hits.select("key", *carry).distinct(), "postings")
