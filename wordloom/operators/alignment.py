"""Statistical and monotone alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions.keys import loose_key
from wordloom.operators.similarity import common_prefix_likeness
from wordloom.sources.shared import materialise

NULL = ""


def word_likeness(pairs: DataFrame) -> DataFrame:
    """(s, t, likeness) of distinct word pairs by the common start of their loose keys."""
    words = pairs.select(F.col("s").alias("w")).union(pairs.select("t")).distinct()
    keyed = materialise(words.withColumn("k", loose_key(F.col("w"))), "align")
    a, b = keyed.withColumnsRenamed({"w": "s", "k": "ks"}), keyed.withColumnsRenamed({"w": "t", "k": "kt"})
    return pairs.join(a, "s").join(b, "t").withColumn("likeness", common_prefix_likeness(F.col("ks"), F.col("kt"))).select("s", "t", "likeness")


def ibm_model1(parallel: DataFrame, rounds: int = 6, null_prior: float = 0.3, spelling_weight: float = 8.0) -> DataFrame:
    """(s, t, times): how often each source word is aligned to each target word.

    ``parallel``: (pair, source array<string>, target array<string>).  Each
    source token is explained by one of its pair's distinct target words or by
    nothing; posteriors are weighted by spelling likeness.  Every round is two
    aggregations over the table of word pairs; rounds are cut by a table.
    Posteriors are rounded before the best is taken, ties go to the smaller word.
    """
    source = parallel.select("pair", F.posexplode("source").alias("place", "s"))
    target = parallel.select("pair", F.explode(F.array_union(F.array_distinct("target"), F.array(F.lit(NULL)))).alias("t"))
    links = materialise(source.join(target, "pair").groupBy("pair", "place", "s", "t").agg(F.count(F.lit(1)).alias("n")).drop("n"), "align")
    likeness = word_likeness(links.where(F.col("t") != NULL).select("s", "t").distinct())
    prior = F.when(F.col("t") == NULL, null_prior).otherwise(1 + spelling_weight * F.coalesce("likeness", F.lit(0.0)))
    table = materialise(links.select("s", "t").distinct().join(likeness, ["s", "t"], "left").select("s", "t", prior.alias("prior"), F.lit(1.0).alias("p")), "align")
    token = Window.partitionBy("pair", "place")
    for _ in range(rounds):
        weighed = links.join(table, ["s", "t"]).withColumn("q", F.col("p") * F.col("prior"))
        counts = weighed.withColumn("post", F.col("q") / F.sum("q").over(token)).groupBy("s", "t", "prior").agg(F.sum("post").alias("c"))
        table = materialise(counts.withColumn("p", F.col("c") / F.greatest(F.sum("c").over(Window.partitionBy("t")), F.lit(1e-12))).select("s", "t", "prior", F.round("p", 12).alias("p")), "align")
    scored = links.join(table, ["s", "t"]).withColumn("score", F.round(F.col("p") * F.col("prior"), 9))
    best = scored.groupBy("pair", "place", "s").agg(F.min_by("t", F.struct(-F.col("score"), "t")).alias("t"))
    return best.where(F.col("t") != NULL).groupBy("s", "t").agg(F.count(F.lit(1)).alias("times"))


def pick_translations(aligned: DataFrame, keep: int = 3) -> DataFrame:
    """(s, t, rank) worth showing of ``ibm_model1``'s result.

    A target spelled like the word, or a steady one (seen twice or more, 40 %
    of three uses or more).  A word without one but with five uses takes the
    forms that share the commonest three-letter key, if that has 35 %.
    """
    total = F.sum("times").over(Window.partitionBy("s"))
    order = Window.partitionBy("s").orderBy(F.desc("times"), "t")
    rows = aligned.withColumn("total", total).withColumn("place", F.row_number().over(order))
    rows = rows.join(word_likeness(aligned.select("s", "t").distinct()), ["s", "t"]).withColumn("head", F.substr(loose_key(F.col("t")), F.lit(1), F.lit(3)))
    steady = (F.col("total") >= 3) & (F.col("times") >= 2) & (F.col("times") * 10 >= F.col("total") * 4)
    rows = rows.withColumn("good", ((F.col("likeness") >= 0.6) | steady) & (F.col("place") <= keep + 2))
    rows = rows.withColumn("any_good", F.max("good").over(Window.partitionBy("s"))).withColumn("head_times", F.sum("times").over(Window.partitionBy("s", "head")))
    first_head = F.first("head").over(Window.partitionBy("s").orderBy(F.desc("head_times"), "head").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    grouped = ~F.col("any_good") & (F.col("total") >= 5) & (F.col("head") == first_head) & (F.col("head_times") * 100 >= F.col("total") * 35)
    chosen = rows.withColumn("grouped", grouped).where("good or grouped")
    return chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select("s", "t", "rank")


@dataclass(frozen=True)
class Joins:
    """How the pieces of a compound change where they meet."""

    ends: tuple[tuple[str, str], ...] = ()  # an ending in a compound, and in the dictionary
    vowels: tuple[tuple[str, str], ...] = ()  # a vowel sign, and the vowels that may begin the next piece
    particles: frozenset[str] = frozenset()  # pieces that may be short
    tails: frozenset[str] = frozenset()  # short last pieces
    enclitics: frozenset[str] = frozenset()  # pieces that come first only before particles


#: Sanskrit sandhi, particles and short tails.
SANSKRIT = Joins(
    ends=(("र्", "ः"), ("ो", "ः"), ("स्", "ः"), ("श्", "ः"), ("ष्", "ः"), ("न्", "म्"), ("ं", "म्"), ("द्", "त्"), ("ग्", "क्"), ("ज्", "त्"), ("च्", "त्"), ("ब्", "प्"), ("ञ्", "म्"), ("ङ्", "म्"), ("ण्", "म्")),
    vowels=(("ा", "अआ"), ("ि", "इ"), ("ी", "ईइ"), ("ु", "उ"), ("ू", "ऊउ"), ("े", "एइ"), ("ो", "ओउ"), ("ै", "ऐए"), ("ौ", "औओ")),
    particles=frozenset("च तु हि न स वा अपि एव इति यत् तत् मे ते नः वः वै ह मा यः सः तम् तं यम् अहम् त्वम् इदम् अयम् सा या का कः किम् यदि यथा तथा अथ अद्य इह अत्र तत्र यत्र सदा पुनः ननु खलु इव".split()),
    tails=frozenset("जन गण मय वश वत् गत कर".split()),
    enclitics=frozenset("च तु हि वा अपि एव इति इव वै ह खलु ननु".split()),
)
AVAGRAHA, LONG_A = "ऽ", "ा"


def _cuts(rest: str, joins: Joins) -> Iterator[tuple[str, str, float]]:
    """(head, what is left, cost of the change) of every way to take a piece off the front, longest first."""
    vowels = dict(joins.vowels)
    for at in range(len(rest), 0, -1):
        head, left = rest[:at], rest[at:]
        yield head, left, 0.0
        if not joins.ends or not left:
            continue
        if left[0] == AVAGRAHA:
            yield head, "अ" + left[1:], 0.0
        if head.endswith("च्") and left[0] == "छ":
            yield head[:-2] + "त्", "श" + left[1:], 0.3
        if len(head) > 1 and head[-1] in vowels:
            for stem in (head[:-1], head[:-1] + LONG_A) if head[-1] in "ाैौे" else (head[:-1],):
                for vowel in vowels[head[-1]]:
                    yield stem, vowel + left, 0.3


def _forms(piece: str, joins: Joins) -> Iterator[str]:
    yield piece
    yield from (piece[: -len(end)] + plain for end, plain in joins.ends if piece.endswith(end))


def split_word(word: str, known: Callable[[str], bool], joins: Joins = Joins(), most: int = 4, least: int = 3) -> list[str] | None:
    """The cheapest known pieces (two to ``most``) that make up a word: one point each, 1.5 more for a short one, 0.3 for a changed one.

    Of equal ones the split with the longer heads is taken.  Pieces shorter
    than ``least`` must be particles or tails.
    """
    heap, made = [(0.0, 0, word, ())], 0
    while heap:
        cost, _, rest, parts = heappop(heap)
        if not rest:
            if len(parts) > 1 and (parts[0] not in joins.enclitics or joins.particles.issuperset(parts[1:])):
                return list(parts)
            continue
        if len(parts) == most:
            continue
        for head, left, extra in _cuts(rest, joins):
            form = next((f for f in _forms(head, joins) if (len(f) >= least or f in joins.particles or f in joins.tails) and known(f)), None)
            if form is not None and (parts or left):
                made += 1
                heappush(heap, (round(cost + 1 + 1.5 * (len(form) < least) + 0.3 * (form != head) + extra, 3), made, left, (*parts, form)))
    return None


def possible_pieces(word: str, joins: Joins, longest: int) -> set[str]:
    """Every form that ``split_word`` could look up in a lexicon whose words have at most ``longest`` letters."""
    found, vowels = set(), dict(joins.vowels)
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + longest + 2) + 1):
            base = word[i:j]
            begins = [base]
            if joins.ends and i:
                begins += ["अ" + base[1:]] * (base[0] == AVAGRAHA) + [v + base for v in vowels.get(word[i - 1], "")] + ["श" + base[1:]] * (base[0] == "छ")
            for b in begins:
                ends = [b, *([b[:-1], b[:-1] + LONG_A] if joins.ends and b[-1] in vowels else []), *([b[:-2] + "त्"] if b.endswith("च्") else [])]
                found.update(f for e in ends if e for f in _forms(e, joins) if len(f) <= longest)
    return found


def compound_split(words: DataFrame, lexicon: DataFrame, endings: tuple[str, ...] = (), joins: Joins = Joins(), least: int = 3) -> DataFrame:
    """(word, parts): words as two to four pieces of the lexicon; an ending is no piece of its own.

    Every piece of a word that can occur in a split is looked up by one join,
    so no lexicon is broadcast; the split itself sees one word and its pieces.
    """
    entries = lexicon.select(F.col("word").alias("piece")).distinct()
    longest = entries.agg(F.max(F.char_length("piece"))).first()[0] or 0

    @F.pandas_udf("array<string>")
    def candidates(whole: pd.Series) -> pd.Series:
        return whole.map(lambda w: sorted(possible_pieces(w, joins, longest)), na_action="ignore")

    @F.pandas_udf("array<string>")
    def split(whole: pd.Series, held: pd.Series) -> pd.Series:
        out = []
        for word, pieces_ in zip(whole, held, strict=True):
            parts = split_word(word, set(pieces_).__contains__, joins, least=least)
            while parts and len(parts) > 1 and parts[-1] in endings:
                parts[-2:] = [parts[-2] + parts[-1]]
            out.append(parts if parts and len(parts) > 1 else None)
        return pd.Series(out)

    pieces = words.select("word").distinct().withColumn("piece", F.explode(candidates("word")))
    known = pieces.join(entries, "piece").groupBy("word").agg(F.collect_set("piece").alias("known"))
    return known.withColumn("parts", split("word", "known")).where("parts is not null").select("word", "parts")


def monotone_pairs(score: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (i, j), both rising, with the greatest sum of scores; rows and columns may be skipped."""
    m, n = len(score), len(score[0]) if score else 0
    best = [[0.0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            best[i][j] = max(best[i - 1][j - 1] + score[i - 1][j - 1], best[i - 1][j], best[i][j - 1])
    pairs, i, j = [], m, n
    while i and j:
        if best[i][j] == best[i - 1][j - 1] + score[i - 1][j - 1] and score[i - 1][j - 1] > 0:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def _heads(title: str) -> set[str]:
    return {w[:3] for w in title.lower().split() if len(w) >= 3}


def align_titles(entries: DataFrame, chapters: DataFrame, by: str, bonus: float = 0.05, least: float = 0.3) -> DataFrame:
    """(by, number, title): printed entries laid onto chapters in order.

    Likeness is the Dice measure of three-letter word heads; an entry that
    carries the chapter's number gains ``bonus``.  entries: (by, place,
    printed, title); chapters: (by, number, title).  A section at a time.
    """

    def section(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("place", ignore_index=True), right.sort_values("number", ignore_index=True)
        heads = [_heads(t or "") for t in right["title"]]

        def likeness(title, k: int) -> float:
            mine = _heads(title or "")
            return 2 * len(mine & heads[k]) / (len(mine) + len(heads[k])) if mine and heads[k] else 0.0

        score = [[likeness(t, k) + (bonus if p == right["number"][k] else 0.0) for k in range(len(right))] for t, p in zip(left["title"], left["printed"], strict=True)]
        got = [(key[0], right["number"][j], left["title"][i]) for i, j in monotone_pairs(score) if likeness(left["title"][i], j) >= least]
        return pd.DataFrame(got, columns=[by, "number", "title"])

    kinds = {f.name: f.dataType.simpleString() for f in chapters.schema}
    return entries.groupBy(by).cogroup(chapters.groupBy(by)).applyInPandas(section, f"{by} {kinds[by]}, number {kinds['number']}, title string")


def place_blocks(fits: DataFrame, by: str, reach: int = 3, join_cost: float = 0.05, least_gain: float = 0.4, region: DataFrame | None = None) -> DataFrame:
    """(by, block, slot): blocks of text put on the slots they fit best, in order.

    ``fits``: (by, block, current, slot, fit).  A block stays within ``reach``
    of its slot, never before the block ahead of it, and pays ``join_cost`` to
    share its slot.  A group is changed only if the sum of fits grows by
    ``least_gain`` or more.  With ``region`` (by, slot), as grown around
    flagged rows by ``sequence.grow_regions``, blocks move from and to its
    slots only; all others stay.  A group is a chapter: its blocks times slots
    are held by one task.
    """
    free = region is None
    if region is not None:
        inside = region.select(by, F.col("slot").alias("_inside")).distinct()
        fits = fits.join(inside, (fits[by] == inside[by]) & (fits["slot"] == inside["_inside"]), "left").select(fits["*"], F.col("_inside").isNotNull().alias("_to"))
        fits = fits.join(inside, (fits[by] == inside[by]) & (fits["current"] == inside["_inside"]), "left").select(*(fits[c] for c in fits.columns), F.col("_inside").isNotNull().alias("_from"))
        fits = fits.withColumn("_stays", ~(F.col("_to") & F.col("_from"))).drop("_to", "_from")

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        bound = {(b, s) for b, s, x in zip(rows["block"], rows["slot"], rows["_stays"], strict=True) if x} if "_stays" in rows else set()
        current = dict(zip(rows["block"], rows["current"], strict=True))
        fit = {(b, s): f for b, s, f in zip(rows["block"], rows["slot"], rows["fit"], strict=True)}
        blocks, slots = sorted(current), sorted(set(rows["slot"]))
        never = float("-inf")

        def gain(b, s) -> float:
            return fit.get((b, s), 0.0) if s == current[b] or (abs(s - current[b]) <= reach and (b, s) not in bound and (free or (b, s) in fit)) else never

        total = [gain(blocks[0], s) for s in slots]
        back: list[list[int]] = []
        for b in blocks[1:]:
            fresh, came, best, at = [], [], never, 0
            for k, s in enumerate(slots):
                shared = total[k] - join_cost
                fresh.append(gain(b, s) + max(shared, best))
                came.append(k if shared > best else at)
                if total[k] > best:
                    best, at = total[k], k
            total = fresh
            back.append(came)
        k = max(range(len(slots)), key=lambda i: (total[i], -i))
        place = [k]
        for came in reversed(back):
            place.append(k := came[k])
        chosen = [slots[k] for k in reversed(place)]
        before = sum(fit.get((b, current[b]), 0.0) for b in blocks)
        after = sum(fit.get((b, s), 0.0) for b, s in zip(blocks, chosen, strict=True))
        if after - before < least_gain:
            chosen = [current[b] for b in blocks]
        return pd.DataFrame({by: rows[by].iloc[0], "block": blocks, "slot": chosen})

    kinds = {f.name: f.dataType.simpleString() for f in fits.schema}
    return fits.groupBy(by).applyInPandas(group, f"{by} {kinds[by]}, block {kinds['block']}, slot {kinds['slot']}")


def lines_from_page(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, line, text): each rough line takes the words of the good text that its characters fall on.

    ``lines``: (by, line, rough, good); ``good`` is the page's whole text.
    """
    import difflib

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("line", ignore_index=True)
        rough, owner = "", []
        for k, text in enumerate(rows["rough"]):
            rough += text + " "
            owner += [k] * (len(text) + 1)
        good = rows["good"].iloc[0]
        at = [None] * len(good)
        for a, b, n in difflib.SequenceMatcher(None, rough, good, autojunk=False).get_matching_blocks():
            for k in range(n):
                at[b + k] = owner[a + k]
        taken: list[list[str]] = [[] for _ in rows["line"]]
        place, now = 0, 0
        for word in good.split(" "):
            held = [o for o in at[place : place + len(word)] if o is not None]
            now = max(set(held), key=lambda o: (held.count(o), -o)) if held else now
            taken[now].append(word)
            place += len(word) + 1
        return pd.DataFrame({**{c: rows[c] for c in by}, "line": rows["line"], "text": [" ".join(t) for t in taken]})

    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    return lines.groupBy(*by).applyInPandas(page, ", ".join(f"{c} {kinds[c]}" for c in by) + f", line {kinds['line']}, text string")
