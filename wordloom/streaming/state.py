"""Keyed state: review cards and the page assembler as streams.

State is bounded by key: a card is three numbers, an assembler an open buffer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wordloom.operators.assemble import MARKER
from wordloom.operators.review import DAY_MS, STEPS


def review_cards(answers: DataFrame) -> DataFrame:
    """(card, stage, due_at) after each batch of answers (card, ts_ms, remembered).

    Answers of a batch are taken in order of time; one older than the card's
    last answer changes nothing.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, last = state.get if state.exists else (0, -1)
        rows = pd.concat(batches).sort_values("ts_ms")
        for ts, remembered in zip(rows["ts_ms"], rows["remembered"], strict=True):
            if ts > last:
                stage, last = (min(stage + 1, len(STEPS)) if remembered else 0), int(ts)
        state.update((stage, last))
        yield pd.DataFrame({"card": [key[0]], "stage": [stage], "due_at": [last + STEPS[min(stage, len(STEPS) - 1)] * DAY_MS]})

    return answers.groupBy("card").applyInPandasWithState(update, "card long, stage int, due_at long", "stage int, last long", "update", GroupStateTimeout.NoTimeout)


def assemble_stream(pages: DataFrame) -> DataFrame:
    """(vol, unit, text, first_page, last_page): units of pages (vol, page, text) as their markers arrive.

    Pages of a volume must arrive in order; the text behind the last marker
    waits in the state for the next page.
    """
    marker = re.compile(MARKER)

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        unit, held, first = state.get if state.exists else (0, "", -1)
        out = []
        for page, text in pd.concat(batches).sort_values("page")[["page", "text"]].itertuples(index=False):
            at = 0
            for m in marker.finditer(text):
                whole = " ".join(x for x in (held, text[at : m.start()].strip()) if x)
                out.append((key[0], unit, whole, int(first if held else page), int(page)))
                unit, held, at = unit + 1, "", m.end()
            tail = text[at:].strip()
            if tail:
                first = first if held else page
                held = " ".join(x for x in (held, tail) if x)
        state.update((unit, held, int(first)))
        yield pd.DataFrame(out, columns=["vol", "unit", "text", "first_page", "last_page"])

    return pages.groupBy("vol").applyInPandasWithState(update, "vol int, unit int, text string, first_page int, last_page int", "unit int, held string, first int", "append", GroupStateTimeout.NoTimeout)


def new_only(stream_batch: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose result isn't there yet: what a restarted job still has to do (for foreachBatch)."""
    return stream_batch.join(done.select(*keys).distinct(), keys, "left_anti")
