"""Streams with timers: pages that arrive out of order, and debounced events.

State is one value and one timer for each key: what waits, and the time at
which waiting ends.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wordloom.operators.assemble import MARKER


def _load(state: GroupState, fresh: dict) -> dict:
    """What was saved for the key, or ``fresh``."""
    return pickle.loads(bytes(state.get[0])) if state.exists else fresh


def _drain(vol: int, held: dict) -> list[tuple]:
    """Units of all waiting pages that follow on; what is left open stays."""
    out, marker = [], re.compile(MARKER)
    while held["next"] in held["waiting"]:
        page, text = held["next"], held["waiting"].pop(held["next"]) or ""
        pieces, at = [], 0
        for mark in marker.finditer(text):
            pieces.append((text[at : mark.start()].strip(), True))
            at = mark.end()
        for piece, closed in [*pieces, (text[at:].strip(), False)]:
            held["begun"] = held["begun"] if held["open"] else page
            held["open"] = f"{held['open']} {piece}".strip()
            if closed:
                out.append((vol, held["unit"], held["open"], held["begun"], page, "unit"))
                held["unit"], held["open"] = held["unit"] + 1, ""
        held["next"] += 1
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["vol", "unit", "text", "first_page", "last_page", "status"]
    return pd.DataFrame(rows, columns=names).astype({"vol": "Int32", "unit": "Int32", "first_page": "Int32", "last_page": "Int32", "text": "object", "status": "object"})


def assemble_unordered(pages: DataFrame, first: int = 1, patience_ms: int = 3_600_000) -> DataFrame:
    """(vol, unit, text, first_page, last_page, status): units of pages (vol, page, text) that arrive in any order.

    Pages of a volume are numbered from ``first`` without gaps.  A page waits
    until all before it are there; after ``patience_ms`` the missing ones are
    given up.  A page that comes after it was given up, or a second time, is a
    row of status ``late``, so that nothing is lost unseen.  Timers go by the
    clock, so a run with ``availableNow`` ends only where
    ``spark.sql.streaming.noDataMicroBatches.enabled`` is off.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, late = _load(state, {"unit": 0, "open": "", "begun": -1, "next": first, "waiting": {}, "until": None}), []
        now = state.getCurrentProcessingTimeMs()
        for batch in batches:
            for page, text in zip(batch["page"].tolist(), batch["text"].tolist(), strict=True):
                if page < held["next"] or page in held["waiting"]:
                    late.append((key[0], None, text, page, page, "late"))
                else:
                    held["waiting"][page] = text
        if held["waiting"] and held["until"] is not None and held["until"] <= now:
            held["next"], held["until"] = min(held["waiting"]), None
        out = _drain(key[0], held) + late
        held["until"] = (held["until"] or now + patience_ms) if held["waiting"] else None
        state.update((pickle.dumps(held),))
        if held["until"] is not None:
            state.setTimeoutDuration(max(1, held["until"] - now))
        yield _frame(out)

    schema = "vol int, unit int, text string, first_page int, last_page int, status string"
    return pages.groupBy("vol").applyInPandasWithState(update, schema, "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def debounce_stream(events: DataFrame, by: list[str], quiet_ms: int, late: str = "10 minutes") -> DataFrame:
    """The events of a stream that no newer one of the same key follows within the quiet time, each once that is certain.

    ``events`` has ts and event_id; of a key, two events with both equal are
    one.  An event is decided when the watermark (``late`` behind the newest
    event) has passed the end of its quiet time, so events that arrive late by
    no more than ``late`` cancel others as in ``windows.debounced``.
    """
    names, quiet_us = events.columns, quiet_ms * 1000
    at_id = names.index("event_id")

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _load(state, {})
        for batch in batches:
            values = batch.astype(object).where(batch.notna(), None)
            for us, row in zip(batch["ts"].astype("datetime64[us]").astype("int64").tolist(), values[names].itertuples(index=False, name=None), strict=True):
                held[us, row[at_id]] = row
        settled, known, out = state.getCurrentWatermarkMs() * 1000, sorted(held), []
        for this, following in zip(known, [*known[1:], None], strict=True):
            if this[0] + quiet_us > settled:
                break
            row = held.pop(this)
            if following is None or following[0] - this[0] >= quiet_us:
                out.append(row)
        if held:
            state.update((pickle.dumps(held),))
            state.setTimeoutTimestamp(max(-(-(min(held)[0] + quiet_us) // 1000), settled // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    return events.withWatermark("ts", late).groupBy(*by).applyInPandasWithState(update, events.schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
