"""Analysis sessions over a stream: page upserts with expiry, kept as state per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session_id string, total int, completed int, progress double, complete boolean, updated_ms bigint"
STATE = "total int, created_ms bigint, updated_ms bigint, pages array<int>"


def session_progress(events: DataFrame, ttl_ms: int = 2 * 60 * 60 * 1000) -> DataFrame:
    """Progress after each batch from a stream (session_id, total, idx, ts): the last write of a page counts.

    A null idx creates or refreshes a session. State goes once the watermark has passed the last write by more
    than ttl_ms; a session older than ttl_ms when an event arrives starts anew. A change of the total and an
    index out of range fail the query, as does a total outside 1..50.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, created, updated, pages = state.get if state.exists else (None, None, None, [])
        pages = set(pages)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for event in rows.itertuples(index=False):
            now = int(event.ts.timestamp() * 1000)
            if updated is not None and updated < now - ttl_ms:
                total, created, pages = None, None, set()
            if total is None:
                total, created = int(event.total), now
            if int(event.total) != total or not 1 <= total <= 50:
                raise ValueError("the number of pages is out of range or changed")
            if not pd.isna(event.idx):
                if not 0 <= int(event.idx) < total:
                    raise ValueError("the page index is out of range")
                pages.add(int(event.idx))
            updated = now if updated is None else max(updated, now)
        state.update((total, created, updated, sorted(pages)))
        state.setTimeoutTimestamp(max(updated + ttl_ms + 1, state.getCurrentWatermarkMs() + 1))
        share = int(len(pages) / total * 10000 + 0.5) / 100
        yield pd.DataFrame([(key[0], total, len(pages), share, len(pages) == total, updated)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    marked = events.withWatermark("ts", "1 minute").select("session_id", F.col("total").cast("int"), F.col("idx").cast("double"), "ts")
    return marked.groupBy("session_id").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
