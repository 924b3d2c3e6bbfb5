"""Retry times over a stream of outcomes: the same rows as the stored failures, kept per card with a timer each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "etag string, attempts long, first_at timestamp, next_retry_at timestamp, reason string"
CHANGES = "side string, href string, event string, etag string, attempts long, first_at timestamp, next_retry_at timestamp, reason string"


def retry_changes(outcomes: DataFrame, late: str = "10 minutes", base: int = 120, cap: int = 86_400) -> DataFrame:
    """What happens to failure rows, from a stream of outcomes (side, href, etag, at timestamp, reason; null: it went well).

    A failure under an equal etag counts one up, another etag starts again at 1, and the next try is the base later,
    doubled per further failure, at most *cap* seconds: event 'failed'. A success clears the row: 'cleared'. Once the
    watermark has passed the time of the next try, the card is 'due'; the row stays until the next outcome. State is one
    row per failing card; outcomes of a card in one batch count in the order of their times.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        side, href = key
        row = dict(zip(("etag", "attempts", "first_at", "next_retry_at", "reason"), state.get, strict=True)) if state.exists else None
        if state.hasTimedOut:
            yield pd.DataFrame([{"side": side, "href": href, "event": "due", **row}])
            return
        events = pd.concat(list(batches)).sort_values(["at", "etag"], kind="stable")
        out = []
        for e in events.itertuples():
            etag = e.etag if isinstance(e.etag, str) else None
            if not isinstance(e.reason, str):
                if row:
                    out.append({"side": side, "href": href, "event": "cleared", **row})
                row = None
                continue
            again = row is not None and row["etag"] == etag
            attempts = row["attempts"] + 1 if again else 1
            wait = min(cap, base * 2 ** min(attempts - 1, 40))
            row = {"etag": etag, "attempts": attempts, "first_at": row["first_at"] if again else e.at, "next_retry_at": e.at + pd.Timedelta(seconds=wait), "reason": e.reason}
            out.append({"side": side, "href": href, "event": "failed", **row})
        if row is None:
            if state.exists:
                state.remove()
        else:
            state.update(tuple(row.values()))
            now = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(int(row["next_retry_at"].timestamp() * 1000), now + 1))
        if out:
            yield pd.DataFrame(out)

    keyed = outcomes.withWatermark("at", late).groupBy("side", "href")
    return keyed.applyInPandasWithState(fold, CHANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout)
