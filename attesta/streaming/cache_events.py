"""The cache log as a stream: versions and counters in update mode, and current entries by a stateful operator.

An addition: batch replay in ``attesta.operators.cachelog`` gives the same results over a log at rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attesta.operators.cachelog import CHECKED, RETRY_DELAY, STORED


def versions(events: DataFrame) -> DataFrame:
    """First and last time of each body of a url; for output mode ``update`` or ``complete``."""
    seen = events.where(F.col("status").isin(*CHECKED, *STORED) & F.col("sha256").isNotNull())
    return seen.groupBy("url", "sha256").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def windowed_counters(events: DataFrame, time: str = "time", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by status and hour; late ones count until the watermark passes."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), "status").agg(F.count(F.lit(1)).alias("n"))


_STATE = "sha256 string, checked_at double, failures long, retry_at double, last_id long"
_OUT = f"url string, {_STATE}"


def _step(state: tuple[Any, ...], row: Any, delay: float) -> tuple[Any, ...]:
    sha, checked, failures, retry, last = state
    if row.id <= last:  # seen already
        return state
    if row.status == "failed":
        failures += 1
        retry = row.at + min(86400.0, delay * 2.0 ** min(failures - 1, 16))
    else:
        sha = row.sha256 if row.sha256 is not None else sha
        checked = row.at if row.status in CHECKED else checked
        failures, retry = 0, None
    return sha, checked, failures, retry, row.id


def entries(events: DataFrame, delay: float = RETRY_DELAY) -> DataFrame:
    """The current entry of each url after each batch; a failure keeps the body and sets the next try."""

    def run(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (None, None, 0, None, -1)
        rows = pd.concat(list(parts)).sort_values("id")
        for row in rows.itertuples(index=False):
            now = _step(now, row, delay)
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["url", "sha256", "checked_at", "failures", "retry_at", "last_id"])

    return events.groupBy("url").applyInPandasWithState(run, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
