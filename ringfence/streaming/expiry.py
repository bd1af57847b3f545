"""Keyed state with event-time timers: blocks that free themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def _timer_ms(expires_us: int) -> int:
    """Timers count in milliseconds: the first one not before the expiry."""
    return -(-expires_us // 1000)


class BlockExpiry(StatefulProcessor):
    """Holds the latest block of a key until it has expired.

    Rows (key, blocked_us, expires_us) come in, times in microseconds. A row
    (key, blocked_us, expires_us, active) goes out when the latest block moves (active) and when
    the watermark passes its expiry (not active); then the key has no state.
    A key has one timer. Its rows come in batches and are folded to their
    latest, so a key that holds a third of all rows costs one number."""

    def __init__(self, key: str, key_type: T.DataType):
        self.key, self.key_type = key, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("block", T.StructType([
            T.StructField("blocked_us", T.LongType()), T.StructField("expires_us", T.LongType())]))

    def _row(self, key, block: tuple[int, int], active: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: pd.Series([key[0]]), "blocked_us": [block[0]], "expires_us": [block[1]], "active": [active]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for part in rows:
            block = int(part["blocked_us"].max()), int(part["expires_us"].max())  # all rows have one ttl
            newest = block if newest is None else max(newest, block)
        held = self.block.get() if self.block.exists() else None
        if newest is None or (held is not None and newest[0] <= held[0]):
            return
        if held is not None:
            self.handle.deleteTimer(_timer_ms(held[1]))
        self.block.update(newest)
        self.handle.registerTimer(_timer_ms(newest[1]))
        yield self._row(key, newest, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.block.exists():
            return
        held = tuple(self.block.get())
        if _timer_ms(held[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.block.clear()
            yield self._row(key, held, False)

    def close(self) -> None:
        pass
