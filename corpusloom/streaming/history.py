"""The latest N records, overall or per key, in batch and as a stream with N records of state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HISTORY = 100
#: Records beyond ``n`` that a key may gather from its input before it lets the older ones go.
MOST_HELD = 10_000
#: The state store that ``stream_latest`` needs; to be set in the session before the query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def latest(df: DataFrame, ts: str, record_id: str, n: int = HISTORY) -> DataFrame:
    """Newest ``n`` records overall: a top-k, not an unpartitioned window."""
    return df.orderBy(F.desc(ts), F.desc(record_id)).limit(n)


def latest_per_key(df: DataFrame, key: str, ts: str, record_id: str, n: int = HISTORY) -> DataFrame:
    """Newest ``n`` records per key; the rank limit is applied before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(record_id))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _newest(rows: pd.DataFrame, n: int, by: list[str]) -> pd.DataFrame:
    ordered = rows.drop_duplicates([*by, "record_id"]).sort_values(["ts_us", "record_id"], ascending=False)
    return ordered.groupby(by, sort=False).head(n) if by else ordered.head(n)


class NewestRecords(StatefulProcessor):
    """Holds a key's newest ``n`` records; emits those it holds after an input, and once each record that it lets go."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value a key: read and written in one step each, as plain numbers, newest first
        self.held = handle.getValueState("held", "ts_us array<bigint>, record_id array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ts_us, before = self.held.get() or ([], [])
        best = dict(zip(before, ts_us))
        for row in rows:
            best.setdefault(row.record_id, row.ts_us)
            if len(best) > MOST_HELD + self.n:
                best = self._newest(best)
        best = self._newest(best)
        self.held.update((list(best.values()), list(best)))
        for position, record_id in enumerate(best, 1):
            yield Row(key=key[0], record_id=record_id, position=position, evicted=False)
        for record_id in before:
            if record_id not in best:
                yield Row(key=key[0], record_id=record_id, position=0, evicted=True)

    def _newest(self, records: dict[int, int]) -> dict[int, int]:
        """The newest ``n`` in order; a record without a time is older than all others."""
        order = sorted(records.items(), key=lambda r: (r[1] is not None, r[1], r[0]), reverse=True)
        return dict(order[: self.n])

    def close(self) -> None:
        pass


def stream_latest(events: DataFrame, n: int = HISTORY) -> DataFrame:
    """Stream of ``(key, record_id, position, evicted)``: the newest ``n`` records of each key that changed, and the evicted ones.

    ``events`` carry ``key string, ts_us bigint, record_id bigint``. State per key is ``n`` records in RocksDB, however many
    pass. Before the shuffle each Arrow batch hands on its newest ``n`` per key, so that a hot key of very many rows reaches
    its task as a few.
    """

    def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _newest(batch, n, ["key"])

    fewer = events.select("key", "ts_us", "record_id").mapInPandas(combined, "key string, ts_us bigint, record_id bigint")
    return fewer.groupBy("key").transformWithState(
        NewestRecords(n), "key string, record_id bigint, position int, evicted boolean", "Update", "None"
    )
