"""The keyed merge over records that arrive over time, as state with timers.

Each key's state is the record merged so far (its longest values, as records.merge_by_key takes them) and the ids that it has
seen. A key without arrivals for `idle` of event time is done: its timer, or a later row of the key, gives the record and clears
the state, so state is bounded by what arrives within `idle`. Replays of an id that the state has seen change nothing.

A row whose time lies `late` behind the latest time of earlier batches is late: it isn't merged but goes to the side output, as
kind `late`. Spark itself drops what is later than `late` + `grace`; rows in between are what the side output has.

Nulls and edge cases: rows with blank keys are a key of their own, as is each different text of a key; a null cell is blank; a
null time can't be ordered, and such rows are late.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.values import blank_free

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class MergeByKey(StatefulProcessor):
    def __init__(self, keys: list[str], columns: list[str], idle_ms: int, grace_ms: int):
        self.columns, self.idle, self.grace = columns, idle_ms, grace_ms
        self.names = [*keys, "kind", "record_idx", "merge_count", *columns]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.merged = handle.getValueState("merged", "record_idx long, n long, last long, best array<string>, held_by array<long>")
        self.seen = handle.getMapState("seen", "record_idx long", "there boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        since = timerValues.getCurrentWatermarkInMs() + self.grace
        state = self.merged.get() if self.merged.exists() else None
        first, n, last, best, held = state if state else (None, 0, None, [None] * len(self.columns), [None] * len(self.columns))
        best, held, before = list(best), list(held), last
        for r in sorted(rows, key=lambda r: (r["_ms"], r["record_idx"])):
            if r["_ms"] < since:
                yield self._row(key, "late", r["record_idx"], 1, [r[c] for c in self.columns])
                continue
            if n and r["_ms"] > last + self.idle:  # the key was done before this row's time
                yield self._row(key, "record", first, n, best)
                self.seen.clear()
                first, n, last, best, held = None, 0, None, [None] * len(self.columns), [None] * len(self.columns)
            if self.seen.containsKey((r["record_idx"],)):
                continue
            self.seen.updateValue((r["record_idx"],), (True,))
            first = r["record_idx"] if first is None else min(first, r["record_idx"])
            n, last = n + 1, max(r["_ms"], last or 0)
            for i, c in enumerate(self.columns):
                length = len(r[f"_trim_{c}"])
                now = len((best[i] or "").strip(" ")) if held[i] is not None else -1
                if length > now or length == now and r["record_idx"] < held[i]:
                    best[i], held[i] = r[c], r["record_idx"]
        if n and last != before:
            if before is not None:  # the timer of what was there before this batch
                self.handle.deleteTimer(before + self.idle - self.grace)
            self.handle.registerTimer(last + self.idle - self.grace)  # Spark's watermark is `grace` behind ours
        if n:
            self.merged.update((first, n, last, best, held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, n, _, best, _ = self.merged.get()
        self.merged.clear()
        self.seen.clear()
        yield self._row(key, "record", first, n, list(best))

    def _row(self, key, kind: str, record_idx: int, n: int, values: list) -> Row:
        return Row(**dict(zip(self.names, [*key, kind, record_idx, n, *values], strict=True)))

    def close(self) -> None:
        pass


def merged_arrivals(records: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", idle: str = "1 hour", late: str = "10 minutes", grace: str = "1 day") -> DataFrame:
    """keys, kind (record or late), record_idx (the first one's), merge_count and columns of a stream of keys, record_idx, ts and
    columns. Records come when their key has been idle; see records.merge_by_key for the batch twin."""
    spark = records.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    ms = lambda x: int(spark.range(1).select(F.expr(f"cast((timestamp'2000-01-01' + interval {x}) as double) - cast(timestamp'2000-01-01' as double)").alias("s")).first().s * 1000)
    r = records.withWatermark(ts, f"{(ms(late) + ms(grace)) // 1000} seconds")
    trimmed = [F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(k) for k in keys]
    cells = [F.col(c).cast("string").alias(c) for c in columns] + [blank_free(F.col(c).cast("string")).alias(f"_trim_{c}") for c in columns]
    r = r.select(*trimmed, "record_idx", ts, *cells, F.coalesce(F.unix_millis(ts), F.lit(-1)).alias("_ms"))
    shape = ", ".join([*(f"`{k}` string" for k in keys), "kind string, record_idx long, merge_count long", *(f"`{c}` string" for c in columns)])
    return r.groupBy(*keys).transformWithState(MergeByKey(keys, columns, ms(idle), ms(grace)), shape, "append", "EventTime")
