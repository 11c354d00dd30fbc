"""The abuse guard over event files as a stream, with each client's state in a state store.

Events may come out of order within the watermark's delay: a client's events wait until the watermark has passed them, and
are then settled in the order of time, by a timer. Until then their decisions are provisional, and are made anew whenever the client
has new events. Clients without new events or due timers are neither read nor written.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from corpusmill.operators.ingestion import Ban

DECISIONS = "user_id long, event_id long, blocked boolean, settled boolean, turn long"
#: until: the end of a ban (0: none); seen: times that count; ids and times of waiting events; turn: numbers decisions.
_STATE = "until long, seen array<bigint>, ids array<bigint>, times array<bigint>, turn long"
_STORE = "spark.sql.streaming.stateStore.providerClass"


class Guard(StatefulProcessor):
    """Decisions of one client's events (event_id, us): more than limit in (now - window, now] ban it for ban microseconds."""

    def __init__(self, limit: int, window: int, ban: int):
        self.limit, self.window, self.ban = limit, window, ban

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("client", _STATE)

    def _read(self) -> tuple[int, list[int], list[tuple[int, int]], int]:
        if not self.state.exists():
            return 0, [], [], 0
        until, seen, ids, times, turn = self.state.get()
        return until, list(seen), list(zip(times, ids, strict=True)), turn

    def _decided(self, key, until: int, seen: list[int], events: list[tuple[int, int]]) -> tuple[Ban, list[tuple[int, bool]]]:
        fold = Ban(key, self.limit, self.window, self.ban)
        fold.until, fold.seen = until or None, seen
        return fold, [(e, blocked) for us, e in events for _, _, blocked in fold.step(e, us)]

    def _settle(self, key, now: int, until, seen, waiting, turn) -> Iterator[pd.DataFrame]:
        """Settles what the watermark (in microseconds) has passed, decides on the rest for now, and keeps what still counts."""
        due, rest = [w for w in waiting if w[0] < now], [w for w in waiting if w[0] >= now]
        fold, settled = self._decided(key, until, seen, due)
        until = fold.until if fold.until is not None and fold.until > now else 0
        seen = [t for t in fold.seen if t > now - self.window]
        _, later = self._decided(key, until, list(seen), rest)
        rows = [(*d, True) for d in settled] + [(*d, False) for d in later]
        if rest or until or seen:
            self.state.update((until, seen, [e for _, e in rest], [t for t, _ in rest], turn + 1))
            # The next that waits, or the time from which the state says nothing more.
            self.handle.registerTimer((rest[0][0] if rest else max(until, *(t + self.window for t in seen), 0)) // 1000 + 1)
        else:
            self.state.clear()
        if rows:
            yield pd.DataFrame({"user_id": key[0], "event_id": [e for e, _, _ in rows], "blocked": [b for _, b, _ in rows], "settled": [s for _, _, s in rows], "turn": turn})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until, seen, waiting, turn = self._read()
        for batch in rows:
            waiting += zip(batch["us"].tolist(), batch["event_id"].tolist(), strict=True)
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs() * 1000, until, seen, sorted(waiting), turn)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield from self._settle(key, timerValues.getCurrentWatermarkInMs() * 1000, *self._read())

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def guarded(spark: SparkSession, pattern: str, out: str, limit: int, window: int, ban: int, delay: str = "1 hour", files: int = 1) -> DataFrame:
    """user_id, event_id, blocked of all events (user_id, event_id, ts) in files of a path pattern, taken as a stream of so many files a
    micro-batch until none is left; another run with the same out goes on from its checkpoint.

    An event up to delay behind the latest one read counts at its time, whatever file it is in; one further behind may be dropped as
    late, then it has no row. Events of null user_id or ts are left out. The decision is the settled one, or the last provisional one.
    """
    schema = spark.read.parquet(pattern).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern).where("user_id is not null and ts is not null")
    events = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    decisions = events.groupBy("user_id").transformWithStateInPandas(Guard(limit, window, ban), DECISIONS, "Append", "EventTime")
    with _state_store(spark):
        decisions.writeStream.format("parquet").option("path", f"{out}/decisions").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(DECISIONS).parquet(f"{out}/decisions")
    return rows.groupBy("user_id", "event_id").agg(F.max_by("blocked", F.struct("settled", "turn")).alias("blocked"))
