"""A live limiter over the keys of a pool, and late corrections of a stream of requests.

A pool (``scope``) has several keys. A request takes the first key, round robin, that is neither cooling nor used up for the day; a key that
is refused hands over to the next one. The state of a pool is small (a minute of admissions, one row per key) and goes when nothing in it can matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loomspan.functions import text as T
from loomspan.streaming.ledger import MINUTE, Minute

NEVER = float("inf")
GRANTED = "scope string, event_id long, at double, key string, admitted double"
COLUMNS = ["scope", "event_id", "at", "key", "admitted"]
KEY_STATE = "until double, used long, day double, turn long"
MINUTE_STATE = "key string, at double, tokens long"


class Pool:
    """The keys of one pool: their last minute, the end of their cooling, what they used today, and whose turn is next."""

    def __init__(self, names: list[str], rpm: int, tpm: int, daily: int) -> None:
        self.names, self.rpm, self.tpm, self.daily, self.turn = names, rpm, tpm, daily, 0
        self.minutes = {k: Minute(rpm, tpm) for k in names}
        self.until = dict.fromkeys(names, 0.0)
        self.used: dict[str, tuple[float, int]] = dict.fromkeys(names, (0.0, 0))

    def told(self, kind: str, key: str, day: float, until: float | None) -> None:
        """A key has to cool until a time, or is refused for the day."""
        if key not in self.minutes:
            return
        if kind == "cooling" and until is not None:
            self.until[key] = max(self.until[key], until)
        elif kind == "refused":
            self.used[key] = (day, self.daily)

    def admit(self, at: float, day: float, tokens: int) -> tuple[str | None, float]:
        """The key that a request goes out with, and when; no key and never, if all are used up or it is beyond the limit."""
        left = [k for k in self._in_turn() if self._spent(k, day) < self.daily]
        if not left or tokens > self.tpm:
            return None, NEVER
        ready = [k for k in left if self.until[k] <= at]
        key = ready[0] if ready else min(left, key=lambda k: self.until[k])
        when = self.minutes[key].admit(max(at, self.until[key]), tokens)
        self.used[key] = (day, self._spent(key, day) + 1)
        self.turn = (self.names.index(key) + 1) % len(self.names)
        return key, when

    def _in_turn(self) -> list[str]:
        return self.names[self.turn :] + self.names[: self.turn]

    def _spent(self, key: str, day: float) -> int:
        own, used = self.used[key]
        return used if own == day else 0

    def matters_until(self) -> float:
        """When everything here is past: admissions after a minute, cooling at its end, a day's use two days after it began."""
        ends = [m.times[-1] + MINUTE for m in self.minutes.values() if len(m.times)]
        return max([*ends, *self.until.values(), *(day + 172_800 for day, used in self.used.values() if used)], default=0.0)

    def answered(self, scope: str, rows: pd.DataFrame) -> pd.DataFrame:
        """The grants of the requests among the rows ``event_id, at, day, kind, key, tokens, until``, in the order of their times."""
        out = []
        for r in rows.sort_values(["at", "event_id"]).itertuples(index=False):
            if r.kind == "request":
                key, when = self.admit(r.at, r.day, int(r.tokens))
                out.append((scope, r.event_id, r.at, key, when))
            else:
                self.told(r.kind, r.key, r.day, r.until)
        return pd.DataFrame(out, columns=COLUMNS)


def _timed(events: DataFrame) -> DataFrame:
    """Adds ``time`` and ``day``, the west coast midnight before it, to ``scope, event_id, at (seconds), kind, key, tokens, until``."""
    time = F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))
    return events.select("scope", "event_id", "at", (F.unix_micros(T.pacific_midnight(time)) / 1_000_000).alias("day"), "kind", "key", F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"), F.col("until").cast("double").alias("until"), time.alias("time"))


def grants_replay(events: DataFrame, keys: list[str], rpm: int, tpm: int, daily: int) -> DataFrame:
    """The table form of ``grants``."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope, pool = None, None
        for pdf in batches:
            for name, rows in pdf.groupby("scope", sort=False):
                if name != scope:
                    scope, pool = name, Pool(keys, rpm, tpm, daily)
                yield pool.answered(name, rows)

    return _timed(events).repartition("scope").sortWithinPartitions("scope", "at", "event_id").mapInPandas(fold, GRANTED)


class Limiter(StatefulProcessor):
    """A pool as state: a value row per key in a map, the admissions of the last minute in a list, and one timer for the end of it all."""

    def __init__(self, keys: list[str], rpm: int, tpm: int, daily: int) -> None:
        self.keys, self.rpm, self.tpm, self.daily = keys, rpm, tpm, daily

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.per_key = handle.getMapState("keys", "key string", KEY_STATE)
        self.minute = handle.getListState("minute", MINUTE_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pool = self._loaded()
        # what is older than the watermark was dropped; a micro-batch is answered in the order of its times
        own = pd.concat(list(rows), ignore_index=True)
        yield pool.answered(key[0], own)
        self._save(pool, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pool = self._loaded()
        if pool.matters_until() * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.per_key.clear()
            self.minute.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _loaded(self) -> Pool:
        pool = Pool(self.keys, self.rpm, self.tpm, self.daily)
        for (name,), (until, used, day, turn) in self.per_key.iterator():
            pool.until[name], pool.used[name], pool.turn = until, (day, used), turn
        held: dict[str, list[tuple[float, int]]] = {}
        for name, at, tokens in self.minute.get():
            held.setdefault(name, []).append((at, tokens))
        for name, own in held.items():
            pool.minutes[name] = Minute(self.rpm, self.tpm, *map(list, zip(*sorted(own))))
        return pool

    def _save(self, pool: Pool, watermark: int) -> None:
        for name in pool.names:
            day, used = pool.used[name]
            self.per_key.updateValue((name,), (float(pool.until[name]), int(used), float(day), int(pool.turn)))
        self.minute.put([(name, float(t), int(n)) for name, m in pool.minutes.items() for t, n in zip(m.times.tolist(), m.tokens.tolist())])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(pool.matters_until() * 1000) + 1, watermark + 1))


def grants(events: DataFrame, keys: list[str], rpm: int, tpm: int, daily: int, late: str = "1 hour") -> DataFrame:
    """Stream ``scope, event_id, at (seconds), kind (request, cooling, refused), key, tokens, until`` to ``scope, event_id, at, key, admitted``.

    Events of a pool are answered in the order of their times within a micro-batch. The session's state store must be the one for several states
    (``RocksDBStateStoreProvider``). A pool's state is dropped once the watermark, ``late`` behind, has passed all it holds.
    """
    timed = _timed(events).withWatermark("time", late)
    return timed.groupBy("scope").transformWithStateInPandas(Limiter(keys, rpm, tpm, daily), GRANTED, "append", "eventTime")


def corrected_stream(requests: DataFrame, metrics: DataFrame, late: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """The stream form of ``ledger.corrected``: requests ``request_id, scope, sent, tokens`` with the newest actual number of
    ``request_id, version, told, tokens`` that is told ``within`` a time after sending.

    Both sides are deduplicated within their watermark (a request by its id, a number by id and version), joined left outer within the time
    bound, and the versions of a request become one row, which comes out once, when the watermark has passed all that may still change it. Numbers behind
    the watermark are dropped and counted, see ``late_rows``.
    """
    sent = requests.select("request_id", "scope", "sent", "tokens").withWatermark("sent", late).dropDuplicatesWithinWatermark(["request_id"])
    told = metrics.select(F.col("request_id").alias("_id"), "version", "told", F.col("tokens").alias("_actual")).withWatermark("told", late).dropDuplicatesWithinWatermark(["_id", "version"])
    met = sent.join(told, (F.col("request_id") == F.col("_id")) & (F.col("told") >= F.col("sent")) & (F.col("told") <= F.col("sent") + F.expr(f"INTERVAL {within}")), "leftOuter")
    own = met.groupBy(F.window("sent", "1 minute"), "request_id", "scope", "tokens").agg(F.max_by("_actual", "version").alias("_actual"))
    return own.select("request_id", "scope", F.col("window.start").alias("minute"), F.coalesce("_actual", "tokens").alias("tokens"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, over the reported progress of a query."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
