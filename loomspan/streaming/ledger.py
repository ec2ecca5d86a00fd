"""Streams of requests: windows with late data, retention, and folds that keep state per scope."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspan.functions import text as T

MINUTE = 60.0


def minute_usage(requests: DataFrame, late: str = "48 hours") -> DataFrame:
    """Tumbling minutes per scope; what comes later than ``late`` is past the retention."""
    return requests.withWatermark("sent", late).groupBy(F.window("sent", "1 minute"), "scope").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))


def civil_days(requests: DataFrame, late: str = "48 hours") -> DataFrame:
    """Daily counters that start anew at west coast midnight."""
    day = T.pacific_midnight("sent").alias("day_start")
    return requests.withWatermark("sent", late).groupBy("scope", day).agg(F.count("*").alias("used"))


def cooldown_state(stated: DataFrame, late: str = "48 hours") -> DataFrame:
    """The latest stated end per scope and day of that end; a day's state goes once it is past."""
    return stated.withWatermark("until", late).groupBy(F.window("until", "1 day"), "scope").agg(F.max("until").alias("until")).select("scope", "until")


class Minute:
    """What was admitted in the last minute of one scope, as sorted times and tokens.

    Both limits name a time from which a request fits: when the request ``rpm`` places from the end expires, and when
    the first request expires whose running sum covers the tokens in excess. The later of both is the admission; there is nothing to wait for twice.
    """

    def __init__(self, rpm: int, tpm: int, times: list[float] | None = None, tokens: list[int] | None = None) -> None:
        self.rpm, self.tpm = rpm, tpm
        self.times, self.tokens = np.array(times or [], np.float64), np.array(tokens or [], np.int64)

    def admit(self, at: float, tokens: int, unknown: bool = False) -> float:
        """When the request goes out; infinite, and not kept, if it is beyond the whole limit.

        Tokens may be negative (a correction). A request of ``unknown`` tokens waits for its place only, and holds none; one without a time (NaN) has no
        admission and is not kept.
        """
        if tokens > self.tpm and not unknown:
            return float("inf")
        if at != at:
            return at
        live = np.searchsorted(self.times, at - MINUTE, side="right")
        times, held = self.times[live:], self.tokens[live:]
        upto = np.cumsum(held)
        free = [at]
        if len(times) >= self.rpm:
            free.append(times[-self.rpm] + MINUTE)
        excess = upto[-1] + tokens - self.tpm if len(upto) and not unknown else 0
        if excess > 0:
            free.append(times[np.argmax(upto >= excess)] + MINUTE)  # sums may fall again where tokens are negative; the last one always covers it
        when = float(max(free))
        place = np.searchsorted(times, when, side="right")
        self.times, self.tokens = np.insert(times, place, when), np.insert(held, place, 0 if unknown else tokens)
        return when


ADMITTED = "scope string, at double, tokens long, admitted double, waited double"


def _known(requests: DataFrame) -> DataFrame:
    """``tokens`` without nulls, which would make the longs of a pandas batch floats; ``_unknown`` marks them."""
    tokens = F.col("tokens").cast("long")
    return requests.select("scope", F.col("at").cast("double").alias("at"), F.coalesce(tokens, F.lit(0)).alias("tokens"), tokens.isNull().alias("_unknown"))


def _admitted(rows: pd.DataFrame, minutes: Iterator[Minute]) -> pd.DataFrame:
    """``rows`` admitted in their order, each by its scope's minute."""
    at, tokens, unknown = rows["at"].to_numpy(np.float64), rows["tokens"].to_numpy(np.int64), rows["_unknown"].to_numpy(bool)
    when = np.fromiter((own.admit(*row) for own, *row in zip(minutes, at.tolist(), tokens.tolist(), unknown.tolist(), strict=False)), np.float64, len(at))
    return pd.DataFrame({"scope": rows["scope"].to_numpy(), "at": at, "tokens": pd.arrays.IntegerArray(tokens, unknown), "admitted": when, "waited": when - at})


def admission_replay(requests: DataFrame, rpm: int, tpm: int) -> DataFrame:
    """The table form of ``admissions``: each scope in the order of its requests (those without a time or tokens last), state of one minute.
    Requests without a scope are left out."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope, own = None, Minute(rpm, tpm)

        def minutes(names: list[str]) -> Iterator[Minute]:
            nonlocal scope, own
            for name in names:
                if name != scope:
                    scope, own = name, Minute(rpm, tpm)
                yield own

        for pdf in batches:
            yield _admitted(pdf, minutes(pdf["scope"].tolist()))

    sorted_rows = _known(requests).where("scope is not null").repartition("scope").sortWithinPartitions("scope", F.asc_nulls_last("at"), "_unknown", "tokens")
    return sorted_rows.mapInPandas(fold, ADMITTED)


def admissions(requests: DataFrame, rpm: int, tpm: int, late: str = "1 hour") -> DataFrame:
    """Stream ``scope, at (seconds), tokens`` to ``scope, at, tokens, admitted, waited``.

    The state of a scope is the minute behind it, at most ``rpm`` rows. It goes when the watermark, ``late`` behind the newest
    request, has passed the minute after its last admission; requests later than that are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = Minute(rpm, tpm, *(state.get if state.exists else ()))
        for pdf in batches:
            yield _admitted(pdf.sort_values(["at", "_unknown", "tokens"]), repeat(own))
        state.update((own.times.tolist(), own.tokens.tolist()))
        if len(own.times):
            state.setTimeoutTimestamp(max(int((own.times[-1] + MINUTE) * 1000), state.getCurrentWatermarkMs() + 1))

    timed = _known(requests).withColumn("_time", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("_time", late)
    return timed.groupBy("scope").applyInPandasWithState(step, ADMITTED, "times array<double>, tokens array<long>", "append", GroupStateTimeout.EventTimeTimeout)


# ---- the adaptive controller ------------------------------------------------------------------------

#: Fixed values of the controller: floors, steps and run lengths.
FLOOR, KEEP_ON_ERROR, KEEP_RPM, BATCH_STEP, RAISE = 512, 0.9, 0.8, 2000, 1.04
RUN, CAREFUL_RUN, FULL = 10, 20, 0.8
RATIO_START, RATIO_LOW, RATIO_HIGH, RATIO_MARGIN, RATIO_DECAY = 1.65, 1.5, 4.0, 1.1, 0.98


def expansion_ratio(events: DataFrame) -> DataFrame:
    """Adds ``ratio``: the assumed output per input after each event of ``scope, at, event, source, output, overhead``.

    A ratio is the largest of its floor, the measured one with a margin, and the one before less a fiftieth. So after n measurements
    it is the maximum over all of them of value times decay to the power of its age: a running maximum of logarithms.
    """
    order = Window.partitionBy("scope").orderBy("at")
    measured = (F.col("event") == "success") & (F.coalesce("source", F.lit(0)) > 0) & (F.coalesce("output", F.lit(0)) > 0)
    seen = F.greatest(F.lit(0), F.col("output") - F.coalesce("overhead", F.lit(0))) / F.col("source")
    value = F.when(measured, F.least(F.lit(RATIO_HIGH), F.greatest(F.lit(RATIO_LOW), seen * RATIO_MARGIN)))
    aged = events.withColumn("_age", F.count(F.when(measured, 1)).over(order)).withColumn("_value", value)
    slope = -float(np.log(RATIO_DECAY))
    best = F.max(F.log("_value") + F.col("_age") * slope).over(order)
    return aged.withColumn("ratio", F.exp(F.greatest(F.coalesce(best, F.lit(0.0)), F.lit(float(np.log(RATIO_START)))) - F.col("_age") * slope)).drop("_age", "_value")


def transitions(s: Column, e: Column, ceiling_tpm: int, ceiling_rpm: int, ceiling_workers: int, max_batch: int, auto_tune: bool) -> dict[str, Column]:
    """The next value of each field of the state ``s`` on an event ``e``, all from the values before."""
    tuned, done = F.lit(auto_tune), e["event"] == "success"
    short, quiet = s["batch_run"] + 1, s["quota_run"] + 1
    eased = done & F.when(s["throttled"], quiet >= CAREFUL_RUN).otherwise(tuned & (quiet >= RUN))
    back = eased & s["throttled"]
    kind = F.coalesce(e["kind"], F.lit("unknown"))
    off_tokens = (e["event"] == "quota") & kind.isin("tpm", "unknown")
    off_requests = (e["event"] == "quota") & kind.isin("rpm", "unknown")
    tpm = F.when(eased, F.least(F.lit(ceiling_tpm), F.ceil(s["tpm"] * RAISE))).when(off_tokens, F.greatest(F.lit(FLOOR), F.floor(s["tpm"] * KEEP_ON_ERROR))).otherwise(s["tpm"])
    rpm = F.when(back, F.least(F.lit(ceiling_rpm), s["rpm"] + 1)).when(off_requests, F.greatest(F.lit(1), F.floor(s["rpm"] * KEEP_RPM))).otherwise(s["rpm"])
    grown = done & (short >= RUN) & tuned & (F.coalesce(e["size"], F.lit(0)) >= s["batch"] * FULL)
    return {
        "tpm": tpm, "rpm": rpm,
        "workers": F.when(back, F.least(F.lit(ceiling_workers), s["workers"] + 1)).when(off_requests, F.greatest(F.lit(1), s["workers"] - 1)).otherwise(s["workers"]),
        "batch": F.when(grown, F.least(F.lit(max_batch), s["batch"] + BATCH_STEP)).when((e["event"] == "invalid") & tuned, F.greatest(F.lit(FLOOR), F.floor(s["batch"] * KEEP_ON_ERROR))).otherwise(s["batch"]),
        "batch_run": F.when(done, short % RUN).otherwise(0),
        "quota_run": F.when(done & ~eased, quiet).otherwise(0),
        "throttled": F.when(e["event"] == "quota", True).when(back, (tpm < ceiling_tpm) | (rpm < ceiling_rpm)).otherwise(s["throttled"]),
    }


def controller_replay(events: DataFrame, ceiling_tpm: int, ceiling_rpm: int, ceiling_workers: int, batch: int, max_batch: int, auto_tune: bool = True) -> DataFrame:
    """``scope, tpm, rpm, workers, batch, ratio`` after all of its ``at, event, kind, source, output, overhead, size`` rows
    (``event``: success, quota or invalid).

    A scope's events are gathered in order: the ledger keeps two days of a key, so their number is bounded by its daily limit.
    """
    fields = {"tpm": ceiling_tpm, "rpm": ceiling_rpm, "workers": ceiling_workers, "batch": batch, "batch_run": 0, "quota_run": 0}
    start = F.struct(*[F.lit(v).cast("long").alias(k) for k, v in fields.items()], F.lit(False).alias("throttled"))

    def step(s: Column, e: Column) -> Column:
        after = transitions(s, e, ceiling_tpm, ceiling_rpm, ceiling_workers, max_batch, auto_tune)
        return F.struct(*[(after[k].cast("long") if k in fields else after[k]).alias(k) for k in (*fields, "throttled")])

    rated = expansion_ratio(events)
    own = rated.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("at", "event", "kind", "size"))).alias("_events"), F.max_by("ratio", "at").alias("ratio"))
    end = own.withColumn("_end", F.aggregate("_events", start, step))
    return end.select("scope", "_end.tpm", "_end.rpm", "_end.workers", "_end.batch", "ratio")


def calibrated(factor: Column, estimated: Column, actual: Column) -> Column:
    """The estimator's factor after one measurement: up at once, down by a tenth of the way."""
    seen = factor * actual / F.greatest(F.lit(1), estimated)
    return F.greatest(F.lit(0.1), F.least(F.lit(10.0), F.greatest(seen, factor * 0.9 + seen * 0.1)))
