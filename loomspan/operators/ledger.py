"""The request ledger: rolling windows, civil days, waits, cooldowns and key choice, replayed over a table
``request_id, scope, sent (timestamp), tokens``.

What looks back a minute is a bucketed interval join: each request is dealt to the minute it falls in and, as history, to the one after. A
minute and its history hold all that its requests look back on, so a scope of any length is spread over its minutes. What looks back to the
start (a budget) is a distributed prefix sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators.ranges import prefix_sums
from loomspan.operators.scans import clamped_scan

WINDOW_US = 60_000_000
KEEP_S = 172_800


def _by_minute(requests: DataFrame) -> DataFrame:
    """Each request twice: ``_minute`` is its own (``_past`` false) or the one after (``_past``)."""
    own = F.floor(F.unix_micros("sent") / WINDOW_US)
    return requests.withColumn("_m", F.explode(F.array(F.struct(own.alias("no"), F.lit(False).alias("past")), F.struct((own + 1).alias("no"), F.lit(True).alias("past"))))).select("*", F.col("_m.no").alias("_minute"), F.col("_m.past").alias("_past")).drop("_m")


def _now(dealt: DataFrame) -> DataFrame:
    return dealt.where(~F.col("_past")).drop("_minute", "_past")


def rolling_usage(requests: DataFrame) -> DataFrame:
    """Adds ``window_requests, window_tokens`` over the sixty seconds up to each request (itself included); one exactly sixty seconds old is out."""
    trailing = Window.partitionBy("scope", "_minute").orderBy(F.unix_micros("sent")).rangeBetween(-(WINDOW_US - 1), 0)
    return _now(_by_minute(requests).withColumns({"window_requests": F.count("*").over(trailing), "window_tokens": F.coalesce(F.sum("tokens").over(trailing), F.lit(0))}))


def usage_at(requests: DataFrame, now: str) -> DataFrame:
    """``scope, requests, tokens`` of the sixty seconds before ``now``."""
    at = F.lit(now).cast("timestamp")
    own = requests.where((F.col("sent") > at - F.expr("INTERVAL 60 SECONDS")) & (F.col("sent") <= at))
    return own.groupBy("scope").agg(F.count("*").alias("requests"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def generation_requests(requests: DataFrame, metrics: DataFrame) -> DataFrame:
    """Requests without metrics, or whose kind is null or ``generate``."""
    kinds = metrics.select("request_id", F.col("kind").alias("_kind"))
    return requests.join(kinds, "request_id", "left").where(F.col("_kind").isNull() | (F.col("_kind") == "generate")).drop("_kind")


def daily_usage(requests: DataFrame) -> DataFrame:
    """``scope, day_start, used`` per US west coast civil day."""
    return requests.groupBy("scope", T.pacific_midnight("sent").alias("day_start")).agg(F.count("*").alias("used"))


def adjusted_usage(daily: DataFrame, corrections: DataFrame) -> DataFrame:
    """``used`` plus the scope's ``offset`` if that was stated for the same day; never below 0."""
    own = corrections.select("scope", F.col("day_start").alias("_day"), F.col("offset").alias("_offset"))
    met = daily.join(own, "scope", "left")
    extra = F.when(F.col("_day") == F.col("day_start"), F.col("_offset")).otherwise(0)
    return met.withColumn("used", F.greatest(F.lit(0), F.col("used") + F.coalesce(extra, F.lit(0)))).drop("_day", "_offset")


def latest(requests: DataFrame) -> DataFrame:
    return requests.groupBy("scope").agg(F.max("sent").alias("latest"))


def rpm_waits(requests: DataFrame, rpm: int) -> DataFrame:
    """Adds ``wait``: seconds that each request would have to wait if at most ``rpm`` may fall in a minute."""
    order = Window.partitionBy("scope", "_minute").orderBy("sent", "request_id")
    gap = (F.unix_micros(F.lag("sent", rpm).over(order)) + WINDOW_US - F.unix_micros("sent")) / 1e6
    return _now(_by_minute(requests).withColumn("wait", F.greatest(F.lit(0.0), F.coalesce(gap, F.lit(0.0)))))


def soft_limit(tokens: str, target: int, hard: int, workers: int):
    """The minute's token limit with a little headroom for what is already packed."""
    margin = F.least(F.lit(target * 0.02), F.col(tokens) * 0.05 * workers)
    return F.least(F.lit(hard), F.greatest(F.col(tokens), F.floor(F.lit(target) + margin)))


def tpm_waits(requests: DataFrame, target: int, hard: int, workers: int = 1) -> DataFrame:
    """Adds ``wait``: seconds until enough of the trailing minute has expired for the request to fit.

    Running sums of tokens say up to which sum the past has to expire; the first request that reaches it decides. That
    search is one more window: sums and wanted sums are sorted together, downwards, and each wanted sum takes the last request seen.
    Requests of the same microsecond count in the order of their ids.
    """
    us, tokens = F.unix_micros("sent"), F.coalesce(F.col("tokens"), F.lit(0))
    order = Window.partitionBy("scope", "_minute").orderBy(us, "request_id")
    old = Window.partitionBy("scope", "_minute").orderBy(us).rangeBetween(Window.unboundedPreceding, -WINDOW_US)
    dealt = _by_minute(requests)
    row = F.struct(*requests.columns).alias("_row")
    summed = dealt.select(row, "scope", "_minute", "_past", us.alias("_us"), F.sum(tokens).over(order).alias("_upto"), tokens.alias("_n"), F.coalesce(F.sum(tokens).over(old), F.lit(0)).alias("_gone"), soft_limit("tokens", target, hard, workers).alias("_soft"), F.lag(us).over(order).alias("_last"))
    wanted = F.col("_upto") - F.col("_soft")
    crowded = (wanted > F.col("_gone")) & (F.col("_last") > F.col("_us") - WINDOW_US)
    alone = crowded & (F.col("_n") > F.col("_soft"))  # fits nowhere: the whole minute before it has to expire
    asked = summed.where(crowded & ~alone & ~F.col("_past"))
    points = summed.select("scope", "_minute", F.col("_upto").alias("_sum"), F.lit(0).alias("_asks"), F.col("_us").alias("_at"), F.lit(None).cast("long").alias("_now"), F.lit(None).cast(summed.schema["_row"].dataType).alias("_row"))
    questions = asked.select("scope", "_minute", wanted.alias("_sum"), F.lit(1).alias("_asks"), F.lit(None).cast("long").alias("_at"), F.col("_us").alias("_now"), "_row")
    down = Window.partitionBy("scope", "_minute").orderBy(F.desc("_sum"), "_asks", F.desc("_at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = points.unionByName(questions).withColumn("_until", F.last("_at", ignorenulls=True).over(down)).where("_asks = 1")
    waits = found.select("_row.*", F.greatest(F.lit(0.0), (F.col("_until") + WINDOW_US - F.col("_now")) / 1e6).alias("wait"))
    whole = F.when(alone, F.greatest(F.lit(0.0), (F.col("_last") + WINDOW_US - F.col("_us")) / 1e6)).otherwise(F.lit(0.0))
    others = summed.where(~F.col("_past")).where(alone | ~F.coalesce(crowded, F.lit(False))).select("_row.*", F.coalesce(whole, F.lit(0.0)).alias("wait"))
    return others.unionByName(waits)


def retained(requests: DataFrame, now: str) -> DataFrame:
    """Requests of the last 48 hours."""
    return requests.where(F.col("sent") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {KEEP_S} SECONDS"))


def kept_metrics(metrics: DataFrame, requests: DataFrame) -> DataFrame:
    """Metrics whose request is still there."""
    return metrics.join(requests.select("request_id"), "request_id", "left_semi")


def orphaned_metrics(metrics: DataFrame, requests: DataFrame) -> DataFrame:
    return metrics.join(requests.select("request_id"), "request_id", "left_anti")


def cooldowns(stated: DataFrame, now: str | None = None) -> DataFrame:
    """``scope, until``: the latest of all stated ends; with ``now``, only those still running."""
    own = stated.groupBy("scope").agg(F.max("until").alias("until"))
    return own if now is None else own.where(F.col("until") > F.lit(now).cast("timestamp"))


def corrected(requests: DataFrame, actual: DataFrame) -> DataFrame:
    """Estimated tokens replaced by the newest actual number (``request_id, version, tokens``)."""
    own = actual.groupBy("request_id").agg(F.max_by("tokens", "version").alias("_actual"))
    return requests.join(own, "request_id", "left").withColumn("tokens", F.coalesce("_actual", "tokens")).drop("_actual")


def session_averages(calls: DataFrame) -> DataFrame:
    """One row over ``kind, success, input, output, actual``: averages over successful generations."""
    good = (F.col("kind") == "generate") & F.col("success")
    return calls.agg(
        F.coalesce(F.avg(F.when(good, F.col("input"))), F.lit(0.0)).alias("avg_input"),
        F.avg(F.when(good, F.col("output"))).alias("avg_output"),
        F.count_if(good & F.col("actual")).alias("measured"),
        F.count_if(F.col("kind") == "count").alias("count_calls"),
    )


def keys_available(keys: DataFrame, daily: DataFrame, limit: int) -> DataFrame:
    """One row: how many keys (``scope``) have quota left."""
    own = keys.join(daily.select("scope", "used"), "scope", "left")
    return own.agg(F.count_if(F.coalesce("used", F.lit(0)) < limit).alias("available"), F.count("*").alias("total"))


def next_key(keys: DataFrame, daily: DataFrame, limit: int, start: int) -> DataFrame:
    """One row ``scope``: the first key with quota left, round robin from ``start``; null if there is none."""
    own = keys.join(daily.select("scope", "used"), "scope", "left")
    turn = F.when(F.coalesce("used", F.lit(0)) < limit, F.pmod(F.col("key_no") - start, F.lit(max(keys.count(), 1))))
    return own.agg(F.min_by("scope", turn).alias("scope"), F.min(turn).alias("turns")).select(F.when(F.col("turns").isNotNull(), F.col("scope")).alias("scope"))


def budget_stop(requests: DataFrame, budget: int) -> DataFrame:
    """Adds ``spent`` (before the request) and ``paused``: the running sum plus this one exceeds the session's budget."""
    own = requests.select("*", F.col("scope").isNull().alias("_none"), F.coalesce("scope", F.lit("")).alias("_name"), F.coalesce("tokens", F.lit(0)).alias("_n"))
    order = [F.col("_none"), F.col("_name"), F.col("sent"), F.col("request_id")]
    return prefix_sums(own, order, {"_n": "spent"}, ["_none", "_name"]).withColumn("paused", F.col("spent") + F.col("tokens") > budget).drop("_none", "_name", "_n")


def api_usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum("requests").alias("requests"))


def stored_state(state: DataFrame, scope: str, key: str) -> DataFrame:
    """``payload`` of one entry of ``scope, key, payload``, as a map of its JSON fields; no row if there is none or it is no object."""
    own = state.where((F.col("scope") == scope) & (F.col("key") == key)).select(F.from_json("payload", "map<string,string>").alias("payload"))
    return own.where("payload is not null").limit(1)


def stored_limits(state: DataFrame, model: str) -> DataFrame:
    """``name, value`` of the daily limits that are kept for a model."""
    return stored_state(state, model, "local-rpd-limits").select(F.explode("payload").alias("name", "value")).select("name", F.try_to_number("value", F.lit("999999999")).cast("long").alias("value"))


def stored_usage(requests: DataFrame, scope: str, now: str) -> DataFrame:
    """One row ``used, resets``: requests of the scope since the last west coast midnight, and the next one."""
    at = F.lit(now).cast("timestamp")
    since = requests.where((F.col("scope") == scope) & (F.col("sent") >= T.pacific_midnight(at)) & (F.col("sent") <= at))
    return since.agg(F.count("*").alias("used")).withColumn("resets", T.pacific_midnight(at, 1))


def exhausted(daily: DataFrame, scope: str, limit: int) -> DataFrame:
    """``scope, used`` after a key was refused for the day: it counts as used up."""
    own = daily.select("scope", "used")
    others = own.where(F.col("scope") != scope)
    mine = own.where(F.col("scope") == scope).agg(F.greatest(F.lit(limit), F.coalesce(F.max("used"), F.lit(0))).cast("long").alias("used"))
    return others.unionByName(mine.select(F.lit(scope).alias("scope"), "used"))


def append(requests: DataFrame, fresh: DataFrame) -> DataFrame:
    """The ledger with new requests; an id that is there already is not written twice."""
    return requests.unionByName(fresh.join(requests.select("request_id"), "request_id", "left_anti").select(*requests.columns))


#: Fixed values of the estimator: bounds of its factor, and the share of a downward correction.
FACTOR_LOW, FACTOR_HIGH, DOWNWARD = 0.1, 10.0, 0.1


def calibration(measured: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """Adds ``factor``, the estimator's factor after each measurement of ``scope, at, raw, actual`` (``at`` without ties within a scope).

    A scope's first measurement sets the factor; later ones raise it at once and lower it by a tenth of the way. A measurement without a positive
    ``actual`` changes nothing (before the first one, ``factor`` is 1). ``saved`` (``scope, factor``): where a scope goes on from.
    """
    seen = F.when((F.coalesce("actual", F.lit(0)) > 0) & (F.col("raw") > 0), F.col("actual") / F.col("raw"))
    own = measured.select("*", F.col("scope").isNull().alias("_none"), F.coalesce("scope", F.lit("")).alias("_name"), seen.alias("_seen"))
    firsts = own.groupBy("_none", "_name").agg(F.min("at").alias("_opens"), F.min(F.when(F.col("_seen").isNotNull(), F.col("at"))).alias("_first"))
    if saved is not None:
        firsts = firsts.join(saved.select(F.col("scope").isNull().alias("_none"), F.coalesce("scope", F.lit("")).alias("_name"), F.col("factor").alias("_saved")), ["_none", "_name"], "left")
    else:
        firsts = firsts.withColumn("_saved", F.lit(None).cast("double"))
    met = own.join(firsts, ["_none", "_name"])
    sets = F.col("_seen").isNotNull() & (F.col("at") == F.col("_first")) & F.col("_saved").isNull()
    opens = F.col("at") == F.col("_opens")
    bounded = F.least(F.lit(FACTOR_HIGH), F.greatest(F.lit(FACTOR_LOW), F.col("_seen")))
    before = F.coalesce("_saved", F.lit(1.0))
    # the first row of a scope is a constant: what is before it belongs to another scope
    after_first = F.when(F.col("_seen").isNull(), before).otherwise(F.least(F.lit(FACTOR_HIGH), F.greatest(bounded, before * (1 - DOWNWARD) + F.col("_seen") * DOWNWARD)))
    constant = F.when(sets, bounded).when(opens, after_first)
    inf = F.lit(float("1e300"))
    steps = met.select(
        *measured.columns, "_none", "_name",
        F.when(constant.isNotNull(), 0.0).when(F.col("_seen").isNull(), 1.0).otherwise(1 - DOWNWARD).alias("_slope"), F.coalesce(constant, F.col("_seen") * DOWNWARD, F.lit(0.0)).alias("_offset"),
        F.coalesce(constant, bounded, -inf).alias("_low"), F.when(constant.isNotNull(), constant).when(F.col("_seen").isNull(), inf).otherwise(F.lit(FACTOR_HIGH)).alias("_high"),
    )
    return clamped_scan(steps, [F.col("_none"), F.col("_name"), F.col("at")], "factor", 1.0).drop("_none", "_name")
