"""Feed and service monitoring over trades, API calls, pool metrics and error logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.errors import classify_db_error, classify_feed_error
from tapewright.functions.numbers import strict_double


def search_trades(trades: DataFrame, pattern: str, n: int) -> DataFrame:
    """The newest n trades whose symbol holds a string."""
    return trades.where(F.col("symbol").contains(pattern)).orderBy(F.desc("ts_ms"), F.desc("trade_id")).limit(n)


def trades_by_exchange(trades: DataFrame, symbol: str) -> DataFrame:
    return trades.where(F.col("symbol") == symbol).groupBy("exchange").agg(F.count(F.lit(1)).alias("trades"), F.round(F.avg(strict_double(F.col("price"))), 6).alias("avg_price"))


def recent_activity(trades: DataFrame, since_ms: int) -> DataFrame:
    return (
        trades.where(F.col("ts_ms") >= since_ms).groupBy("exchange", "market_type", "symbol").agg(F.count(F.lit(1)).alias("trades"), F.max("ts_ms").alias("last_ms")).orderBy(F.desc("trades"), "exchange", "market_type", "symbol")
    )


def venue_status(trades: DataFrame, now_ms: int, *, stale_ms: int = 30_000) -> DataFrame:
    """Per exchange: counts and last times by market type, active, stale or none, and the first three symbols."""
    last = lambda kind: F.max(F.when(F.col("market_type") == kind, F.col("ts_ms")))
    state = lambda at: F.when(at.isNull(), "none").when(F.lit(now_ms) - at <= stale_ms, "active").otherwise("stale")
    out = trades.groupBy("exchange").agg(
        F.count_if(F.col("market_type") == "spot").alias("spot_trades"), F.count_if(F.col("market_type") == "futures").alias("futures_trades"),
        last("spot").alias("spot_last_ms"), last("futures").alias("futures_last_ms"), F.array_join(F.slice(F.sort_array(F.collect_set("symbol")), 1, 3), ",").alias("symbols"),
    )
    return out.withColumn("spot_status", state(F.col("spot_last_ms"))).withColumn("futures_status", state(F.col("futures_last_ms")))


def throughput(trades: DataFrame) -> DataFrame:
    """Trades per second over the time they span, per exchange."""
    span = (F.max("ts_ms") - F.min("ts_ms")) / 1000.0
    rate = F.when(span > 0, F.count(F.lit(1)) / F.when(span > 0, span)).otherwise(F.count(F.lit(1)).cast("double"))
    return trades.groupBy("exchange").agg(F.count(F.lit(1)).alias("trades"), F.round(rate, 6).alias("per_second"))


def write_health(processed: Column, failed: Column) -> Column:
    return F.when(failed > processed * 0.1, "warning").otherwise("healthy")


def recent_trades(trades: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; a limit outside 1..1000 is 100."""
    n = limit if limit is not None and 1 <= limit <= 1000 else 100
    return trades.orderBy(F.desc("ts_ms"), F.desc("trade_id")).limit(n)


def recent_listings(listings: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; a limit outside 1..100 is 50."""
    n = limit if limit is not None and 1 <= limit <= 100 else 50
    return listings.orderBy(F.desc("announced_ms"), F.desc("event_id")).limit(n)


def trades_sorted(trades: DataFrame, symbol: str, from_ms: int, to_ms: int) -> DataFrame:
    return trades.where((F.col("symbol") == symbol) & F.col("ts_ms").between(from_ms, to_ms)).orderBy("ts_ms", "trade_id")


def api_metrics(calls: DataFrame, *, key: str = "node") -> DataFrame:
    return calls.groupBy(key).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("success")).alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.min("response_ms").alias("min_ms"), F.max("response_ms").alias("max_ms"),
        F.round(F.avg("response_ms"), 6).alias("avg_ms"), F.count_if(F.col("status") == 0).alias("connection_errors"), F.count_if(F.col("status") >= 500).alias("http_errors"),
        F.count_if(F.col("status") == 408).alias("timeout_errors"),
    )


def error_breakdown(log: DataFrame) -> DataFrame:
    """Messages by exchange, feed severity and database class."""
    return log.groupBy("exchange", classify_feed_error(F.col("message")).alias("severity"), classify_db_error(F.col("message")).alias("db_class")).agg(F.count(F.lit(1)).alias("n"))


def api_hourly(calls: DataFrame, *, key: str = "node", hours: int = 168) -> DataFrame:
    """Per hour [hour, next hour): calls, means, success rate, listings, longest response; the last ``hours`` hours of each key."""
    hour = F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(3_600_000))
    out = calls.groupBy(key, hour.alias("hour_ms")).agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.avg("response_ms"), 4).alias("avg_ms"), F.round(F.count_if(F.col("success")) * 100.0 / F.count(F.lit(1)), 4).alias("success_percent"),
        F.round(F.avg("cpu"), 4).alias("avg_cpu"), F.round(F.avg("memory_mb"), 4).alias("avg_memory_mb"), F.count_if(F.col("new_listing")).alias("listings"), F.max("response_ms").alias("longest_ms"),
    )
    return out.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("hour_ms")))).where(F.col("nth") <= hours).drop("nth")


_MINUTE_MS, _HOUR_MS = 60_000, 3_600_000
#: Horizons of the rolling rate, in minutes.
_HORIZONS = (("success_1m", 1), ("success_5m", 5), ("success_1h", 60))


def rolling_success(calls: DataFrame, *, key: str = "node", include_current: bool = True) -> DataFrame:
    """Success in per cent over the last minute, five minutes and hour of each call (bound excluded); 100 without calls.

    A call of unknown success is a failure; calls without a time see each other only. A call's horizon is what its own minute has had so far and the whole minutes before it, less what has left:
    a call leaves a horizon of n minutes at the same place of the n-th minute after its own. So windows over calls are
    kept within a minute of a key, whatever the horizon, and the minutes before come from one total per key and minute.
    """
    minute = F.floor(F.col("ts_ms") / _MINUTE_MS)
    ok = F.coalesce(F.col("success"), F.lit(False)).cast("int")
    timed = calls.where(F.col("ts_ms").isNotNull())
    totals = timed.groupBy(F.col(key).alias("_key"), minute.alias("_minute")).agg(F.count(F.lit(1)).alias("n"), F.sum(ok).alias("ok"))
    # Totals are windowed within hours, each also seen by the hour after its own.
    hour = F.floor(F.col("_minute") / 60)
    seen = totals.withColumn("seen", F.explode(F.array(F.struct(hour.alias("hour"), F.lit(True).alias("own")), F.struct((hour + 1).alias("hour"), F.lit(False).alias("own")))))
    before = {m: Window.partitionBy("_key", "seen.hour").orderBy("_minute").rangeBetween(-m, -1) for _, m in _HORIZONS}
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("ok"))

    def part(n: Column, ok: Column) -> Column:
        return F.struct(F.coalesce(n, F.lit(0)).cast("bigint").alias("n"), F.coalesce(ok, F.lit(0)).cast("bigint").alias("ok"))

    held = seen.select("_key", "_minute", "seen.own", *[part(F.sum("n").over(w), F.sum("ok").over(w)).alias(f"_past_{m}") for m, w in before.items()]).where("own")
    held = held.select("_key", "_minute", (F.col("_minute") * _MINUTE_MS).alias("_at"), none.alias("_now"), *[f"_past_{m}" for _, m in _HORIZONS])
    one = part(F.lit(1), ok)
    own = calls.select(F.col(key).alias("_key"), minute.alias("_minute"), F.col("ts_ms").alias("_at"), one.alias("_now"), *[none.alias(f"_past_{m}") for _, m in _HORIZONS], F.struct(*calls.columns).alias("_call"))
    gone = timed.select(F.col(key).alias("_key"), one.alias("_one"), F.explode(F.array(*[F.struct(F.lit(m).alias("m"), (F.col("ts_ms") + m * _MINUTE_MS).alias("at")) for _, m in _HORIZONS])).alias("_left"))
    less = part(-F.col("_one.n"), -F.col("_one.ok"))
    gone = gone.select("_key", F.floor(F.col("_left.at") / _MINUTE_MS).alias("_minute"), F.col("_left.at").alias("_at"), none.alias("_now"), *[F.when(F.col("_left.m") == m, less).otherwise(none).alias(f"_past_{m}") for _, m in _HORIZONS])
    rows = own.unionByName(held, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)
    so_far = Window.partitionBy("_key", "_minute").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    earlier = so_far if include_current else Window.partitionBy("_key", "_minute").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)

    def total(what: str, past: str) -> Column:
        return F.coalesce(F.sum(f"_now.{what}").over(earlier), F.lit(0)) + F.sum(f"{past}.{what}").over(so_far)

    out = rows.select("_call", *[total(what, f"_past_{m}").alias(f"_{what}_{m}") for _, m in _HORIZONS for what in ("n", "ok")]).where(F.col("_call").isNotNull())
    rate = lambda m: F.round(F.when(F.col(f"_n_{m}") > 0, F.col(f"_ok_{m}") * 100.0 / F.col(f"_n_{m}")).otherwise(100.0), 4)
    return out.select("_call.*", *[rate(m).alias(name) for name, m in _HORIZONS])


def failure_streak(calls: DataFrame, *, key: str = "node") -> DataFrame:
    """Failures in a row up to each call, 0 at a success.

    Streaks are counted within hours; an hour hands on the failures at its end, one row per key and hour, and
    calls before the first success of an hour add what the hours before hand on.
    """
    rows = calls.withColumn("streak_hour", F.floor(F.col("ts_ms") / _HOUR_MS))
    ok, failed = F.col("success").cast("int"), (~F.col("success")).cast("int")
    w = Window.partitionBy(key, "streak_hour").orderBy("ts_ms", "call_id")
    rows = rows.withColumn("streak_group", F.sum(ok).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "streak_hour", "streak_group").orderBy("ts_ms", "call_id")
    rows = rows.withColumn("streak", F.sum(failed).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.struct("ts_ms", "call_id")
    hours = rows.groupBy(key, "streak_hour").agg(F.max(ok).alias("any_ok"), F.max_by("streak", last).alias("at_end"))
    before = Window.partitionBy(key).orderBy("streak_hour")
    hours = hours.withColumn("run", F.sum("any_ok").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    handed = F.sum("at_end").over(Window.partitionBy(key, "run").orderBy("streak_hour").rowsBetween(Window.unboundedPreceding, 0))
    hours = hours.withColumn("handed", handed).withColumn("carried", F.coalesce(F.lag("handed").over(before), F.lit(0)))
    rows = rows.join(hours.select(key, "streak_hour", "carried"), [key, "streak_hour"])
    streak = F.col("streak") + F.when(F.col("streak_group") == 0, F.col("carried")).otherwise(0)
    return rows.withColumn("streak", streak.cast("bigint")).drop("streak_group", "streak_hour", "carried")


def service_state(calls: DataFrame, *, key: str = "node") -> DataFrame:
    """One row per key with what scores and rules need: means, failures, last success rate, largest memory and cpu of the last call."""
    rolled = failure_streak(rolling_success(calls, key=key), key=key)
    last = F.struct("ts_ms", "call_id")
    return rolled.groupBy(key).agg(
        F.avg("response_ms").alias("avg_ms"), F.count_if(~F.col("success")).alias("failed"), F.count_if(F.col("success")).alias("ok"), F.max_by("success_1m", last).alias("success_1m"),
        F.max_by("streak", last).alias("streak"), F.max_by("cpu", last).alias("cpu"), F.max_by("memory_mb", last).alias("memory_mb"), F.max("ts_ms").alias("last_ms"),
    )


def performance_score(state: DataFrame) -> DataFrame:
    score = (
        100
        - F.when(F.col("avg_ms") > 3000, 20).when(F.col("avg_ms") > 1000, 10).otherwise(0)
        - F.when(F.col("success_1m") < 90, 30).when(F.col("success_1m") < 95, 15).otherwise(0)
        - F.when(F.col("cpu") > 80, 15).otherwise(0)
        - F.when(F.col("memory_mb") > 8000, 15).otherwise(0)
    )
    return state.withColumn("score", F.greatest(score, F.lit(0)).cast("bigint"))


def threshold_alerts(calls: DataFrame, *, key: str = "node", most_ms: float = 5000, most_memory_mb: int = 8000, most_cpu: float = 80, least_success: float = 95) -> DataFrame:
    """One row per call and threshold passed."""
    rolled = rolling_success(calls, key=key)
    alerts = F.array(
        F.when(F.col("response_ms") > most_ms, "response"), F.when(F.col("memory_mb") > most_memory_mb, "memory"), F.when(F.col("cpu") > most_cpu, "cpu"), F.when(F.col("success_1m") < least_success, "success")
    )
    return rolled.select(key, "ts_ms", "call_id", F.explode(F.filter(alerts, lambda a: a.isNotNull())).alias("alert"))


def health_scores(state: DataFrame, now_ms: int) -> DataFrame:
    """Monitor score (streak, last poll, mean delay ``avg_delay_ms``) and system score of each key."""
    monitor = 100 - F.when(F.col("streak") > 3, 30).otherwise(0) - F.when(F.lit(now_ms) - F.col("last_ms") > 30_000, 20).otherwise(0) - F.when(F.col("avg_delay_ms") > 300_000, 25).otherwise(0)
    system = (
        100 - F.when(F.col("avg_ms") > 3000, 20).otherwise(0) - F.when(F.col("failed") > F.floor(F.col("ok") / 10), 30).otherwise(0)
        - F.when(F.col("memory_mb") > 7000, 15).otherwise(0) - F.when(F.col("cpu") > 80, 20).otherwise(0)
    )
    return state.withColumn("monitor_score", monitor.cast("bigint")).withColumn("system_score", F.greatest(system, F.lit(0)).cast("bigint"))


def pool_health(pools: DataFrame, now_ms: int) -> DataFrame:
    """Score in 0..1 of each pool: active share, error rate, activity within ten minutes."""
    share = F.when(F.col("total_workers") > 0, F.col("active_workers") / F.when(F.col("total_workers") > 0, F.col("total_workers"))).otherwise(1.0)
    errors = F.when(F.col("messages") > 0, 1.0 - 0.5 * F.col("errors") / F.when(F.col("messages") > 0, F.col("messages"))).otherwise(1.0)
    fresh = F.when((F.col("last_ms") > 0) & (F.lit(now_ms) - F.col("last_ms") > 600_000), 0.5).otherwise(1.0)
    score = F.least(F.greatest(share * errors * fresh, F.lit(0.0)), F.lit(1.0))
    return pools.withColumn("score", F.round(F.when(F.col("running"), score).otherwise(0.0), 6))


def feed_stats(pools: DataFrame) -> DataFrame:
    return pools.groupBy("exchange").agg(
        F.sum("messages").alias("messages"), F.sum("trades").alias("trades"), F.sum("errors").alias("errors"), F.sum("active_workers").alias("active_workers")
    )


# Kind, name, metric, bound that the metric must pass, likelihood of a cause, what counts as full use for a bottleneck.
RULES = (
    ("cause", "High API Response Time", "avg_ms", 3000.0, 85.0, None),
    ("cause", "Network Connectivity Issues", "streak", 3.0, 70.0, None),
    ("cause", "High Memory Usage", "memory_mb", 6000.0, 60.0, None),
    ("bottleneck", "Memory", "memory_mb", 7000.0, None, 8000.0),
    ("bottleneck", "CPU", "cpu", 80.0, None, 100.0),
)


def bottlenecks_and_causes(state: DataFrame, *, key: str = "node") -> DataFrame:
    """Rules that apply to each key: causes, most likely first, then bottlenecks with their utilization in per cent."""
    rules = state.sparkSession.createDataFrame(RULES, "kind string, name string, metric string, bound double, likelihood double, full double")
    long = state.select(key, F.explode(F.create_map(*[x for m in ("avg_ms", "streak", "memory_mb", "cpu") for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))
    met = long.join(F.broadcast(rules), "metric").where("value > bound")
    out = met.select(key, "kind", "name", F.round("value", 4).alias("value"), "likelihood", F.round(F.col("value") / F.col("full") * 100, 4).alias("utilization"))
    return out.orderBy(key, F.desc("kind"), F.desc("likelihood"))
