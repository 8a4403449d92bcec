"""Structured Streaming jobs. Each takes streaming DataFrames and returns one; `run` replays a bounded stream into a table.

Every stateful step has a watermark or a state bounded by its own rule, and every write is keyed by the batch, so a
restarted batch replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bars import build_bars
from ..session import scratch_path


def run(stream: DataFrame, mode: str = "append", keys: Sequence[str] = (), merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
        out: str | None = None, checkpoint: str | None = None, prune: str | None = None) -> DataFrame:
    """Process everything available and return the resulting table.

    append: all emitted rows; update: the last version of each key; complete: the last result. `merge(batch, stored)` may
    reduce a batch against what other batches stored before it is written under its batch id. With the same `out` and
    `checkpoint` a later run goes on where the last one stopped, and knows what that one stored. `prune` names a column
    by whose range in the batch the stored rows are cut when read.
    """
    spark = stream.sparkSession
    out, checkpoint = out or scratch_path(spark, "stream"), checkpoint or scratch_path(spark, "checkpoint")
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{out}/batch=-1")
    table = lambda: spark.read.schema(stream.schema).parquet(out)  # noqa: E731  with the column `batch` of the folders

    def write(batch: DataFrame, epoch: int) -> None:
        if merge:
            stored = table().filter(F.col("batch") != epoch)
            if prune:
                low, high = batch.agg(F.min(prune), F.max(prune)).first()
                stored = stored.filter(F.col(prune).between(F.lit(low), F.lit(high)))
            batch = merge(batch, stored.drop("batch"))
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    df = table()
    if mode == "complete":
        return df.filter(F.col("batch") == df.agg(F.max("batch").alias("b")).select("b").scalar()).drop("batch")
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
    return df.drop("batch")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counts(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Messages, bullish and bearish per hour, repeated ids counted once; `messages(id, created_at, mood)`."""
    one = messages.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])
    return one.groupBy(F.window("created_at", "1 hour").alias("w")).agg(
        F.count("*").alias("messages"), F.count(F.when(F.col("mood") == "Bullish", 1)).alias("bullish"), F.count(F.when(F.col("mood") == "Bearish", 1)).alias("bearish")
    ).select(F.col("w.start").alias("hour"), "messages", "bullish", "bearish")


def finished_bars(ticks: DataFrame, length: str, delay: str, order) -> DataFrame:
    """OHLCV bars emitted once, after their end plus the feed delay; `ticks(asset, at, price, volume)`."""
    timed = ticks.withWatermark("at", delay).withColumn("w", F.window("at", length))
    return build_bars(timed, ["asset", "w"], order).select("asset", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def rolling_counts(news: DataFrame, length: str = "24 hours", step: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts over sliding windows, per asset."""
    return news.withWatermark("ts", delay).groupBy("asset", F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n")).select("asset", F.col("w.end").alias("until"), "n")


def bursts(events: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Events of an asset closer together than `gap` form one burst."""
    return events.withWatermark("ts", delay).groupBy("asset", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("asset", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def cluster_signals(filings: DataFrame, buyers: int, days: int, delay: str = "1 day") -> DataFrame:
    """The day the number of different buyers in (day - days, day] reaches `buyers`, at most one per `days`.

    A day is judged once the watermark has passed it, so days that come late, out of order or in several batches give
    what one batch over all of them would. State per asset: the different (day, owner) pairs that a day to come can still
    count, and the last signal day; a timer judges days that no new row follows and drops idle assets. Copies collapse
    before the state; `filings(asset, owner, day timestamp)`.
    """
    day_ms = 86_400_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, done = state.get if state.exists else ([], -10**6, -10**6)
        pairs = {tuple(x) for x in seen}
        for batch in batches:
            numbers = pd.to_datetime(batch["day"]).astype("datetime64[s]").astype("int64") // 86400
            pairs.update(zip(numbers.astype(int).tolist(), batch["owner"].astype(int).tolist()))
        mark = state.getCurrentWatermarkMs()
        final = -(-mark // day_ms) - 1  # the newest day that begins before the watermark
        fired = []
        for d in sorted({d for d, _ in pairs if done < d <= final}):
            if d - last > days and len({o for x, o in pairs if d - days < x <= d}) >= buyers:
                fired.append(d)
                last = d
        done = max(done, final)
        pairs = {(x, o) for x, o in pairs if x > done - days}
        if pairs:
            state.update(([list(x) for x in sorted(pairs)], last, done))
            waiting = [x for x, _ in pairs if x > done]
            state.setTimeoutTimestamp(max(mark, min(waiting) * day_ms if waiting else max(x for x, _ in pairs) * day_ms + days * day_ms) + 1)
        else:
            state.remove()
        yield pd.DataFrame({"asset": [key[0]] * len(fired), "day": pd.to_datetime(fired, unit="D").date})

    slim = filings.withWatermark("day", delay).dropDuplicatesWithinWatermark(["asset", "owner", "day"])
    return slim.groupBy("asset").applyInPandasWithState(step, "asset long, day date", "recent array<array<long>>, last long, done long", "append", GroupStateTimeout.EventTimeTimeout)


def touch_alerts(prices: DataFrame, plan: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stop and target levels the price has reached, once per trade and level; `plan(trade, asset, side, stop, target)` is static."""
    df = prices.join(plan, "asset")
    s = F.col("side")
    stop = F.when(s * (F.col("price") - F.col("stop")) <= 0, "stop")
    target = F.when(s * (F.col("price") - F.col("target")) >= 0, "target")
    return df.select("trade", F.coalesce(stop, target).alias("level")).filter("level is not null").dropDuplicates(["trade", "level"])


def alert_throttle(problems: DataFrame, quiet_hours: int = 6, delay: str = "10 minutes") -> DataFrame:
    """The first alert of each problem, again every `quiet_hours` while it lasts, and `over` once it has not been seen for
    that long; `problems(asset, ts)`, result (asset, ts, kind).

    Moments are taken in order once the watermark has passed them, so alerts that arrive late are told like others. State
    per asset: the last alert, the last moment, and the moments that still wait.
    """
    quiet = quiet_hours * 3_600_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen, waiting = state.get if state.exists else (None, None, [])
        waiting = list(waiting)
        for batch in batches:
            waiting.extend(batch["ts"].astype("datetime64[us]").astype("int64").tolist())
        mark = state.getCurrentWatermarkMs() * 1000
        told = []
        for t in sorted(x for x in waiting if x < mark):
            if seen is not None and t - seen >= quiet:
                told.append((seen + quiet, "over"))
            if last is None or t - last >= quiet:
                told.append((t, "alert"))
                last = t
            seen = t
        waiting = sorted(x for x in waiting if x >= mark)
        if seen is not None and seen + quiet <= mark:
            told.append((seen + quiet, "over"))
            seen = last = None
        if seen is None and not waiting:
            state.remove()
        else:
            state.update((last, seen, waiting))
            state.setTimeoutTimestamp(max(mark // 1000, (waiting[0] if waiting else seen + quiet) // 1000) + 1)
        yield pd.DataFrame({"asset": [key[0]] * len(told), "ts": pd.to_datetime([t for t, _ in told], unit="us"), "kind": [k for _, k in told]})

    return problems.withWatermark("ts", delay).groupBy("asset").applyInPandasWithState(step, "asset long, ts timestamp, kind string", "last long, seen long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def first_write_wins(key: Sequence[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Decisions are made once: a batch keeps only keys not decided before (and one row per key)."""
    def merge(batch: DataFrame, stored: DataFrame) -> DataFrame:
        rest = [c for c in batch.columns if c not in key]
        one = batch.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*").select(*batch.columns)
        return one.join(stored.select(*key), list(key), "left_anti")
    return merge


def daily_totals(events: DataFrame, delay: str = "3 days") -> DataFrame:
    """Totals per asset and day that accept rows up to `delay` late; update mode, merged by key."""
    return events.withWatermark("ts", delay).groupBy("asset", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("asset", F.col("w.start").cast("date").alias("day"), "n", "total")


def run_late(events: DataFrame, out: str | None = None, checkpoint: str | None = None, delay_days: int = 3) -> tuple[DataFrame, DataFrame]:
    """(totals, counts) of everything available: totals per asset and day of rows at most `delay_days` late, and per batch
    the rows kept and dropped and the moment from which they were judged. `events(asset, ts, value)`.

    A batch is judged by the newest moment of the batches before it, less the delay: a row is late once its whole day is
    behind that, as in a windowed aggregation, but it is counted instead of vanishing. Each batch writes its own partial
    sums and its own counts under its id, so a batch that is run again replaces both and a restart goes on.
    """
    spark = events.sparkSession
    out, checkpoint = out or scratch_path(spark, "late"), checkpoint or scratch_path(spark, "checkpoint")
    sums, told = "asset long, day date, n long, total double", "kept long, dropped long, mark timestamp, newest timestamp"
    for name, schema in (("totals", sums), ("counts", told)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{out}/{name}/batch=-1")
    table = lambda name, schema: spark.read.schema(schema).parquet(f"{out}/{name}")

    def write(batch: DataFrame, epoch: int) -> None:
        before = table("counts", told).filter(F.col("batch") < epoch).agg(F.max("newest").alias("m")).first().m
        mark = F.lit(before).cast("timestamp") - F.expr(f"interval {delay_days} days")
        ends = F.date_trunc("day", "ts") + F.expr("interval 1 day")
        on_time = F.coalesce(ends > mark, F.lit(True))
        judged = batch.groupBy(F.col("asset"), F.to_date("ts").alias("day"), on_time.alias("kept")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("ts").alias("newest"))
        judged = judged.persist()
        judged.filter("kept").select("asset", "day", "n", "total").write.mode("overwrite").parquet(f"{out}/totals/batch={epoch}")
        counts = judged.agg(F.coalesce(F.sum(F.when(F.col("kept"), F.col("n"))), F.lit(0)).alias("kept"), F.coalesce(F.sum(F.when(~F.col("kept"), F.col("n"))), F.lit(0)).alias("dropped"), mark.alias("mark"), F.max("newest").alias("newest"))
        counts.write.mode("overwrite").parquet(f"{out}/counts/batch={epoch}")
        judged.unpersist()

    events.select("asset", "ts", "value").writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    totals = table("totals", sums).groupBy("asset", "day").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return totals, table("counts", told).filter("batch >= 0").select(F.col("batch").cast("long").alias("batch"), "kept", "dropped", "mark")


def trailing_stops(prices: DataFrame, trail: float) -> DataFrame:
    """Best price and ratcheting stop per asset so far: one number of state per asset, combined before the shuffle."""
    return prices.groupBy("asset").agg(F.max("price").alias("best")).withColumn("stop", F.col("best") - trail)


def trade_stops(prices: DataFrame, trades: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(trade, ts, kind, stop): the stop of every open trade each time it tightens (`move`), and its end once the price has
    reached it (`out`). `prices(asset, ts, seq, price)` is a stream, `trades(trade, asset, side, entry, stop, trail, since)`
    static: the stop follows `trail` behind the best price since the entry and never loosens.

    Prices of a trade are taken in order of (ts, seq) once the watermark has passed them, so what comes late, out of order
    or in several batches gives what one batch over all of it would. State per trade: the best price, the stop, whether it
    is over, and the prices that still wait.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, stop, over, waiting = state.get if state.exists else (None, None, False, [])
        waiting = [tuple(w) for w in waiting]
        for batch in batches:
            times = batch["ts"].astype("datetime64[us]").astype("int64").tolist()
            waiting.extend(zip(times, *(batch[c].tolist() for c in ("seq", "price", "side", "entry", "stop", "trail"))))
        mark = state.getCurrentWatermarkMs() * 1000
        told = []
        for t, _, price, side, entry, first, trail in sorted(w for w in waiting if w[0] < mark):
            if over:
                break
            if stop is None:
                best, stop = side * entry, side * first
            if side * price <= stop:
                told.append((t, "out", side * stop))
                over = True
                break
            best = max(best, side * price)
            if best - trail > stop:
                stop = best - trail
                told.append((t, "move", side * stop))
        waiting = [] if over else sorted(w for w in waiting if w[0] >= mark)
        state.update((best, stop, over, waiting))
        if waiting:
            state.setTimeoutTimestamp(max(mark // 1000, waiting[0][0] // 1000) + 1)
        yield pd.DataFrame({"trade": [key[0]] * len(told), "ts": pd.to_datetime([t for t, _, _ in told], unit="us"), "kind": [k for _, k, _ in told], "stop": [float(x) for _, _, x in told]})

    open_ = prices.withWatermark("ts", delay).join(trades, "asset").filter(F.col("ts") >= F.col("since"))
    slim = open_.select("trade", "ts", "seq", *[F.col(c).cast("double").alias(c) for c in ("price", "side", "entry", "stop", "trail")])
    held = "best double, stop double, over boolean, waiting array<struct<t: long, seq: long, price: double, side: double, entry: double, stop: double, trail: double>>"
    return slim.groupBy("trade").applyInPandasWithState(step, "trade long, ts timestamp, kind string, stop double", held, "append", GroupStateTimeout.EventTimeTimeout)


def match_fills(fills: DataFrame, orders: DataFrame, within: str, delay: str = "2 hours") -> DataFrame:
    """Fills with the orders of their asset made at most `within` before; both sides are streams."""
    f = fills.withWatermark("fill_ts", delay)
    o = orders.withWatermark("order_ts", delay)
    return f.join(o, (f["asset"] == o["order_asset"]) & (F.col("order_ts") <= F.col("fill_ts")) & (F.col("order_ts") >= F.col("fill_ts") - F.expr(f"interval {within}"))).drop("order_asset")


def running_equity(curve: DataFrame) -> DataFrame:
    """Latest and best equity per account."""
    return curve.groupBy("account").agg(F.max_by("equity", "seq").alias("equity"), F.max("equity").alias("best")).withColumn("drawdown", F.col("equity") / F.col("best") - 1)
