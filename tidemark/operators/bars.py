"""Cleaning, resampling and calendars."""

from __future__ import annotations

import datetime as dt

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import next_at_or_after
from ..functions.windows import own

NEW_YORK = "America/New_York"


def build_bars(ticks: DataFrame, by: Sequence[str], order: Column) -> DataFrame:
    """OHLCV bars from priced observations (`price`, `volume`). `order` is one number, total up to equal prices: a
    fixed-width key keeps the aggregation hash-based and combined before the shuffle, however hot an asset is."""
    return ticks.groupBy(*by).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))


def resample(bars: DataFrame, length: str) -> DataFrame:
    """Longer bars from shorter ones (`length` such as '1 hour'), labelled by their start."""
    return bars.groupBy("asset", F.window("ts", length).alias("w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).select("asset", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def tick_bars(ticks: DataFrame, length: str, order: Column) -> DataFrame:
    """Bars of any length straight from observations at `at`."""
    return build_bars(ticks.withColumn("ts", F.window("at", length)["start"]), ["asset", "ts"], order)


def validate_bars(raw: DataFrame, order: Sequence[str], max_gap_days: int = 5) -> DataFrame:
    """Last duplicate per session, only positive prices, high/low made consistent, volume 0 when missing;
    `gap_days` reports a pause longer than `max_gap_days`."""
    ohlc = ["open", "high", "low", "close"]
    last = raw.groupBy("asset", "ts").agg(F.max(F.struct(*order, *ohlc, "volume")).alias("r"))
    good = last.select("asset", "ts", *[F.col(f"r.{c}").alias(c) for c in ohlc], F.coalesce("r.volume", F.lit(0.0)).alias("volume"))
    good = good.filter(" and ".join(f"{c} > 0" for c in ohlc))
    pause = F.datediff("ts", F.lag("ts").over(own()))
    return good.select("asset", "ts", "open", F.greatest(*ohlc).alias("high"), F.least(*ohlc).alias("low"), "close", "volume",
                       F.when(pause > max_gap_days, pause).alias("gap_days"))


def new_york(ts: str | Column = "ts") -> Column:
    return F.from_utc_timestamp(ts, NEW_YORK)


def minute_of_day(local: Column) -> Column:
    return F.hour(local) * 60 + F.minute(local)


def regular_session_hours(bars: DataFrame) -> DataFrame:
    """Clock-hour bars from half-hour bars that start inside 9:30-16:00 New York."""
    m = minute_of_day(new_york())
    return resample(bars.filter((m >= 570) & (m < 960)), "1 hour")


def complete_bars(bars: DataFrame, now: DataFrame, length_hours: Column) -> DataFrame:
    """Bars already closed at the single moment in `now.now`."""
    return bars.filter(F.col("ts") + F.make_interval(hours=length_hours) <= now.select("now").scalar())


def session_number(bars: DataFrame) -> DataFrame:
    """Trading day (New York date) and number of the bar within it, from 0."""
    day = bars.withColumn("day", new_york().cast("date"))
    return day.withColumn("k", F.row_number().over(own(["asset", "day"])) - 1)


def last_bar_of_session(bars: DataFrame) -> DataFrame:
    day = new_york().cast("date")
    return bars.withColumn("is_last", F.col("ts") == F.max("ts").over(Window.partitionBy("asset", day)))


def week_ends(cal: DataFrame) -> DataFrame:
    """Last session of every week that ends on Friday."""
    friday = F.next_day(F.date_sub("ts", 1), "FRI")
    return cal.groupBy(friday.alias("week")).agg(F.max("ts").alias("ts"))


def month_ends(cal: DataFrame) -> DataFrame:
    """Last session of every month that a later session proves finished."""
    nxt = F.lead("ts").over(Window.orderBy("ts"))  # one row per session
    return cal.select("ts", nxt.alias("_n")).filter(F.trunc("ts", "month") != F.trunc("_n", "month")).select("ts")


def mark_month_ends(panel: DataFrame) -> DataFrame:
    """Flag each bar whose session is the last of its month in the shared calendar (the final session counts)."""
    last = panel.groupBy(F.trunc("ts", "month").alias("_m")).agg(F.max("ts").alias("_last"))
    return panel.withColumn("_m", F.trunc("ts", "month")).join(last, "_m").withColumn(
        "month_end", F.col("ts") == F.col("_last")).drop("_m", "_last")


def closing_bars(bars: DataFrame, data_end: DataFrame, n: int, back_short: int = 20, back_long: int = 250,
                 floor: float = 0.01) -> DataFrame:
    """Flat zero-volume weekday bars after a series ends: at the last price, or at `floor` for a failed company (under
    1, or at most 60% of `back_short` bars and 30% of `back_long` bars (else the first bar) before the last)."""
    w = own()
    tail = bars.withColumn("_short", F.lag("close", back_short).over(w)).withColumn(
        "_long", F.coalesce(F.lag("close", back_long).over(w), F.first("close").over(w)))
    last = tail.groupBy("asset").agg(F.max_by(F.struct("ts", "close", "_short", "_long"), "ts").alias("r")).select("asset", "r.*")
    failed = (F.col("close") < 1) | ((F.col("close") <= 0.6 * F.col("_short")) & (F.col("close") <= 0.3 * F.col("_long")))
    price = F.when(failed, floor).otherwise(F.col("close"))
    days = F.slice(F.filter(F.sequence(F.date_add("ts", 1), F.date_add("ts", 2 * n + 4)), lambda d: F.weekday(d) < 5), 1, n)
    return (last.select("asset", price.alias("price"), F.explode(days).alias("ts")).filter(F.col("ts") <= data_end.select("data_end").scalar())
            .select("asset", "ts", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], F.lit(0.0).alias("volume")))


def retired(bars: DataFrame, cal: DataFrame, quiet: int = 5) -> DataFrame:
    """Assets without a bar on the last `quiet` shared sessions: one blocked flat bar for each of those sessions."""
    recent = cal.orderBy(F.desc("ts")).limit(quiet)
    last = bars.groupBy("asset").agg(F.max("ts").alias("last_ts"), F.max_by("close", "ts").alias("price"))
    days = recent.agg(F.sort_array(F.collect_list("ts")).alias("d")).select("d")  # `quiet` dates
    gone = last.filter(F.col("last_ts") < recent.agg(F.min("ts").alias("since")).select("since").scalar())
    open_days = F.filter("_days", lambda d: d > F.col("last_ts"))
    return gone.withColumn("_days", days.scalar()).withColumn("ts", F.explode(open_days)).select("asset", "ts", "price", F.lit(True).alias("blocked"))


def next_bar(last: DataFrame, sessions: DataFrame, bar_minutes: int = 60) -> DataFrame:
    """Start of the bar after `last`: inside the same session when one still fits, else the next session's first bar."""
    step = F.make_interval(mins=F.lit(bar_minutes))
    today = sessions.select("day", "open_utc", "close_utc")
    nxt = last.withColumn("day", new_york("last").cast("date"))
    inside = nxt.join(today, "day", "left").withColumn("_cand", F.date_trunc("hour", F.col("last")) + step)
    inside = inside.withColumn("_in", F.when(F.col("_cand") < F.col("close_utc"), F.greatest("_cand", "open_utc")))
    opens = sessions.select(F.col("open_utc"))
    days = inside.select("last").distinct().withColumn("all", F.lit(1))
    after = next_at_or_after(days, opens.select(F.lit(1).alias("all"), "open_utc"), ["all"], "last", "open_utc", "_next", strict=True)
    return inside.join(after.select("last", "_next"), "last", "left").select(
        *last.columns, F.date_trunc("hour", F.coalesce("_in", "_next")).alias("next_start"))


def first_fridays(days: DataFrame) -> DataFrame:
    """First Friday of each month between the first and the last day."""
    span = days.agg(F.trunc(F.min("day"), "month").alias("a"), F.max("day").alias("b"))
    months = span.select("b", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("m"))
    friday = F.next_day(F.date_sub("m", 1), "FRI")
    return months.select(friday.alias("day"), "b").filter("day <= b").select("day")


def quarter_sequence(days: DataFrame) -> DataFrame:
    span = days.agg(F.trunc(F.min("day"), "quarter").alias("a"), F.max("day").alias("b"))
    return span.select(F.explode(F.expr("sequence(a, b, interval 3 months)")).alias("quarter"))


def days_to_next(bar_days: DataFrame, events: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """Days from each bar's day to the next event on or after it; null when none is scheduled."""
    return next_at_or_after(bar_days, events.distinct(), by, "day", "event", "_next").select(
        *bar_days.columns, F.datediff("_next", "day").alias(out))


def session_table(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Open and close (UTC) of every weekday that is no holiday, 9:30-16:00 New York."""
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    all_days = span.select(F.explode(F.sequence("a", "b")).alias("day")).filter(F.weekday("day") < 5)
    open_ = F.col("day").cast("timestamp") + F.expr("interval 9 hours 30 minutes")
    close = F.col("day").cast("timestamp") + F.expr("interval 16 hours")
    return all_days.join(holidays, "day", "left_anti").select(
        "day", F.to_utc_timestamp(open_, NEW_YORK).alias("open_utc"), F.to_utc_timestamp(close, NEW_YORK).alias("close_utc"))


def year_end_holidays(days: DataFrame) -> DataFrame:
    """1 January, 4 July and 25 December of every year: the rule used where no holiday list is given."""
    span = days.agg(F.year(F.min("day")).alias("a"), F.year(F.max("day")).alias("b"))
    y = span.select(F.explode(F.sequence("a", "b")).alias("y"))
    return y.select(F.explode(F.array(*[F.make_date("y", F.lit(m), F.lit(d)) for m, d in ((1, 1), (7, 4), (12, 25))])).alias("day"))


def align_to_calendar(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """Each asset's close on every session of the calendar from its first bar on one of them, carried forward. Sessions
    are numbered (a row per session) and met by number."""
    days = cal.select("ts").distinct().withColumn("sno", F.row_number().over(Window.orderBy("ts")))
    first = bars.join(days, "ts").groupBy("asset").agg(F.min("sno").alias("_first"))
    last = days.agg(F.max("sno").alias("n")).select("n").scalar()
    grid = first.withColumn("sno", F.explode(F.sequence("_first", last))).join(days, "sno").select("asset", "ts")
    w = own().rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(bars.select("asset", "ts", "close"), ["asset", "ts"], "left").withColumn(
        "close", F.last("close", ignorenulls=True).over(w))


def forming_bar(bars: DataFrame, now: Column) -> DataFrame:
    """One flat zero-volume bar per asset at its last close."""
    last = bars.groupBy("asset").agg(F.max_by("close", "ts").alias("c"))
    return last.select("asset", now.alias("ts"), *[F.col("c").alias(n) for n in ("open", "high", "low", "close")], F.lit(0.0).alias("volume"))


def bars_per_year(bars: DataFrame) -> DataFrame:
    years = (F.max("ts").cast("timestamp").cast("long") - F.min("ts").cast("timestamp").cast("long")) / (365.25 * 86400)
    return bars.groupBy("asset").agg((F.count("*") / F.when(years > 0, years)).alias("bars_per_year"))


def event_blackout(bars: DataFrame, events: DataFrame, max_back_days: int = 4) -> DataFrame:
    """Bars of a report day, and the last bar of the session before it when that is at most `max_back_days` back.

    `events(asset, day)`; bars carry their New York day. Flags are computed per session, then joined to the bars.
    """
    day = bars.withColumn("day", new_york().cast("date"))
    sess = day.groupBy("asset", "day").agg(F.max("ts").alias("_last"))
    ev = events.select("asset", F.col("day").alias("event")).distinct()
    nxt = next_at_or_after(sess, ev, ["asset"], "day", "event", "_event")
    following = F.lead("day").over(Window.partitionBy("asset").orderBy("day"))
    flags = nxt.withColumn("_nextday", following).select(
        "asset", "day", "_last", (F.col("_event") == F.col("day")).alias("_is"),
        F.lead("_event").over(Window.partitionBy("asset").orderBy("day")).alias("_ev2"), "_nextday", "_event")
    upcoming = F.when(F.col("_event") == F.col("day"), F.col("_ev2")).otherwise(F.col("_event"))
    before = (F.datediff(upcoming, "day").between(1, max_back_days)) & (F.coalesce(F.col("_nextday") >= upcoming, F.lit(True)))
    flags = flags.select("asset", "day", "_last", F.coalesce("_is", F.lit(False)).alias("_is"), F.coalesce(before, F.lit(False)).alias("_before"))
    return day.join(flags, ["asset", "day"]).select(
        *bars.columns, (F.col("_is") | (F.col("_before") & (F.col("ts") == F.col("_last")))).alias("blocked"))


def market_holidays(first: int, last: int) -> list[dt.date]:
    """Weekday closings of the New York exchange in these years: fixed days moved off a weekend, Mondays and Thursdays of
    their months, and Good Friday."""
    def nth(year: int, month: int, weekday: int, n: int) -> dt.date:
        day = dt.date(year, month, 1)
        return day + dt.timedelta((weekday - day.weekday()) % 7 + 7 * (n - 1))

    def observed(day: dt.date) -> dt.date:
        return day + dt.timedelta({5: -1, 6: 1}.get(day.weekday(), 0))

    def easter(year: int) -> dt.date:
        golden, century = year % 19, year // 100
        epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
        moon = epact - (epact // 28) * (1 - (29 // (epact + 1)) * ((21 - golden) // 11))
        back = moon - (year + year // 4 + moon + 2 - century + century // 4) % 7
        return dt.date(year, 3, 28) + dt.timedelta(back)

    days = []
    for y in range(first, last + 1):
        may31 = dt.date(y, 5, 31)
        days += [observed(dt.date(y, 1, 1)), nth(y, 1, 0, 3), nth(y, 2, 0, 3), easter(y) - dt.timedelta(2), may31 - dt.timedelta(may31.weekday()), observed(dt.date(y, 7, 4)), nth(y, 9, 0, 1), nth(y, 11, 3, 4), observed(dt.date(y, 12, 25))]
        days += [observed(dt.date(y, 6, 19))] if y >= 2021 else []
    return sorted(days)


def _trading_days_between(first: Column, last: Column, holidays: Sequence[dt.date]) -> Column:
    """Weekdays strictly between two days, a few days apart, that are no holidays."""
    days = F.filter(F.sequence(F.date_add(first, 1), last), lambda d: (d < last) & (F.weekday(d) < 5))
    return F.size(F.array_except(days, F.array(*[F.lit(h) for h in holidays]).cast("array<date>")))


def blackout(bars: DataFrame, classes: DataFrame, earnings: DataFrame, fed: DataFrame, jobs: DataFrame, holidays: Sequence[dt.date] = (), back: int = 4) -> DataFrame:
    """(asset, ts, blocked): intraday bars to be flat through, as a scheduled event can gap the price through a stop.

    Reports (stocks): the whole New York day, and the last bar of the session before. Fed decisions (all): from 13 to 16
    o'clock. Jobs reports: of stocks the last bar of the session before, of others the bar of 8 o'clock. The session before
    is the asset's last one within `back` days; its newest session counts only if no trading day lies between, and as it
    may still be going on, its last bar is that of 15 o'clock.

    `bars(asset, ts)` in UTC, `classes(asset, stock)`, `earnings(asset, day)`, `fed(day)`, `jobs(day)`. All calendars meet
    in one table with a row per asset and session, which bars join by asset and day.
    """
    at = bars.select("asset", "ts", new_york().cast("date").alias("day"), F.hour(new_york()).alias("_hour"))
    sess = at.groupBy("asset", "day").agg(F.max("ts").alias("_last")).join(classes.select("asset", "stock"), "asset", "left")
    sess = sess.withColumns({"_next": F.lead("day").over(Window.partitionBy("asset").orderBy("day")), "stock": F.coalesce("stock", F.lit(False))})
    reports = earnings.select("asset", "day").distinct().withColumn("_report", F.lit(True))
    days = fed.select("day", F.lit(True).alias("_fed")).unionByName(jobs.select("day", F.lit(True).alias("_jobs")), allowMissingColumns=True)
    days = days.groupBy("day").agg(F.bool_or("_fed").alias("_fed"), F.bool_or("_jobs").alias("_jobs"))
    today = sess.join(reports, ["asset", "day"], "left").join(days, "day", "left")
    # the days after a session up to the asset's next one, each of which it may be the session before of
    ahead = sess.filter("stock").withColumn("_event", F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", back)))).filter(F.coalesce(F.col("_event") <= F.col("_next"), _trading_days_between(F.col("day"), F.col("_event"), holidays) == 0))
    ahead = ahead.join(reports.withColumnRenamed("day", "_event"), ["asset", "_event"], "left").join(days.select(F.col("day").alias("_event"), "_jobs"), "_event", "left")
    ahead = ahead.filter("_report or _jobs").select("asset", "day", F.lit(True).alias("_before")).distinct()
    flags = today.join(ahead, ["asset", "day"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    last_bar = F.when(F.col("_next").isNotNull(), F.col("ts") == F.col("_last")).otherwise(F.col("_hour") == 15)
    blocked = (F.col("stock") & yes("_report")) | (yes("_fed") & F.col("_hour").between(13, 15)) | (yes("_before") & last_bar) | (~F.col("stock") & yes("_jobs") & (F.col("_hour") == 8))
    return at.join(flags, ["asset", "day"]).select("asset", "ts", blocked.alias("blocked"))


def next_bar_blocked(bars: DataFrame, classes: DataFrame, earnings: DataFrame, fed: DataFrame, jobs: DataFrame, holidays: Sequence[dt.date] = ()) -> DataFrame:
    """(asset, ts, blocked): whether the hour after each asset's newest bar is an event bar, so that a live account is flat
    before it begins. For stocks only within the session; the first bar of the next one is the rule of the last bar before."""
    newest = bars.groupBy("asset").agg((F.max(F.col("ts").cast("timestamp")) + F.expr("interval 1 hour")).alias("ts"))
    both = bars.select("asset", F.col("ts").cast("timestamp").alias("ts")).unionByName(newest)
    df = blackout(both, classes, earnings, fed, jobs, holidays).join(newest, ["asset", "ts"]).join(classes.select("asset", "stock"), "asset", "left")
    over = F.coalesce("stock", F.lit(False)) & (F.hour(new_york()) > 15)
    return df.select("asset", "ts", (F.col("blocked") & ~over).alias("blocked"))
