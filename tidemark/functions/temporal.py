"""As-of joins, trailing aggregates, greedy de-duplication: the point-in-time backbone.

Bounds are part of every call: `strict=True` reads what was known before a moment, `strict=False` also what became
known at it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    values: Sequence[str],
    *,
    strict: bool,
    slice_unit: str = "MONTH",
) -> DataFrame:
    """Each left row with the newest right row of its key (`values` and `right_on`; null when none is known).

    Right rows at one moment are ordered by their values. See `asof_join_many` for the plan.
    """
    series = {"_known": (right, right_on, list(values))}
    joined = asof_join_many(left, series, by, left_on, strict=strict, slice_unit=slice_unit)
    return joined.select(*[c for c in joined.columns if c != "_known"], F.col(f"_known.{right_on}").alias(right_on),
                         *[F.col(f"_known.{v}").alias(v) for v in values])


def asof_join_many(left: DataFrame, series: dict[str, tuple[DataFrame, str, list[str]]], by: Sequence[str], left_on: str, *,
                   strict: bool, slice_unit: str = "MONTH") -> DataFrame:
    """Each left row with the newest row of several right series, `name: (rows, moment column, values)`, one struct each.

    All sides are laid on one timeline and cut into (key, time slice) partitions, so a key with a third of all rows is
    spread over many tasks; what was known at the end of earlier slices is carried in from one summary row each. Any
    number of series costs one window and one summary, and the left side is read twice however many there are.
    """
    by = list(by)
    payload = [c for c in left.columns if c not in by]
    line = left.select(*by, F.col(left_on).cast("timestamp").alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*payload).alias("_row"))
    for name, (right, right_on, values) in series.items():
        known = F.struct(F.col(right_on), *[F.col(v) for v in values])
        line = line.unionByName(right.filter(F.col(right_on).isNotNull()).select(
            *by, F.col(right_on).cast("timestamp").alias("_t"), F.lit(1 if strict else 0).alias("_side"), known.alias(name)), allowMissingColumns=True)
    line = line.withColumn("_slice", F.date_trunc(slice_unit, "_t"))
    ends = line.groupBy(*by, "_slice").agg(*[F.max(n).alias(n) for n in series])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*by, "_slice", *[F.max(n).over(before).alias(f"_carry_{n}") for n in series])
    inside = Window.partitionBy(*by, "_slice").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = line.withColumns({n: F.max(n).over(inside) for n in series}).filter(F.col("_row").isNotNull())
    return seen.join(carry, [*by, "_slice"], "left").select(*by, "_row.*", *[F.coalesce(n, f"_carry_{n}").alias(n) for n in series])


def asof_bars(bars: DataFrame, series: dict[str, tuple[DataFrame, str, list[str]]], by: Sequence[str], left_on: str, *, strict: bool) -> DataFrame:
    """`asof_join_many` for rows that are bars and series of periods: a key holds no more of either than the calendar has, so one
    window per key does, and neither the slices' ends nor the carried rows are made, shuffled and joined."""
    by = list(by)
    payload = [c for c in bars.columns if c not in [*by, left_on]]
    kind = dict(bars.dtypes)[left_on]
    line = bars.select(*by, F.col(left_on).alias("_t"), F.lit(0 if strict else 1).cast("byte").alias("_side"), *payload, F.lit(True).alias("_bar"))
    for name, (right, right_on, values) in series.items():
        known = F.struct(F.col(right_on), *[F.col(v) for v in values])
        line = line.unionByName(right.filter(F.col(right_on).isNotNull()).select(
            *by, F.col(right_on).cast(kind).alias("_t"), F.lit(1 if strict else 0).cast("byte").alias("_side"), known.alias(name)), allowMissingColumns=True)
    upto = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumns({n: F.max(n).over(upto) for n in series}).filter("_bar").select(*by, F.col("_t").alias(left_on), *payload, *series)


def next_at_or_after(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, out: str,
                     *, strict: bool = False) -> DataFrame:
    """Each left row with the first right moment of its key at or after its own (after it, when strict).

    Both sides must be bounded per key (event days, calendar sessions), which every caller ensures by de-duplicating.
    """
    by = list(by)
    payload = [c for c in left.columns if c not in by]
    l = left.select(*by, F.col(left_on).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.struct(*payload).alias("_row"))
    r = right.select(*by, F.col(right_on).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.col(right_on).alias("_next"))
    # from the last moment back: a frame that only grows is carried on, one that only shrinks is added up anew for each row
    ahead = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(
        Window.unboundedPreceding, 0)
    return (l.unionByName(r, allowMissingColumns=True).withColumn("_next", F.min("_next").over(ahead))
            .filter(F.col("_row").isNotNull()).select(*by, "_row.*", F.col("_next").alias(out)))


def on_session(events: DataFrame, bars: DataFrame, day: str = "day", by: str = "asset", out: str = "ts") -> DataFrame:
    """Move dated events to the first session of their own asset at or after them; drop those past its last bar."""
    grid = bars.select(by, F.col("ts").alias("_session"))
    return next_at_or_after(events, grid, [by], day, "_session", out).filter(F.col(out).isNotNull())


def flag_session(bars: DataFrame, events: DataFrame, out: str, day: str = "day", by: str = "asset") -> DataFrame:
    """Bars with a flag on the first session of their asset at or after an event's day: what `on_session` finds, decided in the
    shuffle by asset that the windows on bars need anyway, without a join. An asset's bars are never more than its calendar."""
    line = bars.withColumn("_event", F.lit(None).cast("date")).unionByName(
        events.filter(F.col(day).isNotNull()).select(by, F.col(day).alias("ts"), F.col(day).alias("_event")), allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy("ts", F.col("_event").isNull())  # an event comes before the bar of its own day
    event = F.max("_event").over(order.rowsBetween(Window.unboundedPreceding, 0))
    bar = F.max(F.when(F.col("_event").isNull(), F.col("ts"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    line = line.withColumns({"_last": event, "_bar": bar}).filter("_event is null")
    return line.withColumn(out, F.coalesce(F.col("_bar").isNull() & F.col("_last").isNotNull() | (F.col("_last") > F.col("_bar")), F.lit(False))).drop("_event", "_last", "_bar")


def gap_filter(df: DataFrame, by: Sequence[str], at: str, gap: int) -> DataFrame:
    """Keep a moment only when it is more than `gap` units after the last kept one (dates: days; integers: steps).

    One array per key, of distinct days: never longer than the calendar. Only the last kept day is carried.
    """
    by = list(by)
    is_date = dict(df.dtypes)[at] == "date"

    kind = dict(df.dtypes)[at]

    def far(last: Column, x: Column) -> Column:
        return last.isNull() | (F.datediff(x, last) > gap if is_date else x - last > gap)

    kept = pick(F.col("_all"), F.lit(None).cast(kind), far, lambda x: x, lambda x: x, kind)
    return df.groupBy(*by).agg(F.sort_array(F.collect_set(at)).alias("_all")).select(*by, F.explode(kept).alias(at))


def pick(items: Column, start: Column, takes, after, value, kind: str) -> Column:
    """Walk an array and keep `value(x)` of each x that `takes(state, x)`, the state then being `after(x)`.

    Appending copies an array, so what is kept is gathered in blocks of the square root of the length: k^1.5 copied
    elements instead of k^2. The array must not be empty, as lists of a group never are.
    """
    empty = F.expr(f"cast(array() as array<{kind}>)")
    size = F.ceil(F.sqrt(F.size(items))).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.size(items), size), lambda i: F.slice(items, i, size))
    one = lambda acc, x: F.when(takes(acc["state"], x), F.struct(after(x).alias("state"), F.concat(acc["kept"], F.array(value(x))).alias("kept"))).otherwise(acc)
    walk = lambda block, state: F.aggregate(block, F.struct(state.alias("state"), empty.alias("kept")), one)

    def join(acc: Column, block: Column) -> Column:
        done = walk(block, acc["state"])
        return F.struct(done["state"].alias("state"), F.concat(acc["kept"], done["kept"]).alias("kept"))

    return F.aggregate(blocks, F.struct(start.alias("state"), empty.alias("kept")), join)["kept"]


def trailing_distinct(events: DataFrame, by: Sequence[str], who: str, day: str, days: int,
                      grid: DataFrame | None = None, out: str = "n") -> DataFrame:
    """How many different `who` had an event in (d - days, d], at every event day d (or every day of `grid`).

    Instead of a set per window: each (key, who) covers the union of its intervals [event, event + days); the ends of
    those intervals are summed per day and accumulated. No task sees more than one `who`'s days or one key's calendar.
    """
    by = list(by)
    each = Window.partitionBy(*by, who).orderBy("_d")
    d = events.filter(F.col(who).isNotNull()).select(*by, who, F.unix_date(day).alias("_d")).distinct()
    d = d.select(*by, "_d", F.lag("_d").over(each).alias("_prev"), F.lead("_d").over(each).alias("_next"))
    starts = F.when(F.col("_prev").isNull() | (F.col("_d") - F.col("_prev") >= days), 1).otherwise(0)
    stops = F.when(F.col("_next").isNull() | (F.col("_next") - F.col("_d") >= days), -1).otherwise(0)
    steps = d.select(*by, F.explode(F.array(
        F.struct(F.col("_d").alias("at"), starts.alias("step"), F.lit(grid is None).alias("asked")),
        F.struct((F.col("_d") + days).alias("at"), stops.alias("step"), F.lit(False).alias("asked")))).alias("e")
    ).select(*by, "e.*")
    if grid is not None:
        steps = steps.unionByName(grid.select(*by, F.unix_date(day).alias("at"), F.lit(0).alias("step"), F.lit(True).alias("asked")))
    line = steps.groupBy(*by, "at").agg(F.sum("step").alias("step"), F.max("asked").alias("asked"))
    run = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return (line.withColumn(out, F.sum("step").over(run)).filter("asked")
            .select(*by, F.date_from_unix_date(F.col("at").cast("int")).alias(day), out))


def trailing_sums(daily: DataFrame, by: Sequence[str], day: str, days: int, sums: dict[str, str],
                  grid: DataFrame | None = None, *, include_today: bool = True) -> DataFrame:
    """Sums of columns over (d - days, d] (or [d - days, d) without today) at every event day or every day of `grid`."""
    by = list(by)
    lines = daily.groupBy(*by, day).agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.lit(grid is None).alias("_asked"))
    if grid is not None:
        asked = grid.select(*by, day).withColumn("_asked", F.lit(True))
        lines = lines.unionByName(asked, allowMissingColumns=True).groupBy(*by, day).agg(
            *[F.sum(n).alias(n) for n in sums], F.max("_asked").alias("_asked"))
    order = Window.partitionBy(*by).orderBy("_d")
    w = order.rangeBetween(-(days - 1), 0) if include_today else order.rangeBetween(-days, -1)
    return (lines.withColumn("_d", F.unix_date(day)).select(*by, day, "_asked", *[F.sum(n).over(w).alias(n) for n in sums])
            .filter("_asked").drop("_asked"))


def trailing_activity(events: DataFrame, by: Sequence[str], who: str, day: str, days: int, sums: dict[str, str],
                      grid: DataFrame | None = None, out: str = "n", sum_days: int | None = None) -> DataFrame:
    """`trailing_distinct` and `trailing_sums` of one table of events in one pass: how many different `who`, and the sums over
    `sum_days` (default `days`), up to every day of `grid`, or every day of an event that names a `who`.

    Interval ends and daily sums lie on one line per key, so events are shuffled once to their `who` and what is left of
    them, at most a row per day, once to their key.
    """
    by = list(by)
    d = events.groupBy(*by, who, F.unix_date(day).alias("_d")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    each = Window.partitionBy(*by, who).orderBy("_d")
    named = F.col(who).isNotNull()
    d = d.select(*by, "_d", *sums, named.alias("_named"), F.lag("_d").over(each).alias("_prev"), F.lead("_d").over(each).alias("_next"))
    starts = F.when(F.col("_named") & (F.col("_prev").isNull() | (F.col("_d") - F.col("_prev") >= days)), 1).otherwise(0)
    last = F.col("_named") & (F.col("_next").isNull() | (F.col("_next") - F.col("_d") >= days))
    begun = F.struct(F.col("_d").alias("at"), starts.alias("step"), (F.col("_named") & F.lit(grid is None)).alias("asked"), *[F.col(n).alias(n) for n in sums])
    types = dict(d.dtypes)
    ended = F.struct((F.col("_d") + days).alias("at"), F.lit(-1).alias("step"), F.lit(False).alias("asked"), *[F.lit(None).cast(types[n]).alias(n) for n in sums])
    line = d.select(*by, F.explode(F.when(last, F.array(begun, ended)).otherwise(F.array(begun))).alias("e")).select(*by, "e.*")
    if grid is not None:
        line = line.unionByName(grid.select(*by, F.unix_date(day).alias("at"), F.lit(0).alias("step"), F.lit(True).alias("asked")), allowMissingColumns=True)
    line = line.groupBy(*by, "at").agg(F.sum("step").alias("step"), F.max("asked").alias("asked"), *[F.sum(n).alias(n) for n in sums])
    order = Window.partitionBy(*by).orderBy("at")
    back = order.rangeBetween(-((sum_days or days) - 1), 0)
    return (line.select(*by, "at", "asked", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(out), *[F.sum(n).over(back).alias(n) for n in sums])
            .filter("asked").select(*by, F.date_from_unix_date(F.col("at").cast("int")).alias(day), out, *sums))


def calendar(df: DataFrame, at: str = "ts") -> DataFrame:
    """The distinct sessions with their ordinal `sno`. One row per session, so the ordering window is small by nature."""
    return df.select(at).distinct().withColumn("sno", F.row_number().over(Window.orderBy(at)))


def islands(change: Column, by: Sequence[str], order: Sequence[str]) -> Column:
    """Number of the run a row belongs to, counting rows where `change` holds."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.when(change, 1).otherwise(0)).over(w)
