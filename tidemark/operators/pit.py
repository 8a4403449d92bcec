"""Point-in-time and interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import group_medians  # noqa: F401  (re-exported for callers that need market medians)
from ..functions.temporal import asof_bars, asof_join, calendar, islands, on_session, trailing_activity, trailing_distinct, trailing_sums
from ..functions.windows import own, turns_on  # noqa: F401
from .bars import minute_of_day, new_york

def far() -> Column:
    """The end of a spell that is still open."""
    return F.lit("9999-12-31").cast("date")


def newest_periods(filed: DataFrame, by="asset") -> DataFrame:
    """Filings whose period end is newer than every one filed before them (equal ends: the first filed stays)."""
    w = Window.partitionBy(by).orderBy("filed", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return filed.withColumn("_seen", F.max("end").over(w)).filter(F.col("_seen").isNull() | (F.col("end") > F.col("_seen"))).drop("_seen")


def known_asof(rows: DataFrame, filed: DataFrame, at: str, by="asset", values: Sequence[str] = ("val",)) -> DataFrame:
    """The value with the newest period end among filings made strictly before each row's date."""
    return asof_join(rows, newest_periods(filed, by), [by], at, "filed", ["end", *values], strict=True, slice_unit="QUARTER")


def known_asof_many(rows: DataFrame, series: dict[str, DataFrame], at: str, by="asset") -> DataFrame:
    """`known_asof` of bars for several series `name: (by, end, filed, val)` in one pass, one value column per name."""
    sides = {f"_s_{n}": (newest_periods(df, by), "filed", ["end", "val"]) for n, df in series.items()}
    df = asof_bars(rows, sides, [by], at, strict=True)
    return df.select(*rows.columns, *[F.col(f"_s_{n}.val").alias(n) for n in series])


def release_day(accepted: Column) -> Column:
    """The session date that can react: the New York day when before 9:30, else the next day."""
    local = new_york(accepted)
    return F.when(minute_of_day(local) < 570, local.cast("date")).otherwise(F.date_add(local.cast("date"), 1))


def news_day(created: Column) -> Column:
    """The day whose 16:00 New York close knows an article."""
    return (new_york(created) + F.expr("interval 8 hours")).cast("date")


def spells_from_snapshots(snapshots: DataFrame, by: Sequence[str] = ("asset",), missing_allowed: int = 1) -> DataFrame:
    """Membership spells [start, end): snapshots with at most `missing_allowed` absences form one spell; the end is the
    first snapshot without the member, null when it is in the latest one."""
    by = list(by)
    cal = calendar(snapshots, "month").withColumn("next_month", F.lead("month").over(Window.orderBy("month")))
    s = snapshots.join(cal, "month")
    lag = F.lag("sno").over(Window.partitionBy(*by).orderBy("sno"))
    s = s.withColumn("_new", lag.isNull() | (F.col("sno") - lag > missing_allowed + 1))
    s = s.withColumn("spell", islands(F.col("_new"), by, ["sno"]))
    return s.groupBy(*by, "spell").agg(F.min("month").alias("start"), F.max_by("next_month", "sno").alias("end")).drop("spell")


def roll_spells(spells: DataFrame, today: DataFrame, day: Column) -> DataFrame:
    """Close open spells absent from today's list, open new ones today, refresh the sector of the open ones."""
    past = spells.filter("end is not null")
    held = spells.filter("end is null").withColumnRenamed("sector", "_old")
    both = held.join(today.withColumnRenamed("sector", "_now").withColumn("_in", F.lit(True)), "asset", "full_outer")
    rolled = both.select("asset", F.coalesce("start", day).alias("start"), F.when(F.col("_in").isNull(), day).alias("end"),
                         F.coalesce("_now", "_old").alias("sector"))
    return past.select("asset", "start", "end", "sector").unionByName(rolled)


def membership_windows(spells: DataFrame) -> DataFrame:
    """First day as a member, and the day the last spell ended (null while one is open)."""
    return spells.groupBy("asset").agg(F.min("start").alias("first_day"), F.when(F.count("*") == F.count("end"), F.max("end")).alias("left_day"))


def cut_to_membership(bars: DataFrame, windows: DataFrame, warmup_days: int = 550, grace: int = 90, max_gap: int = 10) -> DataFrame:
    """Bars from `warmup_days` before the first membership; after leaving, at most `grace` bars and only until a pause
    longer than `max_gap` days (a ticker used again later is another company)."""
    df = bars.join(windows, "asset").filter(F.col("ts") >= F.date_sub("first_day", warmup_days))
    after = F.col("ts") >= F.col("left_day")
    df = df.withColumn("_after", F.coalesce(after, F.lit(False)))
    pause = F.datediff("ts", F.lag("ts").over(own()))
    df = df.withColumn("_broken", F.when(F.col("_after") & (pause > max_gap), 1).otherwise(0))
    up_to_here = own().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_breaks", F.sum("_broken").over(up_to_here)).withColumn("_n", F.sum(F.col("_after").cast("int")).over(up_to_here))
    return df.filter(~F.col("_after") | ((F.col("_breaks") == 0) & (F.col("_n") <= grace))).drop(
        "_after", "_broken", "_breaks", "_n", "first_day", "left_day")


def membership_mask(bars: DataFrame, spells: DataFrame, floor: Column | None = None) -> DataFrame:
    """Bars on days inside any stay; with a floor, earlier days count as the floor day."""
    day = F.greatest(F.col("ts"), floor) if floor is not None else F.col("ts")
    stays = spells.select("asset", F.col("start").alias("_start"), F.coalesce("end", far()).alias("_end"))
    probe = bars.withColumn("_day", day)
    return probe.join(stays, (probe["asset"] == stays["asset"]) & (F.col("_day") >= F.col("_start")) & (F.col("_day") < F.col("_end")), "left_semi").drop("_day")


def members_since(spells: DataFrame, day: Column) -> DataFrame:
    return spells.filter((F.coalesce("end", far()) > day)).select("asset").distinct()


def current_attribute(spells: DataFrame) -> DataFrame:
    """Sector of the open spell, else of the one that ended last."""
    return spells.groupBy("asset").agg(F.max_by("sector", F.struct(F.coalesce("end", far()), "start", "sector")).alias("sector"))


def view_asof(rows: DataFrame, views: DataFrame, max_age_days: int = 5) -> DataFrame:
    """A view made on day D is readable from D + 1 and for `max_age_days` days."""
    v = views.select("asset", F.date_add("day", 1).alias("usable"), "bias")
    got = asof_join(rows, v, ["asset"], "ts", "usable", ["bias"], strict=False)
    fresh = F.datediff("ts", "usable") <= max_age_days - 1
    return got.withColumn("bias", F.coalesce(F.when(fresh, F.col("bias")), F.lit(0))).drop("usable")


def insider_windows(filings: DataFrame, grid: DataFrame, buy_days: int = 90, sell_days: int = 30, *, include_today: bool) -> DataFrame:
    """Per grid day: distinct buyers and log dollars bought in the last `buy_days`, log dollars sold outside plans in the
    last `sell_days`. Without `include_today` only filings before the day count."""
    buys, sells = filings.filter("code = 'P'"), filings.filter("code = 'S' and not plan")
    moved = (lambda df: df) if include_today else (lambda df: df.withColumn("day", F.date_add("day", 1)))
    buys, sells = (moved(df.select("asset", "owner", F.col("filed").alias("day"), "value")) for df in (buys, sells))
    grid = grid.select("asset", "day")
    who = trailing_distinct(buys, ["asset"], "owner", "day", buy_days, grid, "buyers")
    bought = trailing_sums(buys, ["asset"], "day", buy_days, {"bought": "value"}, grid)
    sold = trailing_sums(sells, ["asset"], "day", sell_days, {"sold": "value"}, grid)
    return who.join(bought, ["asset", "day"]).join(sold, ["asset", "day"]).select(
        "asset", "day", F.coalesce("buyers", F.lit(0)).alias("buyers"), F.log1p(F.coalesce("bought", F.lit(0.0))).alias("log_bought"),
        F.log1p(F.coalesce("sold", F.lit(0.0))).alias("log_sold"))


def known_at_bars(bars: DataFrame, filings: DataFrame, releases: DataFrame | None = None, events: DataFrame | None = None, buy_days: int = 90, sell_days: int = 30,
                  series: dict[str, DataFrame] | None = None, highest: DataFrame | None = None, newest: dict[str, DataFrame] | None = None) -> DataFrame:
    """Bars with what the filings, releases and events of their asset say, in one pass and lying by asset after it: different buyers and
    values of the last `buy_days` (`_buyers`, `_bought`) and values sold in `sell_days` (`_sold`) up to the bar's day; sums since the bar
    before of the counts `n`, `pos`, `neg`; `blocked` where a release has come since then; `_next`, the first event day from the bar on.

    `filings(asset, owner, filed, code, value)`, with the counts where they are asked for, `releases(asset, day)`, `events(asset, day)`.
    `series` are what `known_asof_many` takes, a value column per name; `highest(asset, day, ...)` has columns whose largest value of the
    last `buy_days` is known up to the bar's day, `newest` has tables (asset, day) whose last day is. Filings are shuffled once to their owner, and what is left of them, at most a row per day, lies with the bars on one line per asset."""
    bought, counts = F.col("code") == "P", [c for c in ("n", "pos", "neg") if c in filings.columns]
    e = filings.groupBy("asset", "owner", F.unix_date("filed").alias("_d")).agg(
        (F.coalesce(F.max(bought), F.lit(False)) & F.col("owner").isNotNull()).alias("_named"), F.sum(F.when(bought, F.col("value"))).alias("_b"), F.sum(F.when(F.col("code") == "S", F.col("value"))).alias("_s"), *[F.sum(c).alias(f"_{c}") for c in counts])
    one = Window.partitionBy("asset", "owner").orderBy("_d")
    named = F.when(F.col("_named"), F.col("_d"))
    before, after = F.max(named).over(one.rowsBetween(Window.unboundedPreceding, -1)), F.min(named).over(one.rowsBetween(1, Window.unboundedFollowing))
    e = e.withColumns({"_start": F.col("_named") & (before.isNull() | (F.col("_d") - before >= buy_days)), "_stop": F.col("_named") & (after.isNull() | (after - F.col("_d") >= buy_days))})
    sums = ["_b", "_s", *[f"_{c}" for c in counts]]
    kinds = dict(e.dtypes)
    begun = F.struct(F.col("_d").alias("at"), F.col("_start").cast("int").alias("_step"), *sums)
    ended = F.struct((F.col("_d") + buy_days).alias("at"), F.lit(-1).alias("_step"), *[F.lit(None).cast(kinds[c]).alias(c) for c in sums])
    days = e.select("asset", F.explode(F.when(F.col("_stop"), F.array(begun, ended)).otherwise(F.array(begun))).alias("e")).groupBy("asset", "e.at").agg(*[F.sum(f"e.{c}").alias(c) for c in ("_step", *sums)])
    # a day's filings come before its bar, its events after: days are even, bars odd
    at = lambda day: (F.unix_date(day) * 2).alias("_at")
    line = days.select("asset", (F.col("at") * 2).alias("_at"), "_step", *sums)
    if releases is not None:
        line = line.unionByName(releases.select("asset", at("day"), F.lit(1).alias("_release")), allowMissingColumns=True)
    if events is not None:
        line = line.unionByName(events.select("asset", (F.unix_date("day") * 2 + 2).alias("_at"), F.col("day").alias("_event")), allowMissingColumns=True)
    tops = [] if highest is None else [c for c in highest.columns if c not in ("asset", "day")]
    if tops:
        line = line.unionByName(highest.select("asset", at("day"), *tops), allowMissingColumns=True)
    for name, df in (newest or {}).items():
        line = line.unionByName(df.select("asset", at("day"), F.col("day").alias(name)), allowMissingColumns=True)
    for name, filed in (series or {}).items():
        periods = newest_periods(filed).filter("filed is not null")  # known from the day after
        line = line.unionByName(periods.select("asset", (F.unix_date("filed") * 2 + 2).alias("_at"), F.struct("filed", "end", "val").alias(name)), allowMissingColumns=True)
    line = line.unionByName(bars.select("asset", (F.unix_date("ts") * 2 + 1).alias("_at"), *[c for c in bars.columns if c != "asset"]), allowMissingColumns=True)
    order = Window.partitionBy("asset").orderBy("_at")
    upto, back = order.rowsBetween(Window.unboundedPreceding, 0), lambda n: order.rangeBetween(-(2 * n - 1), 0)
    so_far = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    line = line.withColumns({"_buyers": so_far("_step"), "_bought": F.sum("_b").over(back(buy_days)), "_sold": F.sum("_s").over(back(sell_days)), **{f"_{c}": so_far(f"_{c}") for c in counts},
                             **{n: F.max(n).over(upto) for n in [*(series or {}), *(newest or {})]}, **{n: F.max(n).over(back(buy_days)) for n in tops}, **({} if releases is None else {"_release": so_far("_release")}),
                             **({} if events is None else {"_next": F.min("_event").over(Window.partitionBy("asset").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0))})})
    at_bars = line.filter("ts is not null")
    since = lambda c: F.col(c) - F.coalesce(F.lag(c).over(own()), F.lit(0))
    at_bars = at_bars.withColumns({**{c: since(f"_{c}") for c in counts}, **({} if releases is None else {"blocked": since("_release") > 0})})
    return at_bars.select(*bars.columns, "_buyers", "_bought", "_sold", *counts, *(["blocked"] if releases is not None else []), *(["_next"] if events is not None else []), *[F.col(f"{n}.val").alias(n) for n in series or {}], *tops, *(newest or {}))


def purchase_cost(buys: DataFrame, grid: DataFrame, days: int = 90) -> DataFrame:
    """Value-weighted price and distinct buyers of the purchases in (day - days, day]."""
    p = buys.select("asset", "owner", F.col("filed").alias("day"), "shares", (F.col("price") * F.col("shares")).alias("_paid"))
    known = trailing_activity(p, ["asset"], "owner", "day", days, {"_p": "_paid", "_s": "shares"}, grid, "buyers")
    return known.select("asset", "day", (F.col("_p") / F.nullif("_s", F.lit(0.0))).alias("cost"), "buyers")


def universe_return(panel: DataFrame, spells: DataFrame) -> DataFrame:
    """Equal-weight mean return per session of the members of the day, bars without volume left out, 0 when none."""
    df = panel.withColumn("ret", F.col("close") / F.lag("close").over(own()) - 1)
    members = membership_mask(df, spells).filter("volume > 0").groupBy("ts").agg(F.avg("ret").alias("ret"))
    return panel.select("ts").distinct().join(members, "ts", "left").select("ts", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def coverage_check(days: DataFrame, start: Column, today: Column, max_gap: int = 5) -> DataFrame:
    """Longest stretch without a processed day between start - 1 and today, and whether it is short enough."""
    inside = days.filter(F.col("day") >= start).select("day")
    edges = days.sparkSession.range(1).select(F.explode(F.array(F.date_sub(start, 1), today)).alias("day"))
    points = inside.unionByName(edges).distinct()
    gap = F.datediff(F.lead("day").over(Window.orderBy("day")), "day")  # one row per processed day
    return points.select("day", gap.alias("gap")).agg(F.max("gap").alias("worst"), F.max_by("day", F.col("gap") * 100000 - F.unix_date("day")).alias("since")).select(
        "worst", "since", (F.col("worst") <= max_gap).alias("complete"))


def monthly_snapshots(revisions: DataFrame, months: DataFrame, plausible: DataFrame) -> DataFrame:
    """The list in force at each month start: the last revision strictly before it, skipped when its size is implausible;
    the small list loses the names of that month's (last good) mid list."""
    sizes = revisions.groupBy("list", "rev").agg(F.count("*").alias("_n")).join(plausible, "list").filter("_n >= least_names and _n <= most_names")
    each = months.select("month", F.explode(F.array(F.lit("mid"), F.lit("small"))).alias("list"))
    at = asof_join(each, sizes.select("list", "rev"), ["list"], "month", "rev", [], strict=True, slice_unit="YEAR").filter("rev is not null")
    names = at.join(revisions, ["list", "rev"]).select("list", "month", "asset")
    mid = names.filter("list = 'mid'").select("month", "asset")
    return names.filter("list = 'mid'").unionByName(names.filter("list = 'small'").join(mid, ["month", "asset"], "left_anti").select("list", "month", "asset"))


def cost_lookup(assets: DataFrame, spells: DataFrame, costs: DataFrame, default_bp: float = 15.0) -> DataFrame:
    """Trading cost of each asset by the index it joined last; `default_bp` when it never was in one."""
    last = spells.groupBy("asset").agg(F.max_by("sector", F.struct("start", "sector")).alias("list"))
    return assets.join(last, "asset", "left").join(costs, "list", "left").select("asset", F.coalesce("bp", F.lit(default_bp)).alias("bp"))
