"""Cross-sectional signals on a panel: bars with the session number `sno` of the shared calendar (and `sector`).

A signal costs two shuffles: by asset for the windows, by (date, value slice) for the ranks. Ranks and medians come from
`functions.ranks`, so a date that holds a third of the table is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import average_rank, first_rows, group_medians, pct_rank
from ..functions.windows import enters, session_return, session_rolling, sessions_ago
from .bars import mark_month_ends
from .features import beta_residual, with_realised_vol


def picked(df: DataFrame, mask: Column) -> DataFrame:
    return df.filter(mask).select("asset", "ts", F.lit(1).alias("side"))


def momentum(far: int, near: int) -> Column:
    """Return from `far` to `near` sessions ago."""
    return sessions_ago("close", near) / sessions_ago("close", far) - 1


def weekday_is(n: int | None) -> Column:
    """Sessions on one weekday (Monday 0); None takes every session, for weekly bars."""
    return F.lit(True) if n is None else F.weekday("ts") == n


def xs_top(panel: DataFrame, lookback: int, top: int, best: bool = True) -> DataFrame:
    """Assets that enter the `top` strongest (or weakest) of their session."""
    df = panel.withColumn("_ret", session_return(lookback))
    df = average_rank(df, ["ts"], "_ret", "_rank", ascending=not best)
    return picked(df.withColumn("_in", enters(F.col("_rank") <= top)), F.col("_in"))


def momentum_month_end(panel: DataFrame, far: int, near: int, top: float) -> DataFrame:
    """Highest skip-momentum share at month ends."""
    df = mark_month_ends(panel.withColumn("_ret", momentum(far, near))).filter("month_end")
    return picked(pct_rank(df, ["ts"], "_ret", "_rank", ascending=False), F.col("_rank") <= top)


def short_reversal(panel: DataFrame, lookback: int, bottom: float, weekday: int | None = 4) -> DataFrame:
    df = panel.withColumn("_ret", session_return(lookback)).filter(weekday_is(weekday))
    return picked(pct_rank(df, ["ts"], "_ret", "_rank"), F.col("_rank") <= bottom)


def near_high(panel: DataFrame, within: float, n: int, min_count: int, quiet: int) -> DataFrame:
    """Close within `within` of its high of n sessions, for the first time in `quiet` sessions."""
    df = panel.withColumn("_near", F.coalesce(F.col("close") >= (1 - within) * session_rolling(F.max, "close", n, min_count), F.lit(False)))
    seen = F.coalesce(F.max("_near").over(Window.partitionBy("asset").orderBy("sno").rangeBetween(-quiet, -1)), F.lit(False))
    return picked(df.withColumn("_fresh", F.col("_near") & ~seen), F.col("_fresh"))


def sector_medians(df: DataFrame, value: str, out: str) -> DataFrame:
    return group_medians(df, ["ts", "sector"], value, out)


def sector_momentum(panel: DataFrame, far: int, near: int, top: int, mean: int) -> DataFrame:
    """At month ends, stocks above their mean in the `top` sectors by median skip-momentum (ties in name order)."""
    df = panel.withColumns({"_ret": momentum(far, near), "_mean": session_rolling(F.avg, "close", mean)})
    df = mark_month_ends(df).filter("month_end")
    order = Window.partitionBy("ts").orderBy(F.desc("_med"), "sector")  # a row per sector
    best = sector_medians(df, "_ret", "_med").withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= top)
    return picked(df.join(best.select("ts", "sector"), ["ts", "sector"]), F.col("close") > F.col("_mean"))


def sector_reversal(panel: DataFrame, lookback: int, bottom: float, weekday: int | None = 4) -> DataFrame:
    df = panel.withColumn("_ret", session_return(lookback)).filter(weekday_is(weekday))
    df = df.join(sector_medians(df, "_ret", "_med"), ["ts", "sector"]).withColumn("_rel", F.col("_ret") - F.col("_med"))
    return picked(pct_rank(df, ["ts"], "_rel", "_rank"), F.col("_rank") <= bottom)


def sector_turns(panel: DataFrame, drop: float, bounce: int, window: int, by: tuple[str, ...] = ("sector",), least: int = 0) -> DataFrame:
    """Sessions on which a group's median stock is down `drop` over `window` sessions and turns up over `bounce`."""
    df = panel.withColumns({"_rw": session_return(window), "_rb": session_return(bounce)}) if "_rw" not in panel.columns else panel
    keys = ["ts", *by]
    med = group_medians(df, keys, "_rw", "_mw").join(group_medians(df, keys, "_rb", "_mb"), keys)
    med = med.join(df.groupBy(*keys).agg(F.max("sno").alias("sno"), F.count("*").alias("_n")), keys)
    hit = (F.col("_n") >= least) & (F.col("_mw") <= -drop) & (F.col("_mb") > 0)
    return med.withColumn("_turn", enters(hit, by=list(by))).filter("_turn").select(*keys)


def sector_washout(panel: DataFrame, drop: float, bounce: int, window: int) -> DataFrame:
    """Every stock of a sector on the session its washout turns."""
    return picked(panel.join(sector_turns(panel, drop, bounce, window), ["ts", "sector"], "left_semi"), F.lit(True))


def stock_washout(panel: DataFrame, drop: float, bounce: int, window: int) -> DataFrame:
    df = panel.withColumns({"_rw": session_return(window), "_rb": session_return(bounce)})
    df = df.join(sector_medians(df, "_rb", "_mb"), ["ts", "sector"], "left")
    mask = (F.col("_rw") <= -drop) & (F.col("_rb") > 0) & (F.col("_mb") > 0)
    return picked(df.withColumn("_in", enters(mask)), F.col("_in"))


def with_dollar_rank(panel: DataFrame, window: int, min_count: int, out: str = "_size", digits: int | None = None) -> DataFrame:
    """Share of the sector with a smaller mean dollar volume."""
    df = panel.withColumn("_money", F.col("close") * F.col("volume"))
    df = df.withColumn("_dollar", session_rolling(F.avg, "_money", window, min_count))
    return pct_rank(df, ["ts", "sector"], "_dollar", out, digits=digits).drop("_money", "_dollar")


def lead_lag_sector(panel: DataFrame, lead: float, days: int, window: int, min_count: int) -> DataFrame:
    """Laggards on the session the sector's largest third is up `lead`; sectors of three names or more."""
    names = panel.groupBy("sector").agg(F.countDistinct("asset").alias("_names")).filter("_names >= 3").select("sector")
    df = with_dollar_rank(panel.withColumn("_ret", session_return(days)), window, min_count).join(names, "sector", "left_semi")
    leaders = sector_medians(df.filter(F.col("_size") > F.lit(2) / 3), "_ret", "_lead")
    df = df.join(leaders, ["ts", "sector"], "left")
    mask = (F.col("_lead") >= lead) & (F.col("_size") <= F.lit(2) / 3) & (F.col("_ret") <= 0)
    return picked(df.withColumn("_in", enters(mask)), F.col("_in"))


def with_vol_rank(panel: DataFrame, window: int, min_count: int, log: bool = False, out: str = "_calm", digits: int | None = None) -> DataFrame:
    return pct_rank(with_realised_vol(panel, window, min_count, log, "_vol"), ["ts"], "_vol", out, digits=digits)


def calm(panel: DataFrame, max_vol: float, window: int, min_count: int, digits: int | None = None) -> DataFrame:
    """(asset, ts) of the calmest share of each session; with `digits`, deviations that agree to so many places tie."""
    return with_vol_rank(panel, window, min_count, digits=digits).filter(F.col("_calm") <= max_vol).select("asset", "ts")


def only(signals: DataFrame, rows: DataFrame) -> DataFrame:
    """Signals whose (asset, ts) is among `rows`."""
    return signals.join(rows.select("asset", "ts"), ["asset", "ts"], "left_semi")


def washout_leaders(panel: DataFrame, drop: float, bounce: int, window: int, within: float) -> DataFrame:
    df = panel.withColumns({"_rw": session_return(window), "_rb": session_return(bounce)})
    strong = pct_rank(df, ["ts", "sector"], "_rw", "_rank", ascending=False)
    return picked(strong.join(sector_turns(df, drop, bounce, window), ["ts", "sector"], "left_semi"), F.col("_rank") <= within)


def size_washout(panel: DataFrame, drop: float, bounce: int, window: int, groups: int, size_window: int, min_count: int) -> DataFrame:
    """The washout turn of size groups within sectors, groups of three or more. Dollar volumes that agree to six places tie."""
    df = panel.withColumns({"_rw": session_return(window), "_rb": session_return(bounce)})
    df = with_dollar_rank(df, size_window, min_count, digits=6).filter("_size is not null").withColumn("_group", F.ceil(F.col("_size") * groups).cast("int"))
    turns = sector_turns(df, drop, bounce, window, ("sector", "_group"), 3)
    return picked(df.join(turns, ["ts", "sector", "_group"], "left_semi"), F.lit(True))


def washout_calmest(panel: DataFrame, drop: float, bounce: int, window: int, k: int, vol_window: int, min_count: int) -> DataFrame:
    """The k calmest stocks of each washed-out sector, ties in asset order."""
    df = with_realised_vol(panel, vol_window, min_count, out="_vol")
    df = df.join(sector_turns(panel, drop, bounce, window), ["ts", "sector"], "left_semi")
    return picked(first_rows(df, ["ts", "sector"], "_vol", "asset", k, "_rank"), F.lit(True))


def momentum_pullback(panel: DataFrame, far: int, near: int, top: float, dip: int, bottom: float, weekday: int | None = 4) -> DataFrame:
    df = panel.withColumns({"_mom": momentum(far, near), "_dip": session_return(dip)}).filter(weekday_is(weekday))
    df = pct_rank(pct_rank(df, ["ts"], "_mom", "_r1", ascending=False), ["ts"], "_dip", "_r2")
    return picked(df, (F.col("_r1") <= top) & (F.col("_r2") <= bottom))


def momentum_low_vol(panel: DataFrame, far: int, near: int, top: float, max_vol: float, window: int) -> DataFrame:
    """Strong and calm names at month ends; deviations that agree to 12 places tie."""
    df = with_realised_vol(panel.withColumn("_mom", momentum(far, near)), window, window, True, "_vol")
    df = mark_month_ends(df).filter("month_end")
    df = pct_rank(pct_rank(df, ["ts"], "_mom", "_r1", ascending=False), ["ts"], "_vol", "_r2", digits=12)
    return picked(df, (F.col("_r1") <= top) & (F.col("_r2") <= max_vol))


def low_vol_monthly(panel: DataFrame, bottom: float, window: int, min_count: int, trend: int) -> DataFrame:
    df = with_realised_vol(panel.withColumn("_mean", session_rolling(F.avg, "close", trend)), window, min_count, out="_vol")
    df = pct_rank(mark_month_ends(df).filter("month_end"), ["ts"], "_vol", "_calm")
    return picked(df, (F.col("_calm") <= bottom) & (F.col("close") > F.col("_mean")))


def turn_of_month(panel: DataFrame, days_before: int, max_vol: float, window: int, min_count: int, trend: int) -> DataFrame:
    """Calm stocks above their mean, `days_before` sessions before the month's last one."""
    backwards = Window.partitionBy(F.trunc("ts", "month")).orderBy(F.desc("ts"))  # the sessions of one month
    left = panel.select("ts").distinct().withColumn("_left", F.row_number().over(backwards) - 1).filter(F.col("_left") == days_before).select("ts")
    df = with_realised_vol(panel.withColumn("_mean", session_rolling(F.avg, "close", trend)), window, min_count, out="_vol")
    df = pct_rank(df.join(left, "ts", "left_semi"), ["ts"], "_vol", "_calm")
    return picked(df, (F.col("_calm") <= max_vol) & (F.col("close") > F.col("_mean")))


def stress_days(panel: DataFrame, drop: float, lookback: int) -> DataFrame:
    """First sessions on which the universe's median stock lost `drop`."""
    df = panel.withColumn("_ret", session_return(lookback))
    med = panel.select("ts", "sno").distinct().join(group_medians(df, ["ts"], "_ret", "_med"), "ts", "left")
    bad = F.coalesce(F.col("_med") <= -drop, F.lit(False))
    line = Window.orderBy("sno")  # one row per session
    return med.withColumn("_first", bad & ~F.coalesce(F.lag(bad).over(line), F.lit(False))).filter("_first").select("ts")


def stress_calm_leaders(panel: DataFrame, drop: float, lookback: int, max_vol: float, window: int, min_count: int, trend: int) -> DataFrame:
    df = with_realised_vol(panel.withColumn("_mean", session_rolling(F.avg, "close", trend)), window, min_count, out="_vol")
    df = pct_rank(df.join(stress_days(panel, drop, lookback), "ts", "left_semi"), ["ts"], "_vol", "_calm")
    return picked(df, (F.col("_calm") <= max_vol) & (F.col("close") > F.col("_mean")))


def residual_momentum(panel: DataFrame, top: float, lookback: int, skip: int) -> DataFrame:
    """Highest sums of past residuals over their deviation at month ends; scores that agree to six places tie."""
    win = lookback - skip
    df = beta_residual(panel, lookback, lookback // 2)
    df = df.withColumn("_score", session_rolling(F.sum, "residual", win, win // 2) / F.nullif(session_rolling(F.stddev_samp, "residual", win, win // 2), F.lit(0.0)))
    df = mark_month_ends(df.withColumn("_past", sessions_ago("_score", skip))).filter("month_end")
    return picked(pct_rank(df, ["ts"], "_past", "_rank", ascending=False, digits=6), F.col("_rank") <= top)


def month_end_closes(panel: DataFrame) -> DataFrame:
    """Closes at the month ends of the shared calendar with the month's ordinal `mno`."""
    df = mark_month_ends(panel).filter("month_end")
    months = df.select("ts").distinct().withColumn("mno", F.row_number().over(Window.orderBy("ts")))  # one row per month
    return df.join(months, "ts")


def months_ago(c: str, k: int) -> Column:
    return F.max(c).over(Window.partitionBy("asset").orderBy("mno").rangeBetween(-k, -k))


def same_month(panel: DataFrame, top: float, years: int) -> DataFrame:
    """Highest mean return in the coming calendar month over each of the past `years` years."""
    m = month_end_closes(panel).withColumn("_r", F.col("close") / months_ago("close", 1) - 1)
    seen = m.filter("_r is not null").select("asset", "_r", F.explode(F.array(*[F.col("mno") + 12 * k - 1 for k in range(1, years + 1)])).alias("mno"))
    score = seen.groupBy("asset", "mno").agg(F.avg("_r").alias("_score"), F.count("*").alias("_n")).filter(F.col("_n") == years)
    df = m.select("asset", "ts", "mno").join(score, ["asset", "mno"])
    return picked(pct_rank(df, ["ts"], "_score", "_rank", ascending=False), F.col("_rank") <= top)


def smooth_momentum(panel: DataFrame, far: int, near: int, top: float, within: float) -> DataFrame:
    """Winners whose path had the most up sessions (information discreteness, lowest share)."""
    win = far - near
    df = panel.withColumns({"_mom": momentum(far, near), "_r": session_return(1)})
    df = df.withColumns({"_up": F.when(F.col("_r").isNotNull(), (F.col("_r") > 0).cast("double")), "_dn": F.when(F.col("_r").isNotNull(), (F.col("_r") < 0).cast("double"))})
    df = df.withColumns({c: session_rolling(F.avg, c, win, win // 2, shift=near) for c in ("_up", "_dn")})
    df = mark_month_ends(df.withColumn("_disc", F.signum("_mom") * (F.col("_dn") - F.col("_up")))).filter("month_end")
    winners = pct_rank(df, ["ts"], "_mom", "_r1", ascending=False).filter(F.col("_r1") <= top)
    return picked(pct_rank(winners, ["ts"], "_disc", "_r2"), F.col("_r2") <= within)


def overnight_momentum(panel: DataFrame, lookback: int, top: float, weekday: int | None = 4) -> DataFrame:
    """Highest sums of night moves; sums that agree to 12 places tie."""
    df = panel.withColumn("_night", F.ln(F.col("open") / sessions_ago("close", 1)))
    df = df.withColumn("_sum", session_rolling(F.sum, "_night", lookback)).filter(weekday_is(weekday))
    return picked(pct_rank(df, ["ts"], "_sum", "_rank", ascending=False, digits=12), F.col("_rank") <= top)


def score_rank(scores: DataFrame, top: float) -> DataFrame:
    """The best share of a model's scores on each date."""
    return picked(pct_rank(scores, ["ts"], "score", "_rank", ascending=False), F.col("_rank") <= top)


CASH = -1


def target_weights(panel: DataFrame, top: int, months: int = 12, mean_months: int = 10) -> DataFrame:
    """At each month end the `top` assets by `months`-month return get 1/top each when above their mean, else cash does."""
    df = month_end_closes(panel)
    mean = F.avg("close").over(Window.partitionBy("asset").orderBy("mno").rangeBetween(-(mean_months - 1), 0))
    df = df.withColumns({"_mom": F.col("close") / months_ago("close", months) - 1, "_mean": mean})
    best = first_rows(df.filter("_mom is not null"), ["ts"], "_mom", "asset", top, "_rank", ascending=False)
    name = F.when(F.col("close") > F.col("_mean"), F.col("asset")).otherwise(F.lit(CASH))
    return best.groupBy("ts", name.alias("asset")).agg((F.count("*") / top).alias("weight"))


def inverse_vol_weights(panel: DataFrame, far: int, near: int, top: int, trend: int, vol_window: int) -> DataFrame:
    """At month ends, the `top` momentum names above their mean, weighted by the inverse of their volatility."""
    df = with_realised_vol(panel.withColumns({"_mom": momentum(far, near), "_mean": session_rolling(F.avg, "close", trend)}), vol_window, vol_window, out="_vol")
    df = mark_month_ends(df).filter("month_end").filter("_mom is not null and close > _mean and _vol > 0")
    best = first_rows(df, ["ts"], "_mom", "asset", top, "_rank", ascending=False)
    total = F.sum(1 / F.col("_vol")).over(Window.partitionBy("ts"))  # at most `top` rows per month
    return best.select("ts", "asset", (1 / F.col("_vol") / total).alias("weight"))


def rotation_variants(panel: DataFrame, top: int, pair: tuple[int, int], cash: int, bond: int) -> DataFrame:
    """Month-end weights of the rotation study: equal weight, trend only, mean of 1/3/6/12-month momentum, dual momentum."""
    df = month_end_closes(panel)
    mean = F.avg("close").over(Window.partitionBy("asset").orderBy("mno").rangeBetween(-9, 0))
    df = df.withColumns({f"_m{k}": F.col("close") / months_ago("close", k) - 1 for k in (1, 3, 6, 12)} | {"_mean": mean})
    size = df.groupBy("ts").agg(F.count("*").alias("_n"))
    each = df.join(size, "ts")
    equal = each.select(F.lit("equal").alias("variant"), "ts", "asset", (1 / F.col("_n")).alias("weight"))
    name = F.when(F.col("close") > F.col("_mean"), F.col("asset")).otherwise(F.lit(CASH))
    trend = each.groupBy("ts", name.alias("asset"), "_n").agg((F.count("*") / F.col("_n")).alias("weight")).select(F.lit("trend").alias("variant"), "ts", "asset", "weight")
    mixed = df.withColumn("_avg", (F.col("_m1") + F.col("_m3") + F.col("_m6") + F.col("_m12")) / 4).filter("_avg is not null")
    best = first_rows(mixed, ["ts"], "_avg", "asset", top, "_rank", ascending=False)
    average = best.groupBy("ts", name.alias("asset")).agg((F.count("*") / top).alias("weight")).select(F.lit("average").alias("variant"), "ts", "asset", "weight")
    a, b = pair
    r = lambda k: F.max(F.when(F.col("asset") == k, F.col("_m12")))
    dual = df.filter(F.col("asset").isin(a, b, cash, bond)).groupBy("ts").agg(r(a).alias("ra"), r(b).alias("rb"), r(cash).alias("rc"))
    pick = F.when(F.col("ra").isNull(), a).when(F.col("ra") > F.col("rc"), F.when(F.col("ra") >= F.col("rb"), a).otherwise(b)).otherwise(bond)
    dual = dual.select(F.lit("dual").alias("variant"), "ts", pick.cast("long").alias("asset"), F.lit(1.0).alias("weight"))
    return equal.unionByName(trend).unionByName(average).unionByName(dual)


def holdings_by_year(weights: DataFrame, names: list, by: str = "asset") -> DataFrame:
    """Month ends held per year, one column per name of a short given list."""
    return weights.filter("weight > 0").groupBy(F.year("ts").alias("year")).pivot(by, names).agg(F.count("ts")).na.fill(0)


