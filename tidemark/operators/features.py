"""Rolling indicators and features, known at the bar's close."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import group_medians
from ..functions.temporal import asof_join
from ..functions.windows import bars_ago, col, frame, over, own, rolling, session_rolling, sessions, sessions_ago


def sma(c: str | Column = "close", n: int = 20) -> Column:
    return rolling(F.avg, c, n)


def true_range(by="asset") -> Column:
    prev = bars_ago("close", 1, by)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


BLOCK = 512


def ewm_means(df: DataFrame, means: dict[str, tuple[str, float, int]], by="asset", order="ts") -> DataFrame:
    """Recursive averages y = (1 - a) y' + a x, as `out: (column, a, min_count)`, without a recursion.

    A key's values are cut into blocks of BLOCK. Inside a block the average is a scaled running sum; the state at the
    ends of earlier blocks is added with its decay, back to where the decay is below double precision. Three windows
    on one shuffle, nothing leaves the JVM. Missing values may only lead (a first difference, a warm-up)
    and columns averaged together must be missing on the same rows.
    """
    names = [n for n in means if means[n][1] < 1]
    # a block is short enough for the inverse decay of its last place to stay far below the largest number
    block = min([BLOCK, *(max(1, int(600 / -math.log(1 - means[n][1]))) for n in names)])
    some = means[next(iter(means))][0]
    running = own(by, order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_i", F.count(some).over(running) - 1)
    df = df.withColumns({"_k": F.floor(F.col("_i") / block), "_j": F.pmod("_i", F.lit(block))})
    inside = Window.partitionBy(by, "_k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local, full = {}, {}
    for n in names:
        c, alpha, _ = means[n]
        x = F.when(F.col("_i") == 0, F.col(c) / alpha).otherwise(F.col(c))  # the first value enters whole
        local[f"_l_{n}"] = alpha * F.pow(F.lit(1 - alpha), "_j") * F.sum(x * F.pow(F.lit(1 - alpha), -F.col("_j"))).over(inside)
    df = df.withColumns(local)
    for n in names:
        c, alpha, least = means[n]
        decay = 1 - alpha
        end = F.when(F.col("_j") == block - 1, F.col(f"_l_{n}"))
        state = F.lit(0.0)
        for m in range(1, max(1, math.ceil(40 / (block * -math.log(decay)))) + 1):
            earlier = F.max(end).over(Window.partitionBy(by).orderBy("_k").rangeBetween(-m, -m))
            state = state + F.coalesce(earlier, F.lit(0.0)) * decay ** (block * (m - 1))
        y = F.col(f"_l_{n}") + F.pow(F.lit(decay), F.col("_j") + 1) * state
        full[n] = F.when(F.col(c).isNotNull() & (F.col("_i") + 1 >= least), y)
    for n, (c, alpha, least) in means.items():
        if alpha >= 1:  # nothing is remembered
            full[n] = F.when(F.col("_i") + 1 >= least, F.col(c))
    return df.withColumns({n: full[n] for n in means}).drop("_i", "_k", "_j", *local)


def with_atr(bars: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    return ewm_means(bars.withColumn("_tr", true_range()), {out: ("_tr", 1 / n, n)}).drop("_tr")


def with_rsi(bars: DataFrame, n: int = 14, out: str = "rsi", c: str = "close") -> DataFrame:
    move = F.col(c) - bars_ago(c, 1)
    df = bars.withColumn("_up", F.greatest(move, F.lit(0.0))).withColumn("_down", F.greatest(-move, F.lit(0.0)))
    # the first bar has no move: it must not start the recursion at zero
    df = df.withColumns({k: F.when(move.isNotNull(), F.col(k)) for k in ("_up", "_down")})
    df = ewm_means(df, {"_g": ("_up", 1 / n, n), "_l": ("_down", 1 / n, n)})
    value = F.when(F.col("_l") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_g") / F.col("_l")))
    return df.withColumn(out, F.when(F.col("_g").isNotNull(), value)).drop("_up", "_down", "_g", "_l")


def bollinger(c: str = "close", n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    mid, sd = rolling(F.avg, c, n), rolling(F.stddev_pop, c, n)
    return mid - k * sd, mid, mid + k * sd


def with_adx(bars: DataFrame, n: int = 14, out: str = "adx") -> DataFrame:
    up, down = F.col("high") - bars_ago("high", 1), bars_ago("low", 1) - F.col("low")
    df = bars.withColumns({
        "_tr": true_range(),
        "_plus": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_minus": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    df = ewm_means(df, {"_t": ("_tr", 1 / n, n), "_p": ("_plus", 1 / n, n), "_m": ("_minus", 1 / n, n)})
    plus, minus = 100 * F.col("_p") / F.col("_t"), 100 * F.col("_m") / F.col("_t")
    df = df.withColumn("_dx", 100 * F.abs(plus - minus) / F.nullif(plus + minus, F.lit(0.0)))
    df = ewm_means(df, {out: ("_dx", 1 / n, n)})
    return df.drop("_tr", "_plus", "_minus", "_t", "_p", "_m", "_dx")


def prior_high(n: int, c: str = "high") -> Column:
    """Highest value of the n bars before this one."""
    return rolling(F.max, c, n, shift=1)


def prior_low(n: int, c: str = "low") -> Column:
    return rolling(F.min, c, n, shift=1)


def rolling_quantile(c: str | Column, lookback: int, q: float) -> Column:
    return over(lambda v: F.percentile(v, F.lit(q)), c, frame(lookback), lookback)


def window_rank(c: str, n: int, min_count: int, at: Column | None = None) -> Column:
    """Share of the last n values at or below the current one, ties averaged; with `at` only on rows where it holds."""
    seen = F.collect_list(c).over(frame(n))
    now = F.col(c)
    below = F.size(F.filter(seen, lambda x: x < now))
    ties = F.size(F.filter(seen, lambda x: x == now))
    asked = F.lit(True) if at is None else at
    return F.when(asked & (F.size(seen) >= min_count) & now.isNotNull(), (below + (ties + 1) / 2) / F.size(seen))


def with_features(bars: DataFrame, long: int = 200, medium: int = 50, rank_window: int = 250, rank_min: int = 50) -> DataFrame:
    """The learner's bar features: trend strength, distances in ATRs, volatility rank, short returns, RSI."""
    return with_distances(with_adx(with_atr(bars)), long, medium, rank_window, rank_min)


def with_distances(bars: DataFrame, long: int = 200, medium: int = 50, rank_window: int = 250, rank_min: int = 50, rank_at: Column | None = None) -> DataFrame:
    """What `with_features` adds to bars that carry `atr` and `adx`; `rank_at` says which bars need the volatility rank."""
    df = with_rsi(bars, 14, "rsi14")
    df = df.withColumns({"sma_long": sma("close", long), "_mid": sma("close", medium), "atr_pct": F.col("atr") / F.col("close")})
    df = df.withColumns({
        "vol_rank": window_rank("atr_pct", rank_window, rank_min, rank_at),
        "dist_long": (F.col("close") - F.col("sma_long")) / F.col("atr"),
        "dist_mid": (F.col("close") - F.col("_mid")) / F.col("atr"),
        "ret5": (F.col("close") - bars_ago("close", 5)) / F.col("atr"),
        "ret20": (F.col("close") - bars_ago("close", 20)) / F.col("atr")})
    return df.drop("_mid")


def session_vwap(bars: DataFrame) -> DataFrame:
    """Cumulative volume-weighted typical price within the day; needs `day`."""
    w = own(["asset", "day"]).rowsBetween(Window.unboundedPreceding, 0)
    volume = F.when(F.col("volume") == 0, 1.0).otherwise(F.col("volume"))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return bars.withColumn("vwap", F.sum(typical * volume).over(w) / F.sum(volume).over(w))


def daily_trend(bars: DataFrame, n: int) -> DataFrame:
    """Side of the last finished day's close against its n-day mean, on every bar of the day; needs `day`."""
    daily = bars.groupBy("asset", "day").agg(F.max_by("close", "ts").alias("_c"))
    mean = rolling(F.avg, "_c", n, order="day")
    daily = daily.withColumn("_s", F.signum(F.col("_c") - mean).cast("int"))
    daily = daily.select("asset", "day", F.coalesce(F.lag("_s").over(own(order="day")), F.lit(0)).alias("trend"))
    return bars.join(daily, ["asset", "day"])


def same_hour_volume(n: int = 20, min_count: int = 10, clock: str | Column = "hour") -> Column:
    """Mean volume of the previous n bars at the same clock hour."""
    w = Window.partitionBy("asset", col(clock)).orderBy("ts").rowsBetween(-n, -1)
    return over(F.avg, "volume", w, min_count)


def bar_return() -> Column:
    return F.col("close") / bars_ago("close", 1) - 1


def return_z(bars: DataFrame, n: int = 60, min_count: int = 40) -> DataFrame:
    """Bar return over the deviation of the n returns before it."""
    df = bars.withColumn("ret", bar_return())
    sd = rolling(F.stddev_samp, "ret", n, min_count, shift=1)
    return df.withColumn("ret_z", F.col("ret") / F.nullif(sd, F.lit(0.0)))


def with_realised_vol(panel: DataFrame, n: int = 60, min_count: int = 40, log: bool = False, out: str = "vol") -> DataFrame:
    ratio = F.col("close") / sessions_ago("close", 1)
    df = panel.withColumn("_r", F.ln(ratio) if log else ratio - 1)
    return df.withColumn(out, session_rolling(F.stddev_samp, "_r", n, min_count)).drop("_r")


def high_distance(n: int = 252, min_count: int = 200) -> Column:
    return F.col("close") / session_rolling(F.max, "close", n, min_count) - 1


def beta_residual(panel: DataFrame, n: int, min_count: int | None = None) -> DataFrame:
    """Residual of each return against the market (median return of the session) with the beta of the session before.

    The market's own rolling mean and variance are taken once, on one row per session.
    """
    k = min_count or n
    df = panel.withColumn("r", F.col("close") / sessions_ago("close", 1) - 1)
    market = panel.select("ts", "sno").distinct().join(group_medians(df.select("ts", "r"), ["ts"], "r", "m"), "ts", "left")
    line = Window.orderBy("sno").rangeBetween(-(n - 1), 0)  # one row per session
    market = market.select("ts", "m", over(F.avg, "m", line, k).alias("_mm"), over(F.var_pop, "m", line, k).alias("_mv"))
    df = df.join(market, "ts", "left").withColumn("_rm", F.col("r") * F.col("m"))
    cov = session_rolling(F.avg, "_rm", n, k) - session_rolling(F.avg, "r", n, k) * F.col("_mm")
    df = df.withColumn("_beta", cov / F.nullif(F.col("_mv"), F.lit(0.0)))
    df = df.withColumn("beta", sessions_ago("_beta", 1))
    return df.withColumn("residual", F.col("r") - F.col("beta") * F.col("m")).drop("_rm", "_mm", "_mv", "_beta")


def global_move(region_returns: DataFrame, bars: DataFrame, n: int = 60, min_count: int = 20, offset_hours: int = 6) -> DataFrame:
    """Regional mean return in units of its own deviation, readable `offset_hours` after its day, last known at each bar.

    `region_returns(region, day, ret)`, `bars(region, ts, ...)`.
    """
    df = region_returns.withColumn("z", F.col("ret") / F.nullif(rolling(F.stddev_samp, "ret", n, min_count, by="region", order="day"), F.lit(0.0)))
    df = df.withColumn("known_at", F.col("day").cast("timestamp") + F.make_interval(hours=F.lit(offset_hours))).filter("z is not null")
    return asof_join(bars, df, ["region"], "ts", "known_at", ["z"], strict=False, slice_unit="YEAR")
