"""Per-asset signals: `side` is +1 / -1 on the bar whose close decides, rows without a signal are dropped.

Every function takes one long table of bars; the indicators it needs are added where they are cheap (windows on the
asset's own bars, one shuffle shared by all of them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import bars_ago, own, rolling, side, turns_on
from .features import bollinger, prior_high, prior_low, rolling_quantile, same_hour_volume, session_vwap, sma, with_atr, with_rsi


def fired(df: DataFrame, value: Column, keep: tuple[str, ...] = ("asset", "ts")) -> DataFrame:
    return df.withColumn("side", value.cast("int")).filter("side <> 0").select(*keep, "side")


def fires(values: dict[str, Column], name: str = "strategy") -> Column:
    """What the named rules fire on a bar, as a list of (name, side)."""
    return F.filter(F.array(*[F.struct(F.lit(k).alias(name), v.cast("int").alias("side")) for k, v in values.items()]), lambda x: x["side"] != 0)


def fired_each(df: DataFrame, values: dict[str, Column], name: str = "candidate") -> DataFrame:
    """The signals of several named rules in one pass over the bars."""
    sides = df.select("asset", "ts", F.array(*[F.struct(F.lit(k).alias("name"), v.cast("int").alias("side")) for k, v in values.items()]).alias("_each"))
    hits = F.explode(F.filter("_each", lambda x: x["side"] != 0)).alias("_e")
    return sides.select("asset", "ts", hits).select("asset", "ts", F.col("_e.side").alias("side"), F.col("_e.name").alias(name))


def breakout_side(n: int, trend: int) -> Column:
    close, mean = F.col("close"), sma("close", trend)
    return side((close > prior_high(n)) & (close > mean), (close < prior_low(n)) & (close < mean))


def donchian_breakout(bars: DataFrame, n: int, trend: int) -> DataFrame:
    return fired(bars, breakout_side(n, trend))


def squeeze_breakout(bars: DataFrame, n: int, k: float, lookback: int, q: float, memory: int) -> DataFrame:
    low, mid, high = bollinger("close", n, k)
    df = bars.withColumns({"_lo": low, "_hi": high, "_w": (high - low) / mid})
    df = df.withColumn("_tight", F.coalesce(F.col("_w") <= rolling_quantile("_w", lookback, q), F.lit(False)).cast("int"))
    recent = rolling(F.max, "_tight", memory, shift=1) == 1
    return fired(df, side((F.col("close") > F.col("_hi")) & recent, (F.col("close") < F.col("_lo")) & recent))


def rsi_reversion(bars: DataFrame, n: int, threshold: float, trend: int) -> DataFrame:
    df, mean = with_rsi(bars, n, "_rsi"), sma("close", trend)
    return fired(df, side((F.col("_rsi") < threshold) & (F.col("close") > mean), (F.col("_rsi") > 100 - threshold) & (F.col("close") < mean)))


def news_momentum(bars: DataFrame, news: DataFrame, buzz: float, tone: float, n: int) -> DataFrame:
    df = bars.withColumn("_mean", sma("close", n)).join(news, ["asset", "ts"])
    loud = F.col("attention_z") > buzz
    return fired(df, side(loud & (F.col("tone_z") > tone) & (F.col("close") > F.col("_mean")),
                          loud & (F.col("tone_z") < -tone) & (F.col("close") < F.col("_mean"))))


def opening_range(bars: DataFrame, n_open: int, last_k: int | None = None) -> DataFrame:
    """First close of the day beyond the range of its first `n_open` bars; bars carry `day` and `k`."""
    whole = Window.partitionBy("asset", "day")
    early = F.col("k") < n_open
    df = bars.withColumns({"_hi": F.max(F.when(early, F.col("high"))).over(whole), "_lo": F.min(F.when(early, F.col("low"))).over(whole)})
    later = F.col("k") >= n_open
    if last_k is not None:
        later = later & (F.col("k") < last_k)
    df = df.withColumn("_s", side(later & (F.col("close") > F.col("_hi")), later & (F.col("close") < F.col("_lo"))))
    nth = F.sum(F.abs("_s")).over(own(["asset", "day"]).rowsBetween(Window.unboundedPreceding, 0))
    return fired(df, F.when(nth == 1, F.col("_s")).otherwise(0))


def vwap_stretch(bars: DataFrame) -> DataFrame:
    """Distance of the close from the day's VWAP in ATRs; bars carry `day`."""
    return session_vwap(with_atr(bars)).withColumn("_z", (F.col("close") - F.col("vwap")) / F.col("atr"))


def vwap_reversion(bars: DataFrame, k: float, trend: int) -> DataFrame:
    df, mean = vwap_stretch(bars), sma("close", trend)
    return fired(df, side((F.col("_z") < -k) & (F.col("close") > mean), (F.col("_z") > k) & (F.col("close") < mean)))


def with_trend(signals: DataFrame, trend: DataFrame) -> DataFrame:
    """Signals that agree with the side of the daily trend (`trend` per asset and bar)."""
    return signals.join(trend.select("asset", "ts", "trend"), ["asset", "ts"]).filter(F.col("side") * F.col("trend") > 0).drop("trend")


def vwap_fade(bars: DataFrame, k: float, first_bar: int = 6) -> DataFrame:
    late = F.col("k") >= first_bar
    return fired(vwap_stretch(bars), side(late & (F.col("_z") < -k), late & (F.col("_z") > k)))


def range_break(bars: DataFrame, n: int, volume_k: float) -> DataFrame:
    loud = F.col("volume") > volume_k * rolling(F.avg, "volume", n, shift=1)
    return fired(bars, side((F.col("close") > prior_high(n)) & loud, (F.col("close") < prior_low(n)) & loud))


def rsi_with_averages(bars: DataFrame, fast: int = 12, slow: int = 48, low: float = 5.0) -> DataFrame:
    df = with_rsi(bars, 2, "_rsi")
    up = F.coalesce(sma("close", fast) > sma("close", slow), F.lit(False))
    return fired(df, side((F.col("_rsi") < low) & up, (F.col("_rsi") > 100 - low) & ~up))


def intraday_momentum(bars: DataFrame, k: float, emit_on: int = 5) -> DataFrame:
    body = F.first(F.col("close") - F.col("open")).over(own(["asset", "day"]))
    df = with_atr(bars).withColumn("_z", body / F.col("atr"))
    return fired(df, F.when((F.col("k") == emit_on) & (F.abs("_z") > k), F.signum("_z")).otherwise(0))


def gap_fade(bars: DataFrame, g: float) -> DataFrame:
    df = with_atr(bars).withColumn("_gap", (F.col("open") - bars_ago("close", 1)) / F.col("atr"))
    first = F.col("k") == 0
    return fired(df, side(first & (F.col("_gap") < -g), first & (F.col("_gap") > g)))


def earnings_drift(bars: DataFrame, reports: DataFrame, x: float) -> DataFrame:
    """Side of the first bar's move on a report day or the day after it."""
    df = with_atr(bars).withColumn("_move", (F.col("close") - bars_ago("close", 1)) / F.col("atr")).filter("k = 0")
    days = reports.select("asset", F.explode(F.array(F.col("day"), F.date_add("day", 1))).alias("day")).distinct()
    return fired(df.join(days, ["asset", "day"], "left_semi"), F.when(F.abs("_move") > x, F.signum("_move")).otherwise(0))


def volume_breakout(bars: DataFrame, n: int, m: float, min_count: int = 10) -> DataFrame:
    loud = F.col("volume") > m * same_hour_volume(20, min_count, F.hour("ts"))
    return fired(bars, side((F.col("close") > prior_high(n)) & loud, (F.col("close") < prior_low(n)) & loud))


def sweep_side(n: int, k: float) -> Column:
    """Bars carry `atr`."""
    low, high, room = prior_low(n), prior_high(n), k * F.col("atr")
    return side((F.col("low") < low) & (F.col("close") > low + room), (F.col("high") > high) & (F.col("close") < high - room))


def liquidity_sweep(bars: DataFrame, n: int, k: float) -> DataFrame:
    return fired(with_atr(bars), sweep_side(n, k))


def leader_lag(bars: DataFrame, leader: Column, k: float) -> DataFrame:
    """Followers that moved less than half of the leader's large bar. The leader's rows are one series."""
    df = with_atr(bars).withColumn("_z", (F.col("close") - F.col("open")) / F.col("atr"))
    lead = df.filter(F.col("asset") == leader).select("ts", F.col("_z").alias("_b"))
    df = df.filter(F.col("asset") != leader).join(lead, "ts")
    return fired(df, side((F.col("_b") > k) & (F.col("_z") < 0.5 * F.col("_b")), (F.col("_b") < -k) & (F.col("_z") > 0.5 * F.col("_b"))))


def filtered(signals: DataFrame, bars: DataFrame, trend: DataFrame | None, long_only: bool, member_bars: DataFrame | None) -> DataFrame:
    """Family signals through the common filters: daily trend, long only, member of the day with volume."""
    out = with_trend(signals, trend) if trend is not None else signals
    if long_only:
        out = out.filter("side > 0")
    if member_bars is not None:
        traded = member_bars.filter("volume > 0").select("asset", "ts")
        out = out.join(traded, ["asset", "ts"], "left_semi")
    return out


def hash_uniform(seed: int, *parts: Column) -> Column:
    """A reproducible uniform number from integer columns, the same in every engine."""
    total = F.lit(seed * 1299709)
    for p, m in zip(parts, (7919, 104729, 15485863)):
        total = total + p.cast("long") * m
    return F.pmod(total * 48271 + 11, F.lit(1000003)) / 1000003


#: A prime below 2**31 at which cubing is a permutation, so that products of two residues fit a long.
MIX_PRIME = 2147483399


def cubed(x: Column) -> Column:
    return x * x % MIX_PRIME * x % MIX_PRIME


def mixed(seed: int, *parts: Column) -> Column:
    """A residue of MIX_PRIME from integer columns, cubed after each of them: unlike `hash_uniform`, neighbours share no
    pattern, which resampling needs. The same in every engine."""
    x = F.lit(seed * 1299709)
    for p, m in zip(parts, (7919, 104729, 15485863)):
        x = cubed((x + F.pmod(p.cast("long"), F.lit(MIX_PRIME)) * m) % MIX_PRIME)
    return x


def mixed_uniform(x: Column) -> Column:
    """A uniform number from a residue."""
    return cubed((x * 48271 + 11) % MIX_PRIME) / MIX_PRIME


def random_twin(signals: DataFrame, bars: DataFrame, seed: int, both_sides: bool = True) -> DataFrame:
    """Signals at random times with each asset's own firing rate."""
    flagged = bars.select("asset", "ts").join(signals.select("asset", "ts", "side"), ["asset", "ts"], "left")
    rate = F.count("side").over(Window.partitionBy("asset")) / F.count("*").over(Window.partitionBy("asset"))
    at = F.unix_date(F.col("ts").cast("date"))
    df = flagged.withColumn("_rate", rate).filter(hash_uniform(seed, F.col("asset"), at) < F.col("_rate"))
    way = F.when(hash_uniform(seed + 1, F.col("asset"), at) < 0.5, 1).otherwise(-1) if both_sides else F.lit(1)
    return df.select("asset", "ts", way.cast("int").alias("side"))


def random_twins(signals: DataFrame, bars: DataFrame, seed: int, by: str = "candidate") -> DataFrame:
    """`random_twin` of every `by` in one pass over the bars: an asset takes its firing rates along, one per `by`."""
    rates = signals.groupBy("asset", by).agg(F.count("side").alias("_fired")).join(bars.groupBy("asset").agg(F.count("*").alias("_n")), "asset")
    rates = rates.groupBy("asset").agg(F.collect_list(F.struct(by, (F.col("_fired") / F.col("_n")).alias("rate"))).alias("_rates"))
    at = F.unix_date(F.col("ts").cast("date"))
    df = bars.select("asset", "ts").withColumn("_u", hash_uniform(seed, F.col("asset"), at)).join(rates, "asset")
    df = df.select("asset", "ts", F.explode(F.filter("_rates", lambda x: F.col("_u") < x["rate"])).alias("_e"))
    way = F.when(hash_uniform(seed + 1, F.col("asset"), at) < 0.5, 1).otherwise(-1)
    return df.select("asset", "ts", way.cast("int").alias("side"), f"_e.{by}")


def pending_entries(signals: DataFrame, bars: DataFrame, held: DataFrame, equity: float, risk: float, stop_atr: float, gross: float) -> DataFrame:
    """Long signals on the last shared session of assets not held, sized by risk and capped by a quarter of the gross limit."""
    last = with_atr(bars).groupBy("asset").agg(F.max_by(F.struct("ts", "close", "atr"), "ts").alias("r")).select("asset", "r.*")
    now = bars.agg(F.max("ts").alias("t"))
    df = last.filter(F.col("ts") == now.scalar()).filter("atr > 0")
    df = df.join(signals.filter("side > 0").select("asset", "ts"), ["asset", "ts"], "left_semi").join(held.select("asset"), "asset", "left_anti")
    each = stop_atr * F.col("atr")
    return df.select("asset", F.least(risk * equity / each, gross * equity / F.col("close") / 4).alias("qty"),
                     (F.col("close") - each).alias("stop"), F.col("close").alias("mark"), F.col("ts").alias("bar"))


def fresh_signals(signals: DataFrame, bars: DataFrame, way: int = -1) -> DataFrame:
    """Assets whose last bar has the signal and whose bar before it has not."""
    df = bars.select("asset", "ts", "close").join(signals, ["asset", "ts"], "left").withColumn("side", F.coalesce("side", F.lit(0)))
    before = F.lag("side").over(own())
    df = df.withColumn("_before", before)
    last = df.groupBy("asset").agg(F.max_by(F.struct("ts", "close", "side", "_before"), "ts").alias("r")).select("asset", "r.*")
    return last.filter((F.col("side") == way) & (F.col("_before") != way)).select("asset", "ts", F.col("close").alias("spot"))


def asset_snapshot(features: DataFrame, signals: DataFrame, week: int = 1, month: int = 4) -> DataFrame:
    """Last row per asset: close, one-week and one-month return, side of the long mean, ADX, active signals.

    `signals(asset, ts, strategy, side)`.
    """
    df = features.withColumns({"r_week": F.col("close") / bars_ago("close", week) - 1, "r_month": F.col("close") / bars_ago("close", month) - 1})
    cols = ["ts", "close", "r_week", "r_month", "sma_long", "adx"]
    last = df.groupBy("asset").agg(F.max_by(F.struct(*cols), "ts").alias("r")).select("asset", "r.*")
    active = signals.groupBy("asset", "ts").agg(F.concat_ws(",", F.sort_array(F.collect_set("strategy"))).alias("active"))
    return last.join(active, ["asset", "ts"], "left").select(
        "asset", "ts", "close", "r_week", "r_month", (F.col("close") > F.col("sma_long")).alias("above"), "adx", F.coalesce("active", F.lit("")).alias("active"))


def strategy_cross(assets: DataFrame, strategies: list[str], session_only: set[str], news_only: set[str]) -> DataFrame:
    """Every strategy for every asset, except session strategies on round-the-clock assets and news strategies without a
    tone series. `assets(asset, around_the_clock, has_tone)`; strategies are a short fixed list."""
    df = assets.select("*", F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy"))
    return df.filter(~(F.col("strategy").isin(*session_only) & F.col("around_the_clock")) & ~(F.col("strategy").isin(*news_only) & ~F.col("has_tone"))).select("asset", "strategy")
