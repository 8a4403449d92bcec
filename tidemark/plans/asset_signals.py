"""E: per-asset signals."""

from pyspark.sql import functions as F

from ..functions.windows import rolling
from ..operators import asset_signals as E
from ..operators import bars as B
from ..operators import features as C
from ..operators import pit as D
from ..sources import bindings as S
from .catalog import CTES, cte, query
from .features import win
from .pit import MASK, spells
from .shapes import ewm_cte


def full(agg, c, n, shift=0, t=""):
    """Aggregate over exactly n bars, else null."""
    return f"case when count({c}) over {win(n, shift)} >= {n} then {agg}({c}) over {win(n, shift)} end"


def fired(select, src):
    return f"select asset, ts, side from (select asset, ts, {select} as side from {src}) where side <> 0"


def two(up, down):
    return f"case when {up} then 1 when {down} then -1 else 0 end"


def donchian_sql(n, trend, src="bars_w"):
    return fired(two("close > hi and close > m", "close < lo and close < m"),
                 f"(select *, {full('max', 'high', n, 1)} as hi, {full('min', 'low', n, 1)} as lo, {full('avg', 'close', trend)} as m from {src})")


cte("e1_w", donchian_sql(10, 40))
cte("e3_w", fired(two("rsi < 15 and close > m", "rsi > 85 and close < m"), f"(select b.*, r.rsi, {full('avg', 'close', 40)} as m from bars_w b left join rsi_w_2 r using (asset, ts))"))
cte("e16_w", fired(two("low < lo and close > lo + 0.1 * atr", "high > hi and close < hi - 0.1 * atr"),
                   f"(select *, {full('min', 'low', 5, 1)} as lo, {full('max', 'high', 5, 1)} as hi from atr_w)"))


def donchian(spark, sf):
    return E.donchian_breakout(S.weekly_bars(spark, sf), 10, 40)


def sweeps(spark, sf):
    return E.liquidity_sweep(S.weekly_bars(spark, sf), 5, 0.1)


@query("e1_donchian_breakout", "select * from e1_w")
def e1(spark, sf):
    return donchian(spark, sf)


@query("e2_squeeze_breakout", fired(two("close > upper and recent = 1", "close < lower and recent = 1"),
       "(select *, case when count(*) over w >= 10 then max(tight) over w end as recent from (select *, case when width <= q then 1 else 0 end as tight from bbq_w) "
       "window w as (partition by asset order by ts rows between 10 preceding and 1 preceding))"))
def e2(spark, sf):
    return E.squeeze_breakout(S.weekly_bars(spark, sf), 20, 2.0, 100, 0.2, 10)


@query("e3_rsi2_reversion", "select * from e3_w")
def e3(spark, sf):
    return E.rsi_reversion(S.weekly_bars(spark, sf), 2, 15.0, 40)


cte("nz_w", """select asset, ts, lag(az) over (partition by asset order by ts) as attention_z, lag(tz) over (partition by asset order by ts) as tone_z from (
  select asset, ts, (n - avg(n) over w) / nullif(stddev_samp(n) over w, 0) as az, (tone - avg(tone) over w) / nullif(stddev_samp(tone) over w, 0) as tz from (
  select l_suppkey as asset, cast(date_trunc('week', l_shipdate) as date) as ts, count(*) as n, avg(sqrt(l_discount)) as tone from lineitem group by 1, 2)
  window w as (partition by asset order by ts rows between 25 preceding and current row))""")


NZ_ROUNDED = CTES["nz_w"].replace("avg(sqrt(l_discount))", "round(avg(sqrt(l_discount)), 12)")
for _c, _z in (("n", "az"), ("tone", "tz")):
    NZ_ROUNDED = NZ_ROUNDED.replace(f"({_c} - avg({_c}) over w) / nullif(stddev_samp({_c}) over w, 0) as {_z}", f"round(({_c} - avg({_c}) over w) / nullif(round(stddev_samp({_c}) over w, 9), 0), 6) as {_z}")


def line_news(spark, sf, rounded=False):
    """Weekly counts and tones of lines as scores. `rounded`: a deviation of zero to nine places is none, and scores have six
    places, so that a score at a limit does not depend on the order of sums."""
    w = S.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("asset"), F.date_trunc("week", "l_shipdate").cast("date").alias("ts")).agg(
        F.count("*").alias("n"), F.avg(F.sqrt("l_discount")).alias("tone"))
    if rounded:
        w = w.withColumn("tone", F.round("tone", 12))
    return news_scores(w, rounded).select("asset", "ts", "attention_z", "tone_z")


def news_scores(w, rounded=False):
    """Scores of the counts `n` and tones `tone` of an asset's weeks, as known a week later."""
    def z(c):
        if rounded:
            return F.round((F.col(c) - rolling(F.avg, c, 26, 1)) / F.nullif(F.round(rolling(F.stddev_samp, c, 26, 1), 9), F.lit(0.0)), 6)
        return (F.col(c) - rolling(F.avg, c, 26, 1)) / F.nullif(rolling(F.stddev_samp, c, 26, 1), F.lit(0.0))
    from ..functions.windows import bars_ago
    return w.withColumns({"az": z("n"), "tz": z("tone")}).withColumns({"attention_z": bars_ago("az", 1), "tone_z": bars_ago("tz", 1)}).drop("az", "tz")


@query("e4_news_momentum", fired(two("attention_z > 1 and tone_z > 0.3 and close > m", "attention_z > 1 and tone_z < -0.3 and close < m"),
       f"(select b.*, n.attention_z, n.tone_z, {full('avg', 'close', 20)} as m from bars_w b join nz_e4 n using (asset, ts))"), nz_e4=NZ_ROUNDED)
def e4(spark, sf):
    return E.news_momentum(S.weekly_bars(spark, sf), line_news(spark, sf, True), 1.0, 0.3, 20)


cte("hk", "select *, row_number() over (partition by asset, day order by ts) - 1 as k, row_number() over (partition by asset order by ts) as bn from hday")
cte("tr_h", "select *, greatest(high - low, abs(high - pc), abs(low - pc)) as tr from (select *, lag(close) over (partition by asset order by ts) as pc from hk)")
ewm_cte("tr_h", "tr", 14)
cte("hk_atr", """select t.*, case when t.bn >= 14 then r.e end as atr, sum((high + low + close) / 3 * volume) over w / sum(volume) over w as vwap,
  first(close - open) over w as body from tr_h t join e_tr_h_tr_14 r on r.asset = t.asset and r.bn = t.bn window w as (partition by t.asset, t.day order by t.ts rows unbounded preceding)""")


def session_bars(spark, sf):
    return B.session_number(S.hourly_bars(spark, sf))


def orb_sql(n, last=10 ** 6):
    return f"""select asset, ts, side from (select *, sum(abs(side)) over (partition by asset, day order by ts) as nth from (select *,
      case when k >= {n} and k < {last} and close > hi then 1 when k >= {n} and k < {last} and close < lo then -1 else 0 end as side from (
      select *, max(case when k < {n} then high end) over (partition by asset, day) as hi, min(case when k < {n} then low end) over (partition by asset, day) as lo from hk))) where side <> 0 and nth = 1"""


@query("e5_opening_range", orb_sql(2))
def e5(spark, sf):
    return E.opening_range(session_bars(spark, sf), 2)


@query("e6_vwap_reversion", fired(two("(close - vwap) / atr < -0.2 and close > m", "(close - vwap) / atr > 0.2 and close < m"), f"(select *, {full('avg', 'close', 20)} as m from hk_atr)"))
def e6(spark, sf):
    return E.vwap_reversion(session_bars(spark, sf), 0.2, 20)


@query("e7_with_trend", f"select o.asset, o.ts, o.side from ({orb_sql(1)}) o join hday h using (asset, ts) join trend_h t on t.asset = h.asset and t.day = h.day where o.side * t.trend > 0")
def e7(spark, sf):
    bars = session_bars(spark, sf)
    return E.with_trend(E.opening_range(bars, 1), C.daily_trend(bars, 5)).select("asset", "ts", "side")


@query("e8_orb15", orb_sql(1, 4))
def e8(spark, sf):
    return E.opening_range(session_bars(spark, sf), 1, 4)


@query("e9_vwap_fade", fired(two("k >= 1 and (close - vwap) / atr < -0.5", "k >= 1 and (close - vwap) / atr > 0.5"), "hk_atr"))
def e9(spark, sf):
    return E.vwap_fade(session_bars(spark, sf), 0.5, 1)


@query("e10_range_break", fired(two("close > hi and volume > 1.2 * v", "close < lo and volume > 1.2 * v"),
       f"(select *, {full('max', 'high', 12, 1)} as hi, {full('min', 'low', 12, 1)} as lo, {full('avg', 'volume', 12, 1)} as v from bars_w)"))
def e10(spark, sf):
    return E.range_break(S.weekly_bars(spark, sf), 12, 1.2)


@query("e11_rsi2_averages", fired(two("rsi < 5 and coalesce(f > s, false)", "rsi > 95 and not coalesce(f > s, false)"),
       f"(select b.*, r.rsi, {full('avg', 'close', 12)} as f, {full('avg', 'close', 48)} as s from bars_w b left join rsi_w_2 r using (asset, ts))"))
def e11(spark, sf):
    return E.rsi_with_averages(S.weekly_bars(spark, sf))


@query("e12_intraday_momentum", fired("case when k = 2 and abs(body / atr) > 0.1 then cast(sign(body / atr) as int) else 0 end", "hk_atr"))
def e12(spark, sf):
    return E.intraday_momentum(session_bars(spark, sf), 0.1, 2)


cte("gap_h", "select *, (open - pc) / atr as gap, (close - pc) / atr as move from hk_atr")


@query("e13_gap_fade", fired(two("k = 0 and gap < -0.5", "k = 0 and gap > 0.5"), "gap_h"))
def e13(spark, sf):
    return E.gap_fade(session_bars(spark, sf), 0.5)


@query("e14_earnings_drift", fired("case when abs(move) > 0.3 then cast(sign(move) as int) else 0 end",
       "(select * from gap_h g where k = 0 and exists (select 1 from blk_ev e where e.asset = g.asset and g.day - e.day in (0, 1)))"))
def e14(spark, sf):
    ev = S.table(spark, sf, "events").filter("event_type = 'signup' and day(ts) % 3 = 0").select(F.col("user_id").alias("asset"), F.col("ts").cast("date").alias("day"))
    return E.earnings_drift(session_bars(spark, sf), ev, 0.3)


@query("e15_volume_breakout", fired(two("close > hi and volume > 1.0 * u", "close < lo and volume > 1.0 * u"),
       f"""(select *, {full('max', 'high', 10, 1)} as hi, {full('min', 'low', 10, 1)} as lo, case when count(*) over w >= 2 then avg(volume) over w end as u from bars_h
       window w as (partition by asset, hour(ts) order by ts rows between 20 preceding and 1 preceding))"""))
def e15(spark, sf):
    return E.volume_breakout(S.hourly_bars(spark, sf), 10, 1.0, 2)


@query("e16_liquidity_sweep", "select * from e16_w")
def e16(spark, sf):
    return sweeps(spark, sf)


@query("e17_leader_lag", fired(two("b > 0.5 and z < 0.5 * b", "b < -0.5 and z > 0.5 * b"),
       "(select f.asset, f.ts, (f.close - f.open) / f.atr as z, (l.close - l.open) / l.atr as b from atr_w f join atr_w l on l.ts = f.ts and l.asset = 0 where f.asset <> 0)"))
def e17(spark, sf):
    return E.leader_lag(S.weekly_bars(spark, sf), F.lit(0), 0.5)


cte("trend_w", f"select asset, ts, cast(sign(close - {full('avg', 'close', 10)}) as int) as trend from bars_w")


@query("e18_signals_filtered", f"select b.asset, b.ts, b.side from e16_w b join trend_w t using (asset, ts) where b.side * t.trend > 0 and b.side > 0 and {MASK.format(d='b.ts')}")
def e18(spark, sf):
    bars = S.weekly_bars(spark, sf)
    trend = bars.select("asset", "ts", F.signum(F.col("close") - C.sma("close", 10)).alias("trend"))
    return E.filtered(sweeps(spark, sf), bars, trend, True, D.membership_mask(bars, spells(spark, sf))).select("asset", "ts", "side")


def uniform_sql(seed, *parts):
    total = f"{seed * 1299709}" + "".join(f" + cast({p} as bigint) * {m}" for p, m in zip(parts, (7919, 104729, 15485863)))
    return f"((({total}) * 48271 + 11) % 1000003 / 1000003)"


def cubed_sql(x):
    return f"(({x}) * ({x}) % {E.MIX_PRIME} * ({x}) % {E.MIX_PRIME})"


def mixed_sql(seed, *parts):
    x = str(seed * 1299709)
    for p, m in zip(parts, (7919, 104729, 15485863)):
        x = cubed_sql(f"({x} + cast({p} as bigint) * {m}) % {E.MIX_PRIME}")
    return x


def mixed_uniform_sql(x):
    return "(" + cubed_sql(f"({x} * 48271 + 11) % {E.MIX_PRIME}") + f" / {E.MIX_PRIME})"


DAYNO = "date_diff('day', date '1970-01-01', ts)"


@query("e19_random_twin", f"""select asset, ts, case when {uniform_sql(8, 'asset', DAYNO)} < 0.5 then 1 else -1 end as side from (
  select b.asset, b.ts, count(s.side) over (partition by b.asset) / count(*) over (partition by b.asset) as rate from bars_w b left join e16_w s using (asset, ts)) where {uniform_sql(7, 'asset', DAYNO)} < rate""")
def e19(spark, sf):
    return E.random_twin(sweeps(spark, sf), S.weekly_bars(spark, sf), 7)


cte("e10l", "select asset, ts, 1 as side from (select asset, ts, close > lag(close) over (partition by asset order by ts) as up from bars_w) where up")


@query("e20_pending_entries", """select asset, round(least(0.005 * 100000 / (2 * atr), 2 * 100000 / close / 4), 6) as qty, round(close - 2 * atr, 6) as stop, round(close, 6) as mark, ts as bar from atr_w a
  where ts = (select max(ts) from bars_w) and atr > 0 and exists (select 1 from e10l e where e.asset = a.asset and e.ts = a.ts) and asset not in (select s_suppkey from supplier where s_acctbal < 0)""")
def e20(spark, sf):
    from ..functions.windows import bars_ago
    bars = S.weekly_bars(spark, sf)
    up = bars.select("asset", "ts", F.when(F.col("close") > bars_ago("close", 1), 1).otherwise(0).alias("side")).filter("side > 0")
    held = S.table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("asset"))
    p = E.pending_entries(up, bars, held, 100000.0, 0.005, 2.0, 2.0)
    return p.select("asset", *[F.round(c, 6).alias(c) for c in ("qty", "stop", "mark")], "bar")


@query("e21_fresh_signals", """select asset, ts, round(close, 6) as spot from (select asset, ts, close, case when close < pc then -1 else 0 end as s, lag(case when close < pc then -1 else 0 end) over (partition by asset order by ts) as p,
  row_number() over (partition by asset order by ts desc) as back from (select *, lag(close) over (partition by asset order by ts) as pc from bars_w)) where back = 1 and s = -1 and p <> -1""")
def e21(spark, sf):
    from ..functions.windows import bars_ago
    bars = S.weekly_bars(spark, sf)
    down = bars.select("asset", "ts", F.when(F.col("close") < bars_ago("close", 1), -1).otherwise(0).alias("side")).filter("side < 0")
    return E.fresh_signals(down, bars).select("asset", "ts", F.round("spot", 6).alias("spot"))


@query("e22_asset_snapshot", """select asset, f.ts, round(close, 6) as close, round(r_week, 8) as r_week, round(r_month, 8) as r_month, close > sma_long as above, round(adx, 6) as adx, coalesce(active, '') as active from (
  select *, close / lag(close) over w - 1 as r_week, close / lag(close, 4) over w - 1 as r_month, row_number() over (partition by asset order by ts desc) as back from feat_w window w as (partition by asset order by ts)) f
  left join (select asset, ts, string_agg(strategy, ',' order by strategy) as active from (select distinct asset, ts, strategy from (select asset, ts, 'donchian' as strategy from e1_w union all select asset, ts, 'sweep' from e16_w)) group by 1, 2) a using (asset, ts) where back = 1""")
def e22(spark, sf):
    bars = S.weekly_bars(spark, sf)
    feats = C.with_adx(bars).withColumn("sma_long", C.sma("close", 200))
    sig = donchian(spark, sf).withColumn("strategy", F.lit("donchian")).unionByName(sweeps(spark, sf).withColumn("strategy", F.lit("sweep")))
    return E.asset_snapshot(feats, sig).select("asset", "ts", F.round("close", 6).alias("close"), F.round("r_week", 8).alias("r_week"), F.round("r_month", 8).alias("r_month"),
                                               "above", F.round("adx", 6).alias("adx"), "active")


STRATEGIES = ["donchian", "squeeze", "rsi2", "opening_range", "vwap", "news"]


@query("e23_strategy_cross", f"""select s_suppkey as asset, strategy from supplier, (select unnest({STRATEGIES}) as strategy)
  where not (strategy in ('opening_range') and s_nationkey % 5 = 0) and not (strategy = 'news' and s_acctbal < 0)""")
def e23(spark, sf):
    a = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("asset"), (F.col("s_nationkey") % 5 == 0).alias("around_the_clock"), (F.col("s_acctbal") >= 0).alias("has_tone"))
    return E.strategy_cross(a, STRATEGIES, {"opening_range"}, {"news"})
