"""C: rolling indicators."""

from pyspark.sql import functions as F

from ..functions.windows import bars_ago
from ..operators import bars as B
from ..operators import features as C
from ..sources import bindings as S
from .catalog import cte, query
from .shapes import ewm_cte

W = "(partition by asset order by ts rows between {0} preceding and {1})"


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def win(n, shift=0):
    end = "current row" if shift == 0 else f"{shift} preceding"
    return W.format(n - 1 + shift, end)


@query("c1_sma", f"""select asset, ts, case when count(close) over {win(20)} >= 20 then round(avg(close) over {win(20)}, 6) end as sma20,
  case when count(close) over {win(50)} >= 50 then round(avg(close) over {win(50)}, 6) end as sma50 from bars_w""")
def c1(spark, sf):
    return S.weekly_bars(spark, sf).select("asset", "ts", F.round(C.sma("close", 20), 6).alias("sma20"), F.round(C.sma("close", 50), 6).alias("sma50"))


@query("c2_atr", "select asset, ts, round(tr, 6) as tr, round(case when t.bn >= 14 then r.e end, 6) as atr from tr_w t join e_tr_w_tr_14 r using (asset, bn)")
def c2(spark, sf):
    return C.with_atr(S.weekly_bars(spark, sf)).select("asset", "ts", F.round(C.true_range(), 6).alias("tr"), *r6("atr"))


cte("mv_w", """select asset, ts, bn, close, greatest(d, 0) as up, greatest(-d, 0) as dn from (select asset, ts, close,
  close - lag(close) over (partition by asset order by ts) as d, row_number() over (partition by asset order by ts) - 1 as bn from bars_w) where bn >= 1""")


def rsi_cte(n):
    ewm_cte("mv_w", "up", n)
    ewm_cte("mv_w", "dn", n)
    return cte(f"rsi_w_{n}", f"""select m.asset, m.ts, case when m.bn < {n} then null when l.e = 0 then 100.0 else 100 - 100 / (1 + g.e / l.e) end as rsi
      from mv_w m join e_mv_w_up_{n} g on g.asset = m.asset and g.bn = m.bn join e_mv_w_dn_{n} l on l.asset = m.asset and l.bn = m.bn""")


for _n in (2, 14):
    rsi_cte(_n)


@query("c3_rsi", "select b.asset, b.ts, round(r.rsi, 6) as rsi from bars_w b left join rsi_w_14 r using (asset, ts)")
def c3(spark, sf):
    return C.with_rsi(S.weekly_bars(spark, sf), 14).select("asset", "ts", *r6("rsi"))


@query("c4_bollinger", f"""select asset, ts, round(m - 2 * s, 6) as lower, round(m, 6) as mid, round(m + 2 * s, 6) as upper from (
  select asset, ts, case when count(*) over {win(20)} >= 20 then avg(close) over {win(20)} end as m, stddev_pop(close) over {win(20)} as s from bars_w)""")
def c4(spark, sf):
    lo, mid, hi = C.bollinger()
    return S.weekly_bars(spark, sf).select("asset", "ts", F.round(lo, 6).alias("lower"), F.round(mid, 6).alias("mid"), F.round(hi, 6).alias("upper"))


cte("dm_w", """select asset, ts, bn, tr, case when up > dn and up > 0 then up else 0 end as pdm, case when dn > up and dn > 0 then dn else 0 end as mdm
  from (select *, high - lag(high) over (partition by asset order by ts) as up, lag(low) over (partition by asset order by ts) - low as dn from tr_w)""")
for _c in ("tr", "pdm", "mdm"):
    ewm_cte("dm_w", _c, 14)
cte("dx_w", """select asset, ts, bn0, row_number() over (partition by asset order by ts) as bn, dx from (
  select d.asset, d.ts, d.bn as bn0, 100 * abs(100 * p.e / t.e - 100 * m.e / t.e) / nullif(100 * p.e / t.e + 100 * m.e / t.e, 0) as dx
  from dm_w d join e_dm_w_tr_14 t on t.asset = d.asset and t.bn = d.bn join e_dm_w_pdm_14 p on p.asset = d.asset and p.bn = d.bn
  join e_dm_w_mdm_14 m on m.asset = d.asset and m.bn = d.bn where d.bn >= 14) where dx is not null""")
ewm_cte("dx_w", "dx", 14)
cte("adx_w", "select d.asset, d.ts, case when d.bn >= 14 then r.e end as adx from dx_w d join e_dx_w_dx_14 r on r.asset = d.asset and r.bn = d.bn")


@query("c5_adx", "select b.asset, b.ts, round(a.adx, 6) as adx from bars_w b left join adx_w a using (asset, ts)")
def c5(spark, sf):
    return C.with_adx(S.weekly_bars(spark, sf)).select("asset", "ts", *r6("adx"))


@query("c6_donchian", f"""select asset, ts, case when count(*) over {win(20, 1)} >= 20 then round(max(high) over {win(20, 1)}, 6) end as upper,
  case when count(*) over {win(20, 1)} >= 20 then round(min(low) over {win(20, 1)}, 6) end as lower from bars_w""")
def c6(spark, sf):
    return S.weekly_bars(spark, sf).select("asset", "ts", F.round(C.prior_high(20), 6).alias("upper"), F.round(C.prior_low(20), 6).alias("lower"))


cte("bb_w", f"""select asset, ts, close, m - 2 * s as lower, m + 2 * s as upper, case when m is not null then 4 * s / m end as width from (
  select asset, ts, close, case when count(*) over {win(20)} >= 20 then avg(close) over {win(20)} end as m,
  case when count(*) over {win(20)} >= 20 then stddev_pop(close) over {win(20)} end as s from bars_w)""")
cte("bbq_w", f"""select *, case when count(width) over {win(100)} >= 100 then quantile_cont(width, 0.2) over {win(100)} end as q from bb_w""")


@query("c7_rolling_quantile", "select asset, ts, round(width, 6) as width, round(q, 6) as q20 from bbq_w")
def c7(spark, sf):
    lo, mid, hi = C.bollinger()
    df = S.weekly_bars(spark, sf).withColumn("width", (hi - lo) / mid)
    return df.select("asset", "ts", F.round("width", 6).alias("width"), F.round(C.rolling_quantile("width", 100, 0.2), 6).alias("q20"))


cte("ap_w", "select *, atr / close as atr_pct from atr_w")
cte("vr_w", """select a.asset, a.ts, case when count(b.atr_pct) >= 50 then (count(*) filter (where b.atr_pct < a.atr_pct)
  + (count(*) filter (where b.atr_pct = a.atr_pct) + 1) / 2) / count(b.atr_pct) end as vol_rank
  from ap_w a join ap_w b on a.asset = b.asset and b.bn between a.bn - 249 and a.bn where a.atr_pct is not null group by 1, 2""")


@query("c8_vol_rank", "select a.asset, a.ts, round(v.vol_rank, 6) as vol_rank from ap_w a left join vr_w v using (asset, ts)")
def c8(spark, sf):
    df = C.with_atr(S.weekly_bars(spark, sf)).withColumn("atr_pct", F.col("atr") / F.col("close"))
    return df.select("asset", "ts", F.round(C.window_rank("atr_pct", 250, 50), 6).alias("vol_rank"))


cte("feat_w", f"""select a.asset, a.ts, a.open, a.high, a.low, a.close, a.volume, a.bn, a.atr, x.adx, v.vol_rank, r.rsi as rsi14, a.atr_pct,
  case when count(*) over {win(200)} >= 200 then avg(close) over {win(200)} end as sma_long,
  (close - case when count(*) over {win(200)} >= 200 then avg(close) over {win(200)} end) / atr as dist_long,
  (close - case when count(*) over {win(50)} >= 50 then avg(close) over {win(50)} end) / atr as dist_mid,
  (close - lag(close, 5) over (partition by asset order by ts)) / atr as ret5,
  (close - lag(close, 20) over (partition by asset order by ts)) / atr as ret20
  from ap_w a left join adx_w x using (asset, ts) left join vr_w v using (asset, ts) left join rsi_w_14 r using (asset, ts)""")
FEATS = ["atr_pct", "adx", "vol_rank", "rsi14", "sma_long", "dist_long", "dist_mid", "ret5", "ret20"]


@query("c9_compute_features", "select asset, ts, " + ", ".join(f"round({c}, 6) as {c}" for c in FEATS) + " from feat_w")
def c9(spark, sf):
    return C.with_features(S.weekly_bars(spark, sf)).select("asset", "ts", *r6(*FEATS))




@query("c10_session_vwap", """select asset, ts, round(sum((high + low + close) / 3 * volume) over w / sum(volume) over w, 6) as vwap from hday
  window w as (partition by asset, day order by ts rows unbounded preceding)""")
def c10(spark, sf):
    return C.session_vwap(B.session_number(S.hourly_bars(spark, sf))).select("asset", "ts", *r6("vwap"))


cte("trend_h", """select asset, day, coalesce(lag(s) over (partition by asset order by day), 0) as trend from (
  select asset, day, case when c > m then 1 when c < m then -1 when c = m then 0 end as s from (select asset, day, c,
  case when count(*) over w >= 5 then avg(c) over w end as m from (select asset, day, last(close order by ts) as c from hday group by 1, 2)
  window w as (partition by asset order by day rows between 4 preceding and current row)))""")


@query("c11_daily_trend", "select asset, ts, trend from hday join trend_h using (asset, day)")
def c11(spark, sf):
    return C.daily_trend(B.session_number(S.hourly_bars(spark, sf)), 5).select("asset", "ts", "trend")


@query("c12_same_hour_volume", """select asset, ts, case when count(*) over w >= 3 then round(avg(volume) over w, 6) end as usual from bars_h
  window w as (partition by asset, hour(ts) order by ts rows between 20 preceding and 1 preceding)""")
def c12(spark, sf):
    return S.hourly_bars(spark, sf).select("asset", "ts", F.round(C.same_hour_volume(20, 3, F.hour("ts")), 6).alias("usual"))


cte("ret_w", "select *, close / lag(close) over (partition by asset order by ts) - 1 as ret from bars_w")
cte("retz_w", f"""select *, ret / nullif(case when count(ret) over {win(60, 1)} >= 40 then stddev_samp(ret) over {win(60, 1)} end, 0) as ret_z from ret_w""")


@query("c13_ret_z", "select asset, ts, round(ret, 8) as ret, round(ret_z, 6) as ret_z from retz_w")
def c13(spark, sf):
    return C.return_z(S.weekly_bars(spark, sf)).select("asset", "ts", F.round("ret", 8).alias("ret"), *r6("ret_z"))


def ses(n, shift=0, part="asset"):
    return f"(partition by {part} order by sno range between {n - 1 + shift} preceding and {str(shift) + ' preceding' if shift else 'current row'})"


def ago(k, c="close"):
    return f"max({c}) over (partition by asset order by sno range between {k} preceding and {k} preceding)"


cte("r1_w", f"select *, close / {ago(1)} - 1 as r1, ln(close / {ago(1)}) as lr1 from panel_s")
cte("vol_w", f"""select *, case when count(r1) over {ses(60)} >= 40 then stddev_samp(r1) over {ses(60)} end as vol,
  case when count(lr1) over {ses(60)} >= 40 then stddev_samp(lr1) over {ses(60)} end as lvol from r1_w""")


@query("c14_realised_vol", "select asset, ts, round(vol, 8) as vol, round(lvol, 8) as log_vol from vol_w")
def c14(spark, sf):
    df = C.with_realised_vol(S.sector_panel(spark, sf))
    return C.with_realised_vol(df, log=True, out="log_vol").select("asset", "ts", F.round("vol", 8).alias("vol"), F.round("log_vol", 8).alias("log_vol"))


@query("c15_high_distance", f"""select asset, ts, round(case when count(close) over {ses(52)} >= 40 then close / max(close) over {ses(52)} - 1 end, 8) as dist from panel_w""")
def c15(spark, sf):
    return S.panel(spark, sf).select("asset", "ts", F.round(C.high_distance(52, 40), 8).alias("dist"))


cte("mkt_w", "select ts, median(r1) as m from r1_w where r1 is not null group by 1")
cte("mktr_w", f"""select c.ts, m.m, case when count(m) over w >= 30 then avg(m) over w end as mm, case when count(m) over w >= 30 then var_pop(m) over w end as mv
  from cal_w c left join mkt_w m using (ts) window w as (order by sno range between 51 preceding and current row)""")
cte("beta0_w", f"""select p.*, k.m, case when count(r1) over {ses(52)} >= 30 then (avg(r1 * k.m) over {ses(52)} - avg(r1) over {ses(52)} * k.mm) / nullif(k.mv, 0) end as b from r1_w p left join mktr_w k using (ts)""")
cte("beta_w", f"select *, {ago(1, 'b')} as beta from beta0_w")
cte("resid_w", "select *, r1 - beta * m as residual from beta_w")


@query("c16_beta_residual", "select asset, ts, round(beta, 5) as beta, round(residual, 7) as residual from resid_w")
def c16(spark, sf):
    return C.beta_residual(S.sector_panel(spark, sf), 52, 30).select("asset", "ts", F.round("beta", 5).alias("beta"), F.round("residual", 7).alias("residual"))


cte("regret", """select sector as region, ts as day, avg(r1) as ret from r1_w where r1 is not null group by 1, 2""")
cte("regz", """select region, day, ret / nullif(case when count(ret) over w >= 20 then stddev_samp(ret) over w end, 0) as z, day + interval 6 hours as known_at
  from regret window w as (partition by region order by day rows between 59 preceding and current row)""")


@query("c17_global_move", """select b.asset, b.ts, round(z.z, 6) as z from (select d.asset, d.ts, s.sector as region from bars_d d join sect s using (asset)) b
  asof left join (select * from regz where z is not null) z on b.region = z.region and b.ts >= z.known_at""")
def c17(spark, sf):
    p = S.sector_panel(spark, sf).withColumn("r", F.col("close") / C.sessions_ago("close", 1) - 1).filter("r is not null")
    ret = p.groupBy(F.col("sector").alias("region"), F.col("ts").alias("day")).agg(F.avg("r").alias("ret"))
    bars = S.daily_bars(spark, sf).join(S.sectors(spark, sf), "asset").select("asset", F.col("sector").alias("region"), "ts")
    return C.global_move(ret, bars).select("asset", "ts", *r6("z"))
