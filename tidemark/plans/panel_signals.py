"""F: cross-sectional signals. Weekly bars, so a year is 52 sessions and every session is a decision day."""

from pyspark.sql import functions as F

from ..operators import panel_signals as P
from ..session import materialise
from ..sources import bindings as S
from .catalog import cte, query
from .features import ago, ses


def pct(c, part="ts", desc=False):
    d = "desc nulls last" if desc else "asc nulls last"
    return (f"case when {c} is not null then (rank() over (partition by {part} order by {c} {d}) + (count(*) over (partition by {part}, {c}) - 1) / 2) "
            f"/ count({c}) over (partition by {part}) end")


def avg_rank(c, part="ts", desc=False):
    d = "desc nulls last" if desc else "asc nulls last"
    return f"case when {c} is not null then rank() over (partition by {part} order by {c} {d}) + (count(*) over (partition by {part}, {c}) - 1) / 2 end"


def enter(mask, src, key="asset", cols="asset, ts"):
    prev = f"max(m_) over (partition by {key} order by sno range between 1 preceding and 1 preceding)"
    return f"select {cols} from (select *, m_ = 1 and coalesce({prev}, 0) = 0 as e_ from (select *, case when {mask} then 1 else 0 end as m_ from {src})) where e_"


def full_ses(agg, c, n, least=None, shift=0):
    return f"case when count({c}) over {ses(n, shift)} >= {least or n} then {agg}({c}) over {ses(n, shift)} end"


def one(body):
    return f"select asset, ts, 1 as side from ({body})"


cte("fx_w", f"""select p.*, {ago(4)} / {ago(52)} - 1 as mom, close / {ago(1)} - 1 as r1, close / {ago(2)} - 1 as rb, close / {ago(12)} - 1 as rw, close / {ago(6)} - 1 as r6,
  {full_ses('avg', 'close', 4)} as mean, {full_ses('avg', 'close * volume', 12, 8)} as dollar, ln(open / {ago(1)}) as night, close / {ago(26)} - 1 as r26,
  ts = max(ts) over (partition by date_trunc('month', ts)) as me from panel_s p""")
cte("fv_w", f"select *, {full_ses('stddev_samp', 'r1', 26, 13)} as vol, {full_ses('stddev_samp', 'ln(1 + r1)', 4)} as lvol, {full_ses('sum', 'night', 6)} as nights from fx_w")
cte("calm_w", f"select *, {pct('vol')} as calm from fv_w")
cte("secmed_w", "select ts, sector, max(sno) as sno, count(*) as n, median(rw) as mw, median(rb) as mb from fx_w group by 1, 2")
cte("turn_w", enter("mw <= -0.004 and mb > 0", "secmed_w", "sector", "ts, sector"))
cte("wash_w", "select f.* from calm_w f join turn_w t using (ts, sector)")


def PAN(spark, sf):
    """The panel, written once: ranks and medians read it several times."""
    return materialise(S.sector_panel(spark, sf), "panel")


@query("f1_xs_momentum", one(enter("rank <= 8", f"(select *, {avg_rank('rw', desc=True)} as rank from fx_w)")))
def f1(spark, sf):
    return P.xs_top(PAN(spark, sf), 12, 8)


@query("f2_xs_reversal", one(enter("rank <= 8", f"(select *, {avg_rank('rb')} as rank from fx_w)")))
def f2(spark, sf):
    return P.xs_top(PAN(spark, sf), 2, 8, best=False)


cte("mom_w", f"select * from (select *, {pct('mom', desc=True)} as mrank from fx_w where me) where mrank <= 0.2")


@query("f3_momentum_12_1", one("select * from mom_w"))
def f3(spark, sf):
    return P.momentum_month_end(PAN(spark, sf), 52, 4, 0.2)


@query("f4_reversal_5d", one(f"select * from (select *, {pct('r1')} as rank from fx_w) where rank <= 0.1"))
def f4(spark, sf):
    return P.short_reversal(PAN(spark, sf), 1, 0.1, None)


@query("f5_high_52w", one(f"""select * from (select *, max(near) over (partition by asset order by sno range between 4 preceding and 1 preceding) as before from (
  select *, case when close >= 0.99 * ({full_ses('max', 'close', 52, 30)}) then 1 else 0 end as near from panel_w)) where near = 1 and coalesce(before, 0) = 0"""))
def f5(spark, sf):
    return P.near_high(PAN(spark, sf), 0.01, 52, 30, 4)


@query("f6_sector_momentum", one("""select f.* from fx_w f join (select ts, sector, row_number() over (partition by ts order by med desc, sector) as rank from (
  select ts, sector, median(mom) as med from fx_w where me and mom is not null group by 1, 2)) s using (ts, sector) where f.me and s.rank <= 2 and f.close > f.mean"""))
def f6(spark, sf):
    return P.sector_momentum(PAN(spark, sf), 52, 4, 2, 4)


@query("f7_sector_median", "select ts, sector, round(median(rw), 8) as med from fx_w where rw is not null group by 1, 2")
def f7(spark, sf):
    from ..functions.windows import session_return
    df = PAN(spark, sf).withColumn("r", session_return(12))
    return P.sector_medians(df, "r", "med").select("ts", "sector", F.round("med", 8).alias("med"))


@query("f8_sector_reversal", one(f"select * from (select *, {pct('rel')} as rank from (select f.*, f.r1 - m.med as rel from fx_w f left join (select ts, sector, median(r1) as med from fx_w group by 1, 2) m using (ts, sector))) where rank <= 0.1"))
def f8(spark, sf):
    return P.sector_reversal(PAN(spark, sf), 1, 0.1, None)


@query("f9_sector_washout", one("select * from wash_w"))
def f9(spark, sf):
    return P.sector_washout(PAN(spark, sf), 0.004, 2, 12)


@query("f10_stock_washout", one(enter("rw <= -0.01 and rb > 0 and smb > 0", "(select f.*, m.mb as smb from fx_w f left join secmed_w m using (ts, sector))")))
def f10(spark, sf):
    return P.stock_washout(PAN(spark, sf), 0.01, 2, 12)


cte("size_w", f"select *, {pct('dollar', 'ts, sector')} as size from fx_w")


@query("f11_lead_lag_sector", one(enter("lead >= 0.005 and size <= 2 / 3 and rb <= 0", """(select z.*, l.lead from size_w z left join (select ts, sector, median(rb) as lead from size_w where size > 2 / 3 group by 1, 2) l using (ts, sector)
  where sector in (select sector from panel_s group by 1 having count(distinct asset) >= 3))""")))
def f11(spark, sf):
    return P.lead_lag_sector(PAN(spark, sf), 0.005, 2, 12, 8)


@query("f12_calm_filter", "select asset, ts from calm12 where calm <= 0.3", calm12=f"select *, {pct('round(vol, 12)')} as calm from fv_w")
def f12(spark, sf):
    return P.calm(PAN(spark, sf), 0.3, 26, 13, 12)


@query("f13_sector_washout_calm", one("select * from wash_w where calm <= 0.5"))
def f13(spark, sf):
    p = PAN(spark, sf)
    return P.only(P.sector_washout(p, 0.004, 2, 12), P.calm(p, 0.5, 26, 13)).select("asset", "ts", "side")


@query("f14_sector_washout_leaders", one(f"select * from (select *, {pct('rw', 'ts, sector', True)} as rank from fx_w) join turn_w using (ts, sector) where rank <= 0.5"))
def f14(spark, sf):
    return P.washout_leaders(PAN(spark, sf), 0.004, 2, 12, 0.5)


@query("f15_sector_size_washout", one("select z.* from grp_w z join (" + enter("n >= 3 and mw <= -0.004 and mb > 0", "(select ts, sector, grp, max(sno) as sno, count(*) as n, median(rw) as mw, median(rb) as mb from grp_w group by 1, 2, 3)",
       "sector, grp", "ts, sector, grp") + ") t using (ts, sector, grp)"), grp_w=f"select *, cast(ceil(size * 3) as int) as grp from (select *, {pct('round(dollar, 6)', 'ts, sector')} as size from fx_w) where size is not null")
def f15(spark, sf):
    return P.size_washout(PAN(spark, sf), 0.004, 2, 12, 3, 12, 8)


@query("f16_sector_washout_calmest", one("select * from (select *, row_number() over (partition by ts, sector order by vol, asset) as rank from wash_w where vol is not null) where rank <= 3"))
def f16(spark, sf):
    return P.washout_calmest(PAN(spark, sf), 0.004, 2, 12, 3, 26, 13)


@query("f17_momentum_pullback", one(f"select * from (select *, {pct('mom', desc=True)} as p1, {pct('r1')} as p2 from fx_w) where p1 <= 0.3 and p2 <= 0.3"))
def f17(spark, sf):
    return P.momentum_pullback(PAN(spark, sf), 52, 4, 0.3, 1, 0.3, None)


@query("f18_momentum_low_vol", one(f"select * from (select *, {pct('mom', desc=True)} as p1, {pct('round(lvol, 12)')} as p2 from fv_w where me) where p1 <= 0.3 and p2 <= 0.5"))
def f18(spark, sf):
    return P.momentum_low_vol(PAN(spark, sf), 52, 4, 0.3, 0.5, 4)


@query("f20_low_vol_monthly", one(f"select * from (select *, {pct('vol')} as calm2 from fv_w where me) where calm2 <= 0.3 and close > mean"))
def f20(spark, sf):
    return P.low_vol_monthly(PAN(spark, sf), 0.3, 26, 13, 4)


@query("f21_turn_of_month", one("select c.* from calm_w c join (select ts, row_number() over (partition by date_trunc('month', ts) order by ts desc) - 1 as ahead from cal_w) l using (ts) where ahead = 1 and calm <= 0.3 and close > mean"))
def f21(spark, sf):
    return P.turn_of_month(PAN(spark, sf), 1, 0.3, 26, 13, 4)


cte("stress_w", """select ts from (select *, lag(bad) over (order by sno) as pb from (select c.ts, c.sno, coalesce(m.med <= -0.002, false) as bad from cal_w c left join (
  select ts, median(rb) as med from fx_w group by 1) m using (ts))) where bad and not coalesce(pb, false)""")


@query("f22_stress_calm_leaders", one("select c.* from calm_w c where ts in (select ts from stress_w) and calm <= 0.3 and close > mean"))
def f22(spark, sf):
    return P.stress_calm_leaders(PAN(spark, sf), 0.002, 2, 0.3, 26, 13, 4)


cte("rscore_w", f"select *, ({full_ses('sum', 'residual', 48, 24)}) / nullif({full_ses('stddev_samp', 'residual', 48, 24)}, 0) as score from resid_w")


@query("f23_residual_momentum", one(f"select * from (select *, {pct('round(past, 6)', desc=True)} as rank from (select *, {ago(4, 'score')} as past, ts = max(ts) over (partition by date_trunc('month', ts)) as me from rscore52) where me) where rank <= 0.2"),
       rscore52=f"select *, ({full_ses('sum', 'residual', 48, 24)}) / nullif({full_ses('stddev_samp', 'residual', 48, 24)}, 0) as score from (select *, r1 - {ago(1, 'b')} * m as residual from (select p.*, k.m, case when count(r1) over {ses(52)} >= 26 then (avg(r1 * k.m) over {ses(52)} - avg(r1) over {ses(52)} * k.mm) / nullif(k.mv, 0) end as b from r1_w p left join (select c.ts, m.m, case when count(m) over w >= 26 then avg(m) over w end as mm, case when count(m) over w >= 26 then var_pop(m) over w end as mv from cal_w c left join mkt_w m using (ts) window w as (order by sno range between 51 preceding and current row)) k using (ts)))")
def f23(spark, sf):
    return P.residual_momentum(PAN(spark, sf), 0.2, 52, 4)


cte("me_w", "select f.*, dense_rank() over (order by ts) as mno from fx_w f where me")


def mago(k):
    return f"max(close) over (partition by asset order by mno range between {k} preceding and {k} preceding)"


@query("f24_same_month_seasonality", one(f"select * from (select *, {pct('score', desc=True)} as rank from sm) where rank <= 0.2"),
       mr=f"select asset, ts, mno, close / {mago(1)} - 1 as r from me_w",
       sm="select a.asset, a.ts, (b.r + c.r) / 2 as score from mr a join mr b on b.asset = a.asset and b.mno = a.mno - 11 join mr c on c.asset = a.asset and c.mno = a.mno - 23 where b.r is not null and c.r is not null")
def f24(spark, sf):
    return P.same_month(PAN(spark, sf), 0.2, 2)


@query("f25_smooth_momentum", one(f"select * from (select *, {pct('disc')} as rank from (select *, sign(mom) * (({full_ses('avg', 'dn', 48, 24, 4)}) - ({full_ses('avg', 'up', 48, 24, 4)})) as disc, {'me'} as me2 from ud) where me2 and (asset, ts) in (select (asset, ts) from mom_w)) where rank <= 0.5"),
       ud="select *, case when r1 is not null then cast(r1 > 0 as int) end as up, case when r1 is not null then cast(r1 < 0 as int) end as dn from fx_w")
def f25(spark, sf):
    return P.smooth_momentum(PAN(spark, sf), 52, 4, 0.2, 0.5)


@query("f26_overnight_momentum", one(f"select * from (select *, {pct('round(nights, 12)', desc=True)} as rank from fv_w) where rank <= 0.2"))
def f26(spark, sf):
    return P.overnight_momentum(PAN(spark, sf), 6, 0.2, None)


cte("mew", f"select *, close / {mago(12)} - 1 as m12, close / {mago(6)} - 1 as m6, close / {mago(3)} - 1 as m3, close / {mago(1)} - 1 as m1, avg(close) over (partition by asset order by mno range between 9 preceding and current row) as mean10 from me_w")


@query("f28_xs_target_weights", "select ts, case when close > mean10 then asset else -1 end as asset, round(count(*) / 3, 6) as weight from (select *, row_number() over (partition by ts order by m12 desc, asset) as k from mew where m12 is not null) where k <= 3 group by 1, 2")
def f28(spark, sf):
    return P.target_weights(PAN(spark, sf), 3).select("ts", "asset", F.round("weight", 6).alias("weight"))


cte("ivw_w", "select ts, asset, 1 / v4 / sum(1 / v4) over (partition by ts) as weight from (select *, row_number() over (partition by ts order by mom desc, asset) as k from ivv where me and mom is not null and close > mean and v4 > 0) where k <= 10")
cte("ivv", f"select *, {full_ses('stddev_samp', 'r1', 4)} as v4 from fx_w")


@query("f29_inverse_vol_weights", "select ts, asset, round(weight, 6) as weight from ivw_w")
def f29(spark, sf):
    return P.inverse_vol_weights(PAN(spark, sf), 52, 4, 10, 4, 4).select("ts", "asset", F.round("weight", 6).alias("weight"))


@query("f30_rotation_variants", """select 'equal' as variant, ts, asset, round(1 / count(*) over (partition by ts), 6) as weight from me_w union all
  select 'trend', ts, case when close > mean10 then asset else -1 end, round(count(*) / any_value(n), 6) from (select *, count(*) over (partition by ts) as n from mew) group by 2, 3 union all
  select 'average', ts, case when close > mean10 then asset else -1 end, round(count(*) / 3, 6) from (select *, row_number() over (partition by ts order by (m1 + m3 + m6 + m12) / 4 desc, asset) as k from mew where m1 + m3 + m6 + m12 is not null) where k <= 3 group by 2, 3 union all
  select 'dual', ts, case when ra is null then 0 when ra > rc then case when ra >= rb then 0 else 1 end else 3 end, 1 from (select ts, max(case when asset = 0 then m12 end) as ra, max(case when asset = 1 then m12 end) as rb, max(case when asset = 2 then m12 end) as rc from mew where asset in (0, 1, 2, 3) group by 1)""")
def f30(spark, sf):
    return P.rotation_variants(PAN(spark, sf), 3, (0, 1), 2, 3).select("variant", "ts", "asset", F.round("weight", 6).alias("weight"))


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("f31_holdings_by_year", "select year(ts) as year, " + ", ".join(f"count(*) filter (where sector = '{r}') as \"{r}\"" for r in REGIONS) + " from ivw_w join sect using (asset) where weight > 0 group by 1")
def f31(spark, sf):
    w = P.inverse_vol_weights(PAN(spark, sf), 52, 4, 10, 4, 4).join(S.sectors(spark, sf), "asset")
    return P.holdings_by_year(w, REGIONS, "sector").select(F.col("year").cast("long").alias("year"), *REGIONS)
