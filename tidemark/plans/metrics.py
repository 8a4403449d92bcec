"""M: performance metrics. The curves are supplier price series and the ledgers of the sweep and donchian trades."""

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import panel_signals as P
from ..session import materialise
from ..sources import bindings as S
from .bars import r6
from .catalog import cte, query
from .event_signals import BARS, PAN
from .outcomes import rounded, market, trades

cte("eq", "select asset as account, ts, close as equity from bars_w")


def eq(spark, sf):
    return BARS(spark, sf).select(F.col("asset").alias("account"), "ts", F.col("close").alias("equity"))


def stats_sql(src, ppy):
    root = f"sqrt({ppy}e0)"
    return f"""select account, fe as final_equity, tr as total_return, case when n > 0 then pow(1 + tr, 1 / (n / {ppy}e0)) - 1 end as cagr, s * {root} as volatility, case when s > 0 then m / s * {root} end as sharpe, case when d > 0 then m * {ppy} / (d * {root}) end as sortino, dd as max_drawdown,
      case when dd < 0 then (pow(1 + tr, 1 / (n / {ppy}e0)) - 1) / abs(dd) end as calmar from (select account, last(equity order by ts) as fe, last(equity order by ts) / first(equity order by ts) - 1 as tr, count(ret) as n, avg(ret) as m, stddev_samp(ret) as s, stddev_samp(ret) filter (where ret < 0) as d, min(dd) as dd
      from (select *, equity / lag(equity) over (partition by account order by ts) - 1 as ret, equity / max(equity) over (partition by account order by ts) - 1 as dd from {src}) group by 1)"""


STATS = ["final_equity", "total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar"]
R_STATS = ", ".join(f"round({c}, 6) as {c}" for c in STATS)
cte("eqs", stats_sql("eq", 52))


@query("m1_equity_stats", f"select account, {R_STATS} from eqs")
def m1(spark, sf):
    return rounded(M.equity_stats(eq(spark, sf), 52))


cte("tst", "select asset as account, count(*) as trades, count(*) filter (where side < 0) as shorts, avg(cast(r > 0 as int)) as win_rate, avg(r) as avg_r, case when sum(case when r <= 0 then r else 0 end) < 0 then sum(case when r > 0 then r else 0 end) / -sum(case when r <= 0 then r else 0 end) else 'inf'::double end as profit_factor, sum(fees_r) as fees from trades group by 1")


def tstats(spark, sf):
    return M.trade_stats(trades(spark, sf).select(F.col("asset").alias("account"), "side", "r", F.col("r").alias("pnl"), F.col("fees_r").alias("fees")))


@query("m2_trade_stats", "select account, trades, shorts, round(win_rate, 6) as win_rate, round(avg_r, 6) as avg_r, round(profit_factor, 6) as profit_factor, round(fees, 6) as fees from tst")
def m2(spark, sf):
    return rounded(tstats(spark, sf))


cte("mean_r", "select ts, avg(ret) as bench from ret_w group by 1")
cte("ab", """select account, (mr - c / v * mb) * 52 as alpha, c / v as beta, ma / sa * sqrt(52e0) as info_ratio from (select asset as account, covar_samp(ret, bench) as c, var_samp(bench) as v, avg(ret) as mr, avg(bench) as mb, avg(ret - bench) as ma, stddev_samp(ret - bench) as sa, count(*) as n
  from ret_w join mean_r using (ts) where ret is not null and bench is not null group by 1) where n >= 20 and v > 0""")


def pairs(spark, sf):
    r = M.with_returns(eq(spark, sf))
    return r.join(r.groupBy("ts").agg(F.avg("ret").alias("bench")), "ts")


@query("m3_alpha_beta", "select account, round(alpha, 6) as alpha, round(beta, 6) as beta, round(info_ratio, 6) as info_ratio from ab")
def m3(spark, sf):
    return rounded(M.alpha_beta(pairs(spark, sf), 52))


cte("eqw", "select ts, 1000 * exp(sum(ln(1 + coalesce(bench, 0))) over (order by ts)) as equity from mean_r")


@query("m4_buy_and_hold", "select 'hold' as kind, asset as account, ts, round(1000 * close / (first(open) over (partition by asset order by ts) * 1.0005e0), 6) as equity from bars_w union all select 'equal', -1, ts, round(equity, 6) from eqw")
def m4(spark, sf):
    h = M.buy_and_hold(BARS(spark, sf), 1000.0, 0.0005).select(F.lit("hold").alias("kind"), "account", "ts", *r6("equity"))
    return h.unionByName(M.equal_weight(BARS(spark, sf), 1000.0).select(F.lit("equal").alias("kind"), F.lit(-1).cast("long").alias("account"), "ts", *r6("equity")))


WINDOWS = [("early", "1995-01-01", "1997-12-31"), ("late", "1998-01-01", "2001-12-31")]


@query("m5_window_stats", f"select account, {R_STATS} from ({stats_sql('eqwin', 52)})", eqwin="select asset || '|' || w as account, ts, close as equity from bars_w join (values " + ", ".join(f"('{n}', date '{a}', date '{b}')" for n, a, b in WINDOWS) + ") v(w, a, b) on ts between a and b")
def m5(spark, sf):
    w = spark.createDataFrame(WINDOWS, "window string, start string, end string").select("window", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))
    return rounded(M.window_stats(eq(spark, sf), w, 52))


cte("eqh", "select account, cast(ts as date) as ts, last(equity order by ts) as equity from (select asset as account, ts, close as equity from bars_h) group by 1, 2")


@query("m6_trading_stats", f"""select s.account, round(total_return, 6) as "return", round(sharpe, 6) as sharpe, round(max_drawdown, 6) as max_dd, round(case when sd > 0 then m / sd else 0 end, 6) as sr_daily, n as n_days,
  round(case when n > 3 then g1 * sqrt(n * (n - 1)) / (n - 2) else 0 end, 6) as skew, round(case when n > 3 then ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)) + 3 else 3 end, 6) as kurt from ({stats_sql('eqh', 365)}) s
  join (select account, any_value(n) as n, any_value(m) as m, any_value(sd) as sd, avg(pow((ret - m) / sp, 3)) as g1, avg(pow((ret - m) / sp, 4)) - 3 as g2 from (select *, count(ret) over w as n, avg(ret) over w as m, stddev_samp(ret) over w as sd, stddev_pop(ret) over w as sp
  from (select *, equity / lag(equity) over (partition by account order by ts) - 1 as ret from eqh) window w as (partition by account)) group by 1) k on k.account = s.account""")
def m6(spark, sf):
    e = S.hourly_bars(spark, sf).select(F.col("asset").alias("account"), "ts", F.col("close").alias("equity"))
    return rounded(M.trading_stats(e))


cte("held", "select t.strategy, t.asset, t.entry_ts, b.ts, b.bn, t.side * ((case when b.ts = t.exit_ts then t.exit else b.close end) - t.entry) / t.risk - case when b.ts = t.exit_ts then t.fees_r else 0 end as now_r from trades t join atr_w b on b.asset = t.asset and b.ts between t.entry_ts and t.exit_ts")
cte("led", "select strategy as account, ts, 0.001 * sum(step) as ret from (select *, now_r - coalesce(lag(now_r) over (partition by strategy, asset, entry_ts order by bn), 0) as step from held) group by 1, 2")
cte("ledeq", "select account, ts, ret, 10000 * exp(sum(ln(1 + ret)) over (partition by account order by ts)) as equity from led")


def ledger(spark, sf):
    bars = market(spark, sf)
    return M.ledger_equity(trades(spark, sf, bars), bars, 10000.0, 0.001)


@query("m7_ledger_equity", "select account, ts, round(equity, 6) as equity from ledeq")
def m7(spark, sf):
    return rounded(ledger(spark, sf))


cte("idle0", "select account, ts, ret, case when lag(equity) over (partition by account order by ts) is null then 0 else greatest(0, 1 - lag(gross) over (partition by account order by ts)) end as w from (select l.*, 0.01 * (day(ts) % 7) + 0.5 as gross from (select account, ts, equity, equity / lag(equity) over (partition by account order by ts) - 1 as ret from ledeq) l)")


@query("m8_with_idle_cash", "select account, ts, round(10000 * exp(sum(ln(1 + coalesce(ret, 0) + w * bench - 0.0001 * abs(w - pw))) over (partition by account order by ts)), 6) as equity from (select i.*, m.bench, coalesce(lag(w) over (partition by account order by ts), 0) as pw from idle0 i join (select ts, coalesce(bench, 0) as bench from mean_r) m using (ts))")
def m8(spark, sf):
    book = M.with_returns(ledger(spark, sf)).withColumn("gross", 0.01 * (F.dayofmonth("ts") % 7) + 0.5)
    index = pairs(spark, sf).groupBy("ts").agg(F.coalesce(F.max("bench"), F.lit(0.0)).alias("ret"))
    return rounded(M.with_idle_cash(book, index, 10000.0))


cte("dec", "select ts as decided, row_number() over (order by ts) as seg from (select distinct ts from ivw_w)")
cte("segs", "select c.ts, c.sno, (select max(seg) from dec where decided < c.ts) as seg from cal_w c")
cte("wgrid", "select s.seg, w.asset, w.weight as w0, s.ts, s.sno, w.weight * exp(sum(ln(1 + coalesce(r.r1, 0))) over (partition by s.seg, w.asset order by s.sno)) as v from segs s join dec d on d.seg = s.seg join ivw_w w on w.ts = d.decided left join r1_w r on r.asset = w.asset and r.sno = s.sno")
cte("wtot", "select seg, ts, sno, sum(v) + 1 - sum(w0) as v from wgrid group by 1, 2, 3")
cte("wturn", """select seg, sum(abs(coalesce(w0, 0) - coalesce(old, 0))) as turn from (select coalesce(a.seg, b.seg) as seg, a.w0, b.old from (select d.seg, w.asset, w.weight as w0 from ivw_w w join dec d on d.decided = w.ts) a
  full join (select g.seg + 1 as seg, g.asset, g.v / t.v as old from wgrid g join wtot t using (seg, sno) where g.sno = (select max(sno) from segs s where s.seg = g.seg)) b on a.seg = b.seg and a.asset = b.asset) group by 1""")


@query("m9_weights_backtest", "select ts, round(1000 * exp(sum(ln(1 + v / coalesce(pv, 1) - 1 - case when pv is null then turn * 0.0004 else 0 end)) over (order by ts)), 6) as equity from (select t.*, lag(v) over (partition by t.seg order by sno) as pv, u.turn from wtot t join wturn u using (seg))")
def m9(spark, sf):
    p = materialise(PAN(spark, sf), "panel")
    w = materialise(P.inverse_vol_weights(p, 52, 4, 10, 4, 4), "weights")
    return rounded(M.weights_backtest(p, w, 1000.0, 0.0004))


@query("m11_version_race", """select x.sector as version, round(avg(total_return), 6) as "return", round(min(max_drawdown), 6) as max_drawdown, cast(sum(trades) as bigint) as trades, round(avg(win_rate), 6) as win_rate, round(avg(avg_r), 6) as avg_r from eqs e join sect x on x.asset = e.account left join tst t on t.account = e.account group by 1""")
def m11(spark, sf):
    both = M.equity_stats(eq(spark, sf), 52).join(tstats(spark, sf), "account", "left").join(S.sectors(spark, sf).withColumnRenamed("asset", "account"), "account")
    df = both.groupBy(F.col("sector").alias("version")).agg(F.avg("total_return").alias("return"), F.min("max_drawdown").alias("max_drawdown"), F.sum("trades").alias("trades"), F.avg("win_rate").alias("win_rate"), F.avg("avg_r").alias("avg_r"))
    return rounded(df).orderBy(F.desc("return"))


def drift_sql(where, name):
    return f"select case when s is not null then 'strategy=' || s when k is not null then 'kind=' || k else 'hour=' || h end as name, avg(p) as {name} from (select event_type as s, cast(user_id % 3 as varchar) as k, hour(ts) as h, sqrt(value) / 100 as p from events where {where}) group by grouping sets ((s), (k), (h))"


@query("m12_drift_by_hour", f"select coalesce(a.name, b.name) as name, round(now_p, 8) as now_p, round(was_p, 8) as was_p, round(now_p - was_p, 8) as change from ({drift_sql('day(ts) > 15', 'now_p')}) a full join ({drift_sql('day(ts) <= 15', 'was_p')}) b on a.name = b.name")
def m12(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("event_type").alias("strategy"), (F.col("user_id") % 3).cast("string").alias("kind"), F.hour("ts").alias("hour"), (F.sqrt("value") / 100).alias("p"), F.dayofmonth("ts").alias("d"))
    return rounded(M.drift_by_hour(e.filter("d > 15"), e.filter("d <= 15")), 8)


@query("m13_fill_quality", """select l_suppkey as asset, sum(case when l_returnflag = 'A' then l_quantity else 0 end) as maker, sum(case when l_returnflag <> 'A' then l_quantity else 0 end) as taker, round(sum(case when l_returnflag = 'A' then l_quantity else 0 end) / nullif(sum(l_quantity), 0), 6) as maker_share,
  round(avg((case when l_linenumber % 2 = 0 then 1 else -1 end) * (100 + sqrt(l_extendedprice) / 30 - b.open) / 2.5), 6) as slip_r from lineitem l join bars_w b on b.asset = l_suppkey and b.ts = cast(date_trunc('week', l_shipdate) as date) group by 1""")
def m13(spark, sf):
    l = S.table(spark, sf, "lineitem")
    f = l.select(F.col("l_suppkey").alias("asset"), F.date_trunc("week", "l_shipdate").cast("date").alias("ts"), F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0).alias("maker_qty"),
                 F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).otherwise(0.0).alias("taker_qty"), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1).alias("side"), S.line_price().alias("price"), F.lit(2.5).alias("risk"))
    return rounded(M.fill_quality(f.join(BARS(spark, sf).select("asset", "ts", "open"), ["asset", "ts"]), ["asset"]))


@query("m14_downsample_curve", "select account, ts, round(equity, 6) as equity from (select *, row_number() over (partition by account order by ts) - 1 as i, count(*) over (partition by account) as n from eq) where i % greatest(n // 40, 1) = 0 or i = n - 1")
def m14(spark, sf):
    return rounded(M.downsample(eq(spark, sf), 40))


@query("m15_combine_legs", "select ts, round(sum(coalesce(e, f)), 5) as equity from (select a.account, a.f, c.ts, last_value(q.equity ignore nulls) over (partition by a.account order by c.ts) as e from (select account, first(equity order by ts) as f from eq group by 1) a cross join (select distinct ts from eq) c left join eq q on q.account = a.account and q.ts = c.ts) group by 1")
def m15(spark, sf):
    return rounded(M.combine_legs(eq(spark, sf)), 5)


@query("m16_summarize", f"select e.account, {', '.join(f'round(e.{c}, 6) as {c}' for c in STATS)}, t.trades, round(t.avg_r, 6) as avg_r, round(b.alpha, 6) as alpha, round(b.beta, 6) as beta, round(m.mixed, 6) as mixed from eqs e left join tst t using (account) left join ab b using (account) left join (select account, exp(sum(ln(1 + (ret + bench) / 2))) - 1 as mixed from (select asset as account, ret, bench from ret_w join mean_r using (ts) where ret is not null and bench is not null) group by 1) m using (account)")
def m16(spark, sf):
    p = pairs(spark, sf)
    mixed = p.filter("ret is not null and bench is not null").groupBy("account").agg((F.exp(F.sum(F.log1p((F.col("ret") + F.col("bench")) / 2))) - 1).alias("mixed"))
    df = M.equity_stats(eq(spark, sf), 52).join(tstats(spark, sf).select("account", "trades", "avg_r"), "account", "left").join(M.alpha_beta(p, 52).select("account", "alpha", "beta"), "account", "left").join(mixed, "account", "left")
    return rounded(df)
