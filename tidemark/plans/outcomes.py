"""L: outcomes, labels and trade analytics, on the liquidity-sweep signals of weekly bars."""

from pyspark.sql import functions as F

from ..functions.temporal import flag_session
from ..operators import asset_signals as E
from ..operators import features as C
from ..operators import outcomes as L
from ..operators.bars import days_to_next
from ..session import materialise
from ..sources import bindings as S
from .asset_signals import donchian, line_news, sweeps
from .catalog import cte, query
from .event_signals import BARS, release_days, releases

RULE = L.ExitRule(stop_atr=1.0, rr=1.5, rr_strong=2.0, max_bars=8, trail_atr=1.5)
COSTS = L.Costs(0.0005, 0.0005, 0.02)
HORIZONS = [1, 2, 5, 10]
W = "(partition by strategy, asset, bn order by k rows between unbounded preceding and {0})"


def rounded(df, digits=6, skip=()):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


cte("atr_b", "select a.*, x.adx, r.ts is not null as blocked, lag(a.close) over (partition by a.asset order by a.bn) as pc, lag(a.ts) over (partition by a.asset order by a.bn) as pt from atr_w a left join adx_w x using (asset, ts) left join react_w r using (asset, ts)")
cte("sig2", "select 'sweep' as strategy, asset, ts, side from e16_w union all select 'donchian', asset, ts, side from e1_w")


def signals(spark, sf):
    return sweeps(spark, sf).withColumn("strategy", F.lit("sweep")).unionByName(donchian(spark, sf).withColumn("strategy", F.lit("donchian")))


def trade_bars(spark, sf, days=None):
    return C.with_adx(C.with_atr(flag_session(BARS(spark, sf), releases(spark, sf) if days is None else days, "blocked")))


def with_fires(bars):
    return bars.withColumn("fires", E.fires({"sweep": E.sweep_side(5, 0.1), "donchian": E.breakout_side(10, 40)}))


def market(spark, sf, days=None, features=None):
    """Bars with all that a trade asks of them and the signals they fire, in one pass by asset, written once."""
    bars = with_fires(trade_bars(spark, sf, days))
    return materialise(bars if features is None else features(bars), "market")


def edge_cte(name, sig, keys, horizons):
    """Edge of every signal at every horizon."""
    k = ", ".join(keys)
    cte(f"mv_{name}", " union all ".join(f"select asset, ts, bn - 1 as p, count(*) over (partition by asset) as n, atr, {h} as h, (lead(close, {h}) over (partition by asset order by bn) - lead(open, 1) over (partition by asset order by bn)) / nullif(greatest(atr, 0), 0) as move from atr_w" for h in horizons))
    cte(f"at_{name}", f"select {', '.join('s.' + x for x in keys)}, s.side, m.ts, m.p, m.n, m.atr, m.h, m.move from {sig} s join mv_{name} m using (asset, ts)")
    cte(f"dr_{name}", f"select {', '.join('s.' + x for x in keys)}, s.h, avg(m.move) as drift from (select {k}, h, greatest(min(p), 1) as lo, least(max(p), max(n) - h - 1) as hi from at_{name} group by {k}, h) s join mv_{name} m on m.asset = s.asset and m.h = s.h and m.p between s.lo and s.hi group by {', '.join('s.' + x for x in keys)}, s.h")
    return cte(name, f"select {', '.join('a.' + x for x in keys)}, a.ts, a.side, a.h as horizon, greatest(least(a.side * (a.move - coalesce(d.drift, 0)), 10), -10) as edge from at_{name} a left join dr_{name} d on d.h = a.h and " + " and ".join(f"d.{x} = a.{x}" for x in keys) + " where a.p + a.h < a.n and a.atr > 0")


edge_cte("edges", "sig2", ["strategy", "asset"], HORIZONS)


def edges(spark, sf, horizons=HORIZONS):
    return L.edge_events(signals(spark, sf), C.with_atr(BARS(spark, sf)), horizons, ["strategy", "asset"])


@query("l1_edge_events", "select strategy, asset, ts, side, horizon, round(edge, 6) as edge from edges where horizon = 10")
def l1(spark, sf):
    return rounded(edges(spark, sf, [10]))


@query("l2_edge_curve", """select strategy, arg_max(horizon, (edge, -horizon)) as peak_h, round(max(edge), 6) as peak, round(max(case when horizon = 10 then edge end) / nullif(greatest(max(edge), 0), 0), 6) as exit_vs_peak from (select strategy, horizon, avg(edge) as edge from edges group by 1, 2) group by 1""")
def l2(spark, sf):
    return rounded(L.edge_curve(edges(spark, sf), 10, ["strategy"]))


cte("path0", """select s.strategy, s.asset, s.ts as signal_ts, s.side, a.bn, b.bn - a.bn as k, a.atr as a0, a.adx as x0, b.ts, b.pt, b.pc, b.open, b.high, b.low, b.close, b.atr, b.blocked, o.side as want
  from sig2 s join atr_b a on a.asset = s.asset and a.ts = s.ts and a.atr > 0 join atr_b b on b.asset = a.asset and b.bn between a.bn + 1 and a.bn + 8 left join sig2 o on o.strategy = s.strategy and o.asset = s.asset and o.ts = b.pt""")
cte("path1", f"select *, first(open) over {W.format('current row')} * (1 + side * 0.0005) as entry, 1.0 * a0 as risk, first(ts) over {W.format('current row')} as entry_ts, first(blocked) over {W.format('current row')} as eb, case when side > 0 then low else -high end as adv, case when side > 0 then high else -low end as good from path0")
cte("path2", f"select *, side * entry - risk as ini, side * entry + (case when x0 >= 25 then 2.0 else 1.5 end) * risk as tgt, greatest(side * entry, max(side * close) over {W.format('current row')}) - 1.5 * atr as lvl from path1")
cte("path3", f"select *, greatest(ini, max(lvl) over {W.format('1 preceding')}) as stp, sum(case when side < 0 and k > 1 then pc * 0.02 * date_diff('day', pt, ts) / 365 else 0 end) over {W.format('current row')} as lent, max(good) over {W.format('1 preceding')} as hi0, min(adv) over {W.format('1 preceding')} as lo0 from path2")
cte("path4", """select *, case when k > 1 and blocked then 1 when k > 1 and want = -side then 2 when k > 1 and side * open <= stp then 3 when k > 1 and side * open >= tgt then 4 when adv <= stp then 5 when good >= tgt then 6 when k >= 8 then 7 end as ph from path3""")
cte("tr0", """select *, ph <= 4 as at_open, case ph when 1 then 'event' when 2 then 'reverse' when 4 then 'target' when 6 then 'target' when 7 then 'time' else case when stp = ini then 'stop' else 'trail' end end as reason,
  side * (case when ph <= 4 then side * open when ph = 5 then stp when ph = 6 then tgt else side * close end) * (1 - side * 0.0005) as exit from (select *, row_number() over (partition by strategy, asset, bn order by k) as rn from path4 where ph is not null and not eb) where rn = 1""")
cte("trades_all", """select strategy, asset, signal_ts, side, bn as fill_no, entry_ts, ts as exit_ts, entry, exit, reason, at_open, bn - 1 + k as exit_no, risk, (greatest(hi0, case when not at_open then good end, side * entry) - side * entry) / risk as mfe_r,
  (least(lo0, case when not at_open then adv end, side * entry) - side * entry) / risk as mae_r, (0.0005 * (entry + exit) + lent) / risk as fees_r, side * (exit - entry) / risk as gross_r, side * (exit - entry) / risk - (0.0005 * (entry + exit) + lent) / risk as r from tr0""")
TCOLS = ["strategy", "asset", "signal_ts", "side", "fill_no", "entry_ts", "exit_ts", "entry", "exit", "reason", "at_open", "exit_no", "risk", "mfe_r", "mae_r", "fees_r", "gross_r", "r"]
TDOUBLE = {"entry", "exit", "risk", "mfe_r", "mae_r", "fees_r", "gross_r", "r"}
TSQL = ", ".join(f"round({c}, 6) as {c}" if c in TDOUBLE else c for c in TCOLS)


def all_trades(spark, sf):
    return L.barrier_outcomes("fires", market(spark, sf), RULE, COSTS, ["strategy", "asset"])


def trades(spark, sf, bars=None):
    """The ledger of the signals of `market` bars."""
    return L.ledger("fires", market(spark, sf) if bars is None else bars, RULE, COSTS, ["strategy", "asset"])


@query("l3_barrier_outcomes", f"select {TSQL} from trades_all")
def l3(spark, sf):
    return rounded(all_trades(spark, sf)).select(*TCOLS)


def ledger_ctes(p, sig, by, rules):
    """Trades of a signal cte under each row of a cte of rules (`{p}_all`), and one position at a time (`{p}`)."""
    key = f"{by}, asset, rule_no"
    upto = lambda end: f"(partition by {key}, bn order by k rows between unbounded preceding and {end})"
    cte(f"{p}_p0", f"""select s.{by}, s.asset, s.ts as signal_ts, s.side, u.*, a.bn, b.bn - a.bn as k, a.atr as a0, a.adx as x0, b.ts, b.pt, b.pc, b.open, b.high, b.low, b.close, b.atr, b.blocked, o.side as want
      from {sig} s join atr_b a on a.asset = s.asset and a.ts = s.ts and a.atr > 0 join atr_b b on b.asset = a.asset and b.bn between a.bn + 1 and a.bn + 8 join {rules} u on b.bn <= a.bn + u.max_bars left join {sig} o on o.{by} = s.{by} and o.asset = s.asset and o.ts = b.pt""")
    cte(f"{p}_p1", f"select *, first(open) over {upto('current row')} * (1 + side * 0.0005) as entry, stop_atr * a0 as risk, first(ts) over {upto('current row')} as entry_ts, first(blocked) over {upto('current row')} as eb, case when side > 0 then low else -high end as adv, case when side > 0 then high else -low end as good from {p}_p0")
    cte(f"{p}_p2", f"select *, side * entry - risk as ini, side * entry + (case when strong and x0 >= 25 then rr_strong else rr end) * risk as tgt, greatest(side * entry, max(side * close) over {upto('current row')}) - trail_atr * atr as lvl from {p}_p1")
    cte(f"{p}_p3", f"select *, greatest(ini, max(lvl) over {upto('1 preceding')}) as stp, sum(case when side < 0 and k > 1 then pc * 0.02 * date_diff('day', pt, ts) / 365 else 0 end) over {upto('current row')} as lent from {p}_p2")
    cte(f"{p}_p4", f"select *, case when k > 1 and blocked then 1 when k > 1 and want = -side then 2 when k > 1 and side * open <= stp then 3 when k > 1 and side * open >= tgt then 4 when adv <= stp then 5 when good >= tgt then 6 when k >= max_bars then 7 end as ph from {p}_p3")
    cte(f"{p}_p5", f"""select *, ph <= 4 as at_open, side * (case when ph <= 4 then side * open when ph = 5 then stp when ph = 6 then tgt else side * close end) * (1 - side * 0.0005) as exit
      from (select *, row_number() over (partition by {key}, bn order by k) as rn from {p}_p4 where ph is not null and not eb) where rn = 1""")
    cte(f"{p}_all", f"select {by}, asset, rule_no, rule, signal_ts, side, bn as fill_no, entry_ts, ts as exit_ts, at_open, bn - 1 + k as exit_no, entry, exit, risk, (0.0005 * (entry + exit) + lent) / risk as fees_r, side * (exit - entry) / risk as gross_r, side * (exit - entry) / risk - (0.0005 * (entry + exit) + lent) / risk as r from {p}_p5")
    same = lambda a, b: f"{a}.{by} = {b}.{by} and {a}.asset = {b}.asset and {a}.rule_no = {b}.rule_no"
    cte(f"{p}_next", f"select t.{by}, t.asset, t.rule_no, t.fill_no, min(n.fill_no) as nxt from {p}_all t left join {p}_all n on {same('n', 't')} and n.fill_no >= t.exit_no + case when t.at_open then 0 else 1 end and n.fill_no > t.fill_no group by 1, 2, 3, 4")
    cte(f"{p}_walk", f"select {key}, min(fill_no) as fill_no from {p}_all group by {key} union all select x.{by}, x.asset, x.rule_no, x.nxt from {p}_walk g join {p}_next x on {same('x', 'g')} and x.fill_no = g.fill_no where x.nxt is not null")
    return cte(p, f"select t.* from {p}_all t join {p}_walk using ({key}, fill_no)")


cte("tx", "select t.strategy, t.asset, t.fill_no, min(n.fill_no) as nxt from trades_all t left join trades_all n on n.strategy = t.strategy and n.asset = t.asset and n.fill_no >= t.exit_no + case when t.at_open then 0 else 1 end and n.fill_no > t.fill_no group by 1, 2, 3")
cte("tg", "select strategy, asset, min(fill_no) as fill_no from trades_all group by 1, 2 union all select x.strategy, x.asset, x.nxt from tg g join tx x on x.strategy = g.strategy and x.asset = g.asset and x.fill_no = g.fill_no where x.nxt is not null")
cte("trades", "select t.* from trades_all t join tg using (strategy, asset, fill_no)")


@query("l4_non_overlapping", f"select {TSQL} from trades")
def l4(spark, sf):
    return rounded(trades(spark, sf)).select(*TCOLS)


@query("l5_limit_fill_study", """select asset, ts, side, round(side * (c1 - o) / atr, 6) as drift_1, round(side * (c4 - o) / atr, 6) as drift_4, case when side > 0 then lo <= o - side * 0.25 * atr else hi >= o - side * 0.25 * atr end as filled from (
  select *, lead(open) over w as o, lead(close) over w as c1, lead(close, 4) over w as c4, min(low) over (partition by asset order by bn rows between 1 following and 3 following) as lo, max(high) over (partition by asset order by bn rows between 1 following and 3 following) as hi from atr_w window w as (partition by asset order by bn)) join e16_w using (asset, ts) where atr > 0 and o is not null""")
def l5(spark, sf):
    return rounded(L.limit_fill_study(sweeps(spark, sf), C.with_atr(BARS(spark, sf)), [1, 4], 0.25, 3))


cte("ctx", """select t.*, f.adx, f.vol_rank, d.trend, n.tone_z, n.attention_z, e.to_earnings, j.to_jobs, v.bias as ai_bias from trades t left join feat_w f on f.asset = t.asset and f.ts = t.signal_ts left join trend_w d on d.asset = t.asset and d.ts = t.signal_ts
  left join nz_w n on n.asset = t.asset and n.ts = t.signal_ts left join dte_w e on e.asset = t.asset and e.ts = t.signal_ts left join dtj_w j on j.ts = t.signal_ts left join aib v on v.asset = t.asset and v.ts = t.signal_ts""")
cte("dte_w", "select d.asset, d.ts, date_diff('day', d.ts, e.event) as to_earnings from bars_w d asof left join earn_day e on e.asset = d.asset and e.event >= d.ts")
cte("dtj_w", "select d.ts, date_diff('day', d.ts, j.day) as to_jobs from (select distinct ts from bars_w) d asof left join jobs j on j.day >= d.ts")
cte("aib", "select asset, ts, cast(volume as int) % 3 - 1 as bias from bars_w")
cte("lab", """select *, case when side > 0 then 'long' else 'short' end as side_name, case when adx is null then 'unknown' when adx < 20 then 'chop' when adx < 30 then 'trend' else 'strong' end as regime, case when vol_rank is null then 'unknown' when vol_rank < 1e0 / 3 then 'low' when vol_rank < 2e0 / 3 then 'mid' else 'high' end as vol,
  side * coalesce(trend, 0) > 0 as aligned, case when tone_z is null then 'unknown' when tone_z < -1 then 'negative' when tone_z > 1 then 'positive' else 'neutral' end as news, case when attention_z is null then 'unknown' when attention_z > 1.5 then 'spike' else 'normal' end as buzz,
  case when to_earnings <= 3 then 'earnings' when to_jobs <= 0 then 'jobs report' else 'none' end as event, case when coalesce(ai_bias, 0) = 0 then 'none' when sign(ai_bias) = side then 'agree' else 'disagree' end as ai from ctx""")
cte("labd", """select *, case when r > 0 then 'none' when gross_r > 0 then 'fees_ate_edge' when r < -1.2 and event <> 'none' then 'event_gap' when r < -1.2 then 'gap_through_stop' when mfe_r >= 1 then 'gave_back_profit' when not aligned then 'counter_trend'
  when r < 0 and ((news = 'negative' and side > 0) or (news = 'positive' and side < 0)) then 'news_against' when regime = 'chop' then 'choppy_market' when mfe_r < 0.3 then 'wrong_immediately' else 'normal_loss' end as error from lab""")


def labelled(spark, sf):
    from .bars import jobs
    reports = materialise(S.earnings(spark, sf).select("asset", "accepted"), "reports")

    def features(bars):
        bars = bars.withColumn("atr_pct", F.col("atr") / F.col("close"))
        return bars.withColumns({"vol_rank": F.when(F.size("fires") > 0, C.window_rank("atr_pct", 250, 50)), "trend": F.signum(F.col("close") - C.sma("close", 10)).cast("int"), "ai_bias": (F.col("volume").cast("int") % 3 - 1)})

    bars = market(spark, sf, release_days(reports), features)
    feats = bars.filter("size(fires) > 0").select("asset", "ts", "adx", "vol_rank", "trend", "ai_bias")  # a trade has the context of its signal's bar
    days = feats.select("asset", F.col("ts").alias("day"))
    to_e = days_to_next(days, reports.select("asset", F.col("accepted").cast("date").alias("event")), ["asset"], "to_earnings").withColumnRenamed("day", "ts")
    cal = days.select("day").distinct().withColumn("all", F.lit(1))
    to_j = days_to_next(cal, jobs(spark, sf).select(F.lit(1).alias("all"), F.col("day").alias("event")), ["all"], "to_jobs").select(F.col("day").alias("ts"), "to_jobs")
    ctx = feats.join(line_news(spark, sf), ["asset", "ts"], "left").join(to_e, ["asset", "ts"], "left").join(to_j, "ts", "left")
    df = trades(spark, sf, bars).join(ctx.withColumnRenamed("ts", "signal_ts"), ["asset", "signal_ts"], "left").withColumn("to_fomc", F.lit(None).cast("int"))
    return L.diagnose(L.entry_context(df))


LABELS = ["side_name", "regime", "vol", "aligned", "news", "buzz", "event", "ai"]


@query("l6_entry_context", f"select strategy, asset, signal_ts, {', '.join(LABELS)} from lab")
def l6(spark, sf):
    return labelled(spark, sf).select("strategy", "asset", "signal_ts", *LABELS)


@query("l7_diagnose", "select strategy, asset, signal_ts, round(r, 6) as r, error from labd")
def l7(spark, sf):
    return labelled(spark, sf).select("strategy", "asset", "signal_ts", F.round("r", 6).alias("r"), "error")


@query("l8_stop_too_tight", """select t.strategy, t.asset, t.signal_ts, t.side from trades t where reason = 'stop' and exists (select 1 from atr_w x join atr_w b on b.asset = x.asset and b.bn between x.bn + 1 and x.bn + 4 where x.asset = t.asset and x.ts = t.exit_ts
  and case when t.side > 0 then b.high >= t.entry + 1.5 * t.risk else b.low <= t.entry - 1.5 * t.risk end)""")
def l8(spark, sf):
    bars = market(spark, sf)
    return L.stop_too_tight(trades(spark, sf, bars), bars, 1.5, 4)


@query("l9_rule_learner_view", """select strategy, asset, signal_ts, n as n_recent, round(m, 6) as mean_recent, coalesce(n >= 15 and m < -0.1, false) as blocked from (select t.strategy, t.asset, t.signal_ts, (select count(*) from (select h.r from labd h where h.strategy = t.strategy and h.side_name = t.side_name and h.regime = t.regime and h.vol = t.vol and h.aligned = t.aligned and h.exit_ts < t.entry_ts order by h.exit_ts desc, h.asset desc, h.signal_ts desc limit 60)) as n,
  (select avg(r) from (select h.r from labd h where h.strategy = t.strategy and h.side_name = t.side_name and h.regime = t.regime and h.vol = t.vol and h.aligned = t.aligned and h.exit_ts < t.entry_ts order by h.exit_ts desc, h.asset desc, h.signal_ts desc limit 60)) as m from labd t)""")
def l9(spark, sf):
    t = materialise(labelled(spark, sf), "labelled")
    df = L.rule_learner_view(t, ["strategy", "side_name", "regime", "vol", "aligned"])
    return df.select("strategy", "asset", "signal_ts", F.col("n_recent").cast("long").alias("n_recent"), F.round("mean_recent", 6).alias("mean_recent"), "blocked")


NOW = "date '2001-10-01'"


@query("l10_strategy_board", f"""select strategy, asset, round(sum(case when t and exit_ts > {NOW} - 7 then r else 0 end), 6) as r_7d, round(sum(case when t and exit_ts > {NOW} - 30 then r else 0 end), 6) as r_30d, round(sum(case when t then r else 0 end), 6) as r_all, count(*) filter (where t) as trades,
  round(avg(cast(r > 0 as int)) filter (where t), 6) as win_rate, round(avg(r) filter (where t), 6) as avg_r, count(*) filter (where not t) as skipped, round(sum(case when not t then r else 0 end), 6) as r_skipped from (select *, asset % 5 <> 1 as t from trades) group by 1, 2""")
def l10(spark, sf):
    return rounded(L.strategy_board(trades(spark, sf).withColumn("shadow", F.col("asset") % 5 == 1), F.lit("2001-10-01").cast("date")))


@query("l11_r_tables", """select 'pivot' as kind, cast(asset as varchar) as name, round(sum(r) filter (where strategy = 'sweep'), 6) as a, round(sum(r) filter (where strategy = 'donchian'), 6) as b from trades group by asset union all
  select 'error', error, round(sum(r), 6), round(count(*) / sum(count(*)) over (), 6) from labd where r <= 0 group by error""")
def l11(spark, sf):
    t = materialise(labelled(spark, sf).select("asset", "strategy", "r", "error"), "labelled")  # both tables read it
    p = L.r_pivot(t, ["sweep", "donchian"]).select(F.lit("pivot").alias("kind"), F.col("asset").cast("string").alias("name"), F.round("sweep", 6).alias("a"), F.round("donchian", 6).alias("b"))
    e = L.error_table(t.filter("r <= 0")).select(F.lit("error").alias("kind"), F.col("error").alias("name"), F.round("sum_r", 6).alias("a"), F.round("share", 6).alias("b"))
    return p.unionByName(e)


cte("ev", "select *, mae_r + fees_r as ev from trades")


@query("l12_learner_quality", """select 'auc' as kind, 0 as bin, count(*) as n, round((sum(case when r > 0 then rk end) - count(*) filter (where r > 0) * (count(*) filter (where r > 0) + 1) / 2) / (count(*) filter (where r > 0) * count(*) filter (where r <= 0)), 6) as value
  from (select *, rank() over (order by ev) + (count(*) over (partition by ev) - 1) / 2 as rk from ev) union all select 'bin', cast(b as int), count(*), round(avg(r), 6) from (select r, cast(ev > q1 as int) + cast(ev > q2 as int) + cast(ev > q3 as int) + cast(ev > q4 as int) as b from ev, (select quantile_cont(ev, 0.2) as q1, quantile_cont(ev, 0.4) as q2, quantile_cont(ev, 0.6) as q3, quantile_cont(ev, 0.8) as q4 from ev)) group by b""")
def l12(spark, sf):
    t = materialise(trades(spark, sf).withColumns({"ev": F.col("mae_r") + F.col("fees_r"), "won": F.col("r") > 0}), "judged")
    a = L.auc(t, "ev", "won")
    n = t.agg(F.count("*").alias("n"))
    a = a.select(F.lit("auc").alias("kind"), F.lit(0).alias("bin"), n.select("n").scalar().alias("n"), F.round("auc", 6).alias("value"))
    return a.unionByName(L.r_by_quintile(t, "ev").select(F.lit("bin").alias("kind"), "bin", "n", F.round("mean_r", 6).alias("value")))


@query("l13_vanished", "select asset, cast(entry_ts as date) as entry_ts from trades t where strategy = 'sweep' and entry_ts >= date '2001-01-01' and asset not in (select s_suppkey from supplier where s_acctbal > 2000) and asset not in (select asset from trades where strategy = 'donchian' and exit_ts >= date '2001-06-01')")
def l13(spark, sf):
    t = trades(spark, sf)
    held = S.table(spark, sf, "supplier").filter("s_acctbal > 2000").select(F.col("s_suppkey").alias("asset"))
    return L.vanished(t.filter("strategy = 'sweep' and entry_ts >= date'2001-01-01'"), held, t.filter("strategy = 'donchian' and exit_ts >= date'2001-06-01'")).select("asset", "entry_ts")


@query("l14_recent_payoff", """select strategy, n, round(case when n >= 30 then w else aw end, 6) as win, round(case when n >= 30 then l else al end, 6) as loss from (select strategy, count(*) as n, avg(r) filter (where r > 0) as w, -avg(r) filter (where r <= 0) as l from pay group by 1), (select avg(r) filter (where r > 0) as aw, -avg(r) filter (where r <= 0) as al from pay)""",
       pay="select strategy || (asset // 10)::varchar as strategy, r from trades")
def l14(spark, sf):
    t = materialise(trades(spark, sf).select(F.concat("strategy", F.floor(F.col("asset") / 10).cast("string")).alias("strategy"), "r"), "payoff")
    return rounded(L.recent_payoff(t))


@query("l15_rationale_text", """select strategy, asset, signal_ts, concat_ws('; ', side_name || ' ' || asset || ' on ' || strategy, regime || ' market', vol || ' volatility', case when aligned then 'with the trend' else 'against the trend' end, case when news in ('positive', 'negative') then news || ' news' end, case when event <> 'none' then event || ' ahead' end) as rationale from lab""")
def l15(spark, sf):
    return L.rationale_text(labelled(spark, sf)).select("strategy", "asset", "signal_ts", "rationale")
