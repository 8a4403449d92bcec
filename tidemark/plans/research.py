"""N: research statistics of four candidate strategies and of the suppliers' weekly returns as tries."""

import math
import re

from pyspark.sql import functions as F

from ..operators import asset_signals as E
from ..operators import features as C
from ..operators import metrics as M
from ..operators import outcomes as L
from ..operators import panel_signals as P
from ..operators import research as N
from ..session import materialise
from ..sources import bindings as S
from .asset_signals import DAYNO, donchian_sql, fired, full, mixed_sql, mixed_uniform_sql, two, uniform_sql
from .bars import cal_d
from .catalog import CTES, cte, query
from .combinators import grid
from .event_signals import BARS, PAN
from .metrics import ledger, pairs
from .outcomes import COSTS, RULE, edge_cte, ledger_ctes, market, rounded, signals, trade_bars, trades

SETS = {"sweep-4": ("sweep", 4), "sweep-8": ("sweep", 8), "donchian-10": ("donchian", 10), "donchian-16": ("donchian", 16)}


def sweep_sql(n):
    return fired(two("low < lo and close > lo + 0.1 * atr", "high > hi and close < hi - 0.1 * atr"), f"(select *, {full('min', 'low', n, 1)} as lo, {full('max', 'high', n, 1)} as hi from atr_w)")


cte("sigc", " union all ".join(f"select '{k}' as candidate, asset, ts, side from ({sweep_sql(n) if f == 'sweep' else donchian_sql(n, 40)})" for k, (f, n) in SETS.items()))
edge_cte("cedges", "sigc", ["candidate", "asset"], [5])


def candidate_edges(spark, sf):
    """Edges of all candidates in one job: bars and ATR are prepared once, one union of signals, one edge pass."""
    bars = materialise(C.with_atr(BARS(spark, sf)), "atr")
    out = None
    for k, (f, n) in SETS.items():
        s = E.liquidity_sweep(bars.drop("atr"), n, 0.1) if f == "sweep" else E.donchian_breakout(bars, n, 40)
        s = s.withColumn("candidate", F.lit(k))
        out = s if out is None else out.unionByName(s)
    return L.edge_events(out, bars, [5], ["candidate", "asset"])


cte("mic", "select candidate, cast(date_trunc('month', ts) as date) as month, avg(edge) as ic, count(*) as n from cedges group by 1, 2")


@query("n1_monthly_ic", "select candidate, month, round(ic, 6) as ic, n from mic")
def n1(spark, sf):
    return rounded(N.monthly_ic(candidate_edges(spark, sf)))


@query("n1_icir", "select candidate, cast(sum(n) as bigint) as events, round(avg(ic), 6) as mean_ic, round(case when count(*) >= 12 then avg(ic) / stddev_samp(ic) end, 6) as icir, count(*) as months from mic group by 1")
def n1b(spark, sf):
    return rounded(N.icir(N.monthly_ic(candidate_edges(spark, sf))))


cte("regm", "select month, case when mv is null then null when mv <= -0.001 then 'down' when mv <= 0.001 then 'flat' else 'up' end as regime from (select month, avg(c / case when pm = month - interval 1 month then pc end - 1) as mv from (select *, lag(c) over w as pc, lag(month) over w as pm from (select asset, cast(date_trunc('month', ts) as date) as month, last(close order by ts) as c from bars_w group by 1, 2) window w as (partition by asset order by month)) group by 1)")
WIDE = "select candidate, avg(cast(e > 0 as int)) as breadth, string_agg(sector || ':' || cast(round(e * 10000) as bigint) || ':' || n, ';' order by sector) as by_group from ({}) group by 1"
cte("wide", WIDE.format("select candidate, sector, avg(edge) as e, count(*) as n from cedges join sect using (asset) group by 1, 2"))
cte("wide_a", WIDE.format("select candidate, asset as sector, e, n from (select *, count(*) filter (where n >= 3) over (partition by candidate) as many from (select candidate, asset, avg(edge) as e, count(*) as n from cedges group by 1, 2)) where many < 5 or n >= 3"))
cte("shelf", """select b.*, coalesce(x.longest, 0) as longest_bad_run, r.rp as regimes_positive, r.rs as regimes_seen, g.breadth, g.by_group from (select candidate, count(*) as months, avg(cast(ic > 0 as int)) as pos_months, avg(ic) filter (where k <= n // 2) as ic_first_half, avg(ic) filter (where k > n // 2) as ic_second_half from (select candidate, ic, row_number() over (partition by candidate order by month) as k, count(*) over (partition by candidate) as n from mic) group by 1) b
  left join (select candidate, max(len) as longest from (select candidate, grp, count(*) as len from (select *, row_number() over (partition by candidate order by month) - row_number() over (partition by candidate, ic <= 0 order by month) as grp from mic) where ic <= 0 group by 1, 2) group by 1) x using (candidate)
  left join (select candidate, count(*) filter (where e > 0) as rp, count(*) as rs from (select candidate, regime, avg(ic) as e from mic join regm using (month) where regime is not null group by 1, 2) group by 1) r using (candidate)
  left join wide g using (candidate)""")
SHELF = ["pos_months", "ic_first_half", "ic_second_half", "breadth"]


def shelf(spark, sf, events, by_sector=True, bars=None):
    return N.shelf_life(events, N.market_regimes(BARS(spark, sf) if bars is None else bars, 0.001), S.sectors(spark, sf).select("asset", "sector") if by_sector else None)


SHELF_SQL = f"select candidate, months, {', '.join(f'round({c}, 6) as {c}' for c in SHELF)}, by_group, longest_bad_run, regimes_positive, regimes_seen from "


@query("n2_shelf_life", SHELF_SQL + "shelf")
def n2(spark, sf):
    return rounded(shelf(spark, sf, materialise(candidate_edges(spark, sf), "edges")))


cte("shelf_a", CTES["shelf"].replace("left join wide g", "left join wide_a g"))


@query("n2_shelf_life_assets", SHELF_SQL + "shelf_a")
def n2b(spark, sf):
    return rounded(shelf(spark, sf, materialise(candidate_edges(spark, sf), "edges"), by_sector=False))


WINDOWS = {"s": ("1990-01-01", "1998-12-31"), "v": ("1999-01-01", "2010-12-31")}


def wsql(w):
    a, b = WINDOWS[w]
    return f"select candidate, cast(sum(n) as bigint) as {w}_events, avg(ic) as {w}_ic, case when count(*) >= 12 then avg(ic) / stddev_samp(ic) end as {w}_icir, count(*) as {w}_months from (select candidate, date_trunc('month', ts) as m, avg(edge) as ic, count(*) as n from cedges where ts between date '{a}' and date '{b}' group by 1, 2) group by 1"


cte("wscore", f"select * from ({wsql('s')}) join ({wsql('v')}) using (candidate)")
WCOLS = [f"{w}_{c}" for w in "sv" for c in ("events", "ic", "icir", "months")]


@query("n3_windows_score", "select candidate, " + ", ".join(f"round({c}, 6) as {c}" if c.endswith(("ic", "icir")) else c for c in WCOLS) + " from wscore")
def n3(spark, sf):
    return rounded(N.windows_score(candidate_edges(spark, sf), WINDOWS))


IC = "sin(n) + share"


@query("n5_plateau", f"""select g.id, coalesce(k.c, 0) as neighbours, round(case when k.c >= 2 and g.ic > 0 then k.m / g.ic end, 6) as plateau from gic g left join (select id, count(*) as c, avg(oic) as m from (
  select a.id, b.ic as oic from gic a join gic b on a.family = b.family and a.rule = b.rule and a.segment = b.segment and a.share = b.share and a.n <> b.n and b.n / a.n between 0.6 and 1.67 union all
  select a.id, b.ic from gic a join gic b on a.family = b.family and a.rule = b.rule and a.segment = b.segment and a.n = b.n and a.share <> b.share and b.share / a.share between 0.6e0 and 1.67e0) group by 1) k using (id)""", gic=f"select *, {IC} as ic from grid_c")
def n5(spark, sf):
    reg = materialise(grid(spark, sf), "grid").withColumn("ic", F.sin(F.col("params")["n"]) + F.col("params")["share"])
    return rounded(N.plateau(reg, ["family", "rule", "segment"]))


cte("hw", """select asset as try_id, cast(ts + cast((5 - isodow(ts) + 7) % 7 as int) as date) as week, sum(ret - b * bench) as r from (select r.*, m.bench, b.b from ret_w r join mean_r m using (ts) join (select asset, case when count(*) >= 30 and var_samp(bench) > 0 then covar_samp(ret, bench) / var_samp(bench) else 0 end as b from ret_w join mean_r using (ts)
  where ret is not null and bench is not null group by 1) b using (asset) where r.ret is not null and m.bench is not null) group by 1, 2""")


def weekly(spark, sf):
    return N.hedged_weekly(pairs(spark, sf).select(F.col("account").alias("try_id"), "ts", "ret", "bench"))


@query("n6_hedged_weekly", "select try_id, week, round(r, 8) as r from hw")
def n6(spark, sf):
    return rounded(weekly(spark, sf), 8)


@query("n7_try_stats", "select try_id, any_value(n) as weeks, round(any_value(m / s), 6) as sharpe, round(any_value(m / s * sqrt(n)), 6) as t, round(avg(pow((r - m) / p, 3)), 6) as skew, round(avg(pow((r - m) / p, 4)), 6) as kurt from (select *, count(*) over w as n, avg(r) over w as m, stddev_samp(r) over w as s, stddev_pop(r) over w as p from hw window w as (partition by try_id)) group by 1")
def n7(spark, sf):
    return rounded(N.try_stats(weekly(spark, sf)))


def null_ctes(p, weekly, replays=N.REPLAYS):
    """The largest t of each replay of a weekly cte, `{p}`."""
    cte(f"{p}_cal", f"select week, row_number() over (order by week) - 1 as i from (select distinct week from {weekly})")
    cte(f"{p}_u", f"select replay, i, n, {mixed_uniform_sql(mixed_sql(1, 'replay', 'i'))} as u, {mixed_uniform_sql(mixed_sql(2, 'replay', 'i'))} as v from {p}_cal, (select unnest(range(1, {replays + 1})) as replay), (select count(*) as n from {p}_cal)")
    cte(f"{p}_g", f"select replay, i, n, case when i = 0 or u < 0.25 then floor(v * n) end as s, case when i = 0 or u < 0.25 then i end as at_i from {p}_u")
    cte(f"{p}_src", f"select replay, (last_value(s ignore nulls) over w + i - last_value(at_i ignore nulls) over w) % n as src from {p}_g window w as (partition by replay order by i)")
    return cte(p, f"""select replay, max(s) / sqrt((select count(*) from {p}_cal)) as max_t from (select c.replay, z.try_id, sum(z.z * c.times) as s from (select h.try_id, h.week, (h.r - m) / s as z from {weekly} h join (select try_id, avg(r) as m, stddev_samp(r) as s from {weekly} group by 1) using (try_id) where s > 1e-9) z
      join (select replay, w.week, count(*) as times from {p}_src b join {p}_cal w on w.i = b.src group by 1, 2) c using (week) group by 1, 2) group by 1""")


null_ctes("nmax", "hw")


@query("n8_null_max", "select replay, round(max_t, 6) as max_t from nmax")
def n8(spark, sf):
    return rounded(N.null_max(materialise(weekly(spark, sf), "weekly")))


def horner_sql(coefficients) -> str:
    text = str(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * a + {c})"
    return text


cte("tstat", "select try_id, any_value(n) as weeks, any_value(m / s) as sharpe, any_value(m / s * sqrt(n)) as t, avg(pow((r - m) / p, 3)) as skew, avg(pow((r - m) / p, 4)) as kurt from (select *, count(*) over w as n, avg(r) over w as m, stddev_samp(r) over w as s, stddev_pop(r) over w as p from hw window w as (partition by try_id)) group by 1")
def deflated_ctes(p, stats, bar):
    """`{p}`: the rows of a cte of try statistics with `deflated` against the bar, a scalar."""
    cte(f"{p}_z", f"select *, (sharpe - {bar} / sqrt(weeks)) * sqrt(greatest(weeks - 1, 1)) / sqrt(greatest(1e-12, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe)) as z from {stats}")
    cte(f"{p}_tail", f"""select *, exp(-a * a / 2) * case when a < 7.07106781186547e0 then {horner_sql([f'{c!r}::double' for c in N.TAIL_TOP])} / {horner_sql([f'{c!r}::double' for c in N.TAIL_BELOW])}
      else 1 / ((a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65e0))))) * {(2 * math.pi) ** 0.5!r}) end as tail from (select *, abs(z) as a from {p}_z)""")
    return cte(p, f"select *, case when z > 0 then 1 - tail else tail end as deflated from {p}_tail")


deflated_ctes("tdef", "tstat", "(select avg(max_t) from nmax)")


@query("n9_deflated", "select try_id, weeks, round(sharpe, 6) as sharpe, round(t, 6) as t, round(skew, 6) as skew, round(kurt, 6) as kurt, round((select avg(max_t) from nmax), 6) as bar, round(deflated, 6) as deflated from tdef")
def n9(spark, sf):
    w = materialise(weekly(spark, sf), "weekly")
    bar = N.null_max(w).agg(F.avg("max_t").alias("b")).first().b
    return rounded(N.deflated(N.try_stats(w), bar).withColumn("bar", F.lit(bar)).select("try_id", "weeks", "sharpe", "t", "skew", "kurt", "bar", "deflated"))


@query("n9_effective_n")
def n9b(spark, sf):
    """The measured bar of all tries, and how many independent ones would put it there."""
    bars = N.null_max(materialise(weekly(spark, sf), "weekly")).agg(F.count("*").alias("replays"), F.avg("max_t").alias("bar"))
    bar = bars.first().bar
    return rounded(bars.withColumn("independent_tries", F.lit(N.effective_n(bar))), 4)


STEPS = " ".join(f"when u < {x!r} then {k}" for k, x in enumerate(N.poisson_steps()))


@query("n11_trade_bootstrap", f"""select n as trades, round(a, 6) as avg_r, round(quantile_cont(m, 0.05), 6) as p05, round(quantile_cont(m, 0.95), 6) as p95, round(avg(cast(m <= 0 as int)), 6) as p_loss from (select draw, sum(r * w) / sum(w) as m from (select draw, r, case {STEPS} else {len(N.poisson_steps())} end as w from bdraw) group by 1 having sum(w) > 0), (select count(*) as n, avg(r) as a from trades) group by n, a""",
       bdraw=f"select draw, r, {mixed_uniform_sql(f'((x + y) % {E.MIX_PRIME})')} as u from (select r, {mixed_sql(1, 'ascii(strategy)', 'asset', 'fill_no')} as x from trades), (select draw, {mixed_sql(2, 'draw')} as y from (select unnest(range(1, {N.TRADE_DRAWS + 1})) as draw))")
def n11(spark, sf):
    return rounded(N.trade_bootstrap(materialise(trades(spark, sf), "ledger")))


@query("n11_day_bootstrap", f"""select w.account, n as days, round(exp(g / (n / 365.25)) - 1, 6) as cagr, round(p05, 6) as p05, round(p95, 6) as p95, round(p_loss, 6) as p_loss from (select account, n, sum(g) as g from dday group by 1, 2) w join (select account, quantile_cont(c, 0.05) as p05, quantile_cont(c, 0.95) as p95, avg(cast(c <= 0 as int)) as p_loss
  from (select account, draw, exp(sum(b.g) / (any_value(d.n) / 365.25)) - 1 as c from ddraw d join dblock b using (account, i) where b.last = (d.j = d.k - 1) group by 1, 2) group by 1) using (account) where n >= 30""",
       dday="select account, d, ln(1 + d) as g, row_number() over (partition by account order by ts) - 1 as i, count(*) over (partition by account) as n from (select account, ts, equity / lag(equity) over (partition by account order by ts) - 1 as d from ledeq) where d is not null",
       dblock="select a.account, a.i, t.last, sum(b.g) as g from dday a, (select unnest([true, false]) as last) t join dday b on b.account = a.account and b.i between a.i and a.i + case when t.last then a.n - (cast(ceil(a.n / 10) as bigint) - 1) * 10 else 10 end - 1 group by 1, 2, 3",
       ddraw=f"select account, n, k, draw, j, cast(floor({mixed_uniform_sql(mixed_sql(1, 'draw', 'j'))} * (n - 9)) as bigint) as i from (select account, n, k, draw, unnest(range(0, k)) as j from (select distinct account, n, cast(ceil(n / 10) as bigint) as k from dday), (select unnest(range(1, {N.DAY_DRAWS + 1})) as draw))")
def n11b(spark, sf):
    return rounded(N.day_bootstrap(ledger(spark, sf)))


#: The scored candidates: two families, each parameter with two neighbours, and each candidate with a random twin.
SCORED = {f"{f}-{n}": (f, n) for f, ns in (("sweep", (4, 5, 6, 8)), ("donchian", (10, 12, 16))) for n in ns}
SCORE_RISK = 0.005
cte("fsig", " union all ".join(f"select '{k}' as candidate, asset, ts, side from ({sweep_sql(n) if f == 'sweep' else donchian_sql(n, 40)})" for k, (f, n) in SCORED.items()))
cte("ftwin", f"""select candidate || '~' as candidate, asset, ts, case when {uniform_sql(8, 'asset', DAYNO)} < 0.5 then 1 else -1 end as side from (select c.candidate, b.asset, b.ts, count(s.side) over (partition by c.candidate, b.asset) / count(*) over (partition by c.candidate, b.asset) as rate
  from bars_w b cross join (select distinct candidate from fsig) c left join fsig s on s.candidate = c.candidate and s.asset = b.asset and s.ts = b.ts) where {uniform_sql(7, 'asset', DAYNO)} < rate""")
cte("fboth", "select * from fsig union all select * from ftwin")
edge_cte("fedges4", "fsig", ["candidate", "asset"], [1, 2, 5, 10])
cte("fedges", "select * from fedges4 where horizon = 5")
for _name in ("mic", "wide", "shelf"):
    cte(f"f{_name}", re.sub(r"\b(cedges|mic|wide)\b", lambda m: {"cedges": "fedges"}.get(m[0], f"f{m[0]}"), CTES[_name]))
cte("fwscore", CTES["wscore"].replace("cedges", "fedges"))
cte("rule1", "select 0 as rule_no, 'rule' as rule, 1.0e0 as stop_atr, 1.5e0 as rr, 2.0e0 as rr_strong, 8 as max_bars, 1.5e0 as trail_atr, true as strong")
ledger_ctes("fled", "fboth", "candidate", "rule1")
cte("fwin", "select replace(candidate, '~', '') as candidate, " + ", ".join(
    f"avg(r) filter ({{i}} and {{o}}) as {w}_avg_r, exp(sum(ln(1 + greatest({SCORE_RISK} * r, -0.999999))) filter ({{i}} and {{o}})) - 1 as {w}_ret, avg(r) filter ({{i}} and not {{o}}) as {w}_rand_avg_r".format(i=f"entry_ts between date '{a}' and date '{b}'", o="not contains(candidate, '~')")
    for w, (a, b) in WINDOWS.items()) + " from fled group by 1")
cte("fheld", f"select t.candidate, t.asset, t.entry_ts, b.ts, b.bn, t.side * ((case when b.ts = t.exit_ts then t.exit else b.close end) - t.entry) / t.risk - case when b.ts = t.exit_ts then t.fees_r else 0 end as now_r from fled t join atr_w b on b.asset = t.asset and b.ts between t.entry_ts and t.exit_ts where not contains(candidate, '~') and t.entry_ts between date '{WINDOWS['s'][0]}' and date '{WINDOWS['s'][1]}'")
cte("fret", f"select candidate as try_id, ts, {SCORE_RISK} * sum(step) as ret from (select *, now_r - coalesce(lag(now_r) over (partition by candidate, asset, entry_ts order by bn), 0) as step from fheld) group by 1, 2")
cte("fhw", CTES["hw"].replace("asset as try_id", "try_id").replace("select asset, case", "select try_id, case").replace("using (asset)", "using (try_id)").replace("ret_w", "fret"))
cte("fstat", CTES["tstat"].replace("from hw", "from fhw"))
cte("fcould", "select fhw.* from fhw join fwscore on candidate = try_id where s_events >= 100")
null_ctes("fmax", "fcould")
deflated_ctes("fdef", "fstat", "(select coalesce(avg(max_t), 0) from fmax)")
cte("fcurve", f"""select candidate, arg_max(horizon, (edge, -horizon)) as peak_h, max(case when horizon = 5 then edge end) / nullif(greatest(max(edge), 0), 0) as exit_vs_peak from (select candidate, horizon, avg(edge) as edge from fedges4 where ts between date '{WINDOWS['s'][0]}' and date '{WINDOWS['s'][1]}' group by 1, 2) group by 1""")
cte("fids", "select candidate, string_split(candidate, '-')[1] as family, cast(string_split(candidate, '-')[2] as int) as n, s_ic from fwscore")
cte("fplat", "select a.candidate, case when count(b.candidate) >= 2 and a.s_ic > 0 then avg(b.s_ic) / a.s_ic end as plateau from fids a left join fids b on a.family = b.family and a.n <> b.n and b.n / a.n between 0.6e0 and 1.67e0 group by a.candidate, a.s_ic")
cte("scored", "select w.*, f.* exclude candidate, s.* exclude candidate, c.* exclude candidate, p.plateau, d.deflated as s_dsr, string_split(w.candidate, '-')[1] as family from fwscore w left join fwin f using (candidate) left join fshelf s using (candidate) left join fcurve c using (candidate) left join fplat p using (candidate) left join fdef d on d.try_id = w.candidate")
cte("gated", "select *, " + " + ".join(f"cast(coalesce({g}, false) as int)" for _, g in N.GATES) + " as passed, concat_ws('; ', " + ", ".join(f"case when not coalesce({g}, false) then '{n}' end" for n, g in N.GATES) + ") as failed from scored")


def scorecard(spark, sf):
    """Every number the gates and the verdict ask for: edges, trades of the candidates and of their random twins, luck."""
    bars = materialise(trade_bars(spark, sf), "bars")
    plain = bars.drop("atr", "adx", "blocked")
    # one pass for all candidates: a branch each would put their sorts and windows side by side in the tasks of the union
    rules = {k: E.sweep_side(n, 0.1) if f == "sweep" else E.breakout_side(n, 40) for k, (f, n) in SCORED.items()}
    own_ = materialise(E.fired_each(bars, rules), "signals")
    twins = E.random_twins(own_, plain, 7).withColumn("candidate", F.concat("candidate", F.lit("~")))
    curve = materialise(L.edge_events(own_, bars, [1, 2, 5, 10], ["candidate", "asset"]), "edges")
    events = curve.filter("horizon = 5")
    both = own_.unionByName(twins)
    led = materialise(L.ledger(both, bars, RULE, COSTS, ["candidate", "asset"]), "ledger")
    a, b = WINDOWS["s"]
    scores = materialise(N.windows_score(events, WINDOWS), "windows")
    search = led.filter(~F.col("candidate").endswith("~") & F.col("entry_ts").between(F.lit(a).cast("date"), F.lit(b).cast("date")))
    bench = M.with_returns(plain.select(F.col("asset").alias("account"), "ts", F.col("close").alias("equity"))).groupBy("ts").agg(F.avg("ret").alias("bench"))
    hedged = N.hedged_weekly(M.ledger_returns(search, plain, SCORE_RISK, "candidate").withColumnRenamed("candidate", "try_id").join(bench, "ts"))
    luck = N.luck_scores(hedged, scores.select(F.col("candidate").alias("try_id"), F.col("s_events").alias("events"))).select(F.col("try_id").alias("candidate"), F.col("deflated").alias("s_dsr"))
    peaks = L.edge_curve(curve.filter(F.col("ts").between(F.lit(a).cast("date"), F.lit(b).cast("date"))), 5, ["candidate"]).drop("peak")
    registry = scores.select(F.col("candidate").alias("id"), F.split("candidate", "-")[0].alias("family"), F.create_map(F.lit("n"), F.split("candidate", "-")[1].cast("double")).alias("params"), "s_ic")
    near = N.plateau(registry, ["family"], "s_ic").select(F.col("id").alias("candidate"), "plateau")
    df = scores.withColumn("family", F.split("candidate", "-")[0])
    for part in (N.window_trades(led, WINDOWS, SCORE_RISK), shelf(spark, sf, events, bars=plain), luck, peaks, near):
        df = df.join(part, "candidate", "left")
    return df


def gated_scores(spark, sf):
    return N.apply_gates(scorecard(spark, sf), [(n, F.expr(g)) for n, g in N.GATES])


CARD = ["s_avg_r", "s_rand_avg_r", "v_avg_r", "v_rand_avg_r", "v_ret", "s_dsr", "exit_vs_peak", "plateau"]


@query("n4_gates", f"select candidate, {', '.join(f'round({c}, 6) as {c}' for c in CARD)}, peak_h, passed, failed from gated")
def n4(spark, sf):
    return rounded(gated_scores(spark, sf).select("candidate", *CARD, "peak_h", "passed", "failed"))


@query("n12_lineage", "select id, root, depth from lin", lin="select c_custkey as id, c_custkey as root, 0 as depth from customer where c_custkey % 50 = 0 union all select c.c_custkey, l.root, l.depth + 1 from lin l join customer c on c.c_custkey - 1 - c.c_custkey % 3 % (c.c_custkey % 50) = l.id where c.c_custkey % 50 <> 0")
def n12(spark, sf):
    k = F.col("c_custkey")
    nodes = S.table(spark, sf, "customer").select(k.alias("id"), F.expr("case when c_custkey % 50 <> 0 then c_custkey - 1 - c_custkey % 3 % (c_custkey % 50) end").alias("parent"))
    return N.lineage(nodes)


CAMP = "select c_custkey as id, c_custkey - c_custkey % 50 as root, c_custkey % 50 // 5 as depth, cast(round(c_acctbal) as int) % 15 as passed, case when c_custkey % 7 > 0 then c_acctbal / 1000 end as icir from customer"


@query("n13_campaigns", f"""select root, id as best_id, passed as best_passed, rounds, tried, last_gain, path, case when passed >= {len(N.GATES)} then 'done' when ic < 0.2 then 'stopped' when rounds >= 5 then 'finished' else 'improving' end as status from (select *, row_number() over (partition by root order by passed desc, ic desc, depth, id desc) as rn, max(depth) over (partition by root) as rounds, count(*) over (partition by root) as tried from cm)
  join (select root, max(depth) as last_gain from (select root, depth, b, max(b) over (partition by root order by depth rows between unbounded preceding and 1 preceding) as pb from (select root, depth, max(row(passed, ic)) as b from cm group by 1, 2)) where pb is null or b > pb group by 1) using (root)
  join (select root, string_agg(best, ',' order by k) as path from (select r.root, k, coalesce(max(passed) filter (depth <= k), 0) as best from (select root, unnest(range(0, max(depth) + 1)) as k from cm group by root) r join cm using (root) group by 1, 2) group by 1) using (root) where rn = 1""", cm=f"select *, coalesce(icir, -1e9) as ic from ({CAMP})")
def n13(spark, sf):
    c = S.table(spark, sf, "customer").selectExpr("c_custkey as id", "c_custkey - c_custkey % 50 as root", "cast(c_custkey % 50 div 5 as bigint) as depth", "cast(round(c_acctbal) as int) % 15 as passed", "case when c_custkey % 7 > 0 then c_acctbal / 1000 end as icir")
    return N.campaigns(c)


@query("n14_same_idea", """select s_suppkey as try_id, 'family' as why from supplier where s_acctbal >= 1000 and s_nationkey in (select s_nationkey from supplier where s_acctbal < 1000) union all
  select distinct c.try_id, 'returns' from (select b.try_id, a.try_id as t, corr(b.r, a.r) as c from hw b join hw a using (week) where a.try_id in (select s_suppkey from supplier where s_acctbal < 1000) and b.try_id in (select s_suppkey from supplier where s_acctbal >= 1000) group by 1, 2) c where c.c >= 0.1""")
def n14(spark, sf):
    s = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("try_id"), F.col("s_nationkey").alias("family"), "s_acctbal")
    return N.same_idea(s.filter("s_acctbal < 1000"), s.filter("s_acctbal >= 1000"), materialise(weekly(spark, sf), "weekly"), 0.1)


@query("n15_failure_reasons", "select reason, count(*) as n from (select unnest(string_split(failed, '; ')) as reason from gated where failed <> '') group by 1")
def n15(spark, sf):
    return N.failure_reasons(gated_scores(spark, sf))


@query("n15_best_of_family", "select family, candidate, passed, round(s_icir, 6) as s_icir, members from (select *, row_number() over (partition by family order by passed desc, coalesce(s_icir, -1e9) desc, candidate desc) as k, count(*) over (partition by family) as members from gated) where k = 1")
def n15b(spark, sf):
    return rounded(N.best_of_family(gated_scores(spark, sf)))


@query("n16_registry_topk", "select candidate, passed from gated order by passed desc, s_icir desc limit 3")
def n16(spark, sf):
    return gated_scores(spark, sf).orderBy(F.desc("passed"), F.desc("s_icir")).limit(3).select("candidate", "passed")


cte("sc", "select * from (select ts, mom as score, lead(close) over (partition by asset order by ts) / close - 1 as target from fx_w) where score is not null and target is not null")
cte("icrep", """select i.ts, i.ic, i.n, t.top from (select ts, corr(a, b) as ic, count(*) as n from (select ts, rank() over (partition by ts order by score) + (count(*) over (partition by ts, score) - 1) / 2 as a, rank() over (partition by ts order by target) + (count(*) over (partition by ts, target) - 1) / 2 as b from sc) group by 1) i
  left join (select ts, avg(target) as top from sc join (select ts, quantile_cont(score, 0.9) as q from sc group by 1) using (ts) where score >= q group by 1) t using (ts)""")


def ic_weeks(spark, sf):
    from ..functions.windows import own
    p = PAN(spark, sf).withColumns({"score": P.momentum(52, 4), "target": F.lead("close").over(own()) / F.col("close") - 1}).select("ts", "score", "target")
    return N.ic_report(materialise(p, "scores"))


@query("n17_ic_report", "select ts, round(ic, 6) as ic, n, round(top, 8) as top from icrep")
def n17(spark, sf):
    return ic_weeks(spark, sf).select("ts", F.round("ic", 6).alias("ic"), "n", F.round("top", 8).alias("top"))


@query("n17_ic_by_year", "select year(ts) as year, round(avg(ic), 6) as ic, round(stddev_samp(ic), 6) as ic_sd, round(avg(top), 6) as top, count(*) as weeks, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) as icir from icrep group by 1")
def n17b(spark, sf):
    return rounded(N.ic_by_year(ic_weeks(spark, sf)))


@query("n21_time_split", "select ts, case when row_number() over (order by ts) <= floor(0.6 * count(*) over ()) then 'train' else 'test' end as part from (select distinct ts from bars_h)")
def n21(spark, sf):
    return N.time_split(S.hourly_bars(spark, sf))


cte("twin2", " union all ".join(f"""select '{k}' as strategy, asset, ts, case when {uniform_sql(8, 'asset', DAYNO)} < 0.5 then 1 else -1 end as side from (
  select b.asset, b.ts, count(s.side) over (partition by b.asset) / count(*) over (partition by b.asset) as rate from bars_w b left join {t} s using (asset, ts)) where {uniform_sql(7, 'asset', DAYNO)} < rate""" for k, t in (("sweep", "e16_w"), ("donchian", "e1_w"))))
edge_cte("tedges", "twin2", ["strategy", "asset"], [5])
edge_cte("oedges", "sig2", ["strategy", "asset"], [5])


@query("n23_forward_report", """select strategy, since, round(date_diff('day', since, last) / 7, 1) as weeks, coalesce(n, 0) as signals, round(total, 6) as total, round(m, 6) as avg_edge, round(r, 6) as rand_avg_edge,
  case when coalesce(n, 0) = 0 then 'no new bars yet' else (case when coalesce(total > 0 and m > r, false) then 'holding up' else 'behind' end) || (case when date_diff('day', since, last) / 7 < 5.95 then ' (too early to judge)' else '' end) end as status
  from grads left join (select strategy, count(edge) as n, sum(edge) as total, avg(edge) as m from oedges join grads using (strategy) where ts >= since group by 1) using (strategy)
  left join (select strategy, avg(edge) as r from tedges join grads using (strategy) where ts >= since group by 1) using (strategy)""",
       grads="select strategy, cast(last - back as date) as since, last from (values ('sweep', 1500), ('donchian', 30)) v(strategy, back), (select max(ts) as last from bars_w)")
def n23(spark, sf):
    bars = BARS(spark, sf)
    own_ = signals(spark, sf)
    twins = [E.random_twin(own_.filter(F.col("strategy") == k).drop("strategy"), bars, 7).select(F.lit(k).alias("strategy"), "asset", "ts", "side") for k in ("sweep", "donchian")]
    edge = lambda s: L.edge_events(s, C.with_atr(bars), [5], ["strategy", "asset"])
    last = bars.agg(F.max("ts").alias("last")).select("last")
    grads = spark.createDataFrame([("sweep", 1500), ("donchian", 30)], "strategy string, back int").withColumn("last", last.scalar()).select("strategy", F.date_sub("last", F.col("back")).alias("since"))
    return rounded(N.forward_report(grads, edge(own_), edge(twins[0].unionByName(twins[1])), last.scalar()))


@query("n24_coverage_counts", "select rule, segment, count(*) as tries from grid_c group by 1, 2")
def n24(spark, sf):
    return grid(spark, sf).groupBy("rule", "segment").agg(F.count("*").alias("tries"))


@query("n25_missing_scores", "select c_custkey as id, round(coalesce(case when c_custkey % 7 > 0 then c_acctbal / 1000 end, t), 6) as icir from customer left join (select o_custkey, max(o_totalprice) / 1e6 as t from orders group by 1) on o_custkey = c_custkey")
def n25(spark, sf):
    c = S.table(spark, sf, "customer").selectExpr("c_custkey as id", "case when c_custkey % 7 > 0 then c_acctbal / 1000 end as icir")
    o = S.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.max("o_totalprice") / 1e6).alias("icir"))
    return rounded(N.fill_missing(c, o, ["icir"]))


@query("n26_period_table", "select 'last ' || y || 'y' as window, cast(\"end\" - to_months(12 * y) as date) as start, \"end\" from (select max(ts) as \"end\" from cal_d), (select unnest([1, 3, 5]) as y)")
def n26(spark, sf):
    return N.period_table(cal_d(spark, sf), [1, 3, 5])




null_ctes("lmax", "lhw")
cte("lev", "select s_suppkey as try_id, coalesce(n, 0) as events from supplier left join (select asset, count(*) as n from e16_w group by 1) on asset = s_suppkey")
cte("lhw", "select hw.* from hw join lev using (try_id) where events >= 30")
deflated_ctes("ldef", "tstat", "(select avg(max_t) from lmax)")


@query("n10_luck_scores", "select try_id, events, round(t, 6) as t, round((select avg(max_t) from lmax), 6) as bar, round(deflated, 6) as deflated, case when events >= 30 and deflated is not null then deflated >= 0.9 end as beats_luck from lev left join ldef using (try_id)")
def n10(spark, sf):
    from .asset_signals import sweeps
    fired_ = sweeps(spark, sf).groupBy(F.col("asset").alias("try_id")).agg(F.count("*").alias("_n"))
    events = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("try_id")).join(fired_, "try_id", "left").select("try_id", F.coalesce("_n", F.lit(0)).alias("events"))
    return rounded(N.luck_scores(weekly(spark, sf), materialise(events, "events"), least=30))


@query("n18_vault_verdict", "select candidate, round(v_ret, 6) as v_ret, round(v_avg_r, 6) as v_avg_r, round(v_rand_avg_r, 6) as v_rand_avg_r, round(v_ic, 6) as v_ic, round(v_icir, 6) as v_icir, coalesce(v_ret > 0 and v_avg_r > v_rand_avg_r and v_ic > 0 and v_icir >= 0.5 * s_icir, false) as verdict from scored")
def n18(spark, sf):
    return rounded(N.vault_verdict(scorecard(spark, sf)).select("candidate", "v_ret", "v_avg_r", "v_rand_avg_r", "v_ic", "v_icir", "verdict"))


#: Exit families of the study, each tuned by itself: one reward for every trade, a trailing stop, a reward by trend.
MODES = {
    "fixed": {f"{s}/{r}": L.ExitRule(s, r, max_bars=8) for s in (1.5, 2.0, 2.5, 3.0) for r in (1.5, 2.0, 3.0, 4.0)},
    "trailing": {f"{s}/run/{t}": L.ExitRule(s, None, max_bars=8, trail_atr=t) for s in (2.0, 3.0) for t in (2.0, 3.0, 4.0, 5.0)},
    "adaptive": {f"{s}/{a}-{b or 'run'}": L.ExitRule(s, a, b, 8, t, adaptive=True) for s in (1.5, 2.0, 2.5, 3.0) for a, b, t in ((2.0, 3.0, None), (2.0, 4.0, None), (1.5, 3.0, None), (2.0, None, 3.0))},
}
MODE_ROWS = [(m, no, n) for no, (m, n) in enumerate((m, n) for m, rules in MODES.items() for n in rules)]
EVERY_RULE = {f"{m} {n}": r for m, rules in MODES.items() for n, r in rules.items()}


def _sql_value(v):
    return "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


cte("xrules", "select rule_no, rule, string_split(rule, ' ')[1] as mode, cast(stop_atr as double) as stop_atr, cast(rr as double) as rr, cast(rr_strong as double) as rr_strong, max_bars, cast(trail_atr as double) as trail_atr, strong from (values " + ", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in L.rule_rows(EVERY_RULE)) + ") v(rule_no, rule, stop_atr, rr, rr_strong, max_bars, trail_atr, strong)")
ledger_ctes("xled", "sig2", "strategy", "xrules")
cte("xtrain", "select l.*, string_split(rule, ' ')[1] as mode, unnest(range(year(exit_ts) + 1, year(entry_ts) + 5)) as year from xled l")
cte("xgrid", "select strategy, mode, year, rule_no, rule, count(*) as trades, avg(r) / nullif(stddev_samp(r), 0) as quality from xtrain group by all")
cte("xyears", "select unnest(range(year(d) + 4 + case when dayofyear(d) > 1 then 1 else 0 end, year(l) + 1)) as year from (select cast(min(ts) + interval 250 day as date) as d, max(ts) as l from bars_w)")
cte("xbest", "select g.strategy, g.mode, g.year, coalesce(b.rule_no, f.rule_no) as rule_no, coalesce(b.rule, f.rule) as rule, b.quality from (select distinct strategy, string_split(rule, ' ')[1] as mode, year from xled, xyears) g left join (select * from (select *, row_number() over (partition by strategy, mode, year order by round(quality, 9) desc, rule_no) as k from xgrid where trades >= 10 and quality is not null) where k = 1) b using (strategy, mode, year) join (select mode, min(rule_no) as rule_no, arg_min(rule, rule_no) as rule from xrules group by 1) f on f.mode = g.mode")
cte("xtest", "select strategy, rule_no, year(entry_ts) as year, count(*) as trades, sum(r) as sum_r, sum(ln(1 + greatest(0.01 * r, -0.999999))) as g from xled group by 1, 2, 3")


def rule_ledger(spark, sf):
    """Every signal under every exit rule, one position at a time for each rule."""
    kept = L.ledger("fires", market(spark, sf), EVERY_RULE, COSTS, ["strategy", "asset"])
    return kept.withColumn("mode", F.split("rule", " ")[0])


@query("n19_exit_rule_grid", "select strategy, string_split(rule, ' ')[1] as mode, rule, count(*) as trades, round(avg(r), 6) as avg_r, round(avg(r) / nullif(stddev_samp(r), 0), 6) as quality from xled group by 1, 2, 3")
def n19(spark, sf):
    return rounded(N.exit_rule_grid(rule_ledger(spark, sf), ["strategy", "mode"]).drop("rule_no"))


@query("n19_walk_forward_tuning", "select strategy, mode, year, b.rule, round(b.quality, 6) as quality, coalesce(t.trades, 0) as trades, round(coalesce(sum_r, 0), 6) as sum_r, round(exp(coalesce(g, 0)) - 1, 6) as ret, round(exp(sum(coalesce(g, 0)) over (partition by strategy, mode order by year)), 6) as equity from xbest b left join xtest t using (strategy, rule_no, year)")
def n19b(spark, sf):
    first = spark.createDataFrame([(m, no, f"{m} {n}") for m, no, n in MODE_ROWS if n == next(iter(MODES[m]))], "mode string, rule_no int, rule string")
    return rounded(N.walk_forward_tuning(rule_ledger(spark, sf), first, ["strategy"], BARS(spark, sf)))


cte("stwin", "select * from sig2 union all select strategy || '~', asset, ts, side from twin2")
ledger_ctes("sled", "stwin", "strategy", "rule1")


@query("n22_study_table", f"""select w as "window", sector as market, replace(strategy, '~', '') as strategy, count(*) filter (o) as trades, round(sum(r) filter (o), 6) as sum_r, round(avg(r) filter (o), 6) as avg_r, round(avg(cast(r > 0 as int)) filter (o), 6) as win_rate, round(sum(fees_r) filter (o) / sum(abs(gross_r)) filter (o), 6) as fee_share, round(avg(exit_no - fill_no + 1) filter (o), 6) as bars_held, round(avg(r) filter (not o), 6) as rand_avg_r
  from (select * replace (replace(strategy, '~', '') as strategy), not contains(strategy, '~') as o, case when entry_ts between date '{WINDOWS['s'][0]}' and date '{WINDOWS['s'][1]}' then 's' when entry_ts between date '{WINDOWS['v'][0]}' and date '{WINDOWS['v'][1]}' then 'v' end as w from sled join sect using (asset)) where w is not null group by grouping sets ((w, sector, strategy), (w, sector))""")
def n22(spark, sf):
    bars = materialise(trade_bars(spark, sf), "bars")
    both = own_ = materialise(signals(spark, sf), "signals")
    for k in ("sweep", "donchian"):
        twin = E.random_twin(own_.filter(F.col("strategy") == k).drop("strategy"), bars, 7).withColumn("strategy", F.lit(f"{k}~"))
        both = both.unionByName(twin.select(*both.columns))
    led = L.ledger(both, bars, RULE, COSTS, ["strategy", "asset"])
    return rounded(N.study_table(led.join(S.sectors(spark, sf).select("asset", F.col("sector").alias("market")), "asset"), WINDOWS))
