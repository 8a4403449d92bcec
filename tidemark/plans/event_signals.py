"""G: signals from filings, on weekly sessions."""

from pyspark.sql import functions as F

from ..functions.ranks import pct_rank
from ..functions.temporal import on_session
from ..functions.windows import session_return
from ..operators import combine as H
from ..operators import event_signals as G
from ..operators import panel_signals as P
from ..operators import pit as D
from ..session import materialise
from ..sources import bindings as S
from .asset_signals import full
from .catalog import cte, query
from .panel_signals import PAN, one, pct

BUYS, BARS = S.purchases, S.weekly_bars


def inputs(spark, sf, buys=None, bars=None):
    """Purchases and bars: those a query with several signals has written once, else made from the tables."""
    return BUYS(spark, sf) if buys is None else buys, BARS(spark, sf) if bars is None else bars


def written_filings(spark, sf, *columns):
    """The filings' join written once with the columns its signals read, and the purchases among them."""
    filed = materialise(S.filings(spark, sf).select("asset", "owner", "filed", "code", *columns), "filings")
    return filed, filed.filter("code = 'P'")


# --- SQL building blocks -------------------------------------------------------------------------------------------
def gap_cte(tag, src, d, gap):
    """Greedy de-duplication of days `d` per asset of `src`: kept days in g_<tag>."""
    cte(f"x_{tag}", f"""select asset, dn, min(dn) over (partition by asset order by dn range between {gap + 1} following and unbounded following) as nxt
      from (select distinct asset, cast(date_diff('day', date '1970-01-01', {d}) as bigint) as dn from {src})""")
    cte(f"gr_{tag}", f"select asset, min(dn) as dn from x_{tag} group by asset union all select x.asset, x.nxt from gr_{tag} g join x_{tag} x on x.asset = g.asset and x.dn = g.dn where x.nxt is not null")
    return cte(f"g_{tag}", f"select asset, date '1970-01-01' + cast(dn as int) as d from gr_{tag}")


def to_session(src, d="d"):
    return f"select distinct asset, ts from (select e.asset, min(b.ts) as ts from (select distinct asset, {d} as d from {src}) e join bars_w b on b.asset = e.asset and b.ts >= e.d group by e.asset, e.d)"


def cluster_cte(tag, src, buyers, days, gap=None):
    cte(f"n_{tag}", f"""select a.asset, a.filed as d, count(distinct b.owner) as n from (select distinct asset, filed from {src}) a
      join {src} b on b.asset = a.asset and b.filed between a.filed - {days - 1} and a.filed group by 1, 2 having count(distinct b.owner) >= {buyers}""")
    gap_cte(tag, f"n_{tag}", "d", days if gap is None else gap)
    return cte(f"c_{tag}", to_session(f"g_{tag}"))


def once_cte(tag, src, gap):
    """Signals (asset, ts) of src kept once per gap days, as s_<tag>."""
    gap_cte(tag, src, "ts", gap)
    return cte(f"s_{tag}", f"select asset, d as ts from g_{tag}")


def signal(name, src, extra=""):
    return query(name, f"select asset, ts, 1 as side from {src} {extra}")


def gated(src, where, feats="calm_w"):
    return f"select s.asset, s.ts, 1 as side from {src} s join {feats} f using (asset, ts) where {where}"


# --- shared signals -------------------------------------------------------------------------------------------------
cluster_cte("base", "buys", 2, 10)


def base(spark, sf, buys=None, bars=None):
    return G.insider_cluster(*inputs(spark, sf, buys, bars), 2, 10)


@signal("g1_insider_cluster", "c_base")
def g1(spark, sf):
    return base(spark, sf)


cte("big", "select asset, filed from buys where role ilike '%officer%' group by asset, accession, filed having sum(value) >= 80000")


@query("g2_insider_big_buy", one(to_session("big", "filed")))
def g2(spark, sf):
    return G.insider_big_buy(BUYS(spark, sf), BARS(spark, sf), 80000.0, True)


def fresh_cte(tag, src, gap):
    return cte(tag, f"select asset, owner, filed from (select *, lag(filed) over (partition by asset, owner order by filed) as p from (select distinct asset, owner, filed from {src})) where p is null or filed - p > {gap}")


fresh_cte("fresh", "buys", 365)
cte("officer_buys", "select * from buys where role ilike '%officer%'")
fresh_cte("fresh_o", "officer_buys", 365)
cluster_cte("fresh", "fresh", 2, 10, 20)
cluster_cte("fresh_o", "fresh_o", 1, 10, 30)


@signal("g3_insider_fresh", "c_fresh")
def g3(spark, sf, buys=None, bars=None):
    buys, bars = inputs(spark, sf, buys, bars)
    return G.insider_cluster(G.fresh(buys, 365), bars, 2, 10, 20)


@signal("g4_insider_fresh_officer", "c_fresh_o")
def g4(spark, sf):
    return G.insider_cluster(G.fresh(G.officers(BUYS(spark, sf)), 365), BARS(spark, sf), 1, 10, 30)


cte("oppo", """select b.* from buys b where not (exists (select 1 from buys p where p.asset = b.asset and p.owner = b.owner and month(p.filed) = month(b.filed) and year(p.filed) = year(b.filed) - 1))""")
cluster_cte("oppo", "oppo", 2, 10)
cte("oppo_x", "select * from oppo where upper(title) like '%CHIEF EXECUTIVE%' or regexp_matches(upper(title), '\\bCEO\\b')")
cluster_cte("oppo_x", "oppo_x", 1, 10)


@signal("g5_insider_opportunistic", "c_oppo")
def g5(spark, sf):
    return G.insider_cluster(G.opportunistic(BUYS(spark, sf), 1), BARS(spark, sf), 2, 10)


@signal("g6_insider_opportunistic_exec", "c_oppo_x")
def g6(spark, sf):
    return G.insider_cluster(G.with_title(G.opportunistic(BUYS(spark, sf), 1), "ceo"), BARS(spark, sf), 1, 10)


cte("exec_days", "select asset, filed from buys where regexp_matches(upper(title), '\\bCEO\\b|CHIEF EXECUTIVE|\\bCFO\\b|CHIEF FINANCIAL') group by asset, owner, filed having sum(value) >= 50000")
cte("exec_s", to_session("exec_days", "filed"))
once_cte("exec", "exec_s", 30)


@signal("g7_insider_top_exec", "s_exec")
def g7(spark, sf, buys=None, bars=None):
    return G.insider_top_exec(*inputs(spark, sf, buys, bars), 50000.0, "ceo_cfo", 30)


cte("rep_days", "select asset, filed from (select *, lag(filed) over (partition by asset, owner order by filed) as p from (select distinct asset, owner, filed from buys)) where filed - p <= 200")
cte("rep_s", to_session("rep_days", "filed"))
once_cte("rep", "rep_s", 30)


@signal("g8_insider_repeat", "s_rep")
def g8(spark, sf):
    return G.insider_repeat(BUYS(spark, sf), BARS(spark, sf), 2, 200, 30)


cluster_cte("n1", "buys", 1, 10)
cte("clean_days", "select n.asset, n.d from n_n1 n where not exists (select 1 from filings f where f.code = 'S' and f.asset = n.asset and f.filed between n.d - 14 and n.d)")
cte("clean_s", to_session("clean_days"))
once_cte("clean", "clean_s", 30)


@signal("g9_insider_clean", "s_clean")
def g9(spark, sf, filed=None, bars=None):
    filed, bars = inputs(spark, sf, S.filings(spark, sf) if filed is None else filed, bars)
    return G.insider_clean(filed, bars, 1, 10, 15, 30)


cte("prompt", "select * from buys where filed - traded <= 1")
cluster_cte("prompt", "prompt", 1, 10)
cte("late", "select * from buys where filed - traded >= 3")
cluster_cte("late", "late", 2, 10)


@query("g10_insider_filing_lag", "select 'prompt' as mode, asset, ts, 1 as side from c_prompt union all select 'late', asset, ts, 1 from c_late")
def g10(spark, sf):
    p = G.insider_cluster(G.filing_lag(BUYS(spark, sf), "prompt"), BARS(spark, sf), 1, 10).select(F.lit("prompt").alias("mode"), "asset", "ts", "side")
    return p.unionByName(G.insider_cluster(G.filing_lag(BUYS(spark, sf), "late"), BARS(spark, sf), 2, 10).select(F.lit("late").alias("mode"), "asset", "ts", "side"))


cte("under0", "select b.asset, b.ts from bars_w b join cost_w c on c.asset = b.asset and c.day = b.ts where b.close <= c.cost * 0.99 and c.buyers >= 2")
once_cte("under", "under0", 30)


def underwater(spark, sf, buys=None, bars=None):
    return G.insider_underwater(*inputs(spark, sf, buys, bars), 2, 0.01, 20, 30)


@signal("g11_insider_underwater", "s_under")
def g11(spark, sf):
    return underwater(spark, sf)


cte("lv_w", f"select *, case when count(st) over w >= 13 then stddev_samp(st) over w end as sg from (select *, ln(close) - ln(lag(close) over (partition by asset order by ts)) as st from bars_w) window w as (partition by asset order by ts rows between 25 preceding and current row)")
cte("uz0", "select b.asset, b.ts from lv_w b join cost_w c on c.asset = b.asset and c.day = b.ts where ln(b.close / c.cost) <= -0.3 * (b.sg * sqrt(21e0)) and c.buyers >= 1")
once_cte("uz", "uz0", 30)


@signal("g12_insider_underwater_z", "s_uz")
def g12(spark, sf):
    return G.insider_underwater_z(BUYS(spark, sf), BARS(spark, sf), 1, 0.3, 20, 30, 26, 13)


cte("rc0", """select asset, ts from (select b.asset, b.ts, b.close >= c.cost as back, c.buyers, max(case when b.close <= c.cost * 0.985 then 1 else 0 end) over (partition by b.asset order by b.ts rows between 4 preceding and 1 preceding) as u
  from bars_w b join cost_w c on c.asset = b.asset and c.day = b.ts) where back and u = 1 and buyers >= 1""")
once_cte("rc", "rc0", 30)


@signal("g13_insider_reclaim", "s_rc")
def g13(spark, sf):
    return G.insider_reclaim(BUYS(spark, sf), BARS(spark, sf), 0.015, 4, 20, 30)


cte("own_w", f"""select *, row_number() over (partition by asset order by ts) as bn, lag(close) over (partition by asset order by ts) as pc, lag(close, 4) over (partition by asset order by ts) as c4,
  {full('avg', 'close', 5)} as m5, {full('avg', 'close', 10)} as m10, {full('avg', 'volume', 10, 1)} as v10, case when count(*) over w >= 13 then max(close) over w end as h26 from bars_w
  window w as (partition by asset order by ts rows between 25 preceding and current row)""")
cte("own2_w", "select *, close > m5 as above, close > m5 and pc <= lag(m5) over (partition by asset order by ts) as crossed, volume >= 1.2 * v10 and close > pc as heavy from own_w")


@query("g14_insider_dip", gated("c_base", "close / c4 - 1 < -0.01", "own_w"))
def g14(spark, sf):
    return P.only(base(spark, sf), G.drop_on_bars(BARS(spark, sf), 4, 0.01)).select("asset", "ts", "side")


@query("g15_insider_deep_value", gated("c_base", "close <= 0.97 * h26", "own_w"))
def g15(spark, sf):
    return P.only(base(spark, sf), G.far_below_high(BARS(spark, sf), 0.03, 26, 13)).select("asset", "ts", "side")


def ahead_sql(sig, where, hit, lo, hi):
    return f"select distinct asset, ts, 1 as side from (select c.asset, min(n.ts) as ts from (select s.asset, o.bn from {sig} s join own2_w o using (asset, ts) where {where}) c join own2_w n on n.asset = c.asset and n.bn between c.bn + {lo} and c.bn + {hi} and n.{hit} group by c.asset, c.bn)"


@query("g16_insider_confirm", f"select asset, ts, side from ({ahead_sql('c_base', 'not coalesce(o.above, false)', 'crossed', 0, 5)}) union select s.asset, s.ts, 1 from c_base s join own2_w o using (asset, ts) where o.above")
def g16(spark, sf):
    return G.insider_confirm(base(spark, sf), BARS(spark, sf), 6, 5)


@query("g17_insider_turn", ahead_sql("c_base", "o.close < o.m10", "crossed", 1, 6))
def g17(spark, sf):
    return G.insider_turn(base(spark, sf), BARS(spark, sf), 6, 10, 5)


@query("g18_insider_accumulation", ahead_sql("c_base", "true", "heavy", 1, 10))
def g18(spark, sf):
    return G.insider_accumulation(base(spark, sf), BARS(spark, sf), 1.2, 10)


cluster_cte("big3", "buys", 4, 10)


def strong(spark, sf):
    return G.insider_cluster(BUYS(spark, sf), BARS(spark, sf), 4, 10)


def wave_sql(sig, ev, companies, window, own=False):
    return f"""select s.asset, s.ts from (select c.asset, c.ts, x.sector from {sig} c join sect x using (asset)) s
      left join (select e.asset as ea, e.ts as et, x.sector from {ev} e join sect x using (asset)) e on e.sector = s.sector and e.et between s.ts - {window - 1} and s.ts
      group by 1, 2 having count(distinct ea) {'+ case when bool_or(coalesce(ea = s.asset, false)) then 0 else 1 end' if own else ''} >= {companies}"""


cte("wave", wave_sql("c_big3", "c_big3", 5, 14))


@signal("g19_insider_sector_wave", "wave")
def g19(spark, sf):
    s = strong(spark, sf)
    return G.sector_wave(s, s, S.sectors(spark, sf), 5, 14)


@query("g20_insider_fresh_wave", one(wave_sql("c_fresh", "c_big3", 5, 14, True)))
def g20(spark, sf):
    f = G.insider_cluster(G.fresh(BUYS(spark, sf), 365), BARS(spark, sf), 2, 10, 20)
    return G.sector_wave(f, strong(spark, sf), S.sectors(spark, sf), 5, 14, own_counts=True)


@query("g21_insider_opportunistic_wave", one(wave_sql("c_oppo", "c_oppo", 8, 14)))
def g21(spark, sf):
    s = G.insider_cluster(G.opportunistic(BUYS(spark, sf), 1), BARS(spark, sf), 2, 10)
    return G.sector_wave(s, s, S.sectors(spark, sf), 8, 14)


@query("g22_insider_market_stress", one("select c.asset, c.ts from c_base c join (select ts, median(rb) as med from fx_w group by 1) m using (ts) where med <= -0.002"))
def g22(spark, sf):
    from ..functions.ranks import group_medians
    p = PAN(spark, sf).withColumn("_r", session_return(2))
    low = group_medians(p, ["ts"], "_r", "_med").filter("_med <= -0.002")
    return base(spark, sf).join(low.select("ts"), "ts", "left_semi").select("asset", "ts", "side")


cte("fs_w", "select f.*, m.mw from calm_w f join secmed_w m using (ts, sector)")
cte("sstress", "select c.asset, c.ts from c_base c join fs_w f using (asset, ts) where f.mw <= -0.003")


def stressed(spark, sf, signals=None, panel=None):
    signals, panel = base(spark, sf) if signals is None else signals, PAN(spark, sf) if panel is None else panel
    return G.sector_stress(signals, panel, 0.003, 12).select("asset", "ts", "side")


@signal("g23_insider_sector_stress", "sstress")
def g23(spark, sf):
    return stressed(spark, sf)


@query("g24_insider_sector_laggard", gated("c_base", "rw <= mw - 0.01", "fs_w"))
def g24(spark, sf):
    return G.against_sector(base(spark, sf), PAN(spark, sf), 12, lambda r, m: r <= m - 0.01).select("asset", "ts", "side")


@query("g25_insider_stress_leader", gated("sstress", "rw - mw > 0.005", "fs_w"))
def g25(spark, sf):
    return G.against_sector(stressed(spark, sf), PAN(spark, sf), 12, lambda r, m: r - m > 0.005).select("asset", "ts", "side")


@query("g26_insider_wave_stress", gated("wave", "mw <= -0.001", "fs_w"))
def g26(spark, sf):
    s = strong(spark, sf)
    return G.sector_stress(G.sector_wave(s, s, S.sectors(spark, sf), 5, 14), PAN(spark, sf), 0.001, 12).select("asset", "ts", "side")


cte("mr_w", f"select *, {pct('r26')} as strength from calm_w")


@query("g27_insider_low_vol_momentum", f"select 'low_vol' as kind, * from ({gated('c_base', 'calm <= 0.3')}) union all select 'momentum', * from ({gated('c_base', 'strength >= 0.7', 'mr_w')})")
def g27(spark, sf):
    p, b = PAN(spark, sf), base(spark, sf)
    strength = pct_rank(p.withColumn("_r", session_return(26)), ["ts"], "_r", "_s").filter("_s >= 0.7")
    a = P.only(b, P.calm(p, 0.3, 26, 13)).select(F.lit("low_vol").alias("kind"), "asset", "ts", "side")
    return a.unionByName(P.only(b, strength).select(F.lit("momentum").alias("kind"), "asset", "ts", "side"))


cte("srank_w", f"""select *, {pct('sm')} as short_rank from (select *, case when count(known) over w >= 4 then avg(known) over w end as sm from (
  select p.asset, p.ts, p.sno, max(v.short / v.total) over (partition by p.asset order by p.sno range between 1 preceding and 1 preceding) as known from panel_w p left join shortv v using (asset, ts))
  window w as (partition by asset order by sno range between 7 preceding and current row))""")


def short_ranks(spark, sf, digits=None, panel=None):
    return H.short_rank(PAN(spark, sf) if panel is None else panel, S.short_volume(spark, sf), 8, 4, digits)


@query("g28_insider_short_interest", f"select 'low' as kind, * from ({gated('c_base', 'short_rank <= 0.3', 'srank_w')}) union all select 'high', * from ({gated('c_base', 'short_rank >= 0.7', 'srank_w')})")
def g28(spark, sf):
    b, r = base(spark, sf), short_ranks(spark, sf)
    low = P.only(b, r.filter("short_rank <= 0.3")).select(F.lit("low").alias("kind"), "asset", "ts", "side")
    return low.unionByName(P.only(b, r.filter("short_rank >= 0.7")).select(F.lit("high").alias("kind"), "asset", "ts", "side"))


LOW_SHORT = "short_rank <= 0.4"


@query("g29_low_short_combos", f"""select 'opportunistic' as kind, * from ({gated('c_oppo', LOW_SHORT, 'srank_w')}) union all select 'wave', * from ({gated('wave', LOW_SHORT, 'srank_w')})
  union all select 'stress', * from ({gated('sstress', LOW_SHORT, 'srank_w')}) union all select 'calm', * from ({gated('(select c.* from c_base c join calm_w f using (asset, ts) where f.calm <= 0.3)', LOW_SHORT, 'srank_w')})""")
def g29(spark, sf):
    panel, (_, buys) = PAN(spark, sf), written_filings(spark, sf)
    low = short_ranks(spark, sf, panel=panel).filter(LOW_SHORT)
    # a signal counts only on a bar of the panel, so the panel's bars place the signals too; clusters of both sizes come
    # from one count of buyers, and are written, as several kinds read them
    counts = materialise(G.buyer_counts(buys, 10).filter("_n >= 2"), "counts")
    b, s = (materialise(G.as_signals(on_session(G.clusters_of(counts, n, 10), panel)), "clusters") for n in (2, 4))
    parts = {"opportunistic": G.insider_cluster(G.opportunistic(buys, 1), panel, 2, 10),
             "wave": G.sector_wave(s, s, S.sectors(spark, sf), 5, 14), "stress": stressed(spark, sf, b, panel),
             "calm": P.only(b, P.calm(panel, 0.3, 26, 13))}
    out = None
    for k, df in parts.items():
        d = df.select(F.lit(k).alias("kind"), "asset", "ts", "side")
        out = d if out is None else out.unionByName(d)
    return P.only(out, low).select("kind", "asset", "ts", "side")


CALM = "calm <= 0.3"


@query("g30_calm_combos", f"select 'fresh' as kind, * from ({gated('c_fresh', CALM)}) union all select 'stress', * from ({gated('sstress', CALM)}) union all select 'underwater', * from ({gated('s_under', CALM)})")
def g30(spark, sf):
    calm = P.calm(PAN(spark, sf), 0.3, 26, 13)
    parts = {"fresh": G.insider_cluster(G.fresh(BUYS(spark, sf), 365), BARS(spark, sf), 2, 10, 20), "stress": stressed(spark, sf), "underwater": underwater(spark, sf)}
    out = None
    for k, df in parts.items():
        d = df.select(F.lit(k).alias("kind"), "asset", "ts", "side")
        out = d if out is None else out.unionByName(d)
    return P.only(out, calm).select("kind", "asset", "ts", "side")


cte("react_w", to_session("rel_day", "day"))
cte("ae_w", """select *, max(rat) over (partition by asset order by bn) as lastr from (select o.*, case when r.ts is not null and o.close / o.pc - 1 <= 0 then o.bn end as rat from own_w o left join react_w r on r.asset = o.asset and r.ts = o.ts)""")


def release_days(reports):
    return reports.select("asset", D.release_day(F.col("accepted")).alias("day"))


def releases(spark, sf, filed=None):
    return release_days(S.earnings(spark, sf, filed))


@query("g31_insider_after_earnings", gated("c_base", "bn - lastr <= 4", "ae_w"))
def g31(spark, sf, filed=None, buys=None, bars=None):
    buys, bars = inputs(spark, sf, buys, bars)
    return G.after_earnings(base(spark, sf, buys, bars), bars, releases(spark, sf, filed), 4, 0.0).select("asset", "ts", "side")


@query("g32_insider_conviction", """select asset, ts, 1 as side from (select c.asset, c.ts, (select sum(value) from buys b where b.asset = c.asset and b.filed between c.ts - 19 and c.ts) as paid,
  (select last(val order by "end", filed desc) from funda f where f.asset = c.asset and f.filed < c.ts) as shares, w.close from c_base c join bars_w w using (asset, ts)) where shares > 0 and coalesce(paid, 0) / (shares * close) * 1e4 >= 20""")
def g32(spark, sf):
    return G.conviction(base(spark, sf), BUYS(spark, sf), BARS(spark, sf), S.fundamentals(spark, sf), 20, 20.0)


@query("g34_insider_defensive", one("select c.asset, c.ts from c_fresh c join sect s using (asset) where s.sector in ('ASIA', 'EUROPE')"))
def g34(spark, sf):
    some = S.sectors(spark, sf).filter(F.col("sector").isin("ASIA", "EUROPE"))
    return g3(spark, sf).join(some.select("asset"), "asset", "left_semi").select("asset", "ts", "side")


cte("votes0", """select asset, ts from (select asset, ts, """ + " + ".join(f"coalesce(max(v{i}) over (partition by asset order by ts rows between 3 preceding and current row), 0)" for i in range(5)) + """ as votes from (
  select b.asset, b.ts, """ + ", ".join(f"case when s{i}.ts is not null then 1 end as v{i}" for i in range(5)) + " from bars_w b " + " ".join(
    f"left join {t} s{i} on s{i}.asset = b.asset and s{i}.ts = b.ts" for i, t in enumerate(("c_fresh", "s_under", "s_exec", "s_clean", "ae_sig"))) + ")) where votes >= 3")
cte("ae_sig", "select s.asset, s.ts from c_base s join ae_w f using (asset, ts) where bn - lastr <= 4")
once_cte("votes", "votes0", 30)


GAPS = {"base": 10, "fresh": 20, "late": 10, "exec": 30, "clean": 30, "under": 30, "votes": 30}


def ideas(spark, sf, bars, *names):
    """Signals (asset, ts) of several ideas on filings, from one pass, written once."""
    filed, _ = written_filings(spark, sf, "accession", "traded", "shares", "price", "value", "title")
    days = releases(spark, sf, filed)
    found = materialise(G.insider_ideas(filed, bars, 10, 2, 365, 3, 50000.0, "ceo_cfo", 15, 20, 0.01, {k: GAPS[k] for k in names}, days, 4, 3, 4), "ideas")
    return {k: found.filter(F.col("idea") == k).select("asset", "ts", F.lit(1).alias("side")) for k in names}


@signal("g35_insider_consensus", "s_votes")
def g35(spark, sf):
    return ideas(spark, sf, BARS(spark, sf).select("asset", "ts", "close"), "base", "fresh", "exec", "clean", "under", "votes")["votes"]


def reaction_sql(sign):
    return f"""select asset, ts from (select o.*, case when count(ret) over {W26} >= 13 then stddev_samp(ret) over {W26} end as sd, case when count(*) over {W10} >= 5 then avg(volume) over {W10} end as us
      from (select *, close / pc - 1 as ret from own_w) o) join react_w using (asset, ts) where sd > 0 and us > 0 and {sign} * ret / sd >= 0.8 and volume / us >= 1.1"""


W26 = "(partition by asset order by ts rows between 26 preceding and 1 preceding)"
W10 = "(partition by asset order by ts rows between 10 preceding and 1 preceding)"


@query("g37_earnings_reaction", f"select 'up' as kind, asset, ts, 1 as side from ({reaction_sql(1)}) union all select 'down', asset, ts, 1 from ({reaction_sql(-1)})")
def g37(spark, sf):
    def part(up):
        return G.earnings_reaction(BARS(spark, sf), releases(spark, sf), 0.8, 1.1, up, 26, 13, 10, 5).select(F.lit("up" if up else "down").alias("kind"), "asset", "ts", "side")
    return part(True).unionByName(part(False))
