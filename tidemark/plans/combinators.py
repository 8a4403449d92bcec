"""H: signal combinators."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import ranked_upto
from ..functions.temporal import calendar
from ..functions.windows import enters, rolling, session_return
from ..operators import combine as H
from ..operators import event_signals as G
from ..operators import panel_signals as P
from ..operators.features import with_realised_vol
from ..session import materialise
from ..sources import bindings as S
from .asset_signals import donchian, full, sweeps
from .catalog import cte, query
from .event_signals import BARS, GAPS, PAN, g3, ideas, once_cte, short_ranks, underwater, written_filings
from .panel_signals import enter, one

once_cte("h1", "e16_w", 60)


@query("h1_once_per_gap_days", "select asset, ts, 1 as side from s_h1")
def h1(spark, sf):
    return G.once_per(sweeps(spark, sf), 60)


def union_cte(tag, parts, gap):
    """Union of signals kept once per gap bars: u_<tag>(asset, ts)."""
    cte(f"un_{tag}", " union ".join(f"select asset, ts from {p}" for p in parts))
    cte(f"ub_{tag}", f"select u.asset, u.ts, b.bn from un_{tag} u join own_w b using (asset, ts)")
    cte(f"ux_{tag}", f"select asset, ts, bn, min(bn) over (partition by asset order by bn range between {gap + 1} following and unbounded following) as nxt from ub_{tag}")
    cte(f"ug_{tag}", f"select asset, min(bn) as bn from ux_{tag} group by asset union all select x.asset, x.nxt from ug_{tag} g join ux_{tag} x on x.asset = g.asset and x.bn = g.bn where x.nxt is not null")
    return cte(f"u_{tag}", f"select asset, ts from ub_{tag} join ug_{tag} using (asset, bn)")


union_cte("h2", ["e1_w", "e16_w"], 8)


@query("h2_one_per_gap_sessions", "select asset, ts, 1 as side from u_h2")
def h2(spark, sf):
    return H.one_per_gap_bars([donchian(spark, sf), sweeps(spark, sf)], BARS(spark, sf), 8)


@query("h3_short_rank", "select asset, ts, round(short_rank, 6) as short_rank from srank_w")
def h3(spark, sf):
    return short_ranks(spark, sf).select("asset", "ts", F.round("short_rank", 6).alias("short_rank"))


@query("h4_enter_edge", one(enter("close > m5", f"(select *, {full('avg', 'close', 5)} as m5 from panel_w)")))
def h4(spark, sf):
    df = S.panel(spark, sf).withColumn("_above", F.col("close") > rolling(F.avg, "close", 5))
    return P.picked(df.withColumn("_in", enters("_above")), F.col("_in"))


def turn_sql(sig, wait, up):
    return f"""select distinct asset, ts, 1 as side from (select c.asset, min(n.ts) as ts from (select s.asset, s.ts, o.bn from {sig} s join own_w o using (asset, ts)) c
      join (select o.asset, o.ts, o.bn, f.rb, f.mb from own_w o join (select f.*, m.mb from fx_w f join secmed_w m using (ts, sector)) f using (asset, ts)) n
      on n.asset = c.asset and n.bn between c.bn and c.bn + {wait} and n.{up} > 0 group by c.asset, c.bn)"""


@query("h5_at_turn", f"select 'stock' as confirm, * from ({turn_sql('e16_w', 6, 'rb')}) union all select 'sector', * from ({turn_sql('e16_w', 6, 'mb')})")
def h5(spark, sf):
    s = sweeps(spark, sf)
    a = H.at_turn(s, PAN(spark, sf), 2, 6, "stock").select(F.lit("stock").alias("confirm"), "asset", "ts", "side")
    return a.unionByName(H.at_turn(s, PAN(spark, sf), 2, 6, "sector").select(F.lit("sector").alias("confirm"), "asset", "ts", "side"))


cte("calm_fresh", "select s.asset, s.ts from c_fresh s join calm_w f using (asset, ts) where calm <= 0.3")
cte("calm_stress", "select s.asset, s.ts from sstress s join calm_w f using (asset, ts) where calm <= 0.3")
cte("wash_calm", "select asset, ts from wash_w where calm <= 0.5")


def calm_rows(spark, sf, panel=None):
    return P.calm(PAN(spark, sf) if panel is None else panel, 0.3, 26, 13)


@query("h6_turned_ideas", f"select 'underwater' as idea, * from ({turn_sql('s_under', 6, 'rb')}) union all select 'calm_fresh', * from ({turn_sql('calm_fresh', 6, 'rb')})")
def h6(spark, sf):
    # an idea turns only on a bar of the panel, so the panel's bars place the signals too
    panel, (_, buys) = PAN(spark, sf), written_filings(spark, sf, "shares", "price")
    fresh = P.only(g3(spark, sf, buys, panel), calm_rows(spark, sf, panel))
    ideas = underwater(spark, sf, buys, panel).select(F.lit("underwater").alias("idea"), "asset", "ts").unionByName(fresh.select(F.lit("calm_fresh").alias("idea"), "asset", "ts"))
    return H.at_turn_by(ideas, panel, 2, 6, ["idea"]).select("idea", "asset", "ts", F.lit(1).alias("side"))


cte("low_short_base", "select s.asset, s.ts from c_base s join srank_w f using (asset, ts) where short_rank <= 0.3")
cte("low_vol_base", "select s.asset, s.ts from c_base s join calm_w f using (asset, ts) where calm <= 0.3")
union_cte("calm", ["wash_calm", "calm_fresh", "calm_stress"], 8)
union_cte("insider", ["low_short_base", "calm_fresh", "low_vol_base", "sstress"], 8)
union_cte("top", ["calm_fresh", "s_under", "c_late", "s_votes"], 8)


@query("h7_unions", "select 'calm' as kind, asset, ts, 1 as side from u_calm union all select 'insider', asset, ts, 1 from u_insider union all select 'top', asset, ts, 1 from u_top")
def h7(spark, sf):
    bars = materialise(S.weekly_closes(spark, sf), "bars")
    found = ideas(spark, sf, bars, *GAPS)
    panel = bars.join(calendar(bars), "ts").join(S.sectors(spark, sf).select("asset", "sector"), "asset")
    moves = with_realised_vol(H.with_short_mean(panel, 8, 4), 26, 13, False, "_vol").withColumns({"_rw": session_return(12), "_rb": session_return(2)})
    moves = materialise(moves.select("asset", "ts", "sno", "sector", "_vol", "_mean", "_rw", "_rb"), "moves")
    calm, quiet = (materialise(ranked_upto(moves.select("asset", "ts", "_vol"), ["ts"], "_vol", most).select("asset", "ts"), "calm") for most in (0.3, 0.5))
    low = ranked_upto(moves.select("asset", "ts", "_mean"), ["ts"], "_mean", 0.3)
    stress = materialise(P.only(found["base"], moves.join(P.sector_medians(moves, "_rw", "_mw").filter("_mw <= -0.003").select("ts", "sector"), ["ts", "sector"], "left_semi")), "stress")
    fresh, wash = P.only(found["fresh"], calm), P.only(P.sector_washout(moves, 0.004, 2, 12), quiet)
    kinds = {"calm": [wash, fresh, P.only(stress, calm)],
             "insider": [P.only(found["base"], low), fresh, P.only(found["base"], calm), stress],
             "top": [fresh, found["under"], found["late"], found["votes"]]}
    parts = [d.select(F.lit(k).alias("kind"), "asset", "ts") for k, each in kinds.items() for d in each]
    return H.one_per_gap_bars_by(reduce(DataFrame.unionByName, parts), bars, 8, ["kind"]).select("kind", "asset", "ts", "side")


@query("h8_not_event_day", """select e.asset, e.ts, e.side from e16_w e join own_w o using (asset, ts) where not exists (select 1 from react_w r join own_w q on q.asset = r.asset and q.ts = r.ts
  where r.asset = e.asset and o.bn - q.bn in (0, 1))""")
def h8(spark, sf):
    from .event_signals import releases
    return H.not_event_day(sweeps(spark, sf), BARS(spark, sf), releases(spark, sf)).select("asset", "ts", "side")


GRID_JSON = """'{"family":"' || family || '","params":{"n":' || cast(n as varchar) || ',"share":' || cast(share as varchar) || '},"rule":"' || rule || '","segment":"' || segment || '"}'"""
cte("grid_c", f"""select sha1({GRID_JSON}) as id, family, n, share, rule, segment from (select distinct p_brand as family, cast(p_size as double) as n, 0.05 + (p_partkey % 8) / 10 as share from part),
  (select distinct c_mktsegment as rule from customer), (select r_name as segment from region)""")


def grid(spark, sf):
    p = S.table(spark, sf, "part").select(F.col("p_brand").alias("family"), F.lit("all").alias("kind"),
                                          F.create_map(F.lit("n"), F.col("p_size").cast("double"), F.lit("share"), 0.05 + (F.col("p_partkey") % 8) / 10).alias("m"))
    fam = p.withColumn("e", F.map_entries("m")).groupBy("family", "kind", "e").agg(F.first("m").alias("m"))
    rules = S.table(spark, sf, "customer").select(F.lit("all").alias("kind"), F.col("c_mktsegment").alias("rule")).distinct()
    segments = S.table(spark, sf, "region").select(F.lit("all").alias("kind"), F.col("r_name").alias("segment"))
    # written first: a kind that the planner knows to be constant would make the join by kind a cross join
    fam, rules, segments = (materialise(df, "grid-part") for df in (fam.select("family", "kind", F.array("m").alias("params")), rules, segments))
    return H.parameter_grid(fam, rules, segments)


@query("h9_parameter_grid", "select *, substr(id, 1, 10) as shown from grid_c")
def h9(spark, sf):
    return grid(spark, sf).select("id", H.short_id().alias("shown"), "family", F.col("params")["n"].alias("n"), F.col("params")["share"].alias("share"), "rule", "segment")


@query("h10_param_neighbours", """select id, 'n' as name, nn as n, share from (select id, n, share, greatest(1, floor(n * f + 0.5)) as nn from grid_c, (values (0.7e0), (1.4e0)) v(f)) where nn <> n
  union all select id, 'share', n, sn from (select id, n, share, round(share * f, 4) as sn from grid_c, (values (0.7e0), (1.4e0)) v(f)) where sn <> share and sn > 0 and sn < 1""")
def h10(spark, sf):
    df = H.param_neighbours(grid(spark, sf))
    return df.select("id", "name", F.col("params")["n"].alias("n"), F.col("params")["share"].alias("share"))


