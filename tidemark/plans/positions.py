"""P: plans and reconciliation. Parts are the symbols, lines the plan rows and the holdings."""

from pyspark.sql import functions as F

from ..operators import positions as P
from ..sources import bindings as S
from .catalog import cte, query
from .bars import sess_e
from .outcomes import rounded

SIGN = "(case when l_linenumber % 3 = 0 then -1 else 1 end)"
SEQ = "l_orderkey * 10 + l_linenumber"
cte("pplan", f"""select l_partkey as symbol, {SEQ} as seq, {SIGN} * (l_quantity + l_linenumber / 8) as qty, case when l_linenumber = 7 then null else p_retailprice * (1 - {SIGN} * l_discount) end as stop, case when l_linenumber % 2 = 0 then p_retailprice * (1 + {SIGN} * (l_tax + 0.01)) end as target, l_extendedprice as x
  from lineitem join part on p_partkey = l_partkey where l_returnflag = 'N'""")
cte("phave", f"select l_partkey as symbol, sum({SIGN} * (l_quantity + l_linenumber / 8)) as have from lineitem where l_returnflag <> 'R' and l_shipdate >= timestamp '1996-06-01' group by 1")
cte("pquote", "select p_partkey as symbol, p_retailprice as price, p_size % 7 = 0 as crypto from part")
cte("prange", "select p_partkey as symbol, p_retailprice * (0.98e0 - (p_size % 5) / 100) as lo, p_retailprice * (1.01e0 + (p_size % 4) / 100) as hi from part where p_partkey % 9 > 0")
cte("plive", "select p.* from pplan p left join prange r using (symbol) where not (coalesce(case when qty > 0 then lo <= stop else hi >= stop end, false) or coalesce(case when qty > 0 then hi >= target else lo <= target end, false))")
cte("pwant", "select symbol, sum(qty) as want from plive group by 1")
ALLOWED = "case when crypto and w < 0 then 0 when not crypto and w < 0 then -floor(-w) else w end"


def sign():
    return F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(1)


def plan(spark, sf):
    part = S.table(spark, sf, "part")
    l = S.table(spark, sf, "lineitem").filter("l_returnflag = 'N'")
    return l.join(part, l.l_partkey == part.p_partkey).select(
        F.col("l_partkey").alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (sign() * (F.col("l_quantity") + F.col("l_linenumber") / 8)).alias("qty"),
        F.when(F.col("l_linenumber") != 7, F.col("p_retailprice") * (1 - sign() * F.col("l_discount"))).alias("stop"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("p_retailprice") * (1 + sign() * (F.col("l_tax") + 0.01))).alias("target"), F.col("l_extendedprice").alias("x"))


def have(spark, sf):
    l = S.table(spark, sf, "lineitem").filter("l_returnflag <> 'R' and l_shipdate >= timestamp'1996-06-01'")
    return l.groupBy(F.col("l_partkey").alias("symbol")).agg(F.sum(sign() * (F.col("l_quantity") + F.col("l_linenumber") / 8)).alias("have"))


def quotes(spark, sf):
    return S.table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 7 == 0).alias("crypto"))


def ranges(spark, sf):
    p = S.table(spark, sf, "part").filter("p_partkey % 9 > 0")
    return p.select(F.col("p_partkey").alias("symbol"), (F.col("p_retailprice") * (0.98 - (F.col("p_size") % 5) / 100)).alias("lo"), (F.col("p_retailprice") * (1.01 + (F.col("p_size") % 4) / 100)).alias("hi"))


def want(spark, sf):
    return P.wanted_positions(plan(spark, sf), ranges(spark, sf))


@query("p1_wanted_positions", "select symbol, round(want, 6) as want from pwant")
def p1(spark, sf):
    return rounded(want(spark, sf))


cte("porders", f"""select symbol, case when d > 0 then 'buy' else 'sell' end as side, case when t = 0 and have is not null then abs(h) when crypto then floor(abs(d) * 1e9) / 1e9 else round(abs(d), 6) end as qty, case when crypto then 'gtc' else 'day' end as tif from (select *, t - h as d from (select symbol, have, crypto, price, coalesce(have, 0) as h, {ALLOWED} as t
  from (select coalesce(a.symbol, b.symbol) as symbol, coalesce(a.want, 0) as w, b.have, q.crypto, q.price from pwant a full join phave b on a.symbol = b.symbol join pquote q on q.symbol = coalesce(a.symbol, b.symbol)))) where not abs(d) * price < 5 and not (t <> 0 and h * t > 0 and abs(d) * price <= greatest(50, 0.02 * abs(t) * price))""")


def orders(spark, sf):
    return P.order_diff(want(spark, sf), have(spark, sf), quotes(spark, sf))


@query("p2_order_diff", "select symbol, side, round(qty, 6) as qty, tif from porders")
def p2(spark, sf):
    return rounded(orders(spark, sf))


cte("palloc", """select *, least(abs(qty), greatest(abs(have) - coalesce(sum(abs(qty)) over (partition by symbol order by seq, x rows between unbounded preceding and 1 preceding), 0), 0)) as q from plive join phave using (symbol) join pquote using (symbol) where have * qty > 0""")
cte("pprot", """select symbol, seq, case when have > 0 then 'sell' else 'buy' end as side, stop as stop_price, type, o_qty as qty, lim as limit_price, tif from (
  select *, 'market' as type, round(q, 9) as o_qty, null as lim, case when crypto then 'gtc' else 'day' end as tif from pall where thr union all
  select *, 'stop_limit', floor(q * 1e9) / 1e9, stop * 0.99e0, 'gtc' from pall where not thr and crypto union all
  select *, case when target is not null then 'oco' else 'stop' end, floor(q + 1e-9), target, 'gtc' from pall where not thr and not crypto and floor(q + 1e-9) >= 1 union all
  select *, 'stop', round(q - floor(q + 1e-9), 9), null, 'day' from pall where not thr and not crypto and round(q - floor(q + 1e-9), 9) >= 1e-4)""")
cte("pall", "select *, (price - stop) * sign(have) <= 0 as thr from palloc where q > 0 and stop is not null")


def protection(spark, sf):
    return P.protective_orders(P.live_plan(plan(spark, sf), ranges(spark, sf)), have(spark, sf), quotes(spark, sf), order=["seq", "x"])


PCOLS = ["symbol", "seq", "side", "type", "qty", "stop_price", "limit_price", "tif"]


@query("p3_protective_orders", "select symbol, seq, side, type, round(qty, 6) as qty, round(stop_price, 6) as stop_price, round(limit_price, 6) as limit_price, tif from pprot")
def p3(spark, sf):
    return rounded(protection(spark, sf)).select(*PCOLS)


OPEN = "select l_partkey as symbol, {c} as side, l_quantity as qty from lineitem where l_returnflag = {f}"


@query("p4_orders_equal", "select *, 'wanted' as only from (select symbol, side, qty from ow except all select symbol, side, qty from oo) union all select *, 'open' from (select symbol, side, qty from oo except all select symbol, side, qty from ow)",
       ow="select l_partkey as symbol, case when l_linenumber % 2 = 0 then 'buy' else 'sell' end as side, l_quantity as qty from lineitem where l_returnflag = 'A'", oo="select l_partkey as symbol, case when l_linenumber % 2 = 0 then 'buy' else 'sell' end as side, l_quantity as qty from lineitem where l_returnflag = 'R'")
def p4(spark, sf):
    l = S.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("symbol"), F.when(F.col("l_linenumber") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("l_quantity").alias("qty"), "l_returnflag")
    return P.order_changes(l.filter("l_returnflag = 'A'").drop("l_returnflag"), l.filter("l_returnflag = 'R'").drop("l_returnflag"))


cte("pboth", "select symbol, 'market' as type, side, qty from porders union all select symbol, type, side, qty from pprot")
cte("ppend", "select distinct symbol, side from porders where symbol % 2 = 0")


@query("p5_split_orders", """select b.symbol, b.type, b.side, round(b.qty, 6) as qty, case when b.type = 'market' and b.side = 'buy' and not q.crypto and coalesce(h.have, 0) >= 0 then 'after the open' when b.type = 'stop' and exists (select 1 from ppend p where p.symbol = b.symbol and p.side <> b.side) then 'wash trade' else 'now' end as "when"
  from pboth b left join phave h using (symbol) left join pquote q using (symbol)""")
def p5(spark, sf):
    o = orders(spark, sf)
    both = o.select("symbol", F.lit("market").alias("type"), "side", "qty").unionByName(protection(spark, sf).select("symbol", "type", "side", "qty"))
    return rounded(P.split_orders(both, have(spark, sf), quotes(spark, sf), o.filter("symbol % 2 = 0")))


cte("pver", f"""select symbol, t as want, h as have, cov as covered, not (abs(t - h - pend) * price <= greatest(50, 0.02 * abs(t) * price)) as mismatch, abs(h) * price >= case when w0 is not null then 1 else 5 end and cov < 0.98 * abs(h) and not (abs(h) - cov < 1 and cov >= floor(abs(h) + 1e-9) and floor(abs(h) + 1e-9) > 0) as uncovered from (
  select *, coalesce(sq, 0) + case when h <> 0 then greatest(0, -sign(h) * pend) else 0 end as cov from (select symbol, w0, {ALLOWED} as t, coalesce(have, 0) as h, coalesce(p, 0) as pend, sq, price from (select coalesce(a.symbol, b.symbol) as symbol, a.want as w0, coalesce(a.want, 0) as w, b.have, q.crypto, q.price, p.p, s.sq
  from pwant a full join phave b on a.symbol = b.symbol join pquote q on q.symbol = coalesce(a.symbol, b.symbol) left join (select symbol, sum(case when side = 'buy' then qty else -qty end) as p from porders where symbol % 2 = 0 group by 1) p on p.symbol = q.symbol left join (select symbol, sum(qty) as sq from pprot where type <> 'market' group by 1) s on s.symbol = q.symbol)))""")


@query("p6_verify_positions", "select symbol, round(want, 6) as want, round(have, 6) as have, round(covered, 6) as covered, mismatch, uncovered from pver where mismatch or uncovered")
def p6(spark, sf):
    o = orders(spark, sf).filter("symbol % 2 = 0").groupBy("symbol").agg(F.sum(F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))).alias("pending"))
    st = protection(spark, sf).filter("type <> 'market'").groupBy("symbol").agg(F.sum("qty").alias("stop_qty"))
    return rounded(P.verify_positions(want(spark, sf), have(spark, sf), o, st, quotes(spark, sf)))


@query("p7_range_since", """select symbol, round(min(lo), 6) as lo, round(max(hi), 6) as hi from (select b.asset as symbol, low as lo, high as hi from bars_h b join st on st.symbol = b.asset where b.ts > since union all select e.user_id, 99 + sqrt(value) / 3, 99 + sqrt(value) / 3 from events e join st on st.symbol = e.user_id where event_type = 'error' and e.ts > since) group by 1""",
       st="select user_id as symbol, max(ts) - interval 30 hours as since from events group by 1")
def p7(spark, sf):
    e = S.table(spark, sf, "events")
    starts = e.groupBy(F.col("user_id").alias("symbol")).agg((F.max("ts") - F.expr("interval 30 hours")).alias("since"))
    fills = e.filter("event_type = 'error'").select(F.col("user_id").alias("symbol"), "ts", (99 + F.sqrt("value") / 3).alias("level"))
    return rounded(P.range_since(S.hourly_bars(spark, sf).withColumnRenamed("asset", "symbol"), starts, fills))


@query("p8_group_risk", """select grp, asset, round(risk, 4) as risk, case when grp is null then null when asset is null then risk > 60000 else risk > 6000 end as over from (select sector as grp, asset, sum(abs(l_quantity * (price - stop))) as risk from (select x.sector, l_suppkey as asset, l_quantity, 100 + sqrt(l_extendedprice) / 30 as price, 100 + sqrt(l_extendedprice) / 30 * (1 - l_discount) as stop from lineitem join sect x on x.asset = l_suppkey) group by rollup (sector, asset))""")
def p8(spark, sf):
    l = S.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("asset"), F.col("l_quantity").alias("qty"), S.line_price().alias("price"), (100 + F.sqrt("l_extendedprice") / 30 * (1 - F.col("l_discount"))).alias("stop"))
    df = P.group_risk(l.join(S.sectors(spark, sf), "asset").withColumnRenamed("sector", "grp"), 6000.0, 60000.0)
    return df.select("grp", "asset", F.round("risk", 4).alias("risk"), "over")


@query("p9_idle_cash_row", "select cast(symbol as varchar) as symbol, round(have, 6) as qty, price as mark from phave join pquote using (symbol) union all select 'INDEX', round((1e10 - sum(abs(have) * price)) / 400, 4), 400 from phave join pquote using (symbol) having 1e10 - sum(abs(have) * price) > 0")
def p9(spark, sf):
    pos = have(spark, sf).join(quotes(spark, sf), "symbol").select("symbol", F.col("have").alias("qty"), F.col("price").alias("mark"))
    df = P.idle_cash_row(pos, 1e10, "INDEX", 400.0)
    return df.select("symbol", F.when(F.col("symbol") == "INDEX", F.round("qty", 4)).otherwise(F.round("qty", 6)).alias("qty"), "mark")


@query("p10_market_time_gates", """select event_id as id, case when not coalesce(e.ts >= open_utc and e.ts < close_utc, false) then 'closed' when epoch(date_trunc('second', e.ts)) - epoch(open_utc) < 1200 or epoch(close_utc) - epoch(date_trunc('second', e.ts)) < 600 then 'sales only' else 'all' end as gate from events e left join sess_e s on s.day = cast(e.ts as date)""")
def p10(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts")
    return P.market_time_gates(e, sess_e(spark, sf), 20, 10).select("id", "gate")


@query("p11_trade_notices", "select symbol, upper(substr(side, 1, 1)) || substr(side, 2) || ' ' || format('{:,.2f}', qty) || ' x ' || symbol as message from pboth where type = 'market'")
def p11(spark, sf):
    both = orders(spark, sf).select("symbol", F.lit("market").alias("type"), "side", "qty").unionByName(protection(spark, sf).select("symbol", "type", "side", "qty"))
    return P.trade_notices(both)
