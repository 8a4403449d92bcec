"""K: option-market operators on contracts derived from parts."""

from pyspark.sql import functions as F

from ..operators import options as K
from ..sources import bindings as S
from .catalog import cte, query

cte("chains", "select c.*, s.spot, case when contract % 3 = 0 then bid * 1.01 else null end as last from chain c join (select p_brand as underlying, avg(p_retailprice) as spot from part group by 1) s using (underlying)")


def chains(spark, sf):
    spot = S.table(spark, sf, "part").groupBy(F.col("p_brand").alias("underlying")).agg(F.avg("p_retailprice").alias("spot"))
    return S.chain(spark, sf).join(spot, "underlying").withColumn("last", F.when(F.col("contract") % 3 == 0, F.col("bid") * 1.01))


OCC_SQL = """case when p_partkey % 11 = 0 then p_name else 'P' || chr(cast(65 + p_partkey % 26 as int)) || strftime(date '2026-01-02' + p_size, '%y%m%d') || case when p_partkey % 2 = 0 then 'C' else 'P' end || lpad(cast(cast(round(p_retailprice * 1000) as bigint) as varchar), 8, '0') end"""


@query("k1_parse_occ", f"""select id, nullif(regexp_extract(s, p, 1), '') as root, cast(try_strptime(nullif(regexp_extract(s, p, 2), ''), '%y%m%d') as date) as expiry, nullif(regexp_extract(s, p, 3), '') as type, try_cast(nullif(regexp_extract(s, p, 4), '') as double) / 1000 as strike
  from (select p_partkey as id, {OCC_SQL} as s, '{K.OCC}' as p from part)""")
def k1(spark, sf):
    k = F.col("p_partkey")
    sym = F.concat(F.lit("P"), F.char((65 + k % 26)), F.date_format(F.date_add(F.lit("2026-01-02").cast("date"), F.col("p_size")), "yyMMdd"), F.when(k % 2 == 0, "C").otherwise("P"),
                   F.lpad(F.round(F.col("p_retailprice") * 1000).cast("long").cast("string"), 8, "0"))
    df = S.table(spark, sf, "part").select(k.alias("id"), F.when(k % 11 == 0, F.col("p_name")).otherwise(sym).alias("symbol"))
    return K.parse_occ(df).drop("symbol")


cte("atm", """select c.underlying, c.dte, avg(c.iv) as iv from chains c join (select underlying, dte, first(strike order by abs(strike - spot), contract) as k from chains where iv > 0 group by 1, 2) a using (underlying, dte) where c.strike = a.k and c.iv > 0 group by 1, 2""")


@query("k2_atm_iv", "select underlying, dte, round(iv, 8) as iv from atm")
def k2(spark, sf):
    return K.atm_iv(chains(spark, sf)).select("underlying", "dte", F.round("iv", 8).alias("iv"))


@query("k3_iv_at_tenor", """select underlying, tenor, round(case when d0 is null then v1 when d1 is null or d0 = d1 then v0 else sqrt((v0 * v0 * d0 + (v1 * v1 * d1 - v0 * v0 * d0) * (tenor - d0) / (d1 - d0)) / tenor) end, 8) as iv from (
  select underlying, t.tenor, max(dte) filter (where dte <= tenor) as d0, arg_max(iv, dte) filter (where dte <= tenor) as v0, min(dte) filter (where dte >= tenor) as d1, arg_min(iv, dte) filter (where dte >= tenor) as v1 from atm, (values (6), (30), (60), (93), (120)) t(tenor) group by 1, 2)""")
def k3(spark, sf):
    return K.iv_at_tenor(K.atm_iv(chains(spark, sf)), [6, 30, 60, 93, 120]).select("underlying", "tenor", F.round("iv", 8).alias("iv"))


cte("near30", "select c.* from chains c join (select underlying, first(dte order by abs(dte - 30), dte) as dte from chains group by 1) n using (underlying, dte)")


@query("k4_straddle_move", """select underlying, round(case when count(*) = 2 and count(mid) = 2 then sum(mid) / max(spot) end, 8) as move from (select n.*, case when bid > 0 and ask >= bid then (bid + ask) / 2 else last end as mid from near30 n
  join (select underlying, first(strike order by abs(strike - spot), contract) as k from near30 group by 1) a using (underlying) where strike = k) group by 1""")
def k4(spark, sf):
    return K.straddle_move(chains(spark, sf)).select("underlying", F.round("move", 8).alias("move"))


@query("k5_skew25", """select underlying, round(case when pf < 0.1 and cf < 0.1 then pv - cv end, 8) as skew from (select underlying, min(abs(delta + 0.25)) filter (where type = 'P') as pf, first(iv order by abs(delta + 0.25), contract) filter (where type = 'P') as pv,
  min(abs(delta - 0.25)) filter (where type = 'C') as cf, first(iv order by abs(delta - 0.25), contract) filter (where type = 'C') as cv from chains group by 1)""")
def k5(spark, sf):
    return K.skew25(chains(spark, sf)).select("underlying", F.round("skew", 8).alias("skew"))


@query("k6_put_call_volume", "select underlying, sum(volume) as volume, round(sum(case when type = 'P' then volume else 0 end) / nullif(sum(case when type = 'C' then volume else 0 end), 0), 6) as pc_volume from chains group by 1")
def k6(spark, sf):
    return K.put_call_volume(chains(spark, sf)).select("underlying", "volume", F.round("pc_volume", 6).alias("pc_volume"))


@query("k7_leg_select", "select underlying, contract, dte, strike from (select *, row_number() over (partition by underlying order by abs(delta - 0.3), contract) as rn from chains where (ask - bid) / ((ask + bid) / 2) <= 0.15) where rn = 1")
def k7(spark, sf):
    return K.leg_select(chains(spark, sf), 0.3).select("underlying", "contract", "dte", "strike")


@query("k8_vertical_design", """select underlying, dte, short_leg, long_leg, round(credit, 6) as credit, width, round(loss, 6) as loss, cast(floor(0.5 * 100000 / loss) as bigint) as n from (select s.underlying, s.dte, s.contract as short_leg, l.contract as long_leg, s.bid - l.ask as credit, abs(s.strike - l.strike) as width,
  (abs(s.strike - l.strike) - (s.bid - l.ask)) * 100 as loss, row_number() over (partition by s.underlying order by abs(l.delta + 0.15), l.contract) as rn from (select * from (select *, row_number() over (partition by underlying order by abs(delta + 0.5), contract) as rn from chains where type = 'P' and (ask - bid) / ((ask + bid) / 2) <= 0.15) where rn = 1 and abs(delta + 0.5) <= 0.12) s
  join chains l on l.underlying = s.underlying and l.dte = s.dte and l.type = 'P' and l.strike < s.strike and (l.ask - l.bid) / ((l.ask + l.bid) / 2) <= 0.15) where rn = 1 and credit >= -0.5 * width and 0.5 * 100000 / loss >= 1""")
def k8(spark, sf):
    d = K.vertical_design(chains(spark, sf), "P", -0.5, -0.15, 100000.0, 0.5, 0.12, -0.5)
    return d.select("underlying", "dte", "short_leg", "long_leg", F.round("credit", 6).alias("credit"), "width", F.round("loss", 6).alias("loss"), "n")


cte("legs", "select l_orderkey as id, l_partkey as symbol, case when l_linenumber % 2 = 0 then -l_quantity else l_quantity end as qty from lineitem")
cte("quotes", "select p_partkey as symbol, case when p_partkey % 50 = 7 then 0 else 1 + p_size / 10 end as bid, (1 + p_size / 10) * 1.05e0 as ask from part")
cte("closing", """select id, case when count(px) = count(*) then sum(-qty * px * 100) end as cost from (select l.id, l.qty, case when (case when l.qty < 0 then q.ask else q.bid end) > 0 then (case when l.qty < 0 then q.ask else q.bid end) end as px from legs l left join quotes q using (symbol)) group by 1""")


def legs(spark, sf):
    return S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("symbol"), F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("qty"))


def quotes(spark, sf):
    return S.table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"), F.when(F.col("p_partkey") % 50 == 7, 0.0).otherwise(1 + F.col("p_size") / 10).alias("bid"), ((1 + F.col("p_size") / 10) * 1.05).alias("ask"))


def positions(spark, sf):
    return legs(spark, sf).groupBy("id").agg(F.collect_list(F.struct("symbol", "qty")).alias("legs"))


@query("k9_exit_rules", """select id, why from (select o_orderkey as id, case when dte <= 21 then 'expiry near' when timetable then null when bias > 0 and not src then 'source closed' when bias < 0 and trend > 0 then 'trend turned up' when bias < 0 and held >= 20 then 'held long enough'
  when legs = 2 and cc <= -0.5 * -100 then 'half the credit earned' end as why from (select o.*, cast(o_orderkey % 60 as int) as dte, o_orderpriority = '5-LOW' as timetable, case when o_orderstatus = 'P' then -1 else 1 end as bias, o_orderstatus <> 'F' as src, cast(o_custkey % 3 as int) - 1 as trend, cast(o_custkey % 40 as int) as held, n.n as legs, n.cost as cc
  from orders o join (select c.id, c.cost, l.n from closing c join (select id, count(*) as n from legs group by 1) l using (id)) n on n.id = o.o_orderkey)) where why is not null""")
def k9(spark, sf):
    pos = positions(spark, sf)
    n = pos.select("id", F.size("legs").alias("legs")).join(K.close_cost(pos, quotes(spark, sf)).withColumnRenamed("cost", "close_cost"), "id")
    o = S.table(spark, sf, "orders")
    p = o.join(n, o.o_orderkey == n.id).select("id", (F.col("o_orderkey") % 60).cast("int").alias("dte"), (F.col("o_orderpriority") == "5-LOW").alias("timetable"), F.when(F.col("o_orderstatus") == "P", -1).otherwise(1).alias("bias"),
        (F.col("o_orderstatus") != "F").alias("source_open"), (F.col("o_custkey") % 3 - 1).cast("int").alias("trend"), (F.col("o_custkey") % 40).cast("int").alias("days_held"), "legs", "close_cost", F.lit(-100.0).alias("cost"))
    return K.exit_rules(p)


@query("k10_close_cost", "select id, round(cost, 4) as cost from closing")
def k10(spark, sf):
    return K.close_cost(positions(spark, sf), quotes(spark, sf)).select("id", F.round("cost", 4).alias("cost"))


@query("k11_reconcile", """select symbol, want, qty, round(mv, 4) as market_value, round(mid, 4) as mid_value, concat_ws(',', case when qty <> want then 'quantity' end, case when mid is null and qty <> 0 then 'no quote' when abs(mv - mid) > greatest(100, 0.2 * abs(mid)) then 'value off mid' end) as flags from (
  select coalesce(w.symbol, h.symbol) as symbol, coalesce(w.want, 0) as want, coalesce(h.qty, 0) as qty, coalesce(h.mv, 0) as mv, case when q.bid > 0 and q.ask > 0 then coalesce(h.qty, 0) * (q.bid + q.ask) / 2 * 100 end as mid from (select l_partkey as symbol, sum(l_quantity) as want from lineitem where l_returnflag <> 'A' group by 1) w
  full join (select l_partkey as symbol, sum(l_quantity) as qty, sum(l_quantity) * 250 as mv from lineitem where l_returnflag <> 'N' group by 1) h on w.symbol = h.symbol left join quotes q on q.symbol = coalesce(w.symbol, h.symbol))""")
def k11(spark, sf):
    l = S.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_quantity").alias("qty"), "l_returnflag")
    have = l.filter("l_returnflag <> 'N'").groupBy("symbol").agg(F.sum("qty").alias("qty"), (F.sum("qty") * 250).alias("market_value"))
    df = K.reconcile(l.filter("l_returnflag <> 'A'"), have, quotes(spark, sf))
    return df.select("symbol", "want", "qty", F.round("market_value", 4).alias("market_value"), F.round("mid_value", 4).alias("mid_value"), "flags")


@query("k12_playbook_score", """select o_orderpriority as playbook, count(*) filter (where not c) as open, count(*) filter (where c) as closed, round(sum(case when c then pnl else 0 end), 2) as realised, round(sum(case when not c then pnl else 0 end), 2) as unrealised, count(*) filter (where c and pnl > 0) as wins
  from (select o_orderpriority, o_orderstatus = 'F' as c, o_totalprice - 250000 as pnl from orders) group by 1""")
def k12(spark, sf):
    p = S.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("playbook"), (F.col("o_orderstatus") == "F").alias("closed"), (F.col("o_totalprice") - 250000).alias("pnl"))
    return K.playbook_score(p).withColumns({c: F.round(c, 2) for c in ("realised", "unrealised")})


@query("k13_entry_quota", """select playbook, underlying from (select s.playbook, s.underlying, row_number() over (partition by s.playbook order by s.underlying) as rn, coalesce(h.n, 0) as n from (
  select distinct o_orderpriority || o_orderstatus as playbook, c_name as underlying from orders join customer on c_custkey = o_custkey where o_totalprice > 300000) s left join (select o_orderpriority || o_orderstatus as playbook, count(*) as n from orders where o_totalprice > 499500 group by 1) h using (playbook)
  where not exists (select 1 from orders join customer on c_custkey = o_custkey where o_totalprice > 499500 and o_orderpriority || o_orderstatus = s.playbook and c_name = s.underlying)) where rn <= 3 - n""")
def k13(spark, sf):
    o = S.table(spark, sf, "orders").join(S.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.concat("o_orderpriority", "o_orderstatus").alias("playbook"), F.col("c_name").alias("underlying"), "o_totalprice")
    return K.entry_quota(o.filter("o_totalprice > 300000"), o.filter("o_totalprice > 499500"))
