"""D: point-in-time and interval joins."""

from pyspark.sql import functions as F

from ..functions.temporal import on_session
from ..functions.windows import own
from ..operators import bars as B
from ..operators import features as C
from ..operators import pit as D
from ..sources import bindings as S
from .bars import NY, cal_d
from .catalog import cte, query

day = lambda s: F.lit(s).cast("date")


@query("d1_known_asof", """select id, asset, "end", round(val, 2) as val from (select o.o_orderkey as id, o.o_custkey as asset, f."end", f.val,
  row_number() over (partition by o.o_orderkey order by f."end" desc, f.filed) as rn from orders o left join funda f on f.asset = o.o_custkey and f.filed < cast(o.o_orderdate as date)) where rn = 1""")
def d1(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("asset"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("at"))
    return D.known_asof(o, S.fundamentals(spark, sf), "at").select("id", "asset", "end", F.round("val", 2).alias("val"))


@query("d2_on_days", "select asset, filed, min(ts) as ts from (select distinct asset, filed from buys) b join bars_w w using (asset) where w.ts >= b.filed group by 1, 2")
def d2(spark, sf):
    ev = S.purchases(spark, sf).select("asset", "filed").distinct()
    return on_session(ev, S.weekly_bars(spark, sf), "filed").select("asset", "filed", "ts")


cte("rel_day", f"""select asset, accepted, case when hour(ny) * 60 + minute(ny) < 570 then cast(ny as date) else cast(ny as date) + 1 end as day from (select *, accepted {NY} as ny from earn)""")


@query("d3_release_session", "select asset, accepted, day from rel_day")
def d3(spark, sf):
    return S.earnings(spark, sf).select("asset", "accepted", D.release_day(F.col("accepted")).alias("day"))


@query("d4_news_day", f"select event_id as id, cast(ts {NY} + interval 8 hours as date) as day from events")
def d4(spark, sf):
    return S.table(spark, sf, "events").select(F.col("event_id").alias("id"), D.news_day(F.col("ts")).alias("day"))


def spells_sql(src):
    return f"""select asset, min(month) as start, case when max(sno) < (select max(sno) from mcal_{src}) then (select c.month from mcal_{src} c where c.sno = max(i.sno) + 1) end as "end"
  from (select *, sum(case when p is null or sno - p > 2 then 1 else 0 end) over (partition by asset order by sno) as grp from (
  select s.asset, c.sno, s.month, lag(c.sno) over (partition by s.asset order by c.sno) as p from {src} s join mcal_{src} c using (month))) i group by asset, grp"""


def spells_cte(src):
    cte(f"mcal_{src}", f"select month, row_number() over (order by month) as sno from (select distinct month from {src})")
    cte(f"sp_{src}", f"""select i.asset, i.start, c.month as "end" from (select asset, min(month) as start, max(sno) as last from (
  select *, sum(case when p is null or sno - p > 2 then 1 else 0 end) over (partition by asset order by sno) as grp from (
  select s.asset, c.sno, s.month, lag(c.sno) over (partition by s.asset order by c.sno) as p from {src} s join mcal_{src} c using (month))) group by asset, grp) i
  left join mcal_{src} c on c.sno = i.last + 1""")


spells_cte("snaps")
cte("spells", 'select s.asset, s.start, s."end", x.sector from sp_snaps s join sect x using (asset)')


def spells(spark, sf):
    return D.spells_from_snapshots(S.snapshots(spark, sf)).join(S.sectors(spark, sf).select("asset", "sector"), "asset")


@query("d5_spells_from_snapshots", 'select asset, start, "end" from spells')
def d5(spark, sf):
    return spells(spark, sf).select("asset", "start", "end")


cte("snaps_old", "select * from snaps where month < date '2000-01-01'")
spells_cte("snaps_old")
cte("today_list", "select s.asset, x.segment as sector from snaps s join sect x using (asset) where month = date '2000-01-01'")


@query("d6_roll_spells", """select s.asset, s.start, s."end", x.sector from sp_snaps_old s join sect x using (asset) where s."end" is not null
  union all select coalesce(o.asset, t.asset), coalesce(o.start, date '2000-01-01'), case when t.asset is null then date '2000-01-01' end, coalesce(t.sector, o.sector)
  from (select s.*, x.sector from sp_snaps_old s join sect x using (asset) where s."end" is null) o full join today_list t on o.asset = t.asset""")
def d6(spark, sf):
    snaps, sect = S.snapshots(spark, sf), S.sectors(spark, sf)
    old = D.spells_from_snapshots(snaps.filter("month < date'2000-01-01'")).join(sect.select("asset", "sector"), "asset")
    today = snaps.filter("month = date'2000-01-01'").join(sect, "asset").select("asset", F.col("segment").alias("sector"))
    return D.roll_spells(old, today, day("2000-01-01"))


cte("snaps_q", "select asset, month from (select asset, month, count(*) over (partition by asset order by month) as k from snaps) where asset % 4 > 0 or k <= 12")
spells_cte("snaps_q")


def early_leavers(spark, sf):
    from pyspark.sql import Window

    k = F.count("*").over(Window.partitionBy("asset").orderBy("month"))
    return D.spells_from_snapshots(S.snapshots(spark, sf).withColumn("k", k).filter("asset % 4 > 0 or k <= 12").select("asset", "month"))


@query("d7_membership_cut", """select asset, ts from (select *, sum(brk) over (partition by asset order by ts) as breaks, sum(aft) over (partition by asset order by ts) as n from (
  select b.asset, b.ts, case when b.ts >= m.l then 1 else 0 end as aft, case when b.ts >= m.l and date_diff('day', lag(b.ts) over (partition by b.asset order by b.ts), b.ts) > 60 then 1 else 0 end as brk
  from bars_d b join (select asset, min(start) as f, case when count(*) = count("end") then max("end") end as l from sp_snaps_q group by 1) m using (asset) where b.ts >= m.f - 550)) where aft = 0 or (breaks = 0 and n <= 20)""")
def d7(spark, sf):
    return D.cut_to_membership(S.daily_bars(spark, sf), D.membership_windows(early_leavers(spark, sf)), 550, 20, 60).select("asset", "ts")


MASK = """exists (select 1 from spells s where s.asset = b.asset and {d} >= s.start and {d} < coalesce(s."end", date '9999-12-31'))"""


@query("d8_membership_mask", f"""select 'plain' as kind, asset, ts from bars_w b where {MASK.format(d='b.ts')} union all
  select 'floor', asset, ts from bars_w b where {MASK.format(d="greatest(b.ts, date '1998-06-01')")} union all
  select 'sector', asset, ts from bars_w b where exists (select 1 from spells s where s.asset = b.asset and s.sector = 'ASIA' and b.ts >= s.start and b.ts < coalesce(s."end", date '9999-12-31'))""")
def d8(spark, sf):
    bars, sp = S.weekly_bars(spark, sf).select("asset", "ts"), spells(spark, sf)
    parts = [("plain", D.membership_mask(bars, sp)), ("floor", D.membership_mask(bars, sp, day("1998-06-01"))), ("sector", D.membership_mask(bars, sp.filter("sector = 'ASIA'")))]
    out = [df.select(F.lit(k).alias("kind"), "asset", "ts") for k, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("d9_members_since", """select distinct asset from spells where coalesce("end", date '9999-12-31') > date '2001-06-01'""")
def d9(spark, sf):
    return D.members_since(spells(spark, sf), day("2001-06-01"))


cte("spells_seg", """select asset, start, "end", case when month(start) % 2 = 0 then segment else sector end as sector from sp_snaps join sect using (asset)""")


def mixed_spells(spark, sf):
    sp = D.spells_from_snapshots(S.snapshots(spark, sf)).join(S.sectors(spark, sf), "asset")
    return sp.select("asset", "start", "end", F.when(F.month("start") % 2 == 0, F.col("segment")).otherwise(F.col("sector")).alias("sector"))


@query("d10_current_attribute", """select a.asset, a.sector, b.sector as last_index from (select asset, last(sector order by coalesce("end", date '9999-12-31'), start) as sector from spells_seg group by 1) a
  join (select asset, last(sector order by start) as sector from spells_seg group by 1) b using (asset)""")
def d10(spark, sf):
    sp = mixed_spells(spark, sf)
    last = sp.groupBy("asset").agg(F.max_by("sector", F.struct("start", "sector")).alias("last_index"))
    return D.current_attribute(sp).join(last, "asset")


cte("views", "select user_id as asset, cast(ts as date) as day, last(cast(floor(value) as int) % 5 - 2 order by ts, event_id) as bias from events where event_type = 'purchase' group by 1, 2")


def views(spark, sf):
    e = S.table(spark, sf, "events").filter("event_type = 'purchase'")
    return e.groupBy(F.col("user_id").alias("asset"), F.col("ts").cast("date").alias("day")).agg(
        F.max_by((F.floor("value") % 5 - 2).cast("int"), F.struct("ts", "event_id")).alias("bias"))


cte("view_h", """select b.asset, b.ts, coalesce(case when date_diff('day', v.usable, cast(b.ts as date)) <= 4 then v.bias end, 0) as bias from bars_h b
  asof left join (select asset, day + 1 as usable, bias from views) v on v.asset = b.asset and b.ts >= v.usable""")


@query("d11_view_asof", "select * from view_h")
def d11(spark, sf):
    return D.view_asof(S.hourly_bars(spark, sf).select("asset", "ts"), views(spark, sf)).select("asset", "ts", "bias")


def insider_sql(grid, lo, hi):
    """Buyers and dollars in a window of days around each grid row: filed between day - lo and day - hi."""
    return f"""select g.asset, g.day, coalesce(p.buyers, 0) as buyers, round(ln(1 + coalesce(p.bought, 0)), 6) as log_bought, round(ln(1 + coalesce(s.sold, 0)), 6) as log_sold from {grid} g
  left join (select g.asset, g.day, count(distinct f.owner) as buyers, sum(f.value) as bought from {grid} g join buys f on f.asset = g.asset and f.filed between g.day - {lo[0]} and g.day - {hi} group by 1, 2) p using (asset, day)
  left join (select g.asset, g.day, sum(f.value) as sold from {grid} g join (select * from filings where code = 'S' and not plan) f on f.asset = g.asset and f.filed between g.day - {lo[1]} and g.day - {hi} group by 1, 2) s using (asset, day)"""


cte("grid_w", "select asset, ts as day from bars_w")


def grid_w(spark, sf):
    return S.weekly_bars(spark, sf).select("asset", F.col("ts").alias("day"))


def rounded(df):
    return df.select("asset", "day", F.col("buyers").cast("long").alias("buyers"), F.round("log_bought", 6).alias("log_bought"), F.round("log_sold", 6).alias("log_sold"))


@query("d12_event_window_agg", insider_sql("grid_w", (20, 10), 1))
def d12(spark, sf):
    return rounded(D.insider_windows(S.filings(spark, sf), grid_w(spark, sf), 20, 10, include_today=False))


cte("grid_f", "select distinct asset, cast(ts + 4 as date) as day from bars_w")


@query("d13_event_window_panel", insider_sql("grid_f", (19, 9), 0))
def d13(spark, sf):
    grid = S.weekly_bars(spark, sf).select("asset", F.date_add("ts", 4).alias("day"))
    return rounded(D.insider_windows(S.filings(spark, sf), grid, 20, 10, include_today=True))


cte("cost_w", """select g.asset, g.day, sum(f.price * f.shares) / nullif(sum(f.shares), 0) as cost, count(distinct f.owner) as buyers from grid_w g
  left join buys f on f.asset = g.asset and f.filed between g.day - 19 and g.day group by 1, 2""")


@query("d14_prefix_vwap", "select asset, day, round(cost, 6) as cost, buyers from cost_w")
def d14(spark, sf):
    df = D.purchase_cost(S.purchases(spark, sf), grid_w(spark, sf), 20)
    return df.select("asset", "day", F.round("cost", 6).alias("cost"), F.col("buyers").cast("long").alias("buyers"))


cte("univ_w", f"""select c.ts, coalesce(u.ret, 0) as ret from (select distinct ts from bars_w) c left join (
  select ts, avg(ret) as ret from ret_w b where volume > 0 and {MASK.format(d='b.ts')} group by 1) u using (ts)""")


@query("d15_universe_return", "select ts, round(ret, 9) as ret from univ_w")
def d15(spark, sf):
    return D.universe_return(S.weekly_bars(spark, sf), spells(spark, sf)).select("ts", F.round("ret", 9).alias("ret"))


@query("d16_coverage_check", """select gap as worst, day as since, gap <= 5 as complete from (select day, date_diff('day', day, lead(day) over (order by day)) as gap from (
  select ts as day from cal_d where ts >= date '1998-01-01' and ts in (select cast(o_orderdate as date) from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F')
  union select date '1997-12-31' union select max(ts) from cal_d)) where gap is not null order by gap desc, day limit 1""")
def d16(spark, sf):
    done = S.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_orderdate").cast("date").alias("day"))
    cal = cal_d(spark, sf).select(F.col("ts").alias("day"))
    days = cal.join(done, "day", "left_semi").unionByName(cal.agg(F.max("day").alias("day")))
    df = D.coverage_check(days, day("1998-01-01"), day("1998-01-01"))
    return df.select(F.col("worst").cast("long").alias("worst"), "since", "complete")


cte("revs", """select distinct case o_orderpriority when '1-URGENT' then 'mid' else 'small' end as list, cast(date_trunc('month', o_orderdate) + case o_orderpriority when '1-URGENT' then interval 14 days else interval 9 days end as date) as rev,
  l_suppkey as asset from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R' and o_orderpriority in ('1-URGENT', '2-HIGH')""")
cte("rev_ok", "select list, rev from (select list, rev, count(*) as n from revs group by 1, 2) join (select list, count(*) / count(distinct rev) as a from revs group by 1) using (list) where n >= 0.9 * a and n <= 1.25 * a")
cte("rev_at", "select m.month, l.list, r.rev from (select distinct cast(date_trunc('month', o_orderdate) as date) as month from orders) m cross join (select distinct list from rev_ok) l asof join rev_ok r on r.list = l.list and r.rev < m.month")
cte("rev_names", "select a.list, a.month, r.asset from rev_at a join revs r using (list, rev)")


@query("d17_monthly_snapshots", """select list, month, asset from rev_names where list = 'mid' union all
  select list, month, asset from rev_names n where list = 'small' and not exists (select 1 from rev_names m where m.list = 'mid' and m.month = n.month and m.asset = n.asset)""")
def d17(spark, sf):
    l = S.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    o = S.table(spark, sf, "orders").filter("o_orderpriority in ('1-URGENT', '2-HIGH')")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    revs = l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.when(urgent, "mid").otherwise("small").alias("list"),
        F.when(urgent, F.date_add(F.trunc("o_orderdate", "month"), 14)).otherwise(F.date_add(F.trunc("o_orderdate", "month"), 9)).alias("rev"),
        F.col("l_suppkey").alias("asset")).distinct()
    usual = revs.groupBy("list", "rev").agg(F.count("*").alias("n")).groupBy("list").agg(F.avg("n").alias("a"))
    plausible = usual.select("list", (0.9 * F.col("a")).alias("least_names"), (1.25 * F.col("a")).alias("most_names"))
    months = S.table(spark, sf, "orders").select(F.trunc("o_orderdate", "month").alias("month")).distinct()
    return D.monthly_snapshots(revs, months, plausible)


COSTS = {"AFRICA": 4.0, "AMERICA": 6.0, "ASIA": 8.0}


@query("d18_cost_lookup", """select s_suppkey as asset, coalesce(c.bp, 15) as bp from supplier left join (select asset, last(sector order by start, sector) as list from spells_seg group by 1) l on l.asset = s_suppkey
  left join (values """ + ", ".join(f"('{k}', {v}e0)" for k, v in COSTS.items()) + ") c(list, bp) on c.list = l.list")
def d18(spark, sf):
    costs = spark.createDataFrame(list(COSTS.items()), "list string, bp double")
    return D.cost_lookup(S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("asset")), mixed_spells(spark, sf), costs)


@query("d19_context_join", """select f.asset, f.ts, round(f.adx, 6) as adx, round(f.rsi14, 6) as rsi14, round(c.cost, 6) as cost, c.buyers, round(u.ret, 9) as market, date_diff('day', f.ts, e.event) as to_earnings
  from feat_w f join cost_w c on c.asset = f.asset and c.day = f.ts join univ_w u on u.ts = f.ts asof left join earn_day e on e.asset = f.asset and e.event >= f.ts""")
def d19(spark, sf):
    bars = S.weekly_bars(spark, sf)
    feats = C.with_rsi(C.with_adx(bars), 14, "rsi14").select("asset", "ts", "adx", "rsi14")
    cost = D.purchase_cost(S.purchases(spark, sf), grid_w(spark, sf), 20).withColumnRenamed("day", "ts")
    earn = S.earnings(spark, sf).select("asset", F.col("accepted").cast("date").alias("event"))
    to = B.days_to_next(grid_w(spark, sf), earn, ["asset"], "to_earnings").withColumnRenamed("day", "ts")
    market = D.universe_return(bars, spells(spark, sf)).withColumnRenamed("ret", "market")
    out = feats.join(cost, ["asset", "ts"]).join(to, ["asset", "ts"]).join(market, "ts")
    return out.select("asset", "ts", F.round("adx", 6).alias("adx"), F.round("rsi14", 6).alias("rsi14"), F.round("cost", 6).alias("cost"),
                      F.col("buyers").cast("long").alias("buyers"), F.round("market", 9).alias("market"), F.col("to_earnings").cast("long").alias("to_earnings"))
