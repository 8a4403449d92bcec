"""Q: streaming jobs replayed over the event table; the SQL twins say what the batch result must be."""

from pyspark.sql import functions as F

from ..sources import bindings as S
from ..streaming import jobs as Q
from .bars import OHLC, R_OHLC, tick_sql
from .catalog import query
from .outcomes import rounded

DONE = "(select date_trunc('millisecond', max(ts)) - interval {0} from events)"


def events(spark, sf):
    return Q.read_events(spark, sf)


@query("q1_stream_hourly_counts", f"select date_trunc('hour', ts) as hour, count(*) as messages, count(*) filter (where event_type = 'signup') as bullish, count(*) filter (where event_type = 'error') as bearish from events where date_trunc('hour', ts) + interval 1 hour <= {DONE.format('10 minutes')} group by 1")
def q1(spark, sf):
    mood = F.when(F.col("event_type") == "signup", "Bullish").when(F.col("event_type") == "error", "Bearish")
    e = events(spark, sf)
    m = e.unionByName(events(spark, sf)).select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), mood.alias("mood"))
    return Q.run(Q.hourly_counts(m))


@query("q2_stream_bars", f"select asset, ts, {R_OHLC}, volume from ({tick_sql('time_bucket(interval 1 hour, ts)')}) where ts + interval 1 hour <= {DONE.format('16 minutes')}")
def q2(spark, sf):
    t = events(spark, sf).select(F.col("user_id").alias("asset"), F.col("ts").alias("at"), "event_id", (100 + F.sqrt("value") / 3).alias("price"), F.lit(1.0).alias("volume"))
    return rounded(Q.run(Q.finished_bars(t, "1 hour", "16 minutes", S.event_order()))).select("asset", "ts", *OHLC, "volume")


@query("q3_stream_news_24h", f"select asset, until, count(*) as n from (select user_id as asset, unnest(generate_series(time_bucket(interval 1 hour, ts) + interval 1 hour, time_bucket(interval 1 hour, ts) + interval 24 hours, interval 1 hour)) as until from events) where until <= {DONE.format('10 minutes')} group by 1, 2")
def q3(spark, sf):
    return Q.run(Q.rolling_counts(events(spark, sf).select(F.col("user_id").alias("asset"), "ts")))


@query("q4_stream_bursts", f"""select asset, min(ts) as start, max(ts) + interval 4 hours as "end", count(*) as n from (select *, sum(case when p is null or ts - p >= interval 4 hours then 1 else 0 end) over (partition by asset order by ts) as g from (select user_id as asset, ts, lag(ts) over (partition by user_id order by ts) as p from events)) group by asset, g having max(ts) + interval 4 hours <= {DONE.format('10 minutes')}""")
def q4(spark, sf):
    return Q.run(Q.bursts(events(spark, sf).select(F.col("user_id").alias("asset"), "ts"), "4 hours"))


@query("q5_stream_cluster_signal", "select asset, date '1970-01-01' + cast(dn as int) as day from sgr",
       sbuys="select user_id % 10 as asset, user_id as owner, cast(ts as date) as day from events where event_type = 'purchase'",
       sn="select a.asset, a.day, count(distinct b.owner) as n from (select distinct asset, day from sbuys) a join sbuys b on b.asset = a.asset and b.day between a.day - 2 and a.day group by 1, 2 having count(distinct b.owner) >= 8 and a.day < (select max(day) from sbuys) - 1",
       sx="select asset, dn, min(dn) over (partition by asset order by dn range between 4 following and unbounded following) as nxt from (select asset, cast(date_diff('day', date '1970-01-01', day) as bigint) as dn from sn)",
       sgr="select asset, min(dn) as dn from sx group by asset union all select x.asset, x.nxt from sgr g join sx x on x.asset = g.asset and x.dn = g.dn where x.nxt is not null")
def q5(spark, sf):
    f = events(spark, sf).filter("event_type = 'purchase'").select((F.col("user_id") % 10).alias("asset"), F.col("user_id").alias("owner"), F.date_trunc("day", "ts").alias("day"))
    return Q.run(Q.cluster_signals(f, 8, 3))


@query("q6_stream_touch_alerts", "select distinct trade, case when side * (100 + sqrt(value) / 3 - stop) <= 0 then 'stop' when side * (100 + sqrt(value) / 3 - target) >= 0 then 'target' end as level from events join (select s_suppkey as trade, s_suppkey % 150 as asset, case when s_nationkey % 2 = 0 then 1 else -1 end as side, 101 + (s_nationkey % 5) / 10 as stop, 103 - (s_nationkey % 7) / 10 as target from supplier) p on p.asset = user_id where side * (100 + sqrt(value) / 3 - stop) <= 0 or side * (100 + sqrt(value) / 3 - target) >= 0")
def q6(spark, sf):
    n = F.col("s_nationkey")
    plan = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("trade"), (F.col("s_suppkey") % 150).alias("asset"), F.when(n % 2 == 0, 1).otherwise(-1).alias("side"), (101 + (n % 5) / 10).alias("stop"), (103 - (n % 7) / 10).alias("target"))
    p = events(spark, sf).select(F.col("user_id").alias("asset"), "ts", (100 + F.sqrt("value") / 3).alias("price"))
    return Q.run(Q.touch_alerts(p, plan))


@query("q7_stream_alert_throttle", f"select asset, ts, 'alert' as kind from thr where ts < {DONE.format('10 minutes').replace('events', 'thr0')} union all select asset, ts + interval 6 hours, 'over' from (select asset, ts, lead(ts) over (partition by asset order by k) as n from thr0) where (n is null or n - ts >= interval 6 hours) and ts + interval 6 hours <= {DONE.format('10 minutes').replace('events', 'thr0')}", thr0="select user_id as asset, ts, row_number() over (partition by user_id order by ts) as k from events where event_type = 'error'",
       thrx="select a.asset, a.k, a.ts, min(b.k) as nxt from thr0 a left join thr0 b on b.asset = a.asset and b.ts >= a.ts + interval 6 hours group by 1, 2, 3", thr="select asset, k, ts, nxt from thrx where k = 1 union all select x.asset, x.k, x.ts, x.nxt from thr t join thrx x on x.asset = t.asset and x.k = t.nxt")
def q7(spark, sf):
    return Q.run(Q.alert_throttle(events(spark, sf).filter("event_type = 'error'").select(F.col("user_id").alias("asset"), "ts"), 6))


@query("q8_stream_frozen_decisions", "select user_id as asset, cast(ts as date) as day, first(event_type order by ts, event_id) as decision from events group by 1, 2")
def q8(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("asset"), F.col("ts").cast("date").alias("day"), "ts", "event_id", F.col("event_type").alias("decision"))
    return Q.run(e, merge=Q.first_write_wins(["asset", "day"]), prune="day").select("asset", "day", "decision")


@query("q9_stream_late_data", "select user_id as asset, cast(ts as date) as day, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def q9(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("asset"), "ts", "value")
    return rounded(Q.run(Q.daily_totals(e), "update", ["asset", "day"]), 2)


@query("q10_stream_trailing_stop", "select user_id as asset, round(100 + sqrt(max(value)) / 3, 6) as best, round(100 + sqrt(max(value)) / 3 - 0.5, 6) as stop from events group by 1")
def q10(spark, sf):
    p = events(spark, sf).select(F.col("user_id").alias("asset"), "ts", (100 + F.sqrt("value") / 3).alias("price"))
    return rounded(Q.run(Q.trailing_stops(p, 0.5), "update", ["asset"]))


@query("q9_stream_late_counts", "select cast(0 as bigint) as batch, count(*) as kept, cast(0 as bigint) as dropped from events")
def q9b(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("asset"), "ts", "value")
    return Q.run_late(e)[1].select("batch", "kept", "dropped")


@query("q9_stream_on_time_totals", "select user_id as asset, cast(ts as date) as day, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def q9c(spark, sf):
    return rounded(Q.run_late(events(spark, sf).select(F.col("user_id").alias("asset"), "ts", "value"))[0], 2)


TICK = "100 + sqrt(value) / 3"


@query("q10_stream_trade_stops", f"""select trade, ts, kind, round(stop, 6) as stop from (select trade, ts, k, 'out' as kind, side * held as stop from sq2 where k = ended union all select trade, ts, k, 'move', side * now from sq2 where (ended is null or k < ended) and now > held)""",
       sq0="select user_id as trade, user_id as asset, case when user_id % 2 = 0 then 1 else -1 end as side, p as entry, p - case when user_id % 2 = 0 then 1 else -1 end * (0.5 + user_id % 4) as stop, 0.5 + user_id % 3 as trail, since from (select user_id, arg_min(100 + sqrt(value) / 3, (ts, event_id)) as p, min(ts) as since from events group by 1)",
       sq1=f"select t.*, e.ts, {TICK} as price, row_number() over (partition by trade order by e.ts, event_id) as k from sq0 t join events e on e.user_id = t.asset and e.ts >= t.since where e.ts < {DONE.format('10 minutes')}",
       sqr="select *, greatest(side * stop, side * entry - trail, max(side * price) over (partition by trade order by k) - trail) as now, greatest(side * stop, case when k > 1 then greatest(side * entry, max(side * price) over (partition by trade order by k rows between unbounded preceding and 1 preceding)) - trail end) as held from sq1",
       sq2="select *, min(case when side * price <= held then k end) over (partition by trade) as ended from sqr")
def q10b(spark, sf):
    e = S.table(spark, sf, "events")
    first = e.groupBy("user_id").agg(F.min_by((100 + F.sqrt("value") / 3), F.struct("ts", "event_id")).alias("p"), F.min("ts").cast("timestamp").alias("since"))
    side = F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)
    trades = first.select(F.col("user_id").alias("trade"), F.col("user_id").alias("asset"), side.alias("side"), F.col("p").alias("entry"), (F.col("p") - side * (0.5 + F.col("user_id") % 4)).alias("stop"), (0.5 + F.col("user_id") % 3).alias("trail"), "since")
    p = events(spark, sf).select(F.col("user_id").alias("asset"), "ts", F.col("event_id").alias("seq"), (100 + F.sqrt("value") / 3).alias("price"))
    return rounded(Q.run(Q.trade_stops(p, trades)))


@query("q11_stream_fill_match", "select f.user_id as asset, f.event_id as fill_id, f.ts as fill_ts, o.event_id as order_id, o.ts as order_ts from events f join events o on o.user_id = f.user_id and f.event_type = 'purchase' and o.event_type = 'click' and o.ts <= f.ts and o.ts >= f.ts - interval 3 hours")
def q11(spark, sf):
    e = events(spark, sf)
    f = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("asset"), F.col("event_id").alias("fill_id"), F.col("ts").alias("fill_ts"))
    o = events(spark, sf).filter("event_type = 'click'").select(F.col("user_id").alias("order_asset"), F.col("event_id").alias("order_id"), F.col("ts").alias("order_ts"))
    return Q.run(Q.match_fills(f, o, "3 hours"))


@query("q12_stream_running_equity", "select user_id as account, round(last(value order by ts, event_id), 4) as equity, round(max(value), 4) as best, round(last(value order by ts, event_id) / max(value) - 1, 6) as drawdown from events group by 1")
def q12(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("account"), F.col("value").alias("equity"), F.struct("ts", "event_id").alias("seq"))
    df = Q.run(Q.running_equity(e), "update", ["account"])
    return df.select("account", F.round("equity", 4).alias("equity"), F.round("best", 4).alias("best"), F.round("drawdown", 6).alias("drawdown"))
