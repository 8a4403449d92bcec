"""B: cleaning, resampling, calendars."""

from pyspark.sql import functions as F

from ..operators import bars as B
from ..sources import bindings as S
from .catalog import cte, query

NY = "at time zone 'UTC' at time zone 'America/New_York'"


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


OHLC = ["open", "high", "low", "close"]
R_OHLC = ", ".join(f"round({c}, 6) as {c}" for c in OHLC)


@query("b1_validate_bars", f"""select asset, ts, {R_OHLC}, volume, case when pause > 5 then pause end as gap_days from (
  select asset, ts, open, greatest(open, high, low, close) as high, least(open, high, low, close) as low, close, volume,
  date_diff('day', lag(ts) over (partition by asset order by ts), ts) as pause from (
  select *, row_number() over (partition by asset, ts order by l_linenumber desc, l_extendedprice desc, l_discount desc, l_tax desc, l_quantity desc) as rn from (
  select l_suppkey as asset, cast(l_shipdate as date) as ts, case when l_linenumber = 7 then 0 else 100 + sqrt(l_extendedprice) / 30 end as open,
  100 + sqrt(l_extendedprice * (1 - l_discount)) / 30 as high, 100 + sqrt(l_extendedprice * (1 - l_tax)) / 30 as low,
  100 + sqrt(l_extendedprice * (1 + l_tax)) / 30 as close, l_quantity as volume, l_linenumber, l_extendedprice, l_discount, l_tax, l_quantity from lineitem))
  where rn = 1 and open > 0 and high > 0 and low > 0 and close > 0)""")
def b1(spark, sf):
    p, d, t = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    raw = S.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("asset"), F.col("l_shipdate").cast("date").alias("ts"),
        F.when(F.col("l_linenumber") == 7, 0.0).otherwise(S.line_price()).alias("open"),
        (100 + F.sqrt(p * (1 - d)) / 30).alias("high"), (100 + F.sqrt(p * (1 - t)) / 30).alias("low"),
        (100 + F.sqrt(p * (1 + t)) / 30).alias("close"), F.col("l_quantity").alias("volume"),
        "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    good = B.validate_bars(raw, ["l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity"])
    return good.select("asset", "ts", *r6(*OHLC), "volume", F.col("gap_days").cast("long").alias("gap_days"))


def ticks(spark, sf):
    return S.table(spark, sf, "events").select(F.col("user_id").alias("asset"), F.col("ts").alias("at"), "event_id",
                                               (100 + F.sqrt("value") / 3).alias("price"), F.lit(1.0).alias("volume"))


def tick_sql(bucket):
    return f"""select user_id as asset, {bucket} as ts, first(px order by ts, event_id) as open, max(px) as high, min(px) as low,
      last(px order by ts, event_id) as close, cast(count(*) as double) as volume from (select *, 100 + sqrt(value) / 3 as px from events) group by 1, 2"""


cte("bars_30", tick_sql("time_bucket(interval 30 minutes, ts)"))


@query("b2_regular_session_hours", f"""select asset, date_trunc('hour', ts) as hour_ts, round(first(open order by ts), 6) as open, round(max(high), 6) as high,
  round(min(low), 6) as low, round(last(close order by ts), 6) as close, sum(volume) as volume from (select *, ts {NY} as ny from bars_30)
  where hour(ny) * 60 + minute(ny) between 570 and 959 group by 1, 2""")
def b2(spark, sf):
    half = B.tick_bars(ticks(spark, sf), "30 minutes", S.event_order())
    return B.regular_session_hours(half).select("asset", F.col("ts").alias("hour_ts"), *r6(*OHLC), "volume")


@query("b3_resample_ohlcv", " union all ".join(f"select '{n}' as length, asset, ts, {R_OHLC}, volume from ({tick_sql(b)})" for n, b in
       (("5 minutes", "time_bucket(interval 5 minutes, ts)"), ("1 hour", "time_bucket(interval 1 hour, ts)"), ("1 day", "date_trunc('day', ts)::timestamp"))))
def b3(spark, sf):
    parts = [B.tick_bars(ticks(spark, sf), n, S.event_order()).select(F.lit(n).alias("length"), "asset", "ts", *r6(*OHLC), "volume")
             for n in ("5 minutes", "1 hour", "1 day")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("b4_complete_bars", """select asset, ts, kind from (select asset, ts, case when asset % 2 = 0 then 'crypto' else 'stock' end as kind from (
  select distinct user_id as asset, date_trunc('day', ts)::timestamp as ts from events))
  where ts + case kind when 'crypto' then interval 24 hours else interval 21 hours end <= (select max(ts) - interval 1 hour from events)""")
def b4(spark, sf):
    days = B.tick_bars(ticks(spark, sf), "1 day", S.event_order()).withColumn("kind", F.when(F.col("asset") % 2 == 0, "crypto").otherwise("stock"))
    now = S.table(spark, sf, "events").agg((F.max("ts") - F.expr("interval 1 hour")).alias("now"))
    return B.complete_bars(days, now, F.when(F.col("kind") == "crypto", 24).otherwise(21)).select("asset", "ts", "kind")


@query("b5_session_number", f"""select asset, ts, cast(ts {NY} as date) as day, row_number() over (partition by asset, cast(ts {NY} as date) order by ts) - 1 as k from bars_h""")
def b5(spark, sf):
    return B.session_number(S.hourly_bars(spark, sf)).select("asset", "ts", "day", F.col("k").cast("long").alias("k"))


@query("b6_last_bar_of_session", f"select asset, ts, ts = max(ts) over (partition by asset, cast(ts {NY} as date)) as is_last from bars_h")
def b6(spark, sf):
    return B.last_bar_of_session(S.hourly_bars(spark, sf)).select("asset", "ts", "is_last")


cte("cal_d", "select distinct cast(l_shipdate as date) as ts from lineitem")


def cal_d(spark, sf):
    return S.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("ts")).distinct()


@query("b7_week_and_month_ends", """select 'week' as kind, max(ts) as ts from cal_d group by ts + cast((5 - isodow(ts) + 7) % 7 as int)
  union all select 'month', ts from (select ts, lead(ts) over (order by ts) as n from cal_d) where date_trunc('month', ts) <> date_trunc('month', n)""")
def b7(spark, sf):
    cal = cal_d(spark, sf)
    return B.week_ends(cal).select(F.lit("week").alias("kind"), "ts").unionByName(B.month_ends(cal).select(F.lit("month").alias("kind"), "ts"))


cte("ended", """select l_suppkey as asset, cast(l_shipdate as date) as ts, max(l_extendedprice) / 100 as close from lineitem
  where cast(l_shipdate as date) < date '1999-06-30' + cast(l_suppkey % 500 as int) group by 1, 2""")


def ended(spark, sf):
    return S.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("asset"), F.col("l_shipdate").cast("date").alias("ts"), "l_extendedprice").filter(
        F.col("ts") < F.date_add(F.lit("1999-06-30").cast("date"), (F.col("asset") % 500).cast("int"))).groupBy("asset", "ts").agg(
        (F.max("l_extendedprice") / 100).alias("close"))


@query("b8_closing_bars", """select asset, ts, round(price, 6) as close, 0e0 as volume from (select l.asset, l.price, cast(d.d as date) as ts,
  row_number() over (partition by l.asset order by d.d) as rn from (select asset, ts, case when close < 1 or (close <= 0.6 * c20 and close <= 0.3 * c250) then 0.01 else close end as price
  from (select *, lag(close, 20) over w as c20, coalesce(lag(close, 250) over w, first(close) over w) as c250, row_number() over (partition by asset order by ts desc) as back
  from ended window w as (partition by asset order by ts)) where back = 1) l,
  lateral (select unnest(generate_series(l.ts + 1, l.ts + 64, interval 1 day)) as d) d where isodow(d.d) < 6) where rn <= 30 and ts <= (select max(ts) from cal_d)""")
def b8(spark, sf):
    end = cal_d(spark, sf).agg(F.max("ts").alias("data_end"))
    return B.closing_bars(ended(spark, sf), end, 30).select("asset", "ts", *r6("close"), "volume")


@query("b9_retire", """select asset, r.ts, round(p, 6) as price, true as blocked from last_seen, recent r
  where lt < (select min(ts) from recent) and r.ts > lt""", recent="select ts from cal_w order by ts desc limit 5",
  last_seen="""select asset, max(ts) as lt, last(close order by ts) as p from bars_w where asset % 7 > 0 or ts < date '2000-01-01' group by 1""")
def b9(spark, sf):
    bars = S.weekly_bars(spark, sf)
    cal = bars.select("ts").distinct()
    gone = bars.filter("asset % 7 > 0 or ts < date'2000-01-01'")
    return B.retired(gone, cal).select("asset", "ts", *r6("price"), "blocked")


@query("b10_bars_since", "select count(distinct ts) as bars from bars_h where ts >= timestamp '2024-01-15'")
def b10(spark, sf):
    return S.hourly_bars(spark, sf).filter("ts >= timestamp'2024-01-15'").agg(F.countDistinct("ts").alias("bars"))


cte("days_e", "select distinct cast(ts as date) as day from events")
cte("hol", "select make_date(y, m, d) as day from (select unnest(range(extract(year from (select min(day) from days_e)), extract(year from (select max(day) from days_e)) + 1)) as y), (values (1, 1), (7, 4), (12, 25)) v(m, d)")
cte("sess_e", """select day, (day + interval 570 minutes) at time zone 'America/New_York' at time zone 'UTC' as open_utc,
  (day + interval 16 hours) at time zone 'America/New_York' at time zone 'UTC' as close_utc from (
  select cast(unnest(generate_series((select min(day) from days_e), (select max(day) from days_e), interval 1 day)) as date) as day) where isodow(day) < 6 and day not in (select day from hol)""")


def days_e(spark, sf):
    return S.table(spark, sf, "events").select(F.col("ts").cast("date").alias("day")).distinct()


def sess_e(spark, sf):
    d = days_e(spark, sf)
    return B.session_table(d, B.year_end_holidays(d))


@query("b11_next_bar", f"""select last, date_trunc('hour', coalesce(case when c < close_utc then greatest(c, open_utc) end, nx)) as next_start from (
  select l.last, l.last + interval 60 minutes as c, s.open_utc, s.close_utc, n.open_utc as nx from (select distinct ts as last from bars_h) l
  left join sess_e s on s.day = cast(l.last {NY} as date) asof left join sess_e n on n.open_utc > l.last)""")
def b11(spark, sf):
    last = S.hourly_bars(spark, sf).select(F.col("ts").alias("last")).distinct()
    return B.next_bar(last, sess_e(spark, sf))


cte("jobs", """select cast(m + cast((5 - isodow(m) + 7) % 7 as int) as date) as day from (select cast(unnest(generate_series(date_trunc('month', (select min(ts) from cal_d)),
  (select max(ts) from cal_d), interval 1 month)) as date) as m) where m + cast((5 - isodow(m) + 7) % 7 as int) <= (select max(ts) from cal_d)""")


def jobs(spark, sf):
    return B.first_fridays(cal_d(spark, sf).select(F.col("ts").alias("day")))


@query("b12_jobs_report_dates", "select day from jobs")
def b12(spark, sf):
    return jobs(spark, sf)


cte("earn_day", "select asset, cast(accepted as date) as event from earn")


@query("b13_days_to_next_event", """select d.asset, d.ts, date_diff('day', d.ts, j.day) as to_jobs, date_diff('day', d.ts, e.event) as to_earnings
  from bars_w d asof left join jobs j on j.day >= d.ts asof left join earn_day e on e.asset = d.asset and e.event >= d.ts""")
def b13(spark, sf):
    days = S.weekly_bars(spark, sf).select("asset", F.col("ts").alias("day"))
    cal = days.select("day").distinct().withColumn("all", F.lit(1))
    to_jobs = B.days_to_next(cal, jobs(spark, sf).select(F.lit(1).alias("all"), F.col("day").alias("event")), ["all"], "to_jobs").select("day", "to_jobs")
    earn = S.earnings(spark, sf).select("asset", F.col("accepted").cast("date").alias("event"))
    out = B.days_to_next(days, earn, ["asset"], "to_earnings").join(to_jobs, "day")
    return out.select("asset", F.col("day").alias("ts"), F.col("to_jobs").cast("long").alias("to_jobs"), F.col("to_earnings").cast("long").alias("to_earnings"))


cte("blk_ev", "select distinct user_id as asset, cast(ts as date) as day from events where event_type = 'signup' and day(ts) % 3 = 0")
cte("blk", f"""select h.asset, h.ts, (e.day is not null or (h.ts = h.last_ts and exists (select 1 from blk_ev x where x.asset = h.asset and x.day > h.day
  and date_diff('day', h.day, x.day) <= 4 and (h.nextday is null or h.nextday >= x.day)))) as blocked
  from (select b.*, s.last_ts, s.nextday from hday b join (select asset, day, max(ts) as last_ts, lead(day) over (partition by asset order by day) as nextday from hday group by asset, day) s
  on s.asset = b.asset and s.day = b.day) h left join blk_ev e on e.asset = h.asset and e.day = h.day""")
cte("hday", f"select *, cast(ts {NY} as date) as day from bars_h")


def blackout(spark, sf):
    ev = S.table(spark, sf, "events").filter("event_type = 'signup' and day(ts) % 3 = 0").select(F.col("user_id").alias("asset"), F.col("ts").cast("date").alias("day"))
    return B.event_blackout(S.hourly_bars(spark, sf), ev).select("asset", "ts", "blocked")


@query("b14_blackout", "select * from blk")
def b14(spark, sf):
    return blackout(spark, sf)


HOLIDAYS = B.market_holidays(2023, 2025)
cte("cls", "select distinct user_id as asset, user_id % 3 > 0 as stock from events")
cte("fed_d", "select distinct cast(ts as date) as day from events where day(ts) % 10 = 1")
cte("job_d", "select distinct cast(ts as date) as day from events where isodow(ts) = 5")


def blackout_sql(bars):
    """The rules over a cte of bars (asset, ts)."""
    free = "[" + ", ".join(f"date '{h}'" for h in HOLIDAYS) + "]"
    pre = "exists (select 1 from (select asset, day from blk_ev union all select s.asset, j.day from job_d j) x where x.asset = s.asset and x.day > s.day and date_diff('day', s.day, x.day) <= 4 and case when nextday is not null then nextday >= x.day else len(list_filter(range(s.day + interval 1 day, cast(x.day as timestamp), interval 1 day), lambda d: isodow(d) < 6 and not list_contains(" + free + ", cast(d as date)))) = 0 end)"
    return f"""select h.asset, h.ts, (h.stock and e.day is not null) or (f.day is not null and h.hour between 13 and 15) or (h.stock and h.pre and case when h.nextday is not null then h.ts = h.last_ts else h.hour = 15 end) or (not h.stock and j.day is not null and h.hour = 8) as blocked
      from (select b.*, c.stock, s.last_ts, s.nextday, {pre} as pre from (select asset, ts, cast(ts {NY} as date) as day, hour(ts {NY}) as hour from {bars}) b join cls c using (asset)
      join (select asset, cast(ts {NY} as date) as day, max(ts) as last_ts, lead(cast(ts {NY} as date)) over (partition by asset order by cast(ts {NY} as date)) as nextday from {bars} group by 1, 2) s on s.asset = b.asset and s.day = b.day) h
      left join blk_ev e on e.asset = h.asset and e.day = h.day left join fed_d f on f.day = h.day left join job_d j on j.day = h.day"""


def calendars(spark, sf):
    e = S.table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"))
    classes = e.select(F.col("user_id").alias("asset"), (F.col("user_id") % 3 > 0).alias("stock")).distinct()
    reports = e.filter("event_type = 'signup' and day(day) % 3 = 0").select(F.col("user_id").alias("asset"), "day")
    days = lambda c: e.filter(c).select("day").distinct()
    return classes, reports, days("day(day) % 10 = 1"), days("weekday(day) = 4"), HOLIDAYS


@query("b14_blackout_rules", "select * from blk_all", blk_all=blackout_sql("bars_h"))
def b14b(spark, sf):
    return B.blackout(S.hourly_bars(spark, sf), *calendars(spark, sf))


@query("b14_next_bar_blocked", f"select asset, b.ts, blocked and not (stock and hour(b.ts {NY}) > 15) as blocked from blk_nx b join cls using (asset) join nx_only n using (asset) where n.ts = b.ts", nx_only="select asset, max(ts) + interval 1 hour as ts from bars_h group by 1", nx_bars="select asset, ts from bars_h union all select * from nx_only", blk_nx=blackout_sql("nx_bars"))
def b14c(spark, sf):
    return B.next_bar_blocked(S.hourly_bars(spark, sf), *calendars(spark, sf))


@query("b15_bars_per_year", "select asset, round(count(*) / nullif((epoch(max(ts)) - epoch(min(ts))) / (365.25 * 86400), 0), 6) as bars_per_year from bars_h group by 1")
def b15(spark, sf):
    return B.bars_per_year(S.hourly_bars(spark, sf)).select("asset", *r6("bars_per_year"))


@query("b16_intraday_flag", """select 'hourly' as kind, asset, bool_or(ts <> date_trunc('day', ts)) as intraday from bars_h group by 2
  union all select 'weekly', asset, bool_or(ts <> date_trunc('day', ts)) from bars_w group by 2""")
def b16(spark, sf):
    def flag(kind, bars):
        return bars.groupBy("asset").agg(F.bool_or(F.col("ts").cast("timestamp") != F.date_trunc("day", "ts")).alias("intraday")).select(F.lit(kind).alias("kind"), "asset", "intraday")
    return flag("hourly", S.hourly_bars(spark, sf)).unionByName(flag("weekly", S.weekly_bars(spark, sf)))


@query("b17_quarter_sequence", """select q as quarter, (select count(*) from orders where date_trunc('quarter', o_orderdate) = q and o_orderstatus = 'P') = 0 as todo from (
  select cast(unnest(generate_series(date_trunc('quarter', (select min(o_orderdate) from orders)) - interval 9 months, (select max(o_orderdate) from orders), interval 3 months)) as date) as q)""")
def b17(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus")
    span = o.agg(F.expr("date_sub(min(day), 0) - interval 9 months").cast("date").alias("day"), F.max("day").alias("b"))
    days = span.select(F.explode(F.array("day", "b")).alias("day"))
    done = o.filter("o_orderstatus = 'P'").select(F.trunc("day", "quarter").alias("quarter")).distinct().withColumn("done", F.lit(True))
    return B.quarter_sequence(days).join(done, "quarter", "left").select("quarter", F.col("done").isNull().alias("todo"))


@query("b18_next_bars", f"""select asset, next_start from (select asset, date_trunc('hour', coalesce(case when c < close_utc then greatest(c, open_utc) end, nx)) as next_start from (
  select l.asset, l.last, l.last + interval 60 minutes as c, s.open_utc, s.close_utc, n.open_utc as nx from (select asset, max(ts) as last from bars_h group by 1) l
  left join sess_e s on s.day = cast(l.last {NY} as date) asof left join sess_e n on n.open_utc > l.last))
  where next_start + interval 1 hour > (select max(ts) from events) - interval 48 hours""")
def b18(spark, sf):
    last = S.hourly_bars(spark, sf).groupBy("asset").agg(F.max("ts").alias("last"))
    moments = B.next_bar(last.select("last").distinct(), sess_e(spark, sf))
    now = S.table(spark, sf, "events").agg((F.max("ts") - F.expr("interval 48 hours")).alias("now")).scalar()
    return last.join(moments, "last").filter(F.col("next_start") + F.expr("interval 1 hour") > now).select("asset", "next_start")


@query("b19_retire_masks", """select b.asset, b.ts, b.blocked or b.ts >= r.at as blocked from blk b join (select user_id as asset, max(ts) - interval 3 days as at
  from events where user_id % 5 = 0 group by 1 union all select distinct user_id, timestamp '9999-01-01' from events where user_id % 5 <> 0) r using (asset)""")
def b19(spark, sf):
    gone = S.table(spark, sf, "events").filter("user_id % 5 = 0").groupBy(F.col("user_id").alias("asset")).agg((F.max("ts") - F.expr("interval 3 days")).alias("at"))
    return blackout(spark, sf).join(gone, "asset", "left").select(
        "asset", "ts", (F.col("blocked") | F.coalesce(F.col("ts") >= F.col("at"), F.lit(False))).alias("blocked"))


@query("b20_align_to_calendar", """select g.asset, g.ts, round(b.close, 6) as close from (select f.asset, c.ts from (select asset, min(ts) as a from bars_w group by 1) f
  join cal_w c on c.ts >= f.a) g asof join bars_w b on b.asset = g.asset and b.ts <= g.ts""")
def b20(spark, sf):
    bars = S.weekly_bars(spark, sf)
    return B.align_to_calendar(bars, bars.select("ts").distinct()).select("asset", "ts", *r6("close"))


@query("b21_session_table", "select * from sess_e")
def b21(spark, sf):
    return sess_e(spark, sf)


@query("b22_append_forming_bar", f"""select asset, ts, {R_OHLC}, volume from bars_w union all
  select asset, date '2030-01-07', {', '.join('round(last(close order by ts), 6)' for _ in OHLC)}, 0 from bars_w group by 1""")
def b22(spark, sf):
    bars = S.weekly_bars(spark, sf)
    return bars.unionByName(B.forming_bar(bars, F.lit("2030-01-07").cast("date"))).select("asset", "ts", *r6(*OHLC), "volume")
