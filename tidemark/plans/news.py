"""I: news, text, social."""

from pyspark.sql import functions as F

from ..operators import combine as H
from ..operators import features as C
from ..operators import news as I
from ..sources import bindings as S
from .bars import NY, cal_d, jobs
from .catalog import cte, query
from .event_signals import BARS, releases
from .features import win

# Frequent words of the sample texts stand in for the finance lists, which hit almost nothing there.
GOOD, BAD = ["the", "and", "que", "die"], ["of", "to", "les", "und"]


def words_sql(text, words):
    return f"len(list_filter(regexp_extract_all(lower({text}), '[a-z\\-]+'), lambda w: w in ({', '.join(repr(w) for w in words)})))"


def score_sql(text):
    return f"coalesce(({words_sql(text, GOOD)} - {words_sql(text, BAD)}) / nullif({words_sql(text, GOOD)} + {words_sql(text, BAD)}, 0), 0)"


@query("i1_headline_score", f"""select 'document' as kind, doc_id as id, round({score_sql('text')}, 8) as score, round(coalesce(({words_sql('text', I.POSITIVE)} - {words_sql('text', I.NEGATIVE)})
  / nullif({words_sql('text', I.POSITIVE)} + {words_sql('text', I.NEGATIVE)}, 0), 0), 8) as finance from documents union all
  select 'turn', conv_id * 1000 + turn, round({score_sql('text')}, 8), 0 from conversations""")
def i1(spark, sf):
    s = I.headline_score(F.col("text"), GOOD, BAD)
    d = S.table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.round(s, 8).alias("score"), F.round(I.headline_score(F.col("text")), 8).alias("finance"))
    return d.unionByName(S.table(spark, sf, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.round(s, 8).alias("score"), F.lit(0.0).alias("finance")))


@query("i2_news_tally", f"""select day, symbol, cast(sum(cast(f as int)) as bigint) as n, cast(sum(case when f and s > 0 then 1 else 0 end) as bigint) as pos, cast(sum(case when f and s < 0 then 1 else 0 end) as bigint) as neg,
  round(sum(case when f then s else 0 end), 6) as score, cast(sum(cast(not f as int)) as bigint) as wide from (select day, s, len(symbols) <= 3 as f, replace(unnest(symbols), '.', '-') as symbol from (
  select cast(created_at {NY} + interval 8 hours as date) as day, symbols, {score_sql('text')} as s from (select doc_id as id, e.ts as created_at, text, case when n_chars > 2000 then [lang, source, upper(lang), 'BRK.B'] else [lang, source] end as symbols
  from documents join events e on doc_id = event_id))) where symbol in (select lang from documents union select 'BRK-B') group by 1, 2""")
def i2(spark, sf):
    a = S.articles(spark, sf)
    copies = a.unionByName(a)
    kept = S.table(spark, sf, "documents").select(F.col("lang").alias("symbol")).distinct().unionByName(spark.createDataFrame([("BRK-B",)], "symbol string"))
    df = I.news_tally(copies, I.headline_score(F.col("text"), GOOD, BAD), kept)
    return df.withColumn("score", F.round("score", 6))


cte("ud", "select user_id as asset, cast(ts as date) as day, count(*) as articles, avg(sqrt(value)) as tone from events group by 1, 2")


def full_d(agg, c, n, least):
    w = f"(partition by asset order by day rows between {n - 1} preceding and current row)"
    return f"case when count({c}) over {w} >= {least} then {agg}({c}) over {w} end"


cte("nf1", f"""select asset, day, round({full_d('avg', 't', 3, 2)}, 12) as t, round({full_d('avg', 'v', 3, 2)}, 12) as v from (select g.asset, g.day, case when u.articles > 0 then u.tone end as t, ln(1 + coalesce(u.articles, 0)) as v
  from (select asset, cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from ud group by asset) g left join ud u using (asset, day))""")
cte("nf2", f"select asset, day, (t - {full_d('avg', 't', 14, 5)}) / nullif(round({full_d('stddev_samp', 't', 14, 5)}, 9), 0) as tz, (v - {full_d('avg', 'v', 10, 5)}) / nullif(round({full_d('stddev_samp', 'v', 10, 5)}, 9), 0) as az from nf1")


@query("i3_news_features", """select b.asset, b.day, round(n.tone_z, 5) as tone_z, round(n.attention_z, 5) as attention_z from (select distinct user_id as asset, cast(ts as date) as day from events) b
  left join (select asset, day, lag(tz) over w as tone_z, lag(az) over w as attention_z from nf2 window w as (partition by asset order by day)) n using (asset, day)""")
def i3(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("user_id").alias("asset"), F.col("ts").cast("date").alias("day"), "value")
    daily = e.groupBy("asset", "day").agg(F.count("*").alias("articles"), F.avg(F.sqrt("value")).alias("tone"))
    df = I.news_features(daily, daily.select("asset", "day"), (3, 2, 14, 5), (3, 2, 10, 5))
    return df.select("asset", "day", F.round("tone_z", 5).alias("tone_z"), F.round("attention_z", 5).alias("attention_z"))


cte("bn1", """select b.asset, b.ts, (select count(*) from nev n where n.asset = b.asset and n.created_at >= b.ts and n.created_at < b.ts + interval 1 hour) as n1,
  (select count(*) from nev n where n.asset = b.asset and n.created_at >= b.ts - interval 23 hours and n.created_at < b.ts + interval 1 hour) as n24,
  (select sum(score) from nev n where n.asset = b.asset and n.created_at >= b.ts - interval 23 hours and n.created_at < b.ts + interval 1 hour) as s24 from bars_h b""")
cte("nev", "select user_id as asset, ts as created_at, (k - 50) / 50 as score from (select user_id, ts, cast(json_extract(props, '$.k') as int) as k from events where event_type <> 'error')")


@query("i4_bar_news_features", """select asset, ts, n1 as news_1h, round((l - case when count(*) over w >= 10 then avg(l) over w end) / nullif(case when count(*) over w >= 10 then stddev_samp(l) over w end, 0), 5) as news_24h_z,
  case when n24 > 0 then round(s24 / n24, 6) else 0 end as news_tone from (select *, ln(1 + n24) as l from bn1) window w as (partition by asset order by ts range between interval 719 hours preceding and current row)""")
def i4(spark, sf):
    k = F.from_json("props", "k int")["k"]
    news = S.table(spark, sf, "events").filter("event_type <> 'error'").select(F.col("user_id").alias("asset"), F.col("ts").alias("created_at"), ((k - 50) / 50).alias("score"))
    df = I.bar_news_features(news, S.hourly_bars(spark, sf), 30, 10)
    return df.select("asset", "ts", "news_1h", F.round("news_24h_z", 5).alias("news_24h_z"), F.round("news_tone", 6).alias("news_tone"))


cte("ftally", """select asset, filed as day, count(*) as n, count(*) filter (where code = 'P' and role = 'Officer') as pos, count(*) filter (where code = 'S') as neg from filings where title <> '' group by 1, 2""")
cte("ns_w", "select b.asset, b.ts, coalesce(n, 0) as n, coalesce(pos, 0) as pos, coalesce(neg, 0) as neg from bars_w b left join (select asset, ts, cast(sum(n) as bigint) as n, cast(sum(pos) as bigint) as pos, cast(sum(neg) as bigint) as neg from (select t.asset, t.day, t.n, t.pos, t.neg, min(b.ts) as ts from ftally t join bars_w b on b.asset = t.asset and b.ts >= t.day group by all) group by 1, 2) s using (asset, ts)")


def tally(spark, sf):
    f = S.filings(spark, sf).filter("title <> ''")
    return f.groupBy("asset", F.col("filed").alias("day")).agg(F.count("*").alias("n"), F.count(F.when((F.col("code") == "P") & (F.col("role") == "Officer"), 1)).alias("pos"), F.count(F.when(F.col("code") == "S", 1)).alias("neg"))


def on_sessions(spark, sf):
    return I.news_on_sessions(tally(spark, sf), BARS(spark, sf), ["n", "pos", "neg"])


@query("i5_news_on_sessions", "select * from ns_w")
def i5(spark, sf):
    return on_sessions(spark, sf)


@query("i6_news_completeness", """select cast(m as date) as month from (select unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)) + interval 2 months, interval 1 month)) as m from orders)
  except select cast(date_trunc('month', o_orderdate) as date) from orders where o_totalprice > 499000""")
def i6(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"), "o_totalprice")
    loaded = o.withColumn("month", F.trunc("d", "month"))
    span = I.missing_months(loaded.select("d", F.when(F.col("o_totalprice") > 499000, F.col("month")).alias("month")), F.min("d"), F.add_months(F.max("d"), 2))
    return span


cte("nm_w", f"""select r.*, n.n, n.pos, n.neg, coalesce(sum(n.n) over (partition by r.asset order by r.ts rows between 12 preceding and 1 preceding), 0) > 0 as covered,
  sum(n.n) over (partition by r.asset order by r.ts rows between 1 preceding and current row) = 0 as silent from (select *, ret / nullif(case when count(ret) over {win(26, 1)} >= 13 then stddev_samp(ret) over {win(26, 1)} end, 0) as mv from ret_w) r join ns_w n using (asset, ts)""")


def moves(spark, sf):
    return I.news_moves(BARS(spark, sf), on_sessions(spark, sf), 26, 13, 12)


@query("i7_news_quiet_drop", "select asset, ts, 1 as side from nm_w where mv <= -0.7 and silent and covered")
def i7(spark, sf):
    return I.quiet_drop(moves(spark, sf), 0.7, 2)


CALM_DAY = """not exists (select 1 from react_w r join own_w q on q.asset = r.asset and q.ts = r.ts join own_w o on o.asset = m.asset and o.ts = m.ts where r.asset = m.asset and o.bn - q.bn in (0, 1))"""


@query("i8_news_days", f"""select 'bad' as kind, asset, ts, 1 as side from nm_w m where mv <= -0.7 and n >= 1 and neg > pos and covered and {CALM_DAY}
  union all select 'good', asset, ts, 1 from nm_w m where mv >= 0.7 and n >= 1 and pos > neg and covered and {CALM_DAY}""")
def i8(spark, sf):
    m = moves(spark, sf)
    both = I.loud_day(m, 0.7, 1, False).select(F.lit("bad").alias("kind"), "asset", "ts", "side").unionByName(I.loud_day(m, 0.7, 1, True).select(F.lit("good").alias("kind"), "asset", "ts", "side"))
    return H.not_event_day(both, BARS(spark, sf), releases(spark, sf)).select("kind", "asset", "ts", "side")


def hc_sql(where):
    return f"select date_trunc('hour', ts) as hour, count(*) as messages, count(*) filter (where event_type = 'signup') as bullish, count(*) filter (where event_type = 'error') as bearish from events where {where} group by 1"


def messages(spark, sf):
    mood = F.when(F.col("event_type") == "signup", "Bullish").when(F.col("event_type") == "error", "Bearish")
    return S.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), mood.alias("mood"))


@query("i9_hourly_counts", hc_sql("true"))
def i9(spark, sf):
    m = messages(spark, sf)
    old, new = m.filter("created_at < timestamp'2024-01-15 12:30:00'"), m.filter("created_at >= timestamp'2024-01-15 12:30:00'")
    return I.add_counts(I.hourly_counts(old), I.hourly_counts(new.unionByName(new)))


cte("cals", "select 'jobs' as name, day from jobs union all select distinct 'earnings', cast(accepted as date) from earn union all select distinct 'month', cast(date_trunc('month', ts) as date) from cal_d")


def calendars(spark, sf):
    e = S.earnings(spark, sf).select(F.lit("earnings").alias("name"), F.col("accepted").cast("date").alias("day")).distinct()
    m = cal_d(spark, sf).select(F.lit("month").alias("name"), F.trunc("ts", "month").alias("day")).distinct()
    return jobs(spark, sf).select(F.lit("jobs").alias("name"), "day").unionByName(e).unionByName(m)


@query("i10_upcoming_events", "select name, day from cals where day between date '1999-09-28' and date '1999-10-05'")
def i10(spark, sf):
    return I.upcoming_events(calendars(spark, sf), F.lit("1999-09-28").cast("date")).select("name", "day")


TODAY = "date '2000-03-01'"


@query("i11_calendar_changes", f"""select coalesce(o.name, n.name) as name, o.d as was, n.d as now from (select asset as name, min(cast(accepted as date)) as d from earn where cast(accepted as date) >= {TODAY} group by 1) o
  full join (select asset as name, min(cast(accepted as date) + cast(case when asset % 3 = 0 then 2 else 0 end as int)) as d from earn where cast(accepted as date) + cast(case when asset % 3 = 0 then 2 else 0 end as int) >= {TODAY} group by 1) n on o.name = n.name where o.d is distinct from n.d""")
def i11(spark, sf):
    e = S.earnings(spark, sf).select(F.col("asset").alias("name"), F.col("accepted").cast("date").alias("day"))
    new = e.select("name", F.when(F.col("name") % 3 == 0, F.date_add("day", 2)).otherwise(F.col("day")).alias("day"))
    return I.calendar_changes(e, new, F.lit("2000-03-01").cast("date"))[1].select("name", "was", "now")


cte("vw", "select s.asset, s.ts as day, s.side * (1 + s.asset % 2) as bias, (s.asset % 10) / 10 as confidence, 1 + s.asset % 8 as horizon from e16_w s")
cte("scored", "select v.asset, v.day, v.bias, v.confidence, (z.close - a.close) / a.atr as move, sign(v.bias) * (z.close - a.close) / a.atr as score from (select v.*, (select min(b.bn) from atr_w b where b.asset = v.asset and b.ts > v.day) as p from vw v) v join atr_w a on a.asset = v.asset and a.bn = v.p join atr_w z on z.asset = v.asset and z.bn = v.p + v.horizon where a.atr > 0")


def scored(spark, sf):
    from .asset_signals import sweeps
    v = sweeps(spark, sf).select("asset", F.col("ts").alias("day"), (F.col("side") * (1 + F.col("asset") % 2)).alias("bias"), ((F.col("asset") % 10) / 10).alias("confidence"), (1 + F.col("asset") % 8).alias("horizon"))
    return I.score_views(v, C.with_atr(BARS(spark, sf)))


@query("i12_score_views", "select asset, day, bias, round(move, 6) as move, round(score, 6) as score, score > 0 as hit from scored")
def i12(spark, sf):
    return scored(spark, sf).select("asset", "day", "bias", F.round("move", 6).alias("move"), F.round("score", 6).alias("score"), "hit")


@query("i13_track_record", """select asset, count(*) as views, round(avg(cast(score > 0 as int)), 6) as hit_rate, round(avg(score), 6) as mean_score, count(*) filter (where confidence >= 0.6) as sure_views,
  round(avg(cast(score > 0 as int)) filter (where confidence >= 0.6), 6) as sure_hit_rate from scored group by rollup (asset)""")
def i13(spark, sf):
    return I.track_record(scored(spark, sf)).select("asset", "views", F.round("hit_rate", 6).alias("hit_rate"), F.round("mean_score", 6).alias("mean_score"), "sure_views", F.round("sure_hit_rate", 6).alias("sure_hit_rate"))


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("i14_bias_pivot", "select cast(ts as date) as day, " + ", ".join(f"last(cast(floor(value) as int) % 5 - 2 order by ts, event_id) filter (where event_type = '{k}') as \"{k}\"" for k in KINDS) + " from events group by 1")
def i14(spark, sf):
    v = S.table(spark, sf, "events").select(F.col("ts").cast("date").alias("day"), F.col("event_type").alias("asset"), (F.floor("value") % 5 - 2).cast("int").alias("bias"), F.struct("ts", "event_id").alias("seq"))
    return I.bias_pivot(v, KINDS)


