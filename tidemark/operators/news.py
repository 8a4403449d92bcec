"""News, text and message counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import next_at_or_after
from ..functions.windows import bars_ago, over, own, rolling
from .pit import news_day

# The finance word lists of the headline score.
POSITIVE = """beat beats surge surges soar soars jump jumps rally rallies gain gains record upgrade upgraded
upgrades bullish outperform strong stronger growth boost boosts rise rises rising higher approval approved
wins win profit profitable exceed exceeds exceeded raise raises raised buy breakout expands expansion
optimistic tops top rebound rebounds recovery inflows partnership launch launches accelerate""".split()
NEGATIVE = """miss misses plunge plunges drop drops fall falls falling sink sinks slump slumps tumble tumbles
crash crashes downgrade downgraded downgrades bearish underperform weak weaker loss losses lawsuit probe
investigation recall recalls cut cuts cutting lower decline declines warning warns fraud risk risks selloff
sell-off outflows ban bans delay delays halt halts fine fined layoffs slowdown fear fears concern concerns
default hack hacked exploit liquidation liquidations""".split()


def headline_score(text: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """(positive - negative) / (positive + negative) word hits, 0 without hits. Whole text, in the JVM."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z\-]+)"), F.lit(1))
    hits = F.transform(F.filter(words, lambda w: w.isin(*positive, *negative)), lambda w: F.when(w.isin(*positive), 1).otherwise(-1))
    return F.when(F.size(hits) > 0, F.aggregate(hits, F.lit(0), lambda a, x: a + x) / F.size(hits)).otherwise(0.0)


def news_tally(articles: DataFrame, score: Column, kept: DataFrame, focus: int = 3) -> DataFrame:
    """Per day and symbol: focused articles (at most `focus` tags) counted with their tone, the others as `wide`.

    An article that arrives twice counts once; its text is dropped before it is shuffled.
    """
    slim = articles.select("id", news_day(F.col("created_at")).alias("day"), "symbols", score.alias("score"))
    one = slim.groupBy("id").agg(F.min(F.struct("day", "symbols", "score")).alias("a")).select("a.*")
    one = one.select("day", "score", (F.size("symbols") <= focus).alias("focused"), F.explode("symbols").alias("symbol"))
    one = one.withColumn("symbol", F.translate("symbol", ".", "-")).join(kept, "symbol", "left_semi")
    f = F.col("focused")
    return one.groupBy("day", "symbol").agg(
        F.sum(f.cast("long")).alias("n"), F.sum((f & (F.col("score") > 0)).cast("long")).alias("pos"),
        F.sum((f & (F.col("score") < 0)).cast("long")).alias("neg"), F.sum(F.when(f, F.col("score")).otherwise(0.0)).alias("score"),
        F.sum((~f).cast("long")).alias("wide"))


def news_features(daily: DataFrame, bar_days: DataFrame, tone: tuple[int, int, int, int] = (7, 4, 180, 60),
                  attention: tuple[int, int, int, int] = (3, 2, 90, 30)) -> DataFrame:
    """Tone and attention z-scores of each key's daily series, made dense over its days and usable the day after.

    `daily(asset, day, articles, tone)`, `bar_days(asset, day, ...)`. Short means count to 12 places and a deviation of
    zero to nine places is none: whether a flat series has a score must not depend on the order of sums.
    """
    span = daily.groupBy("asset").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    dense = span.select("asset", F.explode(F.sequence("a", "b")).alias("day")).join(daily, ["asset", "day"], "left")
    def mean(c, n, least):
        return rolling(F.avg, c, n, least, order="day")
    df = dense.withColumns({"_t": F.when(F.col("articles") > 0, F.col("tone")), "_v": F.log1p(F.coalesce("articles", F.lit(0)).cast("double"))})
    df = df.withColumns({"_t": F.round(mean("_t", *tone[:2]), 12), "_v": F.round(mean("_v", *attention[:2]), 12)})
    def z(c, n, least):
        return (F.col(c) - mean(c, n, least)) / F.nullif(F.round(rolling(F.stddev_samp, c, n, least, order="day"), 9), F.lit(0.0))
    df = df.withColumns({"_tz": z("_t", *tone[2:]), "_az": z("_v", *attention[2:])})
    df = df.select("asset", "day", bars_ago("_tz", 1, order="day").alias("tone_z"), bars_ago("_az", 1, order="day").alias("attention_z"))
    return bar_days.join(df, ["asset", "day"], "left")


def bar_news_features(articles: DataFrame, bars: DataFrame, history_days: int = 30, least: int = 100) -> DataFrame:
    """Per hourly bar, from articles published before its end: last hour, z-score of the last 24 hours, mean tone of them.

    Articles are first summed per asset and hour, so windows never hold more than an asset's hours.
    """
    hour = lambda c: F.unix_seconds(F.date_trunc("hour", c)) / 3600
    hourly = articles.groupBy("asset", hour("created_at").cast("long").alias("h")).agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    grid = bars.select("asset", "ts", hour("ts").cast("long").alias("h"))
    df = hourly.join(grid, ["asset", "h"], "full_outer")
    order = Window.partitionBy("asset").orderBy("h")
    day = order.rangeBetween(-23, 0)
    df = df.withColumns({"news_1h": F.coalesce("n", F.lit(0)), "_n": F.coalesce(F.sum("n").over(day), F.lit(0)), "_s": F.coalesce(F.sum("s").over(day), F.lit(0.0))})
    df = df.filter("ts is not null").withColumn("_l", F.log1p(F.col("_n").cast("double")))
    past = order.rangeBetween(-(history_days * 24 - 1), 0)
    z = (F.col("_l") - over(F.avg, "_l", past, least)) / F.nullif(over(F.stddev_samp, "_l", past, least), F.lit(0.0))
    return df.select("asset", "ts", "news_1h", z.alias("news_24h_z"), F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(0.0).alias("news_tone"))


def news_on_sessions(tally: DataFrame, bars: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Daily tallies on each asset's sessions: other days move to the next session, days after the last bar are dropped."""
    moved = next_at_or_after(tally, bars.select("asset", F.col("ts").alias("_s")), ["asset"], "day", "_s", "ts").filter("ts is not null")
    laid = moved.groupBy("asset", "ts").agg(*[F.sum(c).alias(c) for c in sums])
    return bars.select("asset", "ts").join(laid, ["asset", "ts"], "left").na.fill(0, list(sums))


def missing_months(loaded: DataFrame, first: Column, last: Column) -> DataFrame:
    """Months between two days that are not loaded."""
    months = loaded.agg(F.trunc(first, "month").alias("a"), F.trunc(last, "month").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return months.exceptAll(loaded.select("month").distinct())


def news_moves(bars: DataFrame, news: DataFrame, n: int, least: int, cover: int) -> DataFrame:
    """Bars with their move in usual moves, their news and whether the asset was covered in the `cover` bars before."""
    df = bars.withColumn("_ret", F.col("close") / bars_ago("close", 1) - 1)
    df = df.withColumn("move", F.col("_ret") / F.nullif(rolling(F.stddev_samp, "_ret", n, least, shift=1), F.lit(0.0)))
    df = df.join(news, ["asset", "ts"])
    return df.withColumn("covered", F.coalesce(F.sum("n").over(own().rowsBetween(-cover, -1)), F.lit(0)) > 0)


def quiet_drop(df: DataFrame, drop: float, quiet: int) -> DataFrame:
    silent = F.sum("n").over(own().rowsBetween(-(quiet - 1), 0)) == 0
    return df.withColumn("_silent", silent).filter((F.col("move") <= -drop) & F.col("_silent") & F.col("covered")).select("asset", "ts", F.lit(1).alias("side"))


def loud_day(df: DataFrame, size: float, articles: int, good: bool) -> DataFrame:
    tone = F.col("pos") > F.col("neg") if good else F.col("neg") > F.col("pos")
    move = F.col("move") >= size if good else F.col("move") <= -size
    return df.filter(move & (F.col("n") >= articles) & tone & F.col("covered")).select("asset", "ts", F.lit(1).alias("side"))


def hourly_counts(messages: DataFrame) -> DataFrame:
    """Messages, bullish and bearish ones per hour; `messages(id, created_at, mood)`, copies of an id count once."""
    one = messages.groupBy("id").agg(F.min(F.struct("created_at", "mood")).alias("m")).select("m.*")
    return one.groupBy(F.date_trunc("hour", "created_at").alias("hour")).agg(
        F.count("*").alias("messages"), F.count(F.when(F.col("mood") == "Bullish", 1)).alias("bullish"), F.count(F.when(F.col("mood") == "Bearish", 1)).alias("bearish"))


def add_counts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Additive merge of hourly counts."""
    names = ["messages", "bullish", "bearish"]
    return stored.unionByName(new).groupBy("hour").agg(*[F.sum(c).alias(c) for c in names])


def upcoming_events(calendars: DataFrame, today: Column, days: int = 7) -> DataFrame:
    return calendars.filter(F.col("day").between(today, F.date_add(today, days)))


def calendar_changes(old: DataFrame, new: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(merged calendar, names whose next event moved): past dates stay, future ones follow the download."""
    merged = old.filter(F.col("day") < today).unionByName(new.filter(F.col("day") >= today)).distinct()
    nxt = lambda df, c: df.filter(F.col("day") >= today).groupBy("name").agg(F.min("day").alias(c))
    moved = nxt(old, "was").join(nxt(merged, "now"), "name", "full_outer").filter(~F.col("was").eqNullSafe(F.col("now")))
    return merged, moved


def score_views(views: DataFrame, bars: DataFrame) -> DataFrame:
    """Due views: signed move in ATRs from the first bar after the view to `horizon` bars later; bars carry `atr`.

    `views(asset, day, bias, confidence, horizon)`.
    """
    numbered = bars.select("asset", "ts", "close", "atr", F.row_number().over(own()).alias("_bn"))
    v = next_at_or_after(views.filter("bias <> 0"), numbered.select("asset", F.col("ts").alias("_s")), ["asset"], "day", "_s", "ts", strict=True).filter("ts is not null")
    start = v.join(numbered, ["asset", "ts"])
    end = numbered.select("asset", (F.col("_bn")).alias("_to"), F.col("close").alias("_end"))
    df = start.withColumn("_to", F.col("_bn") + F.col("horizon")).join(end, ["asset", "_to"])
    move = (F.col("_end") - F.col("close")) / F.col("atr")
    return df.filter("atr > 0").select("asset", "day", "bias", "confidence", move.alias("move"), (F.signum("bias") * move).alias("score"), (F.signum("bias") * move > 0).alias("hit"))


def track_record(scored: DataFrame) -> DataFrame:
    """Hit rate and mean score, over all and by asset, and of the confident views."""
    sure = F.col("confidence") >= 0.6
    return scored.rollup("asset").agg(
        F.count("*").alias("views"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("score").alias("mean_score"),
        F.count(F.when(sure, 1)).alias("sure_views"), F.avg(F.when(sure, F.col("hit").cast("double"))).alias("sure_hit_rate"))


def bias_pivot(views: DataFrame, assets: list) -> DataFrame:
    """Last bias per date, one column per asset of a short given list."""
    return views.groupBy("day").pivot("asset", assets).agg(F.max_by("bias", "seq"))
