"""Plans, positions and their reconciliation, as joins by symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import sum_before


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def live_plan(plan: DataFrame, ranges: DataFrame) -> DataFrame:
    """Plan rows whose stop and target the price range `(symbol, lo, hi)` has not reached; unknown prices keep a row."""
    df = plan.join(ranges, "symbol", "left")
    long = F.col("qty") > 0
    stop = F.when(long, F.col("lo") <= F.col("stop")).otherwise(F.col("hi") >= F.col("stop"))
    target = F.when(long, F.col("hi") >= F.col("target")).otherwise(F.col("lo") <= F.col("target"))
    return df.filter(~(F.coalesce(stop, F.lit(False)) | F.coalesce(target, F.lit(False)))).select(*plan.columns)


def wanted_positions(plan: DataFrame, ranges: DataFrame) -> DataFrame:
    return live_plan(plan, ranges).groupBy("symbol").agg(F.sum("qty").alias("want"))


def allowed(want: Column) -> Column:
    """What may be held: round-the-clock symbols never short, other shorts in whole shares."""
    return F.when(F.col("crypto") & (want < 0), 0.0).when(~F.col("crypto") & (want < 0), -F.floor(-want).cast("double")).otherwise(want)


def too_small(diff: Column, target: Column, price: Column, least: float, share: float) -> Column:
    return F.abs(diff) * price <= F.greatest(F.lit(least), share * F.abs(target) * price)


def order_diff(want: DataFrame, have: DataFrame, quotes: DataFrame, min_notional: float = 5.0, adjust: float = 50.0, share: float = 0.02) -> DataFrame:
    """Orders that turn holdings into wanted positions; `quotes(symbol, price, crypto)`. Sales come first when sorted."""
    df = want.join(have, "symbol", "full_outer").join(quotes, "symbol", "left").withColumn("crypto", F.coalesce("crypto", F.lit(False)))
    df = df.withColumns({"_t": allowed(zero("want")), "_h": zero("have"), "_p": zero("price")}).withColumn("_d", F.col("_t") - F.col("_h"))
    keep = (F.col("_t") != 0) & (F.col("_h") * F.col("_t") > 0) & too_small(F.col("_d"), F.col("_t"), F.col("_p"), adjust, share)
    df = df.filter(~(F.abs("_d") * F.col("_p") < min_notional) & ~keep)
    size = F.when((F.col("_t") == 0) & F.col("have").isNotNull(), F.abs("_h")).when(F.col("crypto"), F.floor(F.abs("_d") * 1e9) / 1e9).otherwise(F.round(F.abs("_d"), 6))
    return df.select("symbol", F.when(F.col("_d") > 0, "buy").otherwise("sell").alias("side"), size.alias("qty"), F.when(F.col("crypto"), "gtc").otherwise("day").alias("tif"))


def protective_orders(plan: DataFrame, have: DataFrame, quotes: DataFrame, stop_room: float = 0.01, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Stops and targets for what is held: the held quantity is given to the plan's rows in order until it is used up.

    `plan(symbol, seq, qty, stop, target)`; a row takes what the rows before it, in the order of `order`, left. One symbol
    may hold a large share of the plan, so its rows are ordered in slices.
    """
    df = plan.join(have, "symbol").join(quotes, "symbol").filter(F.col("have") * F.col("qty") > 0)
    df = sum_before(df.withColumn("_size", F.abs("qty")), ["symbol"], order, "_size", "_used")
    df = df.withColumn("_q", F.least("_size", F.greatest(F.abs("have") - F.col("_used"), F.lit(0.0)))).filter("_q > 0 and stop is not null")
    through = (F.col("price") - F.col("stop")) * F.signum("have") <= 0
    whole = F.floor(F.col("_q") + 1e-9).cast("double")
    part = F.round(F.col("_q") - whole, 9)
    order = lambda kind, q, tif, limit=F.lit(None): F.struct(F.lit(kind).alias("type"), q.cast("double").alias("qty"), F.lit(tif).alias("tif"), limit.cast("double").alias("limit_price"))
    orders = F.when(through, F.array(F.struct(F.lit("market").alias("type"), F.round("_q", 9).alias("qty"), F.when(F.col("crypto"), "gtc").otherwise("day").alias("tif"), F.lit(None).cast("double").alias("limit_price")))).when(
        F.col("crypto"), F.array(order("stop_limit", F.floor(F.col("_q") * 1e9) / 1e9, "gtc", F.col("stop") * (1 - stop_room)))).otherwise(F.filter(F.array(
            F.when((whole >= 1) & F.col("target").isNotNull(), order("oco", whole, "gtc", F.col("target"))).when(whole >= 1, order("stop", whole, "gtc")),
            F.when(part >= 1e-4, order("stop", part, "day"))), lambda o: o.isNotNull()))
    side = F.when(F.col("have") > 0, "sell").otherwise("buy")
    return df.select("symbol", "seq", side.alias("side"), "stop", F.explode(orders).alias("o")).select("symbol", "seq", "side", "o.type", "o.qty", F.col("stop").alias("stop_price"), "o.limit_price", "o.tif")


def order_changes(wanted: DataFrame, open_: DataFrame) -> DataFrame:
    """Orders only one side has, as multisets; empty when the open orders are the wanted ones."""
    return wanted.exceptAll(open_).withColumn("only", F.lit("wanted")).unionByName(open_.exceptAll(wanted).withColumn("only", F.lit("open")))


def split_orders(orders: DataFrame, have: DataFrame, quotes: DataFrame, pending: DataFrame) -> DataFrame:
    """What goes now and what waits: buys that open or add to a long position, and plain stops against a pending order."""
    opposite = pending.select("symbol", F.when(F.col("side") == "buy", "sell").otherwise("buy").alias("side")).distinct().withColumn("_wash", F.lit(True))
    df = orders.join(have, "symbol", "left").join(quotes.select("symbol", "crypto"), "symbol", "left").join(opposite, ["symbol", "side"], "left")
    long_up = (F.col("type") == "market") & (F.col("side") == "buy") & ~F.coalesce("crypto", F.lit(False)) & (zero("have") >= 0)
    wash = (F.col("type") == "stop") & F.coalesce("_wash", F.lit(False))
    return df.select(*orders.columns, F.when(long_up, "after the open").when(wash, "wash trade").otherwise("now").alias("when"))


def verify_positions(want: DataFrame, have: DataFrame, pending: DataFrame, stops: DataFrame, quotes: DataFrame, adjust: float = 50.0, share: float = 0.02, min_notional: float = 5.0) -> DataFrame:
    """Per symbol: does the holding with its pending orders match the plan, and is it covered by stops?"""
    df = want.join(have, "symbol", "full_outer").join(pending, "symbol", "left").join(stops, "symbol", "left").join(quotes, "symbol", "left")
    df = df.withColumn("crypto", F.coalesce("crypto", F.lit(False))).withColumns({"_w": allowed(zero("want")), "_h": zero("have"), "_p": F.coalesce("price", F.lit(100.0))})
    total = F.col("_h") + zero("pending")
    gap = ~too_small(F.col("_w") - total, F.col("_w"), F.col("_p"), adjust, share)
    leaving = F.when(F.col("_h") != 0, F.greatest(F.lit(0.0), -F.signum("_h") * zero("pending"))).otherwise(0.0)
    covered, size = zero("stop_qty") + leaving, F.abs("_h")
    whole = (size - covered < 1) & (covered >= F.floor(size + 1e-9)) & (F.floor(size + 1e-9) > 0)
    dust = F.when(F.col("want").isNotNull(), 1.0).otherwise(min_notional)
    bare = (size * F.col("_p") >= dust) & (covered < 0.98 * size) & ~whole
    return df.select("symbol", F.col("_w").alias("want"), F.col("_h").alias("have"), covered.alias("covered"), gap.alias("mismatch"), bare.alias("uncovered")).filter("mismatch or uncovered")


def range_since(bars: DataFrame, starts: DataFrame, fills: DataFrame) -> DataFrame:
    """Low and high per symbol since its own last processed bar, widened by the stop levels that filled since.

    `starts(symbol, since)`, `fills(symbol, ts, level)`.
    """
    b = bars.join(starts, "symbol").filter("ts > since").select("symbol", F.col("low").alias("lo"), F.col("high").alias("hi"))
    f = fills.join(starts, "symbol").filter("ts > since").select("symbol", F.col("level").alias("lo"), F.col("level").alias("hi"))
    return b.unionByName(f).groupBy("symbol").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def group_risk(positions: DataFrame, cap_asset: float, cap_group: float) -> DataFrame:
    """Open risk rolled up by group and asset against its cap; `positions(grp, asset, qty, price, stop)`."""
    risk = F.sum(F.abs(F.col("qty") * (F.col("price") - F.col("stop"))))
    df = positions.rollup("grp", "asset").agg(risk.alias("risk"), F.grouping_id().alias("_g"))
    cap = F.when(F.col("_g") == 0, cap_asset).when(F.col("_g") == 1, cap_group)
    return df.select("grp", "asset", "risk", (F.col("risk") > cap).alias("over"))


def idle_cash_row(positions: DataFrame, equity: float, name: str, price: float) -> DataFrame:
    """The plan with one more row that puts the uninvested equity into the index."""
    left = positions.agg(F.greatest(F.lit(0.0), equity - F.sum(F.abs(F.col("qty")) * F.col("mark"))).alias("_c"))
    return positions.select(F.col("symbol").cast("string").alias("symbol"), "qty", "mark").unionByName(left.filter("_c > 0").select(F.lit(name).alias("symbol"), (F.col("_c") / price).alias("qty"), F.lit(price).alias("mark")))


def market_time_gates(moments: DataFrame, sessions: DataFrame, after_open: int, before_close: int) -> DataFrame:
    """Which orders may go at a moment: all inside the session, buys only some minutes after the open and before the close."""
    s = sessions.select("day", "open_utc", "close_utc")
    df = moments.join(s, F.col("ts").cast("date") == F.col("day"), "left")
    since = (F.unix_seconds("ts") - F.unix_seconds("open_utc")) / 60
    until = (F.unix_seconds("close_utc") - F.unix_seconds("ts")) / 60
    open_ = F.coalesce((since >= 0) & (until > 0), F.lit(False))
    return df.select(*moments.columns, F.when(~open_, "closed").when((since < after_open) | (until < before_close), "sales only").otherwise("all").alias("gate"))


def trade_notices(orders: DataFrame) -> DataFrame:
    """One message per market order."""
    return orders.filter("type = 'market'").select("symbol", F.format_string("%s %s x %s", F.initcap("side"), F.format_number("qty", 2), F.col("symbol").cast("string")).alias("message"))
