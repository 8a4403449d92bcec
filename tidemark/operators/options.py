"""Option-market operators on flat chains: (underlying, contract, type C/P, strike, dte, iv, delta, bid, ask, volume)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the standard contract symbol, root + YYMMDD + C/P + strike in thousandths.
OCC = r"^([A-Z]+)(\d{6})([CP])(\d{8})$"


def parse_occ(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    part = lambda i: F.nullif(F.regexp_extract(symbol, OCC, i), F.lit(""))
    return df.withColumns({"root": part(1), "expiry": F.to_date(part(2), "yyMMdd"), "type": part(3), "strike": part(4).cast("double") / 1000})


def nearest_strike(chain: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group the strike nearest `spot`, the first contract on ties."""
    return chain.groupBy(*by).agg(F.min_by("strike", F.struct(F.abs(F.col("strike") - F.col("spot")), "contract")).alias("_atm"))


def atm_iv(chain: DataFrame) -> DataFrame:
    """Per expiry the mean implied volatility at the strike nearest the price."""
    good = chain.filter("iv > 0")
    at = nearest_strike(good, ["underlying", "dte"])
    return good.join(at, ["underlying", "dte"]).filter("strike = _atm").groupBy("underlying", "dte").agg(F.avg("iv").alias("iv"))


def iv_at_tenor(points: DataFrame, tenors: Sequence[int]) -> DataFrame:
    """Volatility at fixed tenors, linear in total variance between the two nearest expiries, flat outside."""
    df = points.filter("dte > 0 and iv is not null").withColumn("tenor", F.explode(F.array(*[F.lit(t) for t in tenors])))
    below, above = F.col("dte") <= F.col("tenor"), F.col("dte") >= F.col("tenor")
    pick = lambda agg, side: agg(F.when(side, F.struct("dte", "iv")))
    df = df.groupBy("underlying", "tenor").agg(pick(F.max, below).alias("lo"), pick(F.min, above).alias("hi"))
    w0, w1 = F.col("lo.iv") * F.col("lo.iv") * F.col("lo.dte"), F.col("hi.iv") * F.col("hi.iv") * F.col("hi.dte")
    t = F.col("tenor")
    blend = F.sqrt((w0 + (w1 - w0) * (t - F.col("lo.dte")) / (F.col("hi.dte") - F.col("lo.dte"))) / t)
    value = F.when(F.col("lo").isNull(), F.col("hi.iv")).when(F.col("hi").isNull() | (F.col("lo.dte") == F.col("hi.dte")), F.col("lo.iv")).otherwise(blend)
    return df.select("underlying", "tenor", value.alias("iv"))


def mid_price() -> Column:
    quoted = (F.col("bid") > 0) & (F.col("ask") >= F.col("bid"))
    return F.when(quoted, (F.col("bid") + F.col("ask")) / 2).otherwise(F.when(F.col("last") > 0, F.col("last")))


def straddle_move(chain: DataFrame, target: int = 30) -> DataFrame:
    """At-the-money call plus put of the expiry nearest `target` days over the price; both legs, nothing else, needed."""
    near = chain.groupBy("underlying").agg(F.min(F.struct(F.abs(F.col("dte") - target), "dte")).getField("dte").alias("dte"))
    e = chain.join(near, ["underlying", "dte"])
    legs = e.join(nearest_strike(e, ["underlying"]), "underlying").filter("strike = _atm").withColumn("_mid", mid_price())
    return legs.groupBy("underlying").agg(F.when((F.count("*") == 2) & (F.count("_mid") == 2), F.sum("_mid") / F.max("spot")).alias("move"))


def skew25(chain: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Volatility of the put nearest -0.25 delta minus that of the call nearest 0.25."""
    g = chain.filter("delta is not null and iv is not null")

    def nearest(kind, target):
        far = F.abs(F.col("delta") - target)
        return F.min(F.when(F.col("type") == kind, F.struct(far.alias("far"), F.col("contract"), F.col("iv").alias("iv"))))

    df = g.groupBy("underlying").agg(nearest("P", -0.25).alias("p"), nearest("C", 0.25).alias("c"))
    return df.select("underlying", F.when((F.col("p.far") < tolerance) & (F.col("c.far") < tolerance), F.col("p.iv") - F.col("c.iv")).alias("skew"))


def put_call_volume(chain: DataFrame) -> DataFrame:
    side = lambda k: F.sum(F.when(F.col("type") == k, F.col("volume")).otherwise(0.0))
    return chain.groupBy("underlying").agg(F.sum("volume").alias("volume"), (side("P") / F.when(side("C") > 0, side("C"))).alias("pc_volume"))


def tradable(chain: DataFrame, max_spread: float = 0.15) -> DataFrame:
    return chain.filter((F.col("bid") > 0) & (F.col("ask") > 0) & F.col("delta").isNotNull() & ((F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) <= max_spread))


LEG = ["contract", "dte", "strike", "bid", "ask", "delta"]


def leg_select(chain: DataFrame, target: float) -> DataFrame:
    """The tradable contract nearest a target delta, the first on ties."""
    far = F.abs(F.col("delta") - target)
    best = tradable(chain).groupBy("underlying").agg(F.min(F.struct(far.alias("far"), *LEG)).alias("l"))
    return best.select("underlying", "l.*")


def vertical_design(chain: DataFrame, kind: str, short_delta: float, long_delta: float, equity: float, risk: float, tolerance: float = 0.12,
                    min_credit: float = 0.15, fit_width: bool = False) -> DataFrame:
    """A credit spread: short leg by delta, long leg further out on the same expiry, credit at least a share of the width."""
    c = tradable(chain.filter(F.col("type") == kind))
    short = leg_select(c, short_delta).filter(F.col("far") <= tolerance).select("underlying", "dte", F.struct(*[x for x in LEG if x != "dte"]).alias("s"))
    beyond = F.col("strike") < F.col("s.strike") if kind == "P" else F.col("strike") > F.col("s.strike")
    longs = c.join(short, ["underlying", "dte"]).filter(beyond)
    if fit_width:
        longs = longs.filter((F.abs(F.col("s.strike") - F.col("strike")) - (F.col("s.bid") - F.col("ask"))) * 100 <= risk * equity)
    best = longs.groupBy("underlying", "dte", "s").agg(F.min(F.struct(F.abs(F.col("delta") - long_delta), "contract", "strike", "ask")).alias("l"))
    credit, width = F.col("s.bid") - F.col("l.ask"), F.abs(F.col("s.strike") - F.col("l.strike"))
    df = best.withColumns({"credit": credit, "width": width}).filter(F.col("credit") >= min_credit * F.col("width"))
    df = df.withColumn("loss", (F.col("width") - F.col("credit")) * 100).withColumn("n", F.floor(risk * equity / F.when(F.col("loss") > 0, F.col("loss"))))
    return df.filter("n >= 1").select("underlying", "dte", F.col("s.contract").alias("short_leg"), F.col("l.contract").alias("long_leg"), "credit", "width", "loss", "n")


def exit_rules(positions: DataFrame, exit_dte: int = 21, max_days: int = 20, take: float = 0.5) -> DataFrame:
    """First matching reason to close: `positions(id, dte, timetable, bias, source_open, trend, days_held, legs, close_cost, cost)`."""
    why = (F.when(F.col("dte") <= exit_dte, "expiry near").when(F.col("timetable"), F.lit(None))
           .when((F.col("bias") > 0) & ~F.col("source_open"), "source closed")
           .when((F.col("bias") < 0) & (F.col("trend") > 0), "trend turned up").when((F.col("bias") < 0) & (F.col("days_held") >= max_days), "held long enough")
           .when((F.col("legs") == 2) & (F.col("close_cost") <= -take * F.col("cost")), "half the credit earned"))
    return positions.withColumn("why", why).filter("why is not null").select("id", "why")


def close_cost(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Cash needed to close each position: short legs at the ask, long ones at the bid; null when any quote is missing.

    `positions(id, legs array<struct<symbol, qty>>)`, `quotes(symbol, bid, ask)`.
    """
    legs = positions.select("id", F.explode("legs").alias("leg")).select("id", "leg.symbol", "leg.qty")
    px = F.when(F.col("qty") < 0, F.col("ask")).otherwise(F.col("bid"))
    df = legs.join(quotes, "symbol", "left").withColumn("_px", F.when(px > 0, px))
    return df.groupBy("id").agg(F.when(F.count("_px") == F.count("*"), F.sum(-F.col("qty") * F.col("_px") * 100)).alias("cost"))


def reconcile(book: DataFrame, positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Book and broker contracts per symbol side by side with the flags of what does not agree."""
    want = book.groupBy("symbol").agg(F.sum("qty").alias("want"))
    df = want.join(positions, "symbol", "full_outer").join(quotes, "symbol", "left").na.fill(0, ["want", "qty", "market_value"])
    mid = F.when((F.col("bid") > 0) & (F.col("ask") > 0), F.col("qty") * (F.col("bid") + F.col("ask")) / 2 * 100)
    df = df.withColumn("mid_value", mid)
    quote = F.when(F.col("mid_value").isNull() & (F.col("qty") != 0), "no quote").when(
        F.abs(F.col("market_value") - F.col("mid_value")) > F.greatest(F.lit(100.0), 0.2 * F.abs("mid_value")), "value off mid")
    flags = F.concat_ws(",", F.when(F.col("qty") != F.col("want"), "quantity"), quote)
    return df.select("symbol", "want", "qty", "market_value", "mid_value", flags.alias("flags"))


def playbook_score(positions: DataFrame) -> DataFrame:
    closed = F.col("closed")
    return positions.groupBy("playbook").agg(
        F.count(F.when(~closed, 1)).alias("open"), F.count(F.when(closed, 1)).alias("closed"), F.sum(F.when(closed, F.col("pnl")).otherwise(0.0)).alias("realised"),
        F.sum(F.when(~closed, F.col("pnl")).otherwise(0.0)).alias("unrealised"), F.count(F.when(closed & (F.col("pnl") > 0), 1)).alias("wins"))


def entry_quota(signals: DataFrame, held: DataFrame, most: int = 3) -> DataFrame:
    """Fresh signals in name order up to the room each playbook has left, none on an underlying it already holds.

    The room is at most `most`, so the first `most` names per playbook decide; they are found by a bounded aggregate.
    """
    free = signals.join(held.select("playbook", "underlying"), ["playbook", "underlying"], "left_anti").select("playbook", "underlying").distinct()
    room = held.groupBy("playbook").agg(F.count("*").alias("_held"))
    names = None
    left = free
    for k in range(most):
        nth = left.groupBy("playbook").agg(F.min("underlying").alias("underlying"))
        step = nth.withColumn("_k", F.lit(k + 1))
        names = step if names is None else names.unionByName(step)
        left = left.join(nth, ["playbook", "underlying"], "left_anti")
    return names.join(room, "playbook", "left").filter(F.col("_k") <= most - F.coalesce("_held", F.lit(0))).select("playbook", "underlying")
