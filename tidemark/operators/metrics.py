"""Performance metrics. Curves are `(account, ts, equity)`; an account's curve is bounded by the calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import own


def curve(order: str = "ts"):
    return Window.partitionBy("account").orderBy(order)


def with_returns(equity: DataFrame) -> DataFrame:
    return equity.withColumn("ret", F.col("equity") / F.lag("equity").over(curve()) - 1)


def equity_stats(equity: DataFrame, ppy: int) -> DataFrame:
    """Total return, CAGR, volatility, Sharpe, Sortino, maximum drawdown and Calmar per account."""
    df = with_returns(equity).withColumn("_dd", F.col("equity") / F.max("equity").over(curve().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    r, down = F.col("ret"), F.when(F.col("ret") < 0, F.col("ret"))
    root = ppy ** 0.5
    df = df.groupBy("account").agg(
        F.max_by("equity", "ts").alias("final_equity"), (F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1).alias("total_return"), F.count(r).alias("_n"),
        (F.stddev_samp(r) * root).alias("volatility"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"), (F.stddev_samp(down) * root).alias("_d"), F.min("_dd").alias("max_drawdown"))
    years = F.col("_n") / ppy
    cagr = F.when((years > 0) & (F.col("total_return") > -1), F.pow(1 + F.col("total_return"), 1 / years) - 1)
    df = df.withColumns({"cagr": cagr, "sharpe": F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * root), "sortino": F.when(F.col("_d") > 0, F.col("_m") * ppy / F.col("_d"))})
    return df.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown"))).drop("_n", "_m", "_s", "_d")


def trade_stats(trades: DataFrame, by: Sequence[str] = ("account",)) -> DataFrame:
    """Counts, win share, mean R, profit factor (infinite without losses) and fees; `trades(pnl, side, r, fees)`."""
    won, lost = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") <= 0, F.col("pnl")).otherwise(0.0))
    return trades.groupBy(*by).agg(
        F.count("*").alias("trades"), F.count(F.when(F.col("side") < 0, 1)).alias("shorts"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("r").alias("avg_r"),
        F.when(lost < 0, won / -lost).otherwise(F.lit(float("inf"))).alias("profit_factor"), F.sum("fees").alias("fees"))


def alpha_beta(returns: DataFrame, ppy: int, least: int = 20) -> DataFrame:
    """Annual alpha, beta and information ratio per account from paired returns `(account, ret, bench)`."""
    both = returns.filter("ret is not null and bench is not null").withColumn("_a", F.col("ret") - F.col("bench"))
    df = both.groupBy("account").agg(F.count("*").alias("_n"), F.covar_samp("ret", "bench").alias("_c"), F.var_samp("bench").alias("_v"), F.avg("ret").alias("_mr"), F.avg("bench").alias("_mb"), F.avg("_a").alias("_ma"), F.stddev_samp("_a").alias("_sa"))
    ok = (F.col("_n") >= least) & (F.col("_v") > 0)
    df = df.withColumn("beta", F.when(ok, F.col("_c") / F.col("_v")))
    return df.select("account", ((F.col("_mr") - F.col("beta") * F.col("_mb")) * ppy).alias("alpha"), "beta", F.when(ok & (F.col("_sa") > 0), F.col("_ma") / F.col("_sa") * ppy ** 0.5).alias("info_ratio"))


def buy_and_hold(bars: DataFrame, capital: float, slippage: float) -> DataFrame:
    first = bars.groupBy("asset").agg(F.min_by("open", "ts").alias("_o"))
    return bars.join(first, "asset").select(F.col("asset").alias("account"), "ts", (capital * F.col("close") / (F.col("_o") * (1 + slippage))).alias("equity"))


def compounded(returns: DataFrame, value: str, capital: float, by: Sequence[str] = ()) -> DataFrame:
    """Equity from one return per session (and key)."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("equity", capital * F.exp(F.sum(F.log1p(F.coalesce(value, F.lit(0.0)))).over(w)))


def equal_weight(bars: DataFrame, capital: float) -> DataFrame:
    r = bars.withColumn("_r", F.col("close") / F.lag("close").over(own()) - 1)
    return compounded(r.groupBy("ts").agg(F.avg("_r").alias("_m")), "_m", capital).select("ts", "equity")


def daily_last(equity: DataFrame) -> DataFrame:
    return equity.groupBy("account", F.col("ts").cast("date").alias("ts")).agg(F.max_by("equity", "ts").alias("equity"))


def trading_stats(equity: DataFrame, ppy: int = 365) -> DataFrame:
    """Of the daily last equity: return, Sharpe, drawdown, and the bias-corrected skew and kurtosis of daily returns."""
    daily = daily_last(equity)
    base = equity_stats(daily, ppy).select("account", F.col("total_return").alias("return"), "sharpe", F.col("max_drawdown").alias("max_dd"))
    m = with_returns(daily).groupBy("account").agg(F.count("ret").alias("n_days"), F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"), F.skewness("ret").alias("_g1"), F.kurtosis("ret").alias("_g2"))
    n = F.col("n_days")
    skew = F.when(n > 3, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    kurt = F.when(n > 3, ((n + 1) * F.col("_g2") + 6) * (n - 1) / ((n - 2) * (n - 3)) + 3).otherwise(3.0)
    return base.join(m, "account").select("account", "return", "sharpe", "max_dd", F.when(F.col("_s") > 0, F.col("_m") / F.col("_s")).otherwise(0.0).alias("sr_daily"), "n_days", skew.alias("skew"), kurt.alias("kurt"))


def ledger_returns(trades: DataFrame, bars: DataFrame, risk: float, by: str = "strategy") -> DataFrame:
    """Return of a ledger per bar: each trade risks a fixed fraction, its R is marked at every close from entry to exit."""
    t = trades.select(by, "asset", "side", "entry_ts", "exit_ts", "entry", "exit", "risk", "fees_r")
    b = bars.select("asset", "ts", "close", (F.row_number().over(own()) - 1).alias("bn"))
    at = t.join(b.select("asset", F.col("ts").alias("entry_ts"), F.col("bn").alias("_p")), ["asset", "entry_ts"])
    at = at.join(b.select("asset", F.col("ts").alias("exit_ts"), F.col("bn").alias("_e")), ["asset", "exit_ts"])
    held = at.withColumn("bn", F.explode(F.sequence("_p", "_e"))).join(b, ["asset", "bn"])
    mark = F.when(F.col("ts") == F.col("exit_ts"), F.col("exit")).otherwise(F.col("close"))
    now = F.col("side") * (mark - F.col("entry")) / F.col("risk") - F.when(F.col("ts") == F.col("exit_ts"), F.col("fees_r")).otherwise(0.0)
    w = Window.partitionBy(by, "asset", "entry_ts").orderBy("bn")
    step = held.withColumn("_now", now).withColumn("_step", F.col("_now") - F.coalesce(F.lag("_now").over(w), F.lit(0.0)))
    return step.groupBy(by, "ts").agg((risk * F.sum("_step")).alias("ret"))


def ledger_equity(trades: DataFrame, bars: DataFrame, capital: float, risk: float, by: str = "strategy") -> DataFrame:
    """Equity of a ledger: the returns of `ledger_returns`, compounded."""
    return compounded(ledger_returns(trades, bars, risk, by), "ret", capital, [by]).select(F.col(by).alias("account"), "ts", "equity")


def with_idle_cash(book: DataFrame, index: DataFrame, capital: float, cost: float = 0.0001) -> DataFrame:
    """The book's return plus the index return on what was not invested the session before, less the cost of changing it.

    `book(account, ts, ret, gross)`, `index(ts, ret)`.
    """
    df = book.join(index.withColumnRenamed("ret", "_ix"), "ts").withColumn("_w", F.greatest(F.lit(0.0), 1 - F.lag("gross").over(curve())))
    df = df.withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    df = df.withColumn("_r", F.coalesce("ret", F.lit(0.0)) + F.col("_w") * F.col("_ix") - cost * F.abs(F.col("_w") - F.coalesce(F.lag("_w").over(curve()), F.lit(0.0))))
    return compounded(df, "_r", capital, ["account"]).select("account", "ts", "equity")


def weights_backtest(panel: DataFrame, weights: DataFrame, capital: float, cost: float) -> DataFrame:
    """Equity of target weights decided at a close and earned from the next session, drifting until the next decision,
    with a cost on what each decision trades.

    Between decisions a weight is start x growth / portfolio growth, so segments compound independently: growth per asset
    inside its segment, one sum per session, turnover at the segment's end. A missing bar earns nothing.
    """
    decisions = weights.select("ts").distinct().select(F.col("ts").alias("decided"), F.row_number().over(Window.orderBy("ts")).alias("seg"))  # a row per decision
    cal = panel.select("ts", "sno").distinct()
    marked = cal.join(decisions, cal.ts == decisions.decided, "left")
    order = Window.orderBy("sno")  # a row per session
    marked = marked.select("ts", "sno", F.max("seg").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("seg")).filter("seg is not null")
    seg_last = marked.groupBy("seg").agg(F.max("sno").alias("_end"))
    start = weights.join(decisions, weights.ts == decisions.decided).select("seg", "asset", F.col("weight").alias("w0")).filter("w0 > 0")
    rets = panel.withColumn("_r", F.coalesce(F.col("close") / F.max("close").over(own(order="sno").rangeBetween(-1, -1)) - 1, F.lit(0.0))).select("asset", "sno", "_r")
    grid = start.join(marked, "seg").join(rets, ["asset", "sno"], "left").withColumn("_r", F.coalesce("_r", F.lit(0.0)))
    run = Window.partitionBy("seg", "asset").orderBy("sno").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("_value", F.col("w0") * F.exp(F.sum(F.log1p("_r")).over(run)))
    cash = start.groupBy("seg").agg((1 - F.sum("w0")).alias("_cash"))
    total = grid.groupBy("seg", "ts", "sno").agg(F.sum("_value").alias("_v")).join(cash, "seg").withColumn("_v", F.col("_v") + F.col("_cash"))
    ends = grid.join(seg_last, "seg").filter("sno = _end").join(total.select("seg", "sno", "_v"), ["seg", "sno"]).select((F.col("seg") + 1).alias("seg"), "asset", (F.col("_value") / F.col("_v")).alias("_old"))
    turn = start.join(ends, ["seg", "asset"], "full_outer").groupBy("seg").agg(F.sum(F.abs(F.coalesce("w0", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0)))).alias("_turn"))
    before = F.coalesce(F.lag("_v").over(Window.partitionBy("seg").orderBy("sno")), F.lit(1.0))
    first = F.row_number().over(Window.partitionBy("seg").orderBy("sno")) == 1
    step = total.join(turn, "seg").withColumn("_ret", F.col("_v") / before - 1 - F.when(first, F.col("_turn") * cost).otherwise(0.0))
    return compounded(step, "_ret", capital).select("ts", "equity")


def window_stats(equity: DataFrame, windows: DataFrame, ppy: int) -> DataFrame:
    """Equity statistics inside named windows `(window, start, end)`."""
    df = equity.join(windows, F.col("ts").between(F.col("start"), F.col("end")))
    df = df.withColumn("account", F.concat_ws("|", F.col("account").cast("string"), "window")).select("account", "ts", "equity")
    return equity_stats(df, ppy)


def drift_by_hour(now: DataFrame, last: DataFrame, top: int = 3) -> DataFrame:
    """Mean of a probability by strategy, class and hour (grouping sets) against the previous run, largest moves first."""
    def means(df, name):
        return df.groupingSets([[F.col("strategy")], [F.col("kind")], [F.col("hour")]], "strategy", "kind", "hour").agg(F.avg("p").alias(name))
    key = F.concat_ws("=", F.when(F.col("strategy").isNotNull(), "strategy").when(F.col("kind").isNotNull(), "kind").otherwise("hour"), F.coalesce("strategy", "kind", F.col("hour").cast("string")))
    a, b = (means(df, n).select(key.alias("name"), n) for df, n in ((now, "now_p"), (last, "was_p")))
    return a.join(b, "name", "full_outer").withColumn("change", F.col("now_p") - F.col("was_p"))


def fill_quality(fills: DataFrame, by: Sequence[str]) -> DataFrame:
    """Maker and taker shares, and the fill against the open in units of risk."""
    return fills.groupBy(*by).agg(F.sum("maker_qty").alias("maker"), F.sum("taker_qty").alias("taker"), (F.sum("maker_qty") / F.nullif(F.sum("maker_qty") + F.sum("taker_qty"), F.lit(0.0))).alias("maker_share"),
                                  F.avg(F.col("side") * (F.col("price") - F.col("open")) / F.col("risk")).alias("slip_r"))


def downsample(equity: DataFrame, points: int = 800) -> DataFrame:
    """Every k-th point of each curve and its last one."""
    df = equity.withColumns({"_i": F.row_number().over(curve()) - 1, "_n": F.count("*").over(Window.partitionBy("account"))})
    return df.filter((F.pmod("_i", F.greatest(F.floor(F.col("_n") / points), F.lit(1))) == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def combine_legs(equity: DataFrame) -> DataFrame:
    """Sum of curves on the union of their dates: carried forward, the first value before their start."""
    cal = equity.select("ts").distinct()
    spans = equity.groupBy("account").agg(F.min_by("equity", "ts").alias("_first"), F.min("ts").alias("_from"))
    starts = cal.agg(F.min("ts").alias("_a"))
    sparse = equity.unionByName(spans.join(starts, F.col("_from") > F.col("_a")).select("account", F.col("_a").alias("ts"), F.col("_first").alias("equity")))
    step = sparse.withColumn("_d", F.col("equity") - F.coalesce(F.lag("equity").over(curve()), F.lit(0.0)))
    line = step.groupBy("ts").agg(F.sum("_d").alias("_d"))
    return line.select("ts", F.sum("_d").over(Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)).alias("equity"))  # a row per session
