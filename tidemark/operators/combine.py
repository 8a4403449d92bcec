"""Signal combinators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import pct_rank
from ..functions.temporal import gap_filter, on_session, pick
from ..functions.windows import own, session_return, session_rolling, sessions_ago
from .event_signals import as_signals, first_ahead, on_bars
from .panel_signals import sector_medians


def one_per_gap_bars(parts: list[DataFrame], bars: DataFrame, gap: int) -> DataFrame:
    """The union of signals, each kept only when more than `gap` bars follow the last kept one."""
    union = None
    for p in parts:
        s = p.select("asset", "ts")
        union = s if union is None else union.unionByName(s)
    numbered = bars.select("asset", "ts", F.row_number().over(own()).alias("_bn")).join(union.distinct(), ["asset", "ts"])
    kept = gap_filter(numbered, ["asset"], "_bn", gap)
    return numbered.join(kept, ["asset", "_bn"]).select("asset", "ts", F.lit(1).alias("side"))


def one_per_gap_bars_by(signals: DataFrame, bars: DataFrame, gap: int, by: list[str]) -> DataFrame:
    """`one_per_gap_bars` of several unions, named by the columns `by` of `signals`, in one pass over the bars."""
    numbered = bars.select("asset", "ts", F.row_number().over(own()).alias("_bn")).join(signals.select(*by, "asset", "ts"), ["asset", "ts"])
    lists = numbered.groupBy(*by, "asset").agg(F.sort_array(F.collect_set(F.struct("_bn", "ts"))).alias("_all"))  # never longer than an asset's bars
    kept = pick(F.col("_all"), F.lit(None).cast("int"), lambda last, x: last.isNull() | (x["_bn"] - last > gap), lambda x: x["_bn"], lambda x: x["ts"], dict(bars.dtypes)["ts"])
    return lists.select(*by, "asset", F.explode(kept).alias("ts")).withColumn("side", F.lit(1))


def with_short_mean(panel: DataFrame, n: int, least: int) -> DataFrame:
    """The mean of `short_rank`, unranked, as `_mean`, of a panel that carries `short` and `total`."""
    df = panel.withColumn("_ratio", F.when(F.col("total") > 0, F.col("short") / F.col("total")))
    df = df.withColumn("_known", sessions_ago("_ratio", 1))
    return df.withColumn("_mean", session_rolling(F.avg, "_known", n, least)).drop("_ratio", "_known")


def short_rank(panel: DataFrame, volumes: DataFrame, n: int, least: int, digits: int | None = None) -> DataFrame:
    """Share of the cross-section with a lower mean short ratio, the ratio usable from the session after its own.

    `volumes(asset, ts, short, total)` on the panel's sessions. With `digits`, means that agree to so many places tie: a
    mean of the same ratios in another order differs by rounding noise.
    """
    ratio = volumes.filter("total > 0").select("asset", "ts", (F.col("short") / F.col("total")).alias("_ratio"))
    df = panel.join(ratio, ["asset", "ts"], "left").withColumn("_known", sessions_ago("_ratio", 1))
    df = df.withColumn("_mean", session_rolling(F.avg, "_known", n, least))
    return pct_rank(df, ["ts"], "_mean", "short_rank", digits=digits).drop("_ratio", "_known", "_mean")


def at_turn(signals: DataFrame, panel: DataFrame, bounce: int, wait: int, confirm: str = "stock") -> DataFrame:
    """Each signal moved to the first bar in [0, wait] with a positive `bounce`-session return of the stock (or of its
    sector's median stock); dropped when none comes."""
    df = panel.withColumn("_rb", session_return(bounce))
    if confirm == "sector":
        df = df.join(sector_medians(df, "_rb", "_mb"), ["ts", "sector"], "left").withColumn("_up", F.col("_mb") > 0)
    else:
        df = df.withColumn("_up", F.col("_rb") > 0)
    return first_ahead(on_bars(signals, df), F.col("_sig"), F.col("_up"), 0, wait)


def at_turn_by(signals: DataFrame, panel: DataFrame, bounce: int, wait: int, by: list[str]) -> DataFrame:
    """`at_turn` on the stock's own return for the signals of several ideas (named by the columns `by`) in one pass over the panel."""
    df = panel.select("asset", "ts", F.when(session_return(bounce) > 0, F.col("ts")).alias("_turn"))
    df = df.select("asset", "ts", F.min("_turn").over(own().rowsBetween(0, wait)).alias("_to")).filter("_to is not null")
    return signals.select(*by, "asset", "ts").join(df, ["asset", "ts"]).select(*by, "asset", F.col("_to").alias("ts")).distinct()


def not_event_day(rows: DataFrame, bars: DataFrame, release_days: DataFrame) -> DataFrame:
    """Rows outside the reaction session of a release and the one after it."""
    react = on_session(release_days.select("asset", "day").distinct(), bars).select("asset", "ts").distinct().withColumn("_r", F.lit(1))
    df = bars.select("asset", "ts").join(react, ["asset", "ts"], "left")
    hit = F.max("_r").over(own().rowsBetween(-1, 0))
    return rows.join(df.withColumn("_h", hit).filter("_h = 1").select("asset", "ts"), ["asset", "ts"], "left_anti")


def union_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return as_signals(out)


def candidate_id(fields: list[str]) -> Column:
    """Stable id: the SHA-1 of the canonical JSON of the deciding fields. Joins use the whole of it; show `short_id`."""
    return F.sha1(F.to_json(F.struct(*sorted(fields))))


def short_id(column: str = "id") -> Column:
    return F.substring(column, 1, 10)


def parameter_grid(families: DataFrame, rules: DataFrame, segments: DataFrame) -> DataFrame:
    """Every family version with every rule and segment of its kind, with a stable id.

    `families(family, kind, params array<map<string,double>>)`, `rules(kind, rule)`, `segments(kind, segment)`: the rules
    and segments of a kind are one row with two short arrays, which the families meet by kind and spread locally.
    """
    versions = families.select("family", "kind", F.explode("params").alias("params"))
    ordered = versions.withColumn("params", F.map_from_entries(F.array_sort(F.map_entries("params"))))
    choices = rules.groupBy("kind").agg(F.collect_set("rule").alias("_rules")).join(segments.groupBy("kind").agg(F.collect_set("segment").alias("_segments")), "kind")
    df = ordered.join(choices, "kind").withColumn("rule", F.explode("_rules")).withColumn("segment", F.explode("_segments"))
    return df.select(candidate_id(["family", "params", "rule", "segment"]).alias("id"), "family", "params", "rule", "segment")


def param_neighbours(candidates: DataFrame, factors: tuple[float, ...] = (0.7, 1.4)) -> DataFrame:
    """Each numeric parameter times each factor: whole numbers stay whole and at least 1, shares stay inside (0, 1)."""
    df = candidates.select("id", "params", F.explode(F.map_entries("params")).alias("e"), )
    df = df.select("id", "params", "e", F.explode(F.array(*[F.lit(f) for f in factors])).alias("_f"))
    old = F.col("e.value")
    whole = old == F.floor(old)
    new = F.when(whole, F.greatest(F.lit(1.0), F.floor(old * F.col("_f") + 0.5).cast("double"))).otherwise(F.round(old * F.col("_f"), 4))
    df = df.withColumn("_new", new).filter(F.col("_new") != old).filter(whole | (old >= 1) | ((F.col("_new") > 0) & (F.col("_new") < 1)))
    return df.select("id", F.col("e.key").alias("name"), F.map_from_entries(F.transform(F.map_entries("params"), lambda p: F.struct(
        p["key"].alias("key"), F.when(p["key"] == F.col("e.key"), F.col("_new")).otherwise(p["value"]).alias("value")))).alias("params"))


