"""Exact cross-sectional ranks and quantiles that do not need one task per group.

A date's cross-section can be most of a table, so ranking with `Window.partitionBy(date)` puts it in one task. Here
the values of a group are first counted (equal values collapse map-side), cut into slices at approximate quantiles
and ranked inside the slice; the counts of the lower slices are added. The slice bounds only balance the work: the
ranks are exact whatever the bounds are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

SLICES = 16


def value_ranks(df: DataFrame, by: Sequence[str], value: str, slices: int = SLICES) -> DataFrame:
    """Distinct values of each group: `n` rows with it, `below` rows with a smaller one, `total` rows of the group."""
    by = list(by)
    # written once: bounds, slice sizes and ranks all read the counts
    present = F.col(value).isNotNull()
    for c in by:
        present = present & F.col(c).isNotNull()
    counts = materialise(df.filter(present).groupBy(*by, value).agg(F.count("*").alias("n")), "counts")
    cuts = [i / slices for i in range(1, slices)]
    # sizes and ranks must see the same slices: an approximate quantile differs with the order its parts are merged in, so
    # the bounds, one row per group, are written too and never taken twice
    bounds = materialise(counts.groupBy(*by).agg(F.percentile_approx(value, cuts, 1000).alias("_bounds")), "bounds")
    sliced = counts.join(bounds, by).withColumn(
        "_slice", F.size(F.filter("_bounds", lambda b: b < F.col(value)))
    ).drop("_bounds")
    sizes = sliced.groupBy(*by, "_slice").agg(F.sum("n").alias("_in_slice"))
    ordered = Window.partitionBy(*by).orderBy("_slice")
    sizes = sizes.select(
        *by,
        "_slice",
        F.coalesce(F.sum("_in_slice").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lower"),
        F.sum("_in_slice").over(Window.partitionBy(*by)).alias("total"),
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return sliced.join(sizes, [*by, "_slice"]).select(
        *by, value, "n", (F.col("_lower") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("below"), "total"
    )


def _with_rank(df: DataFrame, by, value, expression, out) -> DataFrame:
    ranks = value_ranks(df, by, value).select(*by, value, expression.alias(out))
    return df.join(ranks, [*by, value], "left")


def pct_rank(df: DataFrame, by: Sequence[str], value: str, out: str, ascending: bool = True, digits: int | None = None) -> DataFrame:
    """Share of the group at or below each value, ties averaged, nulls unranked. With `digits`, values that agree to so many
    decimal places tie: sums and deviations carry rounding noise, which must not part equal ones."""
    if digits is not None:
        return pct_rank(df.withColumn("_rounded", F.round(value, digits)), by, "_rounded", out, ascending).drop("_rounded")
    first = F.col("below") if ascending else F.col("total") - F.col("below") - F.col("n")
    return _with_rank(df, by, value, (first + (F.col("n") + 1) / 2) / F.col("total"), out)


def ranked_from(df: DataFrame, by: Sequence[str], value: str, least: float, digits: int | None = None) -> DataFrame:
    """Rows whose `pct_rank` is at least `least`; `df` is read several times. With `digits` as there."""
    return _rank_part(df, by, value, least, digits, True)


def ranked_upto(df: DataFrame, by: Sequence[str], value: str, most: float, digits: int | None = None) -> DataFrame:
    """Rows whose `pct_rank` is at most `most`; `df` is read several times."""
    return _rank_part(df, by, value, most, digits, False)


def _rank_part(df: DataFrame, by: Sequence[str], value: str, share: float, digits: int | None, upper: bool) -> DataFrame:
    """Ranks rise with the values, so one value of each group parts its rows, and no row is shuffled to be ranked.

    Coarse quantiles bound a strip around the share, what lies below the strip is counted, and only its own values, about a
    twenty-fifth, are ordered. The strip holds the rows at the share, as it is four times as wide on either side as the
    quantiles may err; where every value in it ranks too low, the values above it are those that do not."""
    by = list(by)
    present = F.col(value).isNotNull()
    for c in by:
        present = present & F.col(c).isNotNull()
    rows = df.filter(present).withColumn("_at", F.col(value) if digits is None else F.round(value, digits))
    ends = rows.groupBy(*by).agg(F.percentile_approx("_at", [max(share - 0.02, 0.0), min(share + 0.02, 1.0)], 200).alias("_q"), F.count("*").alias("_total"))
    ends = materialise(ends.select(*by, "_total", F.col("_q")[0].alias("_low"), F.col("_q")[1].alias("_high")), "strips")
    near = rows.select(*by, "_at").join(ends, by).filter(F.col("_at") <= F.col("_high"))
    inside = F.when(F.col("_at") >= F.col("_low"), F.col("_at"))  # null stands for all values below the strip
    counts = near.groupBy(*by, inside.alias("_at")).agg(F.count("*").alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(F.col("_at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("_below", below).filter("_at is not null").join(ends.select(*by, "_total"), by)
    rank = (F.col("_below") + (F.col("_n") + 1) / 2) / F.col("_total")
    first = ranks.filter(rank >= share if upper else rank > share).groupBy(*by).agg(F.min("_at").alias("_first"))
    limits = materialise(ends.select(*by, "_high").join(first, by, "left"), "limits")
    above = F.when(F.col("_first").isNull(), F.col("_at") > F.col("_high")).otherwise(F.col("_at") >= F.col("_first"))
    return rows.join(limits, by).filter(above if upper else ~above).select(*df.columns)


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str, ascending: bool = True) -> DataFrame:
    """Rank from 1 with ties averaged, nulls unranked."""
    first = F.col("below") if ascending else F.col("total") - F.col("below") - F.col("n")
    return _with_rank(df, by, value, first + (F.col("n") + 1) / 2, out)


def group_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column each, plus the row count `total`."""
    ranks = value_ranks(df, by, value)
    aggs = []
    for name, q in quantiles.items():
        at = F.lit(float(q)) * (F.col("total") - 1)
        low, high = F.floor(at), F.ceil(at)
        holds_low = (F.col("below") <= low) & (low < F.col("below") + F.col("n"))
        holds_high = (F.col("below") <= high) & (high < F.col("below") + F.col("n"))
        x0, x1 = F.max(F.when(holds_low, F.col(value))), F.max(F.when(holds_high, F.col(value)))
        share = F.max(at - low)
        aggs.append((x0 + (x1 - x0) * share).alias(name))
    return ranks.groupBy(*by).agg(*aggs, F.max("total").alias("total"))


def group_medians(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    return group_quantiles(df, by, value, {out: 0.5}).select(*by, out)


def first_rows(df: DataFrame, by: Sequence[str], value: str, tie: str, k: int, out: str, ascending: bool = True) -> DataFrame:
    """The first k rows of each group by `value`, ties in the order of `tie`, numbered from 1; null values take no part.

    A filter on row_number lets the planner keep k rows of a group in each task before the shuffle, so neither a hot group
    nor a hot value meets in one task.
    """
    order = F.col(value).asc() if ascending else F.col(value).desc()
    present = F.col(value).isNotNull()
    return df.filter(present).withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(order, tie))).filter(F.col(out) <= k)


def sum_before(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str, slices: int = 64) -> DataFrame:
    """Sum of `value` over the rows of a group before each row, in the order of `order`, whose first column is a number.

    A group is cut into slices at approximate quantiles of that number; a slice is one window, and the sums of the lower
    slices are added. Rows whose group or first order column is null have no place in the order and are left out.
    """
    by, order = list(by), list(order)
    present = F.col(order[0]).isNotNull()
    for c in by:
        present = present & F.col(c).isNotNull()
    rows = materialise(df.filter(present), "ordered")  # bounds, sums of slices and windows all read it
    bounds = rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx(order[0], [i / slices for i in range(1, slices)], 1000)).alias("_bounds"))
    bounds = materialise(bounds, "bounds")  # taken once, as in `value_ranks`
    sliced = rows.join(bounds, by).withColumn("_slice", F.size(F.filter("_bounds", lambda b: b < F.col(order[0])))).drop("_bounds")
    sums = sliced.groupBy(*by, "_slice").agg(F.sum(value).alias("_in_slice"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    lower = sums.select(*by, "_slice", F.coalesce(F.sum("_in_slice").over(earlier), F.lit(0)).alias("_lower"))
    inside = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_lower") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return sliced.join(lower, [*by, "_slice"]).withColumn(out, total).drop("_slice", "_lower")
