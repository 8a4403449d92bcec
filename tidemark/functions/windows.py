"""Rolling frames over bars.

Two clocks exist and are never mixed: ROWS frames count an asset's own bars, RANGE frames on the session number `sno`
count the sessions of the shared calendar, so a missing bar occupies its place in the window.

Every partition here is one asset's bars. Bars are aggregated before they are windowed, so a partition never holds
more rows than the calendar has sessions, however many raw rows one asset has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

UNBOUNDED = Window.unboundedPreceding


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def own(by="asset", order="ts"):
    """An asset's own bars in time order."""
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)


def frame(n: int, shift: int = 0, by="asset", order="ts"):
    """The last n bars, ending `shift` bars ago."""
    return own(by, order).rowsBetween(-(n - 1) - shift, -shift)


def sessions(n: int, shift: int = 0, by="asset", order="sno"):
    """The last n calendar sessions, ending `shift` sessions ago."""
    return own(by, order).rangeBetween(-(n - 1) - shift, -shift)


def over(fn: Callable[[Column], Column], c: str | Column, window, min_count: int) -> Column:
    """Aggregate over a frame, null until the frame holds `min_count` values."""
    value = col(c)
    return F.when(F.count(value).over(window) >= min_count, fn(value).over(window))


def rolling(fn, c, n: int, min_count: int | None = None, shift: int = 0, by="asset", order="ts") -> Column:
    return over(fn, c, frame(n, shift, by, order), n if min_count is None else min_count)


def session_rolling(fn, c, n: int, min_count: int | None = None, shift: int = 0, by="asset") -> Column:
    return over(fn, c, sessions(n, shift, by), n if min_count is None else min_count)


def bars_ago(c: str | Column, k: int, by="asset", order="ts") -> Column:
    return F.lag(col(c), k).over(own(by, order))


def sessions_ago(c: str | Column, k: int, by="asset") -> Column:
    """The value exactly k calendar sessions back, null when that session has no bar."""
    return F.max(col(c)).over(own(by, "sno").rangeBetween(-k, -k))


def session_return(k: int, c: str | Column = "close", by="asset") -> Column:
    return col(c) / sessions_ago(c, k, by) - 1


def enters(mask: str | Column, by="asset") -> Column:
    """True on the session a mask turns on; a missing session counts as off."""
    now = F.coalesce(col(mask), F.lit(False))
    before = F.coalesce(F.max(now).over(own(by, "sno").rangeBetween(-1, -1)), F.lit(False))
    return now & ~before


def turns_on(mask: str | Column, by="asset", order="ts") -> Column:
    """The same edge on an asset's own bars."""
    now = F.coalesce(col(mask), F.lit(False))
    return now & ~F.coalesce(F.lag(now).over(own(by, order)), F.lit(False))


def side(up: Column, down: Column) -> Column:
    """+1 / -1 / 0 from two masks."""
    return F.when(up, 1).when(down, -1).otherwise(0)
