"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be sent to all executors.
SMALL_ROWS = 200_000


def is_finite(x: Column) -> Column:
    """Whether x is a number other than NaN and the infinities (null: false)."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or_null(x: Column) -> Column:
    return F.when(is_finite(x), x)


def clipped(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """x within [low, high]; null and NaN stay null."""
    x = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def sign_of(x: Column) -> Column:
    """-1, 0 or 1 as double."""
    return F.signum(clipped(x))


def day_id(ts: Column) -> Column:
    """Days since 1970-01-01 UTC."""
    return F.unix_date(F.to_date(ts))


def week_id(ts: Column) -> Column:
    """Seven-day weeks since 1970-01-01, which begin on Thursdays."""
    return F.floor(day_id(ts) / 7).cast("int")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def series(keys: list[str], order: str = "bar_idx") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def so_far(keys: list[str], order: str = "bar_idx") -> WindowSpec:
    return series(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def truth(value, default: bool = False) -> bool:
    """What a flag means: booleans, numbers and words such as yes and off; default for anything else."""
    if isinstance(value, bool | int | float):
        return bool(value)
    word = str(value).strip().lower()
    return True if word in ("1", "true", "yes", "y", "on") else False if word in ("0", "false", "no", "n", "off") else default


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, with a hint to broadcast it if a count shows that it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
