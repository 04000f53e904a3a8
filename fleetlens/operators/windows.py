"""Rolling statistics, lags, rates, forward fill and latest rows, per service in time order.

Every function takes `keys` and `by`; `by` must order the rows of a key without ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from fleetlens.functions.numeric import finite
from fleetlens.plans.ordered import running, with_history
from fleetlens.schemas import KEYS, ORDER

STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def rolling_columns(w: WindowSpec, cols: Sequence[str], sizes: Sequence[int]) -> dict[str, Column]:
    """Mean, sample deviation, min and max of the last n rows, the current one included."""
    return {
        f"{c}_rolling_{s}_{n}": f(c).over(w.rowsBetween(1 - n, 0))
        for c in cols
        for n in sizes
        for s, f in STATS.items()
    }


def zscore_columns(cols: Sequence[str], sizes: Sequence[int]) -> dict[str, Column]:
    """Distance from the rolling mean in rolling deviations."""
    return {
        f"{c}_zscore_{n}": (F.col(c) - F.col(f"{c}_rolling_mean_{n}")) / (F.col(f"{c}_rolling_std_{n}") + F.lit(1e-6))
        for c in cols
        for n in sizes
    }


def lag_columns(w: WindowSpec, cols: Sequence[str], steps: Sequence[int]) -> dict[str, Column]:
    return {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in cols for k in steps}


def rate_columns(w: WindowSpec, cols: Sequence[str]) -> dict[str, Column]:
    """Difference, relative change (0 where the former value is 0) and change of the difference."""
    out = {}
    for c in cols:
        one, two = F.lag(c, 1).over(w), F.lag(c, 2).over(w)
        out[f"{c}_diff"] = F.col(c) - one
        out[f"{c}_pct_change"] = F.when(one == 0, F.lit(0.0)).otherwise(F.col(c) / one - 1)
        out[f"{c}_acceleration"] = F.col(c) - 2 * one + two
    return out


def rolling(df, cols, sizes=(5, 10, 30), keys=KEYS, by=ORDER, **how) -> DataFrame:
    return with_history(df, keys, by, max(sizes) - 1, lambda d, w: d.withColumns(rolling_columns(w, cols, sizes)), **how)


def rolling_z(df, cols, sizes=(5, 10, 30), keys=KEYS, by=ORDER, **how) -> DataFrame:
    return rolling(df, cols, sizes, keys, by, **how).withColumns(zscore_columns(cols, sizes))


def lags(df, cols, steps=(1, 5, 10, 30), keys=KEYS, by=ORDER, **how) -> DataFrame:
    return with_history(df, keys, by, max(steps), lambda d, w: d.withColumns(lag_columns(w, cols, steps)), **how)


def rates(df, cols, keys=KEYS, by=ORDER, **how) -> DataFrame:
    return with_history(df, keys, by, 2, lambda d, w: d.withColumns(rate_columns(w, cols)), **how)


def rate_of_change(df, cols, fill: float | None = None, keys=KEYS, by=ORDER, **how) -> DataFrame:
    """Difference to the former sample; the first row of a key gets `fill`."""
    def build(d, w):
        diff = {f"{c}_rate_of_change": F.col(c) - F.lag(c, 1).over(w) for c in cols}
        return d.withColumns(diff if fill is None else {n: F.coalesce(v, F.lit(fill)) for n, v in diff.items()})

    return with_history(df, keys, by, 1, build, **how)


def ffill(df, cols, keys=KEYS, by=ORDER, default: float = 0.0, **how) -> DataFrame:
    """Nulls take the last known value of the key, or `default` before the first one."""
    out = running(df, keys, by, last={f"_f_{c}": F.col(c) for c in cols}, **how)
    return out.withColumns({c: F.coalesce(f"_f_{c}", F.lit(default)) for c in cols}).drop(*[f"_f_{c}" for c in cols])


def lookback_columns(w: WindowSpec, cols: Sequence[str], n: int) -> dict[str, Column]:
    span = w.rowsBetween(1 - n, 0)
    out = {f"{c}_{s}": f(c).over(span) for c in cols for s, f in STATS.items()}
    return {k: F.coalesce(v, F.lit(0.0)) if k.endswith("_std") else v for k, v in out.items()}


def change_columns(w: WindowSpec, cols: Sequence[str]) -> dict[str, Column]:
    """Difference and relative change to the former row, 0 where undefined."""
    out = {}
    for c in cols:
        prev = F.lag(c, 1).over(w)
        out[f"{c}_change_rate"] = F.coalesce(F.col(c) - prev, F.lit(0.0))
        out[f"{c}_change_pct"] = finite(F.try_divide(F.col(c), prev) - 1)
    return out


def lookback(df, cols, n=12, keys=KEYS, by=ORDER, **how) -> DataFrame:
    return with_history(df, keys, by, n - 1, lambda d, w: d.withColumns(lookback_columns(w, cols, n)), **how)


def latest_row(df: DataFrame, keys: Sequence[str], by: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """Per key the named columns of its newest row, as one aggregate."""
    newest = F.max_by(F.struct(*[F.col(c).alias(n) for n, c in cols.items()]), F.struct(*by))
    return df.groupBy(*keys).agg(newest.alias("_l")).select(*keys, "_l.*")


def system_health(df: DataFrame, keys=KEYS, by=ORDER) -> DataFrame:
    """Last update, error rate, cpu and uptime of each service."""
    cols = {"last_updated": "timestamp", "current_error_rate": "error_rate", "current_cpu_percent": "cpu_usage_percent"}
    if "uptime_seconds" in df.columns:
        cols["uptime_seconds"] = "uptime_seconds"
    return latest_row(df, keys, by, cols)


def latest_score(df: DataFrame, keys: Sequence[str] = (), by: Sequence[str] = ("timestamp", "id")) -> DataFrame:
    """The newest anomaly score, of the whole log or of each key."""
    cols = {c: c for c in df.columns if c not in keys}
    return latest_row(df, keys, by, cols)
