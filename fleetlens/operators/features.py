"""Feature frames for the models: calendar, rolling, lag, rate, interaction and indicator columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.dates import calendar, cyclic
from fleetlens.functions.numeric import finite, flag
from fleetlens.operators.setops import align_columns
from fleetlens.operators.windows import (
    change_columns,
    ffill,
    lag_columns,
    lookback_columns,
    rate_columns,
    rolling_columns,
    zscore_columns,
)
from fleetlens.plans.ordered import running, settle, with_history
from fleetlens.schemas import KEYS, ORDER

# Which metrics get which features, and the sizes in rows.
ROLLING_METRICS = ["cpu_usage_percent", "memory_usage_mb", "error_rate", "response_time_p50", "response_time_p95"]
LAG_METRICS = ["cpu_usage_percent", "memory_usage_mb", "error_rate", "response_time_p95"]
RATE_METRICS = ["cpu_usage_percent", "memory_usage_mb", "error_rate", "disk_usage_percent"]
SIZES = [5, 10, 30]
STEPS = [1, 5, 10, 30]
NOT_FEATURES = ["id", "timestamp", "label"]


def feature_columns(df: DataFrame, keys: Sequence[str] = tuple(KEYS)) -> list[str]:
    """All columns but keys, id, time and label."""
    return [c for c in df.columns if c not in (*NOT_FEATURES, *keys)]


def extract_features(df: DataFrame, keys: Sequence[str] = tuple(KEYS), by: Sequence[str] = tuple(ORDER), **how) -> DataFrame:
    """All features of each sample; rows without a full history of 30 samples drop out.

    Rolling, lag and rate columns share one window, so the rows are sorted once."""
    have = set(df.columns)
    roll = [m for m in ROLLING_METRICS if m in have]
    lagged = [m for m in LAG_METRICS if m in have]
    rated = [m for m in RATE_METRICS if m in have]

    def build(d, w):
        return d.withColumns(rolling_columns(w, roll, SIZES) | lag_columns(w, lagged, STEPS) | rate_columns(w, rated))

    past = with_history(df, keys, by, max(STEPS), build, **how)
    c = F.col
    pairs = {
        "cpu_error_interaction": (("cpu_usage_percent", "error_rate"), lambda a, b: a * b),
        "memory_latency_interaction": (("memory_usage_mb", "response_time_p95"), lambda a, b: a * b),
        "combined_load": (("cpu_usage_percent", "memory_usage_percent"), lambda a, b: (a + b) / 2),
        "error_latency_interaction": (("error_rate", "response_time_p95"), lambda a, b: a * b),
    }
    mixed = {n: f(c(x), c(y)) for n, ((x, y), f) in pairs.items() if x in have and y in have}
    limits = {
        "high_cpu_indicator": ("cpu_usage_percent", 80),
        "high_memory_indicator": ("memory_usage_percent", 85),
        "high_error_indicator": ("error_rate", 0.05),
        "high_latency_indicator": ("response_time_p95", 1000),
    }
    marks = {n: flag(c(m) > limit) for n, (m, limit) in limits.items() if m in have}
    several = sum(marks.values(), F.lit(0)) >= 2
    full = past.withColumns(
        calendar("timestamp") | cyclic("timestamp") | zscore_columns(roll, SIZES) | mixed | marks
        | {"multiple_issues_indicator": several.cast("int")}
    )
    return full.na.drop("any", subset=[x for x in full.columns if x not in ("label", *keys)])


def encode_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """0 for `normal`, 1 for every other label."""
    return df.withColumn(label, flag(F.col(label) != "normal"))


def assemble(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=name, handleInvalid="error").transform(df)


def align_for_prediction(df: DataFrame, features: Sequence[str], ids: Sequence[str] = (*KEYS, "timestamp")) -> DataFrame:
    """The training columns in their order beside the ids; columns the frame lacks are 0."""
    return align_columns(df, [*ids, *features])


def fit_scaler(df: DataFrame, cols: Sequence[str], vector: str | None = None) -> DataFrame:
    """Mean and population deviation of each column, one row per column; a deviation of 0 becomes 1.

    One vector aggregate instead of two aggregates per column, which would be too much code to compile.
    `vector` names an array column that already holds the values of `cols`."""
    values = F.col(vector) if vector else F.array(*[F.col(c).cast("double") for c in cols])
    s = df.agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(values)).alias("s"))
    n = F.col("s.count")
    parts = F.arrays_zip(
        F.array(*[F.lit(c) for c in cols]),
        vector_to_array("s.mean"),
        F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n)),
    )
    rows = s.select(F.inline(parts)).toDF("feature", "mean", "std")
    return rows.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / std. The statistics are one row per column of the schema and are read once."""
    known = {r["feature"]: (r["mean"], r["std"]) for r in stats.filter(F.col("feature").isin(list(cols))).collect()}
    return df.withColumns({c: (F.col(c) - F.lit(known[c][0])) / F.lit(known[c][1]) for c in cols})


def contribution_map(cols: Sequence[str]):
    """Share of each |value| in their sum, as an array of (feature, share), largest first."""
    parts = F.array(*[F.struct(F.abs(F.col(c).cast("double")).alias("w"), F.lit(c).alias("feature")) for c in cols])
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x["w"])
    share = F.transform(
        parts,
        lambda x: F.struct(F.when(total > 0, x["w"] / total).otherwise(x["w"]).alias("share"), x["feature"].alias("feature")),
    )
    return F.array_sort(
        share,
        lambda a, b: F.when(a["share"] > b["share"], -1).when(a["share"] < b["share"], 1)
        .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0),
    )


def contributions(df: DataFrame, cols: Sequence[str], name: str = "contributions") -> DataFrame:
    """Contribution of each scaled feature to how far a row lies from the mean, largest first."""
    return df.withColumn(name, contribution_map(cols))


def top_k(array: str, k: int):
    """The first k entries of an ordered array."""
    return F.slice(array, 1, k)


def split(df: DataFrame, test: float = 0.2, temporal: bool = True, by: Sequence[str] = ("timestamp", "id"), seed: int = 42, blocks: int | None = None):
    """(train, test): the first int(n * (1 - test)) rows in time against the rest, or by a hash of the row.

    The rank over all rows comes from range partitions with carried counts, so no task holds them all."""
    if temporal:
        n = df.count()
        cut = int(n * (1 - test))
        ranked = running(df, [], by, sums={"_rank": F.lit(1)}, blocks=blocks)
        return ranked.filter(F.col("_rank") <= cut).drop("_rank"), ranked.filter(F.col("_rank") > cut).drop("_rank")
    share = F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1_000_000)) / 1_000_000.0
    return df.filter(share >= test), df.filter(share < test)


def failure_features(long: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("service",), n: int = 12, error_high: float = 5.0, **how) -> DataFrame:
    """Features of each (service, time) from long metrics: filled values, lookback statistics, changes,
    products, calendar and indicators. Undefined values are 0."""
    wide = long.groupBy(*keys, "timestamp").pivot("metric_name", list(metrics)).agg(F.avg("value"))
    how = settle(wide, keys, how)
    filled = ffill(wide, metrics, keys, ["timestamp"], **how)

    def build(d, w):
        return d.withColumns(lookback_columns(w, metrics, n) | change_columns(w, metrics))

    past = with_history(filled, keys, ["timestamp"], n, build, **how)
    c = F.col
    extra = {}
    if {"cpu_usage", "memory_usage"} <= set(metrics):
        extra["cpu_memory_product"] = c("cpu_usage") * c("memory_usage")
        extra["cpu_memory_ratio"] = F.try_divide(c("cpu_usage"), c("memory_usage") + 1)
    if {"error_rate", "response_time"} <= set(metrics):
        extra["error_latency_product"] = c("error_rate") * c("response_time")
    high = {"cpu_high": ("cpu_usage", 80.0), "memory_high": ("memory_usage", 85.0), "error_high": ("error_rate", error_high)}
    extra |= {name: flag(c(m) > limit) for name, (m, limit) in high.items() if m in metrics}
    out = past.withColumns(extra | calendar("timestamp"))
    numeric = [x for x in out.columns if x not in (*keys, "timestamp")]
    doubles = {x: finite(F.col(x).cast("double")) for x in numeric}
    return out.withColumns(doubles).withColumnsRenamed({m: f"{m}_current" for m in metrics})
