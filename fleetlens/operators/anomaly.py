"""Isolation forest: many small random trees, each from its own sample, then scores over the whole table.

Only the samples are small: `psi` rows a tree. They are drawn by hashing row ids, the trees grow in
parallel, and the model is a node table of at most trees * 2 * psi rows."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.numeric import clip
from fleetlens.operators.aggregates import classification_report, score_stats
from fleetlens.operators.features import apply_scaler, contribution_map, fit_scaler
from fleetlens.plans.quantiles import grouped_quantiles
from fleetlens.session import durable

NODES = "tree int, node int, feature int, cut double, low int, high int, depth int, size int"


def mean_path(n):
    """Average depth of an unsuccessful search in a random tree of n rows."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes of one tree: each splits a random column at a random value between its extremes."""
    nodes, todo = [], [(np.arange(len(x)), 0)]
    links: list[tuple] = [(-1, 0)]
    while todo:
        rows, depth = todo.pop()
        parent, side = links.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = me
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= max_depth or len(rows) < 2 or not len(usable):
            nodes.append([me, -1, 0.0, -1, -1, depth, len(rows)])
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        below = part[:, f] < cut
        if not below.any():  # the draw fell on the lower extreme
            below = part[:, f] <= cut
        nodes.append([me, f, cut, -1, -1, depth, len(rows)])
        todo += [(rows[below], depth + 1), (rows[~below], depth + 1)]
        links += [(me, 0), (me, 1)]
    return nodes


@dataclass
class Forest:
    cols: list[str]
    nodes: pd.DataFrame
    psi: int
    offset: float
    stats: dict
    scaler: pd.DataFrame

    def scaler_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.scaler)


def _sample(df: DataFrame, row_id: Sequence[str], n: int, trees: int, psi: int, seed: int) -> DataFrame:
    """`psi` rows for each tree, as (tree, x): those with the smallest hashes among the rows dealt to the tree.

    A row is dealt to as many trees as leave each about twice `psi` rows or more, one in a large table, so trees
    share few rows; a 64-bit threshold keeps about twice `psi` of them before any are sorted."""
    deals = min(trees, int(np.ceil(2 * trees * psi / n)))
    share = min(1.0, 2 * psi * trees / (n * deals))
    first = F.pmod(F.xxhash64(F.lit(seed), *row_id), F.lit(trees))
    dealt = F.transform(F.sequence(F.lit(0), F.lit(deals - 1)), lambda k: ((first + k) % trees).cast("int"))
    pool = df.withColumn("tree", F.explode(dealt)).withColumn("_h", F.xxhash64(F.lit(seed + 1), "tree", *row_id))
    pool = pool.filter(F.col("_h") <= F.lit(sample_bound(share)))
    w = Window.partitionBy("tree").orderBy("_h", *row_id)
    return pool.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= psi).select("tree", "_h", "x")


def sample_bound(share: float) -> int:
    """The 64-bit hash below which `share` of all hashes lie."""
    return min(int(share * 2**64) - 2**63, 2**63 - 1)


def _vector(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def _path_scores(nodes: pd.DataFrame, psi: int, keep: list[str]):
    """Mean path lengths of batches of rows, all rows of a batch going down a tree together."""
    trees = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        leaf = (t["depth"].to_numpy() + mean_path(t["size"].to_numpy())).astype(float)
        trees.append((t["feature"].to_numpy(), t["cut"].to_numpy(), t["low"].to_numpy(), t["high"].to_numpy(), leaf, int(t["depth"].max())))
    norm = float(mean_path(psi))

    def work(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            rows = np.arange(len(x))
            total = np.zeros(len(x))
            for feature, cut, low, high, leaf, depth in trees:
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(depth):
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    go = x[rows, np.where(inner, f, 0)] < cut[at]
                    at = np.where(inner, np.where(go, low[at], high[at]), at)
                total += leaf[at]
            out = pdf[keep].copy()
            out["score"] = -np.power(2.0, -total / len(trees) / norm)
            yield out

    return work


def _raw_scores(df: DataFrame, nodes: pd.DataFrame, psi: int, keep: list[str]) -> DataFrame:
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    return df.mapInPandas(_path_scores(nodes, psi, keep), schema)


def fit_isolation_forest(
    df: DataFrame, cols: Sequence[str], row_id: Sequence[str], trees=100, psi=256, contamination=0.05, seed=42, min_rows=100
) -> Forest:
    """Train on all rows of a feature frame; `row_id` names a row uniquely."""
    if not 0.0 < contamination <= 0.5:
        raise ValueError("contamination must lie in (0, 0.5]")
    # Standardising a column moves every cut of it along, so the trees grow on the values as they are; the
    # scaler serves the contributions. The features are computed once.
    rows = durable(df.select(*row_id, _vector(cols).alias("x")))
    n = rows.count()
    if n < min_rows:
        raise ValueError(f"need at least {min_rows} rows, got {n}")
    scaler = fit_scaler(rows, cols, "x").toPandas()  # one row per column
    psi = min(psi, n)
    max_depth = int(np.ceil(np.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf.sort_values("_h")["x"].to_numpy())
        if len(x) != psi:
            raise ValueError(f"tree {tree} got {len(x)} of {psi} rows")
        got = grow(x, np.random.default_rng([seed, tree]), max_depth)
        out = pd.DataFrame(got, columns=["node", "feature", "cut", "low", "high", "depth", "size"])
        out.insert(0, "tree", tree)
        return out

    nodes = _sample(rows, row_id, n, trees, psi, seed).groupBy("tree").applyInPandas(build, NODES).toPandas()
    scores = durable(_raw_scores(rows, nodes, psi, [*row_id]).select("score"))
    offset = grouped_quantiles(scores, [], "score", {"offset": contamination}).first()["offset"]
    decided = scores.withColumn("anomaly_score", F.col("score") - F.lit(offset)).withColumn("is_anomaly", F.col("anomaly_score") < 0)
    s = score_stats(decided).first().asDict()
    stats = {**s, "features": len(cols), "contamination": contamination, "n_estimators": trees}
    return Forest(list(cols), nodes, psi, offset, stats, scaler)


def severity(score: Column | str, mean: float, std: float) -> Column:
    """0 to 100: 50 at the mean training score, more for lower scores."""
    c = F.col(score) if isinstance(score, str) else score
    return clip(F.lit(50.0) - (c - F.lit(mean)) / F.lit(std + 1e-6) * 20, 0, 100)


def score_isolation_forest(df: DataFrame, forest: Forest, keep: Sequence[str], contributions: bool = False) -> DataFrame:
    """anomaly_score (below 0 is anomalous), is_anomaly and anomaly_severity of each feature row."""
    cols, ready = [*keep], df.withColumn("x", _vector(forest.cols))
    if contributions:
        ready = apply_scaler(ready, forest.scaler_frame(df.sparkSession), forest.cols)
        ready = ready.withColumn("contributions", F.slice(contribution_map(forest.cols), 1, 5))
        cols.append("contributions")
    out = _raw_scores(ready.select(*cols, "x"), forest.nodes, forest.psi, cols)
    out = out.withColumn("anomaly_score", F.col("score") - F.lit(forest.offset)).drop("score")
    return out.withColumns(
        {
            "is_anomaly": F.col("anomaly_score") < 0,
            "anomaly_severity": severity("anomaly_score", forest.stats["score_mean"], forest.stats["score_std"]),
        }
    )


def score_latest(scored: DataFrame, keys: Sequence[str] = ("service_name",)) -> DataFrame:
    """The verdict on the newest row of each key, which was scored inside its own history."""
    from fleetlens.operators.windows import latest_row

    return latest_row(scored, keys, ["timestamp"], {c: c for c in scored.columns if c not in keys})


def evaluate(scored: DataFrame, label: str = "label") -> DataFrame:
    """Confusion metrics of scored rows; every label but `normal` is an anomaly."""
    return classification_report(scored, F.col(label) != "normal", F.col("is_anomaly"))


def tune_threshold(df: DataFrame, target_fpr: float = 0.05, score: str = "anomaly_score", label: str = "label", steps: int = 100) -> DataFrame:
    """The score percentile whose false positive rate comes closest to the target; the lowest of equals."""
    probs = {f"t{i}": i / (steps - 1) for i in range(steps)}
    cuts = list(grouped_quantiles(df, [], score, probs).select(*probs).first())
    normal = F.col(label) == "normal"
    counts = df.agg(
        F.count_if(normal).alias("normals"),
        *[F.count_if(normal & (F.col(score) < F.lit(c))).alias(f"fp{i}") for i, c in enumerate(cuts)],
    )
    tried = [
        F.struct(
            F.abs(F.col(f"fp{i}") / F.col("normals") - F.lit(target_fpr)).alias("miss"), F.lit(i).alias("i"),
            F.lit(c).alias("threshold"), (F.col(f"fp{i}") / F.col("normals")).alias("fpr"),
        )
        for i, c in enumerate(cuts)
    ]
    return counts.select(F.array_min(F.array(*tried)).alias("b")).select("b.threshold", "b.fpr")


def save_forest(spark: SparkSession, forest: Forest, path: str) -> None:
    """Node and scaler tables with the training facts, as parquet."""
    spark.createDataFrame(forest.nodes, NODES).write.mode("overwrite").parquet(f"{path}/nodes")
    forest.scaler_frame(spark).write.mode("overwrite").parquet(f"{path}/scaler")
    facts = json.dumps({"cols": forest.cols, "psi": forest.psi, "offset": forest.offset, "stats": forest.stats})
    spark.createDataFrame([(facts,)], "facts string").write.mode("overwrite").parquet(f"{path}/facts")


def load_forest(spark: SparkSession, path: str) -> Forest:
    facts = json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])
    nodes = spark.read.parquet(f"{path}/nodes").toPandas()
    scaler = spark.read.parquet(f"{path}/scaler").toPandas()
    return Forest(facts["cols"], nodes, facts["psi"], facts["offset"], facts["stats"], scaler)


def model_info(forest: Forest) -> dict:
    return {**forest.stats, "n_features": len(forest.cols), "feature_names": forest.cols[:10], "offset": forest.offset}
