"""Stored tables that change by partition."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import retention as ret
from fleetlens.operators import setops
from fleetlens.sources import ingest
from fleetlens.sources import partitions as parts

T0 = datetime(2024, 1, 1)


def files(path):
    return {str(f.relative_to(path)) for f in Path(path).rglob("*.parquet")}


def rows(spark, path, *cols):
    return sorted(tuple(r) for r in parts.read_table(spark, path).select(*cols).collect())


def days(spark, ids, per_day=4):
    data = [(i, f"svc_{i % 2}", T0 + timedelta(days=i // per_day, hours=i % per_day)) for i in ids]
    return spark.createDataFrame(data, "id long, service_name string, timestamp timestamp_ntz")


def test_repeated_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    ingest.append_by_day(days(spark, range(12)), path, "1")
    first = files(path)
    ingest.append_by_day(days(spark, range(12, 20)), path, "2024-01-01")  # a name that looks like a date
    assert first < files(path)
    before = files(path)
    ingest.append_by_day(days(spark, range(12, 20)), path, "2024-01-01")
    assert rows(spark, path, "id") == [(i,) for i in range(20)] and first < files(path) and len(files(path)) == len(before)
    assert "batch" not in parts.read_table(spark, path).columns


def test_repeated_batch_with_other_rows_replaces_itself(spark, tmp_path):
    """A retry that has rows of fewer days leaves nothing of the first attempt, and other batches as they are."""
    path = str(tmp_path / "t")
    ingest.append_by_day(days(spark, range(12)), path, "a")
    ingest.append_by_day(days(spark, range(100, 104)), path, "b")
    ingest.append_by_day(days(spark, range(4, 8)), path, "a")
    assert rows(spark, path, "id") == [(i,) for i in [*range(4, 8), *range(100, 104)]]


def test_expire_touches_one_day(spark, tmp_path):
    path = str(tmp_path / "t")
    ingest.append_by_day(days(spark, range(40)), path, "a", keys=["service_name"])
    before = files(path)
    # Ten days of four rows; the cutoff lies in the sixth day, behind two of its rows.
    assert ret.expire_days(spark, path, T0 + timedelta(days=10, hours=2), 5, keys=["service_name"]) == 22
    assert rows(spark, path, "id") == [(i,) for i in range(22, 40)]
    later = {f for f in before if f.split("date=")[1][:10] > "2024-01-06"}
    assert later < files(path) and all(f.split("date=")[1][:10] >= "2024-01-06" for f in files(path))
    assert ret.expire_days(spark, path, T0 + timedelta(days=10, hours=2), 5, keys=["service_name"]) == 0
    left = files(path)
    assert ret.expire_days(spark, path, T0, 5, keys=["service_name"]) == 0 and files(path) == left


def test_delete_by_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    ingest.append_by_day(days(spark, range(16)), path, "a")
    before = files(path)
    gone = spark.createDataFrame([(1,), (1,), (8,), (9,), (10,), (11,), (99,), (None,)], "id long")
    assert parts.delete_rows(spark, path, ["date"], keys=gone) == 5
    assert rows(spark, path, "id") == [(i,) for i in range(16) if i not in (1, 8, 9, 10, 11)]
    kept = {f for f in before if f.split("date=")[1][:10] in ("2024-01-02", "2024-01-04")}
    assert kept < files(path) and not any("2024-01-03" in f for f in files(path))


def test_expire_incidents(spark, tmp_path):
    inc = spark.createDataFrame([(i, datetime(2024, 1 + i // 2, 10 + i % 2)) for i in range(8)], "id long, timestamp timestamp_ntz")
    act = spark.createDataFrame([(10 * i + k, i, datetime(2024, 1 + (i // 2 + k) % 4, 12)) for i in range(8) for k in range(2)], "id long, incident_id long, timestamp timestamp_ntz")
    a, b = str(tmp_path / "inc"), str(tmp_path / "act")
    parts.replace_partitions(inc.withColumn("month", ret.month("timestamp")), a, ["month"])
    parts.replace_partitions(act.withColumn("month", ret.month("timestamp")), b, ["month"])
    as_of = "2024-08-11 00:00:00"  # 181 days after 2024-02-12
    kept_inc, kept_act, counts = ret.retain_incidents(inc, act, as_of, 181)
    n = ret.expire_incidents(spark, a, b, as_of, 181)
    assert {r["kind"]: r["n"] for r in counts.collect()} == {k: n[k] for k in ("incidents", "remediation_actions")}
    assert rows(spark, a, "id") == sorted(map(tuple, kept_inc.select("id").collect()))
    assert rows(spark, b, "id", "incident_id") == sorted(map(tuple, kept_act.select("id", "incident_id").collect()))
    assert set(ret.expire_incidents(spark, a, b, as_of, 181).values()) == {0}


CURRENT = [("a", "1", 0), ("b", "1", 0), ("c", "1", 1), (None, "1", 1), ("d", None, 2)]
UPDATES = [("a", "2", 0, 1), ("a", "3", 0, 2), ("c", "1", 1, 1), ("d", "9", 3, 1), ("e", "5", 3, 1), ("e", "4", 3, 0), (None, "7", 1, 1)]


@pytest.mark.parametrize("overwrite", [True, False])
def test_merge(spark, tmp_path, overwrite):
    path = str(tmp_path / "t")
    now = spark.createDataFrame(CURRENT, "key string, value string, part int")
    new = spark.createDataFrame(UPDATES, "key string, value string, part int, seq int")
    parts.replace_partitions(now, path, ["part"])
    before = files(path)
    told = parts.merge_rows(spark, path, new, "key", ["part"], ["seq"], overwrite)
    got = sorted(map(str, rows_any(spark, path)))
    if overwrite:
        want = [("a", "3", 0), ("b", "1", 0), ("c", "1", 1), (None, "7", 1), ("d", "9", 3), ("e", "5", 3)]
        assert told == {"added": 1, "changed": 3}
        assert not any(f.startswith("part=2") for f in files(path))  # its only row has moved
    else:
        want = [*CURRENT, ("e", "4", 3)]
        assert told == {"added": 1, "changed": 0} and before < files(path)
    assert got == sorted(map(str, want))
    left = files(path)
    assert parts.merge_rows(spark, path, new, "key", ["part"], ["seq"], overwrite) == {"added": 0, "changed": 0} and files(path) == left


def rows_any(spark, path):
    return [tuple(r) for r in parts.read_table(spark, path).select("key", "value", "part").collect()]


def test_merge_equals_the_upsert_of_frames(spark, tmp_path):
    path = str(tmp_path / "t")
    now = spark.range(200).select(F.col("id").alias("key"), (F.col("id") * 3).alias("value"), (F.col("id") % 5).cast("int").alias("part"))
    new = spark.range(150, 260).select((F.col("id") - F.col("id") % 2).alias("key"), F.col("id").alias("value"), F.lit(0).alias("part"), F.col("id").alias("seq"))
    parts.replace_partitions(now, path, ["part"])
    parts.merge_rows(spark, path, new, "key", ["part"], ["seq"])
    want = setops.upsert(now, new, "key", ["seq"]).select("key", "value", "part")
    assert sorted(rows_any(spark, path)) == sorted(map(tuple, want.collect()))
