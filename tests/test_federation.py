from __future__ import annotations

import datetime
import random
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from triplake.schemas import federated
from triplake.sources import federation


def test_jdbc_options():
    got = federation.jdbc_options("jdbc:x", "t", "u", "p", "id", (1, 100), 4)
    assert got["partitionColumn"] == "id" and got["numPartitions"] == "4" and got["upperBound"] == "100"
    assert "partitionColumn" not in federation.jdbc_options("jdbc:x", "t", "u", "p")


def test_string_ranges_cover_every_row_once(spark):
    cuts = ["f", "o'x"]
    df = spark.createDataFrame([(x,) for x in ("a", "f", "g", "o'x", "z", "", None)], "k string")
    parts = [df.where(p).count() for p in federation.string_ranges("k", cuts)]
    assert sum(parts) == 7 and parts == [3, 2, 2]


def test_declared_tables(spark):
    df = spark.createDataFrame([("1", "k", "n", "w", Decimal("2.90"), "HIDUP", 5)], "nik string, no_kk string, nama string, pekerjaan string, penghasilan decimal(15,2), status_hidup string, hidden int")
    out = federation.declared(df, federated("master_penduduk"))
    assert out.schema == federated("master_penduduk")
    assert out.first().penghasilan == 2 and out.first().tanggal_lahir is None
    federation.register_catalog({"master_penduduk": df})
    assert spark.table("dukcapil_master_penduduk").count() == 1


def test_blank_padded_keys_are_trimmed(spark, tmp_path):
    spark.createDataFrame([("1 ", "a ")], "nik string, nama string").write.parquet(str(tmp_path / "t"))
    assert tuple(federation.read_source(spark, "t", str(tmp_path / "t")).first()) == ("1", "a ")


def test_versions_are_written_on_change_only(spark, tmp_path):
    path = str(tmp_path / "registry")
    a = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "x")], "k int, v string")
    assert [federation.save_if_changed(f, path) for f in (a, a, b, b)] == [1, None, 2, None]
    assert federation.load_version(spark, path).count() == 1 and federation.load_version(spark, path, 1).count() == 2


def test_log_is_appended_by_day(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 2, 3)), (2, datetime.datetime(2024, 1, 3, 3))], "id int, captured_at timestamp")
    federation.append_events(rows, path)
    federation.append_events(rows.limit(1), path)
    assert spark.read.parquet(path).where("day = '2024-01-02'").count() >= 1 and spark.read.parquet(path).count() == 3


def test_a_failed_save_is_no_version(spark, tmp_path):
    path = str(tmp_path / "registry")
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2,)], "k int")
    assert federation.save_if_changed(a, path) == 1
    (tmp_path / "registry" / "version=2").mkdir()  # what a save that failed leaves
    assert federation.versions(spark, path) == [1]
    assert federation.save_if_changed(a, path) is None and federation.save_if_changed(b, path) == 3
    assert [r.k for r in federation.load_version(spark, path).collect()] == [2]


def test_topic_options():
    got = federation.topic_options("h:9092", ["a.log", "b.log"], 50, kafka_group_id="g", includeHeaders="true")
    assert got == {"kafka.bootstrap.servers": "h:9092", "subscribe": "a.log,b.log", "startingOffsets": "earliest", "failOnDataLoss": "true", "maxOffsetsPerTrigger": "50", "kafka.group.id": "g", "includeHeaders": "true"}


def test_jdbc_reads_are_split(spark):
    from tests.conftest import SF
    from triplake.plans import queries

    by_number, by_text = queries.QUERIES["s1_jdbc_by_number"](spark, SF), queries.QUERIES["s2_jdbc_by_text"](spark, SF)
    assert by_number.rdd.getNumPartitions() == 4 and by_text.rdd.getNumPartitions() == 3
    assert "PushedFilters: [*IsNotNull(penerima_id), *EqualTo(penerima_id,5)]" in by_number.where("penerima_id = 5")._jdf.queryExecution().executedPlan().toString()


def test_a_repeated_append_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(i, datetime.datetime(2024, 1, 1 + i % 3)) for i in range(9)], "id int, captured_at timestamp")
    assert federation.append_events(rows, path, "b1") and not federation.append_events(rows.repartition(3), path, "b1")
    assert not federation.append_events(rows, path, "b1") and federation.append_events(rows.where("id < 2"), path)
    assert not federation.append_events(rows.where("id < 2"), path)  # a retry without a name
    assert federation.read_log(spark, path).count() == 11
    with pytest.raises(ValueError, match="other rows"):
        federation.append_events(rows.limit(1), path, "b1")
    (tmp_path / "log" / "batch=b2" / "day=2024-01-01").mkdir(parents=True)  # cut off
    assert federation.read_log(spark, path).count() == 11 and federation.append_events(rows, path, "b2")
    assert federation.read_log(spark, path).count() == 20


def test_writers_at_once_get_versions_of_their_own(spark, tmp_path):
    path = str(tmp_path / "registry")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda k: federation.save_if_changed(spark.createDataFrame([(k,)], "k int"), path), range(4)))
    assert sorted(got) == [1, 2, 3, 4] == federation.versions(spark, path)
    assert {federation.load_version(spark, path, v).first().k for v in got} == {0, 1, 2, 3}


def test_fingerprints_know_rows_apart(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "a", None), (2, "", "b"), (2, "", "b")], "k int, x string, y string")
    same = [df, df.repartition(3), df.orderBy(F.desc("k"))]
    other = [df.limit(3), df.unionByName(df), df.withColumn("y", F.lit("b")), df.select("k", F.col("y").alias("x"), F.col("x").alias("y")), df.withColumn("k", F.col("k").cast("long"))]
    assert len({federation.fingerprint(d) for d in same}) == 1
    assert len({federation.fingerprint(d) for d in [df, *other]}) == 6


@pytest.mark.parametrize("text", [False, True])
def test_splits_are_even_with_a_hot_key(spark, text):
    rng = random.Random(4)
    rows = [((7 if i % 3 == 0 else rng.randrange(1000)), rng.randrange(10_000)) for i in range(3000)] + [(None, 1), (7, None)]
    rows = [(None if k is None else f"k'{k:04}" if text else k, v) for k, v in rows]
    df = spark.createDataFrame(rows, f"k {'string' if text else 'int'}, v int")
    predicates = federation.balanced_ranges(rows[::3] + rows[1::3], 9, "k", "v")
    sizes = [df.where(p).count() for p in predicates]
    assert sum(sizes) == len(rows) and max(sizes) <= 2 * len(rows) / len(sizes)
    assert federation.balanced_ranges([], 4, "k") == ["1 = 1"]


def test_calls_have_databases_of_their_own(spark):
    from tests.conftest import SF
    from triplake.plans import queries

    first = queries.QUERIES["s1_jdbc_by_number"](spark, SF)
    n = first.count()
    second = queries.QUERIES["s1_jdbc_by_number"](spark, SF.replace("sf0.001", "sf0.01"))
    assert (first.count(), second.count()) == (n, 10 * n)
