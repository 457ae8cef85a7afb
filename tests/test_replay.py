import math

from pyspark.sql import functions as F

from pagework.catalog import streams
from pagework.sources import store
from pagework.streaming.streams import run_available


def test_a_value_that_all_rows_share_is_dealt_to_many_files_and_few_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "new_folder", lambda _, label: str(tmp_path / label))
    rows = spark.range(0, 40_000, 1, 20).select("id", F.lit(1).alias("version"))
    stream = streams.replay(rows, "version")
    held = spark.read.parquet(str(tmp_path / "replay"))
    largest = held.groupBy(F.input_file_name().alias("f")).count().agg(F.max("count")).first()[0]
    assert largest <= held.count() / 4
    assert held.select("id").distinct().count() == 40_000
    assert held.count() == 40_000 + rows.where("pmod(xxhash64(id, version), 77) % 7 = 0").count()
    batches = []
    run_available(stream, "append", str(tmp_path / "checkpoint"), lambda batch, i: batches.append(batch.count()))
    assert sum(batches) == held.count() and 1 < len(batches) <= 5


def test_deliveries_follow_the_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "new_folder", lambda _, label: str(tmp_path / label))
    rows = spark.range(0, 3_000, 1, 4).select("id", (F.col("id").cast("double") + 0.5).alias("at")).unionByName(
        spark.createDataFrame([(5000, None)], "id bigint, at double"))
    streams.replay(rows, "at")
    dealt = spark.read.parquet(str(tmp_path / "ranged")).groupBy("_file").agg(F.min("at"), F.max("at"), F.count("*"))
    got = {r[0]: r[1:] for r in dealt.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] or sorted(got) == [0, 1, 2, 3]
    assert got[0][1] <= 1010 and got[2][1] == 2999.5 and math.isclose(got[0][0], 0.5, abs_tol=80)
    assert spark.read.parquet(str(tmp_path / "replay")).where("id = 5000").count() >= 1
