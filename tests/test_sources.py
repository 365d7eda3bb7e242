import pytest
from pyspark.sql import functions as F

from plumbago.sources import readers, sinks
from plumbago.streaming import progress


def test_json_lines_report_line_numbers(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "a", "v": 1}\n\n{"id": "b"\n{"id": "a", "v": 2}\n')
    good, bad = readers.json_lines(spark, str(p), "id string, v int", "id")
    assert good.count() == 2
    assert sorted((r.line, r.error) for r in bad.collect()) == [(3, "malformed"), (4, "duplicate key")]


def test_suffix_dispatch(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "id string, v int")
    for kind in ("parquet", "orc"):
        df.write.format(kind).save(f"{tmp_path}/t.{kind}")
        assert readers.read_table(spark, f"{tmp_path}/t.{kind}").collect() == df.collect()
    df.write.option("header", True).csv(f"{tmp_path}/t.csv")
    assert readers.read_table(spark, f"{tmp_path}/t.csv", df.schema).collect() == df.collect()
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.xls")


def test_catalog(spark, tmp_path):
    (tmp_path / "c.txt").write_text("﻿1\t永\n2\t龘\n", encoding="utf-8")
    assert {r.char for r in readers.catalog(spark, str(tmp_path / "c.txt")).collect()} == {"永", "龘"}


def test_ocr_payloads(spark):
    ok = '{"lines":[{"text":"ab","score":0.9,"characters":[{"char":"a","confidence":0.9,"topk":{"a":0.9}},{"char":"","confidence":2.0}]}]}'
    df = spark.createDataFrame([("i", ok), ("j", "{"), ("k", None)], "id string, p string")
    chars, bad = readers.ocr_characters(df, "id", "p")
    assert [r.character_id for r in chars.collect()] == ["ocr-i-0-0"] and bad.count() >= 2


def test_publish_is_idempotent_and_refuses_change(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    path = f"{tmp_path}/out"
    first = sinks.publish(df, path, "id")
    assert sinks.publish(df.repartition(3).orderBy(F.desc("id")), path, "id") == first
    with pytest.raises(sinks.PublishConflict):
        sinks.publish(df.limit(1), path, "id")
    assert spark.read.parquet(path).count() == 2


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0)]
    df = spark.createDataFrame(rows, "ts string, kind string, value double").withColumn("ts", F.to_timestamp_ntz("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = progress.windows(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "ts", "kind", "value", "1 hour", "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("progress_test").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("progress_test").collect()) == sorted(progress.windows(df, "ts", "kind", "value").collect())


def test_stream_merge_replays_add_nothing(spark, tmp_path):
    schema = "id string, label string"
    spark.createDataFrame([("a", "PASS"), ("a", "PASS"), ("b", "BLOCK")], schema).write.json(f"{tmp_path}/in")
    for k in range(2):
        q = progress.merge_batches(progress.log_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/gold", "id", ["label"], f"{tmp_path}/cp{k}").start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(f"{tmp_path}/gold").count() == 2
