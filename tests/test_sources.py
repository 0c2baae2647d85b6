import io
import json
import zipfile

import numpy as np
import pytest

from strandwell.operators import jobs
from strandwell.sources import files
from strandwell.streaming import incremental


def test_manifest(spark, tmp_path):
    good, twice, torn = tmp_path / "good.jsonl", tmp_path / "twice.jsonl", tmp_path / "torn.jsonl"
    good.write_text('{"item_id": "a", "n": 1}\n{"item_id": "b", "n": 2}\n')
    twice.write_text('{"item_id": "a", "n": 1}\n{"item_id": "a", "n": 2}\n')
    torn.write_text('{"item_id": "a", "n": 1}\n{"item_id": "b", "n": 2}\n{"item_id": "c", "n"')
    schema = "item_id string, n int"
    assert files.read_manifest(spark, str(good), schema, "item_id").count() == 2
    with pytest.raises(Exception, match="repeated a"):
        files.read_manifest(spark, str(twice), schema, "item_id").collect()
    with pytest.raises(Exception):  # noqa: B017
        files.read_manifest(spark, str(torn), schema, "item_id").collect()
    assert [(r["line"], r["item_id"]) for r in files.read_json_prefix(spark, str(torn), schema).orderBy("line").collect()] == [(1, "a"), (2, "b")]
    files.write_manifest(files.read_manifest(spark, str(good), schema, "item_id").select("n", "item_id").coalesce(1), str(tmp_path / "out"))
    line = next((tmp_path / "out").glob("part-*")).read_text().splitlines()[0]
    assert list(json.loads(line)) == ["item_id", "n"]


def test_frame_maps_archives_and_vectors(spark, tmp_path):
    (tmp_path / "L01_V001.csv").write_text("n,pts_time,fps,frame_idx\n1,0.0,25.0,0\n2,4.0,25.0,100\n")
    assert [tuple(r) for r in files.read_frame_map(spark, str(tmp_path / "L01_V001.csv")).collect()] == [("L01_V001", 1, 0.0, 25.0, 0), ("L01_V001", 2, 4.0, 25.0, 100)]
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        z.writestr("objects/L01_V001/001.json", json.dumps({"detection_class_names": ["/m/1", "/m/2"], "detection_class_entities": ["Person", "Car"], "detection_scores": ["0.9", "0.2"], "detection_boxes": [["0", "0", "1", "1"], ["0", "0", "0.5", "1"]]}))
        z.writestr("objects/readme.txt", "no")
    (tmp_path / "objects.zip").write_bytes(content.getvalue())
    rows = files.detections(files.read_json_archive(spark, str(tmp_path / "objects.zip"))).orderBy("ordinal").collect()
    assert [(r["video"], r["n"], r["ordinal"], r["class_entity"], r["confidence"], r["box"]) for r in rows] == [("L01_V001", 1, 1, "Person", 0.9, [0, 0, 1, 1]), ("L01_V001", 1, 2, "Car", 0.2, [0, 0, 0.5, 1])]
    np.save(tmp_path / "L01_V001.npy", np.arange(6, dtype=np.float16).reshape(2, 3))
    assert [(r["video"], r["n"], r["vector"]) for r in files.read_vectors(spark, str(tmp_path / "L01_V001.npy")).collect()] == [("L01_V001", 1, [0, 1, 2]), ("L01_V001", 2, [3, 4, 5])]
    assert files.inventory(spark, str(tmp_path)).filter("bytes > 0").count() == 3


def test_combined_queries_and_settings():
    assert files.numbered_queries("Query 1:\n a\nQuery 2:\nb\n", 2) == ["a", "b"]
    for text in ("Query 1:\na\n", "Query 1:\na\nQuery 3:\nb\n", "x\nQuery 1:\na\nQuery 2:\nb"):
        with pytest.raises(ValueError):
            files.numbered_queries(text, 2)
    assert files.merged_settings({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}}) == {"a": {"b": 9, "c": 2}, "d": 3}


def test_jobs(spark):
    items = spark.range(120).withColumnRenamed("id", "item")
    shards = jobs.fixed_shards(jobs.dense_index(items, "item", 5), 40)
    assert sorted((r["shard"], r["count"]) for r in shards.groupBy("shard").count().collect()) == [(0, 40), (1, 40), (2, 40)]
    balanced = jobs.balanced_shards(jobs.dense_index(items, "item", 5), 120, 7)
    assert [r["count"] for r in balanced.groupBy("shard").count().orderBy("shard").collect()] == [18, 17, 17, 17, 17, 17, 17]
    assert jobs.dense_index(items.limit(0), "item", 5).count() == 0
    done, failed = items.filter("item < 100"), items.filter("item >= 100")
    assert jobs.terminal_check(items, done, failed, "item").first()["complete"]
    assert not jobs.terminal_check(items, done, failed.filter("item > 100"), "item").first()["complete"]
    with pytest.raises(Exception, match="repeated"):
        jobs.merge([done, done], "item").collect()


def test_streamed_windows(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events"))
    from pyspark.sql import functions as F

    timed = stream.withColumn("at", F.col("ts").cast("timestamp"))
    for name, counted in (("counts", incremental.windowed_counts(timed, "at", "event_type", "1 day")), ("runs", incremental.sessions(timed, "at", "user_id"))):
        query = counted.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        assert 0 < spark.table(name).agg(F.sum("n")).first()[0] <= rows.count()


def test_items_are_handled_once(spark, tmp_path):
    items = spark.createDataFrame([(f"i{k}", str(k)) for k in range(6)], "item_id string, payload string")

    def handler(payload):
        if payload == "3":
            raise ValueError("no three")
        return payload * 2

    path = str(tmp_path / "runs")
    first = jobs.run_items(items.limit(4), handler, path, [])
    second = jobs.run_items(items, handler, path, [first])
    rows = jobs.finished(spark, path, [first, second]).orderBy("item_id").collect()
    assert [r["item_id"] for r in rows] == [f"i{k}" for k in range(6)]
    assert [r["value"] for r in rows if r["state"] == "OK"] == ["00", "11", "22", "44", "55"]
    assert [r["error"] for r in rows if r["state"] == "ERROR"] == ["ValueError: no three"]


def test_unicode_forms(spark):
    from pyspark.sql import functions as F

    from strandwell.functions.unicode import document_text, normalise, stored_forms

    row = spark.createDataFrame([("Cafe\u0301  Đà", None)], "a string, b string")
    got = row.select(normalise("NFC")(F.col("a")).alias("n"), normalise("NFD")(F.col("b")).alias("z"), stored_forms(F.col("a")).alias("f"), document_text({"caption": F.col("a"), "none": F.col("b"), "empty": F.lit(" ")}).alias("d")).first()
    assert got["n"] == "Caf\u00e9  Đà" and got["z"] is None
    assert tuple(got["f"]) == ("Caf\u00e9  Đà", "Caf\u00e9 Đà", "Cafe Da")
    assert got["d"] == "caption: Cafe\u0301  Đà"
