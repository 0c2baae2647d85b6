"""Runs that are taken up again, and tables that merge when they are read."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from strandwell.operators import evaluate, runner
from strandwell.streaming.delta_log import UpsertedTable, keep_upserted

SCHEMA = "key int, version int, value string"


def questions(spark, n=40):
    rows = [(i, f"V{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, "query_id int, gt_video string").withColumn("ranges", F.array(F.struct(F.lit(0).alias("lo"), F.lit(5).alias("hi"))))


def answers(log):
    def answer(asked):
        log.append(asked.count())
        return asked.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank")).select("query_id", "rank", F.concat(F.lit("V"), F.col("rank") - 1).alias("video"), (F.col("query_id") % 9).alias("frame"))

    return answer


def shown(run):
    return sorted(map(str, run.scores.drop("latency_ms").collect())), sorted(map(str, run.predictions.collect())), run.summary.drop("latency_p50", "latency_p95", "latency_mean").first()


def test_an_interrupted_run_ends_like_a_whole_one(spark, tmp_path):
    asked, config = questions(spark), {"k": 4, "model": "none"}
    whole = runner.run(asked, config, answers([]), evaluate.frame_recall, str(tmp_path / "whole"))
    log = []
    assert runner.run(asked, config, answers(log), evaluate.frame_recall, str(tmp_path / "cut"), most=3) is None and len(log) == 3
    assert runner.run(asked, config, answers(log), evaluate.frame_recall, str(tmp_path / "cut"), most=2) is None and len(log) == 5
    again = runner.run(asked, config, answers(log), evaluate.frame_recall, str(tmp_path / "cut"))
    assert shown(again) == shown(whole) and len(log) == 8 and sum(log) == 40
    summary = again.summary.first()
    assert summary["questions"] == summary["answered"] == 40 and summary["latency_p50"] <= summary["latency_p95"]
    # Finished: nothing is answered again.
    assert shown(runner.run(asked, config, answers(log), evaluate.frame_recall, str(tmp_path / "cut"))) == shown(whole) and len(log) == 8


def test_another_contract_is_refused(spark, tmp_path):
    asked, path = questions(spark), str(tmp_path / "r")
    runner.run(asked, {"k": 1}, answers([]), evaluate.frame_recall, path, most=1)
    for other, config, indexes in ((asked, {"k": 2}, {}), (asked.limit(39), {"k": 1}, {}), (asked, {"k": 1}, {"words": "v2"})):
        with pytest.raises(runner.ContractError, match="another run|other"):
            runner.run(other, config, answers([]), evaluate.frame_recall, path, indexes)
    with pytest.raises(runner.ContractError, match="twice"):
        runner.run(asked.unionByName(asked), {"k": 1}, answers([]), evaluate.frame_recall, str(tmp_path / "twice"))


def test_failures_are_kept_and_damage_is_found(spark, tmp_path):
    asked, path, calls = questions(spark), str(tmp_path / "r"), []

    def sometimes(part):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lane gone")
        return answers([])(part)

    found = runner.run(asked, {}, sometimes, evaluate.frame_recall, path, parts=4)
    summary, failed = found.summary.first(), found.scores.filter("status = 'ERROR'").collect()
    assert summary["failed"] == len(failed) > 0 and summary["answered"] + summary["failed"] == 40
    assert all(r["error"] == "RuntimeError: lane gone" and r["first_rank"] is None for r in failed)
    part = glob.glob(f"{path}/done/scores/*.parquet")[0]
    found.scores.limit(1).coalesce(1).write.parquet(str(tmp_path / "x"))
    os.replace(glob.glob(f"{tmp_path}/x/*.parquet")[0], part)
    for crc in glob.glob(f"{path}/done/scores/.*.crc"):
        os.remove(crc)
    with pytest.raises(runner.ContractError, match="changed"):
        runner.run(asked, {}, sometimes, evaluate.frame_recall, path, parts=4)


def test_no_questions(spark, tmp_path):
    found = runner.run(questions(spark).limit(0), {}, answers([]), evaluate.frame_recall, str(tmp_path / "none"), parts=2)
    assert found.answered == 0 and found.summary.first()["questions"] == 0


def latest(rows):
    out = {}
    for batch, changes in enumerate(rows):
        for key, version, value in changes:
            out[key] = max(out.get(key, (-1, -1, "")), (version, batch, value))
    return {k: (v, x) for k, (v, _, x) in out.items()}


def test_reads_equal_the_changes_before_and_after_compaction(spark, tmp_path):
    rng = random.Random(0)
    batches = [[(rng.choice([*range(30), None]), rng.randrange(6), f"b{b}-{i}") for i in range(25)] for b in range(5)] + [[(1, 3, "hot")] * 200 + [(1, 9, "top")]]
    schema = spark.createDataFrame([], SCHEMA).schema
    table = UpsertedTable(spark, str(tmp_path / "t"), schema, "key", "version", 8)
    assert table.read().count() == 0 and table.compact() == []
    got = lambda: {r["key"]: (r["version"], r["value"]) for r in table.read().collect()}
    for number, rows in enumerate(batches):
        table.write_batch(spark.createDataFrame(rows, SCHEMA), number)
        want = latest(batches[: number + 1])
        assert got() == want and table.read().count() == len(want)
        if number in (2, 4):
            table.compact()
            assert got() == want and table.batches() == []
    # The last batch has one key: it wrote one bucket, and its compaction rewrites that one alone.
    assert len(glob.glob(f"{tmp_path}/t/log/batch=5/bucket=*")) == 1
    before = table.state()["base"]
    changed = table.compact()
    after = table.state()["base"]
    assert len(changed) == 1 and {b for b in after if after[b] != before.get(b)} == {str(changed[0])} and got() == latest(batches)
    # A batch that the base holds is not counted again.
    table.write_batch(spark.createDataFrame([(1, 99, "late")], SCHEMA), 3)
    assert got() == latest(batches) and table.expire() and got() == latest(batches)


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    table = UpsertedTable(spark, str(tmp_path / "t"), schema, "key", "version", 4)
    for value in ("half", "whole"):
        table.write_batch(spark.createDataFrame([(1, 1, value)], SCHEMA), 0)
    assert [tuple(r) for r in table.read().collect()] == [(1, 1, "whole")]


def test_streamed_changes_equal_a_batch(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    table = UpsertedTable(spark, str(tmp_path / "t"), schema, "key", "version", 4)
    batches = [[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (3, 1, "d")], [(1, 1, "old"), (2, 5, "e")]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        keep_upserted(stream, table, str(tmp_path / "checkpoint"), 2).awaitTermination()
    assert {r["key"]: (r["version"], r["value"]) for r in table.read().collect()} == latest(batches) and table.state()["upto"] >= 1
