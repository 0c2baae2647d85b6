"""Evaluation runs that can be taken up again: questions are answered part by part, each part is stored whole, and a contract says what the run is about.

A run lives in one folder. Its contract holds the digests of the questions, of the configuration and of whatever indexes answer; a run that is taken up with
another contract is refused. Parts (a hash of the question's id, so that they are the same each time) are answered set at a time by a function over DataFrames;
an answer is written with the time that it took, and published by one rename. Parts that are there are not answered again. When all are, scores, the
summary and a manifest with digests are stored in the same way, and a finished run only checks itself.

Defined results: a part whose answer fails is kept as an error of each of its questions, with no predictions; a question without predictions is scored as such; a
question that is there twice fails the run; no questions give a run of no parts.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwell.sources.store import Files, digests

#: (questions of a part) -> predictions (query_id, rank, and what scorers need)
Answer = Callable[[DataFrame], DataFrame]
#: (questions, predictions) -> a row for each question, with query_id
Score = Callable[[DataFrame, DataFrame], DataFrame]


class ContractError(ValueError):
    """The folder holds another run, or one that was changed."""


@dataclass(frozen=True)
class Run:
    """A finished run: predictions, scores by question, and the summary (one row)."""

    predictions: DataFrame
    scores: DataFrame
    summary: DataFrame
    answered: int


def digest_of(table: DataFrame) -> str:
    """A digest of a table's rows, whatever their order."""
    row = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(table.columns)]).cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}:{row['h']}"


def contract_of(questions: DataFrame, config: dict, indexes: dict[str, str], parts: int) -> dict:
    said = json.dumps(config, sort_keys=True, ensure_ascii=False)
    return {"questions": digest_of(questions), "config": hashlib.sha256(said.encode()).hexdigest(), "indexes": json.dumps(indexes, sort_keys=True), "parts": parts}


def _stored(spark: SparkSession, files: Files, path: str, write: Callable[[str], None]) -> None:
    """What `write` writes, at `path`, whole or not at all."""
    began = f"{path.rpartition('/')[0]}/.began-{uuid.uuid4().hex}"
    try:
        write(began)
        if not files.publish(began, path) and not files.exists(path):
            raise OSError(f"{path} can't be published")
    finally:
        if files.exists(began):
            files.remove(began)


def _held_to(spark: SparkSession, files: Files, path: str, contract: dict) -> None:
    """Writes the contract of a new run; refuses a folder with another."""
    if not files.exists(f"{path}/contract"):
        if files.exists(f"{path}/answers"):
            raise ContractError(f"{path} holds answers without a contract")
        row = spark.createDataFrame([(json.dumps(contract, sort_keys=True),)], "contract string")
        _stored(spark, files, f"{path}/contract", lambda p: row.coalesce(1).write.parquet(p))
    there = json.loads(spark.read.parquet(f"{path}/contract").first()["contract"])
    if there != contract:
        other = sorted(k for k in contract if there.get(k) != contract[k])
        raise ContractError(f"{path} holds a run with other {', '.join(other)}")


def run(questions: DataFrame, config: dict, answer: Answer, score: Score, path: str, indexes: dict[str, str] | None = None, parts: int = 8, most: int | None = None) -> Run | None:
    """Answers, scores and sums up the questions (query_id, ...) in the folder `path`; with `most`, answers that many parts and returns None if some are left."""
    spark = questions.sparkSession
    files = Files(spark, path)
    contract = contract_of(questions, config, indexes or {}, parts)
    _held_to(spark, files, path, contract)
    if not files.exists(f"{path}/done"):
        if questions.groupBy("query_id").count().filter("count > 1").limit(1).count():
            raise ContractError("a query_id stands twice")
        dealt = questions.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
        left = [p for p in range(parts) if not files.exists(f"{path}/answers/part={p}")]
        for part in left[:most]:
            _answer(spark, files, dealt.filter(F.col("_part") == part).drop("_part"), answer, f"{path}/answers/part={part}")
        if most is not None and len(left) > most:
            return None
        _finish(spark, files, questions, score, path, parts)
    bad = violations(spark, path).limit(1).count()
    if bad:
        raise ContractError(f"{path} was changed after it was finished")
    read = lambda name: spark.read.parquet(f"{path}/done/{name}")
    return Run(read("predictions"), read("scores"), read("summary"), spark.read.parquet(f"{path}/done/scores").count())


def _answer(spark: SparkSession, files: Files, asked: DataFrame, answer: Answer, path: str) -> None:
    def write(to: str) -> None:
        n, began = asked.count(), time.perf_counter()
        status, error = "OK", None
        try:
            answer(asked).write.parquet(f"{to}/predictions")
        except Exception as failure:  # kept as the result of the part's questions
            status, error = "ERROR", f"{type(failure).__name__}: {str(failure)[:500]}"
            if files.exists(f"{to}/predictions"):
                files.remove(f"{to}/predictions")
        took = (time.perf_counter() - began) * 1000 / max(1, n)
        asked.select("query_id", F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"), F.lit(took).alias("latency_ms")).write.parquet(f"{to}/states")

    _stored(spark, files, path, write)


def _finish(spark: SparkSession, files: Files, questions: DataFrame, score: Score, path: str, parts: int) -> None:
    here = [f"{path}/answers/part={p}" for p in range(parts)]
    states = spark.read.schema("query_id " + questions.schema["query_id"].dataType.simpleString() + ", status string, error string, latency_ms double").parquet(*[f"{p}/states" for p in here])
    told = [f"{p}/predictions" for p in here if files.exists(f"{p}/predictions") and files.size(f"{p}/predictions")]

    def write(to: str) -> None:
        answered = states.filter("status = 'OK'").select("query_id")
        if told:
            predictions = spark.read.parquet(*told)
            predictions.write.parquet(f"{to}/predictions")
            scored = score(questions.join(answered, "query_id", "left_semi"), predictions)
        else:
            spark.createDataFrame([], "query_id string, rank int").write.parquet(f"{to}/predictions")
            scored = questions.select("query_id").limit(0)
        states.join(scored, "query_id", "left").write.parquet(f"{to}/scores")
        rows = spark.read.parquet(f"{to}/scores")
        names = [c for c in rows.columns if c.startswith("r_at_")]
        summary = rows.agg(
            F.count("*").alias("questions"), F.count_if(F.col("status") == "OK").alias("answered"), F.count_if(F.col("status") == "ERROR").alias("failed"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in names],
            F.percentile("latency_ms", 0.5).alias("latency_p50"), F.percentile("latency_ms", 0.95).alias("latency_p95"), F.avg("latency_ms").alias("latency_mean"),
        )
        summary.coalesce(1).write.parquet(f"{to}/summary")
        digests(spark, to).coalesce(1).write.parquet(f"{to}/manifest")

    _stored(spark, files, f"{path}/done", write)


def violations(spark: SparkSession, path: str) -> DataFrame:
    """part, code of a finished run whose files aren't those of its manifest: MISSING, UNKNOWN, ROWS, DIGEST."""
    told = spark.read.parquet(f"{path}/done/manifest")
    now = digests(spark, f"{path}/done").select("part", F.col("rows").alias("rows_now"), F.col("digest").alias("digest_now"))
    code = F.when(F.col("rows_now").isNull(), "MISSING").when(F.col("rows").isNull(), "UNKNOWN").when(F.col("rows") != F.col("rows_now"), "ROWS").when(F.col("digest") != F.col("digest_now"), "DIGEST")
    return told.join(now, "part", "full").select("part", code.alias("code")).filter("code IS NOT NULL")
