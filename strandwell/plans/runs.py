"""A resumed evaluation run over all users, and a table kept by a log of changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwell.operators import evaluate as E
from strandwell.operators import runner as R
from strandwell.plans.evaluation import _KIS, _predictions, _truth
from strandwell.sources.store import shared_dir
from strandwell.sources.tables import table
from strandwell.streaming.delta_log import UpsertedTable


def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user is a question. The run is cut off after three parts of eight and taken up again."""
    path = f"{shared_dir(spark)}/strandwell-runs/{uuid.uuid4().hex}"
    questions, config = _truth(spark, sf_dir), {"lane": "events", "k": 100}

    def answer(asked: DataFrame) -> DataFrame:
        return _predictions(spark, sf_dir).join(asked.select("query_id"), "query_id", "left_semi")

    first = R.run(questions, config, answer, E.frame_recall, path, most=3)
    done = first or R.run(questions, config, answer, E.frame_recall, path)
    return done.scores.drop("latency_ms", "error")


def upsert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order, from four batches of changes, of which the first two are compacted."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    kept = UpsertedTable(spark, f"{shared_dir(spark)}/strandwell-upserts/{uuid.uuid4().hex}", orders.schema, "o_custkey", "o_orderkey", 16)
    for batch in range(4):
        kept.write_batch(orders.filter(F.col("o_orderkey") % 4 == batch), batch)
        if batch == 1:
            kept.compact()
    return kept.read()


QUERIES = {"evaluation_run": evaluation_run, "upsert_log": upsert_log}

ORACLES = {
    "evaluation_run": f"WITH {_KIS} SELECT *, 'OK' AS status FROM k",
    "upsert_log": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1",
}
