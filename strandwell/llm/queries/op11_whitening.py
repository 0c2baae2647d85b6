"""op11: every vector by its first 16 whitened components."""

from pyspark.sql import DataFrame, SparkSession

from strandwell.llm.svd_whitening import whiten

NAME = "op11_whitening"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
