"""op1: every text stored in an MPEG audio stream and read back."""

from pyspark.sql import DataFrame, SparkSession

from strandwell.llm.media_mpeg import read_streams, store_column

NAME = "op1_mpeg_audio"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_streams(store_column(spark.read.parquet(f"{sf_dir}/documents.parquet")))
