"""op5: the tokens of every text."""

from pyspark.sql import DataFrame, SparkSession

from strandwell.llm.token_counts import count_tokens
from strandwell.llm.tokenizer_files import tokenizer_path

NAME = "op5_token_counts"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
