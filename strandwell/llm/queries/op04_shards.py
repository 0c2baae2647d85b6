"""op4: the token sequences of every text, written in training order and read back."""

from pyspark.sql import DataFrame, SparkSession

from strandwell.llm.token_shards import read_shards, write_shards
from strandwell.llm.tokenizer_files import tokenizer_path

NAME = "op4_token_shards"
KEY = 0x5EED_0F_0DE2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(spark, write_shards(docs, tokenizer_path("byte_bpe_50k.tiktoken"), KEY))
