"""op9: every text encoded to pieces and decoded again."""

from pyspark.sql import DataFrame, SparkSession

from strandwell.llm.sentencepiece_fst import round_trips
from strandwell.llm.tokenizer_files import tokenizer_path

NAME = "op9_sentencepiece"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"))
