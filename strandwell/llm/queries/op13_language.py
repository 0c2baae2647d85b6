"""op13: the language of every text."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwell.llm.language_id import identify

NAME = "op13_language_id"


def held_out():
    """The rows that languages are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
