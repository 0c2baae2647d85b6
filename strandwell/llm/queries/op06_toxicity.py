"""op6: toxicity of every text."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwell.llm.toxicity_fm import classify

NAME = "op6_toxicity"


def held_out():
    """The rows that labels are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels, ~held_out()).select("doc_id", held_out().alias("held_out"), "score", "predicted")
