"""op3: every document with its class of near copies and its number of links."""

from pyspark.sql import DataFrame, SparkSession

from strandwell.llm.jaccard_join import similarity_classes

NAME = "op3_jaccard_join"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "copies", "text_links", "n_links")
