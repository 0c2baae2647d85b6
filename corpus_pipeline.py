"""From raw documents to pieces: the corpus pipeline, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as parquet and read again as the docs of the next
one. All but the last return the columns of documents. Labels come from the labels table of sf_dir.

Defined results, stage by stage:

* quality and toxicity score a null text as an empty one; a row without doc_id is judged and never learnt from; without any usable label all rows stay; repeated rows
  are judged alike.
* near copies: null texts and texts without shingles are classes of their own text; of a class the least doc_id stays (none before others only where all have none), of
  rows that repeat id and text the first by its columns.
* mixture: a null source is a source of its own; a null text has size 0; a row may come twice, and rows that the mix doesn't take go.
* pieces: a null text has no ids; one row for each row.

Empty documents give no rows at every stage; columns beyond those of documents are kept as they are, whatever their names, up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandwell.llm.common import materialise
from strandwell.llm.jaccard_join import one_of_each
from strandwell.llm.mixing import mixed_rows
from strandwell.llm.quality_rff import keep_good
from strandwell.llm.sentencepiece_fst import encode_column
from strandwell.llm.tokenizer_files import tokenizer_path
from strandwell.llm.toxicity_fm import drop_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the least doc_id stays."""
    return one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to meet the weights of their sources."""
    return mixed_rows(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids of every document."""
    return encode_column(docs, tokenizer_path("piece_bpe_32k.model"), ["doc_id", "lang", "source"])


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", pieces),
]

#: Trained models and approximate pruning have no SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
