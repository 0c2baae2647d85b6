"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source gets a share of the mix by its weight; a source whose share passes `max_epochs` times its size is clamped
there and the excess goes to the others by weight until no source is above its cap. The fixed point of these rounds has a
closed form: with sources in order of cap/weight, some prefix is clamped and all others get the same amount per unit of weight.
Within a source, whole repetitions are taken of every document; the fractional one is taken along a seeded order of the
documents until the source's target is met, the document on the boundary in part.

Scale: one aggregation over the documents, combined before its shuffle, by source and by one of `BUCKETS` ranges of the
seeded hash. Rows are ordered within one such range only, so no task ever orders a whole source.

Defined results: a null text has size 0; null sources form one source, the last; sizes of 0 take 0 words; no
rows give no rows; rows of equal doc_id and size are interchangeable. Columns beyond doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwell.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
SEED = 20_240_607
#: Sources, one small row each, up to which their list is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    """The number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(order: Column, weights: tuple[int, ...]) -> Column:
    """The weights, repeating along a rank that starts at 1."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((order - 1) % len(weights) + 1).cast("int"))


def water_fill(sources: DataFrame, budget_ratio: float, max_epochs: float, weights: tuple[int, ...]) -> DataFrame:
    """key, source, source_size -> key, source_size, weight, cap, target: min(cap, level * weight), the level such that targets add up to the budget.

    `sources` has a row for each source, so its windows order the mixing list, not documents."""
    ordered = sources.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ordered.select("key", "source_size", cyclic_weights(F.col("_n"), weights).alias("weight"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"), "_n")
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "_n")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(budget_ratio))).alias("budget"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
        F.row_number().over(by_ratio).alias("_r"),
    )
    # In order of cap/weight a source is clamped while its cap is at most its share of what those before it leave.
    share = F.col("weight") * (F.col("budget") - F.col("cap_before")) / F.col("weight_left")
    marked = filled.withColumn("_open", F.col("cap") > share)
    level = F.min(F.when(F.col("_open"), F.struct("_r", "budget", "cap_before", "weight_left"))).over(everything)
    solved = marked.withColumn("_level", level)
    open_target = F.col("weight") * (F.col("_level.budget") - F.col("_level.cap_before")) / F.col("_level.weight_left")
    target = F.when(F.col("_level").isNull() | (F.col("_r") < F.col("_level._r")), F.col("cap")).otherwise(open_target)
    return solved.select("key", "source_size", "weight", "cap", target.alias("target"))


def _sizes(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, order, bucket, key of every row, written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"))
    return materialise(_ordered(rows, seed), "mix-sizes")


def _ordered(rows: DataFrame, seed: int) -> DataFrame:
    """With the seeded place of each row within its source; the key tells the null source from the empty one."""
    digits = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string")))
    rows = rows.withColumn("order", F.conv(F.substring(digits, 1, 15), 16, 10).cast("long"))
    rows = rows.withColumn("bucket", F.pmod(F.col("order"), F.lit(BUCKETS)).cast("int"))
    return rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))


def _taken(rows: DataFrame, budget_ratio: float, max_epochs: float, weights: tuple[int, ...]) -> DataFrame:
    """The rows with source_size, target, epochs (whole repetitions of the source) and more (words beyond these)."""
    buckets = rows.groupBy("key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size"))
    sources = buckets.groupBy("key").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    plan = water_fill(sources, budget_ratio, max_epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", whole).withColumn("extra", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("key", "bucket", "bucket_size", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start"))
    # A row for each source and hash range: at most BUCKETS times the sources, whatever the number of documents.
    spans = starts.join(plan.select("key", "source_size", "target", "epochs", "extra"), "key")
    placed = rows.join(spans, ["key", "bucket"])
    inside = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("extra") - F.col("bucket_start") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    return placed.withColumn("more", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)))


def mix(docs: DataFrame, budget_ratio: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, whole, taken of every document.

    `whole` counts full repetitions, `taken` words; the words over whole * size come from the boundary document of the source.
    The taken words of a source add up to its target, rounded."""
    taken = _taken(_sizes(docs, seed), budget_ratio, max_epochs, weights)
    whole_copies = F.col("epochs") + ((F.col("more") >= F.col("size")) & (F.col("size") > 0)).cast("long")
    words_taken = F.col("epochs") * F.col("size") + F.col("more")
    return taken.select("doc_id", "source", "size", "source_size", "target", whole_copies.alias("whole"), words_taken.alias("taken"))


def mixed_rows(docs: DataFrame, budget_ratio: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it whole; texts of no words stay once.

    The boundary document of a source, of which the mix takes a part, is taken once more if that part is half of it or more.
    Whether a row is taken once more follows from its place in the seeded order and the place where its source's extra words
    end, so texts are not shuffled. Repeated rows share a place."""
    taken = _taken(_sizes(docs, seed), budget_ratio, max_epochs, weights)
    place = F.struct("bucket", "order", "doc_id", "size")
    ends = taken.groupBy("key").agg(F.max("epochs").alias("epochs"), F.max(F.when((F.col("size") > 0) & (2 * F.col("more") >= F.col("size")), place)).alias("end"))
    ends = materialise(ends, "mix-ends").withColumnRenamed("key", "k")
    few = ends.count() <= BROADCAST_SOURCES
    size, kept = words(F.col("text").cast("string")), docs.columns
    rows = docs.select(F.struct(*[F.col(c) for c in kept]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    met = _ordered(rows, seed).join(F.broadcast(ends) if few else ends, F.col("key") == F.col("k"))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("epochs").cast("int") + F.coalesce((place <= F.col("end")).cast("int"), F.lit(0)))
    repeated = met.select("row", F.explode(F.array_repeat(F.lit(0), copies)).alias("_"))
    return repeated.select("row.*")
