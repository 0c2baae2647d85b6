"""Evidence windows from ranked hits of several lanes, and their ranking by reciprocal ranks.

Hits are rows of (query_id, provider, evidence_id, video, rank, start, end, anchor), times in seconds. Windows are a left fold over the hits in order of
anchors. Wherever two neighbours are more than `merge` apart a window ends in any case, so a video is first cut into stretches at such gaps (found from the
first and last hit of each minute, not from the hits), which are dealt to tasks, sorted, and folded as a stream: one pass, a state of four numbers.

Defined results: hits without an anchor are windows of their own; a null video or query is one like others; repeated hits of one (query, provider, evidence) count
once; hits of equal anchors are taken by provider, rank and evidence; no hits give no windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MERGE_SEC, SPAN_SEC, RRF_K = 4.0, 12.0, 60
BAD_HIT = "rank < 1 OR start < 0 OR end < start OR anchor < start OR anchor > end"


def checked(hits: DataFrame) -> DataFrame:
    """The hits; a hit with an impossible rank or interval fails the query."""
    return hits.filter(F.when(F.expr(BAD_HIT), F.raise_error(F.concat(F.lit("impossible hit "), F.col("evidence_id").cast("string"))).cast("boolean")).otherwise(True))


def distinct_hits(hits: DataFrame) -> DataFrame:
    """One hit for each query, provider and evidence: the best rank, then the earliest anchor."""
    order = Window.partitionBy("query_id", "provider", "evidence_id").orderBy("rank", "anchor", "video")
    return hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def clamped(hits: DataFrame, span: float = SPAN_SEC) -> DataFrame:
    """With lo and hi: the interval, or half a span around the anchor where it is longer than a span."""
    long = F.col("end") - F.col("start") > span
    return hits.withColumn("lo", F.when(long, F.greatest(F.lit(0.0), F.col("anchor") - span / 2)).otherwise(F.col("start"))).withColumn("hi", F.when(long, F.col("anchor") + span / 2).otherwise(F.col("end")))


def stretches(rows: DataFrame, keys: list[str], time: str, gap: float, width: float, name: str = "stretch") -> DataFrame:
    """The rows with the number of their stretch: within the keys, a stretch begins where a slice of `width` follows more than `gap` after the last row of the one before.

    A run of rows that follow each other within `gap` is never divided. The numbers come from two times of each slice, so a key of very many rows is
    not brought together to find them."""
    cut = rows.withColumn("_slice", F.floor(F.col(time) / width))
    slices = cut.groupBy(*keys, "_slice").agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    order = Window.partitionBy(*keys).orderBy("_slice")
    apart = F.coalesce(F.col("_lo") - F.lag("_hi").over(order) > gap, F.lit(False))
    numbered = slices.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_slice").alias("_number"), F.sum(apart.cast("int")).over(order).alias(name))
    same = F.col("_slice").eqNullSafe(F.col("_number"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return cut.join(numbered, same).drop("_slice", "_number", *[f"_{k}" for k in keys])


def _new_keys(columns: list[pa.Array], last: list | None) -> np.ndarray:
    """Which rows of a sorted batch begin a key; the first does if it differs from `last`."""
    new = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        here, before = c[1:], c[:-1]
        differ = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.xor(pc.is_null(here), pc.is_null(before)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    new[:1] = last is None or [c[0].as_py() for c in columns] != last
    return new


def assign_windows(hits: DataFrame, merge: float = MERGE_SEC, span: float = SPAN_SEC) -> DataFrame:
    """The distinct hits with lo, hi, stretch and window (numbers within query and video, and within the stretch)."""
    rows = stretches(clamped(distinct_hits(hits), span), ["query_id", "video"], "anchor", merge, 60.0)
    keys = ["query_id", "video", "stretch"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "anchor", "provider", "rank", "evidence_id")
    at = [dealt.columns.index(c) for c in (*keys, "anchor", "lo", "hi")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, first, top, last = None, 0, 0.0, 0.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _new_keys([batch.column(i) for i in at[:3]], key)
            key = [batch.column(i)[-1].as_py() for i in at[:3]]
            numbers = []
            for begins, anchor, lo, hi in zip(new.tolist(), *(batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in at[3:]), strict=True):
                if begins:
                    number = 0
                # A missing anchor is not a number, which is near nothing.
                if not begins and anchor - last <= merge and max(top, hi) - min(first, lo) <= span:
                    first, top = min(first, lo), max(top, hi)
                else:
                    number, first, top = number + 1, lo, hi
                last = anchor
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int32())], [*batch.schema.names, "window"])

    return dealt.mapInArrow(fold, T.StructType([*dealt.schema.fields, T.StructField("window", T.IntegerType())]))


def windows(hits: DataFrame, merge: float = MERGE_SEC, span: float = SPAN_SEC, k: int = RRF_K) -> DataFrame:
    """query_id, video, start, end, n_evidence, evidence, evidence_ids, best_rank, representative, kind, lanes, rrf of every window.

    The representative is the best-ranked visual hit, or else the best-ranked one; each lane counts once, with its best rank."""
    rows = assign_windows(hits, merge, span)
    keys = ["query_id", "video", "stretch", "window"]
    lanes = rows.groupBy(*keys, "provider").agg(
        F.min("rank").alias("best"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"), F.collect_list(F.struct("provider", "rank", "evidence_id")).alias("evidence"),
        F.min(F.struct("rank", "anchor", "provider", "evidence_id")).alias("any"), F.min(F.when(F.col("provider") == "visual", F.struct("rank", "evidence_id"))).alias("visual"),
    )
    # In order of lanes, so that sums and lists are the same each time.
    merged = lanes.groupBy(*keys).agg(
        F.round(F.min("lo"), 6).alias("start"), F.round(F.max("hi"), 6).alias("end"), F.sum("n").alias("n_evidence"), F.sort_array(F.flatten(F.collect_list("evidence"))).alias("evidence"),
        F.min("best").alias("best_rank"), F.min("any").alias("any"), F.min("visual").alias("visual"), F.sort_array(F.collect_list(F.struct("provider", "best"))).alias("lanes"),
    )
    names = F.transform("evidence", lambda e: F.concat_ws(":", e["provider"], e["evidence_id"].cast("string")))
    rrf = F.aggregate("lanes", F.lit(0.0), lambda s, lane: s + 1.0 / (k + lane["best"]))
    return merged.select(
        "query_id", "video", "start", "end", "n_evidence", F.concat_ws(",", names).alias("evidence"), names.alias("evidence_ids"), "best_rank", F.coalesce("visual.evidence_id", "any.evidence_id").alias("representative"),
        F.when(F.col("visual").isNotNull(), "visual_keyframe").otherwise("temporal_anchor").alias("kind"), F.concat_ws(",", F.transform("lanes", lambda x: F.concat_ws("=", x["provider"], x["best"].cast("string")))).alias("lanes"), F.round(rrf, 9).alias("rrf"),
    )


def _number(seconds: Column) -> Column:
    """A time of six digits at most as JSON has it: no exponent, no trailing zeros, one digit behind the point at least."""
    return F.regexp_replace(F.round(seconds, 6).cast("decimal(20,6)").cast("string"), r"(\.\d+?)0+$", "$1")


def _quoted(text: Column) -> Column:
    """A text as JSON has it, quotes and escapes included: the one entry of a list, without the brackets."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def window_id(policy: str = "window_policy_v1") -> Column:
    """An id from what makes a window: the digest of its evidence (in order of names), bounds, policy and video as JSON without spaces."""
    said = F.concat(
        F.lit('{"end_sec":'), _number(F.col("end")), F.lit(',"evidence_ids":'), F.to_json(F.array_sort("evidence_ids")), F.lit(f',"policy_version":"{policy}","start_sec":'), _number(F.col("start")),
        F.lit(',"video_id":'), _quoted(F.coalesce(F.col("video").cast("string"), F.lit(""))), F.lit("}"),
    )
    return F.concat(F.lit("ew_"), F.substring(F.sha2(said, 256), 1, 24))


def contract_violations(found: DataFrame, span: float = SPAN_SEC, k: int = RRF_K) -> DataFrame:
    """video, start, code of windows that break the answer's contract: SPAN, NO_EVIDENCE, REPEATED_EVIDENCE, RANK, RRF (recomputed to 1e-9)."""
    names = F.col("evidence_ids")
    ranks = F.transform(F.split("lanes", ","), lambda x: F.element_at(F.split(x, "="), 2).cast("int"))
    again = F.aggregate(ranks, F.lit(0.0), lambda s, r: s + 1.0 / (k + r))
    codes = F.array(
        F.when(~((F.col("end") - F.col("start")).between(0, span)), "SPAN"), F.when(F.coalesce(F.size(names), F.lit(0)) < 1, "NO_EVIDENCE"),
        F.when(F.size(F.array_distinct(names)) < F.size(names), "REPEATED_EVIDENCE"), F.when(F.exists(ranks, lambda r: r.isNull() | (r < 1)), "RANK"), F.when(F.abs(F.col("rrf") - again) > 1e-9, "RRF"),
    )
    return found.select("video", "start", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def rank_windows(found: DataFrame, limit: int) -> DataFrame:
    """The best `limit` windows (1 to 100) of each query by reciprocal ranks, best rank, video, start and id."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "best_rank", "video", "start", "window_id")
    return found.withColumn("window_id", window_id()).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def session_dedup(hits: DataFrame, keys: list[str], gap_ms: int = 1000) -> DataFrame:
    """One hit for each run of hits whose starts follow each other within `gap_ms`: the best rank, the earliest among equals.

    Runs are found within stretches, so a key of very many hits is divided where it pauses."""
    cut = stretches(hits, keys, "start_ms", gap_ms, 60 * max(1000, gap_ms), "_stretch")
    order = Window.partitionBy(*keys, "_stretch").orderBy("start_ms", "native_rank")
    new = F.coalesce(F.col("start_ms") - F.lag("start_ms").over(order) > gap_ms, F.lit(False))
    marked = cut.withColumn("_run", F.sum(new.cast("int")).over(order))
    best = Window.partitionBy(*keys, "_stretch", "_run").orderBy("native_rank", "start_ms", "evidence_id")
    return marked.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "_run", "_stretch")
