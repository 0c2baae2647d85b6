"""Temporal sequences: chains of hits of 2 to 5 steps within a video.

For every choice of steps, longest first, chains of hits of the chosen steps are built within their video under the rules of order, gap and span.
Of each video the first chains in the order of enumeration are kept (by choice of steps, then by the hits' places), before anything is ranked;
a hit alone counts only where its video has no longer chain.

A video is cut into slices of time no shorter than a chain can reach. A slice owns the chains that begin in it and sees the hits that these can go on
with, so a video of very many hits is divided over tasks. A task reads its slices as a sorted stream, builds chains in the order of enumeration and stops when
a slice has enough, so that nothing is joined that isn't kept; ends that lead nowhere are remembered, so the search stays small where no
chain is found. The first chains over all slices are then chosen by choice, slice and number.

`diagnose` says why there are few chains, from counts alone: pairs of hits are never formed except for the span.

Defined results: hits with a null video are one video; hits with null times make no chain; repeated hits are one run of hits; no hits give no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwell.operators.fusion import session_dedup


def group_of(indices: tuple[int, ...], total: int) -> str:
    """FULL, PREFIX, SUFFIX, PARTIAL or STEP_ONLY for the matched steps."""
    if len(indices) == total:
        return "FULL"
    if len(indices) == 1:
        return "STEP_ONLY"
    if indices[-1] - indices[0] == len(indices) - 1:
        return "PREFIX" if indices[0] == 0 else "SUFFIX" if indices[-1] == total - 1 else "PARTIAL"
    return "PARTIAL"


Hit = tuple[int, int, int, int]  # start, end, rank, evidence


def chains(steps: list[list[Hit]], strict: bool, min_gap: int, max_gap: int, max_span: int | None) -> Iterator[tuple[int, ...]]:
    """The chains over the steps' hits (each in order), as places, in the order of the places."""
    total, dead = len(steps), set()

    def go(depth: int, last: int, first: int, top: int) -> Iterator[tuple[int, ...]]:
        if depth == total:
            yield ()
            return
        state = (depth, last if strict else 0, first, top)
        if state in dead:
            return
        found = False
        hits = steps[depth]
        begin = bisect_left(hits, last + max(0, min_gap), key=lambda h: h[0]) if strict and depth else 0
        for k in range(begin, len(hits)):
            start, end, *_ = hits[k]
            if strict and depth and start - last > max_gap:
                break
            low, high = (min(first, start), max(top, end)) if depth else (start, end)
            if max_span is not None and high - low > max_span:
                continue
            for rest in go(depth + 1, end, low, high):
                found = True
                yield (k, *rest)
        if not found:
            dead.add(state)

    return go(0, 0, 0, 0)


CHAINS = "case_id {case}, video {video}, slice long, choice int, number int, first long, top long, ranks int, worst int, gaps long, evidence string, matched int, steps string, match_group string"
SLICE_MS = 60_000


def _sliced(steps: DataFrame, reach: int | None, back: int) -> DataFrame:
    """Every hit once for each slice whose chains it can be in, with `own` where a chain that begins with it belongs to the slice.

    A slice owns the chains whose first hit starts in it. Their other hits start no more than `reach` after that hit and `back` before
    it, so slices of that width or more need each hit in three slices at most. Without a reach there is one slice."""
    if reach is None:
        return steps.withColumn("slice", F.lit(0).cast("long")).withColumn("own", F.lit(True))
    width = max(reach, back, SLICE_MS)
    at = lambda ms: F.floor(ms / F.lit(width)).cast("long")
    here = F.sequence(at(F.col("start_ms") - reach), at(F.col("start_ms") + back))
    return steps.withColumn("slice", F.explode(here)).withColumn("own", F.col("slice") == at(F.col("start_ms")))


def _enumerated(sliced: DataFrame, total: int, strict: bool, min_gap: int, max_gap: int, max_span: int | None, per_video: int) -> DataFrame:
    """The first `per_video` chains of every choice of steps in each slice of a case and video, until a slice has enough of them."""
    choices = [c for n in range(total, 0, -1) for c in combinations(range(total), n)]
    keys = ["case_id", "video", "slice"]
    names = [*keys, "step_index", "own", "start_ms", "end_ms", "native_rank", "evidence_id"]
    kinds = dict(sliced.dtypes)
    schema = CHAINS.format(case=kinds["case_id"], video=kinds["video"])

    def found(key: tuple, by_step: list[list[Hit]], own: list[list[Hit]]) -> list[tuple]:
        rows: list[tuple] = []
        for at, choice in enumerate(choices):
            # A single hit counts only where the video has no longer chain.
            if len(rows) >= per_video or (len(choice) == 1 and rows and rows[0][-3] > 1):
                break
            mine = [own[choice[0]], *(by_step[k] for k in choice[1:])]
            if not all(mine):
                continue
            for number, places in enumerate(islice(chains(mine, strict, min_gap, max_gap, max_span), per_video - len(rows)), 1):
                hits = [h[k] for h, k in zip(mine, places, strict=True)]
                gaps = sum(b[0] - a[1] for a, b in zip(hits, hits[1:], strict=False))
                ranks, worst = sum(h[2] for h in hits), max(h[2] for h in hits)
                named = ",".join(str(h[3]) for h in hits)
                rows.append((*key, at, number, min(h[0] for h in hits), max(h[1] for h in hits), ranks, worst, gaps, named, len(choice), ",".join(map(str, choice)), group_of(choice, total)))
        return rows

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, by_step, own, out = None, [], [], []
        fields = None
        for batch in batches:
            fields = fields or pa.schema([*(batch.schema.field(k) for k in keys), *CHAIN_FIELDS])
            for case, video, piece, step, mine, *hit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (case, video, piece) != key:
                    out += found(key, by_step, own) if key else []
                    key, by_step, own = (case, video, piece), [[] for _ in range(total)], [[] for _ in range(total)]
                if 0 <= step < total:
                    by_step[step].append(tuple(hit))
                    if mine:
                        own[step].append(tuple(hit))
            if len(out) >= 10_000:
                yield _columns(out, fields)
                out = []
        out += found(key, by_step, own) if key else []
        if out:
            yield _columns(out, fields)

    dealt = sliced.select(*names).repartition(*keys).sortWithinPartitions(*keys, "step_index", "start_ms", "native_rank", "evidence_id")
    return dealt.mapInArrow(build, schema)


CHAIN_FIELDS = [pa.field(n, k) for n, k in (
    ("choice", pa.int32()), ("number", pa.int32()), ("first", pa.int64()), ("top", pa.int64()), ("ranks", pa.int32()), ("worst", pa.int32()), ("gaps", pa.int64()),
    ("evidence", pa.string()), ("matched", pa.int32()), ("steps", pa.string()), ("match_group", pa.string()),
)]


def _columns(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


def match(
    hits: DataFrame, total: int, strict: bool = True, min_gap: int = 0, max_gap: int = 60_000, max_span: int | None = None, per_video: int = 5, per_group: int = 50, dedup_ms: int = 1000
) -> DataFrame:
    """case_id, match_group, place, video, steps, matched, evidence, ranks, worst, span, gaps of the chains kept.

    `hits` are rows of (case_id, step_index from 0, video, start_ms, end_ms, native_rank, evidence_id)."""
    if not 2 <= total <= 5 or min_gap < 0 or max_gap < min_gap or (max_span is not None and max_span <= 0):
        raise ValueError("2 to 5 steps, 0 <= min_gap <= max_gap, max_span above 0")
    keys = ["case_id", "step_index", "video"]
    steps = session_dedup(hits.filter("start_ms IS NOT NULL AND end_ms IS NOT NULL"), keys, dedup_ms)
    if strict:
        # Hits of a chain follow each other within the gap and the longest hit.
        longest = hits.agg(F.max(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("d")).first()["d"] or 0
        reach = (total - 1) * (max_gap + longest)
        reach, back = min(reach, max_span) if max_span is not None else reach, 0
    else:
        reach = back = max_span
        if max_span is None:
            # Every combination is a chain, so no step gives more hits than there are chains.
            place = F.row_number().over(Window.partitionBy(*keys).orderBy("start_ms", "native_rank", "evidence_id"))
            steps = steps.withColumn("_pos", place).filter(F.col("_pos") <= per_video)
    each = _enumerated(_sliced(steps, reach, back or 0), total, strict, min_gap, max_gap, max_span, per_video)
    order = Window.partitionBy("case_id", "video").orderBy("choice", "slice", "number")
    kept = each.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_video)
    longer = F.max("matched").over(Window.partitionBy("case_id", "video"))
    numbered = kept.withColumn("_longest", longer).filter((F.col("matched") > 1) | (F.col("_longest") == 1)).drop("number").withColumnRenamed("_n", "number")
    span = (F.col("top") - F.col("first")).alias("span")
    rank = Window.partitionBy("case_id", "match_group").orderBy(F.col("matched").desc(), "ranks", "worst", F.col("top") - F.col("first"), "gaps", "video", "first", F.col("number").cast("string"))
    ranked = numbered.withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= per_group)
    return ranked.select("case_id", "match_group", "place", "video", "steps", "matched", "evidence", "ranks", "worst", span, "gaps")


RULES = ("ORDER_VIOLATION", "GAP_TOO_SMALL", "GAP_TOO_LARGE", "MAX_SPAN_VIOLATION")
FAILED = ("ERROR", "UNAVAILABLE", "INVALID_CONFIG")


def _before(events: DataFrame, keys: list[str], width: int) -> DataFrame:
    """For the events of (keys, at, hit: 1 or 0, ...) that are no hits: how many hits of their keys lie before them.

    Hits of earlier slices are counted by slice, those of the event's own slice by a window over it, so no key is brought together."""
    cut = events.withColumn("_slice", F.floor(F.col("at") / width))
    slices = cut.groupBy(*keys, "_slice").agg(F.sum("hit").alias("_h"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = slices.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_slice").alias("_number"), F.coalesce(F.sum("_h").over(earlier), F.lit(0)).alias("_earlier"))
    same = F.col("_slice") == F.col("_number")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    # At equal times the question stands before the hit.
    inside = Window.partitionBy(*keys, "_slice").orderBy("at", "hit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = cut.withColumn("_inside", F.sum("hit").over(inside)).filter("hit = 0")
    return asked.join(sums, same).withColumn("before", F.col("_inside") + F.col("_earlier")).drop("_slice", "_number", "_earlier", "_inside", *[f"_{k}" for k in keys])


def diagnose(hits: DataFrame, chains_found: DataFrame, statuses: DataFrame, total: int, min_gap: int = 0, max_gap: int = 60_000, max_span: int | None = None, dedup_ms: int = 1000) -> DataFrame:
    """case_id, videos, multi_step_videos, order_violations, gap_too_small, gap_too_large, span_violations, chains, status: one row for each case of `statuses`.

    Violations are pairs of hits of two steps that follow each other, in one video: the second begins before the first ends, less than `min_gap` or more
    than `max_gap` after it, or, where these hold, the two span more than `max_span`. `statuses` has (case_id, step_index, status) of the steps'
    searches: ERROR where steps failed and none succeeded, PARTIAL where some failed or nothing was found, OK else."""
    keys = ["case_id", "video", "step_index"]
    steps = session_dedup(hits.filter("start_ms IS NOT NULL AND end_ms IS NOT NULL"), ["case_id", "step_index", "video"], dedup_ms).select(*keys, "start_ms", "end_ms")
    by_video = steps.groupBy("case_id", "video").agg(F.countDistinct("step_index").alias("s")).groupBy("case_id")
    videos = by_video.agg(F.count("*").alias("videos"), F.count_if(F.col("s") > 1).alias("multi_step_videos"))
    # A step's hits as the second of a pair, and the three times that each hit of the step before asks about.
    second = steps.filter("step_index > 0").select("case_id", "video", (F.col("step_index") - 1).alias("step_index"), F.col("start_ms").alias("at"), F.lit(1).alias("hit"), F.lit(0).alias("ask"))
    times = F.array(*[F.struct(F.lit(i).alias("ask"), (F.col("end_ms") + d).alias("at")) for i, d in enumerate((0, min_gap, max_gap + 1))])
    first = steps.filter(F.col("step_index") < total - 1).select(*keys, F.explode(times).alias("t")).select(*keys, F.col("t.at").alias("at"), F.lit(0).alias("hit"), F.col("t.ask").alias("ask"))
    counted = _before(second.unionByName(first), keys, max(max_gap, SLICE_MS)).groupBy(*keys).pivot("ask", [0, 1, 2]).agg(F.sum("before"))
    sizes = second.groupBy(*keys).agg(F.count("*").alias("_b")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_b")
    ones = first.filter("ask = 0").groupBy(*keys).agg(F.count("*").alias("_a")).select(*[F.col(k).alias(f"__{k}") for k in keys], "_a")
    same = lambda mark: F.col("case_id").eqNullSafe(F.col(f"{mark}case_id")) & F.col("video").eqNullSafe(F.col(f"{mark}video")) & (F.col("step_index") == F.col(f"{mark}step_index"))
    pairs = counted.join(ones, same("__")).join(sizes, same("_"), "left")
    late = F.col("_a") * F.coalesce("_b", F.lit(0)) - F.col("2")
    broken = pairs.groupBy("case_id").agg(F.sum("0").alias("order_violations"), F.sum(F.col("1") - F.col("0")).alias("gap_too_small"), F.sum(late).alias("gap_too_large"))
    found = statuses.groupBy("case_id").agg(F.max((F.col("status") == "OK").cast("int")).alias("_ok"), F.max(F.col("status").isin(*FAILED).cast("int")).alias("_bad"))
    emitted = chains_found.groupBy("case_id").agg(F.count("*").alias("chains"))
    for part in (videos, broken, _beyond_span(steps, total, min_gap, max_gap, max_span), emitted):
        found = found.join(part, "case_id", "left")
    names = ["videos", "multi_step_videos", "order_violations", "gap_too_small", "gap_too_large", "span_violations", "chains"]
    status = F.when((F.col("_bad") == 1) & (F.col("_ok") == 0), "ERROR").when((F.col("_bad") == 1) | ((F.col("chains") == 0) & (F.col("_ok") == 1)), "PARTIAL").otherwise("OK")
    return found.select("case_id", "_ok", "_bad", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]).select("case_id", *names, status.alias("status"))


def _beyond_span(steps: DataFrame, total: int, min_gap: int, max_gap: int, max_span: int | None) -> DataFrame:
    """case_id, span_violations: pairs in order and within the gap that span too much. Pairs meet by slices of the gap's width."""
    if max_span is None:
        return steps.select("case_id").distinct().select("case_id", F.lit(0).cast("long").alias("span_violations"))
    width = max(max_gap, SLICE_MS)
    at = lambda ms: F.floor(ms / width)
    ahead = F.explode(F.sequence(at(F.col("end_ms") + min_gap), at(F.col("end_ms") + max_gap)))
    first = steps.filter(F.col("step_index") < total - 1).select("case_id", "video", (F.col("step_index") + 1).alias("step_index"), F.col("start_ms").alias("a0"), F.col("end_ms").alias("a1"), ahead.alias("_slice"))
    # A pair spans too much only if it could: the second ends late enough after the first that can reach it.
    second = steps.filter("step_index > 0").select(F.col("case_id").alias("_c"), F.col("video").alias("_v"), F.col("step_index").alias("_s"), F.col("start_ms").alias("b0"), F.col("end_ms").alias("b1"), at(F.col("start_ms")).alias("_n"))
    same = F.col("case_id").eqNullSafe(F.col("_c")) & F.col("video").eqNullSafe(F.col("_v")) & (F.col("step_index") == F.col("_s")) & (F.col("_slice") == F.col("_n"))
    inside = (F.col("b0") - F.col("a1")).between(min_gap, max_gap)
    span = F.greatest("a1", "b1") - F.least("a0", "b0")
    return first.join(second, same & inside & (span > max_span)).groupBy("case_id").agg(F.count("*").alias("span_violations"))
