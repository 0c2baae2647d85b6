"""Unified search: a checked request, the lanes that answer it, and one fused, ranked list of evidence windows.

A lane is anything with a name, a check whether it is available, and `hits`, a DataFrame of the fusion module's hits. Each lane runs by itself and
hands over its `PER_LANE` best hits; a lane that can't be planned or fails when it runs is left out and reported, as long as another one answers.

Defined results: a request that breaks a rule is an error before anything runs; a lane without hits is EMPTY and fine; if every lane fails there are no windows and the
status is ERROR; a lane that is asked for twice answers once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwell.operators.fusion import checked, rank_windows, windows

LANES = ("visual", "asr", "ocr", "object")
PER_LANE = 100
# Fixed value: the limit of a request.
MOST_RESULTS = 100
REQUEST_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:-]{0,127}")
# Words that suggest a lane; they explain a plan and never take a lane away.
HINTS = {"ocr": ("sign", "text", "caption", "written"), "asr": ("says", "said", "speech", "talks"), "object": ("holding", "wearing", "car", "person"), "visual": ("scene", "color", "background")}


@dataclass(frozen=True)
class Request:
    """A request; empty `video_ids` means no restriction, and `most_videos` is the number of videos of the corpus."""

    request_id: str
    query: str
    lanes: tuple[str, ...] = LANES
    video_ids: tuple = ()
    start_sec: float | None = None
    end_sec: float | None = None
    limit: int = 20
    most_videos: int | None = None

    def __post_init__(self) -> None:
        if not REQUEST_ID.fullmatch(self.request_id):
            raise ValueError("request_id")
        if not self.query.strip():
            raise ValueError("query")
        if not self.lanes or len(set(self.lanes)) != len(self.lanes) or not set(self.lanes) <= set(LANES):
            raise ValueError("lanes")
        if (self.most_videos is not None and len(self.video_ids) > self.most_videos) or len(set(self.video_ids)) != len(self.video_ids):
            raise ValueError("video_ids")
        if not 0 <= (self.start_sec or 0.0) <= (float("inf") if self.end_sec is None else self.end_sec):
            raise ValueError("start_sec, end_sec")
        if not 1 <= self.limit <= MOST_RESULTS:
            raise ValueError("limit")


MOST_SCOPE = 100


def scope_of(video_id: str | None, video_ids: tuple[str, ...] | None) -> tuple[str, ...] | None:
    """The scope that one video or a list of videos stands for: None without either; both at once, an empty or repeated id or more than MOST_SCOPE are errors."""
    if video_id is not None and video_ids is not None:
        raise ValueError("video_id or video_ids, not both")
    ids = (video_id,) if video_id is not None else video_ids
    if ids is None:
        return None
    if len(ids) > MOST_SCOPE or len(set(ids)) != len(ids) or any(not v or not v.strip() for v in ids):
        raise ValueError("video_ids")
    return tuple(ids)


class Lane(Protocol):
    """What a lane must offer."""

    name: str

    def available(self) -> bool: ...

    def hits(self, spark: SparkSession, request: Request) -> DataFrame: ...


@dataclass
class Answer:
    """The ranked windows (None if no lane could be planned), the status of every lane, and why lanes were suggested."""

    windows: DataFrame | None
    status: str
    lanes: dict[str, str] = field(default_factory=dict)
    reasons: list[str] = field(default_factory=list)


def reasons(query: str, hints: dict[str, tuple[str, ...]] = HINTS) -> list[str]:
    """Lanes that words of the query suggest."""
    words = set(re.findall(r"\w+", query.lower()))
    return [f"{lane}:{w}" for lane, said in hints.items() for w in said if w in words]


class InvalidConfig(ValueError):
    """What a lane raises that isn't set up for a request."""


def outcome(spark: SparkSession, lane: Lane | None, request: Request) -> tuple[str, DataFrame | None]:
    """A lane's status (OK, EMPTY, UNAVAILABLE, SKIPPED_INVALID_CONFIG or ERROR) and its `PER_LANE` best hits, which are all that is kept of it."""
    try:
        if lane is None or not lane.available():
            return "UNAVAILABLE", None
        hits = lane.hits(spark, request)
        rows = hits.filter(F.col("rank") <= PER_LANE).orderBy("rank", "evidence_id").limit(PER_LANE).collect()
        return "OK" if rows else "EMPTY", spark.createDataFrame(rows, hits.schema)
    except InvalidConfig:
        return "SKIPPED_INVALID_CONFIG", None
    except Exception as error:  # a lane's fault is reported, not spread
        return f"ERROR: {type(error).__name__}", None


def fused_hits(parts: list[DataFrame], request: Request) -> DataFrame:
    """The lanes' best hits within the request's videos and times. The time range comes after each lane's cut, as a lane doesn't know it."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    if request.start_sec is not None:
        every = every.filter(F.col("anchor") >= request.start_sec)
    if request.end_sec is not None:
        every = every.filter(F.col("anchor") <= request.end_sec)
    return every


def search(spark: SparkSession, request: Request, lanes: list[Lane]) -> Answer:
    """Windows of the request's lanes: OK if all answer, PARTIAL if some do, ERROR if none does."""
    by_name = {lane.name: lane for lane in lanes}
    found = {name: outcome(spark, by_name.get(name), request) for name in request.lanes}
    parts = [hits for _, hits in found.values() if hits is not None]
    overall = "OK" if len(parts) == len(request.lanes) else "PARTIAL" if parts else "ERROR"
    ranked = rank_windows(windows(checked(fused_hits(parts, request))), request.limit) if parts else None
    return Answer(ranked, overall, {name: status for name, (status, _) in found.items()}, reasons(request.query))


def distinct_lanes(names: list[str], aliases: dict[str, str]) -> list[str]:
    """The lanes asked for by their own names, each once, in the order in which they first come."""
    return list(dict.fromkeys(aliases.get(name, name) for name in names))


def side_by_side(spark: SparkSession, request: Request, lanes: list[Lane], names: list[str], aliases: dict[str, str]) -> DataFrame:
    """lane, status, n_hits, n_videos, overall of lanes that run one after the other without fusion: OK if all are OK or EMPTY, PARTIAL if some, else ERROR."""
    by_name, rows = {lane.name: lane for lane in lanes}, []
    for name in distinct_lanes(names, aliases):
        status, hits = outcome(spark, by_name.get(name), request)
        counts = hits.agg(F.count("*").alias("n"), F.countDistinct("video").alias("k")).first() if hits is not None else {"n": 0, "k": 0}
        rows.append((name, status.partition(":")[0], counts["n"], counts["k"]))
    fine = sum(r[1] in ("OK", "EMPTY") for r in rows)
    overall = "OK" if fine == len(rows) else "PARTIAL" if fine else "ERROR"
    return spark.createDataFrame([(*r, overall) for r in rows], "lane string, status string, n_hits long, n_videos long, overall string")
