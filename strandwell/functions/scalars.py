"""Frame and time arithmetic and other scalar rules."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def millis(seconds: Column) -> Column:
    """Seconds as whole milliseconds, halves to even."""
    return F.bround(seconds * 1000, 0).cast("long")


def rate_or_default(fps: Column, default: float = 25.0) -> Column:
    """A usable frame rate: the default where it is null or not positive."""
    return F.when(fps > 0, fps).otherwise(F.lit(default))


def frame_of(seconds: Column, fps: Column) -> Column:
    """The frame shown at a time, halves to even."""
    return F.bround(seconds * rate_or_default(fps), 0).cast("long")


def seconds_of(frame: Column, fps: Column) -> Column:
    """The time of a frame, to the microsecond."""
    return F.round(frame / rate_or_default(fps), 6)


def submission_frame(seconds: Column, fps: Column) -> Column:
    """The frame number by the rate rounded to two digits, cut to a whole."""
    return F.floor(seconds * F.round(rate_or_default(fps), 2)).cast("long")


def clamp(frame: Column, count: Column) -> Column:
    """A frame number within 0 and count - 1."""
    return F.greatest(F.lit(0), F.least(frame, count - 1))


def clock(seconds: Column) -> Column:
    """mm:ss of a time."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def idf(total: Column, frequency: Column) -> Column:
    """Smoothed inverse document frequency: ln((N + 1) / (n + 1)) + 1."""
    return F.log((total + 1) / (frequency + 1)) + 1


def safe_path(path: Column) -> Column:
    """Whether a path is relative, without drive and without a way up."""
    return ~path.rlike(r"^([A-Za-z]:|[/\\])|(^|[/\\])\.\.([/\\]|$)") & (F.length(path) > 0)


def natural_key(name: Column) -> Column:
    """Order of names like L12_V003 by their numbers."""
    return F.struct(F.regexp_extract(name, r"L(\d+)", 1).try_cast("int").alias("l"), F.regexp_extract(name, r"V(\d+)", 1).try_cast("int").alias("v"))


def stable_id(name: Column) -> Column:
    """A positive number of 63 bits from a name, whatever the order of files: the first 8 bytes of its BLAKE2b digest without the sign. Null for null.

    No function of Spark has this digest, so names go through Arrow batches."""

    def digest(names: pd.Series) -> pd.Series:
        found = [None if n is None else int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "big") & ((1 << 63) - 1) for n in names]
        return pd.Series(found, dtype="Int64")

    return F.pandas_udf(digest, LongType())(name)
