"""Catalog validation: every rule yields rows of (code, entity, detail); a catalog without rows is valid.

Defined results: a rule that can't be decided because of nulls is broken; a null entity is shown as null; repeated rows that break a rule give a row each; empty tables
break only rules about their size; null keys are orphans of nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwell.functions.scalars import safe_path


def violation(rows: DataFrame, code: str, entity: Column, detail: Column) -> DataFrame:
    """Rows as violations of one code."""
    return rows.select(F.lit(code).alias("code"), entity.cast("string").alias("entity"), detail.cast("string").alias("detail"))


def broken_rules(table: DataFrame, entity: Column, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Violations of rules over single rows, all in one pass: code -> (condition that must hold, detail); an unknown condition counts as broken."""
    marks = [F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail"))) for code, (holds, detail) in rules.items()]
    found = table.select(entity.cast("string").alias("entity"), F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m"))
    return found.select("m.code", "entity", "m.detail")


def wrong_total(table: DataFrame, expected: int, code: str = "COUNT") -> DataFrame:
    """One violation if the table hasn't the expected number of rows."""
    return violation(table.agg(F.count("*").alias("n")).filter(F.col("n") != expected), code, F.lit("table"), F.col("n"))


def registry_violations(videos: DataFrame, expected: int, id_format: str = r"^L\d{2}_V\d{3}$") -> DataFrame:
    """Violations of a registry of videos (video_id, ordinal, relpath, series): COUNT, ID, SERIES, UNSAFE_PATH, repeated ids, ordinals and paths, ORDINAL_GAP."""
    rules = {
        "ID": (F.col("video_id").rlike(id_format), F.col("video_id")),
        "SERIES": (F.startswith("video_id", F.concat("series", F.lit("_"))), F.col("series")),
        "UNSAFE_PATH": (safe_path(F.col("relpath")), F.col("relpath")),
    }
    found = broken_rules(videos, F.col("ordinal"), rules).unionByName(wrong_total(videos, expected))
    for column, code in (("video_id", "REPEATED_ID"), ("ordinal", "REPEATED_ORDINAL"), ("relpath", "REPEATED_PATH")):
        found = found.unionByName(duplicates(videos, [column], code))
    # Ordinals go from 1 on: as many distinct ones as the last says.
    last = videos.agg(F.countDistinct("ordinal").alias("n"), F.max("ordinal").alias("last")).filter("n <> last")
    return found.unionByName(violation(last, "ORDINAL_GAP", F.lit("table"), F.col("last") - F.col("n")))


def segment_violations(segments: DataFrame, expected: DataFrame, allowed: list[str]) -> DataFrame:
    """Violations of texts on a timeline (segment_id, video, start_ms, end_ms, text, status, box, row): repeated ids, STATUS, INTERVAL, EMPTY_TEXT,
    BOX (four numbers that span an area), ROW (places in a matrix from 0 to n - 1, each once), and videos whose number isn't the expected (video, n)."""
    box, area = F.col("box"), (F.get("box", F.lit(2)) > F.get("box", F.lit(0))) & (F.get("box", F.lit(3)) > F.get("box", F.lit(1)))
    rules = {
        "STATUS": (F.col("status").isin(allowed), F.col("status")),
        "INTERVAL": ((F.col("start_ms") >= 0) & (F.col("end_ms") >= F.col("start_ms")), F.concat_ws("..", F.col("start_ms").cast("string"), F.col("end_ms").cast("string"))),
        "EMPTY_TEXT": (F.length(F.trim("text")) > 0, F.lit("")),
        "BOX": (box.isNull() | ((F.size("box") == 4) & area), F.concat_ws(",", F.transform("box", lambda x: x.cast("string")))),
    }
    found = broken_rules(segments, F.col("segment_id"), rules).unionByName(duplicates(segments, ["segment_id"], "REPEATED_ID")).unionByName(duplicates(segments.filter("row IS NOT NULL"), ["row"], "REPEATED_ROW"))
    rows = segments.agg(F.count("row").alias("n"), F.max("row").alias("last")).filter("last + 1 <> n")
    found = found.unionByName(violation(rows, "ROW", F.lit("table"), F.col("last")))
    counts = segments.groupBy(F.col("video").alias("v")).agg(F.count("*").alias("c"))
    off = expected.join(counts, F.col("video") == F.col("v"), "left").filter(F.coalesce("c", F.lit(0)) != F.col("n"))
    return found.unionByName(violation(off, "VIDEO_COUNT", F.col("video"), F.coalesce("c", F.lit(0))))


def frame_violations(frames: DataFrame) -> DataFrame:
    """Violations of sampled frames (uid, video, n, fps, frame_idx, ms, row): UID (video:n), FPS, MS (from frame and rate), ROW (n - 1), repeated ids."""
    rules = {
        "UID": (F.col("uid") == F.concat_ws(":", "video", "n"), F.col("uid")),
        "FPS": (F.col("fps") > 0, F.col("fps")),
        "MS": (F.col("ms") == F.bround(F.col("frame_idx") * 1000 / F.when(F.col("fps") > 0, F.col("fps")), 0).cast("long"), F.col("ms")),
        "ROW": (F.col("row") == F.col("n") - 1, F.col("row")),
    }
    return broken_rules(frames, F.col("uid"), rules).unionByName(duplicates(frames, ["uid"], "REPEATED_ID"))


def out_of_range(points: DataFrame, videos: DataFrame, slack_ms: int = 1000) -> DataFrame:
    """video, n, first_ms, last_ms: points of a video before 0 or after its duration and a slack."""
    ends = videos.select(F.col("video").alias("v"), "duration_ms")
    off = points.join(ends, F.col("video") == F.col("v")).filter((F.col("ms") < 0) | (F.col("ms") > F.col("duration_ms") + slack_ms))
    return off.groupBy("video").agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def samples_along(points: DataFrame, videos: DataFrame, key: str) -> DataFrame:
    """video, part (early, mid, late), uid: of every third of each video the point of the least hash of its id."""
    ends = videos.select(F.col("video").alias("v"), "duration_ms")
    third = F.least(F.lit(2), F.floor(F.col("ms") * 3 / F.greatest(F.lit(1), F.col("duration_ms"))).cast("int"))
    rows = points.join(ends, F.col("video") == F.col("v")).filter(F.col("ms").between(0, F.col("duration_ms"))).withColumn("part", F.element_at(F.array(F.lit("early"), F.lit("mid"), F.lit("late")), third + 1))
    return rows.groupBy("video", "part").agg(F.min_by(key, F.struct(F.md5(F.col(key).cast("string")), key)).alias(key))


def shard_violations(items: DataFrame, shards: DataFrame) -> DataFrame:
    """Violations of shards (shard, schema_version, manifest_sha, config_sha, item_count) and their items (shard, item_id, state): SCHEMA, ITEM_COUNT,
    REPEATED_ITEM (over all shards), UNFINISHED (done and failed are not all), and MIXED hashes between shards."""
    counts = items.groupBy(F.col("shard").alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("state").isin("OK", "ERROR")).alias("ended"))
    met = shards.join(counts, F.col("shard") == F.col("s"), "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("ended", F.coalesce("ended", F.lit(0)))
    rules = {
        "SCHEMA": (F.col("schema_version") == 1, F.col("schema_version")), "ITEM_COUNT": (F.col("item_count") == F.col("n"), F.col("n")), "UNFINISHED": (F.col("ended") == F.col("n"), F.col("ended")),
    }
    found = broken_rules(met, F.col("shard"), rules).unionByName(duplicates(items, ["item_id"], "REPEATED_ITEM"))
    for column, code in (("manifest_sha", "MIXED_MANIFEST"), ("config_sha", "MIXED_CONFIG")):
        found = found.unionByName(violation(shards.agg(F.countDistinct(column).alias("n")).filter("n > 1"), code, F.lit("shards"), F.col("n")))
    return found


def dataset_violations(queries: DataFrame, types: list[str], traps: list[str], statuses: list[str]) -> DataFrame:
    """Violations of an evaluation set (query_id, query_type, trap, split, label_status, gt_video, ranges, sha, text): repeated ids, TYPE, TRAP, SPLIT, STATUS,
    TEXT, RANGES (start below end, from 0 on; of labelled queries at least one), UNLABELLED (truth without a label), SHA; HOLDOUT_SHARE outside of 20 to 30 %."""
    labelled = F.col("label_status") != "unlabeled_reference"
    good = F.forall("ranges", lambda r: (r["lo"] >= 0) & (r["hi"] >= r["lo"]))
    rules = {
        "TYPE": (F.col("query_type").isin(types), F.col("query_type")), "TRAP": (F.col("trap").isin(traps), F.col("trap")), "SPLIT": (F.col("split").isin("dev", "holdout"), F.col("split")),
        "STATUS": (F.col("label_status").isin(statuses), F.col("label_status")), "TEXT": (F.length(F.trim("text")) > 0, F.lit("")),
        "RANGES": (good & (~labelled | (F.size("ranges") > 0)), F.size("ranges")), "UNLABELLED": (labelled | (F.col("gt_video").isNull() & (F.size("ranges") == 0)), F.col("gt_video")),
        "SHA": (F.col("sha").isNull() | F.col("sha").rlike("^[0-9a-f]{64}$"), F.col("sha")),
    }
    share = queries.agg((F.count_if(F.col("split") == "holdout") / F.count("*")).alias("p")).filter("p IS NOT NULL AND NOT p BETWEEN 0.2 AND 0.3")
    found = broken_rules(queries, F.col("query_id"), rules).unionByName(duplicates(queries, ["query_id"], "REPEATED_ID"))
    return found.unionByName(violation(share, "HOLDOUT_SHARE", F.lit("set"), F.round("p", 4)))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, code: str = "ORPHAN") -> DataFrame:
    """Distinct keys of child rows without a parent, with the number of rows; a null key is none."""
    keys = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("n"))
    lost = keys.join(parent.select(F.col(parent_key).alias("p")), F.col("k") == F.col("p"), "left_anti")
    return violation(lost, code, F.col("k"), F.col("n"))


def duplicates(table: DataFrame, keys: list[str], code: str = "DUPLICATE") -> DataFrame:
    """Keys that more than one row has."""
    return violation(table.groupBy(*keys).count().filter("count > 1"), code, F.concat_ws(":", *keys), F.col("count"))


def ordinal_gaps(table: DataFrame, group: str, ordinal: str) -> DataFrame:
    """group, missing, repeated: how many ordinals between the first (1 at most) and the last are not there, and how many are there again."""
    before = F.coalesce(F.lag(ordinal).over(Window.partitionBy(group).orderBy(ordinal)), F.lit(0))
    step = F.col(ordinal) - before
    marked = table.select(group, F.greatest(step - 1, F.lit(0)).alias("m"), (step == 0).cast("int").alias("r"))
    found = marked.groupBy(group).agg(F.sum("m").cast("long").alias("missing"), F.sum("r").cast("long").alias("repeated"))
    return found.filter("missing > 0 OR repeated > 0")


def bad_intervals(table: DataFrame, entity: Column, start: Column, end: Column) -> DataFrame:
    """Intervals that end before they start or have no bounds."""
    wrong = table.filter(F.coalesce(start > end, F.lit(True)))
    return violation(wrong, "INTERVAL", entity, F.concat_ws("..", start.cast("string"), end.cast("string")))


def bad_values(table: DataFrame, code: str, entity: Column, value: Column, allowed: list) -> DataFrame:
    """Values outside a list."""
    return violation(table.filter(~F.coalesce(value.isin(allowed), F.lit(False))), code, entity, value)


def unsafe_paths(table: DataFrame, entity: Column, path: Column) -> DataFrame:
    """Paths that are absolute, have a drive or lead upwards."""
    return violation(table.filter(~safe_path(path)), "UNSAFE_PATH", entity, path)


def coverage(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, unavailable: DataFrame | None = None) -> DataFrame:
    """key, n, status: how many children each parent has: HAS_ITEMS or NO_ITEMS, or UNAVAILABLE (and none) where `unavailable` has its `key`."""
    counts = children.groupBy(F.col(child_key).alias("c")).agg(F.count("*").alias("n"))
    met = parents.join(counts, parents[parent_key] == counts["c"], "left")
    n = F.coalesce("n", F.lit(0))
    found = met.select(F.col(parent_key).alias("key"), n.alias("n"), F.when(n > 0, "HAS_ITEMS").otherwise("NO_ITEMS").alias("status"))
    if unavailable is None:
        return found
    lost = unavailable.select(F.col("key").alias("_k")).distinct()
    gone = F.col("_k").isNotNull()
    return found.join(lost, F.col("key") == F.col("_k"), "left").select("key", F.when(gone, 0).otherwise(F.col("n")).alias("n"), F.when(gone, "UNAVAILABLE").otherwise(F.col("status")).alias("status"))


def split_matched(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Left rows with the last right row of their keys (by `order`), and the left rows without any."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    last = right.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    return left.join(last, keys), left.join(last.select(*keys), keys, "left_anti")


def merkle(table: DataFrame, order: Column, line: Column, fan: int = 1000) -> DataFrame:
    """One row, checksum: SHA-256 over lines in order of a number, by a tree: digests of `fan` lines, of `fan` digests, and so on.

    `order` numbers the rows from 0 on, or at least grows with them; a task joins `fan` short strings at most."""
    level = table.select(order.cast("long").alias("o"), F.sha2(line, 256).alias("d"))
    top = level.agg(F.max("o")).first()[0]
    size = 1
    while True:
        block = F.floor(F.col("o") / fan)
        joined = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("o", "d"))), lambda x: x["d"]))
        level = level.groupBy(block.alias("b")).agg(F.sha2(joined, 256).alias("d")).select(F.col("b").alias("o"), "d")
        size *= fan
        if top is None or size > top:
            return level.select(F.col("d").alias("checksum"))


def checksums(kinds: dict[str, tuple[DataFrame, Column, Column]], fan: int = 1000) -> DataFrame:
    """kind, n, checksum: `merkle` for each kind of entity, from its table, order and line."""
    found = None
    for kind, (table, order, line) in kinds.items():
        one = merkle(table, order, line, fan).select(F.lit(kind).alias("kind"), "checksum").join(table.agg(F.count("*").alias("n")), F.lit(True)).select("kind", "n", "checksum")
        found = one if found is None else found.unionByName(one)
    return found


def completeness(entities: DataFrame, key: str, kinds: dict[str, DataFrame]) -> DataFrame:
    """One row for each entity and one for each orphan: entity, known, has_<kind>, missing.

    `kinds` are tables with a column `entity`. An orphan is an entity that some kind has and the registry doesn't (known is false)."""
    found = entities.select(F.col(key).alias("entity")).distinct().withColumn("known", F.lit(True))
    for kind, rows in kinds.items():
        mine = rows.select(F.col("entity").alias("_e")).filter("_e IS NOT NULL").distinct().withColumn(f"has_{kind}", F.lit(True))
        found = found.join(mine, F.col("entity") == F.col("_e"), "full").withColumn("entity", F.coalesce("entity", "_e")).drop("_e")
    has = [F.coalesce(f"has_{k}", F.lit(False)) for k in kinds]
    missing = F.filter(F.array(*[F.when(~h, F.lit(k)) for k, h in zip(kinds, has, strict=True)]), lambda x: x.isNotNull())
    return found.select("entity", F.coalesce("known", F.lit(False)).alias("known"), *[h.alias(f"has_{k}") for k, h in zip(kinds, has, strict=True)], F.concat_ws(",", missing).alias("missing"))


def storage(files: DataFrame, path: str, size: str, samples: int = 10) -> DataFrame:
    """folder, extension, n, bytes, samples: for each folder and file extension the files, their bytes and the first `samples` paths in order.

    Samples are cut within tasks first, so no folder's paths are brought together."""
    name = F.regexp_replace(path, r"[?#].*$", "")
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    rows = files.select(F.regexp_extract(name, r"^(.*)/[^/]*$", 1).alias("folder"), extension.alias("extension"), F.col(path).alias("path"), F.col(size).cast("long").alias("size"))
    totals = rows.groupBy("folder", "extension").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    order = Window.partitionBy("folder", "extension").orderBy("path")
    first = rows.select("folder", "extension", "path").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= samples)
    shown = first.groupBy("folder", "extension").agg(F.sort_array(F.collect_list("path")).alias("samples"))
    return totals.join(shown, ["folder", "extension"])


def artifact_violations(shards: DataFrame, segments: DataFrame, videos: DataFrame, slack_ms: int = 1000) -> DataFrame:
    """Violations of shards of segments (shard, count, digest told) by what they hold (shard, segment_id, video, start_ms, end_ms, text): COUNT, DIGEST, and of segments
    INTERVAL (negative or turned round), LATE (beyond the video's duration and `slack_ms`) and UNKNOWN_VIDEO.

    The digest of a shard is the sum of hashes of its segments, so it needs no order."""
    line = F.xxhash64("segment_id", "video", "start_ms", "end_ms", "text").cast("decimal(38,0)")
    held = segments.groupBy(F.col("shard").alias("_s")).agg(F.count("*").alias("n"), F.sum(line).alias("d"))
    met = shards.join(held, F.col("shard") == F.col("_s"), "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("d", F.coalesce("d", F.lit(0).cast("decimal(38,0)")))
    wrong = violation(met.filter("count <> n"), "COUNT", F.col("shard"), F.col("n")).unionByName(violation(met.filter("NOT digest <=> d"), "DIGEST", F.col("shard"), F.lit("")))
    known = videos.select(F.col("video").alias("_v"), "duration_ms")
    timed = segments.join(known, F.col("video") == F.col("_v"), "left")
    span = F.concat_ws("..", F.col("start_ms").cast("string"), F.col("end_ms").cast("string"))
    rules = (
        ("UNKNOWN_VIDEO", F.col("_v").isNull(), F.col("video")), ("INTERVAL", ~F.coalesce((F.col("start_ms") >= 0) & (F.col("end_ms") >= F.col("start_ms")), F.lit(False)), span),
        ("LATE", F.col("end_ms") > F.col("duration_ms") + slack_ms, span),
    )
    for code, broken, detail in rules:
        wrong = wrong.unionByName(violation(timed.filter(broken), code, F.col("segment_id"), detail))
    return wrong


def segment_digest() -> Column:
    """The digest that artifact_violations expects of a shard, as an aggregate over its segments."""
    return F.sum(F.xxhash64("segment_id", "video", "start_ms", "end_ms", "text").cast("decimal(38,0)"))


def extensions(paths: DataFrame, path: str) -> DataFrame:
    """extension, n, sample: how often each file extension occurs (lower case, empty for none) and its least path."""
    name = F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"([^/]*)$", 1)
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return paths.groupBy(extension.alias("extension")).agg(F.count("*").alias("n"), F.min(path).alias("sample"))


def with_item_frames(items: DataFrame, frames: DataFrame, path: str) -> DataFrame:
    """Items (with the path of a file named like its frame) with the frame's columns, by video and file stem; an item without a frame fails the query."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    known = frames.withColumnsRenamed({"video": "_video", "stem": "_stem"}).withColumn("_there", F.lit(True))
    met = items.withColumn("stem", stem).join(known, (F.col("video") == F.col("_video")) & (F.col("stem") == F.col("_stem")), "left")
    lost = F.raise_error(F.concat(F.lit("no frame for "), F.col(path))).cast("boolean")
    return met.filter(F.when(F.col("_there").isNull(), lost).otherwise(True)).drop("_video", "_stem", "_there")


def sweep(files: DataFrame, least: float) -> DataFrame:
    """video, n_files, n_items, n_kept, n_boxed: items of files (video, items: text, confidence, box), those of `least` confidence or more, and those with a box of four numbers."""
    items = files.select("video", F.explode_outer("items").alias("i"))
    there = F.col("i").isNotNull()
    counts = items.groupBy("video").agg(F.count_if(there).alias("n_items"), F.count_if(F.col("i.confidence") >= least).alias("n_kept"), F.count_if(F.size("i.box") == 4).alias("n_boxed"))
    return files.groupBy("video").agg(F.count("*").alias("n_files")).join(counts, "video")
