"""Structured search: object detections by class and facets by support.

Detections are rows of (frame, class, score, ...); postings hold one row for each frame and class. Facets are rows of (frame, facet).
Everything is grouping with partial aggregation and joins against the classes or facets of a request, which are broadcast.

Defined results: detections of a null class are a class without a name, which no request asks for; null scores reach no threshold; equal scores count the smaller ordinal;
repeated facets of a frame count once; a request of no known class or facet gives no rows; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwell.functions.scalars import idf
from strandwell.functions.text import accentless, collapse, facet_phrase, tokens


def postings(detections: DataFrame, best: int = 5) -> DataFrame:
    """video, frame, class_name -> max_score (6 digits), detection_count, top_ordinal (the first of the best) and the `best` scores, best first.

    A frame's detections of one class are few by nature; their scores are what is gathered."""
    first = F.struct(F.col("score"), -F.col("ordinal"))
    return detections.groupBy("video", "frame", "class_name").agg(
        F.round(F.max("score"), 6).alias("max_score"), F.count("*").alias("detection_count"), F.max_by("ordinal", first).alias("top_ordinal"),
        F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, best).alias("top_scores"),
    )


def class_dictionary(posted: DataFrame) -> DataFrame:
    """class_id (by name), class_name, frame_count, detection_count, max_score, min_score."""
    found = posted.groupBy("class_name").agg(
        F.count("*").alias("frame_count"), F.sum("detection_count").alias("detection_count"), F.max("max_score").alias("max_score"), F.min("max_score").alias("min_score")
    )
    return found.withColumn("class_id", F.row_number().over(Window.orderBy("class_name")))  # one row for each class


def resolve(names: list[str], dictionary: DataFrame) -> list[str]:
    """The classes that exist among the asked ones, once each; case and spaces don't matter."""
    wanted = list(dict.fromkeys(" ".join(n.lower().split()) for n in names))
    known = {r["n"]: r["class_name"] for r in dictionary.filter(F.lower("class_name").isin(wanted)).select(F.lower("class_name").alias("n"), "class_name").collect()}
    return [known[n] for n in wanted if n in known]


def class_form(label: Column) -> Column:
    """A label of a class as it is compared: lower case, underscores and hyphens as spaces, single spaces."""
    return collapse(F.translate(F.lower(label), "_-", "  "))


def resolve_classes(asked: DataFrame, dictionary: DataFrame) -> DataFrame:
    """query_id, label, class_name, how of each asked label (query_id, label): by its form or that of the entity ('name'), or by the class's own id ('id').

    `dictionary` has class_name (the id), class_norm, class_entity and frame_count; of several classes of one form the most frequent counts, then the smaller id."""
    known = dictionary.select("class_name", "frame_count", F.explode(F.array_distinct(F.array(class_form(F.col("class_norm")), class_form(F.col("class_entity"))))).alias("form"))
    first = known.groupBy("form").agg(F.min_by("class_name", F.struct(-F.col("frame_count"), "class_name")).alias("by_name"))
    wanted = asked.select("query_id", "label", class_form(F.col("label")).alias("form")).distinct()
    ids = dictionary.select(F.col("class_name").alias("by_id")).distinct()
    met = wanted.join(first, "form", "left").join(ids, F.col("label") == F.col("by_id"), "left")
    return met.filter("by_name IS NOT NULL OR by_id IS NOT NULL").select("query_id", "label", F.coalesce("by_name", "by_id").alias("class_name"), F.when(F.col("by_name").isNotNull(), "name").otherwise("id").alias("how"))


def search_objects(posted: DataFrame, classes: list[str], match_all: bool, least: float = 0.1, scope: list | None = None, asked: int | None = None) -> DataFrame:
    """video, frame, score: frames with all (score: the least of the classes) or any (the greatest) of the classes at `least` or more.

    `asked` counts the classes of the request before unknown ones were dropped: with `match_all`, one unknown class leaves nothing. `scope`
    None means all videos, an empty list none."""
    classes = list(dict.fromkeys(classes))
    hits = posted.filter((F.col("max_score") >= least) & (F.col("class_name").isin(classes) if classes else F.lit(False)))
    if scope is not None:
        hits = hits.filter(F.col("video").isin(scope) if scope else F.lit(False))
    if match_all:
        n = len(classes) if asked is None else asked
        grouped = hits.groupBy("video", "frame").agg(F.min("max_score").alias("score"), F.countDistinct("class_name").alias("n"))
        return grouped.filter(F.col("n") == n).select("video", "frame", "score")
    return hits.groupBy("video", "frame").agg(F.max("max_score").alias("score"))


def facet_frequency(facets: DataFrame) -> DataFrame:
    """facet_id, df_frames, df_videos."""
    return facets.groupBy("facet_id").agg(F.countDistinct("frame").alias("df_frames"), F.countDistinct("video").alias("df_videos"))


def facet_scores(facets: DataFrame, wanted: DataFrame, n_frames: Column, frequency: DataFrame) -> DataFrame:
    """query_id, video, frame, score, matched (sorted): the sum of the rounded weights of the distinct wanted facets of a frame.

    `wanted` has query_id and facet_id and is a request's: it is broadcast."""
    weights = wanted.join(frequency, "facet_id").select("query_id", "facet_id", F.round(idf(n_frames, F.col("df_frames")), 4).alias("weight"))
    hits = facets.select("video", "frame", "facet_id").join(F.broadcast(weights), "facet_id").dropDuplicates(["query_id", "video", "frame", "facet_id"])
    return hits.groupBy("query_id", "video", "frame").agg(F.round(F.sum("weight"), 4).alias("score"), F.sort_array(F.collect_list("facet_id")).alias("matched"))


def discover(dictionary: DataFrame, text: str, limit: int = 25) -> DataFrame:
    """facet_id, stage of the facets (facet_id, value) that a text may mean, in order of both.

    Those whose value is the text, with or without accents (stage 0), and the first `limit` that hold it as a phrase (1); if there are none, the first `limit` that
    hold any of its words of two letters or more (2)."""
    spark = dictionary.sparkSession
    asked = spark.createDataFrame([(text,)], "t string").select(facet_phrase(F.col("t")).alias("norm"), accentless(facet_phrase(F.col("t"))).alias("plain")).first()
    words = [w for w in dict.fromkeys((asked["norm"] or "").split()) if len(w) > 1]
    value, folded = facet_phrase(F.col("value")), accentless(facet_phrase(F.col("value")))
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))
    held = lambda c, t: F.contains(spaced(c), F.concat(F.lit(" "), F.array_join(tokens(F.lit(t)), " "), F.lit(" ")))
    same = (value == asked["norm"]) | (folded == asked["plain"])
    phrase = held(value, asked["norm"]) | held(folded, asked["plain"]) if words else F.lit(False)
    some = F.arrays_overlap(tokens(value), F.array(*[F.lit(w) for w in words])) if words else F.lit(False)
    staged = dictionary.select("facet_id", F.when(same, 0).when(phrase, 1).when(some, 2).alias("stage")).filter("stage IS NOT NULL")
    best = staged.agg(F.min("stage").alias("least"))  # one row
    kept = staged.join(F.broadcast(best), (F.col("stage") < 2) | (F.col("least") == 2)).drop("least")
    placed = kept.withColumn("_n", F.row_number().over(Window.partitionBy("stage").orderBy("facet_id")))
    return placed.filter((F.col("stage") == 0) | (F.col("_n") <= limit)).drop("_n").orderBy("stage", "facet_id")


def vocabulary_audit(facets: DataFrame) -> DataFrame:
    """namespace, n, n_distinct, p50, p90, p99 of value lengths: the value at position int(n * p) of the sorted lengths.

    Lengths are counted first; positions are running sums over the counts, a row for each namespace and length."""
    values = facets.select("namespace", F.col("value"), F.length("value").alias("len"))
    counts = values.groupBy("namespace", "len").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("namespace").orderBy("len"))
    placed = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy("namespace")))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col("len")))
    found = placed.groupBy("namespace").agg(F.first("n").alias("n"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))
    distinct = values.groupBy("namespace").agg(F.countDistinct("value").alias("n_distinct")).withColumnRenamed("namespace", "_namespace")
    return found.join(distinct, F.col("namespace").eqNullSafe(F.col("_namespace"))).select("namespace", "n", "n_distinct", "p50", "p90", "p99")


def vocabulary_top(facets: DataFrame, most: int = 50) -> DataFrame:
    """namespace, place, value, n: the most frequent values of each namespace, the smaller first among equals."""
    counts = facets.groupBy("namespace", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("namespace").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("namespace", "place", "value", "n")


def vocabulary_collisions(facets: DataFrame, key: Column) -> DataFrame:
    """namespace, key, values, n_values: values of a namespace that fall together under a normal form."""
    kinds = facets.select("namespace", "value", key.alias("key")).distinct().groupBy("namespace", "key")
    found = kinds.agg(F.concat_ws("|", F.sort_array(F.collect_list("value"))).alias("values"), F.count("*").alias("n_values"))
    return found.filter("n_values > 1")


NAMESPACES = ("scene", "action", "object", "attribute", "relation", "text")


def resolve_facets(wanted: DataFrame, dictionary: DataFrame, aliases: DataFrame, namespaces: tuple[str, ...] = NAMESPACES) -> DataFrame:
    """query_id, namespace, raw, facet_id, how of each asked value: its own facet ('exact'), or the first facet that has the value as it
    stands or without accents as an alias ('alias'); values of other namespaces and values that nothing answers to are left out.

    `wanted` has query_id, namespace, raw and is a request's; `dictionary` has facet_id, namespace, ordinal; `aliases` has ordinal, alias."""
    norm = facet_phrase(F.col("raw"))
    asked = wanted.filter(F.col("namespace").isin(list(namespaces)) & (F.length(norm) > 0)).select("query_id", "namespace", "raw", norm.alias("norm")).distinct()
    own = dictionary.select(F.col("facet_id").alias("own"))
    exact = asked.withColumn("id", F.concat_ws("/", "namespace", "norm")).join(own, F.col("id") == F.col("own"), "left")
    known = dictionary.select("ordinal", "namespace", F.col("facet_id").alias("other")).join(aliases, "ordinal")
    forms = exact.filter("own IS NULL").select("query_id", "namespace", "raw", F.explode(F.array_distinct(F.array("raw", accentless(F.col("norm"))))).alias("alias"))
    other = known.join(F.broadcast(forms), ["namespace", "alias"]).groupBy("query_id", "namespace", "raw").agg(F.min_by("other", "ordinal").alias("facet_id"))
    found = exact.filter("own IS NOT NULL").select("query_id", "namespace", "raw", F.col("own").alias("facet_id"), F.lit("exact").alias("how"))
    return found.unionByName(other.withColumn("how", F.lit("alias")))
