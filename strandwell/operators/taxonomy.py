"""Branches of a taxonomy and the entities that belong to them: by rules in order, with single entities listed apart.

Nodes are rows of (branch_id, branch_type, parent_ids, active). They are few: a tree that people wrote. Entities may be many; rules are expressions over
their columns and cost one pass.

Defined results: an entity that no rule holds for belongs nowhere; a listed entity belongs where the list says, and nowhere else; repeated memberships count
once; a parent that is no node, or one in a circle, ends the way up; inactive nodes are not shown and pass nothing on to their parents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEEPEST = 16


def memberships(entities: DataFrame, key: str, rules: list[tuple[str, Column]], listed: DataFrame | None = None) -> DataFrame:
    """entity, branch_id, reason: the branch of the first rule that holds (RULE), or those of `listed` (entity, branch_id) instead (LISTED)."""
    branch = None
    for name, holds in rules:
        branch = F.when(holds, name) if branch is None else branch.when(holds, name)
    found = entities.select(F.col(key).alias("entity"), (branch if branch is not None else F.lit(None).cast("string")).alias("branch_id")).distinct()
    if listed is None:
        return found.filter("branch_id IS NOT NULL").withColumn("reason", F.lit("RULE"))
    there = listed.join(entities.select(F.col(key).alias("entity")).distinct(), "entity", "left_semi").distinct()
    by_rule = found.filter("branch_id IS NOT NULL").join(listed.select("entity").distinct(), "entity", "left_anti").withColumn("reason", F.lit("RULE"))
    return by_rule.unionByName(there.select("entity", "branch_id", F.lit("LISTED").alias("reason")))


def active_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes in use."""
    return nodes.filter(F.coalesce(F.col("active"), F.lit(False)))


def ancestors(nodes: DataFrame) -> DataFrame:
    """branch_id, above: every active node with itself and the active nodes above it."""
    parents = active_nodes(nodes).select("branch_id", F.explode("parent_ids").alias("parent"))
    step = parents.join(active_nodes(nodes).select(F.col("branch_id").alias("parent")), "parent", "left_semi")
    found = active_nodes(nodes).select("branch_id", F.col("branch_id").alias("above"))
    last = found
    for _ in range(DEEPEST):
        last = last.join(step.select(F.col("branch_id").alias("above"), F.col("parent")), "above").select("branch_id", F.col("parent").alias("above")).distinct()
        last = last.join(found, ["branch_id", "above"], "left_anti")
        if not last.limit(1).count():
            break
        found = found.unionByName(last)
    return found


def branch_sizes(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """branch_id, branch_type, own, all: of every active node the entities that are its own, and those below it too, each once."""
    up = F.broadcast(ancestors(nodes))  # nodes are few
    below = members.select("entity", "branch_id").distinct().join(up, "branch_id").groupBy("above").agg(F.countDistinct("entity").alias("all"), F.countDistinct(F.when(F.col("above") == F.col("branch_id"), F.col("entity"))).alias("own"))
    shown = active_nodes(nodes).join(below, F.col("branch_id") == F.col("above"), "left")
    return shown.select("branch_id", "branch_type", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("all", F.lit(0)).alias("all"))


def membership_violations(members: DataFrame, nodes: DataFrame, entities: DataFrame, key: str, expected: dict[str, int] | None = None) -> DataFrame:
    """subject, code, n: UNKNOWN_BRANCH, INACTIVE_BRANCH and UNKNOWN_ENTITY of memberships, NO_BRANCH entities (under 'entities'), UNKNOWN_PARENT of nodes, and COUNT
    where a branch has another number of entities of its own than `expected`, an audited constant."""
    state = nodes.select(F.col("branch_id").alias("_b"), F.coalesce("active", F.lit(False)).alias("_a"))
    met = members.join(state, F.col("branch_id") == F.col("_b"), "left")
    code = F.when(F.col("_b").isNull(), "UNKNOWN_BRANCH").when(~F.col("_a"), "INACTIVE_BRANCH")
    found = met.select(F.col("branch_id").alias("subject"), code.alias("code")).filter("code IS NOT NULL").groupBy("subject", "code").agg(F.count("*").alias("n"))
    there = entities.select(F.col(key).alias("entity")).distinct()
    lost = members.join(there, "entity", "left_anti").groupBy(F.col("branch_id").alias("subject"), F.lit("UNKNOWN_ENTITY").alias("code")).agg(F.count("*").alias("n"))
    none = there.join(members.select("entity").distinct(), "entity", "left_anti").agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("entities").alias("subject"), F.lit("NO_BRANCH").alias("code"), "n")
    parents = nodes.select("branch_id", F.explode("parent_ids").alias("parent"))
    orphan = parents.join(nodes.select(F.col("branch_id").alias("parent")), "parent", "left_anti").groupBy(F.col("branch_id").alias("subject"), F.lit("UNKNOWN_PARENT").alias("code")).agg(F.count("*").alias("n"))
    out = found.unionByName(lost).unionByName(none).unionByName(orphan)
    if expected:
        told = members.sparkSession.createDataFrame(list(expected.items()), "subject string, want long")
        has = members.select("entity", "branch_id").distinct().groupBy(F.col("branch_id").alias("subject")).agg(F.count("*").alias("has"))
        wrong = told.join(has, "subject", "left").withColumn("n", F.coalesce("has", F.lit(0))).filter("n <> want").select("subject", F.lit("COUNT").alias("code"), "n")
        out = out.unionByName(wrong)
    return out
