"""Representatives of groups of contigs, and how they change between runs.

Groups: label, members (array of names in order). Scores: name, score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEAR_TIE, LEAST_COVERAGE, LEAST_GROUPS = 0.01, 0.9, 10


def best_scores(rows: DataFrame) -> DataFrame:
    """name, score: the highest of several rows of a name; rows without a number are dropped."""
    return rows.filter(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("name").agg(F.max("score").alias("score"))


def _members(groups: DataFrame) -> DataFrame:
    return groups.filter(F.size("members") > 0).select("label", F.size("members").alias("size"), F.posexplode("members").alias("place", "name"))


def picks(groups: DataFrame, scores: DataFrame) -> DataFrame:
    """(label, pick): the first member of the highest score over 0; no row for groups without one."""
    d = _members(groups).join(scores, "name").filter("score > 0")
    return d.groupBy("label").agg(F.max_by("name", F.struct("score", (-F.col("place")).alias("p"))).alias("pick"))


def compared(groups: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """One row a group: label, size, found_old, found_new, old_pick, new_pick, outcome, old_margin, new_margin, near_tie.

    Margins are each run's score of its own pick over that of the other's, a missing one being 0, where picks differ.
    The scores of both picks travel with them, so members join each run's scores once.
    """
    d = _members(groups).join(old.select("name", F.col("score").alias("old")), "name", "left").join(new.select("name", F.col("score").alias("new")), "name", "left")

    def best(score: str, alias: str):
        own = F.struct(F.col(score).alias("score"), (-F.col("place")).alias("p"))
        return F.max_by(F.struct("name", "old", "new"), F.when(F.col(score) > 0, own)).alias(alias)

    g = d.groupBy("label", "size").agg(F.count("old").alias("found_old"), F.count("new").alias("found_new"), best("old", "o"), best("new", "n"))
    o, n = F.col("o.name"), F.col("n.name")
    outcome = (
        F.when(o.isNull() & n.isNull(), "neither").when(n.isNull(), "only_old").when(o.isNull(), "only_new").when(o == n, "same").otherwise("changed")
    )
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    g = g.withColumn("outcome", outcome)
    changed = F.col("outcome") == "changed"
    g = g.withColumns({"old_margin": F.when(changed, zero("o.old") - zero("n.old")), "new_margin": F.when(changed, zero("n.new") - zero("o.new"))})
    g = g.withColumn("near_tie", F.coalesce(F.greatest("old_margin", "new_margin") < NEAR_TIE, F.lit(False)))
    return g.select("label", "size", "found_old", "found_new", o.alias("old_pick"), n.alias("new_pick"), "outcome", "old_margin", "new_margin", "near_tie")


def outcome_counts(groups: DataFrame) -> DataFrame:
    """groups, slots, the five outcomes, near_ties, shares of members found, rate and enough_members: one row, from compared."""
    kinds = ("same", "changed", "only_old", "only_new", "neither")
    t = groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("slots"),
        *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds],
        F.count_if("near_tie").alias("near_ties"),
        *[F.coalesce(F.sum(f"found_{k}"), F.lit(0)).alias(f"found_{k}") for k in ("old", "new")],
    )
    share = lambda k: F.coalesce(F.try_divide(F.col(f"found_{k}").cast("double"), F.col("slots")), F.lit(0.0))
    t = t.withColumns({"share_old": share("old"), "share_new": share("new"), "rate": F.try_divide(F.col("changed").cast("double"), F.col("same") + F.col("changed"))})
    return t.withColumn("enough_members", F.least("share_old", "share_new") >= LEAST_COVERAGE)


def changes_by_size(groups: DataFrame, least: int = LEAST_GROUPS) -> DataFrame:
    """(size, groups, changed, rate) of sizes with enough groups."""
    t = groups.groupBy("size").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("outcome") == "changed").alias("changed")).filter(F.col("groups") >= least)
    return t.withColumn("rate", F.col("changed") / F.col("groups"))


def largest_disagreements(groups: DataFrame, most: int = 10) -> DataFrame:
    """The changed groups of the largest margin, of equals the first label."""
    d = groups.filter("outcome = 'changed'").withColumn("margin", F.greatest("old_margin", "new_margin"))
    return d.orderBy(F.desc("margin"), "label").limit(most).select("label", "size", "old_pick", "new_pick", "old_margin", "new_margin")


def numbered(groups: DataFrame) -> DataFrame:
    """groups in the order of their labels, place from 1; a report's order, so one task sorts the labels it writes."""
    return groups.withColumn("place", F.row_number().over(Window.orderBy("label")))
