"""Assembly scores and the score-optimising cutoff.

Contigs: contig_idx (file order), score, good, and tpm where it weighs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = 4096


def _rate(good: int | Column, fragments: int | Column) -> Column:
    g, f = (F.lit(x) if isinstance(x, int) else x for x in (good, fragments))
    return F.coalesce(F.try_divide(g.cast("double"), f), F.lit(0.0))


def assembly_scores(contigs: DataFrame, good: int | Column, fragments: int | Column) -> DataFrame:
    """score (geometric mean of the contigs' times the good rate) and weighted (mean of score times tpm, times it)."""
    t = contigs.agg(F.exp(F.avg(F.log("score"))).alias("g"), (F.sum(F.col("score") * F.col("tpm")) / F.count(F.lit(1))).alias("w"))
    r = _rate(good, fragments)
    return t.select((F.coalesce("g", F.lit(0.0)) * r).alias("score"), (F.coalesce("w", F.lit(0.0)) * r).alias("weighted"))


def score_curve(contigs: DataFrame, fragments: int) -> DataFrame:
    """(cutoff, assembly_score): the score of what is left after the contigs up to a score have gone.

    Contigs of one score make one point, what is left after the last of them. Of the highest score all but the last
    contig go (none would be left), so a single contig there makes no point. Contigs are summed by score first; the
    running sums have two levels, over GRID intervals of scores and within each, so no task sorts all scores.
    """
    if not fragments:
        return contigs.sparkSession.createDataFrame([], "cutoff double, assembly_score double")
    g = contigs.groupBy("score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.max_by("good", "contig_idx").alias("last_good")
    )
    g = g.withColumn("log", F.log("score") * F.col("n")).withColumn("cell", F.floor(F.col("score") * GRID).cast("int"))
    sums = ("n", "good", "log")
    cells = g.groupBy("cell").agg(*[F.sum(c).alias(c) for c in sums], F.max("score").alias("top"))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)  # at most GRID + 1 rows
    cells = cells.select("cell", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"above_{c}") for c in sums], F.max("top").over(Window.partitionBy()).alias("top"))
    higher = Window.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    d = g.join(F.broadcast(cells), "cell")
    left = {c: F.coalesce(F.sum(c).over(higher), F.lit(0)) + F.col(f"above_{c}") for c in sums}
    d = d.withColumns({f"left_{c}": x for c, x in left.items()})
    top = F.col("score") == F.col("top")
    n, good, log = F.when(top, F.lit(1)).otherwise(F.col("left_n")), F.when(top, F.col("last_good")).otherwise(F.col("left_good")), F.when(top, F.log("score")).otherwise(F.col("left_log"))
    d = d.filter(~top | (F.col("n") > 1))
    return d.select(F.col("score").alias("cutoff"), (F.exp(log / n) * (good / F.lit(fragments))).alias("assembly_score"))


def optimum(curve: DataFrame) -> DataFrame:
    """optimal_score, cutoff: the highest point over 0, of equals the lowest cutoff; 0, 0 if there is none."""
    best = curve.filter("assembly_score > 0").agg(F.min(F.struct((-F.col("assembly_score")).alias("s"), "cutoff")).alias("b"))
    return best.select(F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("optimal_score"), F.coalesce("b.cutoff", F.lit(0.0)).alias("cutoff"))
