"""Posterior probability that a contig's depth is one segment, against one change point.

States follow a Dirichlet-multinomial; its gamma functions only see whole numbers, so every segment's likelihood is a
running sum of logarithms of counts: of a state so far from the left, and from the right.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txgauge.functions import bins as B

NULL_PRIOR = 0.7


def prob_not_segmented(states: DataFrame, key: str = "ref_id", null_prior: float = NULL_PRIOR, n_states: int = B.STATES, most: int = 64) -> DataFrame:
    """(key, p_not_segmented) from (key, bin, state), bins numbered from 0 without gaps, at most `most` of them.

    States under 0 count as 0, those over n_states - 1 as that. One bin cannot be segmented.
    """
    # fixed by the model: ln of the gamma of n_states over that of n_states + n
    base = [math.lgamma(n_states) - math.lgamma(n_states + n) for n in range(most + 1)]
    norm = lambda n: F.element_at(F.array(*[F.lit(x) for x in base]), (n + 1).cast("int"))
    # one exchange on the key serves all windows
    d = states.repartition(F.col(key)).select(key, F.col("bin").alias("b"), F.least(F.greatest(F.col("state"), F.lit(0)), F.lit(n_states - 1)).alias("s"))
    same = Window.partitionBy(key, "s")
    left = F.count(F.lit(1)).over(same.orderBy("b"))
    d = d.withColumns({"l": left, "r": F.count(F.lit(1)).over(same) + 1 - left})
    up, whole = Window.partitionBy(key).orderBy("b"), Window.partitionBy(key)
    d = d.withColumns({
        "pre": F.sum(F.log("l")).over(up),
        "suf": F.sum(F.log("r")).over(whole) - F.sum(F.log("r")).over(up),
        "n": F.count(F.lit(1)).over(whole),
        "all": F.sum(F.log("l")).over(whole),
    })
    i = F.col("b") + 1
    ratio = F.exp(F.col("pre") + norm(i) + F.col("suf") + norm(F.col("n") - i) - F.col("all") - norm(F.col("n")))
    odds = d.groupBy(key).agg(F.sum(F.when(i < F.col("n"), ratio)).alias("x"), F.max("n").alias("n"))
    one = F.lit(null_prior)
    two = (1 - null_prior) * F.col("x") / F.greatest(F.col("n") - 1, F.lit(1))
    return odds.select(key, F.when(F.col("n") < 2, 1.0).otherwise(F.coalesce(F.try_divide(one, one + two), one)).alias("p_not_segmented"))
