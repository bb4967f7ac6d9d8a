"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document gets an exponential key -ln(u) / quality weight, u being a hash of its identifier and text. A source
that must give more words than it has gives complete epochs of all its documents; the fraction left is filled in
ascending order of the keys up to the token budget, the last document being taken if that comes nearer.

The prefix sums have two levels, so that no task sorts a source: keys fall into ordered buckets of a bounded number,
bucket totals are summed per source, and only the bucket in which the budget ends is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txgauge.llm.common import WORD, cut, filled, others

_Z, _K, _B, _SRC = "__mx_size", "__mx_key", "__mx_bucket", "__mx_source"
ADDED = ("size", "source_size", "target", "taken")
#: Sources up to which what is known of them is broadcast.
MOST_BROADCAST = 50_000


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.02 and 1, from all of the text: its share of letters, the length of its words and how many there are.

    Prose is four fifths of letters or more, in words of 3 to 12 characters. A lower share of letters counts in
    proportion; words of other lengths, and texts of under 20 words, halve the weight each.
    """
    t = filled(text)
    n, letters = F.length(t), F.length(F.regexp_replace(t, r"[^\p{L}]++", ""))
    share = F.least(F.lit(1.0), letters / (0.8 * F.greatest(n - size, F.lit(1))))
    mean = n / F.greatest(size, F.lit(1)) - 1  # without the space behind
    return F.greatest(F.lit(0.02), share * F.when(mean.between(3, 12), 1.0).otherwise(0.5) * F.when(size < 20, 0.5).otherwise(1.0))


def source_targets(totals: DataFrame, weights: Sequence[int], share: float, most_epochs: int) -> DataFrame:
    """totals (__mx_source, source_size) with target: water filling under most_epochs times the source's size.

    Sources are ranked in ranges of code points and by the numbers of sources in the ranges before, so no task sorts
    them all. The water level rises until no source under its cap would be over it; every round is one sum.
    """
    ranged = cut(totals.repartitionByRange(F.col(_SRC).asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before, offset = 0, []
    for r in ranged.groupBy("part").count().orderBy("part").collect():  # a row a partition
        offset.append((r["part"], before))
        before += r["count"]
    offsets = F.broadcast(totals.sparkSession.createDataFrame(offset, "part int, offset long"))
    place = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy(F.col(_SRC).asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    t = cut(ranged.join(offsets, "part").select(_SRC, "source_size", w.alias("w"), (F.col("source_size") * float(most_epochs)).alias("cap")))
    all_words = float(t.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level, capped, last = 0.0, F.lit(False), None
    while True:
        full, left = t.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0.0))).first()
        if (full, left) == last or not left:
            break
        last, level = (full, left), (all_words - full) / left
        capped = F.col("cap") <= F.col("w") * F.lit(level)
    return t.select(_SRC, "source_size", F.when(capped, F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.lit(level))).alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None) -> DataFrame:
    d = docs.withColumn(_Z, F.regexp_count(filled(F.col(text_col)), F.lit(WORD)).cast("long"))
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), filled(F.col(text_col)))
    u = (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    weight = quality_weight(F.col(text_col), F.col(_Z)) if weight_col is None else F.greatest(F.coalesce(F.nanvl(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1e-9))
    return d.withColumn(_K, -F.log(u) / weight).withColumn(_SRC, F.col(source_col))


def mixed(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.0,
    most_epochs: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    bucket_rows: int = 2048,
) -> DataFrame:
    """docs with size (words), source_size, target (words of its source) and taken (words, repeats counted).

    Null text has size 0; null is a source of its own, the last. Equal keys (repeated rows) are taken together. A
    source without words has target 0. Documents are drawn by quality_weight, or by weight_col, where null, NaN and
    what is not over 0 count as next to nothing. Input columns named like an added one, in any case, are replaced,
    after their use as input. An empty table gives an empty result. Buckets grow in number with the rows, by about
    bucket_rows in each.
    """
    full = _keyed(docs, id_col, text_col, source_col, weight_col)
    narrow = cut(full.select(_SRC, _Z, _K))
    buckets = max(64, narrow.count() // bucket_rows)
    # keys of weight 1 are spread evenly, those of low weights gather in the last buckets: these are cut finer
    bucket = (F.floor((1 - F.exp(-F.col(_K))) * buckets) + F.floor(F.least(F.col(_K), F.lit(1e6)) * (buckets // 16))).cast("long").alias(_B)
    full, narrow = full.select("*", bucket), narrow.select("*", bucket)
    sums = cut(narrow.groupBy(_SRC, _B).agg(F.sum(_Z).alias("z")))
    totals = sums.groupBy(_SRC).agg(F.sum("z").alias("source_size"))
    goals = source_targets(totals, weights, share, most_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_epochs))).otherwise(0)
    goals = goals.withColumn("epochs", whole.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goals = cut(goals)
    few = goals.count() <= MOST_BROADCAST
    running = Window.partitionBy(_SRC).orderBy(_B)
    ends = (
        _on_source(sums.withColumn("cum", F.sum("z").over(running)), goals.filter("rest > 0"))
        .filter(F.col("cum") >= F.col("rest"))
        .groupBy(_SRC)
        .agg(F.min(F.struct(_B, F.col("cum") - F.col("z"), "rest")).alias("e"))
        .select(_SRC, F.col("e")[_B].alias("end_bucket"), F.col("e")["col2"].alias("before"), F.col("e")["rest"].alias("rest"))
    )
    inside = _on_source(narrow, ends, few=few).filter(F.col(_B) == F.col("end_bucket"))
    reach = F.sum(_Z).over(Window.partitionBy(_SRC).orderBy(_K).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    inside = inside.withColumn("off", F.abs(F.col("before") + reach - F.col("rest")))
    best = (
        inside.groupBy(_SRC, "end_bucket", "before", "rest")
        .agg(F.min(F.struct("off", _K)).alias("m"))
        .select(_SRC, "end_bucket", F.when(F.col("m.off") < F.col("rest") - F.col("before"), F.col(f"m.{_K}")).otherwise(-1.0).alias("end_key"))
    )
    plan = _on_source(goals, best, "left", few).drop("rest")
    names = ["source_size", "target", "epochs", "end_bucket", "end_key"]
    plan = cut(plan.select(F.col(_SRC), *[F.col(c).alias(f"__mx_{c}") for c in names]))
    out = _on_source(full, plan, few=few)
    extra = (F.col(_B) < F.col("__mx_end_bucket")) | ((F.col(_B) == F.col("__mx_end_bucket")) & (F.col(_K) <= F.col("__mx_end_key")))
    times = F.col("__mx_epochs") + F.when(extra, 1).otherwise(0)
    columns = others(docs, ADDED)
    return out.select(
        *columns,
        F.col(_Z).alias("size"),
        F.col("__mx_source_size").alias("source_size"),
        F.col("__mx_target").alias("target"),
        (F.col(_Z) * times).alias("taken"),
    )


def _on_source(left: DataFrame, right: DataFrame, how: str = "inner", few: bool = False) -> DataFrame:
    """Joined on the source, null being one, with a row for each source at most, broadcast if these were counted to be few."""
    r = right.withColumnRenamed(_SRC, "__mx_right")
    r = F.broadcast(r) if few else r
    return left.join(r, F.col(_SRC).eqNullSafe(F.col("__mx_right")), how).drop("__mx_right")


def emit_mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of the mix: each document as often as the mix takes it, with the columns of docs."""
    m = mixed(docs.withColumnsRenamed({c: f"__in_{c}" for c in docs.columns}), id_col="__in_doc_id", text_col="__in_text", source_col="__in_source", **how)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    rows = m.withColumn("__n", F.explode(F.array_repeat(F.lit(1), times)))
    return rows.select(*[F.col(f"__in_{c}").alias(c) for c in docs.columns])
