"""Exact dedup by content sort, with DataFrame functions only.

Rows are range-partitioned on their normalised bytes (Spark samples the splitters; the range key is the first 32
characters and a hash of all of them, so the sample on the driver stays small however long the texts are), sorted
externally within the partitions so that equal texts are adjacent, and each is compared in full with the one before
it; of equal texts the smallest identifier stays. Only the text as it came crosses the exchange: the comparison
normalises it again, and only where two neighbours have the same hash but are not the same as they are.

A window holds the rows of a key, so a text whose copies fill more than a share of a partition, by rows or by bytes,
is found first, from exact sums by hash. Its rows get a salt in the range key, so they spread over partitions, and
its totals are keyed by SHA-256; by arithmetic there are at most 8 such texts per shuffle partition, which bounds
the broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txgauge.llm.common import cut, filled, one_spaced, others, shuffle_partitions

ADDED = ("keep_id", "group_size", "kept", "text_sha256")
_P, _H, _D, _S, _START, _RUN = "__cs_head", "__cs_hash", "__cs_sha", "__cs_salt", "__cs_start", "__cs_run"
_HOT, _HK, _HN = "__cs_salts", "__cs_keep", "__cs_size"


def _hot_texts(base: DataFrame, id_col: str, text_col: str, least_rows: int, least_bytes: int) -> DataFrame | None:
    """(hash, SHA-256, salts, keep, size) of the texts whose copies need a salt, a table of the driver; None without any."""
    spark, size = base.sparkSession, F.octet_length(filled(F.col(text_col))).cast("long")
    keys = cut(base.select(_H, _D, F.col(id_col).alias("id"), size.alias("b")))
    total, parts = keys.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first(), shuffle_partitions(spark)
    rows, most = max(least_rows, -(-total["n"] // (4 * parts))), max(least_bytes, -(-total["b"] // (4 * parts)))

    def large(n: Column, b: Column) -> Column:
        return (n > 1) & ((n >= rows) | (b >= most))

    sums = keys.groupBy(_H).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"))
    hot = sums.filter(large(F.col("n"), F.col("b"))).select(_H).collect()  # at most 8 * parts rows, as all below
    if not hot:
        return None
    some = keys.join(F.broadcast(spark.createDataFrame(hot, f"{_H} long")), _H)
    exact = some.groupBy(_H, _D).agg(F.min("id").alias(_HK), F.count(F.lit(1)).alias(_HN), F.sum("b").alias("b"))
    salts = F.greatest(F.ceil(F.col(_HN) / rows), F.ceil(F.col("b") / most)).cast("long").alias(_HOT)
    exact = exact.filter(large(F.col(_HN), F.col("b"))).select(_H, _D, salts, _HK, _HN)
    return spark.createDataFrame(exact.collect(), exact.schema)


def _sorted(docs: DataFrame, id_col: str, text_col: str, least_rows: int, least_bytes: int) -> tuple[DataFrame, list[str], bool]:
    """docs in content order, with keys, and whether each row begins a run of equal texts; the key's columns; if any is hot."""
    norm = one_spaced(F.col(text_col))
    base = docs.withColumns({_H: F.xxhash64(norm), _D: F.sha2(norm, 256)})
    hot = _hot_texts(base, id_col, text_col, least_rows, least_bytes)
    base = base.withColumn(_P, F.substring(norm, 1, 32))
    if hot is not None:
        base = base.join(F.broadcast(hot), [_H, _D], "left")
        base = base.withColumn(_S, F.pmod(F.xxhash64(id_col), F.coalesce(_HOT, F.lit(1)))).drop(_HOT)
    # without hot texts there is no salt: a constant would be folded out of the range key, but not out of the window's
    keys = [_P, _H] if hot is None else [_P, _H, _S]
    ordered = Window.partitionBy(*keys).orderBy(_D, F.col(id_col).asc_nulls_last())
    text = filled(F.col(text_col))
    before = F.lag(text).over(ordered)
    rows = base.repartitionByRange(*keys).withColumn("__cs_before", before)
    same = (text == F.col("__cs_before")) | (one_spaced(text) == one_spaced(F.col("__cs_before")))
    return rows.withColumn(_START, F.col("__cs_before").isNull() | ~same).drop("__cs_before"), keys, hot is not None


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_hot: int = 64, least_bytes: int = 1 << 22) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 (of the normalised text) for every row.

    Null text counts as empty, and all empty texts are equal. A null id is larger than any other; keep_id is null
    only if all ids of the group are. Repeated rows count each, and exactly one row of a group is kept. Input columns
    with the names of added ones, in any case, are replaced. An empty table gives an empty result.
    """
    columns = others(docs, ADDED)
    rows, keys, hot = _sorted(docs.select(*columns), id_col, text_col, least_hot, least_bytes)
    rows = rows.withColumn(_RUN, F.sum(F.col(_START).cast("int")).over(Window.partitionBy(*keys).orderBy(_D, F.col(id_col).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    group = Window.partitionBy(*keys, _RUN)
    keep, size, first = F.min(id_col).over(group), F.count(F.lit(1)).over(group), F.col(_START)
    if hot:
        known = F.col(_HN).isNotNull()
        keep, size = F.when(known, F.col(_HK)).otherwise(keep), F.coalesce(_HN, size)
    rows = rows.withColumns({"keep_id": keep, "group_size": size})
    kept = first & F.col(id_col).eqNullSafe(F.col("keep_id"))
    return rows.withColumns({"kept": kept, "text_sha256": F.col(_D)}).select(*columns, *ADDED)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_hot: int = 64, least_bytes: int = 1 << 22) -> DataFrame:
    """The rows of docs that mark_copies keeps, with all their own columns."""
    rows, _, hot = _sorted(docs, id_col, text_col, least_hot, least_bytes)
    rows = rows.filter(_START)
    if hot:
        rows = rows.filter(F.col(_HN).isNull() | F.col(id_col).eqNullSafe(F.col(_HK)))
    return rows.select(*docs.columns)
