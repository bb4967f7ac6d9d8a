"""Inputs of an assessment derived from the driver's tables, which hold neither sequences nor alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txgauge.functions import alignment as A
from txgauge.functions.score import contig_score
from txgauge.session import dealt, spread

LETTERS, CODE = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
N_REFS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str, code: bool = False) -> DataFrame:
    """(contig_idx, name, seq, length) of the documents; with code, letters become bases."""
    seq = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("contig_idx"), F.col("doc_id").cast("string").alias("name"), (F.translate(seq, LETTERS, CODE) if code else seq).alias("seq"))
    return spread(d).withColumn("length", F.length("seq"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, name, length) of the 25 nations."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("ref_id"), F.col("n_name").alias("name"), (600 + (k * 37) % 1500).alias("length"))


def quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, length, eff_len, tpm, eff_count); neighbours share a prior, so names decide ties."""
    r = refs(spark, sf_dir)
    return r.select("name", "length", (F.col("length") - 99).cast("long").alias("eff_len"), F.col("ref_id").cast("double").alias("tpm"), ((F.floor(F.col("ref_id") / 2) * 97) % 1000).cast("double").alias("eff_count"))


def _cigar(kind) -> F.Column:
    # fixed values: operation and length of the six kinds of alignment
    kinds = (
        ((A.M, 100),),
        ((A.M, 50), (A.D, 10), (A.M, 50)),
        ((A.M, 50), (A.I, 10), (A.M, 40)),
        ((A.S, 10), (A.M, 90)),
        ((A.M, 90), (A.S, 10)),
        ((A.M, 40), (A.N, 20), (A.M, 60)),
    )
    arrays = [F.array(*[F.struct(F.lit(o).alias("op"), F.lit(n).alias("len")) for o, n in k]) for k in kinds]
    return F.element_at(F.array(*arrays), (kind + 1).cast("int"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of fragments (orders) on references (suppliers), at most one of each mate on each."""
    # nearly every row is its own group, so rows go to their fragment's task as they are; nothing moves after that
    li = table(spark, sf_dir, "lineitem")
    li = dealt(li.select(F.col("l_orderkey").alias("fragment_idx"), "l_suppkey", "l_linenumber", "l_quantity", "l_partkey"), li.count(), "fragment_idx")
    g = li.groupBy("fragment_idx", (F.col("l_suppkey") % N_REFS).cast("int").alias("ref_id"), (F.col("l_linenumber") % 2).cast("int").alias("mate"))
    g = g.agg(F.min(F.floor("l_quantity") % 12).cast("int").alias("nm"), F.min("l_partkey").alias("part"))
    f, first = F.col("fragment_idx"), F.col("mate") == 1
    length = 600 + (F.col("ref_id") * 37) % 1500
    flag = F.lit(A.PAIRED) + F.when(first, A.READ1 + A.MATE_REVERSE).otherwise(A.READ2 + A.REVERSE) + F.when(f % 3 == 0, A.PROPER).otherwise(0) + F.when(f % 7 == 0, A.MATE_UNMAPPED).otherwise(0) + F.when(F.col("nm") > 8, A.SECONDARY).otherwise(0) + F.when(f % 11 == 0, A.UNMAPPED).otherwise(0)
    pos = (F.col("part") % length).cast("int")
    return g.select(
        (f * 64 + F.col("ref_id") * 2 + F.col("mate")).alias("ord"),
        f.alias("fragment_idx"),
        f.cast("string").alias("qname"),
        flag.cast("int").alias("flag"),
        "ref_id",
        pos.alias("pos"),
        _cigar(f % 6).alias("cigar"),
        F.lit(100).alias("query_len"),
        ((F.col("ref_id") + F.when(f % 5 == 0, 1).otherwise(0)) % N_REFS).cast("int").alias("next_ref_id"),
        (pos + F.when(first, 120).otherwise(-120)).cast("int").alias("next_pos"),
        "nm",
    )


def ordered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in read order for the fragment-size estimate: neighbours of one name are mates."""
    e = F.col("event_id")
    pos = ((F.col("user_id") * 37 + e * 11) % 500).cast("int")
    flag = F.when(e % 2 == 0, A.PAIRED + A.READ1 + A.MATE_REVERSE).otherwise(A.PAIRED + A.READ2 + A.REVERSE) + F.when(e % 17 == 0, A.UNMAPPED).otherwise(0) + F.when(e % 23 == 0, A.SECONDARY).otherwise(0)
    return table(spark, sf_dir, "events").select(
        e.alias("ord"), F.floor(e / 2).cast("string").alias("qname"), flag.cast("int").alias("flag"), pos.alias("pos"), F.lit(100).alias("query_len"), (pos + F.when(e % 2 == 0, 150).otherwise(-150)).cast("int").alias("next_pos")
    )


def scored_contigs(spark: SparkSession, sf_dir: str, run: int = 0) -> DataFrame:
    """Contigs with four components, score, good and tpm from the parts; run 1 is another run over the same contigs."""
    p = F.col("p_partkey")
    parts = {
        "sCcov": ((p * 3 + F.col("p_size")) % 52) / 51.0,
        "sCseg": ((p * 7 + run * (p % 3)) % 102) / 101.0,
        "sCord": ((p * 13) % 98) / 97.0,
        "sCnuc": ((p * 29 + run) % 90) / 89.0,
    }
    d = table(spark, sf_dir, "part").select(
        p.alias("contig_idx"),
        p.cast("string").alias("contig_name"),
        *[x.alias(k) for k, x in parts.items()],
        F.col("p_size").cast("long").alias("good"),
        ((p * (17 + run)) % 1000 / 10.0).alias("tpm"),
        ((p * 31) % 400 / 4.0).alias("coverage"),
        (300 + p % 2000).cast("long").alias("length"),
        (p % 61 / 60.0 + F.when((F.lit(run) == 1) & (p % 40 == 0), 3e-6).when((F.lit(run) == 1) & (p % 90 == 0), 0.25).otherwise(0.0)).alias("prop_gc"),
        (p % 333).cast("long").alias("orf_length"),
        F.col("p_brand").alias("brand"),
    )
    return d.withColumn("score", contig_score(*[F.col(c) for c in ("sCcov", "sCseg", "sCord", "sCnuc")]))
