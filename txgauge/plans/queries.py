"""The registered queries: every operator over the driver's tables, doubles rounded to six places."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txgauge.functions import alignment as A
from txgauge.functions import score as S
from txgauge.functions import sequence
from txgauge.operators import accumulation, assembly_stats, assignment, comparison, coverage, fleet, fragment_size, picks, rollup, scoring, segmentation
from txgauge.plans import surrogates as X
from txgauge.session import shared_folder
from txgauge.sources import fasta, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DISTANCE, FRAGMENTS, CURVE_FRAGMENTS = 400, 1_000_000, 10_000_000


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, negative zeros made positive."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


# sequences


@query
def seq_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.contigs(spark, sf_dir)
    return c.select("name", *[x.alias(f"bases_{b}") for b, x in sequence.composition(F.col("seq")).items()], sequence.prop_gc(F.col("seq")).alias("prop_gc"))


@query
def seq_dinucleotide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.contigs(spark, sf_dir).select("name", *[x.alias(d) for d, x in sequence.dinucleotides(F.col("seq")).items()])


@query
def seq_longest_orf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.contigs(spark, sf_dir, code=True).select("name", sequence.longest_orf(F.col("seq")).alias("orf_length"))


@query
def assembly_basic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly_stats.basic_stats(assembly_stats.sequence_columns(X.contigs(spark, sf_dir, code=True)))


@query
def assembly_nx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly_stats.nx(X.contigs(spark, sf_dir))


@query
def assembly_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly_stats.base_stats(X.contigs(spark, sf_dir))


@query
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly_stats.duplicate_names(X.table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")))


# fragments


@query
def prior_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    expression = X.quant(spark, sf_dir).filter("tpm < 20")
    return assignment.prior_table(X.refs(spark, sf_dir), expression)


def _priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment.prior_table(X.refs(spark, sf_dir), X.quant(spark, sf_dir))


@query
def fragment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment.candidates(X.alignments(spark, sf_dir), _priors(spark, sf_dir), X.N_REFS)


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment.assign(X.alignments(spark, sf_dir), _priors(spark, sf_dir), X.N_REFS, places=9)


@query
def fragment_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("ord", "fragment_idx", "ref_id", "flag", "pos", "nm")


@query
def contig_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = X.refs(spark, sf_dir)
    return accumulation.over_references(refs, accumulation.counters(_assigned(spark, sf_dir), DISTANCE)).drop("length")


@query
def p_seq_true_p_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = accumulation.over_references(X.refs(spark, sf_dir), accumulation.counters(_assigned(spark, sf_dir), DISTANCE))
    return a.select("ref_id", S.p_seq_true(F.col("scored_alignments"), F.col("edit_distance_total"), F.col("reads_mapped")).alias("p_seq_true"), S.p_good(F.col("good"), F.col("fragments_mapped")).alias("p_good"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.runs(coverage.blocks(_assigned(spark, sf_dir), X.refs(spark, sf_dir), X.N_REFS))


@query
def coverage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


@query
def bases_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.bases_uncovered(X.refs(spark, sf_dir), _runs(spark, sf_dir))


@query
def bin_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.bin_states(X.refs(spark, sf_dir), _runs(spark, sf_dir))


@query
def p_not_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.prob_not_segmented(coverage.bin_states(X.refs(spark, sf_dir), _runs(spark, sf_dir)))


@query
def segmentation_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posterior of one vector for each customer, of 30 states that depend on its key."""
    k = F.col("c_custkey")
    d = X.table(spark, sf_dir, "customer").select(k.alias("ref_id"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("bin"))
    state = F.when(F.col("bin") < F.col("ref_id") % 31, F.col("ref_id") % 7).otherwise((F.col("ref_id") * 3 + F.col("bin") * (F.col("ref_id") % 4)) % 26)
    return segmentation.prob_not_segmented(d.withColumn("state", state.cast("int")))


@query
def soft_clip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accumulation.clip_summary(accumulation.counters(_assigned(spark, sf_dir), DISTANCE))


@query
def fragment_size_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragment_size.estimate(fragment_size.first_pairs(X.ordered_records(spark, sf_dir)))


@query
def fragment_size_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragment_size.estimate(fragment_size.first_pairs(X.ordered_records(spark, sf_dir)), faithful=False)


# scores


@query
def contig_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.scored_contigs(spark, sf_dir)
    alt = S.alternative_scores(*[F.col(c) for c in ("sCcov", "sCseg", "sCord", "sCnuc")])
    return d.select("contig_name", "score", *[x.alias(f"without_{k}") for k, x in alt.items()])


@query
def assembly_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.scored_contigs(spark, sf_dir)
    good = d.agg(F.sum("good").alias("g"))
    return scoring.assembly_scores(d, 700_000, FRAGMENTS).crossJoin(F.broadcast(good)).select("score", "weighted", F.col("g").alias("good"))  # one row


@query
def score_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_curve(X.scored_contigs(spark, sf_dir), CURVE_FRAGMENTS)


@query
def optimal_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.optimum(scoring.score_curve(X.scored_contigs(spark, sf_dir), CURVE_FRAGMENTS))


@query
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.scored_contigs(spark, sf_dir).withColumn("classification", S.classify(F.col("score"), F.lit(0.05)))
    return d.groupBy("brand", "classification").agg(F.count(F.lit(1)).alias("n"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole assessment: contigs are the nations and one more that no header names."""
    refs = X.refs(spark, sf_dir)
    assigned = _assigned(spark, sf_dir)
    acc = accumulation.over_references(refs, accumulation.counters(assigned, DISTANCE))
    runs = coverage.runs(coverage.blocks(assigned, refs, X.N_REFS))
    per_ref = acc.join(coverage.bases_uncovered(refs, runs), "ref_id").join(segmentation.prob_not_segmented(coverage.bin_states(refs, runs)), "ref_id")
    own = refs.select(F.col("ref_id").cast("long").alias("contig_idx"), "name", "length").union(spark.createDataFrame([(25, "UNSEEN", 500)], "a long, b string, c int"))
    own = own.withColumns({"prop_gc": F.col("length") % 7 / 7, "orf_length": F.floor(F.col("length") / 9)})
    return rollup.contig_metrics(own, per_ref, X.quant(spark, sf_dir).filter("tpm < 20"))


@query
def contigs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.contig_table(_metrics(spark, sf_dir))


@query
def read_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.read_stats(_metrics(spark, sf_dir), 15_000)


# runs


def _assembly_row(spark: SparkSession, sf_dir: str, run: int) -> DataFrame:
    d = X.scored_contigs(spark, sf_dir, run)
    t = d.agg(F.exp(F.avg(F.log("score"))).alias("g"), F.sum("good").alias("m"), F.count(F.lit(1)).alias("n_seqs"), F.max("length").alias("largest"), F.round(F.avg("prop_gc"), 5).alias("gc"))
    rate = (F.col("m") - run * 100) / CURVE_FRAGMENTS
    return t.select(
        "n_seqs", "largest", "gc", F.round(F.col("g") * rate, 9).alias("score"), F.round(rate, 9).alias("p_good_mapping"), F.lit(CURVE_FRAGMENTS).alias("fragments"), (F.col("m") - run * 100).alias("good_mappings")
    )


@query
def compare_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run 1 has other names for some contigs."""
    name = F.when(F.col("contig_idx") % 50 == 49, F.concat(F.lit("x"), "contig_name")).otherwise(F.col("contig_name"))
    return comparison.contig_validity(X.scored_contigs(spark, sf_dir), X.scored_contigs(spark, sf_dir, 1).withColumn("contig_name", name))


@query
def compare_assembly_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _assembly_row(spark, sf_dir, 0), _assembly_row(spark, sf_dir, 1)
    return comparison.assembly_validity(a, b, ("n_seqs", "largest")).select("metric", "base", "other", "verdict")


@query
def compare_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.metric_deltas(*[_assembly_row(spark, sf_dir, r).select("fragments", "good_mappings") for r in (0, 2, 1)])


@query
def compare_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.decomposition(_assembly_row(spark, sf_dir, 0), _assembly_row(spark, sf_dir, 1))


@query
def compare_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.paired_summary(X.scored_contigs(spark, sf_dir), X.scored_contigs(spark, sf_dir, 1))


@query
def compare_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.rank_agreement(X.scored_contigs(spark, sf_dir), X.scored_contigs(spark, sf_dir, 1), 0.05, 0.06)


@query
def compare_discordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.scored_contigs(spark, sf_dir)
    return comparison.rank_discordance(a, X.scored_contigs(spark, sf_dir, 1), a.count())


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.scored_contigs(spark, sf_dir).withColumn("label", F.concat_ws(".", (F.col("contig_idx") % 37).cast("string"), "brand"))
    return g.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("contig_idx", "contig_name"))).alias("m")).select("label", F.col("m")["contig_name"].alias("members"))


def _scores(spark: SparkSession, sf_dir: str, run: int) -> DataFrame:
    """Scores of a run, null for some contigs."""
    d = X.scored_contigs(spark, sf_dir, run)
    return picks.best_scores(d.select(F.col("contig_name").alias("name"), F.when(F.col("contig_idx") % (11 + run) != 0, F.col("score")).alias("score")))


@query
def group_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.picks(_groups(spark, sf_dir), _scores(spark, sf_dir, 0))


@query
def pick_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.outcome_counts(picks.compared(_groups(spark, sf_dir), _scores(spark, sf_dir, 0), _scores(spark, sf_dir, 1)))


@query
def pick_changes_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.changes_by_size(picks.compared(_groups(spark, sf_dir), _scores(spark, sf_dir, 0), _scores(spark, sf_dir, 1)))


@query
def pick_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.largest_disagreements(picks.compared(_groups(spark, sf_dir), _scores(spark, sf_dir, 0), _scores(spark, sf_dir, 1)))


@query
def merged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blocks of results with different columns, merged; pairs are the nations, the manifest the customers."""
    n = X.table(spark, sf_dir, "nation")
    old = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("pair_id"), F.concat(F.lit("results/"), "n_name").alias("result_dir"), F.col("n_regionkey").cast("string").alias("score"))
    new = n.filter("n_nationkey % 2 = 1").select(F.col("n_name").alias("pair_id"), F.concat(F.lit("results/"), "n_name").alias("result_dir"), F.col("n_nationkey").cast("string").alias("cutoff"))
    pairs = n.join(X.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("pair_id"), F.col("r_name").alias("lineage"))
    manifest = X.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("pair_id")).agg(F.count(F.lit(1)).alias("n_read_pairs"))
    return fleet.merged_metrics(fleet.stacked([old, new]), pairs, manifest)


@query
def missing_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("pair_id"))
    o = X.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("pair_id"))
    return fleet.missing_jobs(c, o)




# sources and sinks: lines made from the tables, written to the shared folder, and read as files


def _written(lines: DataFrame, spark: SparkSession) -> str:
    """The folder of text files of lines (value), which follow each other in the order of `at`."""
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    lines.repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(path)
    return path


@query
def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as packed in lines of 60 letters behind headers of an archive; read back."""
    c = X.contigs(spark, sf_dir, code=True).select("contig_idx", F.regexp_replace(F.translate("seq", "\n\r\t >", "NNNNN"), r"^$", "N").alias("s"))
    folded = F.rtrim(F.regexp_replace("s", "(.{60})", "$1\n"), F.lit("\n"))
    head = F.concat(F.lit(">ENA|"), F.col("contig_idx"), F.lit("|"), F.col("contig_idx"), F.lit(".1 a contig;"))
    path = f"{shared_folder(spark)}/fasta-{uuid.uuid4().hex}"
    c.select(F.concat_ws("\n", head, folded).alias("value")).write.text(path)  # a file of each task
    return fasta.read_plain(spark, path).select(fasta.archive_name(F.col("defline")).alias("name"), F.length("seq").cast("long").alias("length"), F.md5("seq").alias("seq_md5"))


@query
def quant_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.table(spark, sf_dir, "supplier")
    row = F.concat_ws("\t", "s_name", (F.col("s_suppkey") % 5000).cast("string"), F.concat((F.col("s_suppkey") % 900).cast("string"), F.lit(".75")), F.lit("12.5"), F.col("s_suppkey").cast("string"))
    lines = s.select(F.col("s_suppkey").alias("at"), row.alias("value")).union(spark.createDataFrame([(-1, "Name\tLength\tEffectiveLength\tTPM\tNumReads")], "a long, b string"))
    return tables.read_quant(spark, _written(lines, spark))


@query
def manifest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.table(spark, sf_dir, "customer")
    reads = F.array_join(F.array_repeat(F.lit("r_1.fastq"), (F.col("c_custkey") % 4 + 1).cast("int")), ",")
    value = F.when(F.col("c_custkey") % 7 == 0, F.concat_ws("\t", "c_name", F.lit("a.fa"))).otherwise(F.concat_ws("\t", F.col("c_name"), F.lit("a.fa"), reads, F.lit("x")))
    return tables.read_manifest(spark, _written(c.select(F.col("c_custkey").alias("at"), value.alias("value")), spark))


@query
def orthogroup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' suppliers as lines of groups, one empty line among them; members joined by commas."""
    s = X.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), " ").alias("m"))
    lines = s.select(F.col("s_nationkey").cast("long").alias("at"), F.when(F.col("s_nationkey") == 3, "").otherwise(F.concat(F.lit("OG: "), F.regexp_replace("m", "#", ""))).alias("value"))
    return tables.read_orthogroups(spark, _written(lines, spark)).select("label", F.size("members").cast("long").alias("size"), F.array_join("members", ",").alias("members"))


@query
def score_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by the place of their column, some of them no numbers."""
    p = X.scored_contigs(spark, sf_dir)
    score = F.when(F.col("contig_idx") % 9 == 0, "n/a").otherwise(F.round("score", 6).cast("string"))
    d = p.select("contig_name", *[F.lit(i).alias(f"c{i}") for i in range(1, 8)], score.alias("score"), F.lit("more").alias("last"))
    path = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    d.write.csv(path, header=True)
    return tables.read_scores(spark, path)


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the SUMMARY line says."""
    a, b = X.scored_contigs(spark, sf_dir), X.scored_contigs(spark, sf_dir, 1)
    return comparison.summary(_assembly_row(spark, sf_dir, 0), _assembly_row(spark, sf_dir, 1), a, b, a.count())


@query
def alignment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as text with CIGAR strings, parsed: lengths on query and reference, soft clips; those that do not fit are counted apart."""
    a = X.alignments(spark, sf_dir)
    text = F.array_join(F.transform("cigar", lambda o: F.concat(o["len"].cast("string"), F.substring(F.lit(A.LETTERS), o["op"] + 1, 1))), "")
    lines = a.select("fragment_idx", "ref_id", text.alias("cigar"), (F.lit(100) - F.when(F.col("ord") % 50 == 0, 1).otherwise(0)).alias("n"))
    ops = lines.withColumn("ops", A.parse_cigar(F.col("cigar")))
    d = ops.select("ref_id", A.query_length(F.col("ops")).alias("q"), "n", A.clipped_bases(F.col("ops")).alias("clipped"), A.reference_length(F.col("ops")).alias("r"))
    fits = F.col("q") == F.col("n")
    return d.groupBy("ref_id").agg(F.count_if(fits).alias("records"), F.count_if(~fits).alias("skipped"), F.sum(F.when(fits, F.col("clipped"))).alias("clipped"), F.sum(F.when(fits, F.col("r"))).alias("covered"))
