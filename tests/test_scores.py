"""Scores, cutoffs, comparisons, picks and fleets."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from txgauge.functions import score as S
from txgauge.functions.values import verdict
from txgauge.operators import comparison, fleet, picks, scoring


def slow_curve(rows, fragments):
    rows = sorted(rows, key=lambda r: r[1])
    out = {}
    for i, (_, s, _) in enumerate(rows):
        left = rows[i + 1 :]
        if left:
            out[s] = math.exp(sum(math.log(x[1]) for x in left) / len(left)) * sum(x[2] for x in left) / fragments
    return out


@pytest.mark.parametrize("seed", range(6))
def test_score_curve(spark, seed):
    rnd = random.Random(seed)
    n = [1, 2, 3, 40, 40, 3000][seed]
    rows = [(i, rnd.choice([0.01, 0.5, 1.0, rnd.uniform(0.01, 1)] if seed % 2 else [0.01, 0.3, 0.9]), rnd.randrange(9)) for i in range(n)]
    d = spark.createDataFrame(rows, "contig_idx long, score double, good long").repartition(4)
    want = slow_curve(rows, 1000)
    curve = scoring.score_curve(d, 1000)
    got = {r.cutoff: r.assembly_score for r in curve.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())
    best = scoring.optimum(curve).first()
    top = max(want.values(), default=0)
    assert best.optimal_score == pytest.approx(top) and (best.cutoff == 0) == (top == 0)
    r = scoring.assembly_scores(d.withColumn("tpm", F.lit(2.0)), 300, 1000).first()
    assert r.score == pytest.approx(math.exp(sum(math.log(x[1]) for x in rows) / n) * 0.3)
    assert r.weighted == pytest.approx(sum(2 * x[1] for x in rows) / n * 0.3)


def test_scores_without_contigs_or_fragments(spark):
    d = spark.createDataFrame([(0, 0.5, 1, 1.0)], "contig_idx long, score double, good long, tpm double")
    for x, f in ((d.limit(0), 10), (d, 0)):
        assert list(scoring.assembly_scores(x, 1, f).first()) == [0.0, 0.0]
        assert list(scoring.optimum(scoring.score_curve(x, f)).first()) == [0.0, 0.0]


def test_contig_score(spark):
    rows = [(1.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0), (0.5, 0.5, 0.5, -2.0), (0.2, 0.9, 0.0, 1.0)]
    d = spark.createDataFrame(rows, "c double, s double, g double, q double")
    cols = [F.col(x) for x in "csgq"]
    for r in d.select("*", S.contig_score(*cols).alias("score"), *[x.alias(f"no_{k}") for k, x in S.alternative_scores(*cols).items()]).collect():
        c, s, g, q = (max(x, 0.01) for x in r[:4])
        assert r.score == max(c * s * g * q, 0.01)
        assert (r.no_cov, r.no_seg, r.no_good, r.no_seq) == (s * g * q, c * g * q, c * s * q, c * s * g)


def test_verdict(spark):
    cases = [("1", "1", "same"), ("1", "1.000001", "rounding"), ("1", "1.1", "differs"), ("a", "b", "differs"), ("nan", "1", "differs"), ("", "1", "differs"), (None, "", "same"), ("1.0", "1", "same"), (None, "3", "differs")]
    d = spark.createDataFrame(cases, "a string, b string, want string")
    assert all(r.want == r.got for r in d.withColumn("got", verdict(F.col("a"), F.col("b"))).collect())


def runs(spark):
    rnd = random.Random(9)
    base = [(f"c{i}", str(300 + i), str(rnd.random()), str(rnd.choice([0.01, rnd.random()]))) for i in range(120)]
    other = [(n, k, g, str(min(1.0, float(s) + rnd.choice([0, 0, 1e-8, 0.1, -0.1])))) for n, k, g, s in base]
    cols = "contig_name string, length string, prop_gc string, score string"
    return base, other, spark.createDataFrame(base, cols), spark.createDataFrame(other, cols)


def test_paired_summary(spark):
    base, other, a, b = runs(spark)
    delta = [float(y[3]) - float(x[3]) for x, y in zip(base, other, strict=True)]
    moved = sorted(x for x in delta if abs(x) > 1e-6)
    r = comparison.paired_summary(a, b).first()
    up, down = sum(x > 0 for x in moved), sum(x < 0 for x in moved)
    mean = sum(delta) / 120
    assert (r.metric, r.n, r.changed, r.up, r.down) == ("score", 120, len(moved), up, down)
    assert r.mean == pytest.approx(mean) and r.max_abs == pytest.approx(max(map(abs, delta)))
    assert r.se == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in delta) / 119 / 120))
    mid = len(moved) // 2
    assert r.median_changed == pytest.approx(moved[mid] if len(moved) % 2 else (moved[mid - 1] + moved[mid]) / 2)
    assert r.z == pytest.approx((up - down) / math.sqrt(up + down))


def test_validity(spark):
    _, _, a, b = runs(spark)
    keys = ("length", "prop_gc")
    good = comparison.contig_validity(a, b, keys)
    assert {r.metric: r.differing for r in good.collect()} == {"length": 0, "prop_gc": 0, "contig_set": 0}
    bad = comparison.contig_validity(a, b.filter("contig_name <> 'c3'").withColumn("length", F.when(F.col("contig_name") == "c5", "1").otherwise(F.col("length"))), keys)
    assert {r.metric: r.differing for r in bad.collect()} == {"length": 1, "prop_gc": 0, "contig_set": 1}
    row = spark.createDataFrame([("5", "0.5")], "n_seqs string, gc string")
    near = spark.createDataFrame([("5", "0.500001")], "n_seqs string, gc string")
    v = comparison.assembly_validity(row, near)
    assert {r.metric: r.verdict for r in v.collect()} == {"n_seqs": "same", "gc": "rounding"}
    assert comparison.is_valid(v, good).first()[0] and not comparison.is_valid(v, bad).first()[0]


def test_deltas_and_decomposition(spark):
    names = "score string, p_good_mapping string, fragments string, good_mappings string"
    a, b, r = (spark.createDataFrame([x], names) for x in (("0.2", "0.5", "100", "50"), ("0.3", "0", "100", "60"), ("0.2", "0.5", "100", "51")))
    d = {x.metric: x for x in comparison.metric_deltas(a, b, r).collect()}
    assert d["score"].delta == pytest.approx(0.1) and d["score"].times_noise == math.inf
    assert d["good_mappings"].times_noise == 10 and d["fragments"].times_noise == 0
    x = comparison.decomposition(a, b).first()
    assert (x.base_geomean, x.other_rate, x.from_rate, x.from_contigs) == pytest.approx((0.4, 0.6, 0.04, 0.05))
    assert x.residual == pytest.approx(0.01) and x.unexplained


def test_ranks(spark):
    base, other, a, b = runs(spark)
    num = lambda d: d.select("contig_name", F.substring("contig_name", 2, 9).cast("long").alias("contig_idx"), F.col("score").cast("double"))
    a, b = num(a), num(b)
    r = comparison.rank_agreement(a, b, 0.5, 0.4).first()
    x, y = [float(v[3]) for v in base], [float(v[3]) for v in other]
    assert r.both_good == sum(p >= 0.5 and q >= 0.4 for p, q in zip(x, y, strict=True)) and r.both_good + r.both_bad + r.lost + r.gained == 120
    pairs = [(i, j) for i in range(120) for j in range(i)]
    free = [(i, j) for i, j in pairs if x[i] != x[j] and y[i] != y[j]]
    true = sum((x[i] < x[j]) != (y[i] < y[j]) for i, j in free) / len(free)
    got = comparison.rank_discordance(a, b, 120, 60_000).first()
    assert got.discordance == pytest.approx(true, abs=0.01) and got.ties == pytest.approx(1 - len(free) / len(pairs), abs=0.02)
    assert list(comparison.rank_discordance(a.limit(0), b, 0, 10).first()) == [None, None]


def test_picks(spark):
    groups = spark.createDataFrame([("1.groups", ["a", "b"]), ("10.groups", ["c", "a"]), ("2.groups", ["z"]), ("3.groups", ["d", "e"]), ("4.groups", []), ("5.groups", ["z0"])], "label string, members array<string>")
    score = lambda rows: picks.best_scores(spark.createDataFrame(rows, "name string, score double"))
    old = score([("a", 0.5), ("b", 0.5), ("c", 0.1), ("c", 0.6), ("d", 0.3), ("z0", 0.0), ("x", None)])
    new = score([("a", 0.5), ("b", 0.505), ("c", 0.2), ("e", 0.4)])
    assert {r.label: r.pick for r in picks.picks(groups, old).collect()} == {"1.groups": "a", "10.groups": "c", "3.groups": "d"}
    d = picks.compared(groups, old, new).cache()
    got = {r.label: r for r in d.collect()}
    assert {k: r.outcome for k, r in got.items()} == {"1.groups": "changed", "10.groups": "changed", "2.groups": "neither", "3.groups": "changed", "5.groups": "neither"}
    assert got["1.groups"].near_tie and got["1.groups"].new_margin == pytest.approx(0.005)
    assert (got["3.groups"].old_margin, got["3.groups"].new_margin) == (0.3, 0.4)
    c = picks.outcome_counts(d).first()
    assert (c.groups, c.changed, c.neither, c.near_ties, c.slots, c.found_old, c.enough_members) == (5, 3, 2, 1, 8, 6, False)
    assert [r.label for r in picks.largest_disagreements(d, 2).collect()] == ["3.groups", "10.groups"]


def test_fleet(spark):
    a = spark.createDataFrame([("p1", "r/p1", "1")], "pair_id string, result_dir string, score string")
    b = spark.createDataFrame([("p2", "r/p2", "2")], "pair_id string, result_dir string, cutoff string")
    meta = spark.createDataFrame([("p1", "Mus")], "pair_id string, organism string")
    manifest = spark.createDataFrame([("p1", 2), ("p3", 1)], "pair_id string, n_read_pairs long")
    m = fleet.merged_metrics(fleet.stacked([a, b]), meta, manifest)
    assert m.columns == [*fleet.LEAD, "score", "cutoff"]
    assert sorted(map(tuple, m.collect())) == [("p1", "Mus", "", "", "", "2", "r/p1", "1", ""), ("p2", "", "", "", "", "", "r/p2", "", "2")]
    assert [r.pair_id for r in fleet.missing_jobs(manifest, m).collect()] == ["p3"]
