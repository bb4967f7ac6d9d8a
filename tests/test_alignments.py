"""BAM decoding, assignment, accumulation, coverage, segmentation and fragment size."""

from __future__ import annotations

import math
import random
from itertools import groupby

import pytest
from bamfile import cigar, pair, record, write

from txgauge.operators import accumulation, assignment, coverage, fragment_size, segmentation
from txgauge.plans import assess
from txgauge.sources import bam
from txgauge.streaming import counters as stream

REFS = [("contigA", 400), ("contigB", 300)]
CIGARS = ["100M", "50M10D50M", "50M10I40M", "10S90M", "90M10S", "10S80M10S", "5S30M5D30M10I20M5S", "40M20N40M", "100=", "50=10X40="]


def load(spark, tmp_path, records, refs=REFS, **how):
    path = write(tmp_path / "x.bam", refs, records, **how)
    return bam.read_bam(spark, path), bam.read_references(spark, path)


def test_decoding(spark, tmp_path):
    extra = b"XZZhello NMC\0XBBs\x02\0\0\0\1\0\2\0XAAq"
    recs = [record("a", 99, 0, 5, "10S90M", 1, 7, 3, extra=extra), record("a", 147, 1, 7, "50M10I40M", 0, 5, None), record("b", 4, -1, -1, "", nm=None, n_seq=80), record("c", 256, 0, 9, "5H20M", n_seq=0)]
    got = load(spark, tmp_path, recs)[0].orderBy("ord").collect()
    assert [(r.ord, r.fragment_idx, r.qname, r.flag, r.ref_id, r.pos, r.query_len, r.next_ref_id, r.next_pos, r.nm) for r in got] == [
        (0, 0, "a", 99, 0, 5, 100, 1, 7, 3), (1, 0, "a", 147, 1, 7, 100, 0, 5, None), (2, 1, "b", 4, -1, -1, 80, -1, -1, None), (3, 2, "c", 256, 0, 9, 25, -1, -1, 0)]
    assert [tuple(c) for c in got[0].cigar] == cigar("10S90M")
    assert bam.header(tmp_path / "x.bam") == REFS and bam.is_complete(tmp_path / "x.bam")


def test_malformed_records(spark, tmp_path):
    bad = record("bad", 0, 0, 5, "90M", n_seq=100)
    recs = [record("a"), bad, *[bad] * 60, record("b"), *[bad] * 99, record("c")]
    d, _ = load(spark, tmp_path, recs)
    assert [(r.qname, r.skipped) for r in d.orderBy("ord").collect()] == [("a", 0), ("b", 61), ("c", 160)]
    path = write(tmp_path / "y.bam", REFS, [record("a"), *[bad] * 100, record("b")])
    with open(path, "rb") as f, pytest.raises(bam.MalformedBam):
        blocks = bam.Blocks(f)
        bam.read_header(blocks)
        list(bam.decoded(blocks))
    data = open(path, "rb").read()
    (tmp_path / "z.bam").write_bytes(data[: len(data) // 2])
    with open(tmp_path / "z.bam", "rb") as f, pytest.raises(bam.MalformedBam):
        blocks = bam.Blocks(f)
        bam.read_header(blocks)
        list(bam.decoded(blocks))
    assert not bam.is_complete(tmp_path / "z.bam")


def slow_depth(n, placed):
    depth = [0] * n
    for pos, cig in placed:
        for op, k in cigar(cig):
            if op in (0, 7, 8):
                for p in range(pos, min(pos + k, n)):
                    depth[p] += 1
            pos += k if op in (0, 2, 3, 7, 8) else 0
    return depth


def test_coverage(spark, tmp_path):
    rnd = random.Random(20)
    placed = [(0, rnd.randrange(0, 390), rnd.choice(CIGARS)) for _ in range(300)] + [(1, 250, "100M"), (1, 299, "100M")]
    d, refs = load(spark, tmp_path, [record(f"r{i}", 0, r, p, c) for i, (r, p, c) in enumerate(placed)])
    runs = coverage.runs(coverage.blocks(d, refs, 3)).cache()
    unc = {r.ref_id: r.bases_uncovered for r in coverage.bases_uncovered(refs, runs).collect()}
    states = {(r.ref_id, r.bin): r.state for r in coverage.bin_states(refs, runs).collect()}
    for k, (_, n) in enumerate(REFS):
        depth = slow_depth(n, [(p, c) for r, p, c in placed if r == k])
        got = [0] * n
        for r in runs.filter(f"ref_id = {k}").collect():
            got[r.start : r.end] = [r.depth] * (r.end - r.start)
        assert got == depth
        assert unc[k] == depth.count(0)
        w = n // 30 + 1
        for b in range(30):
            part = depth[b * w : (b + 1) * w]
            mean = sum(part) // len(part) if part else 0
            assert states[k, b] == (min(24, mean.bit_length() - 1) if mean else 0)


def slow_posterior(states, prior=0.7, k=24):
    def log_p(x):
        x = [min(max(s, 0), k - 1) for s in x]
        return math.lgamma(k) - math.lgamma(k + len(x)) + sum(math.lgamma(x.count(s) + 1) for s in set(x))

    n = len(states)
    if n < 2:
        return 1.0
    one, two = math.exp(log_p(states)), sum(math.exp(log_p(states[:i]) + log_p(states[i:])) for i in range(1, n)) / (n - 1)
    return prior * one / (prior * one + (1 - prior) * two)


def test_segmentation(spark):
    rnd = random.Random(3)
    vectors = [[0] * 30, [3] * 28 + [0, 0], [3] * 28, [0] * 15 + [12] * 15, list(range(30)), [-3, 99, 5], [4], [1, 2]]
    vectors += [[rnd.randrange(0, rnd.choice([2, 5, 25])) for _ in range(30)] for _ in range(100)]
    rows = [(i, b, s) for i, v in enumerate(vectors) for b, s in enumerate(v)]
    d = spark.createDataFrame(rows, "ref_id int, bin int, state int").repartition(5)
    got = {r.ref_id: r.p_not_segmented for r in segmentation.prob_not_segmented(d).collect()}
    assert all(got[i] == pytest.approx(slow_posterior(v), rel=1e-9) for i, v in enumerate(vectors))
    assert [round(got[i], 10) for i in range(4)] == [0.9974241427, 0.9164214667, 0.9971275498, 0.1268053717]
    half = segmentation.prob_not_segmented(d, null_prior=0.2)
    assert {r.ref_id: r.p_not_segmented for r in half.collect()}[3] == pytest.approx(slow_posterior(vectors[3], 0.2))


def slow_assign(records, refs, counts):
    """ord of the records that stay; records: (ord, name, flag, ref, length, nm)."""
    e, out = 0.01, []
    like = lambda nm, n: nm * math.log(e) + (n - nm) * math.log1p(-e) if n > 0 else 0.0
    for _, batch in groupby(records, key=lambda r: r[1]):
        batch = [r for r in batch if not r[2] & 4]
        total, own = {}, {}
        for _, _, flag, ref, n, nm in batch:
            total[ref] = total.get(ref, 0.0) + like(min(max(nm or 0, 0), n), n)
            own[ref] = own.get(ref, 0) | (2 if flag & 128 else 1)
        mates = 0
        for o in own.values():
            mates |= o
        longest = max((r[4] for r in batch), default=0)

        def rank(ref, total=total, own=own, mates=mates, longest=longest):
            p = counts.get(refs[ref], 0.0) + 1e-3
            lost = mates.bit_count() - own[ref].bit_count()
            return (-(math.log(p) + total[ref] + lost * like(0.15 * longest, longest)), -p, refs[ref])

        if total:
            best = min(total, key=rank)
            out += [r[0] for r in batch if r[3] == best]
    return out


@pytest.mark.parametrize(("nm", "winner"), [(7, 1), (8, 0)])
def test_orphan_crossover(spark, tmp_path, nm, winner):
    """A pair of seven mismatches a mate beats a single perfect mate, one of eight does not."""
    recs = [record("f", 1 | 64, 0, 10, nm=0), record("f", 1 | 64, 1, 10, nm=nm), record("f", 1 | 128, 1, 100, nm=nm)]
    d, refs = load(spark, tmp_path, recs)
    assert {r.ref_id for r in assignment.assign(d, assignment.prior_table(refs), 2).collect()} == {winner}


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_assignment(spark, tmp_path, parts):
    rnd = random.Random(11)
    refs = [(f"tx{i}", 500) for i in (2, 10, 1, 3)]
    recs, rows = [], []
    for f in range(300):
        for _ in range(rnd.randrange(1, 6)):
            flag, ref, nm, cig = 1 | rnd.choice([64, 128]) | rnd.choice([0, 256]) | (4 if rnd.random() < 0.1 else 0), rnd.randrange(4), rnd.choice([0, 0, 1, 4, None, 200]), rnd.choice(["100M", "50M", "20S40M"])
            rows.append((len(rows), f"f{f}", flag, ref, sum(k for _, k in cigar(cig)), nm))
            recs.append(record(f"f{f}", flag, ref, rnd.randrange(300), cig, nm=nm))
    d, r = load(spark, tmp_path, recs, refs)
    counts = {"tx1": 50.0, "tx3": 50.0, "tx2": 2.0}
    priors = assignment.prior_table(r, spark.createDataFrame(list(counts.items()), "name string, eff_count double"))
    got = assignment.assign(d.repartition(parts), priors, 4)
    assert sorted(x.ord for x in got.collect()) == slow_assign(rows, [n for n, _ in refs], counts)
    assert got.filter("flag & 256 <> 0").count() == 0
    best = {x.fragment_idx: x for x in assignment.candidates(d, priors, 4).orderBy("score").collect()}
    assert len(best) == got.select("fragment_idx").distinct().count()


def test_ties_go_to_the_lesser_name(spark, tmp_path):
    for order in ((0, 1), (1, 0)):
        d, refs = load(spark, tmp_path, [record("f", 0, r, 5, nm=1) for r in order], [("b", 200), ("a", 200)])
        assert [r.ref_id for r in assignment.assign(d, assignment.prior_table(refs), 2).collect()] == [1]


def accumulated(spark, tmp_path, recs, distance=300):
    d, refs = load(spark, tmp_path, recs)
    return {r.name: r for r in accumulation.over_references(refs, accumulation.counters(d, distance)).collect()}


def test_counters(spark, tmp_path):
    recs = [r for i in range(5) for r in pair(f"p{i}", 0, 10 + 20 * i, 50)]
    a = accumulated(spark, tmp_path, recs)["contigA"]
    assert (a.good, a.both_mapped, a.fragments_mapped, a.properpair, a.bridges, a.reads_mapped, a.bases_mapped) == (5, 5, 5, 5, 0, 10, 500)
    odd = [
        record("bridge", 1 | 64 | 32, 0, 10, "50M", 1, 40), record("far", 1 | 64 | 32, 0, 10, "50M", 0, 350), record("same", 1 | 64, 0, 10, "50M", 0, 60),
        record("equal", 1 | 64 | 32, 0, 10, "50M", 0, 10), record("orphan", 1 | 128 | 8, 0, 10, "50M"), record("second", 1 | 128 | 16, 0, 10, "50M", 0, 90),
    ]
    a = accumulated(spark, tmp_path, odd)["contigA"]
    assert (a.bridges, a.good, a.fragments_mapped, a.both_mapped) == (1, 0, 5, 4)
    a = accumulated(spark, tmp_path, [record("a", 0, 0, 100, "20S80M"), record("b", 0, 0, 100, "80M20S"), record("c", 0, 0, 100, nm=None)])
    c = a["contigA"]
    assert (c.clipped_alignments, c.clipped_bases, c.leading_clipped_bases, c.scored_alignments, c.reads_mapped) == (2, 40, 20, 2, 3)
    assert a["contigB"].reads_mapped == 0


@pytest.mark.parametrize(("nm", "want"), [(0, 1.0), (35, 0.0), (70, -1.0)])
def test_p_seq_true(spark, tmp_path, nm, want):
    d, refs = load(spark, tmp_path, [record("a", 0, 0, 0, nm=nm)])
    got = {r.name: r for r in assess.reference_metrics(d, refs, 300).collect()}
    assert got["contigA"].p_seq_true == want and got["contigB"].p_seq_true == 1.0
    assert got["contigB"].bases_uncovered == 300 and round(got["contigB"].p_not_segmented, 6) == 0.997424


def test_merged_counters_do_not_depend_on_partitions(spark, tmp_path):
    recs = [r for i in range(60) for r in pair(f"p{i}", i % 2, 5 * (i % 20), 60, nm=i % 5)]
    d, _ = load(spark, tmp_path, recs)
    whole = sorted(accumulation.counters(d, 300).collect())
    parts = [accumulation.counters(d.filter(f"fragment_idx % 3 = {k}"), 300) for k in range(3)]
    assert sorted(accumulation.counters(d.repartition(7), 300).collect()) == whole == sorted(stream.merged_counters(*parts).collect())
    folder = tmp_path / "arriving"
    d.repartition(3).write.parquet(f"file://{folder}")
    q = stream.stream_counters(spark, f"file://{folder}", d.schema, 300, "totals", f"file://{tmp_path}/state")
    q.awaitTermination(120)
    assert sorted(spark.table("totals").collect()) == whole


def slow_size(recs, limit=10_000):
    prev, sizes = None, []
    for name, flag, pos, n, mate in recs:
        if flag & (256 | 2048):
            continue
        p = -1 if flag & 4 else pos
        if prev and prev[0] == name and p >= 0 and prev[1] >= 0 and len(sizes) < limit:
            r, m = flag & 16, flag & 32
            if not (not r and m and p > mate) and not (r and not m and mate > p):
                sizes.append(p - prev[1] + n if p > prev[1] else prev[1] - p + prev[2])
        prev = (name, p, n)
    if not sizes:
        return 0
    mean, s = float(sizes[0]), 0.0
    for k, x in enumerate(sizes[1:], 1):
        new = mean + (x - mean) / k
        s, mean = s + (x - mean) * (x - new), new
    return int(3 * (math.sqrt(s / (len(sizes) - 1)) if len(sizes) > 1 else 0) + sum(sizes) // len(sizes))


@pytest.mark.parametrize("limit", [5, 10_000])
def test_fragment_size(spark, tmp_path, limit):
    rnd = random.Random(6)
    rows = []
    for i in range(200):
        for _ in range(rnd.choice([1, 2, 2, 2, 3])):
            rows.append((f"q{i}", rnd.choice([1 | 64 | 32, 1 | 128 | 16, 1 | 64, 4 | 1, 256 | 1, 1 | 64 | 16 | 32]), rnd.randrange(300), 100, rnd.randrange(300)))
    d, _ = load(spark, tmp_path, [record(n, f, 0, p, "100M", 0, m) for n, f, p, _, m in rows])
    assert fragment_size.realistic_distance(d, limit) == slow_size(rows, limit)
    assert fragment_size.realistic_distance(d.limit(0)) == 0
    pairs = spark.createDataFrame([(i, x) for i, x in enumerate([200, 210, 190, 205])], "ord long, size long")
    assert fragment_size.estimate(pairs).first()[0] == 226
    assert fragment_size.estimate(pairs, faithful=False).first()[0] == int(201.25 + 3 * 8.539125638299666)


def test_sorted_by_place_gives_no_size(spark, tmp_path):
    recs = [r for i in range(50) for r in pair(f"p{i}", 0, i, 200)]
    d, _ = load(spark, tmp_path, recs)
    assert fragment_size.realistic_distance(d) > 0
    d, _ = load(spark, tmp_path, [*recs[::2], *recs[1::2]])
    assert fragment_size.realistic_distance(d) == 0
