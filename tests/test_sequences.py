"""Composition, reading frames and assembly statistics."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from txgauge.functions import sequence
from txgauge.operators import assembly_stats


def slow_orf(seq):
    """A state machine over the codons of all six frames."""
    best = 0
    for s, start, stops in ((seq, "ATG", {"TAG", "TAA", "TGA"}), (seq[::-1], "TAC", {"ATC", "ATT", "ACT"})):
        for frame in range(3):
            count = 0
            for i in range(frame, len(s) - 2, 3):
                codon = s[i : i + 3]
                if codon in stops:
                    best, count = max(best, count or 0), None
                elif count is not None:
                    count += 1
                elif codon == start:
                    count = 1
            best = max(best, count or 0)
    return best


def sequences():
    rnd = random.Random(8)
    out = ["", "A", "AT", "ATG", "TAG", "TAGATG", "ATGAAACCCTAG", "ATG" * 10, "a" * 3000, "TAA" * 50, "GGCCAATTNN", "NNNN", "atgc\nATGC", "ATGé" * 9]
    for alphabet in ("ACGT", "ACGTN", "ACGTacgt", "ACGTRYKM"):
        out += ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([3, 4, 5, 30, 200, 1000]))) for _ in range(60)]
    codons = ["ATG", "TAG", "TAA", "TGA", "CAT", "CTA", "TTA", "TCA", "AAA", "CCC", "GCA"]
    out += ["".join(rnd.choice(codons) for _ in range(rnd.randrange(1, 90)))[rnd.randrange(3) :] for _ in range(200)]
    return out


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "i long, seq string")


def test_longest_orf(spark):
    seqs = sequences()
    got = {r.i: r.orf for r in frame(spark, seqs).select("i", sequence.longest_orf(F.col("seq")).alias("orf")).collect()}
    assert got == {i: slow_orf(s) for i, s in enumerate(seqs)}


def test_longest_orf_reads_a_frame_once(spark):
    """One pass a frame over a sequence that is made once a strand, whatever characters are in it."""
    seqs = ["\n".join(["ATGAAA", "CCATAG", "TAAATG"] * k) for k in range(1, 9)] + ["😀ATG" * 7, "TAA😀\r\nATGé" * 5, "\u2028TAGATG\u0085CC"]
    d = frame(spark, seqs).select("i", sequence.longest_orf(F.col("seq")).alias("orf"))
    assert {r.i: r.orf for r in d.collect()} == {i: slow_orf(s) for i, s in enumerate(seqs)}
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") == plan.count("regexp_extract_all(") == 6 and plan.count("reverse(") == 1


def test_longest_orf_of_nothing(spark):
    d = spark.createDataFrame([(None,), ("",)], "seq string")
    assert [r[0] for r in d.select(sequence.longest_orf(F.col("seq"))).collect()] == [0, 0]


def test_longest_orf_of_a_chromosome(spark):
    """No recursion in the expressions, however long a frame is open."""
    s = "ACC" * 700_000
    assert frame(spark, [s]).select(sequence.longest_orf(F.col("seq"))).first()[0] == slow_orf(s)


def test_composition(spark):
    seqs = sequences()
    comp, pairs = sequence.composition(F.col("seq")), sequence.dinucleotides(F.col("seq"))
    for r in frame(spark, seqs).select("i", sequence.prop_gc(F.col("seq")).alias("share"), *[c.alias(k) for k, c in comp.items()], *[c.alias(k) for k, c in pairs.items()]).collect():
        s = "".join(c if c in "acgt" else "n" for c in seqs[r.i].translate(str.maketrans("ACGT", "acgt")))
        assert all(r[b] == s.count(b) for b in "acgtn")
        assert r.share == pytest.approx((s.count("g") + s.count("c")) / len(s) if s else 0)
        assert all(r[d] == sum(s[i : i + 2] == d for i in range(len(s) - 1)) for d in pairs)


def slow_nx(lengths):
    total, cum, out = sum(lengths), 0, []
    goals = [total * t for t in (0.1, 0.3, 0.5, 0.7, 0.9)]
    for n in sorted(lengths):
        if n >= 200:
            cum += n
            if len(out) < 5 and cum >= goals[len(out)]:
                out.append(n)
    return out + [max(lengths)] * (5 - len(out))


def table(spark, lengths, by=None):
    rows = [(i, f"c{i}", "", n, n // 2, by(i) if by else 0) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "contig_idx long, name string, seq string, length int, orf_length long, assembly int")


def test_nx(spark):
    rnd = random.Random(2)
    sets = [[1000] * 10, [300] * 9 + [10_000], [100] * 10 + [1000], [100] * 50 + [500], [150], [200], [5000, 200, 200]]
    sets += [[rnd.choice([100, 250, 400, 900, 5000, rnd.randrange(50, 9000)]) for _ in range(rnd.randrange(1, 40))] for _ in range(60)]
    flat = [(k, n) for k, s in enumerate(sets) for n in s]
    d = table(spark, [n for _, n in flat], lambda i: flat[i][0])
    got = {r.assembly: [r[f"n{p}"] for p in assembly_stats.NX] for r in assembly_stats.nx(d, ["assembly"]).collect()}
    assert got == {k: slow_nx(s) for k, s in enumerate(sets)}
    assert list(assembly_stats.nx(table(spark, sets[1])).first()) == slow_nx(sets[1])


def test_basic_stats(spark):
    r = assembly_stats.basic_stats(table(spark, [100] * 10 + [1000])).first()
    assert r.asDict() == {"n_seqs": 11, "smallest": 100, "largest": 1000, "n_bases": 2000, "mean_len": 1000 / 11, "n_under_200": 10, "n_over_1k": 0, "n_over_10k": 0, "n_with_orf": 1, "mean_orf_percent": pytest.approx(150.0)}
    empty = table(spark, [100]).limit(0)
    assert set(assembly_stats.basic_stats(empty).first()) == {0} and set(assembly_stats.nx(empty).first()) == {0}
    assert assembly_stats.base_stats(empty).first().asDict() == {"gc": 0.0, "bases_n": 0, "proportion_n": 0.0}


def test_base_stats(spark):
    d = frame(spark, ["GGCCAATTNN", "NNNN"])
    assert assembly_stats.base_stats(d).first().asDict() == {"gc": 0.5, "bases_n": 6, "proportion_n": pytest.approx(6 / 14)}
