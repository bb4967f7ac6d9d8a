"""Readers, writers, and assessments from files to files."""

from __future__ import annotations

import csv
import gzip

import pytest
from bamfile import pair, record, write

from txgauge import cli
from txgauge.operators import comparison
from txgauge.plans import assess, reports
from txgauge.session import numbered
from txgauge.sources import fasta, files, sinks, tables


def test_gzip_by_content(tmp_path):
    (tmp_path / "a.fa").write_bytes(gzip.compress(b">x\nACGT\n"))
    (tmp_path / "b.fa.gz").write_bytes(b">x\nACGT\n")
    assert files.is_gzip(tmp_path / "a.fa") and not files.is_gzip(tmp_path / "b.fa.gz") and not files.is_gzip(tmp_path / "none")
    assert all(files.open_text(tmp_path / n).read() == ">x\nACGT\n" for n in ("a.fa", "b.fa.gz"))
    assert files.without_gzip_suffix("d/x.fa.GZ").name == "x.fa" and files.without_gzip_suffix("x.fa.gzip").name == "x.fa" and files.without_gzip_suffix("x.fa").name == "x.fa"
    out = tmp_path / "out"
    out.mkdir()
    with pytest.raises(RuntimeError), files.plain_copy(tmp_path / "a.fa", out) as p:
        assert p.read_text() == ">x\nACGT\n"
        raise RuntimeError
    assert not list(out.iterdir())
    with files.plain_copy(tmp_path / "b.fa.gz", out) as p:
        assert p == tmp_path / "b.fa.gz"


def test_fasta(spark, tmp_path):
    text = "junk\n>a;; one two\nACG \n\n TTT\r\n>b|x\nA\0CG\n>\nGG\n> \tc d\nT\n"
    (tmp_path / "x.fa").write_text(text, newline="")
    (tmp_path / "y.fa").write_bytes(gzip.compress(text.encode()))
    for n in ("x.fa", "y.fa"):
        got = fasta.read_fasta(spark, tmp_path / n).orderBy("contig_idx").collect()
        assert [(r.contig_idx, r.name, r.seq, r.length) for r in got] == [(0, "a", "ACGTTT", 6), (1, "b|x", "ACG", 3), (2, "", "GG", 2), (3, "c", "T", 1)]
        assert fasta.count_contigs(tmp_path / n) == 4
    assert fasta.read_fasta(spark, tmp_path / "x.fa", tmp_path / "y.fa").count() == 8
    ids = spark.createDataFrame([("ENA|ACC|ACC.1 words",), ("a|b|c",), ("plain x",)], "d string")
    assert [r[0] for r in ids.select(fasta.archive_name(ids.d)).collect()] == ["ACC", "a_b_c", "plain"]


@pytest.mark.parametrize("bad", [">a\n>b\nAC\n", ">a\nAC\n>a x\nGT\n", ">a,b\nAC\n"])
def test_fasta_constraints(spark, tmp_path, bad):
    (tmp_path / "x.fa").write_text(bad)
    with pytest.raises(ValueError, match="contig"):
        fasta.load_assembly(spark, tmp_path / "x.fa")


QUANT = "Name\tLength\tEffectiveLength\tTPM\tNumReads\ntx0\t1000\t850.5\t123.4\t42.7\ntx1\t10\t0\t0\t0\n"


def test_quant(spark, tmp_path):
    p = tmp_path / "quant.sf"
    p.write_text(QUANT)
    assert [tuple(r) for r in tables.read_quant(spark, str(p)).collect()] == [("tx0", 1000, 850, 123.4, 42.7), ("tx1", 10, 0, 0.0, 0.0)]
    assert tables.quant_problem(p, 2) is None and "3 references" in tables.quant_problem(p, 3)
    for text in ("", QUANT[:-1], QUANT.split("\n")[0] + "\n", QUANT + "tx2\t1\n"):
        p.write_text(text)
        assert tables.quant_problem(p)
    with pytest.raises(Exception, match="not five fields"):
        tables.read_quant(spark, str(p)).collect()


def test_reads(tmp_path):
    read = lambda n: f"@r\n{'A' * n}\n+\n{'I' * n}\n"
    a, b, c = (tmp_path / x for x in ("a.fq", "b.fq", "c.fq.gz"))
    a.write_text(read(50) + read(75) + read(100))
    b.write_bytes(gzip.compress(read(60).encode()))
    c.write_bytes(gzip.compress((read(10) * 50_000).encode())[:-500])
    assert tables.longest_read(f"{a},{b}") == 100 and tables.longest_read(str(b)) == 60
    assert tables.count_reads(f"{a},{b}") == (4, [])
    n, cut = tables.count_reads(f"{a},{c}")
    assert cut == [str(c)] and 3 < n < 50_003


def rows_of(path):
    with open(path, newline="") as f:
        return list(csv.reader(f))


def library(tmp_path, name="x"):
    """Six contigs of 600 bases: four well covered, one with a single pair, one without reads."""
    (tmp_path / f"{name}.fa").write_text("".join(f">c{i} text\n{('ACGT' * 150)[i:]}{'A' * i}\n" for i in range(6)))
    recs = [r for c in range(4) for k in range(19) for r in pair(f"c{c}p{k}", c, 20 * k, 120, "10S90M", "100M", nm=2)] + pair("one", 4, 100, 120, "100M")
    recs += [record("lost", 4 | 64 | 1, -1, -1, "")]
    path = write(tmp_path / f"{name}.bam", [(f"c{i}", 600) for i in range(6)], recs)
    quant = tmp_path / f"{name}.sf"
    quant.write_text("Name\tLength\tEffectiveLength\tTPM\tNumReads\n" + "".join(f"c{i}\t600\t500\t{10.5 * i}\t{19 - i}\n" for i in range(6)))
    return str(tmp_path / f"{name}.fa"), path, str(quant)


@pytest.fixture(scope="module")
def assessed(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("run")
    fa, b, q = library(tmp)
    result = assess.run(spark, [fa], str(tmp / "out"), [b], [q], fragments=100, settings=assess.Settings(distance=400))[0]
    return tmp, fa, result


def test_assessment(spark, assessed):
    tmp, fa, result = assessed
    rows = rows_of(tmp / "out/contigs.csv")
    assert rows[0] == list(sinks.contig_columns()) and len(rows[0]) == 18 and [r[0] for r in rows[1:]] == [f"c{i}" for i in range(6)]
    score = {r[0]: float(r[8]) for r in rows[1:]}
    assert score["c0"] > score["c4"] and score["c5"] == 0.01
    assert result["fragments_mapped"] == 77 and result["good_mappings"] == 77 and result["bad_mappings"] == 0
    assert result["optimal_score"] > result["score"] > 0 and result["contigs_uncovbase"] == 6
    assert result["clipped_alignments"] == 76 and result["clipped_bases"] == 760
    a = rows_of(tmp / "out/assemblies.csv")
    assert len(a) == 2 and len(a[0]) == 40 and a[0][36:38] == ["score", "optimal_score"] and a[1][0] == fa
    assert float(a[1][36]) == round(result["score"], 5)
    curve = rows_of(tmp / "out/x.fa_score_optimisation.csv")
    assert curve[0] == ["cutoff", "assembly_score"] and [float(r[0]) for r in curve[1:]] == sorted(float(r[0]) for r in curve[1:])
    assert b"\r\n" in (tmp / "out/contigs.csv").read_bytes()
    with pytest.raises(FileExistsError):
        assess.run(spark, [fa], str(tmp / "out"))
    assert result["good_contigs"] == sum(s >= result["cutoff"] for s in score.values())


def test_sequences_only(spark, tmp_path):
    a, _, _ = library(tmp_path, "a")
    b, _, _ = library(tmp_path, "b")
    assess.run(spark, [a, b], str(tmp_path / "out"))
    rows = rows_of(tmp_path / "out/assemblies.csv")
    assert len(rows) == 3 and len(rows[0]) == 23 and rows[1][-4:] == [""] * 4 and rows[1][1] == "6"
    assert rows_of(tmp_path / "out/a/contigs.csv")[0] == ["contig_name", "length", "prop_gc", "orf_length"]
    with pytest.raises(ValueError, match="twice"):
        assess.run(spark, [a, a], str(tmp_path / "again"))


def test_placed_metrics_and_rows(spark, tmp_path):
    from txgauge.sources import bam

    _, path, _ = library(tmp_path)
    m = assess.placed_metrics(bam.read_bam(spark, path), bam.read_references(spark, path))
    sinks.write_accumulated(m, tmp_path / "m.csv")
    rows = rows_of(tmp_path / "m.csv")
    assert rows[0] == list(sinks.ACCUMULATED) and len(rows) == 7 and rows[6][:3] == ["c5", "1.0", "0"]


def test_runs_compared(spark, assessed, tmp_path, capsys):
    tmp, fa, _ = assessed
    other = tmp_path / "other"
    other.mkdir()
    for n in ("assemblies.csv", "contigs.csv"):
        text = (tmp / "out" / n).read_text()
        (other / n).write_text(text)
    r = reports.compare_runs(spark, str(tmp / "out"), str(other), pairs=1000)
    assert r.valid and {x.changed for x in r.paired.collect()} == {0}
    assert r.agreement.first().pearson == pytest.approx(1) and r.discordance.first().discordance == 0
    assert {x.verdict for x in r.assembly_validity.collect()} == {"same"} and r.assembly_validity.count() == len(comparison.SEQUENCE_KEYS)
    groups = tmp_path / "Orthogroups.txt"
    groups.write_text("OG1: c0 c1\nOG2: c5 c4\n\nOG3: none\n")
    g = tables.read_orthogroups(spark, groups)
    d, counts = reports.compare_picks(spark, str(tmp / "out/contigs.csv"), str(other / "contigs.csv"), g, str(tmp_path / "p"))
    assert (counts.first().same, counts.first().neither) == (2, 1)
    assert (tmp_path / "p.old.list").read_text().split() == [x.old_pick for x in d.orderBy("label").collect() if x.old_pick]
    assert (tmp_path / "p.changed.tsv").read_text().count("\n") == 1


def test_groups(spark, tmp_path):
    (tmp_path / "Orthogroups.txt").write_text("".join(f"OG{i}: m{i} n{i}\n" for i in range(12)))
    g = tables.read_orthogroups(spark, tmp_path / "Orthogroups.txt").orderBy("label").collect()
    assert [r.label for r in g][:4] == ["1.groups", "10.groups", "11.groups", "12.groups"] and g[0].members == ["m0", "n0"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/7.groups").write_text("a\n\n b \n")
    assert [tuple(r) for r in tables.read_group_files(spark, str(tmp_path / "d")).collect()] == [("7.groups", ["a", "b"])]


def test_trees(spark, tmp_path):
    for i, (head, row) in enumerate((("assembly,score", "x.fa,0.5"), ("assembly,score", "y.fa,0.6"), ("assembly,cutoff", '"z,1.fa",0.1'))):
        d = tmp_path / "results" / f"p{i}" / "deep"
        d.mkdir(parents=True)
        (d.parent / "assemblies.csv").write_text(f"{head}\n{row}\n")
        (d / "contigs.csv").write_text(f"contig_name,score\nc{i},0.{i}\n")
    got = {r.pair_id: (r.assembly, r.score, r.cutoff, r.result_dir) for r in tables.read_result_tree(spark, str(tmp_path / "results")).collect()}
    assert got["p0"][:3] == ("x.fa", "0.5", None) and got["p2"][:3] == ("z,1.fa", None, "0.1") and got["p1"][3] == str(tmp_path / "results/p1")
    assert sorted((r.pair_id, r.contig_name) for r in tables.read_contig_tree(spark, str(tmp_path / "results")).collect()) == [("p0", "c0"), ("p1", "c1"), ("p2", "c2")]
    (tmp_path / "manifest.tsv").write_text("p0\ta.fa\tr1,r2\tx\np9\ta.fa\tr1\tx\n")
    assert [tuple(r) for r in tables.read_manifest(spark, str(tmp_path / "manifest.tsv")).collect()] == [("p0", 2), ("p9", 1)]


def test_discovery(tmp_path):
    def put(path, text="x"):
        p = tmp_path / "pairs" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    for p in ("a", "b", "c", "d"):
        put(f"{p}/assembly/small.fa")
        put(f"{p}/assembly/large.fasta.gz", "xxxx")
    for r in ("a/reads/r_1.fastq", "a/reads/r_2.fastq", "b/reads/r.fastq.gz", "d/reads/r_1.fastq", "d/reads/r_2.fastq", "d/reads/s_1.fastq.gz", "d/reads/s_2.fastq.gz", "e/reads/r_1.fastq"):
        put(r)
    jobs, skipped = tables.discover_pairs(tmp_path)
    assert [j[0] for j in jobs] == ["a"] and jobs[0][1].endswith("large.fasta.gz")
    assert dict(skipped) == {"b": "only unpaired reads", "c": "no read files", "d": "2 read pairs", "e": "no assembly file"}
    jobs, _ = tables.discover_pairs(tmp_path, several_runs=True)
    assert [j[0] for j in jobs] == ["a", "d"] and jobs[1][2].count(",") == 1
    sinks.write_manifest(jobs, tmp_path / "m.tsv")
    assert (tmp_path / "m.tsv").read_text().count("\t") == 6


def test_written_numbers(spark, tmp_path):
    d = spark.createDataFrame([(1e-05, 12345678.0, 3, None, 2.675)], "a double, b double, c int, d string, coverage double")
    sinks.write_rows(d, tmp_path / "x.csv", ("a", "b", "c", "d", "e", "coverage"), 6, {"coverage": 2})
    assert (tmp_path / "x.csv").read_bytes() == b"a,b,c,d,e,coverage\r\n1e-05,12345678.0,3,,,2.67\r\n"
    assert sinks.metric_lines("m", {"a": 1234, "bb": 1234.5}, ("a", "bb")) == ["m", "a              1,234", "bb       1,234.50000"]
    sinks.write_fasta(spark.createDataFrame([(1, "b", "GG"), (0, "a", "AC")], "contig_idx long, name string, seq string"), tmp_path / "x.fa")
    assert (tmp_path / "x.fa").read_text() == ">a\nAC\n>b\nGG\n"


def test_command_line(spark, assessed, tmp_path, capsys):
    tmp, fa, _ = assessed
    assert cli.main(["assess", "-a", fa, "-o", str(tmp_path / "o")]) == 0 and (tmp_path / "o/contigs.csv").exists()
    run = str(tmp / "out")
    assert cli.main(["compare", f"a={run}", f"b={run}"]) == 0 and "a -> b: valid" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["assess", "-a", fa, "--reference", "x.fa"])


def test_fasta_is_split_anywhere(spark, tmp_path):
    """The same records in the same order, however small the splits are."""
    text = "".join(f">c{i} x\n" + "ACGT" * (i % 40) + "\nTT\n" for i in range(400))
    (tmp_path / "x.fa").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        d = fasta.read_fasta(spark, tmp_path / "x.fa")
        assert d.rdd.getNumPartitions() > 10
        got = sorted((r.contig_idx, r.name, r.seq) for r in d.collect())
        lines = tables.parse_orthogroups(numbered(spark.read.text(str(tmp_path / "x.fa")), "at")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, f"c{i}", "ACGT" * (i % 40) + "TT") for i in range(400)]
    want = [(f"{n}.groups", w[1:]) for n, line in enumerate(text.split("\n"), 1) if (w := line.split())]
    assert sorted((r.label, r.members) for r in lines) == sorted(want)


def test_fasta_folder(spark, tmp_path):
    """A folder of parts is one file: records count on from part to part, and each part's own start is kept or ignored."""
    parts = [">a\nAC\n>b\nGT\n", "junk\n>c\nA\n>>d\nC\n", "", "junk\n", ">>e\nTT\n>f\n" + "ACGT\n" * 400 + ">g\nG\n"]
    for i, text in enumerate(parts):
        (tmp_path / f"part-{i:05}.txt").write_text(text)
    want = [(0, "a", "AC"), (1, "b", "GT"), (2, "c", "A"), (3, ">d", "C"), (4, ">e", "TT"), (5, "f", "ACGT" * 400), (6, "g", "G")]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for most in (old, "300b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            got = sorted((r.contig_idx, r.defline, r.seq) for r in fasta.read_plain(spark, str(tmp_path)).collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == want


def test_fleet_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda master=None: spark)
    for pair, head, row in (("a", "assembly,score", "x.fa,0.5"), ("b", "assembly,cutoff", "y.fa,0.1")):
        (tmp_path / "results" / pair).mkdir(parents=True)
        (tmp_path / "results" / pair / "assemblies.csv").write_text(f"{head}\n{row}\n")
        (tmp_path / "results" / pair / "contigs.csv").write_text("contig_name,length\nc1,5\n")
    (tmp_path / "manifest.tsv").write_text("a\tx.fa\tr1,r2\nb\ty.fa\tr1\nc\tz.fa\tr1\n")
    (tmp_path / "pairs_seed.csv").write_text("pair_id,organism,other\na,Mus,1\na,Homo,2\n")
    assert cli.main(["collect", str(tmp_path), "--contigs"]) == 0
    assert "no result yet: c" in capsys.readouterr().out
    rows = list(csv.DictReader((tmp_path / "assembly_metrics.csv").open()))
    assert [(r["pair_id"], r["organism"], r["n_read_pairs"], r["score"], r["cutoff"]) for r in rows] == [("a", "Homo", "2", "0.5", ""), ("b", "", "1", "", "0.1")]
    assert [r["pair_id"] for r in csv.DictReader((tmp_path / "contig_metrics.csv").open())] == ["a", "b"]
    for f in ("pairs/p/assembly/x.fa", "pairs/p/reads/r_1.fastq", "pairs/p/reads/r_2.fastq", "pairs/q/assembly/x.fa"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    assert cli.main(["manifest", str(tmp_path), "--out", str(tmp_path / "jobs.tsv")]) == 0
    assert capsys.readouterr().out == "left out q: no read files\n1 jobs\n"
    (tmp_path / "in.fa").write_text(">ENA|A1|A1.1 x\nAC\n>b|c\nGT\n")
    assert cli.main(["normalise", str(tmp_path / "in.fa"), str(tmp_path / "out.fa")]) == 0
    assert (tmp_path / "out.fa").read_text() == ">A1\nAC\n>b_c\nGT\n"
    (tmp_path / "in.fa").write_text(">ENA|A1|A1.1 x\nAC\n>A1\nGT\n")
    with pytest.raises(ValueError, match="A1"):
        cli.main(["normalise", str(tmp_path / "in.fa"), str(tmp_path / "out.fa")])
