"""The registered queries: against their SQL, by their plans, and with the corpus subpackage gone."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from txgauge.plans.oracles import ORACLES
from txgauge.plans.queries import QUERIES

ROOT, SMALL = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_sql_agrees(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    want = duck.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_without_the_corpus_subpackage(tmp_path, gone):
    """All else imports and is registered, whether the pipeline's file goes or stays."""
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=to, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(to)}, check=True)
    assert out.stdout.split() == [str(len(QUERIES))] * 2


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_asked(spark):
    plan = _plan(QUERIES["fragment_assign"](spark, SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_quantity:double>" in plan
    plan = _plan(QUERIES["missing_jobs"](spark, SMALL))
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan


def test_assignment_exchanges_records_once(spark):
    """Between the records (made here by one aggregation) and the assigned ones there is one exchange, on fragment_idx."""
    plan = _plan(QUERIES["fragment_assign"](spark, SMALL))
    assert plan.count("Exchange hashpartitioning(fragment_idx") == 1 and "Python" not in plan
    assert plan.count("Sort [fragment_idx") == 1


@pytest.mark.parametrize("name", ["coverage_runs", "p_not_segmented", "seq_longest_orf", "score_curve", "contigs_table"])
def test_plans_stay_in_the_jvm(spark, name):
    plan = _plan(QUERIES[name](spark, SMALL))
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_records_are_written_by_all_tasks(spark):
    assert len(QUERIES["fasta_records"](spark, SMALL).inputFiles()) > 1


@pytest.mark.parametrize("name", ["seq_longest_orf", "assembly_basic_stats"])
def test_frames_are_found_once(spark, name):
    """Six frames, one pass each: aggregates and projections do not repeat them."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") == plan.count("regexp_extract_all(") == 6


def test_records_are_dealt_by_their_size(spark, tmp_path):
    """Ten times the rows are not ten times the rows of a task; one exchange takes them to their fragment's task."""
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    old, rows = spark.conf.get("spark.sql.shuffle.partitions"), []
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        for n in (100, 1000):
            to = tmp_path / str(n)
            shutil.copytree(SMALL, to, ignore=shutil.ignore_patterns("lineitem*"))
            li.crossJoin(spark.range(n)).withColumn("l_orderkey", li.l_orderkey * n + F.col("id")).drop("id").write.parquet(f"{to}/lineitem.parquet")
            d = QUERIES["fragment_candidates"](spark, str(to))
            assert _plan(d).count("Exchange hashpartitioning(") == 1
            rows.append(max(r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert rows[1] < 5 * rows[0]
