"""Every query of the algebra against its SQL on the smallest tables."""

import duckdb
import pytest

from opweave.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    a, b = QUERIES[name](spark, DIR).toPandas(), db.execute(ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (a, b))
    assert len(a) == len(b) and [str(x) for x in a.dtypes] == [str(x) for x in b.dtypes]
    assert ((a == b) | (a.isna() & b.isna())).all(axis=None)


@pytest.mark.parametrize("name", ["accumulate_divide", "division", "reciprocal", "ufunc_log"])
def test_odd_values(spark, tmp_path, name):
    """Values whose results have few digits left after the point, zeros of both signs, NaN, infinity and null."""
    tiny = "3.547685752000917e-08 3.1653495890304654e-09 1.5877851322458563e-07 1.5462014583048437e-09 2.3609930338366525e-09".split()
    values = [*tiny, "-1.548716759190749e-09", "0.01", "0.0", "-0.0", "-2.5", "'nan'", "'inf'", "null"]
    c = duckdb.connect()
    rows = ", ".join(f"({k}::bigint, {v}::double)" for k, v in enumerate(values))
    c.execute(f"copy (select * from (values {rows}) t(event_id, value)) to '{tmp_path}/events.parquet'")
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    a = [r["y"] for r in QUERIES[name](spark, str(tmp_path)).orderBy("event_id").collect()]
    b = [r[0] for r in c.execute(f"select y from ({ORACLES[name]}) order by event_id").fetchall()]
    assert list(map(repr, a)) == list(map(repr, b))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_projection(spark, tmp_path):
    from pyspark.sql import functions as F

    from opweave.operators.elementwise import ClipOperator
    from opweave.streaming import apply_to_stream

    spark.range(5).select(F.col("id").cast("double").alias("x")).write.parquet(str(tmp_path / "in"))
    df = apply_to_stream(ClipOperator(1, 3), spark.readStream.schema("x double").parquet(str(tmp_path / "in")), "x")
    q = df.writeStream.format("memory").queryName("clipped").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["v"] for r in spark.sql("select v from clipped").collect()) == [1, 1, 2, 3, 3]


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_corpus_operators(tmp_path, pipeline):
    """With the corpus subpackage deleted (its caches may stay), the algebra's queries are all there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "opweave", tmp_path / "opweave", ignore=shutil.ignore_patterns("llm"))
    (tmp_path / "opweave" / "llm" / "__pycache__").mkdir(parents=True)
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (root / "corpus_pipeline.py").exists() else [])):
        shutil.copy(root / name, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert list(map(int, out.stdout.split())) == [len(QUERIES), len(ORACLES)]
