"""Every query on the smallest tables, against its SQL where it has one."""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
duckdb = pytest.importorskip("duckdb")
CORE = sorted(n for n in entry.queries() if not n.startswith("p") or not n[1:2].isdigit())


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in FOLDER.iterdir():
        c.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", CORE)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        r = db.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        assert got == sorted(repr(tuple(norm(x[names.index(c)]) for c in columns)) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_fusion_of_a_chapter_sent_often(spark, tmp_path):
    from pyspark.sql import functions as F

    fusion = entry.queries()["hybrid_fusion"]
    want = sorted(map(tuple, fusion(spark, str(FOLDER)).collect()))
    novel, chapter = max(want, key=lambda r: r[2])[:2]
    rows = spark.read.parquet(f"{FOLDER}/chapters.parquet")
    one = rows.where((F.col("novel_id") == novel) & (F.col("chapter_id") == chapter) & (F.size("embedding") == 64)).orderBy(F.col("row_id").desc()).limit(1)
    copies = one.crossJoin(spark.range(300)).withColumn("row_id", F.col("row_id") + 1_000_000 + F.col("id")).drop("id")
    rows.unionByName(copies).write.parquet(f"{tmp_path}/chapters.parquet")
    spark.read.parquet(f"{FOLDER}/chunks.parquet").write.parquet(f"{tmp_path}/chunks.parquet")
    assert sorted(map(tuple, fusion(spark, str(tmp_path)).collect())) == want
