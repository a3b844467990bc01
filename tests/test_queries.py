"""Every registered query of the library against its SQL, on the small tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest
from conftest import DATA

from posemill.plans import catalog

SF = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def normal(rows: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(rows.columns)
    out = rows[columns].copy()
    for c in columns:
        out[c] = out[c].astype(str) if out[c].dtype == object else out[c].astype(float).round(9) + 0.0
    return out.astype(str).replace({"None": "nan", "<NA>": "nan"}).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(name, spark, db):
    pd.testing.assert_frame_equal(normal(catalog.QUERIES[name](spark, SF).toPandas()), normal(db.sql(catalog.ORACLE[name]).df()))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_gives_rows(name, spark):
    assert len(catalog.QUERIES[name](spark, SF).limit(5).toPandas())


def test_manifest_rounds_as_its_sql(spark, tmp_path):
    """729 frames at 25 + 5 / 7 a second last 28.349999999999998 seconds, which the SQL rounds to 28.4."""
    docs = spark.range(5, 40005).selectExpr("id AS doc_id", "'t' AS text", "'de' AS lang", "'s' AS source", "724 + id AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = normal(con.sql(catalog.ORACLE["manifest_qc"]).df())
    got = catalog.QUERIES["manifest_qc"](spark, str(tmp_path))
    assert got.filter("video_id = 'V05_T01_top'").first()["duration_s"] == 28.4
    pd.testing.assert_frame_equal(normal(got.toPandas()), want)


def test_manifest_of_awkward_rows(spark, tmp_path):
    """A number twice, and rows without a source, text, language, length or number."""
    rows = [(6, "f", "de", "s", 100), (6, "g", "de", "s", 200), (6, "g", "de", "s", 200), (2, "b", "de", None, 100), (3, None, "fr", "s", 100), (4, "d", None, "s", 100),
            (5, "e", "de", "s", None), (None, "n", "de", "s", 5), (9, "", "en", "a/b#1", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = normal(con.sql(catalog.ORACLE["manifest_qc"]).df())
    pd.testing.assert_frame_equal(normal(catalog.QUERIES["manifest_qc"](spark, str(tmp_path)).toPandas()), want)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
