"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__

NAMES = sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op"))


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(name, spark, sf_dir, duck):
    got = __spark_entry__.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    rows = [tuple(plain(x) for x in r) for r in got.select(*columns).collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(x) for x in r)) for r in want)


BLANK = ["chunk_contextual", "chunk_lateral", "chunk_parent_child", "chunk_structural", "chunk_table_aware", "chunk_uncapped", "evaluate_cases"]


@pytest.fixture(scope="module")
def blank_dir(sf_dir, tmp_path_factory):
    """The smallest tables, with texts that are empty, blank or null."""
    duckdb = pytest.importorskip("duckdb")
    at = tmp_path_factory.mktemp("blank")
    text = "CASE WHEN doc_id = 100 THEN '' ELSE text END"  # a case of evaluate_cases
    text = "CASE doc_id % 11 WHEN 1 THEN " + text + " WHEN 3 THEN '' WHEN 5 THEN '   ' WHEN 7 THEN chr(10) || chr(10) WHEN 9 THEN NULL ELSE text END"
    duckdb.sql(f"COPY (SELECT * REPLACE ({text} AS text) FROM '{sf_dir}/documents.parquet') TO '{at}/documents.parquet' (FORMAT parquet)")
    os.symlink(f"{sf_dir}/labels.parquet", at / "labels.parquet")
    return str(at)


@pytest.mark.parametrize("name", BLANK)
def test_blank_texts_match_sql(name, spark, blank_dir):
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{blank_dir}/{t}.parquet')")
    test_matches_sql(name, spark, blank_dir, con)


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0
