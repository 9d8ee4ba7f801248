"""Queries that SQL can express against DuckDB, on the supplied tables and with copies and nulls."""

import duckdb
import pytest
from kinsheet.llm import queries


def compare(spark, name, folder, table):
    answer = duckdb.connect()
    answer.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    expected = answer.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    found = queries.queries()[name](spark, str(folder))
    assert sorted(found.columns) == sorted(columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    assert sorted(rows, key=str) == sorted(expected.fetchall(), key=str)
    return rows


@pytest.mark.parametrize("copies", [1, 3])
def test_archive(spark, sf_dir, tmp_path, copies):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    for n in range(1, copies):
        pages = pages.union(pages.selectExpr(f"page_id + {n} * 100000", "url", "html"))
    odd = [(-1, None), (-2, ""), (-3, "x" * 999), (-4, "x" * 999), (-5, "é" * 500), (-6, "é" * 500)]
    pages = pages.union(spark.createDataFrame([(i, "u", t) for i, t in odd], "page_id long, url string, html string"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    rows = compare(spark, "op9_warc", tmp_path, "pages")
    assert any("revisit" in r for r in rows)
