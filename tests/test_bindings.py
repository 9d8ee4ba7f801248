"""Plans of the bindings: what must not meet in one task."""

import contextlib
import io

from pyspark.sql import functions as F

import bindings as B


def _tables(spark, folder):
    def store(rows, schema, name):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")

    store([(0, "R0")], "r_regionkey int, r_name string", "region")
    store([(0, "N0", 0), (1, "N1", 0)], "n_nationkey int, n_name string, n_regionkey int", "nation")
    store([(i, f"S{i}", i % 2) for i in range(4)], "s_suppkey long, s_name string, s_nationkey int", "supplier")
    store([(i, f"part {i}") for i in range(6)], "p_partkey long, p_name string", "part")
    store([(i % 4, i % 6) for i in range(24)], "l_suppkey long, l_partkey long", "lineitem")


def test_no_shuffle_of_rows_by_sheet(spark, tmp_path, monkeypatch):
    _tables(spark, tmp_path)
    plans = []

    def kept(key_spark, key, build):
        built = build()
        with contextlib.redirect_stdout(io.StringIO()) as text:
            built.explain()
        plans.append(text.getvalue())
        return built

    monkeypatch.setattr(B, "_once", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for many in (False, True):
            sheets = B.sheets(spark, str(tmp_path), many)
            numbers = sheets.groupBy("source_id").agg(
                F.sort_array(F.collect_list("row_number")).alias("n")
            )
            assert all(r["n"] == list(range(1, len(r["n"]) + 1)) for r in numbers.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 2
    assert not any("SortMergeJoin [source_id" in plan for plan in plans)
