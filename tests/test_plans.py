"""What reaches the file scan, and what the plans must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from axonframe.operators import maintenance, metadata, partners, versions
from axonframe.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def columns_read(text: str, table: str) -> set[str]:
    found = re.findall(rf"{table}\.parquet.*?ReadSchema: struct<([^>]*)>", text)
    return {c.split(":")[0] for f in found for c in f.split(",")}


def test_scan_pushes_filters_and_prunes_columns(spark):
    text = plan(catalogue.QUERIES["annotation_scan"](spark, SF))
    assert "PushedFilters: [" in text and "In(o_orderstatus" in text
    assert columns_read(text, "orders") == {"o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"}


def test_partners_read_two_columns_and_shuffle_partial_counts(spark):
    text = plan(partners.partner_summary(spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_suppkey AS pre_root", "l_partkey AS post_root")))
    assert columns_read(text, "lineitem") == {"l_suppkey", "l_partkey"}
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text


@pytest.mark.parametrize("name", ["meta_unique", "meta_dups", "add_count_filter", "root_duplicated", "rootid_asof", "soma_cascade", "nuclei_largest", "l2_top1"])
def test_no_cross_joins_and_no_windows_over_hot_keys(spark, name):
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    if name != "rootid_asof":  # whose history comes from a window
        assert "Window" not in text


def test_time_travel_is_an_equi_join(spark):
    df = spark.createDataFrame([(1, 2)], "supervoxel_id long, root_id long")
    history = spark.createDataFrame([(1, 3)], "supervoxel_id long, root_id long").withColumns({"valid_from": F.lit("2020-01-01").cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})
    text = plan(versions.root_at(df, history, F.lit("2024-01-01").cast("timestamp")))
    assert re.search("SortMergeJoin|HashJoin", text) and "NestedLoop" not in text


def test_upsert_keeps_one_shuffle_per_side(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        table = spark.range(100).select(F.col("id").alias("_id"), F.lit("a").alias("v"))
        text = plan(maintenance.upsert(table, table.where("_id % 2 = 0").withColumn("v", F.lit("b"))))
        assert text.count("Exchange hashpartitioning") == 2
        first, _ = metadata.unique_rows(table.withColumn("root_id", F.col("_id") % 3))
        assert "Window" not in plan(first)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
