"""Queries of the edit log that no fixed ids bound: their work follows the table."""

from axonframe.plans import catalogue

SF = "/root/testdata/sf0.01"


def test_whole_log(spark):
    log = [r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()]
    orders = [r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()]
    run = lambda name: catalogue.QUERIES[name](spark, SF).collect()
    assert max(log) > 900
    assert [r.last_operation for r in run("ops_last_whole")] == [max(log)]
    assert sorted(r.operation_id for r in run("ops_all_whole")) == sorted(i for i in log if i >= 1)
    found = {i for i in log if i % 3}
    assert sorted((r.ordinal, r.operation_id) for r in run("ops_requested_order_whole")) == sorted((o, o * 7) for o in orders if o * 7 in found)
