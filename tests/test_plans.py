"""Plan shape regression tests: the properties the scale design relies on."""

import re

from faretrail.plans import catalog

SF = "/root/testdata/sf0.01"


def _plan(spark, name):
    df = catalog.run(name, spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def _card_exchanges(plan):
    """Exchanges keyed by the card (possibly with more keys after it)."""
    return len(re.findall(r"Exchange hashpartitioning\(cardid_anony#\d+(?:, \w+#\d+)*, \d+\)", plan))


def test_transfer_matrix_one_card_exchange(spark):
    plan = _plan(spark, "transfer_matrix")
    assert _card_exchanges(plan) == 1
    assert "SortMergeJoin" not in plan           # lookups are broadcast at this size
    assert "HashAggregate(keys=[participantname_transfer" in plan and "partial_sum" in plan


def test_focal_pipeline_one_card_exchange(spark):
    for name in ("focal_journeys", "focal_metadata", "tap_counts", "sequences_by_date"):
        plan = _plan(spark, name)
        assert _card_exchanges(plan) == 1, name


def test_scan_prunes_columns_and_pushes_day_filter(spark):
    plan = _plan(spark, "service_day")
    scan = [line for line in plan.split("\n") if "FileScan parquet" in line][0]
    pushed = re.search(r"PushedFilters: \[([^\]]*)", scan).group(1)
    assert "GreaterThanOrEqual(ts," in pushed and "LessThan(ts," in pushed
    read = re.search(r"ReadSchema: struct<([^>]*)>", scan).group(1)
    assert "user_id" in read and "event_id" in read
    plan = _plan(spark, "time_columns")
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "value" not in read and "event_type" not in read   # only the needed columns


def test_no_single_partition_over_rows(spark):
    # the only unpartitioned step of the journey numbering is over bucket totals
    plan = _plan(spark, "journeys")
    for m in re.finditer(r"Exchange SinglePartition", plan):
        tail = plan[m.end():m.end() + 400]
        assert "_bucket" in tail


def _final_plan(spark, name):
    df = catalog.run(name, spark, SF)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()   # AQE final plan


def test_lookup_broadcasts_are_reused(spark):
    assert _final_plan(spark, "enriched").count("ReusedExchange") >= 2   # participants and locations built once


def test_unused_lookups_are_not_joined(spark):
    # routes and locations have one row a key, so their joins go where no column of theirs is asked for
    final = _final_plan(spark, "transfer_matrix")
    assert "p_partkey" not in final
    assert "ReusedExchange" in final                             # participants built once
