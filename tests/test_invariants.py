"""Invariants over the driver data (the source model's own checks and more)."""

from pyspark.sql import functions as F

from faretrail.plans import catalog

from conftest import SF_SMALL

SF_MID = "/root/testdata/sf0.01"


def test_journey_ids_dense_and_legs_sum(spark):
    j = catalog.run("journeys", spark, SF_MID)
    stats = j.agg(F.min("journey_id"), F.max("journey_id"), F.count_distinct("journey_id"), F.count("*")).first()
    assert stats[0] == 1 and stats[1] == stats[2]
    legs = j.groupBy("journey_id").agg(F.first("num_legs").alias("n"), F.count("*").alias("rows"))
    assert legs.where(F.col("n") != F.col("rows")).count() == 0
    assert legs.agg(F.sum("n")).first()[0] == stats[3]


def test_focal_journeys_belong_to_mixed_focal_cards(spark):
    inputs = catalog.Inputs(spark, SF_MID)
    fj = catalog.QUERIES["focal_journeys"](inputs)
    with_link = fj.where(F.col("transfer_to_operator").isNotNull() | F.col("transfer_from_operator").isNotNull())
    cards = with_link.select("cardid_anony").distinct()
    ops = inputs.taps.join(cards, "cardid_anony", "left_semi").groupBy("cardid_anony").agg(
        F.max((F.col("operatorid") == 4).cast("int")).alias("focal"), F.count_distinct("operatorid").alias("ops"))
    assert ops.count() > 0
    assert ops.where((F.col("focal") != 1) | (F.col("ops") < 2)).count() == 0


def test_sample_has_exactly_n_cards(spark):
    s = catalog.run("card_sample", spark, SF_MID)
    assert s.select("cardid_anony").distinct().count() == catalog.SAMPLE_CARDS


def _rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in cols) for r in df.select(*cols).collect())


def test_partition_count_invariance(spark):
    names = ["transfer_matrix", "journeys", "sequences_by_date", "transfers_with_totals"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = {n: _rows(catalog.run(n, spark, SF_SMALL, None)) for n in names}
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        seven = {n: _rows(catalog.run(n, spark, SF_SMALL, None)) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == seven
