"""The hot-card split is exact: forcing every card to be split into many
segments gives the same rows as the plain one-partition-per-card plan."""

import pytest

from faretrail.operators import CardOrder
from faretrail.plans import catalog

from conftest import SF_SMALL

WINDOWED = ["rides", "transfer_flags", "transfer_matrix", "transfer_time", "journeys", "focal_flags",
            "focal_metadata", "focal_journeys", "focal_to_focal", "focal_pairs", "rule_transfers",
            "sequences_by_date", "product_usage", "tap_counts", "transfer_database", "top_movements",
            "sequences_by_day_id", "hour_histogram", "sequences_sampled_trips"]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def forced(spark):
    plain = catalog.Inputs(spark, SF_SMALL, None)
    split = catalog.Inputs(spark, SF_SMALL, None)
    # 2 cards x ~500 taps; 37 rows per segment gives ~14 segments per card
    split.__dict__["order"] = CardOrder.detect(plain.taps, segment_rows=37)
    return plain, split


@pytest.mark.parametrize("name", WINDOWED)
def test_split_equals_plain(forced, name):
    plain, split = forced
    assert split.order.hot is not None
    a = _rows(catalog.QUERIES[name](plain))
    b = _rows(catalog.QUERIES[name](split))
    assert len(a) == len(b) and a == b


def test_detect_finds_only_hot_cards(spark):
    taps = catalog.Inputs(spark, SF_SMALL, None).taps
    assert CardOrder.detect(taps, segment_rows=10_000).hot.count() == 0
    assert CardOrder.detect(taps, segment_rows=100).hot.count() == 2
