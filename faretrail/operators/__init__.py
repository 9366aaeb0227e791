"""Domain operators: DataFrame -> DataFrame functions over card taps."""

from faretrail.operators.ordering import CardOrder
from faretrail.operators.rides import add_tagon_time, add_trip_cost, as_rides, day_of_rides
from faretrail.operators.enrich import make_human_readable, get_product_description, product_meta
from faretrail.operators.journeys import add_transfer_time, add_journey_id
from faretrail.operators.transfers import (
    identify_transfer_for_time, create_transfer_df, transfer_summary, classify_rule_transfers,
)
from faretrail.operators.focal import (
    cards_using_operator, focal_identify, focal_lag_and_lead_metadata, as_focal_journeys,
    focal_to_focal, combined_focal_transactions, tap_counts, transactions_per_user,
    focal_transactions_per_user,
)
from faretrail.operators.extract import (
    fares_for_day, sample_state, write_sample_state, merge_samples, sample_card_ids, sample_user_transactions, day_of_transactions,
    sample_day_of_transactions, taps_of_card, write_day_table, save_day_table, write_transfer_database, descriptive_tables, card_hash,
    to_local_time, day_bounds,
)
from faretrail.operators.medians import exact_medians
from faretrail.operators.sequences import extract_sequence_by_date, extract_sequence_for_random_week, sequences_of_sampled_trips

__all__ = [name for name in dir() if not name.startswith("_")]
