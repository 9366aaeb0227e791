"""Sources: driver-table mapping, rule and pair-day CSV files, file manifests."""

from faretrail.sources.driver_tables import (
    read_table,
    raw_transactions,
    day_taps,
    taps,
    participants,
    routes,
    locations,
    contract_product_map,
    products,
    transfer_rules,
    participants_from,
    routes_from,
    locations_from,
    contract_product_map_from,
    products_from,
    transfer_rules_from,
    sampled_trips_from,
)
from faretrail.sources.files import MANIFEST_TYPES, file_manifest, list_files, read_pair_day, read_transfer_rules, write_pair_day
from faretrail.sources.lookups import LOOKUPS, open_tables

__all__ = [name for name in dir() if not name.startswith("_")]
