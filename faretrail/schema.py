"""Column names, domain constants and the canonical card ordering.

A *tap* is one card transaction. All ordered operators look at a card's taps
in ``(transaction_time, sequencenumber)`` order; ``sequencenumber`` is the
tie-breaker that makes the order total.
"""

from __future__ import annotations

from pyspark.sql import types as T

CARD = "cardid_anony"
TIME = "transaction_time"
SEQ = "sequencenumber"

# The 28 columns of a service-day table, in extract order.
DAY_COLUMNS = (
    "transaction_time", "generationtime", "cardid_anony", "operatorid", "vehicleid",
    "routeid", "recordtype", "subtype", "contractid", "contractserialnumber",
    "productcategory", "farecategory", "transferoperator", "transferdiscountflag",
    "rideannulled", "originlocation", "tripsequencenumber", "institutionid",
    "envelopeheaderversion", "transactionqualifiernegativefare",
    "transactionqualifierspecialfailure", "securitymoduleid", "deviceserialnumber",
    "sequencenumber", "applicationserialnumber", "destinationlocation",
    "purseamount", "pursebalance",
)

# Types of the raw fare-transaction source (the day table adds transaction_time
# and cardid_anony).
RAW_SCHEMA = T.StructType([
    T.StructField("generationtime", T.TimestampNTZType()),
    T.StructField("applicationserialnumber", T.LongType()),
    T.StructField("operatorid", T.IntegerType()),
    T.StructField("vehicleid", T.IntegerType()),
    T.StructField("routeid", T.IntegerType()),
    T.StructField("recordtype", T.IntegerType()),
    T.StructField("subtype", T.IntegerType()),
    T.StructField("contractid", T.IntegerType()),
    T.StructField("contractserialnumber", T.LongType()),
    T.StructField("productcategory", T.IntegerType()),
    T.StructField("farecategory", T.IntegerType()),
    T.StructField("transferoperator", T.IntegerType()),
    T.StructField("transferdiscountflag", T.IntegerType()),
    T.StructField("rideannulled", T.IntegerType()),
    T.StructField("originlocation", T.StringType()),
    T.StructField("tripsequencenumber", T.IntegerType()),
    T.StructField("institutionid", T.IntegerType()),
    T.StructField("envelopeheaderversion", T.IntegerType()),
    T.StructField("transactionqualifiernegativefare", T.IntegerType()),
    T.StructField("transactionqualifierspecialfailure", T.IntegerType()),
    T.StructField("securitymoduleid", T.LongType()),
    T.StructField("deviceserialnumber", T.LongType()),
    T.StructField("sequencenumber", T.LongType()),
    T.StructField("destinationlocation", T.StringType()),
    T.StructField("purseamount", T.DoubleType()),
    T.StructField("pursebalance", T.DoubleType()),
])

# Enrichment columns added by the five dimension joins.
ENRICH_COLUMNS = (
    "participantname", "participantname_transfer", "routename",
    "locationname_origin", "locationname_destination",
)

# Fixed values that define results (domain constants).
FOCAL_OPERATOR = 4            # the rail operator whose trips are annotated
ADJACENT_WINDOW_MIN = 180     # strict: connection to/from the focal operator
JOURNEY_GAP_MIN = 60          # strict: rides closer than this share a journey
TAG_ON_SUBTYPES = (2, 4)      # dropped when taps become rides
TAG_OFF_SUBTYPES = (3, 5)     # carry the tag-on time of the previous tap
NETTED_TAG_OFF = 3            # purse amount is netted against the previous tap
FOCAL_TAG_OFF = 5
DAY_BOUNDARY_UTC = "10:00:00"
MAX_SERIAL = 2000000000
SERVICE_DAY_START_HOUR = 3    # circadian day starts at 3 am local

# Projection of one row per focal-operator trip (underscored names).
FOCAL_JOURNEY_COLUMNS = (
    "cardid_anony", "transaction_time", "time_of_previous", "is_focal",
    "transfer_from_route", "transfer_to_route", "transfer_to_not_focal",
    "transfer_from_not_focal", "locationname_origin", "locationname_destination",
    "transfer_to_operator", "transfer_from_operator", "transfer_from_operator_time",
    "transfer_to_operator_time", "timediff", "operatorid", "participantname",
    "routename", "tripsequencenumber", "sequencenumber",
)

# Calendar labels (1 = January; weekday 1 = Sunday).
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)
WEEKDAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
