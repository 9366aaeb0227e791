"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each statement reads the driver's views (``events``, ``nation``, ``part``)
and rebuilds the fixture mapping inline as CTEs, then computes the query with
plain window functions (a global running sum for journey ids, per-card
``lag``/``lead``). Doubles are produced by the same IEEE operations as on the
Spark side: minutes are microsecond differences divided by 6e7, 2-decimal
rounding is ``floor(x*100+0.5)/100``, money sums are exact decimals.
"""

from __future__ import annotations

from faretrail.plans import catalog as cat

W = "(PARTITION BY cardid_anony ORDER BY transaction_time, sequencenumber)"


def mins(a: str, b: str) -> str:
    return f"(CAST(epoch_us({b}) - epoch_us({a}) AS DOUBLE) / CAST(60000000 AS DOUBLE))"


def round2(x: str) -> str:
    return f"(floor({x} * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE))"


MONTHS = ("CASE {c} WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April' "
          "WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' "
          "WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November' "
          "WHEN 12 THEN 'December' ELSE 'ERROR' END")
WEEKDAYS = ("CASE {c} WHEN 1 THEN 'Sunday' WHEN 2 THEN 'Monday' WHEN 3 THEN 'Tuesday' WHEN 4 THEN 'Wednesday' "
            "WHEN 5 THEN 'Thursday' WHEN 6 THEN 'Friday' WHEN 7 THEN 'Saturday' END")

BASE = f"""
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events
),
raw AS (
  SELECT ts AS generationtime,
         user_id // 10 AS applicationserialnumber,
         CAST(CASE WHEN k < 40 THEN 4 ELSE k % 25 END AS INTEGER) AS operatorid,
         CAST(k % 20 AS INTEGER) AS routeid,
         CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3
                              WHEN 'error' THEN 4 WHEN 'purchase' THEN 5 END AS INTEGER) AS subtype,
         CAST(k % 7 AS INTEGER) AS contractid,
         CAST(1 + (k // 2) % 2 AS INTEGER) AS productcategory,
         CAST(CASE WHEN k % 5 = 0 THEN NULL ELSE (k * 7) % 25 END AS INTEGER) AS transferoperator,
         CAST(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS transferdiscountflag,
         CAST(k % 10 AS VARCHAR) AS originlocation,
         event_id AS sequencenumber,
         CAST(CASE WHEN k % 7 = 0 THEN NULL ELSE (k * 3) % 10 END AS VARCHAR) AS destinationlocation,
         value AS purseamount
  FROM ev
),
taps AS (
  SELECT generationtime AS transaction_time, generationtime,
         sha1(CAST(applicationserialnumber AS VARCHAR)) AS cardid_anony,
         operatorid, routeid, subtype, contractid, productcategory, transferoperator,
         transferdiscountflag, originlocation, sequencenumber, applicationserialnumber,
         destinationlocation, purseamount
  FROM raw
),
participants AS (
  SELECT CAST(n_nationkey AS INTEGER) AS participantid, n_name AS participantname FROM nation
),
routes AS (
  SELECT CAST(p_partkey % 20 AS INTEGER) AS routeid, CAST((p_partkey // 20) % 25 AS INTEGER) AS participantid,
         arg_min(p_name, p_partkey) AS routename
  FROM part GROUP BY 1, 2
),
locations AS (
  SELECT CAST(p_partkey % 10 AS INTEGER) AS locationcode, CAST((p_partkey // 10) % 25 AS INTEGER) AS participantid,
         arg_min(p_name, p_partkey) AS locationname
  FROM part GROUP BY 1, 2
)"""


def enriched_cte(src: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT t.transaction_time, t.generationtime, t.cardid_anony, t.operatorid, t.routeid, t.subtype,
         t.contractid, t.productcategory, t.transferoperator, t.transferdiscountflag,
         TRY_CAST(t.originlocation AS INTEGER) AS originlocation, t.sequencenumber,
         TRY_CAST(t.destinationlocation AS INTEGER) AS destinationlocation, t.purseamount,
         p1.participantname, p2.participantname AS participantname_transfer, r.routename,
         lo.locationname AS locationname_origin, ld.locationname AS locationname_destination
  FROM {src} t
  LEFT JOIN participants p1 ON t.operatorid = p1.participantid
  LEFT JOIN participants p2 ON t.transferoperator = p2.participantid
  LEFT JOIN routes r ON t.operatorid = r.participantid AND t.routeid = r.routeid
  LEFT JOIN locations lo ON TRY_CAST(t.originlocation AS INTEGER) = lo.locationcode
                        AND t.operatorid = lo.participantid
  LEFT JOIN locations ld ON TRY_CAST(t.destinationlocation AS INTEGER) = ld.locationcode
                        AND t.operatorid = ld.participantid
)"""


ENRICHED = enriched_cte("taps", "enriched")


def rides_cte(src: str, name: str) -> str:
    return f"""
{name}_w AS (
  SELECT *, (subtype = 3 OR subtype = 5) AS tagging_off,
         CASE WHEN (subtype = 3 OR subtype = 5) THEN lag(transaction_time) OVER {W} END AS tagon_time,
         CASE WHEN subtype = 3 THEN lag(purseamount) OVER {W} END AS previous_purseamount
  FROM {src}
),
{name} AS (
  SELECT *, {mins('tagon_time', 'transaction_time')} AS trip_duration,
         CASE WHEN subtype = 3 THEN previous_purseamount - purseamount
              WHEN subtype <> 3 THEN purseamount END AS trip_cost
  FROM {name}_w WHERE subtype <> 2 AND subtype <> 4
)"""


FLAGS = rides_cte("enriched", "rides_e") + f""",
flags_w AS (
  SELECT *,
    CASE WHEN tagon_time IS NULL THEN {mins(f'lag(transaction_time) OVER {W}', 'transaction_time')} END
      AS time_from_prev_tagon,
    CASE WHEN tagon_time IS NOT NULL THEN {mins(f'lag(tagon_time) OVER {W}', 'transaction_time')} END
      AS time_from_prev
  FROM rides_e WHERE participantname_transfer IS NOT NULL
),
flags AS (
  SELECT *, CAST(coalesce(time_from_prev <= {cat.TRANSFER_MINS} OR time_from_prev_tagon <= {cat.TRANSFER_MINS},
                          false) AS INTEGER) AS is_transfer
  FROM flags_w
)"""

TRANSFER_TIME = rides_cte("enriched", "rides_e") + f""",
tt_w AS (
  SELECT *, lag(transaction_time) OVER {W} AS previous_time,
         lag(participantname) OVER {W} AS previous_participant
  FROM rides_e
),
tt AS (SELECT *, {mins('previous_time', 'transaction_time')} AS transfer_time FROM tt_w)"""


def identify_cte(src: str, name: str) -> str:
    return f"""
{name}_w AS (
  SELECT *, operatorid = 4 AS is_focal,
         lag(operatorid) OVER {W} = 4 AS from_focal,
         lead(operatorid) OVER {W} = 4 AS to_focal
  FROM {src}
),
{name} AS (
  SELECT *, is_focal AND from_focal AND NOT to_focal AS exit_to_not_focal,
         is_focal AND to_focal AND NOT from_focal AS entrance_from_not_focal
  FROM {name}_w
)"""


def metadata_cte(src: str, name: str) -> str:
    return f"""
{name}_a AS (
  SELECT *, abs({mins(f'lag(transaction_time) OVER {W}', 'transaction_time')}) AS timediff,
         lag(transaction_time) OVER {W} AS time_of_previous
  FROM {src}
),
{name}_b AS (
  SELECT *, {round2('timediff')} AS transfer_from_time,
         {round2(f'lead(timediff) OVER {W}')} AS transfer_to_operator_time
  FROM {name}_a
),
{name}_c AS (
  SELECT *, exit_to_not_focal AND transfer_to_operator_time < 180 AS transfer_to_not_focal,
         entrance_from_not_focal AND transfer_from_time < 180 AS transfer_from_not_focal
  FROM {name}_b
),
{name}_d AS (
  SELECT *,
    CASE WHEN transfer_from_not_focal THEN lag(participantname) OVER {W} END AS s1_from_operator,
    CASE WHEN transfer_to_not_focal THEN lead(participantname) OVER {W} END AS transfer_to_operator,
    CASE WHEN transfer_from_not_focal THEN lag(routename) OVER {W} END AS s1_from_route,
    CASE WHEN transfer_to_not_focal THEN lead(routename) OVER {W} END AS transfer_to_route
  FROM {name}_c
),
{name} AS (
  SELECT *,
    CASE WHEN from_focal THEN lag(s1_from_operator) OVER {W} END AS transfer_from_operator,
    CASE WHEN from_focal THEN lag(s1_from_route) OVER {W} END AS transfer_from_route,
    CASE WHEN from_focal THEN lag(transfer_from_time) OVER {W} END AS transfer_from_operator_time
  FROM {name}_d
)"""


FOCAL_JOURNEYS = f""",
riders AS (
  SELECT * FROM enriched WHERE cardid_anony IN (SELECT cardid_anony FROM enriched WHERE operatorid = 4)
),""" + identify_cte("riders", "fj_i") + "," + metadata_cte("fj_i", "fj_m") + f""",
fj AS (
  SELECT cardid_anony, transaction_time, time_of_previous, is_focal, transfer_from_route,
         transfer_to_route, transfer_to_not_focal, transfer_from_not_focal, locationname_origin,
         locationname_destination, transfer_to_operator, transfer_from_operator,
         transfer_from_operator_time, transfer_to_operator_time, timediff, operatorid, participantname,
         routename, sequencenumber
  FROM fj_m WHERE is_focal AND locationname_destination IS NOT NULL
)"""

FOCAL_TO_FOCAL = "," + identify_cte("enriched", "f2_i") + f""",
f2_k AS (SELECT * FROM f2_i WHERE is_focal AND from_focal AND subtype = 5),
f2_a AS (
  SELECT *, lead(transaction_time) OVER {W} IS NOT NULL AS first_trip,
         lag(transaction_time) OVER {W} IS NOT NULL AS second_trip,
         abs({mins(f'lag(transaction_time) OVER {W}', 'transaction_time')}) AS timediff,
         lag(transaction_time) OVER {W} AS time_of_previous
  FROM f2_k
),
f2_b AS (
  SELECT *, coalesce(lead(timediff) OVER {W} < 180 OR timediff < 180, false) AS near_
  FROM f2_a
),
f2 AS (SELECT * FROM f2_b WHERE (first_trip OR second_trip) AND near_)"""

RULES = """,
rules_a AS (
  SELECT n_nationkey AS from_key, n_name AS from_AgencyName, unnest(generate_series(0, (SELECT max(n_nationkey) FROM nation))) AS to_key
  FROM nation
),
rules AS (
  SELECT a.from_AgencyName, b.n_name AS to_AgencyName,
         CAST(10 + ((a.from_key * 3 + b.n_nationkey) % 7) * 10 AS INTEGER) AS max_time
  FROM rules_a a JOIN nation b ON a.to_key = b.n_nationkey
  WHERE a.from_key <> b.n_nationkey OR a.from_key % 4 <> 0
),
rt AS (
  SELECT tt.*, rules.max_time, coalesce(tt.transfer_time <= rules.max_time, false) AS is_rule_transfer
  FROM tt LEFT JOIN rules ON tt.previous_participant = rules.from_AgencyName
                         AND tt.participantname = rules.to_AgencyName
)"""


def day_cols(ts: str) -> str:
    cd = f"CAST({ts} - INTERVAL 3 HOUR AS DATE)"
    return (f"CAST(year({cd}) AS INTEGER) AS Year, CAST(month({cd}) AS INTEGER) AS Month, "
            f"CAST(dayofweek({cd}) + 1 AS INTEGER) AS CircadianDayOfWeek, "
            f"CAST(ceil(day({cd}) / 7) AS INTEGER) AS RandomWeekID")


DAY_KEYS = "Year, Month, CircadianDayOfWeek, RandomWeekID"


def est(c: str) -> str:
    return f"CAST(round(CAST({c} AS DOUBLE) / CAST({cat.SAMPLING_RATE} AS DOUBLE)) AS BIGINT)"


TRANSFER_DB = TRANSFER_TIME + RULES + f""",
rdays AS (SELECT *, {day_cols('transaction_time')} FROM rt),
xfer AS (
  SELECT {DAY_KEYS}, previous_participant AS from_AgencyName, participantname AS to_AgencyName,
         count(*) AS sampled_transfers
  FROM rdays WHERE is_rule_transfer GROUP BY ALL
),
agency AS (SELECT {DAY_KEYS}, participantname, count(*) AS rides_ FROM rdays GROUP BY ALL),
tdb AS (
  SELECT x.Year, x.Month, x.CircadianDayOfWeek, x.RandomWeekID, x.to_AgencyName, x.from_AgencyName,
         x.sampled_transfers, f.rides_ AS from_Agency_Sampled_Transactions,
         t.rides_ AS to_Agency_Sampled_Transactions,
         {est('x.sampled_transfers')} AS estimated_transfers,
         {est('f.rides_')} AS estimated_from_agency_transactions,
         {est('t.rides_')} AS estimated_to_agency_transactions
  FROM xfer x
  JOIN agency f ON x.Year = f.Year AND x.Month = f.Month AND x.CircadianDayOfWeek = f.CircadianDayOfWeek
               AND x.RandomWeekID = f.RandomWeekID AND x.from_AgencyName = f.participantname
  JOIN agency t ON x.Year = t.Year AND x.Month = t.Month AND x.CircadianDayOfWeek = t.CircadianDayOfWeek
               AND x.RandomWeekID = t.RandomWeekID AND x.to_AgencyName = t.participantname
),
shares AS (
  SELECT *,
    CASE WHEN estimated_from_agency_transactions = 0 THEN NULL
         ELSE CAST(estimated_transfers AS DOUBLE) / CAST(estimated_from_agency_transactions AS DOUBLE) END
      AS from_share,
    CASE WHEN estimated_to_agency_transactions = 0 THEN NULL
         ELSE CAST(estimated_transfers AS DOUBLE) / CAST(estimated_to_agency_transactions AS DOUBLE) END
      AS to_share,
    {MONTHS.format(c='Month')} AS MonthName,
    {WEEKDAYS.format(c='CircadianDayOfWeek')} AS DayName
  FROM tdb
)"""

PRODUCTS = """,
pmap AS (
  SELECT CAST(n_nationkey AS INTEGER) AS issuerid, CAST(c % 3 AS INTEGER) AS producttype,
         CAST(c AS INTEGER) AS contracttype
  FROM (SELECT n_nationkey, unnest(generate_series(0, 5)) AS c FROM nation)
),
ptext AS (
  SELECT CAST(n_nationkey AS INTEGER) AS issuerid, CAST(pt AS INTEGER) AS producttype,
         n_name || ' product ' || CAST(pt AS VARCHAR) AS description,
         CAST(1 + pt % 2 AS INTEGER) AS productcategory
  FROM (SELECT n_nationkey, n_name, unnest(generate_series(0, 2)) AS pt FROM nation)
),
meta AS (
  SELECT m.issuerid, m.contracttype, p.description
  FROM pmap m JOIN ptext p ON m.issuerid = p.issuerid AND m.producttype = p.producttype
)"""


def sequences_cte(src: str) -> str:
    on = "coalesce(tagon_time, transaction_time)"
    return f""",
sr AS (
  SELECT cardid_anony AS CardID, CAST({on} - INTERVAL 3 HOUR AS DATE) AS CircadianDate,
         {on} AS on_, sequencenumber AS seq_,
         concat_ws(' ', coalesce(CAST(hour({on}) AS VARCHAR), 'NA'), coalesce(locationname_origin, 'NA'),
                   coalesce(locationname_destination, 'NA')) AS record_
  FROM {src}
)"""


KEY = "cardid_anony, sequencenumber, transaction_time"
FLAG_COLS = "is_focal, from_focal, to_focal, exit_to_not_focal, entrance_from_not_focal"
ENRICHED_COLS = ", ".join(cat.ENRICHED_COLS)


def _with(*parts: str) -> str:
    return "WITH " + "".join(parts)


def statements() -> dict[str, str]:
    q: dict[str, str] = {}
    base_e = BASE + "," + ENRICHED

    q["transfer_matrix"] = _with(base_e, ",", FLAGS) + """
SELECT participantname_transfer, participantname,
       CAST(trunc(avg(transferoperator)) AS INTEGER) AS from_operator_id,
       CAST(trunc(avg(operatorid)) AS INTEGER) AS to_operator_id,
       CAST(sum(is_transfer) AS BIGINT) AS num_transfers,
       CAST(coalesce(sum(CASE WHEN is_transfer = 1 THEN transferdiscountflag END), 0) AS BIGINT) AS num_discounted,
       coalesce(CAST(sum(CAST(CASE WHEN is_transfer = 1 THEN purseamount END AS DECIMAL(38,10))) AS DOUBLE),
                CAST(0 AS DOUBLE)) AS transfer_revenue
FROM flags WHERE productcategory = 1
GROUP BY participantname_transfer, participantname"""

    q["transfer_matrix_from_rides"] = q["transfer_matrix"]

    q["transfer_flags"] = _with(base_e, ",", FLAGS) + f"""
SELECT {KEY}, participantname, participantname_transfer, tagon_time, time_from_prev_tagon, time_from_prev,
       is_transfer
FROM flags"""

    q["rides"] = _with(BASE, ",", rides_cte("taps", "rides_t")) + f"""
SELECT {KEY}, operatorid, subtype, purseamount, tagging_off, tagon_time, trip_duration,
       previous_purseamount, trip_cost
FROM rides_t"""

    q["transfer_time"] = _with(base_e, ",", TRANSFER_TIME) + f"""
SELECT {KEY}, participantname, previous_time, transfer_time, previous_participant FROM tt"""

    q["journeys"] = _with(base_e, ",", TRANSFER_TIME) + f""",
j1 AS (SELECT *, coalesce(transfer_time < {cat.JOURNEY_GAP}, false) AS is_transfer FROM tt),
j2 AS (
  SELECT *, CAST(sum(1 - CAST(is_transfer AS INTEGER)) OVER (ORDER BY cardid_anony, transaction_time,
         sequencenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS journey_id
  FROM j1
)
SELECT {KEY}, transfer_time, is_transfer, journey_id, count(*) OVER (PARTITION BY journey_id) AS num_legs
FROM j2"""

    q["focal_flags"] = _with(BASE, ",", identify_cte("taps", "fi")) + f"""
SELECT {KEY}, operatorid, {FLAG_COLS} FROM fi"""

    q["focal_metadata"] = _with(base_e, ",", identify_cte("enriched", "fi"), ",", metadata_cte("fi", "fm")) + f"""
SELECT {KEY}, {FLAG_COLS}, timediff, time_of_previous, transfer_from_time, transfer_to_operator_time,
       transfer_to_not_focal, transfer_from_not_focal, transfer_to_operator, transfer_to_route,
       transfer_from_operator, transfer_from_route, transfer_from_operator_time
FROM fm"""

    q["focal_journeys"] = _with(base_e, FOCAL_JOURNEYS) + "\nSELECT * FROM fj"

    q["focal_riders"] = _with(BASE) + f"""
SELECT {KEY}, operatorid FROM taps
WHERE cardid_anony IN (SELECT cardid_anony FROM taps WHERE operatorid = 4)"""

    parts = []
    for p, c in (("tag_on", "time_of_previous"), ("tag_out", "transaction_time")):
        parts += [f"CAST(hour({c}) AS INTEGER) AS {p}_hour", f"CAST(minute({c}) AS INTEGER) AS {p}_minute",
                  f"CAST(dayofyear({c}) AS INTEGER) AS {p}_yday",
                  f"CAST(dayofweek({c}) + 1 AS INTEGER) AS {p}_wday", f"CAST(month({c}) AS INTEGER) AS {p}_month"]
    q["focal_trip_times"] = _with(base_e, FOCAL_JOURNEYS) + f"""
SELECT {KEY}, {", ".join(parts)} FROM fj"""

    q["focal_to_focal"] = _with(base_e, FOCAL_TO_FOCAL) + f"""
SELECT {KEY}, first_trip, second_trip, timediff, time_of_previous, locationname_origin,
       locationname_destination
FROM f2"""

    q["focal_pairs"] = _with(base_e, FOCAL_TO_FOCAL) + f""",
fp AS (
  SELECT *, lead(originlocation) OVER {W} AS second_originlocation,
         lead(destinationlocation) OVER {W} AS second_destinationlocation,
         lead(locationname_origin) OVER {W} AS second_locationname_origin,
         lead(locationname_destination) OVER {W} AS second_locationname_destination,
         lead(timediff) OVER {W} AS second_timediff,
         lead(time_of_previous) OVER {W} AS second_time_of_previous
  FROM f2
)
SELECT {KEY}, originlocation, destinationlocation, second_originlocation, second_destinationlocation,
       second_locationname_origin, second_locationname_destination, second_timediff, second_time_of_previous
FROM fp WHERE second_originlocation IS NOT NULL"""

    q["tap_counts"] = _with(BASE, ",", identify_cte("taps", "fi")) + """,
tc AS (SELECT cardid_anony, sequencenumber, CAST(dayofyear(transaction_time) AS INTEGER) AS yday, is_focal FROM fi)
SELECT cardid_anony, sequencenumber, yday, is_focal,
       count(*) OVER (PARTITION BY cardid_anony, yday) AS transaction_count,
       count(*) OVER (PARTITION BY cardid_anony, yday, is_focal) AS focal_tr_count,
       count(*) OVER (PARTITION BY cardid_anony, yday) - count(*) OVER (PARTITION BY cardid_anony, yday, is_focal)
         AS tr_count_diff
FROM tc"""

    q["enriched"] = _with(base_e) + f"\nSELECT {ENRICHED_COLS} FROM enriched"

    q["product_description"] = _with(BASE, PRODUCTS) + f"""
SELECT t.cardid_anony, t.sequencenumber, t.transaction_time, t.operatorid, t.contractid,
       m.description AS product_description
FROM taps t LEFT JOIN meta m ON t.contractid = m.contracttype AND t.operatorid = m.issuerid"""

    q["product_usage"] = _with(BASE, ",", rides_cte("taps", "rides_t"), PRODUCTS) + f""",
pr AS (
  SELECT r.cardid_anony, m.description AS product_description
  FROM rides_t r LEFT JOIN meta m ON r.contractid = m.contracttype AND r.operatorid = m.issuerid
),
pc AS (SELECT cardid_anony, product_description, count(*) AS n FROM pr GROUP BY ALL)
SELECT product_description, CAST(sum(n * n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS mean_rides
FROM pc GROUP BY product_description
ORDER BY mean_rides DESC, product_description ASC NULLS LAST LIMIT {cat.PRODUCT_TOP}"""

    lo = f"TIMESTAMP '{cat.SERVICE_DATE} 10:00:00'"
    hi = f"(TIMESTAMP '{cat.SERVICE_DATE} 10:00:00' + INTERVAL 1 DAY)"
    day = f""",
day AS (
  SELECT timezone('America/Los_Angeles', generationtime AT TIME ZONE 'UTC') AS transaction_time,
         generationtime, sha1(CAST(applicationserialnumber AS VARCHAR)) AS cardid_anony, operatorid, routeid,
         subtype, contractid, productcategory, transferoperator, transferdiscountflag, originlocation,
         sequencenumber, destinationlocation, purseamount
  FROM raw
  WHERE generationtime >= {lo} AND generationtime < {hi} AND applicationserialnumber < 2000000000
)"""
    q["service_day"] = _with(BASE, day) + "\nSELECT * FROM day"

    q["day_table"] = _with(BASE, day) + f"\nSELECT *, DATE '{cat.SERVICE_DATE}' AS service_date FROM day"

    q["lookups"] = _with(BASE) + """
SELECT 'operators' AS lookup, participantid AS operator, CAST(NULL AS INTEGER) AS key, participantname AS label FROM participants
UNION ALL SELECT 'routes', participantid, routeid, routename FROM routes
UNION ALL SELECT 'locations', participantid, locationcode, locationname FROM locations"""

    q["file_manifest"] = """
SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
       strftime(ts, '%Y - %m') || ' Transaction.csv' AS "Transactions",
       max(CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 3 = 0 THEN strftime(ts, '%Y - %m') || ' Transfer.csv' END) AS "Transfers"
FROM events GROUP BY 1, 2, 3"""

    q["transfer_rules_csv"] = """
SELECT a.n_name AS "from_AgencyName", b.n_name AS "to_AgencyName",
       CAST(10 + ((a.n_nationkey * 3 + b.n_nationkey) % 7) * 10 AS INTEGER) AS max_time
FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey OR a.n_nationkey % 4 <> 0"""

    q["day_of_rides"] = _with(BASE, day, ",", rides_cte("day", "rides_d")) + f"""
SELECT {KEY}, subtype, tagon_time, trip_duration, trip_cost FROM rides_d"""

    q["day_transactions"] = _with(BASE, day, ",", enriched_cte("day", "day_e")) + f"""
SELECT {ENRICHED_COLS} FROM day_e"""

    sample = f"""
  SELECT cardid_anony FROM (SELECT DISTINCT cardid_anony FROM {{src}} WHERE cardid_anony IS NOT NULL)
  ORDER BY sha1(cardid_anony || '#{cat.SAMPLE_SEED}'), cardid_anony LIMIT {cat.SAMPLE_CARDS}"""
    q["sample_day"] = _with(BASE, day, f""",
ids AS ({sample.format(src='day')}),
day_s AS (SELECT * FROM day WHERE cardid_anony IN (SELECT cardid_anony FROM ids)),""",
                            enriched_cte("day_s", "day_e")) + f"""
SELECT {ENRICHED_COLS} FROM day_e"""

    q["card_sample"] = _with(BASE, f""",
ids AS ({sample.format(src='taps')})""") + f"""
SELECT {KEY}, operatorid FROM taps WHERE cardid_anony IN (SELECT cardid_anony FROM ids)"""

    q["card_sample_of_days"] = q["card_sample"]

    q["time_columns"] = _with(BASE) + f"""
SELECT {KEY}, CAST(hour(transaction_time) AS INTEGER) AS t_hour,
       CAST(minute(transaction_time) AS INTEGER) AS t_minute,
       CAST(dayofyear(transaction_time) AS INTEGER) AS t_yday,
       CAST(dayofweek(transaction_time) + 1 AS INTEGER) AS t_wday,
       CAST(month(transaction_time) AS INTEGER) AS t_month
FROM taps"""

    q["od_matrix"] = _with(base_e, FOCAL_JOURNEYS) + """
SELECT locationname_origin, locationname_destination, count(*) AS trips FROM fj GROUP BY ALL"""

    q["top_movements"] = _with(base_e, FOCAL_JOURNEYS) + f"""
SELECT transfer_from_operator, transfer_from_route, transfer_to_operator, transfer_to_route, count(*) AS trips
FROM fj WHERE transfer_from_operator IS NOT NULL OR transfer_to_operator IS NOT NULL
GROUP BY ALL
ORDER BY trips DESC, transfer_from_operator NULLS LAST, transfer_from_route NULLS LAST,
         transfer_to_operator NULLS LAST, transfer_to_route NULLS LAST
LIMIT {cat.TOP_K}"""

    q["hour_histogram"] = _with(base_e, FOCAL_JOURNEYS) + """
SELECT 'focal_tag_on' AS source, CAST(hour(time_of_previous) AS INTEGER) AS hour, count(*) AS n
FROM fj WHERE time_of_previous IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'all_taps' AS source, CAST(hour(transaction_time) AS INTEGER) AS hour, count(*) AS n
FROM taps GROUP BY 2"""

    q["rule_transfers"] = _with(base_e, ",", TRANSFER_TIME, RULES) + f"""
SELECT {KEY}, previous_participant, participantname, transfer_time, max_time, is_rule_transfer FROM rt"""

    tdb = _with(base_e, ",", TRANSFER_DB)
    q["transfer_database"] = tdb + "\nSELECT * FROM tdb"
    by_day = W.replace("cardid_anony", "cardid_anony, CAST(transaction_time - INTERVAL 3 HOUR AS DATE)", 1)
    q["transfer_database_upkeep"] = _with(base_e, ",", TRANSFER_DB).replace(W, by_day) + """
SELECT *, make_date(Year, Month, CAST(1 + (CircadianDayOfWeek - 1 - dayofweek(make_date(Year, Month, 1)) + 7) % 7 + 7 * (RandomWeekID - 1) AS INTEGER)) AS service_date
FROM tdb"""
    q["median_gaps"] = _with(base_e, ",", TRANSFER_TIME) + """
SELECT previous_participant, participantname, median(transfer_time) AS median_minutes FROM tt GROUP BY ALL"""
    q["shares"] = tdb + "\nSELECT * FROM shares"
    ints = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in (
        "sampled_transfers", "from_Agency_Sampled_Transactions", "to_Agency_Sampled_Transactions", "estimated_transfers",
        "estimated_from_agency_transactions", "estimated_to_agency_transactions"))
    q["pair_day_csv"] = tdb + f"\nSELECT * REPLACE ({ints}) FROM shares"
    q["median_share_chart"] = tdb + f"""
SELECT to_AgencyName, median(from_share) AS median_from_share
FROM shares WHERE from_AgencyName = '{cat.CHART_AGENCY}' GROUP BY to_AgencyName"""
    q["share_by_from"] = tdb + """
SELECT from_AgencyName, to_AgencyName, Year, median(estimated_transfers) AS median_transfers,
       median(estimated_from_agency_transactions) AS median_from_transactions,
       median(from_share) AS median_from_share
FROM shares GROUP BY ALL"""
    q["share_by_to"] = tdb + """
SELECT from_AgencyName, to_AgencyName, Year, median(estimated_transfers) AS median_transfers,
       median(estimated_to_agency_transactions) AS median_to_transactions,
       median(to_share) AS median_to_share
FROM shares GROUP BY ALL"""
    q["agency_transactions"] = tdb + """
SELECT Year, Month, CircadianDayOfWeek, from_AgencyName,
       median(estimated_from_agency_transactions) AS median_from_transactions
FROM tdb GROUP BY ALL"""
    q["observed_days"] = tdb + """
SELECT Year, Month, CircadianDayOfWeek, count(DISTINCT RandomWeekID) AS observed_weeks
FROM tdb GROUP BY ALL"""
    q["transfers_with_totals"] = tdb + """
SELECT from_AgencyName, to_AgencyName, Year, CAST(grouping(Year) AS BOOLEAN) AS is_total,
       median(estimated_transfers) AS median_transfers,
       CASE WHEN count(estimated_transfers) > 1 THEN sqrt(CAST(count(estimated_transfers)
            * sum(estimated_transfers * estimated_transfers) - sum(estimated_transfers) * sum(estimated_transfers)
            AS DOUBLE) / CAST(count(estimated_transfers) * (count(estimated_transfers) - 1) AS DOUBLE)) END
         AS sd_transfers
FROM tdb
GROUP BY GROUPING SETS ((from_AgencyName, to_AgencyName, Year), (from_AgencyName, to_AgencyName))"""

    def wide(name: str, heading: str, headings: list, values: list[str], keys: str) -> str:
        cells = ", ".join(f'max(CASE WHEN {heading} = {h} THEN {v} END) AS "{h}{"_" + v if len(values) > 1 else ""}"' for h in headings for v in values)
        return f"SELECT {keys}, {cells} FROM ({q[name]}) GROUP BY ALL"

    for way in ("from", "to"):
        q[f"share_by_{way}_years"] = wide(f"share_by_{way}", "Year", cat.REPORT_YEARS, [
            "median_transfers", f"median_{way}_transactions", f"median_{way}_share"], "from_AgencyName, to_AgencyName")
    q["agency_transactions_weekdays"] = wide("agency_transactions", "CircadianDayOfWeek", list(range(1, 8)), ["median_from_transactions"], "Year, Month, from_AgencyName")
    q["observed_days_years"] = wide("observed_days", "Year", cat.REPORT_YEARS, ["observed_weeks"], "Month, CircadianDayOfWeek")

    seq_base = _with(base_e, ",", rides_cte("enriched", "rides_e"), sequences_cte("rides_e"))
    q["sequences_by_date"] = seq_base + f""",
pc AS (
  SELECT CardID, CircadianDate, string_agg(record_, ' ' ORDER BY on_, seq_) AS RunSequence
  FROM sr GROUP BY ALL
)
SELECT CircadianDate, {WEEKDAYS.format(c='dayofweek(CircadianDate) + 1')} AS CircadianDayOfWeek,
       RunSequence, count(*) AS n
FROM pc GROUP BY CircadianDate, RunSequence"""

    q["sequences_by_day_id"] = seq_base + f""",
sd AS (
  SELECT *, CAST(1000000 * CAST(year(CircadianDate) AS BIGINT) + 10000 * month(CircadianDate)
                 + 100 * (dayofweek(CircadianDate) + 1) + CAST(ceil(day(CircadianDate) / 7) AS INTEGER)
                 AS BIGINT) AS DayID
  FROM sr
),
pc AS (
  SELECT CardID, DayID, string_agg(record_, ' ' ORDER BY on_, seq_) AS RunSequence
  FROM sd GROUP BY ALL
),
cnt AS (SELECT DayID, RunSequence, count(*) AS n FROM pc GROUP BY ALL)
SELECT DayID, CAST(DayID // 1000000 AS INTEGER) AS Year,
       {MONTHS.format(c='CAST((DayID // 10000) % 100 AS INTEGER)')} AS Month,
       {WEEKDAYS.format(c='CAST((DayID // 100) % 100 AS INTEGER)')} AS CircadianDayOfWeek,
       CAST(DayID % 100 AS INTEGER) AS RandomWeekID, RunSequence, n
FROM cnt"""

    on = "coalesce(tagon_time, transaction_time)"
    q["sequences_sampled_trips"] = _with(base_e, ",", rides_cte("enriched", "rides_e")) + f""",
trips AS (
  SELECT cardid_anony, CAST({on} - INTERVAL 3 HOUR AS DATE) AS day, 1 + sequencenumber % 3 AS week,
         CASE WHEN sequencenumber % 11 != 0 THEN sequencenumber * 48271 % 2147483647 END AS trip, strftime({on}, '%H:%M:%S') AS clock,
         concat_ws(' ', CAST(hour({on}) AS VARCHAR), coalesce(locationname_origin, 'NA'), coalesce(locationname_destination, 'NA')) AS record
  FROM rides_e
),
pc AS (
  SELECT cardid_anony, CAST(1000000 * CAST(year(day) AS BIGINT) + 10000 * month(day) + 100 * (dayofweek(day) + 1) + week AS BIGINT) AS DayID,
         string_agg(record, ' ' ORDER BY trip NULLS LAST, clock, record) AS RunSequence
  FROM trips GROUP BY ALL
),
cnt AS (SELECT DayID, RunSequence, count(*) AS n FROM pc GROUP BY ALL)
SELECT DayID, CAST(DayID // 1000000 AS INTEGER) AS Year,
       {MONTHS.format(c='CAST((DayID // 10000) % 100 AS INTEGER)')} AS Month,
       {WEEKDAYS.format(c='CAST((DayID // 100) % 100 AS INTEGER)')} AS CircadianDayOfWeek,
       CAST(DayID % 100 AS INTEGER) AS RandomWeekID, RunSequence, n
FROM cnt"""
    return q
