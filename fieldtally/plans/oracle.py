"""DuckDB SQL giving the same rows as each query, written independently of the operators.

Regressions are recomputed by a different method: both effects are removed by
repeated demeaning until nothing changes, and distribution functions are
integrated with Simpson's rule.
"""

from __future__ import annotations

from fieldtally.plans import bindings as B

_SQL: dict[str, str] = {}


# Date columns, shown as midnight timestamps like those of the queries.
_DATES = {
    "sink_roundtrip": ["trip_date"], "fct_trips": ["trip_date"], "incremental_month_load": ["first_day", "last_day"],
    "trips_enriched": ["trip_date"], "daily_counts": ["trip_date"], "rolling_7d_avg": ["trip_date"],
    "daily_summary": ["trip_date"], "did_panel": ["trip_date"], "group_daily_series": ["trip_date"],
    "incremental_daily_summary": ["trip_date"], "indexed_series": ["trip_date"], "event_weeks": ["first_day", "last_day"],
}


def all_oracles() -> dict[str, str]:
    return {name: _shown(sql, _DATES.get(name, ())) for name, sql in _SQL.items()}


def _shown(sql: str, dates) -> str:
    if not dates:
        return sql
    casts = ", ".join(f"CAST({c} AS TIMESTAMP) AS {c}" for c in dates)
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"


def _r(expr: str, digits: int) -> str:
    """Round half away from zero on the decimal value, as Spark does for doubles."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def _pct(a: str, b: str, digits: int = 2) -> str:
    return _r(f"100.0::DOUBLE * ({a}) / nullif(({b})::DOUBLE, 0)", digits)


_TRIPS = """
ev AS (SELECT *, (props->>'$.k')::INTEGER AS k FROM events),
trips AS (
  SELECT CASE WHEN event_type IN ('view','click') THEN 'HV0003' WHEN event_type = 'purchase' THEN 'HV0005'
              WHEN event_type = 'signup' THEN 'HV0002' ELSE 'HV0004' END AS hvfhs_license_num,
         event_type AS dispatching_base_num,
         CAST(NULL AS VARCHAR) AS originating_base_num,
         ts - to_seconds(k * 7 + 60) AS request_datetime,
         ts - to_microseconds(round(value * 1000000)::BIGINT) AS on_scene_datetime,
         ts AS pickup_datetime,
         ts + to_microseconds(round((value + k * 60 - 60) * 1000000)::BIGINT) AS dropoff_datetime,
         user_id AS PULocationID,
         k::BIGINT AS DOLocationID,
         value / 10 AS trip_miles,
         (k * 60 - 60)::BIGINT AS trip_time,
         value AS base_passenger_fare,
         CASE WHEN k > 80 THEN 6.5 ELSE 0 END::DOUBLE AS tolls,
         0.25::DOUBLE AS bcf,
         k * 0.05::DOUBLE AS sales_tax,
         CASE WHEN event_type = 'purchase' THEN 2.75 ELSE 0 END::DOUBLE AS congestion_surcharge,
         CASE WHEN event_type <> 'error' THEN 0 END::DOUBLE AS airport_fee,
         k * 0.1::DOUBLE AS tips,
         value - k * 0.01::DOUBLE AS driver_pay,
         CASE WHEN event_type = 'click' THEN 'Y' WHEN event_type <> 'error' THEN 'N' END AS shared_request_flag,
         CASE WHEN event_type = 'click' AND k < 50 THEN 'Y' WHEN event_type = 'purchase' AND k < 3 THEN 'Y'
              ELSE 'N' END AS shared_match_flag,
         CAST(NULL AS VARCHAR) AS access_a_ride_flag,
         CAST(NULL AS VARCHAR) AS wav_request_flag,
         CAST(NULL AS VARCHAR) AS wav_match_flag,
         CASE WHEN event_type IN ('click','purchase') THEN 1.5 WHEN event_type <> 'signup' THEN 0 END::DOUBLE
           AS cbd_congestion_fee
  FROM ev)"""

_SCOPED = f"""{_TRIPS},
scoped AS (SELECT * FROM trips
           WHERE pickup_datetime >= TIMESTAMP '{B.SCOPE[0]}' AND pickup_datetime < TIMESTAMP '{B.SCOPE[1]}')"""

_ZONES = """
zones AS (SELECT c_custkey AS id, r_name AS borough, n_name AS zone FROM customer
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_COMPANY = "CASE hvfhs_license_num WHEN 'HV0003' THEN 'Uber' WHEN 'HV0005' THEN 'Lyft' END"


def _day_type(day: str) -> str:
    return f"CASE WHEN isodow({day}) >= 6 THEN 'weekend' ELSE 'weekday' END"


_TRIP_COLUMNS = """hvfhs_license_num, dispatching_base_num, request_datetime, on_scene_datetime, pickup_datetime,
  dropoff_datetime, PULocationID AS pickup_location_id, DOLocationID AS dropoff_location_id, trip_miles, trip_time,
  base_passenger_fare, tolls, bcf, sales_tax, congestion_surcharge, airport_fee, tips, driver_pay,
  cbd_congestion_fee"""

_ENRICHED = f"""{_SCOPED}, {_ZONES},
enriched AS (
  SELECT {_TRIP_COLUMNS}, {_COMPANY} AS provider_name,
         a.zone AS pickup_zone, a.borough AS pickup_borough, b.zone AS dropoff_zone, b.borough AS dropoff_borough,
         pickup_datetime::DATE AS trip_date, dayname(pickup_datetime) AS day_of_week,
         {_day_type('pickup_datetime')} AS day_type,
         hour(pickup_datetime)::BIGINT AS hour_of_day,
         date_diff('second', request_datetime, pickup_datetime) AS wait_time_sec,
         date_diff('second', request_datetime, on_scene_datetime) AS approach_time_sec,
         date_diff('second', on_scene_datetime, pickup_datetime) AS dwell_time_sec,
         shared_request_flag = 'Y' AS is_shared_request, shared_match_flag = 'Y' AS is_shared_match,
         cbd_congestion_fee > 0 AS is_cbd_fee_trip
  FROM scoped JOIN zones a ON PULocationID = a.id JOIN zones b ON DOLocationID = b.id)"""

_DAILY = f"""
SELECT trip_date, dayname(trip_date) AS day_of_week, {_day_type('trip_date')} AS day_type,
       count(*) AS trip_count,
       count(*) FILTER (provider_name = 'Uber') AS uber_trip_count,
       count(*) FILTER (provider_name = 'Lyft') AS lyft_trip_count,
       count(*) FILTER (is_shared_request) AS shared_request_count,
       count(*) FILTER (is_shared_match) AS shared_match_count,
       count(*) FILTER (is_cbd_fee_trip) AS cbd_fee_trip_count,
       {_r('sum(driver_pay)', 2)} AS total_driver_pay,
       {_r('sum(base_passenger_fare)', 2)} AS total_base_fare,
       {_pct('sum(driver_pay)', 'sum(base_passenger_fare)')} AS driver_share_of_fare_pct,
       {_r('avg(count(*)) OVER (ORDER BY trip_date ROWS 6 PRECEDING)', 0)} AS rolling_7d_avg_trips
FROM enriched GROUP BY trip_date"""

# --- sources -------------------------------------------------------------------------------

_SQL["scan_union_by_name"] = f"""WITH {_TRIPS}
SELECT hvfhs_license_num, pickup_datetime, PULocationID, DOLocationID, trip_time, base_passenger_fare,
       CASE WHEN pickup_datetime >= TIMESTAMP '{B.POLICY}' THEN cbd_congestion_fee END AS cbd_congestion_fee
FROM trips"""

_SQL["scan_csv"] = """
SELECT event_id AS order_id, user_id, event_type AS eval_set, day(ts)::INTEGER AS order_number,
       dayofweek(ts)::INTEGER AS order_dow, hour(ts)::INTEGER AS order_hour_of_day,
       CASE WHEN event_type <> 'signup' THEN value END AS days_since_prior_order
FROM events"""

_SQL["sink_roundtrip"] = f"WITH {_ENRICHED} {_DAILY}"

_SQL["table_row_counts"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"))

_SQL["incremental_month_load"] = """
SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS row_count, sum(l_quantity) AS quantity,
       min(l_shipdate)::DATE AS first_day, max(l_shipdate)::DATE AS last_day
FROM lineitem GROUP BY 1"""

_SQL["missing_sources"] = f"""WITH {_ZONES}
SELECT 'trips' AS table_name, count(*) AS row_count, 'zones' AS missing_before FROM events
UNION ALL SELECT 'zones', count(*), 'zones' FROM zones"""

_SQL["seed_dimension"] = f"""WITH {_ZONES}, {_TRIPS},
counted AS (SELECT PULocationID AS id, count(*) AS n FROM trips GROUP BY 1)
SELECT CASE borough WHEN 'ASIA' THEN 'treatment' WHEN 'EUROPE' THEN 'outer_borough_control' ELSE 'exclude_other' END AS zone_group,
       count(*) AS zones, coalesce(sum(n), 0)::BIGINT AS trips
FROM zones LEFT JOIN counted USING (id) GROUP BY 1"""

_SPREAD = "spread AS (SELECT * REPLACE (ts + to_months((event_id % 3)::INTEGER) AS ts) FROM events)"

_SQL["spread_join_volume"] = """
SELECT s_nationkey, count(*) AS n_lines, sum(l_quantity) AS quantity
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"""

_SQL["approximate_distinct"] = f"""WITH {_SPREAD}
SELECT strftime(ts, '%Y-%m') AS month, count(DISTINCT user_id) AS users, TRUE AS within_bound FROM spread GROUP BY 1
UNION ALL SELECT 'all', count(DISTINCT user_id), TRUE FROM spread"""

# --- staging and enrichment ----------------------------------------------------------------

_SQL["staging_contract"] = f"""WITH {_TRIPS}
SELECT {_TRIP_COLUMNS}, originating_base_num, shared_request_flag, shared_match_flag, access_a_ride_flag,
       wav_request_flag, wav_match_flag
FROM trips"""

_SQL["trips_enriched"] = f"""WITH {_ENRICHED}
SELECT * REPLACE (is_shared_request::VARCHAR AS is_shared_request, is_shared_match::VARCHAR AS is_shared_match,
                  is_cbd_fee_trip::VARCHAR AS is_cbd_fee_trip)
FROM enriched"""

_SQL["fct_trips"] = _SQL["trips_enriched"]

_SQL["staging_zones"] = """
SELECT c_custkey AS location_id, r_name AS borough, n_name AS zone, c_mktsegment AS service_zone FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

_SQL["staging_products"] = """
SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS aisle_id, p_type AS department_id FROM part"""

_SQL["staging_aisles"] = "SELECT DISTINCT p_brand AS aisle_id, p_brand AS aisle FROM part"

_SQL["staging_departments"] = "SELECT DISTINCT p_type AS department_id, p_type AS department FROM part"

_SQL["interval_columns"] = f"""WITH {_TRIPS}
SELECT pickup_datetime,
       floor(epoch(pickup_datetime))::BIGINT - floor(epoch(request_datetime))::BIGINT AS wait_time_sec,
       floor(epoch(on_scene_datetime))::BIGINT - floor(epoch(request_datetime))::BIGINT AS approach_time_sec,
       floor(epoch(pickup_datetime))::BIGINT - floor(epoch(on_scene_datetime))::BIGINT AS dwell_time_sec
FROM trips"""

# --- demand --------------------------------------------------------------------------------

_SQL["daily_counts"] = f"""WITH {_SCOPED}
SELECT pickup_datetime::DATE AS trip_date, dayname(pickup_datetime) AS day_of_week, count(*) AS trip_count
FROM scoped GROUP BY 1, 2"""

_SQL["category_label_counts"] = f"""WITH {_SCOPED}
SELECT {_COMPANY} AS provider_name, count(*) AS provider_count FROM scoped GROUP BY 1"""

_SQL["flag_funnel_rates"] = f"""WITH {_SCOPED}, steps AS (
  SELECT {_COMPANY} AS provider_name, count(*) FILTER (shared_request_flag = 'Y') AS requested_count,
         count(*) FILTER (shared_match_flag = 'Y') AS matched_count, count(*) AS total_trips
  FROM scoped GROUP BY 1)
SELECT *, requested_count::DOUBLE / total_trips AS request_rate, matched_count::DOUBLE / total_trips AS match_rate,
       matched_count::DOUBLE / nullif(requested_count, 0) AS match_efficiency
FROM steps"""

_SQL["distribution_profile"] = f"""WITH lines AS (
  SELECT (l_quantity * 86400)::BIGINT AS t, o_orderdate AS a, l_shipdate AS b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT count(*) AS total_trips,
       median(t)::DOUBLE AS median_sec, {_r('median(t) / 60.0::DOUBLE', 1)} AS median_min,
       quantile_cont(t, 0.9)::DOUBLE AS p90_sec, {_r('quantile_cont(t, 0.9) / 60.0::DOUBLE', 1)} AS p90_min,
       quantile_cont(t, 0.99)::DOUBLE AS p99_sec, {_r('quantile_cont(t, 0.99) / 60.0::DOUBLE', 1)} AS p99_min,
       min(t) AS min_sec, max(t) AS max_sec, {_r('max(t) / 3600.0::DOUBLE', 1)} AS max_hours,
       count(*) FILTER (t <= 0) AS zero_or_negative_trips,
       count(*) FILTER (t > 40 * 86400) AS over_4_hour_trips,
       count(*) FILTER (abs(t - date_diff('second', a, b)) > 60) AS trip_time_mismatch_trips
FROM lines"""

_SUPPLIED = """
supplied AS (SELECT n_name AS pickup_zone, r_name AS borough, l_tax, l_orderkey FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

_SQL["topk_share"] = f"""WITH {_SUPPLIED}
SELECT pickup_zone, borough, count(*) AS trip_count,
       {_pct('count(*)', '(SELECT count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)')}
         AS pct_of_all_trips
FROM supplied GROUP BY 1, 2 ORDER BY trip_count DESC, pickup_zone, borough LIMIT 10"""

_SQL["fee_share"] = f"""WITH {_SCOPED}
SELECT count(*) AS total_trips, count(*) FILTER (cbd_congestion_fee > 0) AS fee_paying_trips,
       {_pct('count(*) FILTER (cbd_congestion_fee > 0)', 'count(*)')} AS pct_paying_fee
FROM scoped"""

_SQL["fee_top_origins"] = f"""WITH {_SUPPLIED}
SELECT pickup_zone, borough, count(*) AS fee_paying_trip_count FROM supplied WHERE l_tax > 0
GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10"""

_COST = ("base_passenger_fare + tolls + bcf + sales_tax + congestion_surcharge + airport_fee + tips"
         " + cbd_congestion_fee")

_SQL["ratio_of_sums_by_hour"] = f"""WITH {_SCOPED}
SELECT hour(pickup_datetime)::BIGINT AS hour_of_day, count(*) AS trip_count,
       {_r('sum(driver_pay)', 2)} AS total_driver_pay,
       {_r('sum(base_passenger_fare)', 2)} AS total_base_fare,
       {_r(f'sum({_COST})', 2)} AS total_rider_cost,
       {_pct('sum(driver_pay)', f'sum({_COST})')} AS naive_driver_share_pct,
       {_pct('sum(driver_pay)', 'sum(base_passenger_fare)')} AS driver_share_of_fare_pct
FROM scoped GROUP BY 1"""

_FLOWS = """
flows AS (SELECT f.n_name AS pickup_zone, t.n_name AS dropoff_zone, count(*) AS trip_count FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation f ON s_nationkey = f.n_nationkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation t ON c_nationkey = t.n_nationkey GROUP BY 1, 2)"""

_SQL["role_playing_join"] = f"WITH {_FLOWS} SELECT * FROM flows"

_SQL["topn_per_group"] = f"""WITH {_FLOWS}, ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY pickup_zone ORDER BY trip_count DESC, dropoff_zone))::INTEGER
    AS dropoff_rank FROM flows)
SELECT * FROM ranked WHERE dropoff_rank <= 3"""

_SQL["weekday_weekend_curve"] = f"""WITH {_SCOPED}, days AS (
  SELECT {_day_type('pickup_datetime')} AS day_type, count(DISTINCT pickup_datetime::DATE) AS n FROM scoped GROUP BY 1)
SELECT hour(pickup_datetime)::BIGINT AS hour_of_day,
       {_r("count(*) FILTER (isodow(pickup_datetime) < 6) / (SELECT n::DOUBLE FROM days WHERE day_type = 'weekday')", 0)}
         AS avg_weekday_trips,
       {_r("count(*) FILTER (isodow(pickup_datetime) >= 6) / (SELECT n::DOUBLE FROM days WHERE day_type = 'weekend')", 0)}
         AS avg_weekend_trips
FROM scoped GROUP BY 1"""

_SQL["rolling_7d_avg"] = f"""WITH {_SCOPED}
SELECT pickup_datetime::DATE AS trip_date, count(*) AS trip_count,
       {_r('avg(count(*)) OVER (ORDER BY pickup_datetime::DATE ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 0)}
         AS rolling_7d_avg
FROM scoped GROUP BY 1"""

# --- cohorts -------------------------------------------------------------------------------

_ORDERS = f"""
numbered AS (
  SELECT *, row_number() OVER w AS n, lag(o_orderdate) OVER w AS prev, count(*) OVER (PARTITION BY o_custkey) AS total
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
ords AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id,
         CASE WHEN n < total THEN 'prior' WHEN o_orderstatus = 'O' THEN 'test' ELSE 'train' END AS eval_set,
         n::INTEGER AS order_number, dayofweek(o_orderdate)::INTEGER AS order_dow,
         hour(o_orderdate)::INTEGER AS order_hour_of_day,
         CASE WHEN prev IS NOT NULL
              THEN least(date_diff('day', prev, o_orderdate), {B.GAP_CAP}) END::DOUBLE AS days_since_prior_order
  FROM numbered)"""

_ITEMS = f"""{_ORDERS},
items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS add_to_cart_order, user_id, order_number,
         order_dow, order_hour_of_day, days_since_prior_order,
         CASE WHEN eval_set = 'prior' THEN 'prior' ELSE 'train' END AS source_eval_set,
         order_number > min(order_number) OVER (PARTITION BY user_id, l_partkey) AS again
  FROM lineitem JOIN ords ON l_orderkey = order_id)"""

_SQL["staging_orders"] = f"""WITH {_ORDERS}
SELECT order_id, user_id, eval_set, order_number, order_dow, order_hour_of_day, days_since_prior_order FROM ords"""

_STAGED = "SELECT order_id, product_id, add_to_cart_order, again AS is_reordered"
for _set in ("prior", "train"):
    _SQL[f"staging_order_products_{_set}"] = f"""WITH {_ITEMS} {_STAGED} FROM items WHERE source_eval_set = '{_set}'"""
_SQL["tagged_union"] = f"WITH {_ITEMS} {_STAGED}, source_eval_set FROM items"

_TIER = f"""CASE WHEN recency_days = {B.GAP_CAP} THEN '{B.GAP_TIERS["censored"]}'
  {' '.join(f"WHEN recency_days >= {edge} THEN '{name}'" for edge, name in B.GAP_TIERS["tiers"])}
  ELSE '{B.GAP_TIERS["recent"]}' END"""

_USERS = """
users AS (SELECT user_id, count(*) AS total_orders FROM ords GROUP BY 1),
recency AS (SELECT user_id, days_since_prior_order AS recency_days FROM ords
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY order_number DESC) = 1),
volume AS (SELECT user_id, count(*) AS total_items_prior FROM items WHERE source_eval_set = 'prior' GROUP BY 1)"""

_SQL["sequence_retention"] = f"""WITH {_ORDERS}
SELECT order_number, count(DISTINCT user_id) AS n_users_reaching,
       {_pct('count(DISTINCT user_id)', '(SELECT count(DISTINCT user_id) FROM ords)')} AS pct_of_all_users
FROM ords GROUP BY 1"""

_SQL["latest_row_per_key"] = f"""WITH {_ORDERS}
SELECT user_id, order_number AS last_order_number, order_id, days_since_prior_order
FROM ords JOIN (SELECT user_id, max(order_number) AS order_number FROM ords GROUP BY 1) USING (user_id, order_number)"""

_SQL["reorder_rate_summary"] = f"""WITH {_ITEMS}, both_scopes AS (
  SELECT 'all orders (1st order included -- reorder=0 there by definition)' AS scope, again FROM items
  UNION ALL
  SELECT 'excluding each user''s 1st order', again FROM items WHERE order_number > 1)
SELECT scope, count(*) AS total_items, count(*) FILTER (again) AS reordered_items,
       {_pct('count(*) FILTER (again)', 'count(*)')} AS reorder_rate_pct
FROM both_scopes GROUP BY 1"""

_SQL["reorder_rate_by_tenure"] = f"""WITH {_ITEMS}
SELECT order_number, count(*) AS total_items, {_pct('count(*) FILTER (again)', 'count(*)')} AS reorder_rate_pct
FROM items GROUP BY 1"""

_SQL["rfm_segmentation"] = f"""WITH {_ITEMS}, {_USERS}, scored AS (
  SELECT {_TIER} AS recency_tier, total_orders, total_items_prior,
         ntile(5) OVER (ORDER BY total_orders, user_id) AS f,
         ntile(5) OVER (ORDER BY total_items_prior, user_id) AS m
  FROM users JOIN recency USING (user_id) JOIN volume USING (user_id))
SELECT recency_tier, count(*) AS n_users, {_r('avg(total_orders)', 1)} AS avg_orders,
       {_r('avg(f)', 2)} AS avg_frequency_score, {_r('avg(total_items_prior)', 1)} AS avg_items_prior,
       {_r('avg(m)', 2)} AS avg_monetary_score,
       {_pct('count(*)', '(SELECT count(*) FROM users)')} AS pct_of_users
FROM scored GROUP BY 1"""

_SQL["churn_gap_recovery"] = f"""WITH {_ORDERS}, gaps AS (
  SELECT order_number, last FROM ords JOIN (SELECT user_id, max(order_number) AS last FROM ords GROUP BY 1)
    USING (user_id) WHERE days_since_prior_order = {B.GAP_CAP})
SELECT count(*) AS total_capped_gaps, count(*) FILTER (order_number = last) AS terminal_gaps,
       count(*) FILTER (order_number < last) AS recovered_gaps,
       {_pct('count(*) FILTER (order_number < last)', 'count(*)')} AS pct_recovered
FROM gaps"""

_RUNNING = """
running AS (SELECT user_id, order_number,
    sum(count(*)) OVER (PARTITION BY user_id ORDER BY order_number) AS total
  FROM items WHERE source_eval_set = 'prior' GROUP BY 1, 2)"""

_SQL["cumulative_by_tenure"] = f"""WITH {_ITEMS}, {_RUNNING}
SELECT order_number, count(*) AS n_users_at_this_point, {_r('avg(total)', 1)} AS avg_cumulative_items
FROM running WHERE order_number IN (1, 2, 3, 5, 8, 10, 12, 15, 20) GROUP BY 1"""

_COMPOSITION = f"""WITH {_ITEMS}
SELECT p_type AS department, count(*) AS total_items,
       {_pct('count(*)', '(SELECT count(*) FROM items)')} AS pct_of_all_items,
       {_pct('count(*) FILTER (again)', 'count(*)')} AS reorder_rate_pct
FROM items JOIN part ON product_id = p_partkey GROUP BY 1"""
_SQL["basket_composition"] = f"{_COMPOSITION} ORDER BY 2 DESC, 1 LIMIT 10"

_LEADERS = f"""
SELECT p_name AS product_name, count(*) AS total_purchases,
       {_pct('count(*) FILTER (again)', 'count(*)')} AS reorder_rate_pct
FROM items JOIN part ON product_id = p_partkey GROUP BY 1 HAVING count(*) >= {B.LEADERBOARD_FLOOR}"""

_SQL["reorder_leaderboard"] = f"WITH {_ITEMS} {_LEADERS} ORDER BY reorder_rate_pct DESC, product_name LIMIT 10"

# --- marts ---------------------------------------------------------------------------------

_SQL["order_items_enriched"] = f"""WITH {_ITEMS}
SELECT order_id, product_id, add_to_cart_order, again AS is_reordered, source_eval_set, p_name AS product_name,
       p_brand AS aisle_id, p_brand AS aisle, p_type AS department_id, p_type AS department, user_id, order_number,
       order_dow, order_hour_of_day, days_since_prior_order
FROM items JOIN part ON product_id = p_partkey"""

_SQL["daily_summary"] = f"WITH {_ENRICHED} {_DAILY}"

_SQL["hourly_demand"] = f"""WITH {_ENRICHED}
SELECT hour_of_day, day_type, count(*) AS trip_count, count(DISTINCT trip_date) AS n_days,
       {_r('count(*) / count(DISTINCT trip_date)::DOUBLE', 0)} AS avg_trips_per_hour,
       {_r('sum(driver_pay)', 2)} AS total_driver_pay, {_r('sum(base_passenger_fare)', 2)} AS total_base_fare,
       {_pct('sum(driver_pay)', 'sum(base_passenger_fare)')} AS driver_share_of_fare_pct
FROM enriched GROUP BY 1, 2"""

_SQL["source_registry"] = f"""WITH {_ITEMS}, {_ZONES}
SELECT 'trips' AS table_name, count(*) AS row_count FROM events
UNION ALL SELECT 'zones', count(*) FROM zones
UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'order_products_prior', count(*) FROM items WHERE source_eval_set = 'prior'
UNION ALL SELECT 'order_products_train', count(*) FROM items WHERE source_eval_set = 'train'
UNION ALL SELECT 'products', count(*) FROM part
UNION ALL SELECT 'aisles', count(DISTINCT p_brand) FROM part
UNION ALL SELECT 'departments', count(DISTINCT p_type) FROM part"""

_LONGER = f"{_SPREAD}, " + _ENRICHED.replace("FROM events", "FROM spread").replace(B.SCOPE[1], "2025-01-01")
_SQL["incremental_daily_summary"] = f"WITH {_LONGER} {_DAILY}"
_SQL["incremental_hourly_demand"] = _SQL["hourly_demand"].replace(_ENRICHED, _LONGER)

_SQL["user_rfm"] = f"""WITH {_ITEMS}, {_USERS}
SELECT user_id, total_orders AS frequency, recency_days, {_TIER} AS recency_tier,
       coalesce(total_items_prior, 0) AS monetary_proxy_items
FROM users JOIN recency USING (user_id) LEFT JOIN volume USING (user_id)"""

_SQL["order_sequence_summary"] = f"""WITH {_ITEMS}, {_RUNNING},
reached AS (SELECT order_number, count(DISTINCT user_id) AS n FROM ords GROUP BY 1),
bought AS (SELECT order_number, count(*) AS n, count(*) FILTER (again) AS r FROM items GROUP BY 1),
volume AS (SELECT order_number, avg(total) AS v FROM running GROUP BY 1)
SELECT order_number, reached.n AS n_users_reaching,
       {_pct('reached.n', '(SELECT count(DISTINCT user_id) FROM ords)')} AS pct_of_all_users,
       bought.n::DOUBLE AS total_items, {_pct('bought.r', 'bought.n')} AS reorder_rate_pct,
       {_r('volume.v', 1)} AS avg_cumulative_items_prior
FROM reached LEFT JOIN bought USING (order_number) LEFT JOIN volume USING (order_number)"""

_SQL["department_composition"] = _COMPOSITION
_SQL["product_leaderboard"] = f"WITH {_ITEMS} {_LEADERS}"

# --- panels --------------------------------------------------------------------------------


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_CLASSES = f"""{_TRIPS}, {_ZONES},
paid AS (SELECT PULocationID AS id, 100.0::DOUBLE * count(*) FILTER (cbd_congestion_fee > 0) / count(*) AS pct
         FROM trips GROUP BY 1),
classes AS (
  SELECT id, zone, borough, pct,
         CASE WHEN borough IN ({_in(B.CORE_AREAS)}) THEN
                CASE WHEN pct >= {B.TREAT_AT} THEN 'treatment' WHEN pct >= {B.BORDER_AT} THEN 'border_exclude'
                     ELSE 'manhattan_north_control' END
              WHEN borough IN ({_in(B.OUTER_AREAS)}) THEN 'outer_borough_control' ELSE 'exclude_other' END
           AS zone_group
  FROM paid JOIN zones USING (id))"""

_PANEL = f"""{_CLASSES},
panel AS (
  SELECT pickup_datetime::DATE AS trip_date, id AS location_id, zone AS zone_name, borough, zone_group,
         count(*) AS trip_count, sum(base_passenger_fare) AS fare, sum(driver_pay) AS pay,
         (zone_group = 'treatment')::INTEGER AS is_treatment,
         (pickup_datetime::DATE >= DATE '{B.POLICY}')::INTEGER AS is_post,
         (pickup_datetime::DATE >= DATE '{B.TRANSITION[0]}'
          AND pickup_datetime::DATE < DATE '{B.TRANSITION[1]}')::INTEGER AS is_transition_month
  FROM trips JOIN classes ON PULocationID = id
  WHERE zone_group IN ('treatment', 'outer_borough_control', 'manhattan_north_control')
  GROUP BY ALL)"""

_SQL["incidence_classification"] = f"""WITH {_CLASSES}
SELECT id AS LocationID, zone AS "Zone", borough AS "Borough", {_r('pct', 1)} AS pct_fee_charged, zone_group
FROM classes"""

_SQL["did_panel"] = f"""WITH {_PANEL}
SELECT * EXCLUDE (fare, pay), {_r('fare', 2)} AS total_base_fare, {_r('pay', 2)} AS total_driver_pay FROM panel"""

_SERIES = f"""{_PANEL},
series AS (SELECT trip_date, zone_group, sum(trip_count)::BIGINT AS trip_count,
                  count(DISTINCT location_id) AS n_zones,
                  sum(trip_count)::DOUBLE / count(DISTINCT location_id) AS avg_trips_per_zone
           FROM panel GROUP BY 1, 2)"""

_SQL["group_daily_series"] = f"WITH {_SERIES} SELECT * FROM series"

_CENTRED = "OVER (ORDER BY trip_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


def _smooth(c: str) -> str:
    return _r(f"CASE WHEN count({c}) {_CENTRED} = 7 THEN avg({c}) {_CENTRED} END", 6)


_SQL["indexed_series"] = f"""WITH {_SERIES}, level AS (
  SELECT trip_date, max(avg_trips_per_zone) FILTER (zone_group = 'treatment') AS a,
         max(avg_trips_per_zone) FILTER (zone_group = 'outer_borough_control') AS b FROM series GROUP BY 1),
base AS (SELECT avg(a) AS a, avg(b) AS b FROM level
         WHERE trip_date BETWEEN DATE '{B.PRE_PERIOD[0]}' AND DATE '{B.PRE_PERIOD[1]}'),
both_series AS (SELECT trip_date, level.a, level.b, 100 * level.a / base.a AS ai, 100 * level.b / base.b AS bi
                FROM level, base)
SELECT trip_date, {_r('a', 6)} AS treatment, {_smooth('a')} AS treatment_smooth,
       {_r('ai', 6)} AS treatment_index, {_smooth('ai')} AS treatment_index_smooth,
       {_r('b', 6)} AS outer_borough_control, {_smooth('b')} AS outer_borough_control_smooth,
       {_r('bi', 6)} AS outer_borough_control_index, {_smooth('bi')} AS outer_borough_control_index_smooth
FROM both_series"""


def _present(source: str) -> str:
    """Rows of units seen on enough of their own sample's days."""
    return f"""SELECT * FROM {source} AS s WHERE location_id IN (
      SELECT location_id FROM {source} AS q WHERE q.spec = s.spec GROUP BY 1
      HAVING count(DISTINCT trip_date) >= {B.PRESENCE}::DOUBLE
        * (SELECT count(DISTINCT trip_date) FROM {source} AS d WHERE d.spec = s.spec))"""


_SQL["presence_filter"] = f"""WITH {_PANEL}, n AS (SELECT count(DISTINCT trip_date) AS days FROM panel)
SELECT location_id, zone_group, count(*) AS n_days, sum(trip_count)::BIGINT AS trip_count
FROM panel GROUP BY 1, 2 HAVING count(DISTINCT trip_date) >= {B.PRESENCE}::DOUBLE * (SELECT days FROM n)"""

_WEEKS = f"""{_PANEL},
dated AS (SELECT *, floor(date_diff('day', DATE '{B.POLICY}', trip_date) / 7.0)::INTEGER AS week_relative FROM panel),
weeks AS (SELECT * FROM dated WHERE week_relative IN (
    SELECT week_relative FROM dated GROUP BY 1 HAVING count(DISTINCT trip_date) = 7))"""

_SQL["event_weeks"] = f"""WITH {_WEEKS}
SELECT week_relative, count(*) AS n_cells, min(trip_date) AS first_day, max(trip_date) AS last_day,
       sum(trip_count)::BIGINT AS trip_count
FROM weeks GROUP BY 1"""

# --- regressions ---------------------------------------------------------------------------

_OUTER, _CORE = "('treatment', 'outer_borough_control')", "('treatment', 'manhattan_north_control')"
_CALM = f"trip_date NOT BETWEEN DATE '{B.HOLIDAYS[0]}' AND DATE '{B.HOLIDAYS[1]}'"
_BEFORE = f"trip_date <= DATE '{B.PRE_PERIOD[1]}'"


def _grid(points: int = 2000) -> str:
    """Simpson weights on [0, 1]."""
    return f"""simpson AS (SELECT i / {points}.0::DOUBLE AS u,
      (CASE WHEN i IN (0, {points}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) / (3 * {points}.0::DOUBLE) AS w
    FROM range({points + 1}) AS g(i))"""


def _pretrend(specs: dict[str, str]) -> str:
    """A fully interacted line per group: slopes, intercepts and HC1 errors in closed form."""
    samples = " UNION ALL ".join(f"SELECT '{s}' AS spec, * FROM series WHERE {where}" for s, where in specs.items())
    return f"""WITH {_SERIES}, {_grid()}, sample AS ({samples}),
dated AS (SELECT spec, zone_group = 'treatment' AS g, avg_trips_per_zone AS y,
                 date_diff('day', min(trip_date) OVER (PARTITION BY spec), trip_date)::DOUBLE AS d FROM sample),
lines AS (SELECT spec, g, avg(d) AS dm, regr_slope(y, d) AS b, regr_intercept(y, d) AS a,
                 sum(d * d) - count(*) * avg(d) * avg(d) AS sdd, count(*) AS n FROM dated GROUP BY 1, 2),
-- Variance of slope and intercept of one line: sum of squared influence times squared residual.
noise AS (SELECT spec, g, sum(e * e * pow((d - dm) / sdd, 2)) AS vb,
                 sum(e * e * pow(1.0::DOUBLE / n - dm * (d - dm) / sdd, 2)) AS va
          FROM (SELECT dated.*, dm, sdd, n, y - a - b * d AS e FROM dated JOIN lines USING (spec, g)) GROUP BY 1, 2),
wide AS (SELECT spec, max(a) FILTER (g) AS a_t, max(a) FILTER (NOT g) AS a_c, max(b) FILTER (g) AS b_t,
                max(b) FILTER (NOT g) AS b_c, max(va) FILTER (g) AS vat, max(va) FILTER (NOT g) AS vac,
                max(vb) FILTER (g) AS vbt, max(vb) FILTER (NOT g) AS vbc, sum(n)::BIGINT AS n_obs
         FROM lines JOIN noise USING (spec, g) GROUP BY 1),
terms AS (
  SELECT spec, 'Intercept' AS term, a_c AS coef, vac AS v, n_obs FROM wide
  UNION ALL SELECT spec, 'is_treatment', a_t - a_c, vat + vac, n_obs FROM wide
  UNION ALL SELECT spec, 'days_since_start', b_c, vbc, n_obs FROM wide
  UNION ALL SELECT spec, 'is_treatment:days_since_start', b_t - b_c, vbt + vbc, n_obs FROM wide),
tested AS (SELECT spec, term, coef, sqrt(v * n_obs / (n_obs - 4)) AS se, n_obs FROM terms)
SELECT spec, term, {_r('coef', 6)} AS coef, {_r('se', 6)} AS std_error, {_r('coef / se', 6)} AS z_stat,
       {_r('1 - 2 * (SELECT sum(w * exp(-pow(u * coef / se, 2) / 2)) FROM simpson) * abs(coef / se) / sqrt(2 * pi())', 6)}
         AS p_value, n_obs
FROM tested"""


_SPECS = {
    "outer, full": f"zone_group IN {_OUTER} AND {_BEFORE}",
    "outer, no holidays": f"zone_group IN {_OUTER} AND {_BEFORE} AND {_CALM}",
    "core, full": f"zone_group IN {_CORE} AND {_BEFORE}",
    "core, no holidays": f"zone_group IN {_CORE} AND {_BEFORE} AND {_CALM}",
}
_SQL["pretrend_ols_hc1"] = _pretrend({"outer, full": _SPECS["outer, full"]})
_SQL["pretrend_specs"] = _pretrend(_SPECS)

# Normal quantile 0.975 and its expansion to a t quantile in powers of 1 / df.
_Z = 1.959963984540054
_T_QUANTILE = (
    f"({_Z} + {(_Z**3 + _Z) / 4} / df + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96} / pow(df, 2)"
    f" + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384} / pow(df, 3)"
    f" + {(79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160} / pow(df, 4))")
_T_P_VALUE = """1 - 2 * abs(t) * (SELECT sum(w * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5::DOUBLE * ln(df * pi())
    - (df + 1) / 2 * ln(1 + pow(u * t, 2) / df))) FROM simpson)"""


def _demeaned(columns: list[str], rounds: int = 25) -> str:
    """Both effects removed by alternating means, from ``sample`` (spec, z, d, columns)."""
    by_unit = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY spec, z) AS {c}" for c in columns)
    by_day = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY spec, d) AS {c}" for c in columns)
    start = ", ".join(f"{c}::DOUBLE AS {c}" for c in columns)
    return f"""iterated AS (
  SELECT 0 AS k, spec, z, d, {start} FROM sample
  UNION ALL
  SELECT k + 1, spec, z, d, {by_day} FROM (SELECT k, spec, z, d, {by_unit} FROM iterated WHERE k < {rounds})),
residual AS (SELECT * FROM iterated WHERE k = {rounds}),
size AS (SELECT spec, count(*) AS n, count(DISTINCT z) AS zones, count(DISTINCT d) AS days FROM sample GROUP BY 1)"""


_ONE_REGRESSOR = f"""{_demeaned(["y", "x"])},
fit AS (SELECT spec, sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx FROM residual GROUP BY 1),
scores AS (SELECT spec, z, sum(x * (y - b * x)) AS s FROM residual JOIN fit USING (spec) GROUP BY 1, 2),
tested AS (SELECT spec, b, n, zones, days, (n - 1 - zones - days + 1)::DOUBLE AS df,
                  sqrt(sum(s * s) * n / (n - 1 - zones - days + 1)) / xx AS se
           FROM scores JOIN fit USING (spec) JOIN size USING (spec) GROUP BY spec, b, n, zones, days, xx),
shown AS (SELECT *, b / se AS t, b - {_T_QUANTILE} * se AS lo, b + {_T_QUANTILE} * se AS hi FROM tested)"""

_FE_COLUMNS = f"""spec, 'did' AS term, {_r('b', 6)} AS coef, {_r('se', 6)} AS std_error, {_r('t', 6)} AS t_stat,
  {_r(_T_P_VALUE, 6)} AS p_value, {_r('lo', 6)} AS ci_low, {_r('hi', 6)} AS ci_high,
  n AS n_obs, zones AS n_zones, days AS n_days, false AS absorbed"""


def _twfe(specs: dict[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{s}' AS spec, * FROM panel WHERE {where}" for s, where in specs.items())
    return f"""WITH RECURSIVE {_PANEL}, {_grid()}, wanted AS ({rows}),
sample AS (SELECT spec, location_id AS z, trip_date AS d, ln(trip_count) AS y, is_treatment * is_post AS x
           FROM ({_present('wanted')})),
{_ONE_REGRESSOR}
SELECT {_FE_COLUMNS}, {_r('100 * (exp(b) - 1)', 6)} AS pct_effect, {_r('100 * (exp(lo) - 1)', 6)} AS pct_low,
       {_r('100 * (exp(hi) - 1)', 6)} AS pct_high
FROM shown"""


_SQL["twfe_did"] = _twfe({"primary": f"zone_group IN {_OUTER} AND {_CALM}"})
_SQL["twfe_specs"] = _twfe({
    "primary": f"zone_group IN {_OUTER} AND {_CALM}",
    "sensitivity": f"zone_group IN {_OUTER}",
    "robustness": f"zone_group IN {_CORE} AND {_CALM}",
})


def _effect(c: str) -> str:
    return _r(f"CASE WHEN spec LIKE 'log%' THEN 100 * (exp({c}) - 1) ELSE 100 * {c} END", 6)


_SQL["twfe_outcomes"] = f"""WITH RECURSIVE {_PANEL}, {_grid()},
wanted AS (SELECT '' AS spec, * FROM panel WHERE fare > 0 AND pay > 0 AND zone_group IN {_OUTER} AND {_CALM}),
kept AS ({_present('wanted')}),
sample AS (
  SELECT 'log_avg_fare' AS spec, location_id AS z, trip_date AS d, ln(fare / trip_count) AS y,
         is_treatment * is_post AS x FROM kept
  UNION ALL SELECT 'log_avg_pay', location_id, trip_date, ln(pay / trip_count), is_treatment * is_post FROM kept
  UNION ALL SELECT 'driver_share_of_fare', location_id, trip_date, pay / fare, is_treatment * is_post FROM kept),
{_ONE_REGRESSOR}
SELECT {_FE_COLUMNS}, {_effect('b')} AS effect, {_effect('lo')} AS effect_low, {_effect('hi')} AS effect_high,
       CASE WHEN spec LIKE 'log%' THEN 'percent' ELSE 'percentage points' END AS effect_unit
FROM shown"""

_ADJUGATE = {  # of the symmetric Gram matrix of the three week regressors
    "i11": "g22 * g33 - g23 * g23", "i12": "g13 * g23 - g12 * g33", "i13": "g12 * g23 - g13 * g22",
    "i22": "g11 * g33 - g13 * g13", "i23": "g12 * g13 - g11 * g23", "i33": "g11 * g22 - g12 * g12",
}
_WEEK_ROWS = {-1: ("i11", "i12", "i13"), 0: ("i12", "i22", "i23"), 1: ("i13", "i23", "i33")}

_SQL["event_study"] = f"""WITH RECURSIVE {_WEEKS},
wanted AS (SELECT '' AS spec, * FROM weeks WHERE zone_group IN {_OUTER}),
sample AS (SELECT spec, location_id AS z, trip_date AS d, ln(trip_count) AS y,
                  (is_treatment = 1 AND week_relative = -1)::INTEGER AS x1,
                  (is_treatment = 1 AND week_relative = 0)::INTEGER AS x2,
                  (is_treatment = 1 AND week_relative = 1)::INTEGER AS x3
           FROM ({_present('wanted')})),
{_demeaned(["y", "x1", "x2", "x3"])},
gram AS (SELECT sum(x1*x1) AS g11, sum(x1*x2) AS g12, sum(x1*x3) AS g13, sum(x2*x2) AS g22, sum(x2*x3) AS g23,
                sum(x3*x3) AS g33, sum(x1*y) AS h1, sum(x2*y) AS h2, sum(x3*y) AS h3 FROM residual),
adj AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _ADJUGATE.items())} FROM gram),
inv AS (SELECT h1, h2, h3, {', '.join(f'{n} / (g11*i11 + g12*i12 + g13*i13) AS {n}' for n in _ADJUGATE)} FROM adj),
fit AS (SELECT *, i11*h1 + i12*h2 + i13*h3 AS b1, i12*h1 + i22*h2 + i23*h3 AS b2, i13*h1 + i23*h2 + i33*h3 AS b3
        FROM inv),
scores AS (SELECT z, sum(x1 * e) AS s1, sum(x2 * e) AS s2, sum(x3 * e) AS s3
           FROM (SELECT residual.*, y - b1*x1 - b2*x2 - b3*x3 AS e FROM residual, fit) GROUP BY 1),
tested AS (
  {' UNION ALL '.join(
      f"SELECT {w} AS week_relative, any_value(b{i + 1}) AS b,"
      f" sqrt(sum(pow({r[0]}*s1 + {r[1]}*s2 + {r[2]}*s3, 2)) * any_value(n)"
      f" / any_value(n - 3 - zones - days + 1)) AS se, any_value(n - 3 - zones - days + 1)::DOUBLE AS df"
      f" FROM scores, fit, size" for i, (w, r) in enumerate(_WEEK_ROWS.items()))})
SELECT week_relative::INTEGER AS week_relative, {_r('b', 6)} AS coef, {_r('se', 6)} AS se,
       {_r(f'b - {_T_QUANTILE} * se', 6)} AS ci_low, {_r(f'b + {_T_QUANTILE} * se', 6)} AS ci_high FROM tested
UNION ALL SELECT {B.REFERENCE_WEEK}, 0, 0, 0, 0"""

# --- data quality --------------------------------------------------------------------------


def _checks(rows: list[tuple[str, str, str, str]], ctes: str = "", error_above: int = 0) -> str:
    """(check, table, column, scalar query counting failures) to the common report."""
    parts = " UNION ALL ".join(
        f"SELECT '{check}' AS \"check\", '{t}' AS table_name, '{c}' AS column_name, ({n})::BIGINT AS failures"
        for check, t, c, n in rows)
    head = f"WITH {ctes}, found AS ({parts})" if ctes else f"WITH found AS ({parts})"
    return (f"{head} SELECT *, CASE WHEN failures > {error_above} THEN 'error' WHEN failures > 0 THEN 'warn'"
            f" ELSE 'pass' END AS status FROM found")


def _nulls(t: str, source: str, c: str) -> tuple[str, str, str, str]:
    return "not_null", t, c, f"SELECT count(*) FROM {source} WHERE {c} IS NULL"


_SQL["dq_not_null"] = _checks(
    [_nulls("trips", "trips", c) for c in ("hvfhs_license_num", "pickup_datetime", "dropoff_datetime", "airport_fee",
                                           "shared_request_flag", "cbd_congestion_fee")]
    + [_nulls("orders", "ords", c) for c in ("order_id", "user_id", "days_since_prior_order")],
    f"{_TRIPS}, {_ORDERS}")


def _twice(check: str, t: str, c: str, source: str | None = None) -> tuple[str, str, str, str]:
    return check, t, c, (f"SELECT count(*) FROM (SELECT {c} FROM {source or t} GROUP BY {c} HAVING count(*) > 1)")


_SQL["dq_unique"] = _checks([_twice("unique", t, c) for t, c in (
    ("orders", "o_orderkey"), ("orders", "o_custkey"), ("part", "p_name"), ("nation", "n_nationkey"))])


def _outside(t: str, c: str, values: str) -> tuple[str, str, str, str]:
    return "accepted_values", t, c, f"SELECT count(*) FROM {t} WHERE {c} NOT IN ({values})"


_SQL["dq_accepted_values"] = _checks([
    _outside("trips", "hvfhs_license_num", "'HV0002', 'HV0003', 'HV0005'"),
    _outside("trips", "shared_request_flag", "'Y', 'N'"),
    _outside("trips", "shared_match_flag", "'Y', 'N'"),
    _outside("lineitem", "l_returnflag", "'A', 'N'"),
    _outside("lineitem", "l_linestatus", "'O', 'F'")], _TRIPS)


def _orphans(child: str, c: str, parent: str, p: str) -> tuple[str, str, str, str]:
    return "relationships", child, c, (
        f"SELECT count(*) FROM {child} WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} WHERE {p} = {c})")


_SQL["dq_relationships"] = _checks([
    _orphans("lineitem", "l_partkey", "part", "p_partkey"),
    _orphans("lineitem", "l_orderkey", "orders", "o_orderkey"),
    _orphans("orders", "o_orderkey", "lineitem", "l_orderkey"),
    _orphans("customer", "c_custkey", "events", "user_id")])

_SQL["dq_unique_combination"] = _checks([
    ("unique_combination", "lineitem", "l_orderkey,l_linenumber",
     "SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"),
    ("unique_combination", "did_panel", "trip_date,location_id",
     "SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY trip_date, location_id HAVING count(*) > 1)")], _PANEL)


def _same(a: str, b: str) -> str:
    return f"SELECT (({a}) IS DISTINCT FROM ({b}))::INTEGER"


_SQL["dq_reconcile"] = _checks([
    ("mart_total", "daily_summary", "trip_count", _same("SELECT count(*) FROM enriched",
                                                        "SELECT count(*) FROM scoped")),
    ("same_grain", "fct_trips", "*", _same("SELECT count(*) FROM enriched", "SELECT count(*) FROM scoped")),
    ("mart_total", "user_rfm", "monetary_proxy_items",
     _same("SELECT count(*) FROM items WHERE source_eval_set = 'prior'",
           "SELECT count(*) FROM items WHERE source_eval_set = 'prior'"))],
    f"{_ENRICHED}, {_ITEMS}")

_SQL["dq_partition_identity"] = _checks([
    ("partition_identity", "orders", "eval_set",
     "SELECT abs(count(DISTINCT user_id) FILTER (eval_set = 'train') + count(DISTINCT user_id) "
     f"FILTER (eval_set = '{other}') - count(DISTINCT user_id)) FROM ords") for other in ("test", "prior")], _ORDERS)

_SQL["dq_threshold"] = _checks([
    ("threshold", "trips", "trip_time", "SELECT count(*) FROM trips WHERE trip_time <= 0"),
    ("threshold", "trips", "trip_miles", "SELECT count(*) FROM trips WHERE trip_miles > 30"),
    ("threshold", "trips", "base_passenger_fare", "SELECT count(*) FROM trips WHERE base_passenger_fare < 0")],
    _TRIPS, error_above=20)
