"""Log reports and alerts."""

import datetime as dt

from tidemark.operators import alerts as al, monitoring as m
from tidemark.plans.registry import plain, query
from tidemark.plans.sqlbase import d, r, using
from tidemark.sources.bindings import AS_OF_LOG, AS_OF_MARKET

MARKET_CLOCK = dt.datetime.combine(AS_OF_MARKET, dt.time())
BACK30 = f"start_time >= DATE '{AS_OF_LOG.date()}' - 30"
YEAR = f"start_time >= DATE '{AS_OF_LOG.date()}' - INTERVAL 12 MONTH"
OWN = "warehouse_name LIKE 'INV_%'"
RECENT = f"{OWN} AND {BACK30}"
GB, TB = "1073741824.0::DOUBLE", "1099511627776.0::DOUBLE"


def _sum(c: str, name: str) -> str:
    return d(f"sum({c})", name)


def _cost(c: str, digits: int = 2, name: str = "estimated_cost_usd") -> str:
    return d(f"ROUND({c} * 3, {digits})", name)


def _sec(c: str, name: str) -> str:
    return d(f"ROUND(CAST({c} AS DECIMAL(18,0)) * CAST(0.001 AS DECIMAL(4,3)), 2)", name)


def _rr(num: str, den: str, digits: int, name: str) -> str:
    """num / den, scaled before rounding so that ties are exact."""
    return f"ROUND(CAST({num} AS DOUBLE) * {10 ** digits} / NULLIF(CAST({den} AS DOUBLE), 0)) / {10 ** digits}.0::DOUBLE AS {name}"


def _avg_sec(name: str) -> str:
    return _rr("sum(total_elapsed_time)", "count(*) * 1000", 2, name)


@query("mon_daily_credits", using("metering") + f"""SELECT date_trunc('day', start_time) AS usage_date, warehouse_name,
    {_sum('credits_used', 'total_credits')}, {_sum('credits_used_compute', 'compute_credits')},
    {_sum('credits_used_cloud_services', 'cloud_services_credits')}, count(*) AS query_count, {_cost('sum(credits_used)')}
    FROM metering WHERE {RECENT} GROUP BY 1, 2""")
def _(t):
    return plain(m.daily_credits(t.metering(), AS_OF_LOG))


@query("mon_monthly_credits", using("metering") + f"""SELECT CAST(date_trunc('month', start_time) AS TIMESTAMP) AS usage_month,
    warehouse_name, {_sum('credits_used', 'total_credits')}, {_cost('sum(credits_used)')}
    FROM metering WHERE {OWN} AND {YEAR} GROUP BY 1, 2""")
def _(t):
    return plain(m.monthly_credits(t.metering(), AS_OF_LOG))


@query("mon_credits_by_user", using("qh") + f"""SELECT user_name, count(DISTINCT query_id) AS total_queries,
    {_sum('credits_used_cloud_services', 'total_credits')}, {_avg_sec('avg_query_seconds')},
    {_cost('sum(credits_used_cloud_services)')} FROM qh WHERE {RECENT} GROUP BY user_name""")
def _(t):
    return plain(m.credits_by_user(t.query_history(), AS_OF_LOG))


@query("mon_credits_by_role", using("qh") + f"""SELECT role_name, count(DISTINCT user_name) AS unique_users,
    count(DISTINCT query_id) AS total_queries, {_sum('credits_used_cloud_services', 'total_credits')},
    {_cost('sum(credits_used_cloud_services)')} FROM qh WHERE role_name LIKE 'INV_%' AND {BACK30} GROUP BY role_name""")
def _(t):
    return plain(m.credits_by_role(t.query_history(), AS_OF_LOG))


@query("mon_top_expensive_queries", using("qh") + f"""SELECT query_id, substr(query_text, 1, 200) AS query_preview, user_name,
    role_name, warehouse_name, database_name, execution_status, start_time,
    CAST(total_elapsed_time AS DOUBLE) / 1000.0::DOUBLE AS elapsed_seconds, CAST(bytes_scanned AS DOUBLE) / {GB} AS gb_scanned,
    {d('credits_used_cloud_services', 'credits_used')}, {_cost('credits_used_cloud_services', 4)}
    FROM qh WHERE {RECENT} AND credits_used_cloud_services > 0
    ORDER BY credits_used_cloud_services DESC, query_id LIMIT 100""")
def _(t):
    return plain(m.top_expensive_queries(t.query_history(), AS_OF_LOG))


def _tb(c: str, name: str, digits: int = 4, more: str = "") -> str:
    return r(f"CAST({c} AS DOUBLE) / {TB}{more}", digits, name)


ALL_BYTES = "(storage_bytes + stage_bytes + failsafe_bytes)"


@query("mon_storage_consumption", using("storage_usage") + f"""SELECT usage_date, {_tb('storage_bytes', 'database_storage_tb')},
    {_tb('stage_bytes', 'stage_storage_tb')}, {_tb('failsafe_bytes', 'failsafe_storage_tb')},
    {_tb(ALL_BYTES, 'total_storage_tb')}, {_tb(ALL_BYTES, 'estimated_monthly_cost_usd', 2, ' * 23')}
    FROM storage_usage WHERE usage_date >= DATE '{AS_OF_LOG.date()}' - INTERVAL 6 MONTH""")
def _(t):
    return plain(m.storage_consumption(t.storage_usage(), AS_OF_LOG))


QUOTA = f"""SELECT name AS monitor_name, credit_quota, used_credits, remaining_credits,
    {_rr('used_credits * 100', 'credit_quota', 2, 'usage_percent')}, '75' AS notify_at_percent,
    '90' AS suspend_at_percent, '100' AS suspend_immediate_at_percent, warehouses, created
    FROM monitors WHERE name LIKE 'INV_%'"""


@query("mon_quota_status", using("monitors") + QUOTA)
def _(t):
    return m.quota_status(t.resource_monitors())


@query("mon_query_performance", using("qh") + f"""SELECT query_id, substr(query_text, 1, 500) AS query_preview, user_name, role_name,
    warehouse_name, warehouse_size, database_name, schema_name, query_type, execution_status, start_time, end_time,
    {_sec('total_elapsed_time', 'execution_seconds')}, {_sec('compilation_time', 'compile_seconds')},
    {_sec('queued_overload_time', 'queue_seconds')}, bytes_scanned,
    {r(f'CAST(bytes_scanned AS DOUBLE) / {GB}', 4, 'gb_scanned')}, rows_produced, partitions_scanned, partitions_total,
    {_rr('partitions_scanned * 100', 'partitions_total', 2, 'partition_scan_pct')},
    {d('credits_used_cloud_services', 'credits_used')} FROM qh WHERE {RECENT}""")
def _(t):
    return plain(m.query_performance(t.query_history(), AS_OF_LOG))


LONG = f"""SELECT query_id, substr(query_text, 1, 300) AS query_preview, user_name, role_name, warehouse_name, warehouse_size,
    database_name, query_type, execution_status, start_time, end_time, {_sec('total_elapsed_time', 'execution_seconds')},
    {_rr('total_elapsed_time', '60000', 2, 'execution_minutes')}, bytes_scanned,
    {r(f'CAST(bytes_scanned AS DOUBLE) / {GB}', 2, 'gb_scanned')}, rows_produced, partitions_scanned
    FROM qh WHERE {RECENT} AND total_elapsed_time > 300000"""


@query("mon_long_running", using("qh") + LONG)
def _(t):
    return m.long_running(t.query_history(), AS_OF_LOG)


@query("mon_failed", using("qh") + f"""SELECT query_id, substr(query_text, 1, 300) AS query_preview, user_name, role_name,
    warehouse_name, database_name, schema_name, query_type, execution_status, error_code, error_message, start_time,
    {_sec('total_elapsed_time', 'execution_seconds')} FROM qh WHERE {RECENT} AND execution_status = 'FAIL'""")
def _(t):
    return m.failed(t.query_history(), AS_OF_LOG)


@query("mon_utilization", using("load") + f"""SELECT warehouse_name, start_time, end_time,
    {d('ROUND(avg_running, 2)', 'avg_queries_running')}, {d('ROUND(avg_queued_load, 2)', 'avg_queries_queued')},
    {d('ROUND(avg_queued_provisioning, 2)', 'avg_queries_provisioning')}, {d('ROUND(avg_blocked, 2)', 'avg_queries_blocked')},
    {d('ROUND(avg_running + avg_queued_load, 2)', 'total_load')},
    CASE WHEN avg_queued_load > 5 THEN 'HIGH_QUEUE' WHEN avg_running > 10 THEN 'HIGH_LOAD'
         WHEN avg_blocked > 0 THEN 'BLOCKED' ELSE 'NORMAL' END AS load_status,
    date_trunc('hour', start_time) AS hour_bucket FROM load WHERE {RECENT}""")
def _(t):
    return plain(m.utilization(t.warehouse_load(), AS_OF_LOG))


LOAD_MEASURES = f"""count(*) AS sample_count, {_rr('sum(avg_running) * 10000', 'count(*) * 10000', 2, 'avg_queries_running')},
    {_rr('sum(avg_queued_load) * 10000', 'count(*) * 10000', 2, 'avg_queries_queued')}, {_rr('sum(avg_blocked) * 10000', 'count(*) * 10000', 2, 'avg_queries_blocked')},
    {d('ROUND(max(avg_running), 2)', 'peak_queries_running')}, {d('ROUND(max(avg_queued_load), 2)', 'peak_queries_queued')},
    min(start_time) AS period_start, max(end_time) AS period_end"""
ACTIVE = f"""SELECT warehouse_name, {LOAD_MEASURES} FROM load WHERE {OWN}
    AND start_time >= TIMESTAMP '{AS_OF_LOG}' - INTERVAL 24 HOUR GROUP BY warehouse_name"""


@query("mon_active_load", using("load") + ACTIVE)
def _(t):
    return plain(m.active_load(t.warehouse_load(), AS_OF_LOG))


BOTH = "(sum(credits_used) + sum(credits_used_cloud_services))"
MONTHLY = f"""SELECT warehouse_name, CAST(date_trunc('month', start_time) AS TIMESTAMP) AS usage_month,
    {d('ROUND(sum(credits_used), 4)', 'compute_credits')},
    {d('ROUND(sum(credits_used_cloud_services), 4)', 'cloud_services_credits')}, {d(f'ROUND({BOTH}, 4)', 'total_credits')},
    count(DISTINCT date_trunc('day', start_time)) AS active_days,
    {_rr(BOTH + ' * 1000', "count(DISTINCT date_trunc('day', start_time)) * 1000", 4, 'avg_credits_per_day')},
    {_cost(BOTH)} FROM metering WHERE {OWN} AND {YEAR} GROUP BY 1, 2"""


@query("mon_cost_by_month", using("metering") + MONTHLY)
def _(t):
    return plain(m.cost_by_month(t.metering(), AS_OF_LOG))


@query("mon_login_history", using("logins") + f"""SELECT user_name, reported_client_type AS client_type,
    first_authentication_factor AS auth_factor_1, second_authentication_factor AS auth_factor_2, is_success, error_code,
    error_message, event_timestamp AS login_time, client_ip, connection AS connection_name FROM logins
    WHERE event_timestamp >= DATE '{AS_OF_LOG.date()}' - 30""")
def _(t):
    return m.login_history(t.logins(), AS_OF_LOG)


@query("mon_data_transfer", using("transfers") + f"""SELECT date_trunc('day', start_time) AS transfer_date, source_cloud,
    source_region, target_cloud, target_region, transfer_type,
    {r(f'CAST(sum(bytes_transferred) AS DOUBLE) / {GB}', 4, 'gb_transferred')},
    {r(f'CAST(sum(bytes_transferred) AS DOUBLE) / {TB}', 6, 'tb_transferred')}
    FROM transfers WHERE start_time >= DATE '{AS_OF_MARKET}' - 1000 GROUP BY 1, 2, 3, 4, 5, 6""")
def _(t):
    return m.data_transfer(t.data_transfers(), MARKET_CLOCK, days=1000)


@query("mon_query_type_summary", using("qh") + f"""SELECT query_type, warehouse_name, count(*) AS query_count,
    CAST(ROUND(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY warehouse_name), 2) AS DOUBLE) AS pct_of_warehouse,
    {_sum('credits_used_cloud_services', 'total_credits')}, {_avg_sec('avg_execution_seconds')},
    {r(f'CAST(sum(bytes_scanned) AS DOUBLE) / {TB}', 4, 'tb_scanned')} FROM qh WHERE {RECENT} GROUP BY 1, 2""")
def _(t):
    return plain(m.query_type_summary(t.query_history(), AS_OF_LOG))


SIZE, SAFE = "CAST(sum(average_database_bytes) AS DOUBLE)", "CAST(sum(average_failsafe_bytes) AS DOUBLE)"


@query("mon_database_storage", using("database_storage") + f"""SELECT database_name, {r(f'{SIZE} / {GB}', 4, 'database_size_gb')},
    {r(f'{SAFE} / {GB}', 4, 'failsafe_size_gb')}, {r(f'({SIZE} + {SAFE}) / {GB}', 4, 'total_size_gb')},
    {r(f'({SIZE} + {SAFE}) / {GB} * 23 / 30', 2, 'estimated_daily_cost_usd')} FROM database_storage
    WHERE usage_date = (SELECT max(usage_date) FROM database_storage) AND database_name LIKE 'INV_%' GROUP BY 1""")
def _(t):
    return m.database_storage(t.database_storage())


@query("mon_usage_7d", using("qh") + f"""SELECT warehouse_name, count(*) AS query_count,
    {_sum('credits_used_cloud_services', 'total_credits')}, {_avg_sec('avg_query_seconds')},
    max(start_time) AS last_query_time FROM qh WHERE {OWN} AND start_time >= DATE '{AS_OF_LOG.date()}' - 7 GROUP BY 1""")
def _(t):
    return plain(m.usage_7d(t.query_history(), AS_OF_LOG))


# --- alerts ---------------------------------------------------------------------------------------

# the last quarter of an hour of the log is nearly empty, so query alerts are also read at a busier moment
BUSY = dt.datetime(2024, 1, 20, 12, 0)


def _alert(name: str, severity: str, fired: str, as_of: dt.datetime = AS_OF_LOG) -> str:
    return (f"SELECT '{name}' AS alert, '{severity}' AS severity, coalesce({fired}, FALSE) AS fired, "
            f"TIMESTAMP '{as_of}' AS as_of ")


@query("alert_quota_critical", using("monitors", q=QUOTA) + _alert("quota_critical", "CRITICAL", "bool_or(usage_percent >= 90)") + "FROM q")
def _(t):
    return al.quota_critical(t.resource_monitors(), AS_OF_LOG)


@query("alert_long_running", using("qh") + _alert("long_running", "WARNING", "count(*) > 0")
       + f"FROM qh WHERE {RECENT} AND total_elapsed_time > 300000 AND start_time >= TIMESTAMP '{AS_OF_LOG}' - INTERVAL 15 MINUTE")
def _(t):
    return al.long_running(t.query_history(), AS_OF_LOG)


@query("alert_failed_spike", using("qh") + _alert("failed_spike", "WARNING", "count(*) > 10", BUSY)
       + f"""FROM qh WHERE {OWN} AND execution_status = 'FAIL' AND start_time >= DATE '{BUSY.date()}' - 30
       AND start_time >= TIMESTAMP '{BUSY}' - INTERVAL 15 MINUTE""")
def _(t):
    return al.failed_spike(t.query_history(), BUSY)


@query("alert_high_queue", using("load", a=ACTIVE) + _alert("high_queue", "WARNING", "bool_or(avg_queries_queued > 5)") + "FROM a")
def _(t):
    return al.high_queue(t.warehouse_load(), AS_OF_LOG)


@query("alert_cost_spike", using("metering", c=MONTHLY) + _alert(
    "cost_spike", "CRITICAL",
    f"sum(CASE WHEN usage_month = date_trunc('month', DATE '{AS_OF_LOG.date()}') THEN total_credits ELSE 0 END) > 1.2 * "
    f"sum(CASE WHEN usage_month = date_trunc('month', DATE '{AS_OF_LOG.date()}' - INTERVAL 1 MONTH) THEN total_credits ELSE 0 END) "
    f"AND sum(CASE WHEN usage_month = date_trunc('month', DATE '{AS_OF_LOG.date()}' - INTERVAL 1 MONTH) THEN total_credits ELSE 0 END) > 0")
    + "FROM c")
def _(t):
    return al.cost_spike(t.metering(), AS_OF_LOG)
