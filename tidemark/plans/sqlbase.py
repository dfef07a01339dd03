"""SQL for the canonical inputs, matching ``sources/bindings.py`` expression by expression."""

from __future__ import annotations

from tidemark.sources import bindings as b


def r(expr: str, digits: int, name: str) -> str:
    """Rounded output column (adding zero turns -0.0 into 0.0)."""
    return f"ROUND(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def d(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS DOUBLE) AS {name or expr}"


def single(expr: str, name: str) -> str:
    """Output column cut to single precision."""
    return f"CAST(CAST({expr} AS FLOAT) AS DOUBLE) AS {name}"


def pick(values: list, n: str) -> str:
    quoted = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    size = len(values)
    return f"([{quoted}])[CAST(((({n}) % {size}) + {size}) % {size} AS INTEGER) + 1]"


def _values(rows: list[tuple]) -> str:
    cells = [", ".join("NULL" if v is None else f"'{v}'" for v in row) for row in rows]
    return "VALUES " + ", ".join(f"({c})" for c in cells)


NAV_W = "PARTITION BY portfolio_id ORDER BY as_of_date"
LAST60 = f"({NAV_W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


def _ohlc(source: str) -> str:
    order = "ORDER BY order_id, line_no, portfolio_id, price"
    return f"""SELECT security_id, trade_date, first(price {order}) AS open_price, max(price) AS high_price,
        min(price) AS low_price, last(price {order}) AS close_price, CAST(sum(quantity) AS BIGINT) AS volume,
        CAST(sum(gross) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE) AS vwap
        FROM {source} GROUP BY security_id, trade_date"""


def _cost(source: str, extra: str) -> str:
    return f"""SELECT h.security_id, h.portfolio_id, h.trade_date AS as_of_date, h.quantity, h.market_value,
        h.benchmark_value{extra}, h.quantity * CAST(p_retailprice AS DECIMAL(12,2)) AS cost_basis
        FROM {source} h JOIN part ON p_partkey = h.security_id"""


def _period_open(unit: str) -> str:
    return (f"CASE WHEN date_trunc('{unit}', lag(as_of_date) OVER ({NAV_W})) <> date_trunc('{unit}', as_of_date) "
            f"THEN lag(nav_per_share) OVER ({NAV_W}) END")


_LOTS = """sum(quantity) AS quantity, sum(net) AS market_value, sum(gross) AS benchmark_value"""
_TAG_VALUE = "CASE p_partkey % 8 " + " ".join(
    f"WHEN {i} THEN {pick(b.TAG_VALUES[t], 'p_size')}" for i, t in enumerate(b.TAG_NAMES)) + " END"

# name -> (inputs, SQL)
CTES: dict[str, tuple[list[str], str]] = {
    "trades": ([], """SELECT l_suppkey AS portfolio_id, l_partkey AS security_id, CAST(l_shipdate AS DATE) AS trade_date,
        l_orderkey AS order_id, l_linenumber AS line_no, CAST(l_quantity AS BIGINT) AS quantity,
        l_extendedprice / l_quantity AS price, CAST(l_extendedprice AS DECIMAL(12,2)) AS gross,
        CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS net,
        CAST(l_tax AS DECIMAL(4,2)) AS fee_rate, l_returnflag AS flag FROM lineitem"""),
    "prices": (["trades"], _ohlc("trades")),
    "brand_trades": (["trades"], "SELECT t.* REPLACE (p_brand AS security_id) FROM trades t JOIN part ON p_partkey = t.security_id"),
    "brand_prices": (["brand_trades"], _ohlc("brand_trades")),
    "nav_day": (["trades"], """SELECT portfolio_id, trade_date AS as_of_date, sum(net) AS total_nav,
        CAST(sum(quantity) AS BIGINT) AS shares_outstanding FROM trades GROUP BY ALL"""),
    "nav": (["nav_day"], """SELECT n.*, CAST(total_nav AS DOUBLE) / CAST(shares_outstanding AS DOUBLE) AS nav_per_share,
        benchmark_nav FROM nav_day n JOIN (SELECT as_of_date, CAST(sum(total_nav) AS DOUBLE) /
        CAST(sum(shares_outstanding) AS DOUBLE) AS benchmark_nav FROM nav_day GROUP BY as_of_date) USING (as_of_date)"""),
    "nav_r": (["nav"], f"""SELECT *, nav_per_share / lag(nav_per_share) OVER ({NAV_W}) - 1.0 AS daily_return,
        benchmark_nav / lag(benchmark_nav) OVER ({NAV_W}) - 1.0 AS benchmark_return,
        {_period_open('month')} AS mo, {_period_open('quarter')} AS qo, {_period_open('year')} AS yo FROM nav"""),
    "nav_history": (["nav_r"], f"""SELECT portfolio_id, as_of_date, total_nav, shares_outstanding, nav_per_share, benchmark_nav,
        daily_return, benchmark_return,
        nav_per_share / last_value(mo IGNORE NULLS) OVER ({NAV_W} ROWS UNBOUNDED PRECEDING) - 1.0 AS mtd_return,
        nav_per_share / last_value(qo IGNORE NULLS) OVER ({NAV_W} ROWS UNBOUNDED PRECEDING) - 1.0 AS qtd_return,
        nav_per_share / last_value(yo IGNORE NULLS) OVER ({NAV_W} ROWS UNBOUNDED PRECEDING) - 1.0 AS ytd_return,
        covar_samp(daily_return, benchmark_return) OVER {LAST60} / var_samp(benchmark_return) OVER {LAST60} AS beta,
        avg(daily_return) OVER {LAST60} - covar_samp(daily_return, benchmark_return) OVER {LAST60}
          / var_samp(benchmark_return) OVER {LAST60} * avg(benchmark_return) OVER {LAST60} AS alpha FROM nav_r"""),
    "lots": (["trades"], f"SELECT trade_date, portfolio_id, security_id, {_LOTS} FROM trades GROUP BY ALL"),
    "positions": (["lots"], _cost("lots", "")),
    "dated_lots": (["trades"], f"""SELECT trade_date, portfolio_id, security_id, {_LOTS},
        1 + max(abs(date_diff('day', CAST(o_orderdate AS DATE), trade_date))) AS holding_period_days
        FROM trades JOIN orders ON o_orderkey = order_id GROUP BY ALL"""),
    "holdings": (["dated_lots"], _cost("dated_lots", ", h.holding_period_days")),
    "held": (["holdings"], """SELECT *, market_value - cost_basis AS unrealized_pnl,
        (CAST(market_value AS DOUBLE) / CAST(cost_basis AS DOUBLE) - 1.0) * 100.0 AS gain_loss_pct,
        (CAST(market_value AS DOUBLE) / CAST(cost_basis AS DOUBLE) - 1.0) * 100.0
          * (365.0::DOUBLE / CAST(holding_period_days AS DOUBLE)) AS annualized_return,
        CAST(market_value AS DOUBLE) / CAST(sum(market_value) OVER (PARTITION BY portfolio_id, as_of_date) AS DOUBLE)
          AS weight_pct FROM holdings"""),
    "weighed": (["positions"], """SELECT *, market_value - cost_basis AS unrealized_pnl,
        CAST(market_value AS DOUBLE) / CAST(sum(market_value) OVER (PARTITION BY portfolio_id, as_of_date) AS DOUBLE)
          AS weight_pct FROM positions"""),
    "dim_security": ([], f"""SELECT p_partkey AS security_id, p_name AS security_name, p_brand AS ticker,
        p_type AS security_type, p_type AS sector, 'IND-' || CAST(p_size // 10 AS VARCHAR) AS industry, 'USA' AS country,
        CASE WHEN p_type LIKE '%PROMO%' THEN 'FIXED_INCOME'
             WHEN p_type LIKE '%ECONOMY%' OR p_type LIKE '%LARGE%' THEN 'INTERNATIONAL_EQUITY' ELSE 'EQUITY' END AS asset_class,
        {pick(["SPX", "NDX", "RUT"], "p_partkey")} AS benchmark_index,
        CAST(p_size AS DECIMAL(8,4)) * 0.01 AS expense_ratio,
        {pick(["LOW", "LOW-MEDIUM", "MEDIUM", "MEDIUM-HIGH", "HIGH"], "p_partkey")} AS risk_rating,
        TRUE AS is_current FROM part"""),
    "dim_portfolio": ([], """SELECT s_suppkey AS portfolio_id, s_name AS portfolio_name, r_name AS portfolio_type,
        n_name AS strategy, 'MGR-' || CAST(s_suppkey % 10 AS VARCHAR) AS fund_manager,
        (s_suppkey % 8) * 0.25 AS management_fee, (s_suppkey % 6) * 0.25 AS expense_ratio,
        s_acctbal >= 0 AS is_active FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""),
    "transactions": (["trades"], """SELECT order_id, line_no, trade_date, portfolio_id, security_id, quantity,
        CASE WHEN flag = 'R' THEN 'SELL' ELSE 'BUY' END AS transaction_type,
        gross AS gross_amount, gross * fee_rate AS commission, gross * CAST(0.001 AS DECIMAL(4,3)) AS fees FROM trades"""),
    "clients": ([], f"""SELECT c_custkey AS client_id, c_name AS client_name,
        lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS account_number, CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
        '555-01' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS phone, c_acctbal AS balance,
        CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'INSTITUTIONAL' WHEN c_mktsegment = 'HOUSEHOLD'
             THEN 'RETAIL' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'OTHER' END AS client_tier,
        {pick(b.TAG_VALUES["DATA_QUALITY_STATUS"] + [None], "c_custkey")} AS dq_status FROM customer"""),
    "ev": ([], "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "qh": (["ev"], f"""SELECT event_id AS query_id,
        {pick(b.STATEMENTS, "event_id")} || ' -- ' || CAST(event_id AS VARCHAR) AS query_text,
        'U' || CAST(user_id AS VARCHAR) AS user_name, {pick(b.ROLES, "user_id")} AS role_name,
        {pick(b.WAREHOUSES, "event_id")} AS warehouse_name, {pick(b.SIZES, "event_id")} AS warehouse_size,
        {pick(b.DATABASES, "k")} AS database_name, {pick(b.SCHEMAS, "k // 6")} AS schema_name,
        {pick(b.QUERY_TYPES, "event_id // 14")} AS query_type,
        CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'SUCCESS' END AS execution_status,
        CASE WHEN event_type = 'error' THEN k + 1000 END AS error_code,
        CASE WHEN event_type = 'error' THEN 'code ' || CAST(k AS VARCHAR) END AS error_message,
        ts AS start_time, CAST(CAST(value AS DECIMAL(12,2)) * 1000 AS BIGINT) AS total_elapsed_time,
        ts + to_milliseconds(CAST(CAST(value AS DECIMAL(12,2)) * 1000 AS BIGINT)) AS end_time,
        CAST(CAST(value AS DECIMAL(12,2)) * 1000 AS BIGINT) // 10 AS compilation_time, k * 10 AS queued_overload_time,
        k * 1073741824 AS bytes_scanned, k * 200 AS rows_produced, k AS partitions_scanned,
        k + (event_id % 3) * 50 AS partitions_total,
        CAST(k AS DECIMAL(6,0)) * CAST(0.001 AS DECIMAL(4,3)) AS credits_used_cloud_services FROM ev"""),
    "metering": (["qh"], """SELECT date_trunc('hour', start_time) AS start_time, warehouse_name,
        sum(credits_used_cloud_services) * 10 AS credits_used_compute,
        sum(credits_used_cloud_services) AS credits_used_cloud_services,
        sum(credits_used_cloud_services) * 11 AS credits_used FROM qh GROUP BY 1, 2"""),
    "load": (["qh"], """SELECT warehouse_name, date_trunc('hour', start_time) AS start_time,
        date_trunc('hour', start_time) + INTERVAL 1 HOUR AS end_time,
        CAST(sum(total_elapsed_time) AS DECIMAL(14,0)) * CAST(0.0001 AS DECIMAL(4,4)) AS avg_running,
        CAST(sum(queued_overload_time) AS DECIMAL(14,0)) * CAST(0.005 AS DECIMAL(4,4)) AS avg_queued_load,
        CAST(count(*) AS DECIMAL(14,0)) * CAST(0.25 AS DECIMAL(4,4)) AS avg_queued_provisioning,
        CAST(count(*) FILTER (execution_status = 'FAIL') AS DECIMAL(14,0)) * CAST(0.125 AS DECIMAL(4,4)) AS avg_blocked
        FROM qh GROUP BY 1, 2, 3"""),
    "logins": (["ev"], f"""SELECT event_id, ts AS event_timestamp, 'U' || CAST(user_id AS VARCHAR) AS user_name,
        CASE WHEN k < 30 THEN '10.0.0.' || CAST(k AS VARCHAR) WHEN k < 60 THEN '192.168.1.' || CAST(k AS VARCHAR)
             ELSE '52.1.1.' || CAST(k AS VARCHAR) END AS client_ip,
        {pick(["JDBC", "ODBC", "WEB"], "event_id")} AS reported_client_type,
        '3.' || CAST(event_id % 5 AS VARCHAR) AS reported_client_version,
        {pick(["PASSWORD", "RSA"], "k")} AS first_authentication_factor,
        CASE WHEN k % 3 = 0 THEN 'MFA' END AS second_authentication_factor,
        CASE WHEN event_type = 'error' THEN 'NO' ELSE 'YES' END AS is_success,
        CASE WHEN event_type = 'error' THEN k + 2000 END AS error_code,
        CASE WHEN event_type = 'error' THEN 'bad login' END AS error_message,
        'conn' || CAST(event_id % 4 AS VARCHAR) AS connection FROM ev WHERE event_type IN ('signup', 'error')"""),
    "sessions": (["ev"], f"""SELECT CAST(user_id AS VARCHAR) || '/' || CAST(d AS VARCHAR) AS session_id,
        'U' || CAST(user_id AS VARCHAR) AS user_name, created_on, user_id % 2 = 0 AS is_open,
        CASE WHEN user_id % 2 = 1 THEN 'LOGOUT' END AS closed_reason,
        {pick(["JDBC", "WEB", "PYTHON"], "k")} AS client_application_id, 'v' || CAST(k % 7 AS VARCHAR) AS client_application_version,
        {pick(["PROD", "DEV"], "k")} AS client_environment,
        {pick(["PASSWORD", "PASSWORD_MFA", "MULTI_FACTOR", None], "k")} AS authentication_method
        FROM (SELECT user_id, CAST(ts AS DATE) AS d, min(ts) AS created_on, min(k) AS k FROM ev GROUP BY 1, 2)"""),
    "grants_to_users": (["ev"], f"""SELECT ts AS created_on, {pick(b.GRANT_NAMES, "k")} AS role,
        'U' || CAST(user_id AS VARCHAR) AS grantee_name, 'U' || CAST(event_id % 50 AS VARCHAR) AS granted_by,
        CASE WHEN event_id % 9 = 0 THEN ts END AS deleted_on FROM ev WHERE event_type = 'signup'"""),
    "grants_to_roles": (["ev"], f"""SELECT ts AS created_on, {pick(b.PRIVILEGES, "k")} AS privilege,
        CASE WHEN event_id % 2 = 0 THEN 'ROLE' ELSE 'TABLE' END AS granted_on, {pick(b.GRANT_NAMES, "k // 7")} AS name,
        {pick(b.ROLES + ["SYSADMIN"], "user_id")} AS grantee_name, 'U' || CAST(event_id % 50 AS VARCHAR) AS granted_by,
        CASE WHEN event_id % 9 = 0 THEN ts END AS deleted_on FROM ev WHERE event_type IN ('purchase', 'view')"""),
    "tr": ([], f"""SELECT 'INV_GOVERNANCE_DB' AS tag_database, 'TAGS' AS tag_schema, * FROM ({_values(b.GOVERNED)})
        AS t(object_database, object_schema, object_name, column_name, tag_name, tag_value)"""),
    "cat_tables": ([], f"""SELECT {pick(b.DATABASES, "p_partkey")} AS table_catalog, {pick(b.SCHEMAS, "p_size")} AS table_schema,
        'T_' || CAST(p_partkey AS VARCHAR) AS table_name,
        TIMESTAMP '{b.AS_OF_LOG}' - to_days(CAST(p_partkey % 4000 AS INTEGER)) AS created,
        CAST(p_size AS BIGINT) * 1000 AS row_count, CAST(p_size AS BIGINT) * 1073741824 AS bytes,
        CASE WHEN p_partkey % 11 = 0 THEN TIMESTAMP '{b.AS_OF_LOG}' END AS deleted FROM part"""),
    "tag_refs": ([], f"""SELECT {pick(b.DATABASES, "p_partkey")} AS object_database, {pick(b.SCHEMAS, "p_size")} AS object_schema,
        'T_' || CAST(p_partkey AS VARCHAR) AS object_name, 'C_' || CAST(p_size AS VARCHAR) AS column_name,
        'INV_GOVERNANCE_DB' AS tag_database, 'TAGS' AS tag_schema, {pick(b.TAG_NAMES, "p_partkey")} AS tag_name,
        {_TAG_VALUE} AS tag_value FROM part"""),
    "policy_refs": ([], f"""SELECT {pick(b.POLICIES + ["MASK_OLD"], "p_partkey")} AS policy_name,
        'INV_GOVERNANCE_DB' AS policy_db, 'POLICIES' AS policy_schema,
        CASE WHEN p_partkey % 7 IN (4, 5) THEN 'ROW_ACCESS_POLICY' ELSE 'MASKING_POLICY' END AS policy_kind,
        {pick(b.DATABASES, "p_size")} AS ref_database_name, {pick(b.SCHEMAS, "p_size")} AS ref_schema_name,
        'T_' || CAST(p_partkey AS VARCHAR) AS ref_entity_name, 'C_' || CAST(p_size AS VARCHAR) AS ref_column_name,
        'TABLE' AS ref_entity_domain FROM part"""),
    "policies": ([], f"""SELECT policy_name, 'INV_GOVERNANCE_DB' AS policy_catalog, 'POLICIES' AS policy_schema,
        CASE WHEN policy_name = 'MASK_OLD' THEN 'SYSADMIN' ELSE 'SECURITYADMIN' END AS policy_owner,
        TIMESTAMP '2023-01-01 00:00:00' AS created,
        CASE WHEN policy_name = 'MASK_OLD' THEN TIMESTAMP '{b.AS_OF_LOG}' END AS deleted
        FROM ({_values([(p,) for p in b.POLICIES + ["MASK_OLD"]])}) AS t(policy_name)"""),
    "monitors": ([], f"""SELECT {pick(["INV_MON_", "INVXMON_", "OTHER_"], "s_suppkey")} || CAST(s_suppkey AS VARCHAR) AS name,
        (s_suppkey % 6) * 1000 AS credit_quota, CAST(floor(abs(s_acctbal) / 2) AS BIGINT) AS used_credits,
        (s_suppkey % 6) * 1000 - CAST(floor(abs(s_acctbal) / 2) AS BIGINT) AS remaining_credits,
        {pick(b.WAREHOUSES, "s_suppkey")} AS warehouses, TIMESTAMP '2023-01-01 00:00:00' AS created FROM supplier"""),
    "storage_usage": ([], f"""SELECT DATE '{b.AS_OF_LOG.date()}' - CAST(doc_id % 250 AS INTEGER) AS usage_date,
        sum(n_chars) * 1000000 AS storage_bytes, max(n_chars) * 1000000 AS stage_bytes,
        min(n_chars) * 1000000 AS failsafe_bytes FROM documents GROUP BY 1"""),
    "database_storage": ([], f"""SELECT DATE '{b.AS_OF_LOG.date()}' - CAST(doc_id % 5 AS INTEGER) AS usage_date,
        {pick(["INV_", "LAB_"], "length(source)")} || source AS database_name, sum(n_chars) * 1000 AS average_database_bytes,
        max(n_chars) * 1000 AS average_failsafe_bytes FROM documents GROUP BY 1, 2"""),
    "transfers": ([], """SELECT l_shipdate AS start_time, 'AWS' AS source_cloud, sr.r_name AS source_region,
        'AZURE' AS target_cloud, dr.r_name AS target_region,
        CASE WHEN l_returnflag = 'R' THEN 'REPLICATION' ELSE 'COPY' END AS transfer_type,
        CAST(l_quantity AS BIGINT) * 1073741824 AS bytes_transferred
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
        JOIN customer ON c_custkey = o_custkey JOIN nation sn ON sn.n_nationkey = s_nationkey
        JOIN region sr ON sr.r_regionkey = sn.n_regionkey JOIN nation dn ON dn.n_nationkey = c_nationkey
        JOIN region dr ON dr.r_regionkey = dn.n_regionkey"""),
}


def using(*names: str, **extra: str) -> str:
    """WITH clause holding the named inputs and whatever they need, then ``extra`` in order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        needs, sql = CTES[name]
        for need in needs:
            if need not in done:
                add(need)
        done[name] = sql

    for name in names:
        if name not in done:
            add(name)
    done.update(extra)
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in done.items()) + "\n"
