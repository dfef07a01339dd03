"""The test tables seen as investment tables and logs.

Each method is one canonical input; ``plans/sqlbase.py`` states the same expressions in SQL.
Money is kept in exact decimals until the last step, so sums do not depend on row order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.clock import trunc
from tidemark.functions.measures import pick
from tidemark.operators import nav as nav_ops
from tidemark.operators import silver
from tidemark.sources import files
from tidemark.sources.scratch import forgetting_shuffles, scratch_path

AS_OF_MARKET = dt.date(2001, 11, 5)
AS_OF_LOG = dt.datetime(2024, 1, 31)
PART = 4 << 20
LARGE = 1_000_000  # lots of a portfolio that are summed by day before they go to it
SMALL = 500_000  # portfolios that are broadcast

# fixed values: role, cluster, database, schema and tag names used by the policies and log queries
ROLES = ["INV_DATA_ADMIN", "INV_ML_ADMIN", "INV_APP_ADMIN", "INV_DATA_ENGINEER", "INV_ML_ENGINEER",
         "INV_ANALYST", "INV_READONLY", "ACCOUNTADMIN"]
ADMIN_ROLES = ["ACCOUNTADMIN", "SECURITYADMIN", "SYSADMIN", "ORGADMIN"]
WAREHOUSES = ["INV_INGEST_WH", "INV_TRANSFORM_WH", "INV_ANALYTICS_WH", "INV_ML_WH", "COMPUTE_WH"]
SIZES = ["SMALL", "MEDIUM", "LARGE", "XLARGE", "XSMALL"]
DATABASES = ["INV_RAW_DB", "INV_TRANSFORM_DB", "INV_ANALYTICS_DB", "INV_AI_READY_DB", "INV_GOVERNANCE_DB", "SANDBOX_DB"]
SCHEMAS = ["MARKET_DATA", "CLEANSED", "CORE", "FEATURES", "TAGS", "MASTER", "PUBLIC", "RISK", "INFORMATION_SCHEMA"]
TAG_NAMES = ["PII_CLASSIFICATION", "DATA_SENSITIVITY", "DATA_DOMAIN", "MEDALLION_LAYER", "DATA_QUALITY_STATUS",
             "SOURCE_SYSTEM", "REFRESH_FREQUENCY", "RETENTION_POLICY"]
TAG_VALUES = {
    "PII_CLASSIFICATION": ["DIRECT_PII", "QUASI_PII", "FINANCIAL", "NON_PII"],
    "DATA_SENSITIVITY": ["HIGHLY_CONFIDENTIAL", "CONFIDENTIAL", "INTERNAL", "PUBLIC"],
    "DATA_DOMAIN": ["MARKET_DATA", "PORTFOLIO", "TRANSACTIONS", "CLIENT", "RISK", "REFERENCE"],
    "MEDALLION_LAYER": ["BRONZE", "SILVER", "GOLD", "PLATINUM"],
    "DATA_QUALITY_STATUS": ["CERTIFIED", "UNDER_REVIEW", "QUARANTINED", "DEPRECATED"],
    "SOURCE_SYSTEM": ["BLOOMBERG", "REUTERS", "CUSTODIAN", "TRADING_SYSTEM", "PORTFOLIO_SYSTEM", "MANUAL"],
    "REFRESH_FREQUENCY": ["REAL_TIME", "HOURLY", "DAILY", "WEEKLY", "MONTHLY", "ON_DEMAND"],
    "RETENTION_POLICY": ["7_YEARS", "10_YEARS", "PERMANENT", "1_YEAR"],
}
STATEMENTS = [
    "SELECT * FROM holdings", "INSERT INTO prices", "update trades SET qty", "DELETE FROM trades",
    "MERGE INTO nav", "CREATE TAG pii", "alter tag pii", "Drop Tag pii", "ALTER TABLE t SET TAG a",
    "ALTER TABLE t UNSET TAG a", "CREATE MASKING POLICY m", "ALTER ROW ACCESS POLICY r",
    "drop masking policy m", "GRANT ROLE x",
]
QUERY_TYPES = ["SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "CREATE", "ALTER", "DROP", "ALTER_TABLE",
               "ALTER_TABLE_MODIFY_COLUMN", "CREATE_MASKING_POLICY", "ALTER_ROW_ACCESS_POLICY",
               "DROP_MASKING_POLICY", "GRANT", "CREATE_USER", "DROP_ROLE", "DROP_TABLE"]
PRIVILEGES = ["USAGE", "OWNERSHIP", "APPLY MASKING POLICY", "APPLY ROW ACCESS POLICY", "APPLY TAG", "SELECT", "USAGE"]
GRANT_NAMES = ["INV_READONLY", "ACCOUNTADMIN", "INV_COMPLIANCE", "SECURITYADMIN", "INV_DATA_ADMIN", "SYSADMIN",
               "ORGADMIN", "INV_ANALYST", "PUBLIC_ROLE"]
# tags put on governed tables: database, schema, table, column, tag, value
GOVERNED = [
    ("INV_RAW_DB", "MARKET_DATA", "RAW_TRADES", None, "DATA_DOMAIN", "TRANSACTIONS"),
    ("INV_RAW_DB", "CLEANSED", "STG_TRADES", None, "DATA_QUALITY_STATUS", "QUARANTINED"),
    ("INV_TRANSFORM_DB", "CLEANSED", "FACT_TRADES", None, "DATA_DOMAIN", "TRANSACTIONS"),
    ("INV_TRANSFORM_DB", "MASTER", "DIM_CLIENT", "CLIENT_NAME", "PII_CLASSIFICATION", "DIRECT_PII"),
    ("INV_TRANSFORM_DB", "MASTER", "DIM_CLIENT", "PHONE", "PII_CLASSIFICATION", "QUASI_PII"),
    ("INV_TRANSFORM_DB", "MASTER", "DIM_CLIENT", "TICKER", "PII_CLASSIFICATION", "NON_PII"),
    ("INV_ANALYTICS_DB", "CORE", "DIM_CLIENT", "SSN", "PII_CLASSIFICATION", "DIRECT_PII"),
    ("INV_ANALYTICS_DB", "CORE", "FACT_BALANCE", "AMOUNT", "PII_CLASSIFICATION", "FINANCIAL"),
    ("INV_ANALYTICS_DB", "CORE", "DIM_CLIENT", None, "DATA_SENSITIVITY", "HIGHLY_CONFIDENTIAL"),
    ("INV_ANALYTICS_DB", "RISK", "VAR_LIMITS", None, "DATA_SENSITIVITY", "CONFIDENTIAL"),
    ("INV_ANALYTICS_DB", "RISK", "FACT_VAR", None, "DATA_QUALITY_STATUS", "QUARANTINED"),
    ("INV_AI_READY_DB", "FEATURES", "STRATEGY", None, "DATA_SENSITIVITY", "HIGHLY_CONFIDENTIAL"),
    ("INV_AI_READY_DB", "FEATURES", "OLD_SET", None, "DATA_QUALITY_STATUS", "DEPRECATED"),
]
POLICIES = ["MASK_CLIENT_PII", "MASK_ACCOUNT_NUMBER", "MASK_FINANCIAL_AMOUNT", "MASK_PHONE_EMAIL",
            "ROW_ACCESS_DATA_QUALITY", "ROW_ACCESS_CLIENT_TIER"]


def _hundredths(column: str) -> Column:
    """A stored double with two decimals as whole hundredths."""
    return F.rint(F.col(column) * 100).cast("bigint")


def _decimal(units: Column, precision: int, scale: int) -> Column:
    """Whole units of 10**-scale as a decimal; much cheaper than casting a double."""
    one = F.lit(f"{10 ** -scale:.{scale}f}").cast(f"decimal({scale},{scale})")
    return (units.cast("decimal(18,0)") * one).cast(f"decimal({precision},{scale})")


class Tables:
    """Canonical inputs over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._written: dict[str, str] = {}
        self._lots_found: tuple[dict[str, str], list[int]] | None = None

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def written(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several parts of one query read: made and written once, as silver tables are in use."""
        if name not in self._written:
            self._written[name] = scratch_path(self.spark, f"silver-{name}")
            with forgetting_shuffles(self.spark):
                make().write.option("compression", "zstd").parquet(self._written[name])
        return self.spark.read.parquet(self._written[name])

    def dealt(self, df: DataFrame, *keys: str) -> DataFrame:
        """Rows that follow from trades, by ``keys`` in as many parts as there are ``PART`` bytes of trades: what a task holds does not grow."""
        parts = -(-files.size(self.spark, f"{self.folder}/lineitem.parquet") // PART)
        return df.repartition(max(parts, self.spark.sparkContext.defaultParallelism), *keys)

    # --- market -------------------------------------------------------------------------------

    def trades(self) -> DataFrame:
        cents, off = _hundredths("l_extendedprice"), _hundredths("l_discount")
        ext = _decimal(cents, 12, 2)
        return self.raw("lineitem").select(
            F.col("l_suppkey").alias("portfolio_id"),
            F.col("l_partkey").alias("security_id"),
            F.col("l_shipdate").cast("date").alias("trade_date"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            ext.alias("gross"),
            _decimal(cents * (100 - off), 18, 4).alias("net"),
            _decimal(_hundredths("l_tax"), 4, 2).alias("fee_rate"),
            F.col("l_returnflag").alias("flag"),
        )

    def prices(self) -> DataFrame:
        return silver.daily_prices(self.trades(), tie=["order_id", "line_no", "portfolio_id"])

    def brand_trades(self) -> DataFrame:
        brand = self.raw("part").select(F.col("p_partkey").alias("security_id"), F.col("p_brand").alias("brand"))
        return (self.trades().join(brand, "security_id").drop("security_id")
                .withColumnRenamed("brand", "security_id"))

    def brand_prices(self) -> DataFrame:
        return silver.daily_prices(self.brand_trades(), tie=["order_id", "line_no", "portfolio_id"])

    def nav(self) -> DataFrame:
        return self.dealt(nav_ops.nav_from_trades(self.trades()), "portfolio_id")

    def benchmarked_nav(self) -> DataFrame:
        return nav_ops.with_benchmark(self.nav(), self.trades())

    def nav_history(self) -> DataFrame:
        return nav_ops.nav_history(self.benchmarked_nav())

    def positions(self) -> DataFrame:
        """Holdings without the holding period (no join to orders)."""
        day_lots = self.trades().groupBy("trade_date", "portfolio_id", "security_id").agg(
            F.sum("quantity").alias("quantity"), F.sum("net").alias("market_value"),
            F.sum("gross").alias("benchmark_value"))
        return self._with_cost(day_lots)

    def dated_lots(self) -> DataFrame:
        """One row per day, portfolio and security, with the holding period where its orders are known."""
        ordered = self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("date").alias("ordered"))
        return self.trades().join(ordered, "order_id", "left").groupBy("trade_date", "portfolio_id", "security_id").agg(
            F.sum("quantity").alias("quantity"), F.sum("net").alias("market_value"),
            F.sum("gross").alias("benchmark_value"),
            (1 + F.max(F.abs(F.datediff("trade_date", "ordered")))).cast("bigint").alias("holding_period_days"))

    def holdings(self, lots: DataFrame | None = None) -> DataFrame:
        lots = self.dated_lots() if lots is None else lots
        return self._with_cost(lots.where("holding_period_days IS NOT NULL"))

    def lots(self) -> DataFrame:
        """The lots of a query that needs them more than once; money in 18 digits, half as wide in a shuffle, where all of it fits."""
        narrow, _ = self._measured_lots()
        return self._written_lots().withColumns({c: F.col(c).cast(kind) for c, kind in narrow.items()})

    def _written_lots(self) -> DataFrame:
        """In each file by portfolio: neighbours that are alike take less room, here and in the shuffles that read them."""
        return self.written("lots", lambda: self.dated_lots().sortWithinPartitions("portfolio_id", "trade_date"))

    def _measured_lots(self) -> tuple[dict[str, str], list[int]]:
        """What one pass over the written lots finds: types of money whose values have 18 digits at most, and portfolios of very many lots."""
        if self._lots_found is None:
            lots = self._written_lots()
            money = {f.name: f.dataType.scale for f in lots.schema.fields if f.dataType.typeName() == "decimal"}
            of_each = lots.groupBy("portfolio_id").agg(F.count("*").alias("lots"), *(F.max(F.abs(c)).alias(c) for c in money))
            # a thousand are named at most: the others hold less than a thousandth of the lots each
            large = F.sort_array(F.collect_list(F.when(F.col("lots") > LARGE, F.struct("lots", "portfolio_id"))), asc=False)
            with forgetting_shuffles(self.spark):
                found = of_each.agg(F.slice(large, 1, 1000).alias("large"), *(F.max(c).alias(c) for c in money)).first()
            self._lots_found = ({c: f"decimal(18,{scale})" for c, scale in money.items() if found[c] is None or found[c] < 10 ** (18 - scale)},
                                [x.portfolio_id for x in found.large if x.portfolio_id is not None])
        return self._lots_found

    def history_of_lots(self) -> DataFrame:
        """NAV history from the written lots; sums of sums, so the same as from trades.

        Lots go to their portfolio at once, and are summed by day there; those of very large portfolios are summed by day on the way.
        """
        lots = self.lots().select("portfolio_id", "trade_date", F.col("market_value").alias("net"), "quantity")
        rows = lots
        if large := self._measured_lots()[1]:
            is_large = F.coalesce(F.col("portfolio_id").isin(large), F.lit(False))
            days = nav_ops.nav_from_trades(lots.where(is_large))
            rows = lots.where(~is_large).union(days.select("portfolio_id", "as_of_date", "total_nav", "shares_outstanding"))
        nav = nav_ops.nav_from_trades(self.dealt(rows, "portfolio_id"))
        return nav_ops.nav_history(nav_ops.with_benchmark(nav, lots))

    def _with_cost(self, lots: DataFrame) -> DataFrame:
        # list price is a fact of the security, so it is applied after the sum
        list_price = self.raw("part").select(
            F.col("p_partkey").alias("security_id"), F.col("p_retailprice").cast("decimal(12,2)").alias("list_price"))
        return (lots.join(list_price, "security_id")
                .withColumn("cost_basis", F.col("quantity").cast("decimal(12,0)") * F.col("list_price"))
                .drop("list_price").withColumnRenamed("trade_date", "as_of_date"))

    def dim_security(self) -> DataFrame:
        p = F.col
        return self.raw("part").select(
            p("p_partkey").alias("security_id"), p("p_name").alias("security_name"), p("p_brand").alias("ticker"),
            p("p_type").alias("security_type"), p("p_type").alias("sector"),
            F.concat(F.lit("IND-"), F.floor(p("p_size") / 10).cast("string")).alias("industry"),
            F.lit("USA").alias("country"),
            F.when(p("p_type").like("%PROMO%"), "FIXED_INCOME")
             .when(p("p_type").like("%ECONOMY%") | p("p_type").like("%LARGE%"), "INTERNATIONAL_EQUITY")
             .otherwise("EQUITY").alias("asset_class"),
            pick(["SPX", "NDX", "RUT"], p("p_partkey")).alias("benchmark_index"),
            (p("p_size").cast("decimal(8,4)") / 100).cast("decimal(8,4)").alias("expense_ratio"),
            pick(["LOW", "LOW-MEDIUM", "MEDIUM", "MEDIUM-HIGH", "HIGH"], p("p_partkey")).alias("risk_rating"),
            F.lit(True).alias("is_current"))

    def dim_portfolio(self) -> DataFrame:
        s = F.col
        return (self.raw("supplier")
                .join(self.raw("nation"), s("s_nationkey") == s("n_nationkey"))
                .join(self.raw("region"), s("n_regionkey") == s("r_regionkey"))
                .select(s("s_suppkey").alias("portfolio_id"), s("s_name").alias("portfolio_name"),
                        s("r_name").alias("portfolio_type"), s("n_name").alias("strategy"),
                        F.concat(F.lit("MGR-"), F.pmod(s("s_suppkey"), F.lit(10)).cast("string")).alias("fund_manager"),
                        (F.pmod(s("s_suppkey"), F.lit(8)).cast("decimal(4,0)") / 4).cast("decimal(8,4)").alias("management_fee"),
                        (F.pmod(s("s_suppkey"), F.lit(6)).cast("decimal(4,0)") / 4).cast("decimal(8,4)").alias("expense_ratio"),
                        (s("s_acctbal") >= 0).alias("is_active")))

    def dim_portfolio_at_hand(self) -> DataFrame:
        """The portfolios for rows that are not dealt by portfolio: sent to every task, unless there are very many."""
        portfolios = self.dim_portfolio()
        return F.broadcast(portfolios) if self.raw("supplier").count() <= SMALL else portfolios

    def transactions(self) -> DataFrame:
        """Executions as booked; (order_id, line_no) repeats in the data."""
        return self.trades().select(
            "order_id", "line_no", "trade_date", "portfolio_id", "security_id", "quantity",
            F.when(F.col("flag") == "R", "SELL").otherwise("BUY").alias("transaction_type"),
            (F.col("gross") / F.col("quantity").cast("decimal(10,0)")).cast("decimal(18,6)").alias("price"),
            "gross", (F.col("gross") * F.col("fee_rate")).alias("commission"),
            (F.col("gross") * F.lit(0.001).cast("decimal(4,3)")).alias("fees"))

    def attribute_changes(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("attribute"),
            F.col("o_orderdate").alias("changed_at"), F.col("o_orderkey").alias("change_id"))

    def clients(self) -> DataFrame:
        c = F.col
        return self.raw("customer").select(
            c("c_custkey").alias("client_id"), c("c_name").alias("client_name"),
            F.lpad(c("c_custkey").cast("string"), 12, "0").alias("account_number"),
            F.concat(c("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
            F.concat(F.lit("555-01"), F.lpad(c("c_custkey").cast("string"), 7, "0")).alias("phone"),
            c("c_acctbal").alias("balance"),
            F.when(c("c_mktsegment").isin("BUILDING", "MACHINERY"), "INSTITUTIONAL")
             .when(c("c_mktsegment") == "HOUSEHOLD", "RETAIL")
             .when(c("c_mktsegment") == "AUTOMOBILE", "OTHER").alias("client_tier"),
            pick(TAG_VALUES["DATA_QUALITY_STATUS"] + [None], c("c_custkey")).alias("dq_status"))

    # --- logs ---------------------------------------------------------------------------------

    def events(self) -> DataFrame:
        return self.shape_events(self.raw("events"))

    @staticmethod
    def shape_events(events: DataFrame) -> DataFrame:
        return events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))

    def query_history(self) -> DataFrame:
        return self.shape_queries(self.events())

    @staticmethod
    def shape_queries(events: DataFrame) -> DataFrame:
        e, k = F.col("event_id"), F.col("k")
        elapsed = (F.col("value").cast("decimal(12,2)") * 1000).cast("bigint")
        failed = F.col("event_type") == "error"
        return events.select(
            e.alias("query_id"),
            F.concat(pick(STATEMENTS, e), F.lit(" -- "), e.cast("string")).alias("query_text"),
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_name"),
            pick(ROLES, F.col("user_id")).alias("role_name"),
            pick(WAREHOUSES, e).alias("warehouse_name"), pick(SIZES, e).alias("warehouse_size"),
            pick(DATABASES, k).alias("database_name"),
            pick(SCHEMAS, F.floor(k / 6)).alias("schema_name"),
            pick(QUERY_TYPES, F.floor(e / 14)).alias("query_type"),
            F.when(failed, "FAIL").otherwise("SUCCESS").alias("execution_status"),
            F.when(failed, k + 1000).alias("error_code"),
            F.when(failed, F.concat(F.lit("code "), k.cast("string"))).alias("error_message"),
            F.col("ts").alias("start_time"),
            F.timestamp_add("MILLISECOND", elapsed, "ts").cast("timestamp_ntz").alias("end_time"),
            elapsed.alias("total_elapsed_time"), (elapsed / 10).cast("bigint").alias("compilation_time"),
            (k * 10).alias("queued_overload_time"),
            (k * 1073741824).alias("bytes_scanned"), (k * 200).alias("rows_produced"),
            k.alias("partitions_scanned"), (k + F.pmod(e, F.lit(3)) * 50).alias("partitions_total"),
            (k.cast("decimal(6,0)") * F.lit(0.001).cast("decimal(4,3)")).cast("decimal(12,3)")
            .alias("credits_used_cloud_services"))

    def metering(self) -> DataFrame:
        return self.query_history().groupBy(trunc("HOUR", "start_time").alias("start_time"), "warehouse_name").agg(
            (F.sum("credits_used_cloud_services") * 10).cast("decimal(20,3)").alias("credits_used_compute"),
            F.sum("credits_used_cloud_services").cast("decimal(20,3)").alias("credits_used_cloud_services"),
        ).withColumn("credits_used", (F.col("credits_used_compute") + F.col("credits_used_cloud_services"))
                     .cast("decimal(20,3)"))

    def warehouse_load(self) -> DataFrame:
        def share(total: str, factor: float) -> Column:
            return (F.col(total).cast("decimal(14,0)") * F.lit(factor).cast("decimal(4,4)")).cast("decimal(18,4)")

        return self.query_history().groupBy(trunc("HOUR", "start_time").alias("start_time"), "warehouse_name").agg(
            F.sum("total_elapsed_time").alias("busy"), F.sum("queued_overload_time").alias("queued"),
            F.sum(F.when(F.col("execution_status") == "FAIL", 1).otherwise(0)).alias("failed"),
            F.count("*").alias("n"),
        ).select(
            "warehouse_name", "start_time",
            F.timestamp_add("HOUR", F.lit(1), "start_time").cast("timestamp_ntz").alias("end_time"),
            share("busy", 0.0001).alias("avg_running"), share("queued", 0.005).alias("avg_queued_load"),
            share("n", 0.25).alias("avg_queued_provisioning"), share("failed", 0.125).alias("avg_blocked"))

    def logins(self) -> DataFrame:
        e, k = F.col("event_id"), F.col("k")
        failed = F.col("event_type") == "error"
        return self.events().where(F.col("event_type").isin("signup", "error")).select(
            e.alias("event_id"), F.col("ts").alias("event_timestamp"),
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_name"),
            F.when(k < 30, F.concat(F.lit("10.0.0."), k.cast("string")))
             .when(k < 60, F.concat(F.lit("192.168.1."), k.cast("string")))
             .otherwise(F.concat(F.lit("52.1.1."), k.cast("string"))).alias("client_ip"),
            pick(["JDBC", "ODBC", "WEB"], e).alias("reported_client_type"),
            F.concat(F.lit("3."), F.pmod(e, F.lit(5)).cast("string")).alias("reported_client_version"),
            pick(["PASSWORD", "RSA"], k).alias("first_authentication_factor"),
            F.when(F.pmod(k, F.lit(3)) == 0, "MFA").alias("second_authentication_factor"),
            F.when(failed, "NO").otherwise("YES").alias("is_success"),
            F.when(failed, k + 2000).alias("error_code"),
            F.when(failed, "bad login").alias("error_message"),
            F.concat(F.lit("conn"), F.pmod(e, F.lit(4)).cast("string")).alias("connection"))

    def sessions(self) -> DataFrame:
        u = F.col("user_id")
        per_day = self.events().groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(
            F.min("ts").alias("created_on"), F.min("k").alias("k"))
        return per_day.select(
            F.concat(u.cast("string"), F.lit("/"), F.col("d").cast("string")).alias("session_id"),
            F.concat(F.lit("U"), u.cast("string")).alias("user_name"), "created_on",
            (F.pmod(u, F.lit(2)) == 0).alias("is_open"),
            F.when(F.pmod(u, F.lit(2)) == 1, "LOGOUT").alias("closed_reason"),
            pick(["JDBC", "WEB", "PYTHON"], F.col("k")).alias("client_application_id"),
            F.concat(F.lit("v"), F.pmod(F.col("k"), F.lit(7)).cast("string")).alias("client_application_version"),
            pick(["PROD", "DEV"], F.col("k")).alias("client_environment"),
            pick(["PASSWORD", "PASSWORD_MFA", "MULTI_FACTOR", None], F.col("k")).alias("authentication_method"))

    def grants_to_users(self) -> DataFrame:
        e, k, u = F.col("event_id"), F.col("k"), F.col("user_id")
        return self.events().where(F.col("event_type") == "signup").select(
            F.col("ts").alias("created_on"), pick(GRANT_NAMES, k).alias("role"),
            F.concat(F.lit("U"), u.cast("string")).alias("grantee_name"),
            F.concat(F.lit("U"), F.pmod(e, F.lit(50)).cast("string")).alias("granted_by"),
            F.when(F.pmod(e, F.lit(9)) == 0, F.col("ts")).alias("deleted_on"))

    def grants_to_roles(self) -> DataFrame:
        e, k, u = F.col("event_id"), F.col("k"), F.col("user_id")
        return self.events().where(F.col("event_type").isin("purchase", "view")).select(
            F.col("ts").alias("created_on"), pick(PRIVILEGES, k).alias("privilege"),
            F.when(F.pmod(e, F.lit(2)) == 0, "ROLE").otherwise("TABLE").alias("granted_on"),
            pick(GRANT_NAMES, F.floor(k / 7)).alias("name"), pick(ROLES + ["SYSADMIN"], u).alias("grantee_name"),
            F.concat(F.lit("U"), F.pmod(e, F.lit(50)).cast("string")).alias("granted_by"),
            F.when(F.pmod(e, F.lit(9)) == 0, F.col("ts")).alias("deleted_on"))

    def governed_tags(self) -> DataFrame:
        """Tags on governed columns: a fixed list, joined to the growing query log."""
        return self.spark.createDataFrame(
            [("INV_GOVERNANCE_DB", "TAGS", *row) for row in GOVERNED],
            "tag_database string, tag_schema string, object_database string, object_schema string, "
            "object_name string, column_name string, tag_name string, tag_value string")

    # --- catalogue listings, one row per part ---------------------------------------------------

    def catalog_tables(self) -> DataFrame:
        p, n = F.col("p_partkey"), F.col("p_size").cast("bigint")
        return self.raw("part").select(
            pick(DATABASES, p).alias("table_catalog"), pick(SCHEMAS, n).alias("table_schema"),
            F.concat(F.lit("T_"), p.cast("string")).alias("table_name"),
            F.timestamp_add("DAY", -(F.pmod(p, F.lit(4000))), F.lit(str(AS_OF_LOG)).cast("timestamp_ntz"))
            .cast("timestamp_ntz").alias("created"),
            (n * 1000).alias("row_count"), (n * 1073741824).alias("bytes"),
            F.when(F.pmod(p, F.lit(11)) == 0, F.lit(str(AS_OF_LOG)).cast("timestamp_ntz")).alias("deleted"))

    def catalog_schemas(self) -> DataFrame:
        return (self.catalog_tables().where("deleted IS NULL")
                .select(F.col("table_catalog").alias("catalog_name"), F.col("table_schema").alias("schema_name"))
                .distinct())

    def catalog_columns(self) -> DataFrame:
        # fixed values: declared measure columns, and two ordinary ones
        names = ["COST_BASIS", "MARKET_VALUE", "UNREALIZED_PNL", "BENCHMARK_VALUE", "GAIN_LOSS_PCT",
                 "ANNUALIZED_RETURN", "NAV_PER_SHARE", "ALPHA", "BETA", "DAILY_RETURN", "YTD_RETURN", "TICKER", "SECTOR"]
        return self.catalog_tables().select(
            "table_catalog", "table_schema", "table_name", "deleted",
            pick(names, (F.col("row_count") / 1000).cast("bigint")).alias("column_name"),
            pick(["NUMBER", "TEXT"], (F.col("row_count") / 1000).cast("bigint")).alias("data_type"))

    def tag_references(self) -> DataFrame:
        p, n = F.col("p_partkey"), F.col("p_size").cast("bigint")
        value: Column | None = None
        for i, tag in enumerate(TAG_NAMES):
            hit = F.pmod(p, F.lit(8)) == i
            chosen = pick(TAG_VALUES[tag], n)
            value = F.when(hit, chosen) if value is None else value.when(hit, chosen)
        return self.raw("part").select(
            pick(DATABASES, p).alias("object_database"), pick(SCHEMAS, n).alias("object_schema"),
            F.concat(F.lit("T_"), p.cast("string")).alias("object_name"),
            F.concat(F.lit("C_"), n.cast("string")).alias("column_name"),
            F.lit("INV_GOVERNANCE_DB").alias("tag_database"), F.lit("TAGS").alias("tag_schema"),
            pick(TAG_NAMES, p).alias("tag_name"), value.alias("tag_value"))

    def policy_references(self) -> DataFrame:
        p, n = F.col("p_partkey"), F.col("p_size").cast("bigint")
        return self.raw("part").select(
            pick(POLICIES + ["MASK_OLD"], p).alias("policy_name"), F.lit("INV_GOVERNANCE_DB").alias("policy_db"),
            F.lit("POLICIES").alias("policy_schema"),
            F.when(F.pmod(p, F.lit(7)).isin(4, 5), "ROW_ACCESS_POLICY").otherwise("MASKING_POLICY").alias("policy_kind"),
            pick(DATABASES, n).alias("ref_database_name"), pick(SCHEMAS, n).alias("ref_schema_name"),
            F.concat(F.lit("T_"), p.cast("string")).alias("ref_entity_name"),
            F.concat(F.lit("C_"), n.cast("string")).alias("ref_column_name"), F.lit("TABLE").alias("ref_entity_domain"))

    def policies(self) -> DataFrame:
        rows = [(p, "INV_GOVERNANCE_DB", "POLICIES", "SECURITYADMIN", None) for p in POLICIES]
        rows.append(("MASK_OLD", "INV_GOVERNANCE_DB", "POLICIES", "SYSADMIN", str(AS_OF_LOG)))
        return self.spark.createDataFrame(
            rows, "policy_name string, policy_catalog string, policy_schema string, policy_owner string, deleted string"
        ).withColumns({"deleted": F.col("deleted").cast("timestamp_ntz"),
                       "created": F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")})

    def resource_monitors(self) -> DataFrame:
        s = F.col("s_suppkey")
        quota, used = F.pmod(s, F.lit(6)) * 1000, F.floor(F.abs("s_acctbal") / 2).cast("bigint")
        return self.raw("supplier").select(
            F.concat(pick(["INV_MON_", "INVXMON_", "OTHER_"], s), s.cast("string")).alias("name"),
            quota.alias("credit_quota"), used.alias("used_credits"), (quota - used).alias("remaining_credits"),
            F.lit("75").alias("notify"), F.lit("90").alias("suspend"), F.lit("100").alias("suspend_immediate"),
            pick(WAREHOUSES, s).alias("warehouses"), F.lit("2023-01-01 00:00:00").cast("timestamp_ntz").alias("created"))

    def storage_usage(self) -> DataFrame:
        """Bytes per day (a day is a block of documents)."""
        return self.raw("documents").groupBy(
            F.date_sub(F.lit(str(AS_OF_LOG.date())).cast("date"), F.pmod("doc_id", F.lit(250)).cast("int")).alias("usage_date")
        ).agg((F.sum("n_chars") * 1000000).alias("storage_bytes"), (F.max("n_chars") * 1000000).alias("stage_bytes"),
              (F.min("n_chars") * 1000000).alias("failsafe_bytes"))

    def database_storage(self) -> DataFrame:
        return self.raw("documents").groupBy(
            F.date_sub(F.lit(str(AS_OF_LOG.date())).cast("date"), F.pmod("doc_id", F.lit(5)).cast("int")).alias("usage_date"),
            F.concat(pick(["INV_", "LAB_"], F.length("source")), F.col("source")).alias("database_name"),
        ).agg((F.sum("n_chars") * 1000).alias("average_database_bytes"),
              (F.max("n_chars") * 1000).alias("average_failsafe_bytes"))

    def data_transfers(self) -> DataFrame:
        """Bytes moved from the supplier's region to the customer's region."""
        nation = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        src = self.raw("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("source_region"))
        dst = self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("o_custkey"), F.col("r_name").alias("target_region"))
        return (self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
                .join(src, "l_suppkey").join(dst, "o_custkey")
                .select(F.col("l_shipdate").alias("start_time"), F.lit("AWS").alias("source_cloud"), "source_region",
                        F.lit("AZURE").alias("target_cloud"), "target_region",
                        F.when(F.col("l_returnflag") == "R", "REPLICATION").otherwise("COPY").alias("transfer_type"),
                        (F.col("l_quantity").cast("bigint") * 1073741824).alias("bytes_transferred")))
