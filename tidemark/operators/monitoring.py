"""Cost, load and usage reports over query, metering, load, login and storage logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.clock import ago, day_start, trunc
from tidemark.functions.measures import dbl, ordered_case, rounded_ratio

# fixed values of the reports
PRICE_PER_CREDIT = 3
PRICE_PER_TB_MONTH = 23
OWN = "INV_%"
GB, TB = float(1024 ** 3), float(1024 ** 4)


def _own(column: str = "warehouse_name") -> Column:
    return F.col(column).like(OWN)


def _days(as_of: dt.datetime, n: int, column: str = "start_time") -> Column:
    return F.col(column) >= day_start(as_of, n)


def _months(as_of: dt.datetime, n: int, column: str = "start_time") -> Column:
    return F.col(column) >= day_start(as_of, months=n)


def _seconds(ms: str, digits: int = 2) -> Column:
    """Whole milliseconds as rounded seconds, in decimals so that .005 rounds up."""
    return dbl(F.round(F.col(ms).cast("decimal(18,0)") * F.lit(0.001).cast("decimal(4,3)"), digits))


def _avg_seconds(ms: str) -> Column:
    return rounded_ratio(F.sum(ms), F.count(ms) * 1000, 2)


def _avg(column: str) -> Column:
    """Average of a decimal with four places, rounded to two."""
    return rounded_ratio(F.sum(column) * 10000, F.count(column) * 10000, 2)


def _cost(credits: Column, digits: int = 2) -> Column:
    return F.round(credits * PRICE_PER_CREDIT, digits)


# --- credits --------------------------------------------------------------------------------------

def daily_credits(metering: DataFrame, as_of: dt.datetime) -> DataFrame:
    return metering.where(_own() & _days(as_of, 30)).groupBy(
        trunc("DAY", "start_time").alias("usage_date"), "warehouse_name").agg(
        F.sum("credits_used").alias("total_credits"), F.sum("credits_used_compute").alias("compute_credits"),
        F.sum("credits_used_cloud_services").alias("cloud_services_credits"), F.count("*").alias("query_count"),
        _cost(F.sum("credits_used")).alias("estimated_cost_usd"))


def monthly_credits(metering: DataFrame, as_of: dt.datetime) -> DataFrame:
    return metering.where(_own() & _months(as_of, 12)).groupBy(
        trunc("MONTH", "start_time").alias("usage_month"), "warehouse_name").agg(
        F.sum("credits_used").alias("total_credits"), _cost(F.sum("credits_used")).alias("estimated_cost_usd"))


def credits_by_user(queries: DataFrame, as_of: dt.datetime) -> DataFrame:
    credits = F.sum("credits_used_cloud_services")
    return queries.where(_own() & _days(as_of, 30)).groupBy("user_name").agg(
        F.count_distinct("query_id").alias("total_queries"), credits.alias("total_credits"),
        _avg_seconds("total_elapsed_time").alias("avg_query_seconds"), _cost(credits).alias("estimated_cost_usd"))


def credits_by_role(queries: DataFrame, as_of: dt.datetime) -> DataFrame:
    credits = F.sum("credits_used_cloud_services")
    return queries.where(_own("role_name") & _days(as_of, 30)).groupBy("role_name").agg(
        F.count_distinct("user_name").alias("unique_users"), F.count_distinct("query_id").alias("total_queries"),
        credits.alias("total_credits"), _cost(credits).alias("estimated_cost_usd"))


def top_expensive_queries(queries: DataFrame, as_of: dt.datetime, k: int = 100) -> DataFrame:
    credits = F.col("credits_used_cloud_services")
    return (queries.where(_own() & _days(as_of, 30) & (credits > 0))
            .orderBy(credits.desc(), "query_id").limit(k)
            .select("query_id", F.substring("query_text", 1, 200).alias("query_preview"), "user_name", "role_name",
                    "warehouse_name", "database_name", "execution_status", "start_time",
                    (dbl("total_elapsed_time") / 1000.0).alias("elapsed_seconds"),
                    (dbl("bytes_scanned") / GB).alias("gb_scanned"), credits.alias("credits_used"),
                    _cost(credits, 4).alias("estimated_cost_usd")))


def storage_consumption(usage: DataFrame, as_of: dt.datetime) -> DataFrame:
    total = F.col("storage_bytes") + F.col("stage_bytes") + F.col("failsafe_bytes")
    return usage.where(_months(as_of, 6, "usage_date")).select(
        "usage_date",
        F.round(dbl("storage_bytes") / TB, 4).alias("database_storage_tb"),
        F.round(dbl("stage_bytes") / TB, 4).alias("stage_storage_tb"),
        F.round(dbl("failsafe_bytes") / TB, 4).alias("failsafe_storage_tb"),
        F.round(dbl(total) / TB, 4).alias("total_storage_tb"),
        F.round(dbl(total) / TB * PRICE_PER_TB_MONTH, 2).alias("estimated_monthly_cost_usd"))


def quota_status(monitors: DataFrame) -> DataFrame:
    return monitors.where(_own("name")).select(
        F.col("name").alias("monitor_name"), "credit_quota", "used_credits", "remaining_credits",
        rounded_ratio(F.col("used_credits") * 100, "credit_quota", 2).alias("usage_percent"),
        F.col("notify").alias("notify_at_percent"), F.col("suspend").alias("suspend_at_percent"),
        F.col("suspend_immediate").alias("suspend_immediate_at_percent"), "warehouses", "created")


# --- queries --------------------------------------------------------------------------------------

def query_performance(queries: DataFrame, as_of: dt.datetime) -> DataFrame:
    return queries.where(_own() & _days(as_of, 30)).select(
        "query_id", F.substring("query_text", 1, 500).alias("query_preview"), "user_name", "role_name",
        "warehouse_name", "warehouse_size", "database_name", "schema_name", "query_type", "execution_status",
        "start_time", "end_time", _seconds("total_elapsed_time").alias("execution_seconds"),
        _seconds("compilation_time").alias("compile_seconds"), _seconds("queued_overload_time").alias("queue_seconds"),
        "bytes_scanned", F.round(dbl("bytes_scanned") / GB, 4).alias("gb_scanned"), "rows_produced",
        "partitions_scanned", "partitions_total",
        rounded_ratio(F.col("partitions_scanned") * 100, "partitions_total", 2).alias("partition_scan_pct"),
        F.col("credits_used_cloud_services").alias("credits_used"))


def long_running(queries: DataFrame, as_of: dt.datetime, limit_ms: int = 300_000) -> DataFrame:
    return queries.where(_own() & _days(as_of, 30) & (F.col("total_elapsed_time") > limit_ms)).select(
        "query_id", F.substring("query_text", 1, 300).alias("query_preview"), "user_name", "role_name",
        "warehouse_name", "warehouse_size", "database_name", "query_type", "execution_status", "start_time", "end_time",
        _seconds("total_elapsed_time").alias("execution_seconds"),
        rounded_ratio("total_elapsed_time", F.lit(60000), 2).alias("execution_minutes"), "bytes_scanned",
        F.round(dbl("bytes_scanned") / GB, 2).alias("gb_scanned"), "rows_produced", "partitions_scanned")


def failed(queries: DataFrame, as_of: dt.datetime) -> DataFrame:
    return queries.where(_own() & (F.col("execution_status") == "FAIL") & _days(as_of, 30)).select(
        "query_id", F.substring("query_text", 1, 300).alias("query_preview"), "user_name", "role_name",
        "warehouse_name", "database_name", "schema_name", "query_type", "execution_status", "error_code",
        "error_message", "start_time", _seconds("total_elapsed_time").alias("execution_seconds"))


def query_type_summary(queries: DataFrame, as_of: dt.datetime) -> DataFrame:
    counts = queries.where(_own() & _days(as_of, 30)).groupBy("query_type", "warehouse_name").agg(
        F.count("*").alias("query_count"), F.sum("credits_used_cloud_services").alias("total_credits"),
        _avg_seconds("total_elapsed_time").alias("avg_execution_seconds"),
        F.round(dbl(F.sum("bytes_scanned")) / TB, 4).alias("tb_scanned"))
    per_warehouse = counts.groupBy("warehouse_name").agg(F.sum("query_count").alias("_all"))
    return (counts.join(per_warehouse, "warehouse_name")
            .withColumn("pct_of_warehouse", F.round(F.col("query_count") * 100.0 / F.col("_all"), 2)).drop("_all"))


def usage_7d(queries: DataFrame, as_of: dt.datetime) -> DataFrame:
    return queries.where(_own() & _days(as_of, 7)).groupBy("warehouse_name").agg(
        F.count("*").alias("query_count"), F.sum("credits_used_cloud_services").alias("total_credits"),
        _avg_seconds("total_elapsed_time").alias("avg_query_seconds"), F.max("start_time").alias("last_query_time"))


# --- load and cost --------------------------------------------------------------------------------

def utilization(load: DataFrame, as_of: dt.datetime) -> DataFrame:
    return load.where(_own() & _days(as_of, 30)).select(
        "warehouse_name", "start_time", "end_time",
        F.round("avg_running", 2).alias("avg_queries_running"), F.round("avg_queued_load", 2).alias("avg_queries_queued"),
        F.round("avg_queued_provisioning", 2).alias("avg_queries_provisioning"),
        F.round("avg_blocked", 2).alias("avg_queries_blocked"),
        F.round(F.col("avg_running") + F.col("avg_queued_load"), 2).alias("total_load"),
        ordered_case((F.col("avg_queued_load") > 5, "HIGH_QUEUE"), (F.col("avg_running") > 10, "HIGH_LOAD"),
                     (F.col("avg_blocked") > 0, "BLOCKED"), otherwise="NORMAL").alias("load_status"),
        trunc("HOUR", "start_time").alias("hour_bucket"))


def load_measures() -> list[Column]:
    """Averages and peaks of a set of load samples."""
    return [F.count("*").alias("sample_count"),
            _avg("avg_running").alias("avg_queries_running"),
            _avg("avg_queued_load").alias("avg_queries_queued"),
            _avg("avg_blocked").alias("avg_queries_blocked"),
            F.round(F.max("avg_running"), 2).alias("peak_queries_running"),
            F.round(F.max("avg_queued_load"), 2).alias("peak_queries_queued"),
            F.min("start_time").alias("period_start"), F.max("end_time").alias("period_end")]


def active_load(load: DataFrame, as_of: dt.datetime) -> DataFrame:
    return load.where(_own() & (F.col("start_time") >= ago(as_of, hours=24))).groupBy("warehouse_name").agg(
        *load_measures())


def cost_by_month(metering: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Adds cloud-service credits to ``credits_used``, which already holds them; kept as reported."""
    month = trunc("MONTH", "start_time")
    per_day = metering.where(_own() & _months(as_of, 12)).groupBy(
        "warehouse_name", month.alias("usage_month"), trunc("DAY", "start_time").alias("_day")).agg(
        F.sum("credits_used").alias("_used"), F.sum("credits_used_cloud_services").alias("_cloud"))
    used, cloud = F.sum("_used"), F.sum("_cloud")
    return per_day.groupBy("warehouse_name", "usage_month").agg(
        F.round(used, 4).alias("compute_credits"), F.round(cloud, 4).alias("cloud_services_credits"),
        F.round(used + cloud, 4).alias("total_credits"), F.count("*").alias("active_days"),
        rounded_ratio((used + cloud) * 1000, F.count("*") * 1000, 4).alias("avg_credits_per_day"),
        _cost(used + cloud).alias("estimated_cost_usd"))


def login_history(logins: DataFrame, as_of: dt.datetime) -> DataFrame:
    return logins.where(_days(as_of, 30, "event_timestamp")).select(
        "user_name", F.col("reported_client_type").alias("client_type"),
        F.col("first_authentication_factor").alias("auth_factor_1"),
        F.col("second_authentication_factor").alias("auth_factor_2"), "is_success", "error_code", "error_message",
        F.col("event_timestamp").alias("login_time"), "client_ip", F.col("connection").alias("connection_name"))


def data_transfer(transfers: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    return transfers.where(_days(as_of, days)).groupBy(
        trunc("DAY", "start_time").alias("transfer_date"), "source_cloud", "source_region", "target_cloud",
        "target_region", "transfer_type").agg(
        F.round(dbl(F.sum("bytes_transferred")) / GB, 4).alias("gb_transferred"),
        F.round(dbl(F.sum("bytes_transferred")) / TB, 6).alias("tb_transferred"))


def database_storage(storage: DataFrame) -> DataFrame:
    latest = storage.agg(F.max("usage_date").alias("d"))
    size, failsafe = dbl(F.sum("average_database_bytes")), dbl(F.sum("average_failsafe_bytes"))
    return storage.where((F.col("usage_date") == latest.scalar()) & _own("database_name")).groupBy("database_name").agg(
        F.round(size / GB, 4).alias("database_size_gb"), F.round(failsafe / GB, 4).alias("failsafe_size_gb"),
        F.round((size + failsafe) / GB, 4).alias("total_size_gb"),
        F.round((size + failsafe) / GB * PRICE_PER_TB_MONTH / 30, 2).alias("estimated_daily_cost_usd"))
