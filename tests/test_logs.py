"""Policies, tags, alerts and audit rules at their edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clock, policies as p
from tidemark.operators import alerts, audit, governance as g, monitoring, quality
from tidemark.sources.bindings import ROLES

NOW = dt.datetime(2024, 1, 31, 12, 0)
VALUES = [None, "", "a", "abcd", "abcde", "Customer 1", "x@y", "@", "5550101234"]


def py_pii(v, role):
    if role in p.PII_FULL:
        return v
    if role in p.PII_LAST4:
        return None if v is None else "*" * (len(v) - 4) + v[-4:] if len(v) > 4 else "*" * len(v)
    return "***MASKED***"


def py_account(v, role):
    return v if role in p.CLIENT_FULL else "****-****-" + v[-4:] if v and len(v) > 4 else "****"


def py_contact(v, role):
    if role in p.CLIENT_FULL:
        return v
    if v is None:
        return "***"
    return v[:2] + "***@***.com" if "@" in v else "***-***-" + v[-4:] if len(v) >= 10 else "***"


@pytest.mark.parametrize("mask, expected", [(p.mask_client_pii, py_pii), (p.mask_account_number, py_account), (p.mask_phone_email, py_contact)])
def test_text_masks(spark, mask, expected):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    for role in ROLES + ["SOMEONE"]:
        for r in df.select("v", mask(F.col("v"), role).alias("m")).collect():
            assert r.m == expected(r.v, role), (role, r.v)


def test_amount_mask_and_role_folding(spark):
    df = spark.createDataFrame([(1.5,), (None,)], "v double")
    assert [r.m for r in df.select(p.mask_financial_amount(F.col("v"), "INV_READONLY").alias("m")).collect()] == [None, None]
    plan = df.select(p.mask_client_pii(F.col("v").cast("string"), "INV_READONLY").alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE" not in plan and "***MASKED***" in plan


def test_row_filters(spark):
    df = spark.createDataFrame([(s,) for s in ["CERTIFIED", "UNDER_REVIEW", "QUARANTINED", "DEPRECATED", "NEW", None]], "s string")
    seen = {role: {r.s for r in df.where(p.sees_quality(F.col("s"), role)).collect()} for role in ROLES}
    assert seen["INV_READONLY"] == {"CERTIFIED", "NEW", None} == seen["INV_ANALYST"] and len(seen["INV_DATA_ENGINEER"]) == 6
    df = spark.createDataFrame([(s,) for s in ["INSTITUTIONAL", "RETAIL", "FAMILY", None]], "s string")
    seen = {role: {r.s for r in df.where(p.sees_client(F.col("s"), role)).collect()} for role in ROLES}
    assert seen["INV_ML_ENGINEER"] == {"INSTITUTIONAL", "FAMILY", None} and seen["INV_ML_ADMIN"] == {"FAMILY", None}
    assert len(seen["INV_ANALYST"]) == 4


def test_filter_runs_before_masks(spark):
    df = spark.createDataFrame([("a", "RETAIL"), ("b", "INSTITUTIONAL")], "name string, tier string")
    out = g.governed(df, "INV_DATA_ENGINEER", masks={"tier": "MASK_CLIENT_PII"}, filters={"tier": "ROW_ACCESS_CLIENT_TIER"})
    assert [tuple(r) for r in out.collect()] == [("b", "*" * 9 + "ONAL")]


def test_hours_crossed_counts_boundaries(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 59), dt.datetime(2024, 1, 1, 1, 1)), (dt.datetime(2024, 1, 1, 0, 0), dt.datetime(2024, 1, 1, 0, 59))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert [r.h for r in df.select(clock.hours_crossed("a", F.col("b")).alias("h")).collect()] == [1, 0]


def test_instant_and_wall_are_inverse_in_any_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 1, 5),), (None,)], "t timestamp_ntz")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r.w for r in df.select(clock.wall(clock.instant("t")).alias("w")).collect()] == [dt.datetime(2024, 3, 10, 2, 30, 1, 5), None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


QUERY = ("query_id bigint, query_text string, user_name string, role_name string, warehouse_name string, warehouse_size string, database_name string, "
         "schema_name string, query_type string, execution_status string, error_code bigint, error_message string, start_time timestamp_ntz, "
         "end_time timestamp_ntz, total_elapsed_time bigint, bytes_scanned bigint, rows_produced bigint, partitions_scanned bigint, "
         "credits_used_cloud_services decimal(12,3)")


def queries(spark, items):
    base = dict(query_text="select 1", user_name="U1", role_name="INV_ANALYST", warehouse_name="INV_ML_WH", warehouse_size="S", database_name="INV_RAW_DB",
                schema_name="S", query_type="SELECT", execution_status="SUCCESS", error_code=None, error_message=None,
                start_time=NOW - dt.timedelta(minutes=5), end_time=NOW, total_elapsed_time=10, bytes_scanned=0, rows_produced=1, partitions_scanned=1,
                credits_used_cloud_services=None)
    names = [c.split()[0] for c in QUERY.split(", ")]
    return spark.createDataFrame([tuple({**base, "query_id": i, **q}[n] for n in names) for i, q in enumerate(items)], QUERY)


@pytest.mark.parametrize("failures, fired", [(10, False), (11, True)])
def test_failed_spike_threshold(spark, failures, fired):
    log = queries(spark, [{"execution_status": "FAIL"}] * failures + [{"execution_status": "FAIL", "start_time": NOW - dt.timedelta(minutes=16)}] * 5)
    assert alerts.failed_spike(log, NOW).first().fired is fired


def test_long_running_and_empty_alerts(spark):
    assert alerts.long_running(queries(spark, [{"total_elapsed_time": 300_000}]), NOW).first().fired is False
    assert alerts.long_running(queries(spark, [{"total_elapsed_time": 300_001}]), NOW).first().fired is True
    none = queries(spark, []).where("false")
    assert alerts.failed_spike(none, NOW).first().fired is False and alerts.long_running(none, NOW).first().fired is False


@pytest.mark.parametrize("now, before, fired", [(121, 100, True), (120, 100, False), (5, 0, False)])
def test_cost_spike(spark, now, before, fired):
    rows = [(dt.datetime(2024, 1, 3), "INV_ML_WH", now), (dt.datetime(2023, 12, 3), "INV_ML_WH", before)]
    log = spark.createDataFrame(rows, "start_time timestamp_ntz, warehouse_name string, c int").select(
        "start_time", "warehouse_name", F.col("c").cast("decimal(10,2)").alias("credits_used"),
        F.lit(0).cast("decimal(10,2)").alias("credits_used_cloud_services"))
    assert alerts.cost_spike(log, NOW).first().fired is fired


def test_quota_guards_zero(spark):
    m = spark.createDataFrame([("INV_A", 0, 5), ("INV_B", 100, 90), ("OTHER", 1, 1)], "name string, credit_quota bigint, used_credits bigint").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("remaining_credits", "notify", "suspend", "suspend_immediate", "warehouses", "created")])
    got = {r.monitor_name: r.usage_percent for r in monitoring.quota_status(m).collect()}
    assert got == {"INV_A": None, "INV_B": 90.0}
    assert alerts.quota_critical(m, NOW).first().fired is True
    assert alerts.quota_critical(m.where("name = 'INV_A'"), NOW).first().fired is False


TAGS = "tag_database string, tag_schema string, object_database string, object_schema string, object_name string, column_name string, tag_name string, tag_value string"


def tag(db, schema, column, name, value):
    return ("INV_GOVERNANCE_DB", "TAGS", db, schema, "T", column, name, value)


def test_risk_score_bands(spark):
    tags = spark.createDataFrame([tag("PII_DB", "S", "c1", "PII_CLASSIFICATION", "DIRECT_PII"), tag("PII_DB", "Z", "c2", "PII_CLASSIFICATION", "DIRECT_PII"),
                                  tag("SECRET_DB", "S", None, "DATA_SENSITIVITY", "HIGHLY_CONFIDENTIAL")], TAGS)
    q = queries(spark, [
        {"user_name": "none"}, {"user_name": "pii", "database_name": "PII_DB"}, {"user_name": "pii", "database_name": "PII_DB"},
        {"user_name": "esc"}, {"user_name": "adm", "role_name": "ACCOUNTADMIN"}, {"user_name": "adm3", "role_name": "ACCOUNTADMIN"},
        {"user_name": "all", "role_name": "ACCOUNTADMIN"}, {"user_name": "all", "database_name": "SECRET_DB", "role_name": "X"}, {"user_name": "two"},
        {"user_name": "old", "role_name": "ACCOUNTADMIN", "start_time": NOW - dt.timedelta(days=91)},
        {"user_name": "inside", "database_name": "SECRET_DB", "role_name": "INV_ANALYST"}])
    grants = spark.createDataFrame([(NOW, "OWNERSHIP", "TABLE", "x", "esc", None), (NOW, "USAGE", "ROLE", "SYSADMIN", "none", None),
                                    (NOW, "OWNERSHIP", "TABLE", "x", "none", NOW), (NOW, "USAGE", "ROLE", "SECURITYADMIN", "all", None)],
                                   "created_on timestamp_ntz, privilege string, granted_on string, name string, granted_by string, deleted_on timestamp_ntz")
    logins = spark.createDataFrame([(u, "NO", NOW) for u, n in {"two": 2, "adm3": 3, "all": 3}.items() for _ in range(n)],
                                   "user_name string, is_success string, event_timestamp timestamp_ntz")
    got = {r.user_name: (r.risk_score, r.risk_level, r.pii_access_count, r.failed_logins) for r in audit.risk_score(q, grants, tags, logins, NOW).collect()}
    assert got == {"none": (0, "LOW", 0, 0), "pii": (25, "LOW", 4, 0), "esc": (30, "MEDIUM", 0, 0), "adm": (50, "MEDIUM", 0, 0),
                   "adm3": (70, "HIGH", 0, 3), "all": (140, "CRITICAL", 0, 3), "two": (0, "LOW", 0, 0), "inside": (0, "LOW", 0, 0)}


def test_escalation_of_sysadmin_is_other(spark):
    grants = spark.createDataFrame([(NOW, "USAGE", "ROLE", "SYSADMIN", "r", "a", None), (NOW, "USAGE", "TABLE", "SYSADMIN", "r", "a", None),
                                    (NOW, "APPLY TAG", "ACCOUNT", "ORGADMIN", "r", "a", None)],
                                   "created_on timestamp_ntz, privilege string, granted_on string, name string, grantee_name string, granted_by string, deleted_on timestamp_ntz")
    got = sorted((r.escalation_type, r.severity) for r in audit.privilege_escalation(grants, NOW).collect())
    assert got == [("GOVERNANCE_PRIVILEGE", "CRITICAL"), ("OTHER_ESCALATION", "MEDIUM")]


def test_pii_filter_precedence(spark):
    tags = spark.createDataFrame([tag("D", "S", "c", "PII_CLASSIFICATION", "DIRECT_PII")], TAGS)
    q = queries(spark, [
        {"database_name": "D"}, {"database_name": "E"}, {"database_name": "E", "query_type": "DROP"},
        {"database_name": "D", "warehouse_name": "COMPUTE_WH", "start_time": NOW - dt.timedelta(days=400)},
        {"database_name": "E", "warehouse_name": "COMPUTE_WH"}, {"database_name": "D", "warehouse_name": "COMPUTE_WH", "query_type": "DROP"}])
    loose = sorted(r.query_id for r in audit.pii_access(q, tags, NOW).collect())
    strict = sorted(r.query_id for r in audit.pii_access(q, tags, NOW, strict=True).collect())
    assert loose == [0, 1, 2, 3] and strict == [0]


def test_effective_tag_takes_nearest_level(spark):
    cols = spark.createDataFrame([("D", "S", "T", "a"), ("D", "S", "T", "b"), ("D", "S", "U", "a"), ("D", "R", "U", "a"), ("E", "R", "U", "a")],
                                 "object_database string, object_schema string, object_name string, column_name string")
    tags = spark.createDataFrame([("D", None, None, None, "X", "db"), ("D", "S", None, None, "X", "schema"), ("D", "S", "T", None, "X", "table"),
                                  ("D", "S", "T", "a", "X", "column"), ("E", None, None, None, "OTHER", "no")],
                                 "object_database string, object_schema string, object_name string, column_name string, tag_name string, tag_value string")
    got = [(r.tag_value, r.tag_level) for r in g.effective_tags(cols, tags, "X").orderBy("object_database", F.desc("object_schema"), "object_name", "column_name").collect()]
    assert got == [("column", "column"), ("table", "table"), ("schema", "schema"), ("db", "database"), (None, None)]


def test_retention(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 2, 29), p_) for p_ in ("1_YEAR", "7_YEARS", "10_YEARS", "PERMANENT", None)], "created timestamp_ntz, policy string")

    def expired(as_of):
        return sorted(r.policy for r in g.retention_expired(df, F.col("policy"), "created", as_of).collect())
    assert expired(dt.datetime(2021, 3, 1)) == ["1_YEAR"] and expired(dt.datetime(2021, 2, 28)) == []
    assert expired(dt.datetime(2040, 1, 1)) == ["10_YEARS", "1_YEAR", "7_YEARS"]


def test_orphans_and_counts(spark):
    facts = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert quality.orphans(facts, spark.createDataFrame([(1,)], "k int"), "k").first().asDict() == {"orphan_holdings": 2, "validation_result": "FAIL"}
    counts = quality.table_counts({"A": spark.range(8000), "B": spark.range(0)})
    assert quality.total_records(counts).first().validation_result == "WARNING"
    assert {r.table_name: r.target_check for r in quality.count_targets(counts, {"A": 8000, "B": 1}).collect()} == {"A": "TARGET MET", "B": "BELOW TARGET"}


def test_reports_while_a_table_is_written(spark, tmp_path):
    rows = [(1.0, 2.0, 1.0, 3.0), (None, 2.0, None, None), (4.0, -1.0, -5.0, 1.0), (1.0, 2.0, 9.0, 0.0)]
    df = spark.createDataFrame(rows, "cost_basis double, market_value double, unrealized_pnl double, gain_loss_pct double")
    reports = dict(nulls=quality.holdings_null_measures(), gains=quality.gain_loss_measures(), values=quality.value_measures())
    seen = quality.measured_on_load(df, str(tmp_path / "t"), reports)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    assert seen["gains"] == {"total_records": 3, "calculation_errors": 1, "validation_result": "WARNING"}
    for name, one in (("nulls", quality.holdings_nulls(df)), ("gains", quality.gain_loss_check(df)), ("values", quality.value_summary(df))):
        assert seen[name] == one.first().asDict()
    again = quality.together(df, reports).first()
    assert {name: again[name].asDict() for name in reports} == seen
