"""Audit reports over login, grant, query, session and policy logs.

Query logs are joined to the tags of the tables they touch on database and schema. Tags are metadata:
Spark broadcasts them while they are small and splits hot databases (AQE) when they are not.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.clock import ago, hours_crossed, ts
from tidemark.functions.measures import dbl, ordered_case

# fixed values of the audit reports
TOP_ADMINS = ["ACCOUNTADMIN", "SECURITYADMIN", "SYSADMIN", "ORGADMIN"]
POLICY_PRIVILEGES = ["APPLY MASKING POLICY", "APPLY ROW ACCESS POLICY", "APPLY TAG"]
DATA_VERBS = ["SELECT", "INSERT", "UPDATE", "MERGE", "DELETE"]
CLIENT_DATA_ROLES = ["INV_DATA_ADMIN", "INV_ANALYST", "ACCOUNTADMIN"]
CONFIDENTIAL_ROLES = ["INV_DATA_ADMIN", "INV_ANALYST", "INV_ML_ADMIN", "ACCOUNTADMIN"]
REMEDIATION_ROLES = ["INV_DATA_ENGINEER", "INV_DATA_ADMIN", "ACCOUNTADMIN"]
PLATFORM_ADMINS = ["INV_DATA_ADMIN", "INV_ML_ADMIN", "INV_APP_ADMIN"]
TAG_DDL = ["CREATE", "ALTER", "DROP", "ALTER_TABLE", "ALTER_TABLE_MODIFY_COLUMN"]
POLICY_DDL = ["CREATE_MASKING_POLICY", "CREATE_ROW_ACCESS_POLICY", "ALTER_MASKING_POLICY", "ALTER_ROW_ACCESS_POLICY",
              "DROP_MASKING_POLICY", "DROP_ROW_ACCESS_POLICY", "CREATE", "ALTER", "DROP"]
POINTS = {"admin": 50, "escalation": 30, "pii": 25, "confidential": 40, "logins": 20}
BANDS = [(101, "CRITICAL"), (51, "HIGH"), (26, "MEDIUM")]


def _since(as_of: dt.datetime, days: int, column: str = "start_time") -> Column:
    return F.col(column) >= ago(as_of, days=days)


def _platform() -> Column:
    return F.col("warehouse_name").like("INV_%") | (F.col("warehouse_name") == "COMPUTE_WH")


def _says(pattern: str) -> Column:
    return F.col("query_text").ilike(pattern)


def _role_sensitivity(role: str) -> Column:
    return ordered_case((F.col(role).isin(TOP_ADMINS), "CRITICAL"), (F.col(role).like("%ADMIN%"), "HIGH"),
                        (F.col(role).like("%COMPLIANCE%"), "HIGH"), otherwise="NORMAL")


def _seconds() -> Column:
    return dbl("total_elapsed_time") / 1000.0


# --- logins, grants, sessions ---------------------------------------------------------------------

def logins(log: DataFrame, as_of: dt.datetime) -> DataFrame:
    failed, ip = F.col("is_success") == "NO", F.col("client_ip")
    return log.where(_since(as_of, 90, "event_timestamp")).select(
        "event_id", F.col("event_timestamp").alias("login_timestamp"), "user_name", "client_ip",
        F.col("reported_client_type").alias("client_type"), F.col("reported_client_version").alias("client_version"),
        F.col("first_authentication_factor").alias("auth_method"),
        F.col("second_authentication_factor").alias("mfa_method"), F.col("is_success").alias("login_success"),
        "error_code", "error_message",
        ordered_case((failed, "FAILED"), (F.col("second_authentication_factor").isNotNull(), "SUCCESS_MFA"),
                     otherwise="SUCCESS").alias("login_status"),
        ordered_case((failed, "HIGH"), (~ip.like("10.%") & ~ip.like("192.168.%"), "MEDIUM"),
                     otherwise="LOW").alias("risk_level"))


def role_grants(to_users: DataFrame, to_roles: DataFrame, as_of: dt.datetime) -> DataFrame:
    live = F.col("deleted_on").isNull() & _since(as_of, 180, "created_on")

    def shape(df: DataFrame, role: str, kind: str, grantee: str) -> DataFrame:
        return df.select(F.col("created_on").alias("grant_timestamp"), F.lit(kind).alias("grant_type"),
                         F.col(role).alias("granted_role"), "grantee_name", F.lit(grantee).alias("grantee_type"),
                         "granted_by", _role_sensitivity(role).alias("sensitivity_level"))

    inherited = to_roles.where((F.col("granted_on") == "ROLE") & (F.col("privilege") == "USAGE") & live)
    return shape(to_users.where(live), "role", "USER_GRANT", "USER").unionByName(
        shape(inherited, "name", "ROLE_GRANT", "ROLE"))


def privilege_escalation(to_roles: DataFrame, as_of: dt.datetime) -> DataFrame:
    privilege, name = F.col("privilege"), F.col("name")
    risky = ((privilege == "OWNERSHIP") | privilege.isin(POLICY_PRIVILEGES)
             | ((F.col("granted_on") == "ROLE") & name.isin(TOP_ADMINS)))
    return to_roles.where(risky & _since(as_of, 180, "created_on") & F.col("deleted_on").isNull()).select(
        F.col("created_on").alias("event_timestamp"), privilege.alias("privilege_granted"),
        F.col("granted_on").alias("object_type"), name.alias("object_name"), F.col("grantee_name").alias("grantee"),
        "granted_by", F.lit("HIGH_RISK").alias("risk_flag"),
        ordered_case((privilege == "OWNERSHIP", "OWNERSHIP_TRANSFER"),
                     (privilege.isin(POLICY_PRIVILEGES), "GOVERNANCE_PRIVILEGE"),
                     (name.isin("ACCOUNTADMIN", "SECURITYADMIN", "ORGADMIN"), "ADMIN_ROLE_GRANT"),
                     otherwise="OTHER_ESCALATION").alias("escalation_type"),
        ordered_case((name.isin("ACCOUNTADMIN", "ORGADMIN"), "CRITICAL"), (privilege == "OWNERSHIP", "CRITICAL"),
                     (name == "SECURITYADMIN", "HIGH"), (privilege.like("APPLY%"), "HIGH"),
                     otherwise="MEDIUM").alias("severity"))


def role_hierarchy(to_roles: DataFrame) -> DataFrame:
    return to_roles.where(F.col("name").like("INV_%") & (F.col("granted_on") == "ROLE")
                          & F.col("deleted_on").isNull()).select(
        F.col("name").alias("child_role"), F.col("grantee_name").alias("parent_role"), "granted_by", "created_on")


def inheritors(to_roles: DataFrame, role: str = "INV_READONLY") -> DataFrame:
    """Roles a base role is granted to."""
    return role_hierarchy(to_roles).where(F.col("child_role") == role).select(
        F.col("parent_role").alias("inherits_role"), "granted_by")


def admin_role_check(to_roles: DataFrame) -> DataFrame:
    """Whether each grant of a platform admin role goes to the system administrator."""
    return role_hierarchy(to_roles).where(F.col("child_role").isin(PLATFORM_ADMINS)).select(
        F.col("child_role").alias("admin_role"), "parent_role",
        F.when(F.col("parent_role") == "SYSADMIN", "Correct").otherwise("Check hierarchy").alias("validation_status"))


def sessions(log: DataFrame, as_of: dt.datetime) -> DataFrame:
    method = F.col("authentication_method")
    return log.where(_since(as_of, 90, "created_on")).select(
        "session_id", "user_name", F.col("created_on").alias("login_time"), F.col("is_open").alias("is_session_open"),
        "closed_reason", F.col("client_application_id").alias("client_application"),
        F.col("client_application_version").alias("client_version"), "client_environment", method.alias("auth_method"),
        ordered_case((F.col("is_open") & (hours_crossed("created_on", ts(as_of)) > 8), "EXTENDED_SESSION"),
                     (~method.like("%MFA%") & ~method.like("%MULTI%"), "NO_MFA"), otherwise="NORMAL").alias("session_flag"))


# --- queries on tagged data -----------------------------------------------------------------------

def _tagged(tags: DataFrame, name: str, values: list[str]) -> DataFrame:
    return tags.where((F.col("tag_database") == "INV_GOVERNANCE_DB") & (F.col("tag_schema") == "TAGS")
                      & (F.col("tag_name") == name) & F.col("tag_value").isin(values)).select(
        F.col("object_database").alias("database_name"), F.col("object_schema").alias("schema_name"),
        "object_name", "column_name", "tag_value")


def pii_access(queries: DataFrame, tags: DataFrame, as_of: dt.datetime, *, strict: bool = False) -> DataFrame:
    """Queries on personal-data columns.

    The report's filter has no parentheses around its OR: own clusters need only be recent, the shared
    cluster needs only a data verb and a tag. ``strict`` applies all tests to both.
    """
    matched = queries.join(_tagged(tags, "PII_CLASSIFICATION", ["DIRECT_PII", "QUASI_PII", "FINANCIAL"]),
                           ["database_name", "schema_name"], "left")
    own, shared = F.col("warehouse_name").like("INV_%"), F.col("warehouse_name") == "COMPUTE_WH"
    verb, tagged = F.col("query_type").isin(DATA_VERBS), F.col("tag_value").isNotNull()
    recent = _since(as_of, 90)
    wanted = recent & (own | shared) & verb & tagged if strict else (recent & own) | (shared & verb & tagged)
    tag = F.col("tag_value")
    return matched.where(wanted).select(
        "query_id", F.col("start_time").alias("access_timestamp"), "user_name", "role_name", "warehouse_name",
        F.col("database_name").alias("database_accessed"), F.col("schema_name").alias("schema_accessed"),
        F.coalesce("object_name", F.lit("UNKNOWN")).alias("table_accessed"),
        F.coalesce("column_name", F.lit("UNKNOWN")).alias("column_accessed"), tag.alias("pii_classification"),
        F.left("query_text", F.lit(500)).alias("query_text_preview"), "execution_status",
        _seconds().alias("execution_seconds"),
        ordered_case((tag == "DIRECT_PII", "CRITICAL"), (tag == "FINANCIAL", "HIGH"), (tag == "QUASI_PII", "MEDIUM"),
                     otherwise="LOW").alias("sensitivity_level"),
        F.when(~F.col("role_name").isin(CLIENT_DATA_ROLES) & (tag == "DIRECT_PII"), "POTENTIAL_VIOLATION")
        .otherwise("AUTHORIZED").alias("access_assessment"))


def _access(queries: DataFrame, tags: DataFrame, as_of: dt.datetime, tag: str, value: str, *,
            data_verbs: bool = True, columns: list[Column | str] = ()) -> DataFrame:
    wanted = _since(as_of, 90) & _platform()
    if data_verbs:
        wanted = wanted & F.col("query_type").isin(DATA_VERBS)
    return queries.where(wanted).join(_tagged(tags, tag, [value]), ["database_name", "schema_name"]).select(
        "query_id", F.col("start_time").alias("access_timestamp"), "user_name", "role_name", "warehouse_name",
        F.col("database_name").alias("database_accessed"), F.col("schema_name").alias("schema_accessed"),
        F.col("object_name").alias("table_accessed"), F.left("query_text", F.lit(500)).alias("query_text_preview"),
        "execution_status", *columns)


def quarantined_access(queries: DataFrame, tags: DataFrame, as_of: dt.datetime) -> DataFrame:
    return _access(queries, tags, as_of, "DATA_QUALITY_STATUS", "QUARANTINED", data_verbs=False, columns=[
        F.lit("QUARANTINED_ACCESS").alias("violation_type"), F.lit("HIGH").alias("severity"),
        F.when(F.col("role_name").isin(REMEDIATION_ROLES), "REMEDIATION_ACCESS").otherwise("POTENTIAL_VIOLATION")
        .alias("access_assessment")])


def retail_access(queries: DataFrame, tags: DataFrame, as_of: dt.datetime) -> DataFrame:
    allowed = F.col("role_name").isin(CLIENT_DATA_ROLES)
    return _access(queries, tags, as_of, "PII_CLASSIFICATION", "DIRECT_PII", columns=[
        F.col("column_name").alias("column_accessed"), F.lit("SEC_REG_SP_ACCESS").alias("regulatory_category"),
        F.when(allowed, "AUTHORIZED").otherwise("REQUIRES_REVIEW").alias("access_authorization"),
        F.when(~allowed, "CRITICAL").otherwise("LOGGED").alias("severity"),
        F.when(~allowed, "Verify business need for retail client PII access")
        .otherwise("Authorized client data access").alias("compliance_note")])


def confidential_access(queries: DataFrame, tags: DataFrame, as_of: dt.datetime) -> DataFrame:
    allowed = F.col("role_name").isin(CONFIDENTIAL_ROLES)
    return _access(queries, tags, as_of, "DATA_SENSITIVITY", "HIGHLY_CONFIDENTIAL", columns=[
        F.lit("HIGHLY_CONFIDENTIAL_ACCESS").alias("access_category"),
        F.when(allowed, "AUTHORIZED").otherwise("REQUIRES_REVIEW").alias("access_authorization"),
        F.when(~allowed, "HIGH").otherwise("LOGGED").alias("severity")])


def trading_access(queries: DataFrame, tags: DataFrame, as_of: dt.datetime) -> DataFrame:
    return _access(queries, tags, as_of, "DATA_DOMAIN", "TRANSACTIONS", columns=[
        F.col("rows_produced").alias("rows_returned"), F.lit("FINRA_3110_SUPERVISION").alias("regulatory_category"),
        ordered_case((_says("%DELETE%") | _says("%UPDATE%"), "HIGH"), (F.col("rows_produced") > 10_000, "MEDIUM"),
                     otherwise="LOW").alias("risk_level")])


# --- governance changes ---------------------------------------------------------------------------

def _change_columns() -> list[Column | str]:
    return ["query_id", F.col("start_time").alias("change_timestamp"), F.col("user_name").alias("changed_by"),
            F.col("role_name").alias("role_used"), F.col("query_type").alias("operation_type"),
            F.col("database_name").alias("target_database"), F.col("schema_name").alias("target_schema"),
            F.left("query_text", F.lit(1000)).alias("ddl_statement"), F.col("execution_status").alias("status"),
            "error_code", "error_message"]


def tag_changes(queries: DataFrame, as_of: dt.datetime) -> DataFrame:
    about = _says("%CREATE TAG%") | _says("%ALTER TAG%") | _says("%DROP TAG%") | _says("%SET TAG%") | _says("%UNSET TAG%")
    return queries.where(_since(as_of, 180) & F.col("query_type").isin(TAG_DDL) & about).select(
        *_change_columns(),
        ordered_case((_says("%DROP TAG%"), "CRITICAL"), (_says("%UNSET TAG%"), "HIGH"), (_says("%ALTER TAG%"), "MEDIUM"),
                     (_says("%SET TAG%"), "MEDIUM"), otherwise="LOW").alias("change_severity"))


def policy_changes(queries: DataFrame, as_of: dt.datetime) -> DataFrame:
    masking, row = _says("%MASKING POLICY%"), _says("%ROW ACCESS POLICY%")
    return queries.where(_since(as_of, 180) & F.col("query_type").isin(POLICY_DDL) & (masking | row)).select(
        *_change_columns(),
        ordered_case((masking, "MASKING_POLICY"), (row, "ROW_ACCESS_POLICY"), otherwise="OTHER_POLICY").alias("policy_type"),
        ordered_case((_says("%DROP%POLICY%"), "CRITICAL"), (_says("%ALTER%POLICY%"), "HIGH"),
                     (_says("%CREATE%POLICY%"), "MEDIUM"), otherwise="LOW").alias("change_severity"))


def admin_activity(queries: DataFrame, as_of: dt.datetime) -> DataFrame:
    kind, role = F.col("query_type"), F.col("role_name")
    return queries.where(_since(as_of, 90) & role.isin("ACCOUNTADMIN", "SECURITYADMIN", "SYSADMIN")
                         & (F.col("execution_status") == "SUCCESS")).select(
        "query_id", F.col("start_time").alias("activity_timestamp"), "user_name", role.alias("admin_role"),
        kind.alias("operation_type"), F.col("database_name").alias("target_database"),
        F.col("schema_name").alias("target_schema"), "warehouse_name",
        F.left("query_text", F.lit(500)).alias("query_text_preview"), F.col("execution_status").alias("status"),
        _seconds().alias("execution_seconds"), F.col("rows_produced").alias("rows_affected"),
        ordered_case((role == "ACCOUNTADMIN", "CRITICAL"), (role == "SECURITYADMIN", "HIGH"), (role == "SYSADMIN", "MEDIUM"),
                     otherwise="OTHER").alias("privilege_level"),
        ordered_case((kind.isin("GRANT", "REVOKE"), "PRIVILEGE_CHANGE"),
                     (kind.isin("CREATE_USER", "ALTER_USER", "DROP_USER"), "USER_MANAGEMENT"),
                     (kind.isin("CREATE_ROLE", "DROP_ROLE"), "ROLE_MANAGEMENT"),
                     (kind.like("CREATE%") | kind.like("DROP%"), "DDL_OPERATION"),
                     otherwise="OTHER_OPERATION").alias("activity_category"))


def _policy_usage(refs: DataFrame, policies: DataFrame, kind: str, name: str, levels: list[tuple[str, str]],
                  extra: list[Column]) -> DataFrame:
    used = refs.where((F.col("policy_kind") == kind) & F.col("ref_database_name").like("INV_%"))
    live = policies.where("deleted IS NULL").select(
        "policy_name", F.col("policy_catalog").alias("policy_db"), "policy_schema", "policy_owner",
        F.col("created").alias("policy_created"))
    level = ordered_case(*[(F.col("policy_name").like(p), v) for p, v in levels], otherwise="STANDARD")
    return used.join(live, ["policy_name", "policy_db", "policy_schema"]).select(
        F.col("policy_name").alias(name), F.col("policy_db").alias("policy_database"), "policy_schema",
        F.col("ref_database_name").alias("protected_database"), F.col("ref_schema_name").alias("protected_schema"),
        F.col("ref_entity_name").alias("protected_table"), *extra, F.col("ref_entity_domain").alias("object_type"),
        "policy_owner", "policy_created", level.alias("protection_level"))


def masking_usage(refs: DataFrame, policies: DataFrame) -> DataFrame:
    return _policy_usage(refs, policies, "MASKING_POLICY", "masking_policy_name",
                         [("%CLIENT_PII%", "CRITICAL"), ("%ACCOUNT%", "HIGH"), ("%FINANCIAL%", "HIGH")],
                         [F.col("ref_column_name").alias("protected_column")])


def row_policy_usage(refs: DataFrame, policies: DataFrame) -> DataFrame:
    return _policy_usage(refs, policies, "ROW_ACCESS_POLICY", "row_access_policy_name",
                         [("%CLIENT_TIER%", "HIGH"), ("%DATA_QUALITY%", "MEDIUM")], [])


def retention_status(tags: DataFrame, tables: DataFrame) -> DataFrame:
    kept = tags.where((F.col("tag_database") == "INV_GOVERNANCE_DB") & (F.col("tag_schema") == "TAGS")
                      & (F.col("tag_name") == "RETENTION_POLICY") & F.col("object_database").like("INV_%"))
    live = tables.where("deleted IS NULL").select(
        F.col("table_catalog").alias("object_database"), F.col("table_schema").alias("object_schema"),
        F.col("table_name").alias("object_name"), "created", "row_count", "bytes")
    policy = F.col("tag_value")
    years = ordered_case((policy == "7_YEARS", 7), (policy == "10_YEARS", 10), (policy == "1_YEAR", 1))
    return kept.join(live, ["object_database", "object_schema", "object_name"]).select(
        F.col("object_database").alias("database_name"), F.col("object_schema").alias("schema_name"),
        F.col("object_name").alias("table_name"), policy.alias("retention_policy"),
        F.col("created").alias("table_created"), "row_count", (dbl("bytes") / float(1024 ** 3)).alias("size_gb"),
        (F.col("created") + F.make_ym_interval(years)).cast("timestamp_ntz").alias("earliest_deletion_date"),
        ordered_case((policy == "PERMANENT", "NEVER_DELETE"), (policy.isNull(), "UNTAGGED_REVIEW_REQUIRED"),
                     otherwise="RETENTION_ACTIVE").alias("retention_status"),
        F.lit("17a-4").alias("regulatory_reference"))


# --- risk score -----------------------------------------------------------------------------------

def risk_score(queries: DataFrame, to_roles: DataFrame, tags: DataFrame, log: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Flat points per user for each kind of risky behaviour in 90 days.

    The four query counts come from one pass, grouped by user and database. Tag matches are counted per
    database first, so a query is never multiplied by the tags of its database: a user's count is the
    sum over databases of queries x tags.
    """
    recent = queries.where(_since(as_of, 90))
    outsider = ~F.col("role_name").isin(CLIENT_DATA_ROLES)
    admin = (F.col("role_name") == "ACCOUNTADMIN") & (F.col("execution_status") == "SUCCESS")
    by_db = recent.groupBy("user_name", "database_name").agg(
        F.count(F.when(admin, 1)).alias("_admin"), F.count("*").alias("_all"), F.count(F.when(outsider, 1)).alias("_out"))

    def is_tag(name: str, value: str) -> Column:
        return (F.col("tag_name") == name) & (F.col("tag_value") == value)

    pii, secret = is_tag("PII_CLASSIFICATION", "DIRECT_PII"), is_tag("DATA_SENSITIVITY", "HIGHLY_CONFIDENTIAL")
    tag_counts = tags.where(pii | secret).groupBy(F.col("object_database").alias("database_name")).agg(
        F.count(F.when(pii, 1)).alias("_pii_tags"), F.count(F.when(secret, 1)).alias("_secret_tags"))
    users = by_db.join(tag_counts, "database_name", "left").groupBy("user_name").agg(
        F.sum("_admin").alias("accountadmin_queries"),
        F.coalesce(F.sum(F.col("_all") * F.col("_pii_tags")), F.lit(0)).alias("pii_access_count"),
        F.coalesce(F.sum(F.col("_out") * F.col("_secret_tags")), F.lit(0)).alias("confidential_access_count"))
    escalations = to_roles.where(
        ((F.col("privilege") == "OWNERSHIP") | F.col("name").isin("ACCOUNTADMIN", "SECURITYADMIN"))
        & _since(as_of, 90, "created_on") & F.col("deleted_on").isNull()).groupBy(
        F.col("granted_by").alias("user_name")).agg(F.count("*").alias("privilege_escalations"))
    failures = log.where((F.col("is_success") == "NO") & _since(as_of, 90, "event_timestamp")).groupBy("user_name").agg(
        F.count("*").alias("failed_logins")).where("failed_logins >= 3")
    scored = users.join(escalations, "user_name", "left").join(failures, "user_name", "left").na.fill(
        0, ["privilege_escalations", "failed_logins"])
    counted = {"admin": "accountadmin_queries", "escalation": "privilege_escalations", "pii": "pii_access_count",
               "confidential": "confidential_access_count", "logins": "failed_logins"}
    # a query without a user name matches no user
    from_queries = ("accountadmin_queries", "pii_access_count", "confidential_access_count")
    scored = scored.withColumns({c: F.when(F.col("user_name").isNotNull(), F.col(c)).otherwise(0) for c in from_queries})
    score = sum((F.when(F.col(c) > 0, POINTS[k]).otherwise(0) for k, c in counted.items()), F.lit(0))
    scored = scored.withColumn("risk_score", score)
    return scored.select("user_name", *counted.values(), "risk_score",
                         ordered_case(*[(F.col("risk_score") >= low, band) for low, band in BANDS],
                                      otherwise="LOW").alias("risk_level"),
                         ts(as_of).alias("score_calculated_at"))
