"""Column masks and row filters by role. The role is a literal, so Catalyst folds the role tests away."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: which roles see what
PII_FULL = ["INV_DATA_ADMIN", "INV_ML_ADMIN", "INV_ANALYST", "ACCOUNTADMIN"]
PII_LAST4 = ["INV_DATA_ENGINEER", "INV_ML_ENGINEER"]
CLIENT_FULL = ["INV_DATA_ADMIN", "INV_ANALYST", "ACCOUNTADMIN"]
AMOUNT_FULL = ["INV_DATA_ADMIN", "INV_ML_ADMIN", "INV_ANALYST", "INV_DATA_ENGINEER", "INV_ML_ENGINEER", "ACCOUNTADMIN"]
DATA_TEAM = ["INV_DATA_ADMIN", "INV_DATA_ENGINEER", "ACCOUNTADMIN"]
ENGINEERS = ["INV_DATA_ENGINEER", "INV_ML_ENGINEER"]
HELD_BACK = ["UNDER_REVIEW", "QUARANTINED", "DEPRECATED"]


def _role(role: Column | str) -> Column:
    return F.lit(role) if isinstance(role, str) else role


def _last4(value: Column) -> Column:
    return F.right(value, F.lit(4))


def mask_client_pii(value: Column, role: Column | str) -> Column:
    """Whole value, stars with the last four characters, or a fixed text; NULL stays NULL for engineers only."""
    length = F.length(value)
    partial = F.when(length > 4, F.concat(F.repeat(F.lit("*"), length - 4), _last4(value))) \
               .otherwise(F.repeat(F.lit("*"), length))
    return (F.when(_role(role).isin(PII_FULL), value).when(_role(role).isin(PII_LAST4), partial)
            .otherwise("***MASKED***"))


def mask_account_number(value: Column, role: Column | str) -> Column:
    return (F.when(_role(role).isin(CLIENT_FULL), value)
            .when(F.length(value) > 4, F.concat(F.lit("****-****-"), _last4(value))).otherwise("****"))


def mask_financial_amount(value: Column, role: Column | str) -> Column:
    return F.when(_role(role).isin(AMOUNT_FULL), value)


def mask_phone_email(value: Column, role: Column | str) -> Column:
    return (F.when(_role(role).isin(CLIENT_FULL), value)
            .when(F.contains(value, F.lit("@")), F.concat(F.left(value, F.lit(2)), F.lit("***@***.com")))
            .when(F.length(value) >= 10, F.concat(F.lit("***-***-"), _last4(value))).otherwise("***"))


def sees_quality(status: Column, role: Column | str) -> Column:
    """Certified rows for all, held-back rows for the data team, rows without a known status for all."""
    return F.when(status.isin(HELD_BACK), _role(role).isin(DATA_TEAM)).otherwise(True)


def sees_client(tier: Column, role: Column | str) -> Column:
    """All rows for admins and analysts, institutional ones for engineers, rows of unknown tier for all."""
    return (F.when(_role(role).isin(CLIENT_FULL), True)
            .when(tier == "INSTITUTIONAL", _role(role).isin(ENGINEERS))
            .when(tier == "RETAIL", False).otherwise(True))


MASKS = {"MASK_CLIENT_PII": mask_client_pii, "MASK_ACCOUNT_NUMBER": mask_account_number,
         "MASK_FINANCIAL_AMOUNT": mask_financial_amount, "MASK_PHONE_EMAIL": mask_phone_email}
ROW_FILTERS = {"ROW_ACCESS_DATA_QUALITY": sees_quality, "ROW_ACCESS_CLIENT_TIER": sees_client}
# treatment of a classification; columns tagged NON_PII or not at all stay as they are
MASK_FOR_TAG = {"DIRECT_PII": mask_client_pii, "QUASI_PII": mask_phone_email, "FINANCIAL": mask_financial_amount}
