"""Masks, row filters, tags and catalogue checks."""

from pyspark.sql import functions as F

from tidemark.functions import policies as p
from tidemark.operators import catalog, governance as g
from tidemark.plans.registry import plain, query
from tidemark.plans.sqlbase import r, using
from tidemark.sources.bindings import AS_OF_LOG, ROLES, TAG_VALUES


def names(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


SEEN_AS = ["INV_DATA_ADMIN", "INV_ML_ADMIN", "INV_DATA_ENGINEER", "INV_READONLY"]


def _mask_sql(column: str, case: str) -> str:
    cols = ", ".join(f"{case.replace(':role', chr(39) + role + chr(39))} AS {role.lower()}" for role in SEEN_AS)
    return using("clients") + f"SELECT client_id, {cols} FROM clients"


def _masked(t, column, mask):
    return t.clients().select("client_id", *[mask(F.col(column), role).alias(role.lower()) for role in SEEN_AS])


@query("mask_client_pii", _mask_sql("client_name", f"""CASE WHEN :role IN {names(p.PII_FULL)} THEN client_name
    WHEN :role IN {names(p.PII_LAST4)} THEN CASE WHEN length(client_name) > 4
      THEN repeat('*', length(client_name) - 4) || right(client_name, 4) ELSE repeat('*', length(client_name)) END
    ELSE '***MASKED***' END"""))
def _(t):
    return _masked(t, "client_name", p.mask_client_pii)


@query("mask_account_number", _mask_sql("account_number", f"""CASE WHEN :role IN {names(p.CLIENT_FULL)} THEN account_number
    WHEN length(account_number) > 4 THEN '****-****-' || right(account_number, 4) ELSE '****' END"""))
def _(t):
    return _masked(t, "account_number", p.mask_account_number)


@query("mask_financial_amount", _mask_sql("balance", f"CASE WHEN :role IN {names(p.AMOUNT_FULL)} THEN balance END"))
def _(t):
    return _masked(t, "balance", p.mask_financial_amount)


CONTACT = """CASE WHEN :role IN %s THEN {c} WHEN contains({c}, '@') THEN left({c}, 2) || '***@***.com'
    WHEN length({c}) >= 10 THEN '***-***-' || right({c}, 4) ELSE '***' END""" % names(p.CLIENT_FULL)


@query("mask_phone_email", using("clients") + "SELECT client_id, " + ", ".join(
    f"{CONTACT.format(c=c).replace(':role', chr(39) + role + chr(39))} AS {c}_{role.lower()}"
    for c in ("email", "phone") for role in SEEN_AS) + " FROM clients")
def _(t):
    return t.clients().select("client_id", *[p.mask_phone_email(F.col(c), role).alias(f"{c}_{role.lower()}")
                                             for c in ("email", "phone") for role in SEEN_AS])


QUALITY = f"""CASE WHEN dq_status = 'CERTIFIED' THEN TRUE WHEN dq_status IN ('UNDER_REVIEW', 'QUARANTINED', 'DEPRECATED')
    THEN :role IN {names(p.DATA_TEAM)} ELSE TRUE END"""
TIER = f"""CASE WHEN :role IN {names(p.CLIENT_FULL)} THEN TRUE WHEN client_tier = 'INSTITUTIONAL' THEN :role IN {names(p.ENGINEERS)}
    WHEN client_tier = 'RETAIL' THEN :role IN {names(p.CLIENT_FULL)} ELSE TRUE END"""


def _rows_sql(case: str, column: str) -> str:
    return using("clients") + " UNION ALL ".join(
        f"SELECT '{role}' AS seen_by, client_id, {column} FROM clients WHERE {case.replace(':role', chr(39) + role + chr(39))}"
        for role in ROLES)


def _rows(t, column, rule):
    """All roles in one pass: each row is repeated for the roles that see it."""
    roles = F.array(*[F.when(rule(F.col(column), role), role) for role in ROLES])
    return t.clients().select(F.explode(F.array_compact(roles)).alias("seen_by"), "client_id", column)


@query("row_filter_data_quality", _rows_sql(QUALITY, "dq_status"))
def _(t):
    return _rows(t, "dq_status", p.sees_quality)


@query("row_filter_client_tier", _rows_sql(TIER, "client_tier"))
def _(t):
    return _rows(t, "client_tier", p.sees_client)


@query("governed_read", using("clients") + f"""SELECT client_id, '***MASKED***' AS client_name, CASE WHEN length(account_number) > 4
    THEN '****-****-' || right(account_number, 4) ELSE '****' END AS account_number, CAST(NULL AS DOUBLE) AS balance,
    client_tier FROM clients WHERE {TIER.replace(':role', "'INV_READONLY'")}""")
def _(t):
    return g.governed(
        t.clients(), "INV_READONLY", filters={"client_tier": "ROW_ACCESS_CLIENT_TIER"},
        masks={"client_name": "MASK_CLIENT_PII", "account_number": "MASK_ACCOUNT_NUMBER", "balance": "MASK_FINANCIAL_AMOUNT"},
    ).select("client_id", "client_name", "account_number", "balance", "client_tier")


# tag values above the column level for the inheritance query
HIGHER = [("INV_RAW_DB", None, None, None, "BRONZE"), ("INV_TRANSFORM_DB", None, None, None, "SILVER"),
          ("INV_ANALYTICS_DB", None, None, None, "GOLD"), ("INV_ANALYTICS_DB", "CORE", None, None, "SILVER"),
          ("INV_AI_READY_DB", "FEATURES", None, None, "PLATINUM")]
HIGHER_SQL = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in HIGHER)
PATH = "object_database, object_schema, object_name, column_name"


@query("tag_effective", using("tag_refs", tags=f"""SELECT {PATH}, tag_value FROM tag_refs WHERE tag_name = 'MEDALLION_LAYER'
      UNION ALL SELECT object_database, object_schema, object_name, NULL, 'GOLD' FROM tag_refs WHERE tag_name = 'DATA_DOMAIN'
      UNION ALL SELECT * FROM (VALUES {HIGHER_SQL}) AS h({PATH}, tag_value)""") + f"""
    SELECT c.object_database, c.object_schema, c.object_name, c.column_name,
    coalesce(l4.v, l3.v, l2.v, l1.v) AS tag_value, CASE WHEN l4.v IS NOT NULL THEN 'column' WHEN l3.v IS NOT NULL THEN 'table'
    WHEN l2.v IS NOT NULL THEN 'schema' WHEN l1.v IS NOT NULL THEN 'database' END AS tag_level FROM tag_refs c
    LEFT JOIN (SELECT object_database, min(tag_value) AS v FROM tags WHERE object_schema IS NULL GROUP BY 1) l1 USING (object_database)
    LEFT JOIN (SELECT object_database, object_schema, min(tag_value) AS v FROM tags WHERE object_name IS NULL
      AND object_schema IS NOT NULL GROUP BY 1, 2) l2 USING (object_database, object_schema)
    LEFT JOIN (SELECT object_database, object_schema, object_name, min(tag_value) AS v FROM tags WHERE column_name IS NULL
      AND object_name IS NOT NULL GROUP BY 1, 2, 3) l3 USING (object_database, object_schema, object_name)
    LEFT JOIN (SELECT {PATH}, min(tag_value) AS v FROM tags WHERE column_name IS NOT NULL GROUP BY ALL) l4
      USING ({PATH})""")
def _(t):
    refs = t.tag_references()
    path = PATH.split(", ")
    layer = F.lit("MEDALLION_LAYER").alias("tag_name")
    own = refs.where("tag_name = 'MEDALLION_LAYER'").select(*path, "tag_name", "tag_value")
    table = refs.where("tag_name = 'DATA_DOMAIN'").select(
        *path[:3], F.lit(None).cast("string").alias("column_name"), layer, F.lit("GOLD").alias("tag_value"))
    higher = t.spark.createDataFrame(HIGHER, ", ".join(f"{c} string" for c in path + ["tag_value"])).select(*path, layer, "tag_value")
    return g.effective_tags(refs.select(*path), own.unionByName(table).unionByName(higher), "MEDALLION_LAYER")


@query("tag_driven_policy", using("clients") + f"""SELECT client_id, repeat('*', length(client_name) - 4) || right(client_name, 4)
    AS client_name, CASE WHEN length(phone) >= 10 THEN '***-***-' || right(phone, 4) ELSE '***' END AS phone, balance, client_tier
    FROM clients""")
def _(t):
    tags = t.governed_tags()
    found = {c.lower(): v for c, v in g.column_classification(tags, "INV_TRANSFORM_DB", "MASTER", "DIM_CLIENT").items()}
    client = t.clients().select("client_id", "client_name", "phone", "balance", "client_tier")
    return g.mask_by_tag(client, "INV_ML_ENGINEER", {c: found[c] for c in client.columns if c in found} | {"balance": "FINANCIAL"})


@query("tag_catalogue", using("tag_refs") + """SELECT tag_name, tag_value, count(*) AS objects,
    count(DISTINCT object_database) AS databases, min(object_name) AS first_object FROM tag_refs
    WHERE tag_database = 'INV_GOVERNANCE_DB' GROUP BY 1, 2""")
def _(t):
    return g.tag_catalogue(t.tag_references())


@query("retention_expiry_rows", f"""SELECT o_orderkey, o_orderdate, policy FROM (SELECT *,
    (['7_YEARS', '10_YEARS', 'PERMANENT', '1_YEAR'])[CAST(o_custkey % 4 AS INTEGER) + 1] AS policy FROM orders)
    WHERE CASE policy WHEN '7_YEARS' THEN o_orderdate + INTERVAL 7 YEAR WHEN '10_YEARS' THEN o_orderdate + INTERVAL 10 YEAR
    WHEN '1_YEAR' THEN o_orderdate + INTERVAL 1 YEAR END < TIMESTAMP '2004-11-05 00:00:00'""")
def _(t):
    import datetime as dt
    from tidemark.functions.measures import pick
    orders = t.raw("orders").withColumn("policy", pick(TAG_VALUES["RETENTION_POLICY"], F.col("o_custkey")))
    return g.retention_expired(orders, F.col("policy"), "o_orderdate", dt.datetime(2004, 11, 5)).select(
        "o_orderkey", "o_orderdate", "policy")


# --- catalogue ------------------------------------------------------------------------------------

LAYER = "CASE db " + " ".join(f"WHEN '{n}' THEN '{v}'" for n, v in catalog.LAYERS) + " ELSE 'GOVERNANCE' END AS layer"
ORDER = "CASE db " + " ".join(f"WHEN '{n}' THEN {i}" for i, (n, _) in enumerate(catalog.LAYERS, 1)) + " ELSE 5 END AS layer_order"


@query("schema_counts_by_layer", using("cat_tables") + f"""SELECT db AS database_name, {LAYER}, {ORDER}, schema_count FROM (
    SELECT table_catalog AS db, count(DISTINCT table_schema) AS schema_count FROM cat_tables WHERE deleted IS NULL
    AND table_catalog LIKE 'INV_%' AND table_schema NOT IN ('INFORMATION_SCHEMA', 'PUBLIC') GROUP BY 1)""")
def _(t):
    return catalog.counts_by_layer(t.catalog_schemas(), "catalog_name", "schema_name", "schema_count",
                                   ["INFORMATION_SCHEMA", "PUBLIC"])


@query("table_counts_by_layer", using("cat_tables") + f"""SELECT db AS database_name, {LAYER}, {ORDER}, table_count FROM (
    SELECT table_catalog AS db, count(*) AS table_count FROM cat_tables WHERE deleted IS NULL
    AND table_catalog LIKE 'INV_%' AND table_schema NOT IN ('INFORMATION_SCHEMA') GROUP BY 1)""")
def _(t):
    return catalog.counts_by_layer(t.catalog_tables().where("deleted IS NULL"), "table_catalog", "table_schema",
                                   "table_count", ["INFORMATION_SCHEMA"])


COLUMNS_SQL = """SELECT *, ([%s])[CAST((row_count // 1000) %% 13 AS INTEGER) + 1] AS column_name,
    (['NUMBER', 'TEXT'])[CAST((row_count // 1000) %% 2 AS INTEGER) + 1] AS data_type FROM cat_tables""" % ", ".join(
        f"'{c}'" for c in catalog.MEASURE_COLUMNS + ["TICKER", "SECTOR"])


@query("column_contract_check", using("cat_tables", c=COLUMNS_SQL) + f"""SELECT table_name, column_name, data_type,
    CASE WHEN column_name IN {names(catalog.KEY_COLUMNS)} THEN 'Key Investment Column' ELSE 'Supporting Column' END AS column_type
    FROM c WHERE table_catalog = 'INV_TRANSFORM_DB' AND table_schema IN ('MASTER', 'CLEANSED') AND deleted IS NULL
    AND column_name IN {names(catalog.MEASURE_COLUMNS)}""")
def _(t):
    return catalog.column_contract(t.catalog_columns())


EXPECTED = " OR ".join(f"(table_catalog = '{db}' AND table_schema IN {names(v)})" for db, v in catalog.EXPECTED_SCHEMAS.items())


@query("schema_matrix_check", using("cat_tables") + f"""SELECT DISTINCT table_catalog AS database_name, table_schema AS schema_name,
    CASE WHEN {EXPECTED} THEN 'Expected' ELSE 'Additional' END AS schema_status FROM cat_tables WHERE deleted IS NULL
    AND table_catalog LIKE 'INV_%' AND table_schema NOT IN ('INFORMATION_SCHEMA', 'PUBLIC')""")
def _(t):
    return catalog.schema_matrix(t.catalog_schemas())
