"""Structure checks over catalogue listings (one row per database, schema, table or column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.measures import ordered_case

# fixed values: layers, expected schemas and declared measure columns
LAYERS = [("INV_RAW_DB", "BRONZE"), ("INV_TRANSFORM_DB", "SILVER"), ("INV_ANALYTICS_DB", "GOLD"),
          ("INV_AI_READY_DB", "PLATINUM")]
EXPECTED_SCHEMAS = {
    "INV_RAW_DB": ["MARKET_DATA", "PORTFOLIO_DATA", "REFERENCE_DATA", "STAGING"],
    "INV_TRANSFORM_DB": ["MASTER", "CLEANSED", "ENRICHED"],
    "INV_ANALYTICS_DB": ["PERFORMANCE", "RISK", "REPORTING", "CORE"],
    "INV_AI_READY_DB": ["FEATURES", "TRAINING", "PREDICTIONS", "EXPERIMENTS", "MODELS"],
    "INV_GOVERNANCE_DB": ["TAGS", "POLICIES", "MONITORING", "AUDIT", "SECURITY"],
}
MEASURE_COLUMNS = ["COST_BASIS", "MARKET_VALUE", "UNREALIZED_PNL", "BENCHMARK_VALUE", "GAIN_LOSS_PCT",
                   "ANNUALIZED_RETURN", "NAV_PER_SHARE", "ALPHA", "BETA", "DAILY_RETURN", "YTD_RETURN"]
KEY_COLUMNS = MEASURE_COLUMNS + ["SHARPE_RATIO"]


def layer(database: Column) -> Column:
    return ordered_case(*[(database == name, label) for name, label in LAYERS], otherwise="GOVERNANCE")


def layer_order(database: Column) -> Column:
    return ordered_case(*[(database == name, i) for i, (name, _) in enumerate(LAYERS, 1)], otherwise=5)


def counts_by_layer(listing: DataFrame, database: str, schema: str, name: str, hidden: list[str]) -> DataFrame:
    """Live objects per database with its layer, in layer order."""
    db = F.col("database_name")
    return (listing.where(F.col(database).like("INV_%") & ~F.col(schema).isin(hidden))
            .groupBy(F.col(database).alias("database_name")).agg(F.count("*").alias(name))
            .select("database_name", layer(db).alias("layer"), layer_order(db).alias("layer_order"), name)
            .orderBy("layer_order", "database_name"))


def column_contract(columns: DataFrame) -> DataFrame:
    live = ((F.col("table_catalog") == "INV_TRANSFORM_DB") & F.col("table_schema").isin("MASTER", "CLEANSED")
            & F.col("deleted").isNull() & F.col("column_name").isin(MEASURE_COLUMNS))
    return columns.where(live).select(
        "table_name", "column_name", "data_type",
        F.when(F.col("column_name").isin(KEY_COLUMNS), "Key Investment Column").otherwise("Supporting Column").alias("column_type"))


def schema_matrix(schemas: DataFrame) -> DataFrame:
    known = F.lit(False)
    for db, names in EXPECTED_SCHEMAS.items():
        known = known | ((F.col("catalog_name") == db) & F.col("schema_name").isin(names))
    return schemas.where(F.col("catalog_name").like("INV_%")
                         & ~F.col("schema_name").isin("INFORMATION_SCHEMA", "PUBLIC")).select(
        F.col("catalog_name").alias("database_name"), "schema_name",
        F.when(known, "Expected").otherwise("Additional").alias("schema_status"))
