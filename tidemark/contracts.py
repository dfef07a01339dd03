"""Declared tables: columns and types, defaults, keys. Column lists and types are fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import StructType

OPEN_END = "9999-12-31 00:00:00"


@dataclass(frozen=True)
class Contract:
    ddl: str
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    surrogate: str | None = None
    defaults: dict[str, object] = field(default_factory=dict)
    partition: str | None = None

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()


_RAW_TAIL = "source_system string, load_timestamp timestamp_ntz"

CONTRACTS: dict[str, Contract] = {
    # landing
    "raw_daily_prices": Contract(
        "record_id bigint, security_id string, price_date date, open_price decimal(18,6), high_price decimal(18,6), "
        "low_price decimal(18,6), close_price decimal(18,6), adjusted_close decimal(18,6), volume bigint, "
        "currency string, source_system string, source_file string, load_timestamp timestamp_ntz",
        surrogate="record_id"),
    "raw_corporate_actions": Contract(f"record_id bigint, raw_data variant, {_RAW_TAIL}", surrogate="record_id"),
    "raw_holdings": Contract(
        "record_id bigint, raw_data variant, portfolio_code string, as_of_date date, " + _RAW_TAIL, surrogate="record_id"),
    "raw_transactions": Contract(f"record_id bigint, raw_data variant, {_RAW_TAIL}", surrogate="record_id"),
    "raw_securities_master": Contract(f"record_id bigint, raw_data variant, {_RAW_TAIL}", surrogate="record_id"),
    # dimensions
    "dim_security": Contract(
        "security_key bigint, security_id string, isin string, cusip string, sedol string, ticker string, "
        "security_name string, security_type string, asset_class string, sub_asset_class string, sector string, "
        "industry string, country string, currency string, exchange string, benchmark_index string, "
        "expense_ratio decimal(8,4), fund_manager string, inception_date date, min_investment decimal(18,2), "
        "risk_rating string, is_active boolean, effective_from timestamp_ntz, effective_to timestamp_ntz, is_current boolean",
        required=("security_id",), surrogate="security_key",
        defaults={"is_active": True, "effective_to": OPEN_END, "is_current": True}),
    "dim_portfolio": Contract(
        "portfolio_key bigint, portfolio_id string, portfolio_name string, portfolio_type string, strategy string, "
        "benchmark_id string, inception_date date, base_currency string, fund_manager string, management_fee decimal(8,4), "
        "expense_ratio decimal(8,4), min_investment decimal(18,2), is_active boolean, effective_from timestamp_ntz, "
        "effective_to timestamp_ntz",
        required=("portfolio_id",), surrogate="portfolio_key", defaults={"is_active": True, "effective_to": OPEN_END}),
    "dim_date": Contract(
        "date_key bigint, calendar_date date, year bigint, quarter bigint, month bigint, month_name string, "
        "week_of_year bigint, day_of_week bigint, day_name string, is_weekend boolean, is_us_trading_day boolean, "
        "is_month_end boolean, is_quarter_end boolean, is_year_end boolean, fiscal_year bigint, fiscal_quarter bigint",
        required=("calendar_date",), unique=("date_key",)),
    # facts
    "fact_daily_prices": Contract(
        "price_id bigint, security_id string, trade_date date, open_price decimal(18,6), high_price decimal(18,6), "
        "low_price decimal(18,6), close_price decimal(18,6), adjusted_close decimal(18,6), volume bigint, "
        "vwap decimal(18,6), currency string, source_system string, load_timestamp timestamp_ntz",
        required=("security_id", "trade_date"), unique=("security_id", "trade_date"), surrogate="price_id",
        partition="trade_date"),
    "fact_holdings": Contract(
        "holding_id bigint, as_of_date date, portfolio_id string, security_id string, quantity decimal(18,4), "
        "market_value decimal(18,2), cost_basis decimal(18,2), unrealized_pnl decimal(18,2), weight_pct decimal(8,6), "
        "currency string, benchmark_value decimal(18,2), gain_loss_pct decimal(10,4), annualized_return decimal(10,4), "
        "holding_period_days bigint, load_timestamp timestamp_ntz",
        required=("as_of_date", "portfolio_id", "security_id"), surrogate="holding_id", partition="as_of_date"),
    "fact_transactions": Contract(
        "transaction_id string, trade_date date, settlement_date date, portfolio_id string, security_id string, "
        "transaction_type string, quantity decimal(18,4), price decimal(18,6), gross_amount decimal(18,2), "
        "commission decimal(18,2), fees decimal(18,2), net_amount decimal(18,2), currency string, broker string, "
        "status string, load_timestamp timestamp_ntz",
        required=("transaction_id", "trade_date", "portfolio_id", "security_id"), unique=("transaction_id",),
        partition="trade_date"),
    "fact_nav_history": Contract(
        "nav_id bigint, portfolio_id string, as_of_date date, nav_per_share decimal(18,6), total_nav decimal(18,2), "
        "shares_outstanding decimal(18,4), daily_return decimal(10,6), mtd_return decimal(10,6), qtd_return decimal(10,6), "
        "ytd_return decimal(10,6), benchmark_nav decimal(18,6), alpha decimal(10,6), beta decimal(10,6), "
        "load_timestamp timestamp_ntz",
        required=("portfolio_id", "as_of_date"), unique=("portfolio_id", "as_of_date"), surrogate="nav_id",
        partition="as_of_date"),
    # features, training sets, predictions
    "fact_price_features": Contract(
        "feature_id bigint, security_id string, feature_date date, close_price decimal(18,6), daily_return decimal(10,6), "
        "log_return decimal(10,6), sma_5 decimal(18,6), sma_20 decimal(18,6), sma_50 decimal(18,6), sma_200 decimal(18,6), "
        "ema_12 decimal(18,6), ema_26 decimal(18,6), volatility_20d decimal(10,6), volatility_60d decimal(10,6), "
        "rsi_14 decimal(8,4), macd decimal(10,6), macd_signal decimal(10,6), volume_sma_20 decimal(18,2), "
        "volume_ratio decimal(10,6), high_52w decimal(18,6), low_52w decimal(18,6), pct_from_high decimal(10,6), "
        "created_at timestamp_ntz",
        required=("security_id", "feature_date"), unique=("security_id", "feature_date"), surrogate="feature_id",
        partition="feature_date"),
    "fact_portfolio_features": Contract(
        "feature_id bigint, portfolio_id string, feature_date date, num_positions bigint, concentration_top5 decimal(8,6), "
        "concentration_top10 decimal(8,6), sector_hhi decimal(10,6), return_1d decimal(10,6), return_5d decimal(10,6), "
        "return_20d decimal(10,6), return_60d decimal(10,6), volatility_20d decimal(10,6), volatility_60d decimal(10,6), "
        "sharpe_60d decimal(10,6), max_drawdown_60d decimal(10,6), beta_to_benchmark decimal(10,6), created_at timestamp_ntz",
        required=("portfolio_id", "feature_date"), surrogate="feature_id", partition="feature_date"),
    "ds_return_prediction": Contract(
        "record_id bigint, security_id string, feature_date date, return_1d decimal(10,6), return_5d decimal(10,6), "
        "return_20d decimal(10,6), volatility_20d decimal(10,6), rsi_14 decimal(8,4), volume_ratio decimal(10,6), "
        "sma_cross bigint, forward_return_5d decimal(10,6), forward_return_20d decimal(10,6), direction_5d bigint, "
        "created_at timestamp_ntz", surrogate="record_id", partition="feature_date"),
    "fact_predictions": Contract(
        "prediction_id bigint, model_name string, model_version string, prediction_date date, security_id string, "
        "predicted_return decimal(10,6), predicted_direction bigint, confidence_score decimal(8,6), "
        "actual_return decimal(10,6), is_correct boolean, created_at timestamp_ntz", surrogate="prediction_id"),
}
