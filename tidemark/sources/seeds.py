"""Reference rows given inline, named by position. The rows are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# company, ticker, sector, industry
STOCKS = [
    ("Apple Inc", "AAPL", "Technology", "Consumer Electronics"),
    ("Microsoft Corporation", "MSFT", "Technology", "Software"),
    ("Amazon.com Inc", "AMZN", "Consumer Discretionary", "E-Commerce"),
    ("Alphabet Inc", "GOOGL", "Technology", "Internet Services"),
    ("Tesla Inc", "TSLA", "Consumer Discretionary", "Automobiles"),
    ("NVIDIA Corporation", "NVDA", "Technology", "Semiconductors"),
    ("Meta Platforms Inc", "META", "Technology", "Social Media"),
    ("Berkshire Hathaway", "BRK.B", "Financials", "Diversified Financials"),
    ("JPMorgan Chase & Co", "JPM", "Financials", "Banking"),
    ("Johnson & Johnson", "JNJ", "Healthcare", "Pharmaceuticals"),
    ("Visa Inc", "V", "Financials", "Payment Processing"),
    ("UnitedHealth Group", "UNH", "Healthcare", "Health Insurance"),
    ("Procter & Gamble", "PG", "Consumer Staples", "Household Products"),
    ("Mastercard Inc", "MA", "Financials", "Payment Processing"),
    ("Home Depot Inc", "HD", "Consumer Discretionary", "Home Improvement"),
    ("Chevron Corporation", "CVX", "Energy", "Oil & Gas"),
    ("Eli Lilly and Company", "LLY", "Healthcare", "Pharmaceuticals"),
    ("AbbVie Inc", "ABBV", "Healthcare", "Biotechnology"),
    ("Costco Wholesale", "COST", "Consumer Staples", "Retail"),
    ("Coca-Cola Company", "KO", "Consumer Staples", "Beverages"),
    ("PepsiCo Inc", "PEP", "Consumer Staples", "Beverages"),
    ("Walmart Inc", "WMT", "Consumer Staples", "Retail"),
    ("Exxon Mobil Corp", "XOM", "Energy", "Oil & Gas"),
    ("Adobe Inc", "ADBE", "Technology", "Software"),
    ("Salesforce Inc", "CRM", "Technology", "Cloud Computing"),
    ("Netflix Inc", "NFLX", "Communication Services", "Streaming"),
    ("Intel Corporation", "INTC", "Technology", "Semiconductors"),
    ("Cisco Systems Inc", "CSCO", "Technology", "Networking"),
    ("Oracle Corporation", "ORCL", "Technology", "Enterprise Software"),
    ("Walt Disney Company", "DIS", "Communication Services", "Entertainment"),
    ("PayPal Holdings", "PYPL", "Financials", "Payment Processing"),
    ("Goldman Sachs Group", "GS", "Financials", "Investment Banking"),
    ("Morgan Stanley", "MS", "Financials", "Investment Banking"),
    ("Bank of America", "BAC", "Financials", "Banking"),
    ("Wells Fargo & Co", "WFC", "Financials", "Banking"),
    ("Caterpillar Inc", "CAT", "Industrials", "Machinery"),
    ("Boeing Company", "BA", "Industrials", "Aerospace"),
    ("3M Company", "MMM", "Industrials", "Conglomerate"),
    ("General Electric", "GE", "Industrials", "Conglomerate"),
    ("Lockheed Martin", "LMT", "Industrials", "Defense"),
    ("Raytheon Technologies", "RTX", "Industrials", "Defense"),
    ("American Express", "AXP", "Financials", "Credit Services"),
    ("Target Corporation", "TGT", "Consumer Discretionary", "Retail"),
    ("Starbucks Corporation", "SBUX", "Consumer Discretionary", "Restaurants"),
    ("McDonalds Corporation", "MCD", "Consumer Discretionary", "Restaurants"),
    ("Nike Inc", "NKE", "Consumer Discretionary", "Apparel"),
    ("Qualcomm Inc", "QCOM", "Technology", "Semiconductors"),
    ("Texas Instruments", "TXN", "Technology", "Semiconductors"),
    ("Broadcom Inc", "AVGO", "Technology", "Semiconductors"),
    ("Applied Materials", "AMAT", "Technology", "Semiconductors"),
]
# fund, ticker, category, strategy
FUNDS = [
    ("Vanguard 500 Index Fund", "VFIAX", "Large Cap Blend", "Index"),
    ("Fidelity Contrafund", "FCNTX", "Large Cap Growth", "Active"),
    ("Vanguard Total Stock Market", "VTSAX", "Total Market", "Index"),
    ("T. Rowe Price Blue Chip Growth", "TRBCX", "Large Cap Growth", "Active"),
    ("Fidelity Growth Company", "FDGRX", "Large Cap Growth", "Active"),
    ("Vanguard Growth Index", "VIGAX", "Large Cap Growth", "Index"),
    ("American Funds Growth Fund", "AGTHX", "Large Cap Growth", "Active"),
    ("Vanguard Value Index", "VVIAX", "Large Cap Value", "Index"),
    ("Dodge & Cox Stock Fund", "DODGX", "Large Cap Value", "Active"),
    ("Fidelity Low-Priced Stock", "FLPSX", "Mid Cap Value", "Active"),
    ("Vanguard Mid-Cap Index", "VIMAX", "Mid Cap Blend", "Index"),
    ("T. Rowe Price Mid-Cap Growth", "RPMGX", "Mid Cap Growth", "Active"),
    ("Vanguard Small Cap Index", "VSMAX", "Small Cap Blend", "Index"),
    ("Fidelity Small Cap Discovery", "FSCRX", "Small Cap Growth", "Active"),
    ("Vanguard International Growth", "VWIGX", "International Growth", "Active"),
    ("Fidelity International Index", "FSPSX", "International Blend", "Index"),
    ("American Funds EuroPacific", "AEPGX", "International Growth", "Active"),
    ("Vanguard Emerging Markets", "VEMAX", "Emerging Markets", "Index"),
    ("T. Rowe Price Emerging Markets", "PRMSX", "Emerging Markets", "Active"),
    ("Vanguard Total Bond Market", "VBTLX", "Intermediate Bond", "Index"),
    ("PIMCO Total Return", "PTTRX", "Intermediate Bond", "Active"),
    ("Fidelity US Bond Index", "FXNAX", "Intermediate Bond", "Index"),
    ("Vanguard High-Yield Corporate", "VWEHX", "High Yield Bond", "Active"),
    ("BlackRock High Yield Bond", "BHYAX", "High Yield Bond", "Active"),
    ("Vanguard Balanced Index", "VBIAX", "Balanced", "Index"),
    ("Fidelity Balanced Fund", "FBALX", "Balanced", "Active"),
    ("Vanguard Target Retirement 2030", "VTHRX", "Target Date", "Index"),
    ("Fidelity Freedom 2035", "FFTHX", "Target Date", "Active"),
    ("Vanguard REIT Index", "VGSLX", "Real Estate", "Index"),
    ("Fidelity Real Estate Income", "FRIFX", "Real Estate", "Active"),
    ("Vanguard Health Care Fund", "VGHCX", "Healthcare", "Active"),
    ("Fidelity Select Technology", "FSPTX", "Technology", "Active"),
    ("T. Rowe Price Science & Tech", "PRSCX", "Technology", "Active"),
    ("Vanguard Energy Fund", "VGENX", "Energy", "Active"),
    ("Fidelity Select Financial", "FIDSX", "Financials", "Active"),
    ("Invesco QQQ Trust", "QQQ", "Large Cap Growth", "Index"),
    ("SPDR S&P 500 ETF", "SPY", "Large Cap Blend", "Index"),
    ("iShares Core S&P 500", "IVV", "Large Cap Blend", "Index"),
    ("Vanguard S&P 500 ETF", "VOO", "Large Cap Blend", "Index"),
    ("iShares Russell 2000", "IWM", "Small Cap Blend", "Index"),
]


def inline(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """Rows of text with columns named by position, plus their place in the list."""
    numbered = [(i, *row) for i, row in enumerate(rows)]
    types = ", ".join(f"column{i} string" for i in range(1, len(names) + 1))
    return spark.createDataFrame(numbered, f"place int, {types}").toDF("place", *names)


def stock_names(spark: SparkSession) -> DataFrame:
    return inline(spark, STOCKS, ["company_name", "ticker", "sector", "industry"])


def fund_names(spark: SparkSession) -> DataFrame:
    return inline(spark, FUNDS, ["fund_name", "ticker", "category", "strategy"])
