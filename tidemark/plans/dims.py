"""Reference tables: the asset universe, futures terms, frozen scores and texts. All are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values, in ranking order: asset, symbol, class, money basis, tier of its transmission, dislocation
#: model, strategic mode, back-test status, episodes.
ASSETS = (
    ("SPY", "SPY", "US EQUITY", "usd", "CORE", "absolute", "CORE_HARD_GATE", "SUPPORTED_BUT_FEW_EPISODES", 3),
    ("QQQ", "QQQ", "US GROWTH", "usd", "CORE", "absolute", "CORE_HARD_GATE", "INSUFFICIENT_SAMPLE", 1),
    ("IWM", "IWM", "US SMALL CAPS", "context", "RESEARCH", "relative_spy", "RESEARCH_CONTEXT_ONLY", "NOT_YET_VALIDATED", 0),
    ("GLD", "GLD", "GOLD", "fxn", "CORE", "real", "CORE_CONTEXT_ONLY", "DISLOCATION_NOT_INCREMENTALLY_SUPPORTED", 3),
    ("SLV", "SLV", "SILVER", "fxn", "RESEARCH", "real", "RESEARCH_CONTEXT_ONLY", "NOT_YET_VALIDATED", 0),
    ("DBC", "DBC", "BROAD COMMODITIES", "usd", "CORE", "real", "CORE_HARD_GATE", "MOST_PROMISING_CONTRARIAN_DISLOCATION", 5),
    ("USO", "USO", "WTI CRUDE OIL", "usd", "RESEARCH", "real", "RESEARCH_CONTEXT_ONLY", "NOT_YET_VALIDATED", 0),
    ("CPER", "CPER", "COPPER", "usd", "RESEARCH", "real", "RESEARCH_CONTEXT_ONLY", "NOT_YET_VALIDATED", 0),
    ("DBA", "DBA", "AGRICULTURE", "usd", "RESEARCH", "real", "RESEARCH_CONTEXT_ONLY", "NOT_YET_VALIDATED", 0),
    ("TLT", "TLT", "US LONG DURATION", "context", "RESEARCH", "real_yield_10y_high", "RESEARCH_DISLOCATION_PRIMARY", "MIXED_12M_POSITIVE_24_36M", 8),
    ("IEF", "IEF", "US INTERMEDIATE TREASURIES", "context", "RESEARCH", "real_yield_5y_high", "RESEARCH_DISLOCATION_PRIMARY", "NOT_YET_VALIDATED", 0),
    ("FXY", "FXY", "JAPANESE YEN", "context", "RESEARCH", "absolute", "RESEARCH_CONTEXT_ONLY", "NOT_YET_VALIDATED", 0),
    ("HYG", "HYG", "HIGH YIELD CREDIT", "context", "RESEARCH", "hy_oas_high", "RESEARCH_DATA_INCOMPLETE", "INSUFFICIENT_PUBLIC_HISTORY", 0),
    ("VNQ", "VNQ", "US REITS", "context", "RESEARCH", "relative_spy", "RESEARCH_CONTEXT_ONLY", "RELATIVE_DISLOCATION_NOT_SUPPORTED", 17),
    ("EEM", "EEM", "EM EQUITY", "context", "RESEARCH", "relative_spy", "RESEARCH_PROXY_HARD_GATE", "SUPPORTED_12_24M_MIXED_36M", 19),
    ("VEA", "VEA", "DEVELOPED EX-US", "context", "RESEARCH", "relative_spy", "RESEARCH_CONTEXT_ONLY", "RELATIVE_DISLOCATION_NOT_SUPPORTED", 17),
    ("BTC", "BTC-USD", "BITCOIN", "context", "RESEARCH", "none", "RESEARCH_NO_DISLOCATION_MODEL", "NOT_TESTED_COMPARABLE_DATA", 0),
)
ASSET_COLUMNS = "ordinal int, asset string, symbol string, asset_class string, money string, tier string, dislocation string, strategic_mode string, backtest string, episodes int"

#: Terms in market names (with the commodity name where the flag says so) by asset.
TERMS = (
    ("SPY", ["S&P 500", "E-MINI S&P", "MICRO E-MINI S&P"], False),
    ("QQQ", ["NASDAQ-100", "NASDAQ 100", "E-MINI NASDAQ", "MICRO E-MINI NASDAQ"], False),
    ("IWM", ["RUSSELL 2000", "E-MINI RUSSELL", "MICRO E-MINI RUSSELL"], False),
    ("TLT", ["10-YEAR U.S. TREASURY", "10 YEAR U.S. TREASURY", "U.S. TREASURY BOND", "TREASURY BONDS", "ULTRA U.S. TREASURY"], False),
    ("IEF", ["5-YEAR U.S. TREASURY", "5 YEAR U.S. TREASURY", "10-YEAR U.S. TREASURY", "10 YEAR U.S. TREASURY"], False),
    ("FXY", ["JAPANESE YEN", "YEN"], True),
    ("GLD", ["GOLD"], True),
    ("SLV", ["SILVER"], True),
    ("USO", ["CRUDE OIL", "WTI"], True),
    ("CPER", ["COPPER"], True),
    ("CORN", ["CORN"], True),
    ("WHEAT", ["WHEAT"], True),
    ("SOYBEAN", ["SOYBEAN"], True),
    ("SUGAR", ["SUGAR"], True),
    ("COFFEE", ["COFFEE"], True),
)
#: Baskets, their components among the terms, and how many they need.
BASKETS = {"DBC": (("USO", "CPER", "CORN", "WHEAT"), 2), "DBA": (("CORN", "WHEAT", "SOYBEAN", "SUGAR", "COFFEE"), 3)}

#: The last validated money vintage, the newer candidate, and the overlays.
STATE = {
    "usd_z": 0.9421742066088, "usd_score": 65.70290344348, "fxn_z": -0.4191532308133366, "fxn_score": 43.01411281977772,
    "money_date": "2026-02-28", "freshness": "STALE", "candidate_date": "2026-06-30", "candidate_usd": 59.68584363312337, "candidate_fxn": 45.31710699344927,
    "funding_z": -0.8378753440785458, "funding_score": 36.035410932024234, "funding_date": "2026-07-31", "credit_score": 54.51530771865234, "fiscal_score": 52.539556447652046,
    "promotion_gate": "BLOCKED_MISSING_FROZEN_INPUT_BYTES",
}
#: The last verified money growth of each block, and its reference.
NOWCAST = (
    (0, "us", "US", "2026-06", 5.5258, 4.6887),
    (1, "euro_area", "EA", "2026-06", 3.2931, 2.82),
    (2, "japan", "JP", "2026-07", 2.2, 1.7),
    (3, "china", "CN", "2026-07", 7.7, 9.0),
)


def assets(spark: SparkSession) -> DataFrame:
    """The universe, with its ranking order."""
    return spark.createDataFrame([(i, *a) for i, a in enumerate(ASSETS)], ASSET_COLUMNS)


def terms(spark: SparkSession, rows=TERMS) -> DataFrame:
    return spark.createDataFrame(list(rows), "asset string, terms array<string>, with_commodity boolean")


def baskets(spark: SparkSession, rows=BASKETS) -> DataFrame:
    return spark.createDataFrame([(b, c, least) for b, (parts, least) in rows.items() for c in parts], "basket string, component string, least int")


def nowcast_blocks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOWCAST), "ordinal int, block string, short string, latest_date string, latest_yoy double, reference_yoy double")
