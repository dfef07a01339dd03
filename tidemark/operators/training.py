"""Labels, training sets and back-tests. A label only uses rows after its feature date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.clock import day
from tidemark.functions.measures import ordered_case, simple_return
from tidemark.operators.features import by_date


def lagged(features: DataFrame, columns: Sequence[str], lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    return features.withColumns({f"{c}_lag{n}": F.lag(c, n).over(by_date()) for c in columns for n in lags})


def labels(prices: DataFrame) -> DataFrame:
    """Forward 5- and 20-row returns and the 5-row direction (1 up, 0 otherwise); NULL near the end."""
    def ahead(n: int):
        return simple_return(F.lead("close_price", n).over(by_date()), "close_price")

    return prices.withColumns({"forward_return_5d": ahead(5), "forward_return_20d": ahead(20)}).withColumn(
        "direction_5d", F.when(F.col("forward_return_5d").isNotNull(), (F.col("forward_return_5d") > 0).cast("bigint")))


def sma_cross(features: DataFrame, fast: str = "sma_5", slow: str = "sma_20") -> DataFrame:
    """1 on the day the fast average rises above the slow one, -1 when it falls below, else 0."""
    side = F.signum(F.col(fast) - F.col(slow))
    out = features.withColumn("_side", side)
    before = F.lag("_side").over(by_date())
    return out.withColumn("sma_cross", ordered_case(
        ((F.col("_side") > 0) & (before <= 0), F.lit(1)), ((F.col("_side") < 0) & (before >= 0), F.lit(-1)),
        otherwise=F.lit(0)).cast("bigint")).drop("_side")


def as_of_features(labelled: DataFrame, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each labelled (security_id, trade_date) with the last features known on or before that date.

    Both inputs are joined by union and a running ``last``; a group holds at most two rows per day.
    """
    rest = [c for c in labelled.columns if c not in ("security_id", "trade_date")]
    known = features.select("security_id", "trade_date", F.struct("trade_date", *columns).alias("_f"))
    both = labelled.withColumn("_row", F.lit(True)).unionByName(known, allowMissingColumns=True)
    # features of the same day come first
    w = (Window.partitionBy("security_id").orderBy("trade_date", F.col("_row").asc_nulls_first())
         .rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_f", F.last("_f", ignorenulls=True).over(w)).where("_row")
    return found.select("security_id", "trade_date", *rest, F.col("_f.trade_date").alias("feature_date"),
                        *[F.col(f"_f.{c}").alias(c) for c in columns])


def dataset(labelled: DataFrame, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Point-in-time join of labels and features, rows with anything missing dropped."""
    return as_of_features(labelled, features, columns).na.drop()


def split(df: DataFrame, train_until: dt.date, validate_until: dt.date, date: str = "trade_date") -> DataFrame:
    """Split by cut-off dates (inclusive), so later rows never train earlier ones."""
    return df.withColumn("split", ordered_case(
        (F.col(date) <= day(train_until), "train"), (F.col(date) <= day(validate_until), "validation"), otherwise="test"))


def realised(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Predictions (model, version, security_id, prediction_date, direction, confidence) with the return that followed."""
    happened = outcomes.where("actual_return IS NOT NULL").select(
        "security_id", F.col("trade_date").alias("prediction_date"), "actual_return")
    return predictions.join(happened, ["security_id", "prediction_date"]).withColumn(
        "is_correct", (F.col("predicted_direction") == 1) == (F.col("actual_return") > 0))


def backtest(scored: DataFrame) -> DataFrame:
    """Accuracy per model, version and confidence band."""
    band = F.least(F.floor(F.col("confidence_score") * 10), F.lit(9)).cast("bigint").alias("confidence_band")
    hit = F.when(F.col("is_correct"), 1).otherwise(0)
    return scored.groupBy("model_name", "model_version", band).agg(
        F.count("*").alias("predictions"), F.sum(hit).alias("correct"),
        (F.sum(hit) / F.count("*")).alias("accuracy"), F.avg("actual_return").alias("avg_actual_return"))
