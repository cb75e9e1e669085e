"""Score history: latest, recent, change over time and sparkline geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec


def _newest() -> WindowSpec:
    return W.partitionBy("url").orderBy(F.desc("timestamp"), F.desc("id"))


def for_url(history: DataFrame, url: str, limit: int = 20) -> DataFrame:
    """The newest runs of one URL: the filter reaches the scan, the limit a top-k."""
    own = history.where(F.col("url") == url).select("id", "url", "timestamp", "score", "verdict")
    return own.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def recent(history: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs of every URL, with their rank; a rank filter over a window prunes before the shuffle."""
    ranked = history.select("id", "url", "timestamp", "score", "verdict").withColumn("rn", F.row_number().over(_newest()).cast("long"))
    return ranked.where(F.col("rn") <= limit)


def latest(history: DataFrame, limit: int = 100) -> DataFrame:
    """url, latest, score, verdict of the newest run of each URL, newest first: one aggregation, no window."""
    last = F.max(F.struct("timestamp", "id", "score", "verdict")).alias("x")
    df = history.groupBy("url").agg(last).select("url", F.col("x.timestamp").alias("latest"), "x.score", "x.verdict")
    return df.orderBy(F.desc("latest"), "url").limit(limit)


def delta(history: DataFrame) -> DataFrame:
    """url, runs, first_score, last_score, delta and its text."""
    key = F.struct("timestamp", "id")
    df = history.groupBy("url").agg(
        F.count("*").alias("runs"), F.min_by("score", key).alias("first_score"), F.max_by("score", key).alias("last_score")
    )
    change = F.col("last_score") - F.col("first_score")
    text = F.concat(F.when(change >= 0, "+").otherwise(""), F.format_string("%.1f", change))
    return df.select("*", F.round(change, 6).alias("delta"), text.alias("delta_text"))


def sparkline(history: DataFrame, width: float = 252.0, height: float = 40.0) -> DataFrame:
    """url, id, i, x, y of every run in order of time; URLs with one run have none.

    Runs are ranked within a day, and days by the runs before them, so a URL
    with very many runs is spread over its days; its range is a sum of each
    day's.
    """
    runs = history.select("url", "id", "score", "timestamp", F.to_date("timestamp").alias("day"))
    days = runs.groupBy("url", "day").agg(F.count("*").alias("k"), F.min("score").alias("least"), F.max("score").alias("most"))
    own = W.partitionBy("url")
    days = days.select(
        "url", "day", F.coalesce(F.sum("k").over(own.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("k").over(own).alias("n"), F.least(F.min("least").over(own), F.lit(0.0)).alias("low"), F.greatest(F.max("most").over(own), F.lit(1.0)).alias("high"),
    ).where("n > 1")
    place = F.row_number().over(W.partitionBy("url", "day").orderBy("timestamp", "id")) - 1
    ranked = runs.select("url", "id", "score", "day", place.cast("long").alias("place"))
    df = ranked.join(days, (ranked["url"] == days["url"]) & ranked["day"].eqNullSafe(days["day"])).select(
        ranked["url"], "id", "score", (F.col("before") + F.col("place")).alias("i"), "n", "low", "high"
    )
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1.0))
    x: Column = F.lit(4.0) + F.col("i") / (F.col("n") - 1) * width
    y: Column = F.lit(44.0) - (F.col("score") - F.col("low")) / span * height
    return df.select("url", "id", "i", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def recent_table(history: DataFrame, rows: int = 8) -> DataFrame:
    """The newest rows of URLs that ran more than once.

    Ranks beyond `rows` go before the shuffle; whether there is a second run
    shows in the rows that are left.
    """
    ranked = history.select("url", "id", "score", "verdict", F.row_number().over(_newest()).cast("long").alias("rn")).where(F.col("rn") <= max(rows, 2))
    kept = ranked.withColumn("n", F.count("*").over(W.partitionBy("url")))
    return kept.where((F.col("rn") <= rows) & (F.col("n") > 1)).drop("n")
