"""Crawler probes: blocking, the anomaly ladder, regional differences and escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import dimensions as d
from ..sources.dimensions import BLOCKING, REGIONS

PROBE_BOT = "OAI-SearchBot"


def blocked(status: Column) -> Column:
    return F.coalesce(status.isin(*BLOCKING), F.lit(False))


def matrix(probes: DataFrame) -> DataFrame:
    """Each probe with its verdict; a network error is no blocking."""
    return probes.withColumn("blocked", blocked(F.col("http_status")))


def counts(probes: DataFrame) -> DataFrame:
    """Per site: probes, blocked, errored, and search and training crawlers refused or failed. One shuffle, combined before it."""
    refused = F.col("http_status").isNull() | blocked(F.col("http_status"))
    of = lambda category, more=F.lit(True): F.count_if((F.col("category") == category) & more)
    return probes.groupBy("page_id").agg(
        F.count("*").alias("n"), F.count_if(blocked(F.col("http_status"))).alias("n_blocked"),
        F.count_if(F.col("error").isNotNull()).alias("n_errored"),
        F.count_if(blocked(F.col("http_status")) | F.col("error").isNotNull()).alias("n_lost"),
        of("search").alias("n_search"), of("training").alias("n_training"),
        of("search", refused).alias("search_refused"), of("training", refused).alias("training_refused"),
    )


def facts(probes: Column) -> Column:
    """The same counts from an array of a site's probes (http_status, category, error), where they come with its row."""
    n = lambda test: F.size(F.filter(probes, test)).cast("long")
    stopped = lambda x: blocked(x["http_status"])
    refused = lambda x: x["http_status"].isNull() | stopped(x)
    of = lambda c, more=None: lambda x: (x["category"] == c) & more(x) if more else x["category"] == c
    return F.struct(
        F.size(probes).cast("long").alias("n"), n(stopped).alias("n_blocked"), n(lambda x: x["error"].isNotNull()).alias("n_errored"),
        n(lambda x: stopped(x) | x["error"].isNotNull()).alias("n_lost"),
        *(n(of(c)).alias(f"n_{c}") for c in ("search", "training")),
        *(n(of(c, refused)).alias(f"{c}_refused") for c in ("search", "training")),
    )


def with_anomaly(counted: DataFrame) -> DataFrame:
    """Adds anomaly and reason to rows of counts."""
    uniform = ((F.col("n_blocked") + F.col("n_errored")) == F.col("n")) | ((F.col("n_blocked") == 0) & (F.col("n_errored") == 0))
    search = (F.col("search_refused") > 0) & (F.col("training_refused") == 0)
    training = (F.col("training_refused") > 0) & (F.col("search_refused") == 0)
    partial = (F.col("n_blocked") > 0) & (F.col("n_blocked") < F.col("n"))
    reason = (
        F.when(uniform, d.UNIFORM)
        .when(search, F.format_string(d.SEARCH_BLOCKED, "search_refused", "n_search"))
        .when(training, F.format_string(d.TRAINING_BLOCKED, "training_refused", "n_training"))
        .when(partial, F.format_string(d.PARTLY_BLOCKED, "n_blocked", "n"))
        .otherwise(d.NO_ANOMALY)
    )
    return counted.withColumns({"anomaly": ~uniform & (search | training | partial), "reason": reason})


def anomaly(probes: DataFrame) -> DataFrame:
    """page_id, anomaly, reason with the counts it rests on."""
    return with_anomaly(counts(probes))


def geo_difference(geo: DataFrame) -> DataFrame:
    """page_id, n_statuses, geo_anomaly: whether regions that answered differ."""
    df = geo.groupBy("page_id").agg(F.count_distinct("status").alias("n_statuses"))
    return df.withColumn("geo_anomaly", F.col("n_statuses") > 1)


def regions(workers: list[str]) -> list[tuple[int, str, str]]:
    """(region_ord, region, worker): labels go by position over the workers that are configured."""
    return [(i, region, url) for i, (region, url) in enumerate(zip(REGIONS, [w for w in workers if w], strict=False))]


def skipped(anomaly: Column, enabled: bool, n_workers: int) -> Column:
    """Why no region is asked; null where one is, and where asking is switched off, which needs no reason."""
    return F.when(~anomaly, d.SKIPPED_CALM).when(F.lit(enabled and n_workers == 0), d.SKIPPED_NO_WORKER)


def to_ask(anomalies: DataFrame, workers: list[str], enabled: bool = True) -> DataFrame:
    """page_id, url, user_agent, region_ord, region, worker: what tier 2 asks, the probe crawler from each region, for sites with an anomaly."""
    asked = regions(workers) if enabled else []
    places = anomalies.sparkSession.createDataFrame(asked, "region_ord int, region string, worker string")
    return anomalies.where("anomaly").select("page_id", "url", F.lit(PROBE_BOT).alias("user_agent")).crossJoin(F.broadcast(places))


def escalation(anomalies: DataFrame, geo: DataFrame, enabled: bool = True, n_workers: int = 3) -> DataFrame:
    """page_id, tier_reached, geo_anomaly, skipped: regions are asked only for sites with an anomaly, all crawlers only where regions differ."""
    ask = F.col("anomaly") & F.lit(enabled and n_workers > 0)
    asked = geo.join(anomalies.where(ask).select("page_id"), "page_id", "left_semi")
    df = anomalies.select("page_id", "anomaly").join(geo_difference(asked), "page_id", "left")
    found = F.coalesce("geo_anomaly", F.lit(False))
    return df.select(
        "page_id", F.when(found, 3).when(ask, 2).otherwise(1).cast("long").alias("tier_reached"), found.alias("geo_anomaly"),
        skipped(F.col("anomaly"), enabled, n_workers).alias("skipped"),
    )


def full_matrix(escalated: DataFrame, geo: DataFrame, bots: DataFrame) -> DataFrame:
    """page_id, region, bot_ord, user_agent: what tier 3 fetches, region by crawler."""
    sites = escalated.where(F.col("tier_reached") == 3).select("page_id")
    return geo.join(sites, "page_id", "left_semi").select("page_id", "region_ord", "region").crossJoin(F.broadcast(bots.select("bot_ord", "user_agent")))
