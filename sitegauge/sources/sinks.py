"""Tables of the engine: history, judgment cache and fix-pack files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import judgment


def append_history(reports: DataFrame, path: str) -> None:
    """Appends reports (url, timestamp, score, verdict, report) under an id, one folder a day; the report stays its own column."""
    df = reports.withColumn("id", F.xxhash64("url", "timestamp")).withColumn("day", F.to_date("timestamp"))
    df.write.mode("append").partitionBy("day").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The history without its day column; readers that don't ask for the report never read it."""
    return spark.read.parquet(path).drop("day")


def upsert_cache(cache: DataFrame, new: DataFrame, path: str) -> None:
    """Writes the newest row of each key of cache and new to path, which must not be where cache was read from."""
    judgment.latest(cache.unionByName(new)).write.mode("overwrite").parquet(path)


def write_fix_pack(pack: DataFrame, path: str) -> None:
    """The files of every site as text, one folder for each file name."""
    pack.select("filename", F.concat(F.lit("== "), F.col("page_id").cast("string"), F.lit("\n"), "content").alias("value")).write.partitionBy("filename").text(path)


HISTORY = "id BIGINT, url STRING, `timestamp` TIMESTAMP, score DOUBLE, verdict STRING, report STRING, day DATE"
CACHE = "cache_key STRING, call_type STRING, score DOUBLE, label STRING, reasoning STRING, provider STRING, created_at DOUBLE, id BIGINT"


def create_tables(spark: SparkSession, history: str = "history", cache: str = "llm_cache") -> None:
    """The engine's tables in the warehouse, unless they are there: history by day, the cache bucketed by its key, which an upsert joins on."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {history} ({HISTORY}) USING parquet PARTITIONED BY (day)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {cache} ({CACHE}) USING parquet CLUSTERED BY (cache_key) INTO 16 BUCKETS")
