"""sitemap.xml and llms.txt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as txt
from ..functions import url as urls
from ..sources import dimensions as d
from .robots import usable

_CANDIDATE = "array<struct<url:string,source:string>>"


def candidates(url: Column, directives: Column) -> Column:
    """Where to look: what robots.txt names, else the default path, never both."""
    named = F.transform(directives, lambda x: F.struct(x.alias("url"), F.lit("robots.txt").alias("source")))
    default = F.array(F.struct(urls.well_known(url, "/sitemap.xml").alias("url"), F.lit("default-path").alias("source")))
    return F.when(F.size(directives) > 0, named.cast(_CANDIDATE)).otherwise(default.cast(_CANDIDATE))


def requests(sites: DataFrame) -> DataFrame:
    """page_id, pos, url of every candidate of sites (page_id, url, directives): what is to be fetched."""
    df = sites.select("page_id", F.posexplode(candidates(F.col("url"), F.col("directives"))).alias("pos", "x"))
    return df.select("page_id", "pos", F.col("x.url").alias("url"))


def url_count(text: Column) -> Column:
    """<url> elements, without attributes, in any case."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit("<url>"), F.lit("")))) / 5).cast("long")


def last_modified(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?i)<lastmod>\s*([^<]+)\s*</lastmod>", 1)
    return F.when(found != "", txt.strip(found))


def chosen(url: Column, directives: Column, fetched: Column) -> Column:
    """exists, url, url_count, last_modified and source of the first candidate that came back whole.

    fetched: an array of (pos, http_status, text, error) for the candidates.
    """
    good = F.filter(F.array_sort(fetched), lambda x: x["error"].isNull() & usable(x["http_status"], x["text"]))
    one = F.get(good, F.lit(0))
    own = F.get(candidates(url, directives), one["pos"])
    return F.struct(
        one.isNotNull().alias("exists"), own["url"].alias("url"), url_count(one["text"]).alias("url_count"),
        last_modified(one["text"]).alias("last_modified"), F.coalesce(own["source"], F.lit("absent")).alias("source"),
    )


def llms(url: Column, status: Column, text: Column, error: Column) -> Column:
    """exists, url and has_content of an llms.txt: it is there if it came back with a body, and says something if that isn't blank."""
    exists = error.isNull() & usable(status, text)
    return F.struct(
        exists.alias("exists"), urls.well_known(url, "/llms.txt").alias("url"),
        (exists & F.coalesce(txt.strip(text) != "", F.lit(False))).alias("has_content"), F.lit(d.LLMS_NOTE).alias("note"),
    )


def _gathered(fetched: DataFrame) -> DataFrame:
    return fetched.groupBy("page_id").agg(F.collect_list(F.struct("pos", "http_status", "text", "error")).alias("fetched"))


def check(sites: DataFrame, fetched: DataFrame) -> DataFrame:
    """page_id, sitemap_exists, sitemap_url, url_count, last_modified, source.

    sites: page_id, url, directives; fetched: page_id, pos, http_status, text
    and error of each candidate. The few candidates of a site meet its row in
    one shuffle.
    """
    df = sites.join(_gathered(fetched), "page_id", "left").withColumn("x", chosen(F.col("url"), F.col("directives"), F.col("fetched")))
    return df.select(
        "page_id", F.coalesce("x.exists", F.lit(False)).alias("sitemap_exists"), F.col("x.url").alias("sitemap_url"), "x.url_count", "x.last_modified", "x.source"
    )


def llms_txt(files: DataFrame) -> DataFrame:
    """page_id, llms_exists, llms_url, has_content from rows (page_id, url, http_status, text, error) of fetched llms.txt files."""
    df = files.select("page_id", llms(F.col("url"), F.col("http_status"), F.col("text"), F.col("error")).alias("x"))
    return df.select("page_id", F.col("x.exists").alias("llms_exists"), F.col("x.url").alias("llms_url"), "x.has_content")
