"""The whole analysis from sites to reports: fetched relations, regions where crawlers are treated differently, judgments, one report a site.

Each relation is fetched once and written to a folder the caller names, so a
lost executor repeats no request, and what reads it twice reads files.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as urls
from ..operators import judgment, probes, report, robots, sitemap
from ..options import Options
from ..sources import dimensions as d
from ..sources import fetch
from . import analyze

_PROBE = "struct<bot_ord:int,user_agent:string,category:string,http_status:int,size:bigint,redirect_count:int,error:string>"
_GEO = "struct<region_ord:int,region:string,status:int,blocked:boolean,error:string>"
#: What a judgment may say at most, in tokens.
QUALITY_TOKENS, CITATION_TOKENS = 200, 150
EXCERPT = 6000


@dataclass
class Outcome:
    reports: DataFrame  # page_id, url, total, verdict, report
    fix_pack: DataFrame  # page_id, filename, description, content
    new_judgments: DataFrame  # rows for the cache


def wide(sites: DataFrame, pages: DataFrame, rules: DataFrame, maps: DataFrame, llms: DataFrame, probed: DataFrame) -> DataFrame:
    """One row a site, as analyze.signals reads it, from fetched relations by page_id.

    The many probes and candidates of a site are gathered before they join;
    all sides are keyed by page_id, so each moves once.
    """
    tried = maps.groupBy("page_id").agg(F.collect_list(F.struct("pos", "http_status", "text", "error")).alias("sitemaps"))
    seen = probed.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("bot_ord", "user_agent", "category", "http_status", "size", F.size("redirects").alias("redirect_count"), "error").cast(_PROBE))).alias("probes")
    )
    of = lambda df, name: df.select("page_id", F.col("http_status").alias(f"{name}_status"), F.col("text").alias(f"{name}_text"), F.col("error").alias(f"{name}_error"))
    markup = pages.select("page_id", F.when(F.col("error").isNull(), F.col("text")).alias("html"), F.col("error").alias("fetch_error"))
    return (
        sites.select("page_id", "url").join(markup, "page_id", "left").join(of(rules, "robots"), "page_id", "left").join(of(llms, "llms"), "page_id", "left")
        .join(tried, "page_id", "left").join(seen, "page_id", "left")
        .withColumn("sitemaps", F.coalesce("sitemaps", F.array().cast("array<struct<pos:int,http_status:int,text:string,error:string>>")))
        .withColumn("probes", F.coalesce("probes", F.array().cast(f"array<{_PROBE}>")))
    )


def _tiers(anomalies: DataFrame, options: Options, keep) -> DataFrame:
    """page_id, geo, geo_anomaly, tier_reached, tier3: regions are asked where crawlers are treated differently, all crawlers where regions differ."""
    asked = probes.to_ask(anomalies, list(options.workers), options.enable_geo)
    geo = keep(fetch.geo_probe(asked, options.probe_timeout))
    tiers = probes.escalation(anomalies, geo, options.enable_geo, len(options.workers)).select("page_id", "tier_reached", "geo_anomaly")
    crawlers = d.bots(anomalies.sparkSession).select("user_agent", "bot_ord")
    third = asked.drop("user_agent").join(tiers.where("tier_reached = 3").select("page_id"), "page_id", "left_semi").crossJoin(F.broadcast(crawlers))
    matrix = keep(fetch.geo_probe(third, options.probe_timeout))
    gathered = lambda df, name, more: df.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*more, "region_ord", "region", "status", "blocked", "error"))).alias(name))
    return tiers.join(gathered(geo, "geo", ()), "page_id", "left").join(gathered(matrix, "tier3", ("user_agent",)), "page_id", "left")


def run(sites: DataFrame, folder: str, options: Options, cache: DataFrame, now: Column, rendered: DataFrame | None = None) -> Outcome:
    """Reports, fix packs and new judgments of sites (page_id, unique, and url as given).

    folder: a shared folder for what is fetched. cache: judgments so far
    (cache_key, score, label, reasoning, provider, created_at). rendered:
    page_id, rendered_html and render_error of pages that a browser has
    rendered, read where the options say so. Sites whose URL isn't http or
    https give error rows in every relation and a report that says so.
    """
    spark = sites.sparkSession

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    began = F.unix_millis(F.current_timestamp())
    sites = keep(sites.select(F.col("page_id").cast("long").alias("page_id"), urls.normalize(F.col("url")).alias("url")).withColumn("began", began))
    rules = keep(fetch.files(sites, "/robots.txt", options.page_timeout))
    llms = keep(fetch.files(sites, "/llms.txt", options.page_timeout))
    pages = keep(fetch.pages(sites.select("page_id", "url"), options.page_timeout))
    named = sites.join(rules.select("page_id", "http_status", "text"), "page_id").select("page_id", "url", robots.directives(F.col("http_status"), F.col("text")).alias("directives"))
    maps = keep(fetch.at_positions(sitemap.requests(named), options.page_timeout))
    probed = keep(fetch.probe(sites, options.probe_timeout))
    anomalies = keep(probes.anomaly(probed).join(sites.select("page_id", "url"), "page_id"))
    whole = wide(sites, pages, rules, maps, llms, probed).join(_tiers(anomalies, options, keep), "page_id", "left")
    whole = whole.withColumns({"tier_reached": F.coalesce("tier_reached", F.lit(1)), "geo_anomaly": F.coalesce("geo_anomaly", F.lit(False))})
    if options.enable_render and rendered is not None:
        whole = whole.join(rendered.select("page_id", "rendered_html", "render_error"), "page_id", "left")
    # parsed once: prompts and reports read the same rows
    seen = keep(analyze.signals(whole, whole=True).drop("html", "head", "main", "rendered", "rendered_html"))
    url = F.col("url")
    asked = seen.where("NOT failed").select(
        "page_id", judgment.quality_key(url, F.left("final_text", F.lit(EXCERPT))).alias("cache_key"),
        judgment.quality_prompt(url, F.left("final_text", F.lit(EXCERPT))).alias("prompt"),
    )
    cited = seen.select(
        "page_id", judgment.citation_key(url, F.col("description"), F.col("types"), F.lit(0)).alias("cache_key"),
        judgment.citation_prompt(url, F.col("description"), F.col("types"), F.col("search_allowed"), len(d.SEARCH_BOTS)).alias("prompt"),
    )
    judged = {}
    kinds = (("quality", asked, "content_quality", QUALITY_TOKENS), ("citation", cited, "citation_likelihood", CITATION_TOKENS))
    for name, requests, kind, tokens in kinds:
        scorer = fetch.completions(options, tokens)
        judged[name] = keep(judgment.judge(requests, cache, now, kind, options.provider, options.enable_llm, scorer))
    for name, df in judged.items():
        seen = seen.join(df.select("page_id", F.col("judgment").alias(name)), "page_id", "left")
    unavailable = judgment.unavailable(F.lit(d.PAGE_FAILED))
    seen = seen.withColumn("quality", F.coalesce("quality", unavailable))
    scored = keep(analyze.totals(seen))
    took = F.unix_millis(F.current_timestamp()) - F.col("began")
    reports = report.as_json(scored.join(sites.select("page_id", "began"), "page_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), took, options.enable_geo, len(options.workers))
    new = [judgment.to_cache(judged[name], kind, now) for name, kind in (("quality", "content_quality"), ("citation", "citation_likelihood"))]
    return Outcome(reports, report.fix_pack(scored), new[0].unionByName(new[1]))
