"""The whole analysis as one plan: one wide row a site in, one scored row out, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import content, judgment, page, probes, robots, scoring, sitemap, structure


def _judged(raw: str, call_type: str) -> Column:
    """A reply that came with the row as a judgment; null is none."""
    x = judgment.strict(F.col(raw), call_type)
    return F.struct(*(x[c].alias(c) for c in ("score", "label", "reasoning")), F.lit("fixture").alias("provider"), F.lit(False).alias("cached"))


def signals(wide: DataFrame, whole: bool = False) -> DataFrame:
    """Every signal of a site in one row.

    wide: page_id, url, html, fetch_error; robots_status, robots_text and
    robots_error; sitemaps, an array of (pos, http_status, text, error) of
    the candidates; llms_status, llms_text and llms_error; probes, an array
    of (bot_ord, user_agent, category, http_status, size, redirect_count,
    error); and judgments, as structs `quality` and `citation`, or as replies
    quality_raw and citation_raw. With `whole`, also what only a report
    needs: main content, anomalies and tiers (from `geo` and `tier3`).

    Robots, probes and files are expressions over the row; its markup crosses
    to Python once.
    """
    df = robots.with_access(wide)
    df = structure.with_signals((page.with_all if whole else page.with_head)(df))
    df = df.withColumns({
        "sitemap": sitemap.chosen(F.col("url"), F.col("directives"), F.col("sitemaps")),
        "llms": sitemap.llms(F.col("url"), F.col("llms_status"), F.col("llms_text"), F.col("llms_error")),
    })
    if "quality_raw" in wide.columns:
        df = df.withColumns({"quality": _judged("quality_raw", "content_quality"), "citation": _judged("citation_raw", "citation_likelihood")})
    df = scoring.with_access_facts(df)
    return content.with_signals(probes.with_anomaly(df), "rendered_html" in wide.columns) if whole else df


def totals(seen: DataFrame) -> DataFrame:
    """Scored rows from rows with every signal and judgment."""
    return scoring.totals(scoring.breakdown(seen))


def scored(wide: DataFrame, whole: bool = False) -> DataFrame:
    return totals(signals(wide, whole))


def eligibility_report(wide: DataFrame) -> DataFrame:
    """The flagship: total, verdict, gate and issues of every site."""
    df = scored(wide).withColumn("issues", scoring.issue_list())
    return df.select(
        "page_id", "url", "total", "verdict", "gate_applied", "gate_reason", "llm_available", "max_possible",
        F.size("issues").cast("long").alias("n_issues"), F.get("issues", F.lit(0))["title"].alias("top_issue"),
    )
