"""Per-crawler table, summaries, fix pack and the nested report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import dimensions as d
from . import content, probes, robots, scoring, structure

LLMS_TEMPLATE = "# llms.txt\n# A forward-looking signal; no provider has confirmed that it reads this file.\nname: \ndescription: \ncontact: \n"
JSON_LD_TEMPLATE = '<script type="application/ld+json">\n{"@context": "https://schema.org", "@type": "WebPage", "name": "", "description": "", "url": ""}\n</script>'
DESCRIPTION_TEMPLATE = '<meta name="description" content="">'


def per_bot(sites: DataFrame) -> DataFrame:
    """Adds `per_bot` to rows with the arrays `bots` and `probes`: what robots.txt and the probe say of each crawler.

    Unknown is allowed and not blocked. All is in the site's row, so nothing moves.
    """

    def one(b: Column) -> Column:
        p = F.get(F.filter("probes", lambda x: x["bot_ord"] == b["bot_ord"]), F.lit(0))
        return F.struct(
            b["bot_ord"].alias("bot_ord"), b["user_agent"].alias("bot_name"), b["provider"].alias("provider"), b["category"].alias("category"),
            b["allowed"].alias("robots_allowed"), p["http_status"].cast("long").alias("ua_http_status"), probes.blocked(p["http_status"]).alias("ua_blocked"),
            b["crawl_delay"].alias("crawl_delay"), b["paths"].alias("disallowed_paths"),
        )

    return sites.withColumn("per_bot", F.transform("bots", one))


def per_bot_rows(sites: DataFrame) -> DataFrame:
    """One row a site and crawler."""
    return per_bot(sites).select("page_id", F.explode_outer("per_bot").alias("x")).select("page_id", "x.*")


def top_paths(table: DataFrame) -> DataFrame:
    """page_id, bot_ord, shown: the first two paths and how many more."""
    more = F.size("disallowed_paths") - 2
    shown = F.array_join(F.slice("disallowed_paths", 1, 2), ", ")
    return table.select("page_id", "bot_ord", F.when(more > 0, F.concat(shown, F.lit(" +"), more.cast("string"))).otherwise(shown).alias("shown"))


def summary(category: str) -> Column:
    """How many crawlers of a category robots.txt allows, from the array `bots`."""
    of, name = (d.TRAINING_BOTS, "training") if category == "training" else (d.SEARCH_BOTS, "search/answer")
    n = F.size(F.filter("bots", lambda b: (b["category"] == category) & b["allowed"]))
    return F.format_string(f"%d/{len(of)} {name} bots allowed", n)


def summaries(sites: DataFrame) -> DataFrame:
    """page_id, training_summary, search_summary."""
    return sites.select("page_id", summary("training").alias("training_summary"), summary("search").alias("search_summary"))


def robots_additions(search_denied: Column, training_denied: Column) -> Column:
    """Lines to add to robots.txt: search crawlers live, training crawlers commented out; null if none is denied."""
    search = F.transform(search_denied, lambda x: F.concat(F.lit("User-agent: "), x, F.lit("\nAllow: /\n")))
    training = F.transform(training_denied, lambda x: F.concat(F.lit("# User-agent: "), x, F.lit("\n# Allow: /\n")))
    text = F.concat(
        F.lit("# Search and answer crawlers\n"), F.array_join(search, "\n"),
        F.lit("\n# Training crawlers: remove the comment signs to admit them\n"), F.array_join(training, "\n"),
    )
    return F.when((F.size(search_denied) > 0) | (F.size(training_denied) > 0), text)


def fix_files() -> Column:
    """The files that would help a site, as an array of (filename, description, content)."""
    lacks_ld = ~F.col("present") | F.col("malformed")
    lacks_description = F.coalesce(F.col("description") == "", F.lit(True))

    def file(when: Column, name: str, about: str, content: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("filename"), F.lit(about).alias("description"), content.alias("content")))

    additions = robots_additions(F.col("search_denied"), F.col("training_denied"))
    files = F.array(
        file(additions.isNotNull(), "robots_txt_additions.txt", "Add these groups to robots.txt", additions),
        file(~F.col("llms.exists"), "llms.txt", "An optional template; no provider has confirmed its use", F.lit(LLMS_TEMPLATE)),
        file(lacks_ld, "json_ld_snippet.html", "Add this block to the head of the page", F.lit(JSON_LD_TEMPLATE)),
        file(lacks_description, "meta_description.html", "Add this tag to the head of the page", F.lit(DESCRIPTION_TEMPLATE)),
    )
    return F.filter(files, lambda x: x.isNotNull())


def fix_pack(signals: DataFrame) -> DataFrame:
    """page_id, filename, description, content of each file that would help a site."""
    return signals.select("page_id", F.explode_outer(fix_files()).alias("x")).where("x IS NOT NULL").select("page_id", "x.*")


def breakdown_percent(long: DataFrame) -> DataFrame:
    """page_id, item_ord, percent, band and the shortened reason of each component."""
    pct = F.when(F.col("possible") > 0, F.col("earned") / F.col("possible") * 100).otherwise(0.0)
    band = F.when(pct >= 85, "green").when(pct >= 55, "yellow").when(pct >= 25, "orange").otherwise("red")
    short = F.when(F.length("reason") > 120, F.concat(F.left("reason", F.lit(120)), F.lit("…"))).otherwise(F.col("reason"))
    return long.select("page_id", F.col("item_ord").cast("long").alias("item_ord"), F.round(pct, 6).alias("percent"), band.alias("band"), short.alias("reason"))


def score_band(total: Column) -> Column:
    return F.when(total >= 85, "green").when(total >= 65, "yellow").when(total >= 40, "orange").otherwise("red")


def access_evidence() -> Column:
    """What a report keeps of the access checks."""
    spoof = F.transform(
        "probes",
        lambda p: F.struct(
            p["user_agent"].alias("bot"), p["category"].alias("category"), p["http_status"].alias("http_status"), probes.blocked(p["http_status"]).alias("blocked"),
            F.coalesce(p["redirect_count"], F.lit(0)).alias("redirect_count"), F.coalesce(p["size"], F.lit(0)).alias("response_size_bytes"), p["error"].alias("error"),
        ),
    )
    found = robots.evidence_of(F.col("url"), F.col("robots_status"), F.col("robots_text"), F.col("robots_error"), F.col("directives"))
    return F.struct(found.alias("robots"), F.col("sitemap"), F.col("llms").alias("llms_txt"), spoof.alias("ua_spoof"))


def probe_evidence(enabled: bool, n_workers: int) -> Column:
    """What a report keeps of the probes, tier by tier, from the columns of with_anomaly, `geo` and `tier3`."""
    results = F.transform(
        "probes",
        lambda p: F.struct(
            p["user_agent"].alias("bot"), p["category"].alias("category"), p["http_status"].alias("status"), probes.blocked(p["http_status"]).alias("blocked"),
            p["error"].alias("error"),
        ),
    )
    why = probes.skipped(F.col("anomaly"), enabled, n_workers)
    asked = F.col("tier_reached") >= 2
    tier2 = F.when(
        asked | why.isNotNull(),
        F.struct(
            F.when(~asked, F.lit(True)).alias("skipped"), F.when(~asked, why).alias("reason"), F.when(asked, probes.PROBE_BOT).alias("probe_bot"),
            F.when(asked, F.col("geo_anomaly")).alias("geo_anomaly_detected"), F.when(asked, F.col("geo")).alias("results"),
        ),
    )
    return F.struct(
        F.struct(F.col("anomaly").alias("anomaly_detected"), F.col("reason").alias("anomaly_reason"), results.alias("results")).alias("tier1"),
        tier2.alias("tier2"), F.when(F.col("tier_reached") == 3, F.struct(F.col("tier3").alias("results"))).alias("tier3"),
        F.struct(*(F.col("citation")[c].alias(c) for c in ("provider", "score", "label", "reasoning", "cached"))).alias("llm_citation"),
    )


def as_json(scored: DataFrame, now: Column, duration_ms: Column, enabled: bool = True, n_workers: int = 3) -> DataFrame:
    """page_id, url, total, verdict, report: one JSON document a site with all its evidence, null fields kept.

    scored: a site's row with every signal, scored by scoring.totals. All of
    it is in that row, so a report needs no join.
    """
    parts = F.transform(
        F.arrays_zip(F.col("items").alias("item"), scoring.evidence_items().alias("why")),
        lambda x: F.struct(
            x["item"]["label"].alias("label"), x["item"]["earned"].alias("points_earned"), x["item"]["possible"].alias("points_possible"),
            x["item"]["reason"].alias("reason"), x["why"].alias("evidence"),
        ),
    )
    flat = F.transform("items", lambda x: F.struct(x["label"].alias("label"), x["earned"].alias("earned"), x["possible"].alias("possible"), x["reason"].alias("reason")))
    issues = F.transform(scoring.issue_list(), lambda x: F.struct(x["severity"], x["title"], x["detail"], x["points_lost"], x["fix"]))
    score = F.struct("total", "max_possible", "verdict", "gate_applied", "gate_reason", "llm_available", parts.alias("breakdown"), issues.alias("issues"))
    evidence = F.struct(
        access_evidence().alias("access"), structure.evidence().alias("structure"), content.evidence(F.col("quality")).alias("content"),
        probe_evidence(enabled, n_workers).alias("empirical"), flat.alias("score_breakdown"),
    )
    whole = F.struct(
        "url", now.cast("string").alias("timestamp"), score.alias("score"), F.col("per_bot").alias("per_bot_table"),
        summary("training").alias("training_bots_summary"), summary("search").alias("search_bots_summary"), evidence.alias("raw_evidence"),
        fix_files().alias("fix_pack"), duration_ms.cast("long").alias("analysis_duration_ms"),
    )
    return per_bot(scored).select("page_id", "url", "total", "verdict", F.to_json(whole, {"ignoreNullFields": "false"}).alias("report"))
