"""Fixed dimensions: crawlers, weights, labels and texts. All are a few rows and go to plans as literals or broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (bot_ord, user_agent, category, provider).
BOTS = [
    (0, "GPTBot", "training", "OpenAI"),
    (1, "ClaudeBot", "training", "Anthropic"),
    (2, "Google-Extended", "training", "Google"),
    (3, "CCBot", "training", "Common Crawl"),
    (4, "Amazonbot", "training", "Amazon"),
    (5, "Diffbot", "training", "Diffbot"),
    (6, "OAI-SearchBot", "search", "OpenAI"),
    (7, "Claude-SearchBot", "search", "Anthropic"),
    (8, "PerplexityBot", "search", "Perplexity"),
    (9, "Applebot-Extended", "search", "Apple"),
    (10, "Googlebot", "search", "Google"),
]
SEARCH_BOTS = [b for b in BOTS if b[2] == "search"]
TRAINING_BOTS = [b for b in BOTS if b[2] == "training"]
#: Statuses that count as blocking.
BLOCKING = (403, 429, 503)
REGIONS = ["us", "eu", "apac"]
#: Label and points of each component, in order of the report.
SEARCH, TRAINING = ("Search/Answer bots allowed (robots.txt)", 30), ("Training bots allowed (robots.txt)", 10)
UA_BLOCKING, SITEMAP = ("No UA-based HTTP blocking (empirical)", 7), ("sitemap.xml present", 3)
LLMS_TXT, NOINDEX = ("llms.txt present (bonus signal only)", 5), ("noindex override — all structure points zeroed", 15)
JSON_LD, DESCRIPTION, OPEN_GRAPH = ("JSON-LD structured data", 5), ("Meta description", 4), ("OpenGraph tags", 2)
H1, HIERARCHY = ("H1 heading present", 2), ("Heading hierarchy", 2)
QUALITY, CITATION = ("Content quality (LLM judgment)", 20), ("Citation likelihood (LLM judgment)", 10)
RULE_POINTS, ALL_POINTS = 70, 100
#: What to do about a lost component; our own wording.
FIXES = {
    SEARCH[0]: "Lift the Disallow rules that keep search and answer crawlers out.",
    TRAINING[0]: "Lift the Disallow rules for training crawlers, if they are welcome.",
    UA_BLOCKING[0]: "Look for firewall, CDN or rate-limit rules that refuse crawler user agents.",
    SITEMAP[0]: "Publish a sitemap.xml at the root and name it in robots.txt.",
    JSON_LD[0]: "Describe the page with a JSON-LD block in schema.org terms.",
    DESCRIPTION[0]: "Add a meta description of 120 to 160 characters.",
    OPEN_GRAPH[0]: "Add og:title and og:description to the head.",
    H1[0]: "Give the page exactly one h1, its main topic.",
    HIERARCHY[0]: "Let heading levels follow each other without gaps.",
}
#: What checks say; reports are compared and searched by these sentences.
NO_HEADINGS = "No headings found — content structure is invisible to AI chunkers"
NO_H1 = "No H1 tag — AI crawlers rely on H1 as the primary topic signal"
MANY_H1 = "Multiple H1 tags (%d) — should have exactly one H1 per page"
EARLY_LEVEL = "H%d appears before H%d — broken heading hierarchy"
UNIFORM = "uniform result across all bot UAs — no geo verification needed"
SEARCH_BLOCKED = "search bots blocked (%d/%d) but training bots allowed"
TRAINING_BLOCKED = "training bots blocked (%d/%d) but search bots allowed"
PARTLY_BLOCKED = "partial blocking: %d/%d bots blocked — possible UA-discriminating WAF"
NO_ANOMALY = "no significant anomaly detected"
CAPPED, REDUCED = "Score capped at 45: only ", "Score reduced 15%: only "
PAGE_FAILED = "unavailable — page fetch failed"
NO_ROBOTS = "robots.txt absent or unreadable — treating as default-allow"
NOT_PARSED, NO_REASON = "Could not parse LLM response", "No reasoning provided"
#: What else reports say; our own wording.
EMPTY_PAGE = "the page came back empty"
RENDER_OFF, RENDER_FAILED = "the page looks like an application, but rendering is not enabled", "rendering failed: "
LLMS_NOTE = "A forward-looking signal; no provider has confirmed that it reads this file."
SKIPPED_CALM, SKIPPED_NO_WORKER = "no anomaly among crawlers, so no region was asked", "an anomaly among crawlers, but no worker to ask from a region"
JUDGE_OFF, JUDGE_NO_KEY, JUDGE_FAILED = "judgments are not enabled", "no key for the provider", "the call failed: "
DEFAULT_FIX = "Take the template from the fix pack."


def bots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOTS, "bot_ord int, user_agent string, category string, provider string")


def bots_literal() -> Column:
    """The crawlers as an array literal: a per-site fan-out without a join."""
    return F.array(
        *(
            F.struct(F.lit(o).alias("bot_ord"), F.lit(ua).alias("user_agent"), F.lit(c).alias("category"), F.lit(p).alias("provider"))
            for o, ua, c, p in BOTS
        )
    )
