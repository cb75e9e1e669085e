"""The score: components, total, gate, verdict and ranked issues, one wide row per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import half_even_1
from ..functions.text import percent
from ..sources import dimensions as d
from . import probes

N_SEARCH, N_TRAINING = len(d.SEARCH_BOTS), len(d.TRAINING_BOTS)
ITEM = "array<struct<item_ord:int,label:string,earned:double,possible:double,reason:string>>"


def with_access_facts(sites: DataFrame) -> DataFrame:
    """Adds allowed and denied crawlers by category, and the counts of probes, to rows with the arrays `bots` and `probes`."""
    of = lambda c, more: F.filter("bots", lambda b: (b["category"] == c) & more(b))
    out = {}
    for c in ("search", "training"):
        out[f"{c}_allowed"] = F.size(of(c, lambda b: b["allowed"])).cast("long")
        out[f"{c}_denied"] = F.transform(of(c, lambda b: ~b["allowed"]), lambda b: b["user_agent"])
    df = sites.withColumns(out | {"facts__": probes.facts(F.col("probes"))})
    names = ("n", "n_blocked", "n_errored", "n_lost", "n_search", "n_training", "search_refused", "training_refused")
    return df.withColumns({k: F.col("facts__")[k] for k in names}).drop("facts__")


def _item(i: int, what: tuple[str, int], earned: Column, reason: Column) -> Column:
    return F.struct(
        F.lit(i).alias("item_ord"), F.lit(what[0]).alias("label"), earned.cast("double").alias("earned"),
        F.lit(float(what[1])).alias("possible"), reason.alias("reason"),
    )


def _names(denied: str, head: str) -> Column:
    listed = F.array_join(denied, ", ")
    return F.when(F.size(denied) > 0, F.concat(F.lit(head), listed)).otherwise("")


def access_items() -> list[Column]:
    """Components of access, from the columns of access_facts, sitemap and llms.txt."""
    s, t, n, lost = F.col("search_allowed"), F.col("training_allowed"), F.col("n"), F.col("n_lost")
    ok = n - lost
    return [
        _item(0, d.SEARCH, half_even_1(s * d.SEARCH[1] / N_SEARCH), F.concat(s.cast("string"), F.lit(f"/{N_SEARCH} search bots allowed in robots.txt"), _names("search_denied", ". Blocked: "))),
        _item(1, d.TRAINING, half_even_1(t * d.TRAINING[1] / N_TRAINING), F.concat(t.cast("string"), F.lit(f"/{N_TRAINING} training bots allowed; blocking them is the site's choice."), _names("training_denied", " Blocked: "))),
        _item(2, d.UA_BLOCKING, F.when(n > 0, half_even_1(ok * d.UA_BLOCKING[1] / n)).otherwise(0.0), F.format_string("%d/%d bots received non-blocking HTTP response", ok, n)),
        _item(3, d.SITEMAP, F.when(F.col("sitemap.exists"), d.SITEMAP[1]).otherwise(0), F.when(F.col("sitemap.exists"), F.format_string("sitemap.xml with %d URLs", F.col("sitemap.url_count"))).otherwise("No sitemap.xml found")),
        _item(4, d.LLMS_TXT, F.when(F.col("llms.exists"), d.LLMS_TXT[1]).otherwise(0), F.when(F.col("llms.exists"), "llms.txt found").otherwise("No llms.txt found")),
    ]


def structure_items() -> Column:
    """Components of structure; noindex replaces them all by one that earns nothing."""
    some = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    described = F.length(F.trim("description"))
    both, either = some("og_title") & some("og_description"), some("og_title") | some("og_description")
    n_issues = F.size("hierarchy_issues")
    items = F.array(
        _item(5, d.JSON_LD, F.when(F.col("present") & ~F.col("malformed"), 5).when(F.col("present"), 2).otherwise(0),
              F.when(F.col("present") & ~F.col("malformed"), F.concat(F.lit("Valid JSON-LD found. Types: "), F.coalesce(F.nullif(F.array_join("types", ", "), F.lit("")), F.lit("untyped")))).when(F.col("present"), "JSON-LD found but it has parse errors").otherwise("No JSON-LD found")),
        _item(6, d.DESCRIPTION, F.when(some("description") & (described > 10), 4).when(some("description"), 2).otherwise(0),
              F.when(some("description") & (described > 10), F.format_string("Meta description present (%d chars)", F.length("description"))).when(some("description"), "Meta description present but very short").otherwise("No meta description")),
        _item(7, d.OPEN_GRAPH, F.when(both, 2).when(either, 1).otherwise(0), F.when(both, "og:title and og:description present").when(either, "One of og:title and og:description present").otherwise("No OpenGraph tags")),
        _item(8, d.H1, F.when(F.col("h1_count") == 1, 2).when(F.col("h1_count") > 1, 1).otherwise(0), F.when(F.col("h1_count") == 1, "Exactly one H1 found").when(F.col("h1_count") > 1, F.format_string("%d H1 tags found", "h1_count")).otherwise("No H1 tag")),
        _item(9, d.HIERARCHY, F.greatest(F.lit(0), 2 - n_issues), F.when(n_issues > 0, F.concat(F.lit("Heading hierarchy issues: "), F.array_join("hierarchy_issues", "; "))).otherwise("Heading hierarchy is well-structured")),
    )
    zeroed = F.array(_item(5, d.NOINDEX, F.lit(0), F.concat(F.lit("The page says "), F.col("robots_meta"))))
    return F.when(F.col("noindex"), zeroed.cast(ITEM)).otherwise(items.cast(ITEM))


def judgment_items() -> list[Column]:
    out = []
    for i, what, col in ((10, d.QUALITY, "quality"), (11, d.CITATION, "citation")):
        score = F.col(f"{col}.score")
        reason = F.when(score.isNotNull(), F.concat(F.lit(f"{col} "), F.col(f"{col}.label"))).otherwise("No judgment available")
        out.append(_item(i, what, F.coalesce(half_even_1(score * what[1]), F.lit(0.0)), reason))
    return out


def evidence_items() -> Column:
    """What each item of breakdown() rests on, in the same order, as variants: their shapes differ."""
    v = lambda *cols: F.to_variant_object(F.struct(*cols))
    by_bot = lambda bots, key, value: F.map_from_arrays(F.transform(bots, lambda b: b[key]), F.transform(bots, value))
    of = lambda c: F.filter("bots", lambda b: b["category"] == c)
    allowed = lambda c: F.transform(F.filter(of(c), lambda b: b["allowed"]), lambda b: b["user_agent"])
    lost = F.filter("probes", lambda p: probes.blocked(p["http_status"]) | p["error"].isNotNull())
    stopped = lambda c: F.transform(F.filter(lost, lambda p: p["category"] == c), lambda p: p["user_agent"])
    access = [
        v(allowed("search").alias("allowed"), F.col("search_denied").alias("blocked"),
          by_bot(of("search"), "user_agent", lambda b: F.struct(b["allowed"].alias("allowed"), b["paths"].alias("disallowed_paths"))).alias("per_bot")),
        v(allowed("training").alias("allowed"), F.col("training_denied").alias("blocked")),
        v(F.transform(lost, lambda p: p["user_agent"]).alias("blocked"), stopped("search").alias("blocked_search"), stopped("training").alias("blocked_training"),
          by_bot(F.col("probes"), "user_agent", lambda p: F.struct(p["http_status"].alias("status"), probes.blocked(p["http_status"]).alias("blocked"), p["error"].alias("error"))).alias("per_bot")),
        v("sitemap.exists", "sitemap.url", "sitemap.url_count", "sitemap.source"),
        v("llms.exists", "llms.url", "llms.note"),
    ]
    structure = [v("present", "types", "malformed", "schema_count"), v("description"), v("og_title", "og_description"), v("h1_count"), v(F.col("hierarchy_issues").alias("issues"))]
    tail = [v("quality.score", "quality.label", "quality.reasoning"), v("citation.score", "citation.label", "citation.reasoning")]
    middle = F.when(F.col("noindex"), F.array(v("robots_meta"))).otherwise(F.array(*structure))
    return F.concat(F.array(*access), middle, F.array(*tail))


def breakdown(signals: DataFrame) -> DataFrame:
    """signals with the array items, in order of the report."""
    head, tail = F.array(*access_items()).cast(ITEM), F.array(*judgment_items()).cast(ITEM)
    return signals.withColumn("items", F.concat(head, structure_items(), tail))


def long_breakdown(scored: DataFrame) -> DataFrame:
    """One row per site and component.

    An outer explode, as a plain one would have the optimiser compute the
    items, and so read the page, once more to see that there are any.
    """
    return scored.select("page_id", F.explode_outer("items").alias("x")).select("page_id", "x.*")


def verdict(total: Column) -> Column:
    return F.when(total >= 80, "Excellent").when(total >= 60, "Good").when(total >= 40, "Fair").otherwise("Poor")


def _earned(first: int, last: int) -> Column:
    """Points of the items in that range, added in order, so that sums don't depend on anything else."""
    own = F.filter("items", lambda x: x["item_ord"].between(first, last))
    return F.aggregate(own, F.lit(0.0), lambda s, x: s + x["earned"])


def totals(scored: DataFrame) -> DataFrame:
    """Adds llm_available, raw_total, max_possible, gate_applied, gate_reason, total and verdict.

    Without judgments the rule points are scaled to 100. The gate comes
    last: below two of five search crawlers the total is capped at 45, below
    three it loses 15 %.
    """
    rule_points = F.least(_earned(0, 9), F.lit(float(d.RULE_POINTS)))
    sums = {"llm_available": _earned(10, 11) > 0, "rules__": rule_points, "all__": F.least(_earned(0, 11), F.lit(float(d.ALL_POINTS)))}
    df = scored.withColumns(sums)
    rules = F.col("rules__")
    raw = F.when(F.col("llm_available"), half_even_1(F.col("all__"))).otherwise(half_even_1(rules / d.RULE_POINTS * 100))
    df = df.withColumn("raw_total", raw)
    k = F.col("search_allowed")
    gated = F.when(k * 10 < 4 * N_SEARCH, F.least("raw_total", F.lit(45.0))).when(k * 10 < 6 * N_SEARCH, F.col("raw_total") * F.lit(0.85)).otherwise(F.col("raw_total"))
    share = F.concat(k.cast("string"), F.lit(f"/{N_SEARCH} AI search/answer bots can access this site ("), percent(k, N_SEARCH), F.lit(")."))
    reason = F.when(k * 10 < 4 * N_SEARCH, F.concat(F.lit(d.CAPPED), share)).when(k * 10 < 6 * N_SEARCH, F.concat(F.lit(d.REDUCED), share))
    df = df.withColumn("gated", gated)
    df = df.withColumn("total", half_even_1(F.col("gated"))).drop("gated", "rules__", "all__")
    return df.select(
        "*", F.when(F.col("llm_available"), float(d.ALL_POINTS)).otherwise(float(d.RULE_POINTS)).alias("max_possible"),
        (k * 10 < 6 * N_SEARCH).alias("gate_applied"), reason.alias("gate_reason"), verdict(F.col("total")).alias("verdict"),
    )


def issue_list() -> Column:
    """Lost components, most points first, ties in order of the report; ranked within the row, so nothing is shuffled."""
    fixes = F.create_map(*(F.lit(x) for kv in d.FIXES.items() for x in kv))
    lost = F.filter("items", lambda x: x["possible"] - x["earned"] > 0)

    def issue(x: Column) -> Column:
        points = x["possible"] - x["earned"]
        severity = F.when(points >= 10, "critical").when(points >= 5, "high").when(points >= 2, "medium").otherwise("low")
        fix = F.coalesce(F.try_element_at(fixes, x["label"]), F.lit(d.DEFAULT_FIX))
        return F.struct(
            (-points).alias("order"), x["item_ord"].alias("item_ord"), severity.alias("severity"), x["label"].alias("title"),
            x["reason"].alias("detail"), points.alias("points_lost"), fix.alias("fix"),
        )

    return F.sort_array(F.transform(lost, issue))


def issues(scored: DataFrame) -> DataFrame:
    """One row per site and issue, with its rank from 1."""
    df = scored.select("page_id", F.posexplode_outer(issue_list()).alias("pos", "x")).where("pos IS NOT NULL")
    return df.select("page_id", (F.col("pos") + 1).cast("long").alias("rank"), "x.severity", "x.title", "x.detail", "x.points_lost", "x.fix")

