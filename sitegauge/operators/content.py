"""Main content, script bundles and the single-page-application heuristic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import dimensions as d
from . import page

SPA_WORDS = 100
EXCERPT = 500


def extract(pages: DataFrame) -> DataFrame:
    """page_id, body_text, fallback, body_word_count."""
    df = page.with_main(pages)
    return df.select("page_id", F.col("main.text").alias("body_text"), "main.fallback", F.col("main.words").alias("body_word_count"))


def bundles(pages: DataFrame) -> DataFrame:
    """page_id and the sources of scripts that look like application bundles, in order."""
    return page.with_head(pages).select("page_id", F.col("head.bundles").alias("bundles"))


def likely_spa(word_count: Column, has_bundles: Column) -> Column:
    return (word_count < SPA_WORDS) & has_bundles


def with_signals(df: DataFrame, render: bool = False) -> DataFrame:
    """Adds the content signals to rows with `main` and `failed`.

    With `render`, pages that look like applications take their text from
    rendered_html, a column that a renderer fills for them, and its error
    from render_error. A failed fetch has no words and says so.
    """
    main = F.col("main")
    spa = ~F.col("failed") & likely_spa(main["words"], F.size(main["bundles"]) > 0)
    df = df.withColumn("likely_spa", F.coalesce(spa, F.lit(False)))
    if render:
        # only the pages that were rendered have any markup for the parser
        wanted = F.when(F.col("likely_spa"), F.col("rendered_html"))
        df = page.with_main(df.drop("failed").withColumn("wanted__", wanted).withColumnRenamed("main", "plain__"), "wanted__")
        rendered = F.when(~F.col("failed"), F.col("main"))
        df = df.withColumn("rendered", rendered).drop("main", "failed", "wanted__").withColumnRenamed("plain__", "main")
        df = df.withColumn("failed", page.failed(F.col("html")))
        problem = F.when(F.col("rendered").isNull() & F.col("render_error").isNotNull(), F.concat(F.lit(d.RENDER_FAILED), F.col("render_error")))
    else:
        df = df.withColumn("rendered", F.lit(None).cast("struct<text:string,fallback:boolean,words:bigint,bundles:array<string>>"))
        problem = F.lit(d.RENDER_OFF)
    used = F.col("likely_spa") & F.lit(render)
    return df.withColumns({
        "body_word_count": F.when(F.col("failed"), 0).otherwise(F.col("main.words")).cast("long"),
        "rendered_used": used, "rendered_word_count": F.col("rendered.words"),
        "final_text": F.coalesce("rendered.text", "main.text"), "excerpt": F.left("main.text", F.lit(EXCERPT)),
        "fallback": F.when(used, F.coalesce("rendered.fallback", F.lit(False))).otherwise(F.col("main.fallback")),
        "bundles": F.slice("main.bundles", 1, 5), "has_bundles": F.size("main.bundles") > 0,
        "content_error": F.when(F.col("failed"), F.coalesce("fetch_error", F.lit(d.EMPTY_PAGE))).when(F.col("likely_spa"), problem),
    })


def check(pages: DataFrame, render: bool = False) -> DataFrame:
    """Content signals of a page; `render` uses rendered_html and render_error of pages that look like applications."""
    missing = {c: F.lit(None).cast("string") for c in ("fetch_error", "render_error", "rendered_html") if c not in pages.columns}
    df = with_signals(page.with_main(pages.withColumns(missing) if missing else pages), render)
    return df.select(
        "page_id", "body_word_count", "likely_spa", "rendered_used", "rendered_word_count", "excerpt", "fallback", "has_bundles", "bundles",
        F.when(F.col("failed"), d.PAGE_FAILED).alias("quality_label"), F.col("content_error").alias("error"),
    )


def evidence(judgment: Column) -> Column:
    """What a report keeps of the content checks; null where the page couldn't be had but for the error."""
    return F.struct(
        "body_word_count", F.col("excerpt").alias("visible_text_excerpt"), F.col("fallback").alias("extraction_fallback_used"),
        F.col("has_bundles").alias("has_js_bundles"), F.col("bundles").alias("bundle_urls"), "likely_spa", "rendered_used", "rendered_word_count",
        F.struct(F.lit(SPA_WORDS).alias("word_threshold"), F.lit(True).alias("js_bundle_required")).alias("spa_thresholds"),
        F.struct(*(judgment[c].alias(c) for c in ("provider", "score", "label", "cached"))).alias("llm"),
        F.when(F.col("failed"), F.col("content_error")).alias("fetch_error"),
    )
