"""Head and heading signals of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as urls
from ..sources import dimensions as d
from . import page


def json_ld(pages: DataFrame) -> DataFrame:
    """page_id, present, malformed, schema_count, types (sorted) of a page's blocks of strict JSON-LD."""
    return page.with_head(pages).select("page_id", *(F.col("head")[c].alias(c) for c in ("present", "malformed", "schema_count", "types")))


def _robots_flag(head: Column, word: str) -> Column:
    return F.contains(F.lower(F.coalesce(head["robots_meta"], F.lit(""))), F.lit(word))


def meta_tags(pages: DataFrame) -> DataFrame:
    """One row a page: title, description, og_*, robots_meta, canonical, noindex, noarchive.

    An absent tag gives null, one without content ''.
    """
    head = F.col("head")
    tags = ("title", "description", "og_title", "og_description", "og_image", "canonical", "robots_meta")
    return page.with_head(pages).select(
        "page_id", "url", *(head[c].alias(c) for c in tags), *(_robots_flag(head, w).alias(w) for w in ("noindex", "noarchive"))
    )


def canonical_check(meta: DataFrame) -> DataFrame:
    """page_id, present, self_referential (null if absent), canonical_url, page_url; a link without href is there, with ''."""
    c = F.col("canonical")
    return meta.select(
        "page_id", c.isNotNull().alias("present"), F.when(c.isNotNull(), urls.canonical(c) == urls.canonical(F.col("url"))).alias("self_referential"),
        c.alias("canonical_url"), F.col("url").alias("page_url"),
    )


def hierarchy_issues(levels: Column) -> Column:
    """What is wrong with the order of headings.

    A level is out of place where it first stands if the level above hasn't
    stood before; each level is told once.
    """
    h1 = F.size(F.filter(levels, lambda x: x == 1))
    first = (
        F.when(F.size(levels) == 0, F.array(F.lit(d.NO_HEADINGS)))
        .when(h1 == 0, F.array(F.lit(d.NO_H1)))
        .when(h1 > 1, F.array(F.format_string(d.MANY_H1, h1)))
        .otherwise(F.array().cast("array<string>"))
    )

    def early(level: Column) -> Column:
        above = F.array_position(levels, level - 1)
        return (level > 1) & ((above == 0) | (above > F.array_position(levels, level)))

    # array_distinct keeps the order in which levels first stand
    skips = F.transform(F.filter(F.array_distinct(levels), early), lambda x: F.format_string(d.EARLY_LEVEL, x, x - 1))
    return F.concat(first, skips)


def headings(pages: DataFrame) -> DataFrame:
    """page_id, has_h1, h1_count, headings (first 20), hierarchy_issues (from all of them)."""
    df = page.with_head(pages).select("page_id", F.col("head.levels").alias("levels"), F.col("head.headings").alias("headings"))
    h1 = F.size(F.filter("levels", lambda x: x == 1))
    return df.select("page_id", (h1 > 0).alias("has_h1"), h1.cast("long").alias("h1_count"), "headings", hierarchy_issues(F.col("levels")).alias("hierarchy_issues"))


def with_signals(df: DataFrame) -> DataFrame:
    """Adds all structure signals to rows with `head` and `failed`; a failed fetch has none and no hierarchy issues."""
    head = F.col("head")
    names = [c for c in ("present", "malformed", "schema_count", "types", "title", "description", "og_title", "og_description", "og_image", "canonical", "robots_meta")]
    none = F.array().cast("array<string>")
    h1 = F.size(F.filter(head["levels"], lambda x: x == 1)).cast("long")
    return df.withColumns({
        **{c: head[c] for c in names},
        **{w: _robots_flag(head, w) for w in ("noindex", "noarchive")},
        "h1_count": h1, "has_h1": h1 > 0, "headings": head["headings"],
        "hierarchy_issues": F.when(F.col("failed"), none).otherwise(hierarchy_issues(head["levels"])),
    })


def check(pages: DataFrame) -> DataFrame:
    """All structure signals of a page in one row, from one pass over its markup and without a shuffle."""
    return with_signals(page.with_head(pages)).drop("html", "head")


def evidence() -> Column:
    """What a report keeps of the structure checks, from the columns of with_signals and url."""
    cut = lambda c: F.left(F.nullif(F.col(c), F.lit("")), F.lit(200))
    canonical = F.col("canonical")
    own = F.when(canonical.isNotNull(), urls.canonical(canonical) == urls.canonical(F.col("url")))
    return F.struct(
        F.struct("present", "types", "schema_count", "malformed").alias("json_ld"),
        F.struct(
            "title", cut("description").alias("description"), "og_title", cut("og_description").alias("og_description"), "og_image",
            "canonical", "robots_meta", "noindex", "noarchive",
        ).alias("meta"),
        F.struct(
            "has_h1", "h1_count", F.size("headings").alias("total_headings"), "hierarchy_issues", F.slice("headings", 1, 5).alias("sample"),
        ).alias("headings"),
        F.struct(
            canonical.isNotNull().alias("present"), own.alias("self_referential"), canonical.alias("canonical_url"), F.col("url").alias("page_url"),
        ).alias("canonical"),
    )
