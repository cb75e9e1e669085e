"""Line dedup: lines spread over many sites are boilerplate; HyperLogLog sketches count the sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A line on this many distinct sites is boilerplate, few enough for passages to be seen where one site holds half of all documents.
MIN_SITES = 5
LG_K = 12


def _key(line: Column) -> Column:
    """128 bits of a line, so that distinct lines stay distinct among trillions."""
    return F.unhex(F.md5(line.cast("binary")))


def _counts(line: Column) -> Column:
    """Whether a line is looked at: any that isn't blank."""
    return line.rlike(r"[^\x20\x09-\x0D]")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, site and key of each distinct line of a row that is looked at."""
    own = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1), _counts)
    keys = F.transform(F.array_distinct(own), _key)
    return docs.select("doc_id", F.col("source").alias("site"), F.explode(keys).alias("line"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """line (key) and keeper (its least doc_id) of every line on min_sites distinct sites or more.

    Each line's sites go to a sketch that merges before and after the shuffle,
    so a line on a third of all rows costs a task no more than another.
    Estimates beyond the sketch's error band around the threshold decide; the
    lines within it get an exact distinct count, itself by partial
    aggregation. Null sites count for nothing.
    """
    lines = _lines(docs)
    spread = materialize(
        lines.groupBy("line")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.min("doc_id").alias("keeper"))
        .where(F.col("sites") >= min_sites - _band(min_sites, lg_k))
    )
    sure = spread.where(F.col("sites") > min_sites + _band(min_sites, lg_k)).select("line", "keeper")
    near = spread.where(F.col("sites") <= min_sites + _band(min_sites, lg_k)).select("line", "keeper")
    counted = lines.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("n"))
    exact = near.join(counted.where(F.col("n") >= min_sites).select("line"), "line", "left_semi")
    return sure.unionByName(exact)


def _band(min_sites: int, lg_k: int) -> int:
    """Four standard errors of a sketch at the threshold, and one."""
    return int(4 * 1.04 / 2 ** (lg_k / 2) * min_sites) + 1


def clean(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """docs with boilerplate lines taken out of text, and n_lines and n_dropped.

    A boilerplate line stays in the document of the least id that has it, so
    that no content goes altogether. Every line that isn't blank is looked
    at, however short. Rows of one id count as one document; rows with a null
    id keep their lines and are nobody's keeper, and don't go through the
    shuffle. A null text stays null and has 0 lines. A text all of whose
    lines go becomes ''. Columns n_lines and n_dropped of docs are replaced,
    others stay; an empty table gives an empty result.
    """
    bad = materialize(boilerplate(docs, min_sites, lg_k))
    hits = _lines(docs.where(F.col("doc_id").isNotNull())).select("doc_id", "line").join(bad, "line")
    drops = (
        hits.where(F.col("keeper").isNull() | (F.col("doc_id") != F.col("keeper")))
        .groupBy("doc_id")
        .agg(F.collect_set("line").alias("__drop"))
    )
    kept = docs.drop("n_lines", "n_dropped", "__drop")
    df = kept.where(F.col("doc_id").isNotNull()).join(drops, "doc_id", "left")
    df = df.unionByName(kept.where(F.col("doc_id").isNull()), allowMissingColumns=True)
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    stay = F.filter(lines, lambda x: ~_counts(x) | ~F.array_contains("__drop", _key(x)))
    df = df.withColumn("__stay", F.when(F.col("__drop").isNotNull(), stay))
    n = F.coalesce(F.size(lines), F.lit(0))
    return df.select(
        *(F.coalesce(F.array_join("__stay", "\n"), F.col("text").cast("string")).alias("text") if c == "text" else c for c in kept.columns),
        F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("__stay").isNotNull(), n - F.size("__stay")), F.lit(0)).cast("long").alias("n_dropped"),
    )


def oracle_sql(min_sites: int = MIN_SITES) -> str:
    """The same result for DuckDB, with exact counts of sites."""
    return f"""
WITH own AS (SELECT doc_id, source, unnest(list_distinct(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents),
seen AS (SELECT * FROM own WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
bad AS (SELECT line, min(doc_id) AS keeper FROM seen GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
drops AS (
  SELECT doc_id, list(DISTINCT seen.line) AS lines FROM seen JOIN bad USING (line)
  WHERE doc_id IS NOT NULL AND (keeper IS NULL OR doc_id <> keeper) GROUP BY doc_id),
cut AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS lines,
    CASE WHEN x.lines IS NULL THEN string_split(d.text, chr(10))
      ELSE list_filter(string_split(d.text, chr(10)), lambda l: NOT list_contains(x.lines, l)) END AS stay
  FROM documents d LEFT JOIN drops x USING (doc_id))
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(stay), 0)::BIGINT AS n_dropped,
  CASE WHEN text IS NULL THEN NULL WHEN len(stay) = 0 THEN '' ELSE array_to_string(stay, chr(10)) END AS text
FROM cut
"""
