"""Quality rules: base counts of a text, and Jensen-Shannon distance from language references.

Only DataFrame functions; the texts are read once. A first job reduces every
document to a few dozen counts, written to the shared folder; the references
are sums of those counts by language over all documents, and the verdict is
arithmetic on the counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words

#: Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was with on by".split(),
    "de": "der die und in den von zu das mit ist im dem ein auf".split(),
    "fr": "de la le et les des en un du une que est pour dans".split(),
    "es": "de la que el en y a los se del las un por con".split(),
}
CLASSES = ("lower", "upper", "digit", "space", "symbol", "other")
MIN_WORDS = 50
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.60
#: Beyond both of these a text is odd in both histograms.
JOINT_DISTANCES = (0.16, 0.24)
#: References, one small row a language, are broadcast if there are no more.
MAX_BROADCAST = 10_000


def vocabulary(common_words: dict[str, list[str]] | None = None) -> list[str]:
    return sorted({w for ws in (common_words or COMMON_WORDS).values() for w in ws})


def _removed(text: Column, *pieces: str) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), pieces, text)


def _repeated(window_hash: Callable[[Column], Column], n: Column) -> Column:
    """Hash and position of each 3-word window, in order; equal windows are neighbours."""
    at = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    return F.when(n >= 3, F.sort_array(F.transform(at, lambda i: F.struct(window_hash(i).alias("h"), i.alias("i")))))


def measure(docs: DataFrame, common_words: dict[str, list[str]] | None = None, carry: bool = False) -> DataFrame:
    """One row of counts per row of docs, in columns doc_id, lang, n_words, ..., classes, common.

    With `carry`, the whole row goes along as the struct row__.

    A null text counts as empty: no words, all counts 0. Repeated rows each
    give a row. Words in repeated 3-word windows are found by sorting the
    windows' hashes with their positions, so a text of n words costs n log n
    whatever it repeats.
    """
    vocab = vocabulary(common_words)
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row_too = ["row__"] if carry else []
    row = [F.struct(*docs.columns).alias("row__")] if carry else []
    df = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), t.alias("text"), *row)
    df = df.withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines).withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    df = df.withColumn("rest", F.regexp_replace("text", r"[\p{Ll}\x20]+", ""))
    df = df.withColumn("blanks", F.length("text") - F.length(_removed(F.col("text"), " ")))
    df = df.withColumn("dense", _removed(F.col("rest"), "\t", "\n", "\x0b", "\x0c", "\r"))
    cased = sorted({x for w in vocab for x in (w, w.capitalize())})
    n = F.size("w")
    wh = F.col("wh")
    length, rest, dense = F.length("text"), F.length("rest"), F.length("dense")
    n_space = F.col("blanks") + rest - dense
    counted = {
        "n_words": n,
        "n_chars": length,
        "n_space": n_space,
        "n_symbols": dense - F.length(_removed(F.col("dense"), *"#*$%&|<>")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_lower": length - F.col("blanks") - rest,
        "n_upper": dense - F.length(F.regexp_replace("dense", r"\p{Lu}+", "")),
        "n_digit": dense - F.length(_removed(F.col("dense"), *"0123456789")),
    }
    df = df.select(
        "doc_id", "lang", *row_too, _repeated(lambda i: F.xxhash64(wh[i], wh[i + 1], wh[i + 2]), n).alias("windows"),
        F.lower(F.concat(F.lit(" "), F.array_join(F.filter("w", lambda x: x.isin(cased)), "  "), F.lit(" "))).alias("spoken"),
        *(c.cast("long").alias(k) for k, c in counted.items()),
    )
    m = F.size("windows")
    pairs = F.zip_with(F.slice("windows", 1, m - 1), F.slice("windows", 2, m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("at", F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))))
    gaps = F.zip_with(
        F.slice("at", 1, F.size("at") - 1), F.slice("at", 2, F.size("at") - 1), lambda a, b: F.least(F.lit(3), b - a)
    )
    covered = F.when(F.size("at") > 0, F.aggregate(gaps, F.lit(3), lambda s, x: s + x))
    known = F.col("n_lower") + F.col("n_upper") + F.col("n_digit") + F.col("n_space") + F.col("n_symbols")
    common = [
        F.floor((F.length("spoken") - F.length(F.replace("spoken", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2))
        for w in vocab
    ]
    return df.select(
        *row_too, "doc_id", "lang", "n_words", (F.col("n_chars") - F.col("n_space")).alias("word_chars"), "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array("n_lower", "n_upper", "n_digit", "n_space", "n_symbols", F.col("n_chars") - known).alias("classes"),
        F.array(*common).alias("common"),
    )


def _shares(counts: Column) -> Column:
    """Counts as shares of their sum; of nothing all shares are 0."""
    total = F.greatest(F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(1).cast("long"))
    return F.transform(counts, lambda x: x / total.cast("double"))


def _listed(lang: Column, n_words: Column, vocab: list[str], common_words: dict[str, list[str]]) -> Column:
    """Counts of a language's common words and of all other words; null for a language without a list."""
    out = F.lit(None).cast("array<long>")
    for own, listed in common_words.items():
        counts = F.array(*(F.col("common")[vocab.index(w)] for w in dict.fromkeys(listed)))
        rest = n_words - F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
        out = F.when(lang == own, F.concat(counts, F.array(rest))).otherwise(out)
    return out


def references(measured: DataFrame, vocab: list[str], common_words: dict[str, list[str]] | None = None) -> DataFrame:
    """By language: shares of each class (class_q) and of each common word and all others (word_q), over all given documents of it.

    Written out, one small row for each language that has words. Rows without
    a language add to no reference; a language without a list has no word_q.
    """
    summed = (
        measured.where(F.col("lang").isNotNull())
        .groupBy(F.col("lang").alias("ref"))
        .agg(
            F.sum("n_words").alias("words"),
            F.array(*(F.sum(F.col("classes")[i]) for i in range(len(CLASSES)))).alias("classes"),
            F.array(*(F.sum(F.col("common")[i]) for i in range(len(vocab)))).alias("common"),
        )
        .where("words > 0")
    )
    word = _listed(F.col("ref"), F.col("words"), vocab, common_words or COMMON_WORDS)
    return materialize(summed.select("ref", _shares(F.col("classes")).alias("class_q"), _shares(word).alias("word_q")))


def _entropy(parts: Column) -> Column:
    """Minus the entropy of an array of probabilities."""
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares.

    Written as entropies, H((p+q)/2) - (H(p) + H(q))/2.
    """
    mixed = _entropy(F.zip_with(p, q, lambda a, b: (a + b) / F.lit(2.0)))
    return F.sqrt(F.greatest((_entropy(p) + _entropy(q)) / F.lit(2.0) - mixed, F.lit(0.0)))


def _with_own(df: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """df with the reference whose language is in `key`, null where there is none; broadcast only after a count."""
    small = refs.count() <= MAX_BROADCAST
    return df.join(F.broadcast(refs) if small else refs, df[key] == refs["ref"], "left")


@dataclass(frozen=True)
class Limits:
    """Beyond these a text is rejected."""

    min_words: int = MIN_WORDS
    class_distance: float = MAX_CLASS_DISTANCE
    word_distance: float = MAX_WORD_DISTANCE
    joint: tuple[float, float] = JOINT_DISTANCES

    def base_failed(self) -> Column:
        return (F.col("n_words") < self.min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(measured: DataFrame, limits: Limits) -> DataFrame:
    """References from all rows that pass the base rules, then once more from those nearer to the first than their language's mean.

    So junk doesn't shape them while most texts of a language aren't junk,
    however much there is. Both steps are sums over all rows, for every
    language.
    """
    vocab = vocabulary()
    passing = measured.where(~limits.base_failed() & F.col("lang").isNotNull()).select("lang", "n_words", "classes", "common")
    first = _with_own(passing, references(passing, vocab), "lang")
    first = first.withColumn("d", distance(_shares(F.col("classes")), F.col("class_q"))).select("lang", "n_words", "classes", "common", "d")
    means = materialize(first.groupBy(F.col("lang").alias("ref")).agg(F.avg("d").alias("mean")))
    return references(_with_own(first, means, "lang").where("d <= mean"), vocab)


def verdict(measured: DataFrame, refs: DataFrame, limits: Limits) -> DataFrame:
    """Adds class_distance, word_distance, base_failed and kept to counts.

    Both distances are from one reference: that of the row's language or,
    where the row has no language or its language no reference, the nearest
    in classes of those of the languages with a list of common words.
    """
    vocab = vocabulary()
    # as many rows as there are lists at most
    known = sorted(refs.where(F.col("ref").isin(list(COMMON_WORDS))).collect(), key=lambda r: r["ref"])
    df = measured.withColumn("p__", _shares(F.col("classes")))
    df = _with_own(df, refs, "lang")
    if known:
        literal = lambda xs: F.array(*map(F.lit, xs))
        each = [F.struct(distance(F.col("p__"), literal(r["class_q"])).alias("d"), F.lit(r["ref"]).alias("ref")) for r in known]
        word_q = F.create_map(*(x for r in known for x in (F.lit(r["ref"]), literal(r["word_q"]))))
        class_q = F.create_map(*(x for r in known for x in (F.lit(r["ref"]), literal(r["class_q"]))))
        df = df.withColumn("near__", F.when(F.col("ref").isNull(), F.array_min(F.array(*each))["ref"]))
        df = df.withColumns({
            "class_q": F.coalesce("class_q", F.try_element_at(class_q, F.col("near__"))),
            "word_q": F.coalesce("word_q", F.try_element_at(word_q, F.col("near__"))),
            "ref": F.coalesce("ref", "near__"),
        }).drop("near__")
    words_p = _shares(_listed(F.col("ref"), F.col("n_words"), vocab, COMMON_WORDS))
    df = df.withColumns({"class_distance": distance(F.col("p__"), F.col("class_q")), "word_distance": distance(words_p, F.col("word_q"))})
    df = df.drop("p__", "ref", "class_q", "word_q")
    by_class, by_word = (F.coalesce(c, F.lit(0.0)) for c in ("class_distance", "word_distance"))
    both = (by_class > limits.joint[0]) & (by_word > limits.joint[1])
    near = (by_class <= limits.class_distance) & (by_word <= limits.word_distance) & ~both
    return df.withColumn("base_failed", limits.base_failed()).withColumn("kept", ~F.col("base_failed") & near)


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Counts, distances and verdict of every row of docs.

    A text is compared with the reference of its language, both in classes
    and in words; one without a language, or whose language no good text has,
    with the nearest of the languages that have a list of common words. Texts
    under min_words words fail the base rules and their distances don't
    count. With no language column filled there are no references and the
    base rules alone decide; an empty table gives an empty result. Columns of docs other than doc_id, text and lang
    are ignored.
    """
    measured = materialize(measure(docs))
    return verdict(measured, fit(measured, limits), limits).drop("classes", "common")


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The rows of docs that pass, with all their columns.

    Rows are written beside their counts, so the texts are measured once and
    no shuffle joins verdicts to texts.
    """
    measured = materialize(measure(docs, carry=True))
    return verdict(measured, fit(measured, limits), limits).where("kept").select("row__.*")


def oracle_sql(limits: Limits = Limits()) -> str:  # noqa: B008
    """The counts and the verdict for DuckDB, over table documents with unique ids."""
    vocab = vocabulary()
    quoted = ", ".join(f"'{w}'" for w in vocab)
    lists = ", ".join(f"('{lang}', '{w}')" for lang, ws in COMMON_WORDS.items() for w in dict.fromkeys(ws))
    cased = ", ".join(f"'{x}'" for w in vocab for x in sorted({w, w.capitalize()}))
    langs = ", ".join(f"'{lang}'" for lang in COMMON_WORDS)
    plogp = "CASE WHEN {0} > 0 THEN {0} * log2({0}) ELSE 0 END"
    size = "length(regexp_replace(t, '{0}', '', 'g'))"

    def distances(name: str, shares: str, refs: str, keys: str) -> str:
        mixed = plogp.format("((p.p + q.q) / 2)")
        own, fixed = plogp.format("p.p"), plogp.format("q.q")
        return f"""{name} AS (
  SELECT doc_id, min(d) AS d FROM (
    SELECT p.doc_id, q.lang, sqrt(greatest((sum({own}) + sum({fixed})) / 2 - sum({mixed}), 0)) AS d
    FROM {shares} p JOIN {refs} q ON {keys} GROUP BY ALL) GROUP BY doc_id)"""

    return f"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
    SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(w[1:len(w) - 2]) AS a, unnest(w[2:len(w) - 1]) AS b, unnest(w[3:len(w)]) AS c FROM base WHERE len(w) >= 3)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM tri WHERE n > 1) GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - {size.format('[#*$%&|<>]')})::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) -
     len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, length(t) AS n_chars, w,
    [length(t) - {size.format('\\p{Ll}')}, length(t) - {size.format('\\p{Lu}')}, length(t) - {size.format('[0-9]')}, length(t) - {size.format('[\\x20\\x09-\\x0D]')}, length(t) - {size.format('[#*$%&|<>]')}] AS k
  FROM base LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
cls AS (
  SELECT doc_id, lang, base_failed, unnest(range(6)) AS i, unnest(list_append(k, n_chars - list_sum(k)))::DOUBLE AS n, greatest(n_chars, 1) AS total FROM judged),
cls_p AS (SELECT doc_id, lang, i, n / total AS p FROM cls),
first_sum AS (SELECT lang, i, sum(n) AS n FROM cls WHERE NOT base_failed AND lang IS NOT NULL GROUP BY ALL),
first_q AS (SELECT lang, i, n / sum(n) OVER (PARTITION BY lang) AS q FROM first_sum),
{distances('first_d', 'cls_p', 'first_q', 'p.i = q.i AND p.lang = q.lang')},
near AS (
  SELECT doc_id FROM (SELECT j.doc_id, d, avg(d) OVER (PARTITION BY lang) AS mean FROM judged j JOIN first_d USING (doc_id) WHERE NOT base_failed AND lang IS NOT NULL) WHERE d <= mean),
cls_sum AS (SELECT lang, i, sum(n) AS n FROM cls SEMI JOIN near USING (doc_id) GROUP BY ALL),
cls_q AS (SELECT lang, i, n / sum(n) OVER (PARTITION BY lang) AS q FROM cls_sum),
cls_any AS (
  SELECT p.doc_id, q.lang, sqrt(greatest((sum({plogp.format('p.p')}) + sum({plogp.format('q.q')})) / 2 - sum({plogp.format('((p.p + q.q) / 2)')}), 0)) AS d
  FROM cls_p p JOIN cls_q q ON p.i = q.i AND (q.lang = p.lang OR (coalesce(p.lang NOT IN (SELECT lang FROM cls_q), true) AND q.lang IN ({langs}))) GROUP BY ALL),
cls_d AS (SELECT doc_id, arg_min(lang, ROW(d, lang)) AS lang, min(d) AS d FROM cls_any GROUP BY doc_id),
listed AS (SELECT * FROM (VALUES {lists}) v(lang, word)),
spoken AS (
  SELECT doc_id, lower(x) AS word, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(w) AS x FROM judged) WHERE x IN ({cased}) AND lower(x) IN ({quoted}) GROUP BY ALL),
word_n AS (
  SELECT j.doc_id, j.lang AS own, l.lang, l.word, coalesce(s.n, 0) AS n, j.n_words FROM judged j CROSS JOIN listed l LEFT JOIN spoken s ON s.doc_id = j.doc_id AND s.word = l.word),
word_all AS (
  SELECT doc_id, own, lang, word, n, n_words FROM word_n
  UNION ALL SELECT doc_id, own, lang, '', n_words - sum(n), n_words FROM word_n GROUP BY doc_id, own, lang, n_words),
word_p AS (SELECT doc_id, lang, word, n / greatest(n_words, 1) AS p FROM word_all),
word_sum AS (SELECT lang, word, sum(n) AS n FROM word_all SEMI JOIN near USING (doc_id) WHERE own = lang GROUP BY ALL),
word_q AS (SELECT lang, word, n / sum(n) OVER (PARTITION BY lang) AS q FROM word_sum),
near_p AS (SELECT p.* FROM word_p p JOIN cls_d c ON c.doc_id = p.doc_id AND c.lang = p.lang),
{distances('word_d', 'near_p', 'word_q', 'p.lang = q.lang AND p.word = q.word')}
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(c.d, 0) <= {limits.class_distance} AND coalesce(x.d, 0) <= {limits.word_distance}
    AND NOT (coalesce(c.d, 0) > {limits.joint[0]} AND coalesce(x.d, 0) > {limits.joint[1]}) AS kept
FROM judged j LEFT JOIN cls_d c USING (doc_id) LEFT JOIN word_d x USING (doc_id)
"""
