"""Sharding along a Hilbert curve over quantised metadata, cut into runs of equal row counts."""

from __future__ import annotations

import sys
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

SHARDS = 24
BITS = 6
#: The metadata dimensions of documents, in the order of the curve's axes.
DIMENSIONS = ("lang", "source", "n_chars")
#: Rows that one task ranks.
ROWS_PER_RANGE = 250_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of cells, integer coordinates below 2**bits, as int64.

    Gray-code form: exchanges and inversions from the highest bit down undo
    the curve's rotations; the bits are then interleaved.
    """
    n, dims = cells.shape
    x = [cells[:, d].astype(np.int64).copy() for d in range(dims)]
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for d in range(dims):
            high = (x[d] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[dims - 1] & (1 << level), (1 << level) - 1, 0)
    out = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | (((x[d] ^ turn) >> level) & 1)
    return out


def _key(col: Column, kind: T.DataType) -> Column:
    """A string as its bytes; other columns as a double that keeps their order, null before all else."""
    if isinstance(kind, T.StringType):
        return col.cast("binary")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.unix_micros(col.cast("timestamp")).cast("double"), F.lit(float("-inf")))
    return F.coalesce(col.cast("double"), F.lit(float("-inf")))


def _string_cuts(keys: DataFrame, name: str, parts: int) -> list[bytes | None]:
    """The values at which the shares i / parts of all rows are reached, in order of whole strings, null first.

    Distinct values are counted and sorted by range; a value's rank is its
    range's offset plus the counts before it in the range.
    """
    counted = materialize(keys.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n")))
    ranges = max(1, -(-counted.count() // ROWS_PER_RANGE))
    ranged = materialize(counted.repartitionByRange(ranges, "value").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    offsets, total = [], 0
    for r in sums:
        offsets.append((r["part"], total))
        total += r["n"]
    if not total:
        return []
    known = keys.sparkSession.createDataFrame(offsets, "part int, offset long")
    upto = F.col("offset") + F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    # the shares a value reaches: those above (upto - n) / total, up to upto / total; the whole is no cut
    ranked = ranged.join(F.broadcast(known), "part").withColumn("upto", upto)
    reached, before = (F.expr(f"least({x} * {parts}L, {total * parts - 1}L) div {total}L") for x in ("upto", "(upto - n)"))
    return [r["value"] for r in ranked.where(reached > before).orderBy("upto").select("value").collect()]


def cut_points(keys: DataFrame, names: list[str], bits: int) -> list[list]:
    """At most 2**bits - 1 increasing quantiles of each column, over all rows."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    strings = {f.name for f in keys.schema.fields if isinstance(f.dataType, T.BinaryType)}
    numbers = [n for n in names if n not in strings]
    row = keys.agg(*(F.percentile_approx(n, shares, 10_000).alias(n) for n in numbers)).collect()[0] if numbers else {}
    return [_string_cuts(keys, n, 1 << bits) if n in strings else sorted(set(row[n] or [])) for n in names]


def _passed(cuts: list, x: pd.Series, string: bool) -> np.ndarray:
    """How many cut points each value has reached."""
    if not string:
        return np.searchsorted(cuts, x.to_numpy(), side="right")
    known = [bytes(c) for c in cuts if c is not None]
    codes, values = pd.factorize(x)  # the code of null is -1
    return np.array([*(bisect_right(known, v) for v in values), 0])[codes] + (len(cuts) - len(known))


def assign(
    docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, also: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, law, shard, slot, grown_shard of every row of docs; row counts differ by one at most.

    The order is by curve index, then crc32 of the text, then doc_id (nulls
    first); rows equal in all of these are alike but for their size's
    order, so any order of them is the same result. A null text has size 8
    and the crc32 of ''. Null metadata sorts first; an empty table gives an
    empty result; columns other than doc_id, text, the dimensions and those
    in `also`, which are carried along, are ignored. The law `rows` goes
    before all else: equal texts of one cell of metadata stand side by side,
    so a group of them lies in as few shards as its count allows, and a group
    larger than a shard, or one spread over metadata, in several.

    Texts aren't shuffled: keys of a few dozen bytes a row are sorted by range
    on the whole order, ids included, so that no hot value lands in one task.
    The ranged rows are written out, which fixes the ranges; a row's rank is
    then its range's offset (one number a range) plus its place in the range.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    names = [f"d{i}" for i in range(len(dimensions))]
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    metadata = docs.select(*(_key(F.col(d), kinds[d]).alias(n) for d, n in zip(dimensions, names, strict=True)))
    cuts = cut_points(metadata, names, bits)
    string = [isinstance(kinds[d], T.StringType) for d in dimensions]

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        # few distinct values spread over the whole axis, else a coarse dimension would only sway the curve's lowest bits
        at = [_passed(c, x, s) * (1 << bits) // (len(c) + 1) for c, x, s in zip(cuts, columns, string, strict=True)]
        return pd.Series(hilbert_index(np.stack(at, 1), bits))

    keys = docs.select(
        "doc_id", *also, (F.length(t) + 8).cast("long").alias("size"), F.crc32(t).cast("long").alias("text_crc32"),
        *(_key(F.col(d), kinds[d]).alias(n) for d, n in zip(dimensions, names, strict=True)),
    )
    order = ["hilbert", "text_crc32", "doc_id"]
    keys = materialize(keys.select("doc_id", *also, "size", "text_crc32", curve(*names).alias("hilbert")))
    n = keys.count()
    ranges = max(1, -(-n // ROWS_PER_RANGE), min(shards, -(-n // 1000)))
    ranged = keys.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition in the upper 31 bits, the row's place in it below
    ranked = materialize(ranged.withColumn("at", at))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranked.groupBy(part.alias("part")).count().orderBy("part").collect()
    offsets, before = [], 0
    for r in counts:
        offsets.append((r["part"], before))
        before += r["count"]
    # a row of 16 bytes for each range of up to ROWS_PER_RANGE rows
    known = docs.sparkSession.createDataFrame(offsets, "part long, offset long")
    df = ranked.withColumn("part", part).join(F.broadcast(known), "part").withColumn("rank", F.col("offset") + place)
    small, large = divmod(before, shards)  # the first `large` shards hold one row more
    edge = large * (small + 1)
    in_large = F.col("rank") < edge
    shard = F.when(in_large, F.floor(F.col("rank") / (small + 1))).otherwise(large + F.floor((F.col("rank") - edge) / max(small, 1)))
    df = df.withColumn("shard", shard.cast("int"))
    start = F.least(F.col("shard"), F.lit(large)) * (small + 1) + F.greatest(F.col("shard") - large, F.lit(0)) * small
    return df.select(
        "doc_id", *also, "size", "text_crc32", "hilbert", F.lit("rows").alias("law"), "shard",
        (F.col("rank") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS) -> None:
    """Write docs as Parquet under path/shard=N/, in slot order, so that files prune by every dimension.

    Every row is written once, whatever its id: rows are numbered, written to
    the shared folder, and meet their shard by number. Columns shard and slot
    of docs are replaced.
    """
    own = materialize(docs.drop("shard", "slot", "row__").withColumn("row__", F.monotonically_increasing_id()))
    placed = assign(own, shards, dimensions, also=("row__",)).select("row__", "shard", "slot")
    df = own.join(placed, "row__").drop("row__")
    df.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
