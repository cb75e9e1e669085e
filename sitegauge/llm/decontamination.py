"""Benchmark decontamination: pigeonhole pieces find test items, bit-parallel edit distance verifies them."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shipped, by_slice, materialize

#: Edits allowed for a character of an item. An item too short for one edit must stand exactly, between word boundaries.
ERROR_SHARE = 0.06
#: Items that one scan of the documents looks for.
BLOCK = 20_000
LEAKS = "array<struct<item_id:long,start:int,end:int,distance:int>>"
_RUN = re.compile(r"\S+")


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normalise(text: str) -> str:
    """Lower case, each run of white space one space, none at the ends."""
    return " ".join(_lower(text).split())


def positions(text: str) -> list[int]:
    """Where each character of the normalised text stands in the text; a space stands where the gap begins."""
    out: list[int] = []
    for m in _RUN.finditer(_lower(text)):
        if out:
            out.append(out[-1] + 1)
        out.extend(range(m.start(), m.end()))
    return out


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of pattern to any substring of text, and the end of the first such, by bit vectors."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = mask, 0, m
    best, where = m, 0
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(zero | up) & mask, up & zero
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = (plus << 1) & mask, (minus << 1) & mask
        up, down = minus | ~(zero | plus) & mask, plus & zero
        if score < best:
            best, where = score, i + 1
    return best, where


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces (offset, text) that cover the item: with at most budget edits, one stays whole."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Finder:
    """Finds the items, (id, normalised text), in texts."""

    def __init__(self, items: list[tuple[int, str]], error_share: float) -> None:
        self.items = [(i, t, int(len(t) * error_share)) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, budget) in enumerate(self.items):
            for offset, piece in pieces(t, budget):
                places.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[dict]:
        """Every place where an item stands with no more edits than its budget, in code points of text."""
        if not self.items or not text:
            return []
        plain = normalise(text)
        tried: set[tuple[int, int]] = set()
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for end, (size, where) in self.automaton.iter(plain):
            for k, offset in where:
                start = end - size + 1 - offset
                _, item, budget = self.items[k]
                if (k, start) in tried:
                    continue
                tried.add((k, start))
                if not budget:
                    if whole_words(plain, start, start + len(item)):
                        found[k, start + len(item)] = (start, 0)
                    continue
                if plain.startswith(item, max(start, 0)) and start >= 0:
                    found[k, start + len(item)] = (start, 0)
                    continue
                low = max(0, start - budget)
                window = plain[low : max(0, start + len(item) + budget)]
                distance, stop = myers(item, window)
                if distance <= budget:
                    _, back = myers(item[::-1], window[:stop][::-1])
                    found[k, low + stop] = (low + stop - back, distance)
        if not found:
            return []
        at, out = positions(text), []
        last: dict[int, tuple[int, int, int]] = {}
        for (k, end), (start, distance) in sorted(found.items(), key=lambda x: (x[0][0], x[1][0], x[1][1])):
            if k in last and start < last[k][1] and last[k][2] <= distance:
                continue  # overlaps one at least as good
            if k in last and start < last[k][1]:
                out.pop()
            last[k] = (start, end, distance)
            out.append({"item_id": self.items[k][0], "start": at[start], "end": at[end - 1] + 1, "distance": distance})
        return out


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] neither begins nor ends within a word."""
    return not (start > 0 and text[start - 1].isalnum() and text[start].isalnum()) and not (
        end < len(text) and text[end - 1].isalnum() and text[end].isalnum()
    )


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items to look for, about BLOCK at a time; null and blank ones can't be, equal rows count once."""
    items = benchmark.where(F.col("text").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    n = -(-items.count() // BLOCK)
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        found = {(r["item_id"], t) for r in rows if (t := normalise(r["text"]))}
        yield sorted(found, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _scanned(docs: DataFrame, shipped: Shipped, error_share: float, to: str) -> DataFrame:
    """docs with an array of what one block of items has in each text, as the last column."""
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shipped.value, error_share)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())]))

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            here = [finder.find(t or "") for t in b.column(place).to_pylist()]
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(here, kind)], [*b.schema.names, to])

        yield from by_slice(work)(batches)

    return docs.mapInArrow(run, f"{head}, `{to}` {LEAKS}")


def matches(docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE) -> DataFrame:
    """doc_id, item_id, start, end, distance: one row for each place in docs where an item stands.

    start and end are code points of the text. Texts are scanned whole and
    compared in lower case with white space collapsed. A null or empty text
    holds no item, a null or blank item stands nowhere, an item without an id
    has a null one; repeated rows each give theirs. The items go to every
    task in blocks of about BLOCK, each a scan of the documents.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out, shipped = None, None
    for items in _blocks(benchmark):
        if out is not None:
            out = materialize(out)  # before the next block, so that only one is in memory
            shipped.release()
        shipped = Shipped(docs.sparkSession, items)
        found = _scanned(own, shipped, error_share, "leaks").select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        nothing = own.where(F.lit(False)).withColumn("leaks", F.array().cast(LEAKS))
        return nothing.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE) -> DataFrame:
    """The rows of docs that hold no item, with all their columns, as matches() finds them.

    Blocks of items follow each other, each on what the one before has left.
    """
    to = "leaks"
    while to in docs.columns:
        to += "_"
    left, shipped = docs.withColumn("text", F.col("text").cast("string")), None
    for items in _blocks(benchmark):
        if shipped is not None:
            left = materialize(left)
            shipped.release()
        shipped = Shipped(docs.sparkSession, items)
        left = _scanned(left, shipped, error_share, to).where(F.size(to) == 0).drop(to)
    return left


cloudpickle.register_pickle_by_value(sys.modules[__name__])
