"""Near-dedup: BagMinHash signatures of 5-word shingle multisets, banded; multiset overlap verifies, components join.

Equal texts collapse to one node first, so copies are never paired. A node is
the 128-bit hash of its text. Of the pairs that share a band, each bucket's
most central member meets all others first; then every pair that no chain of
links joins yet is verified, in cells of a few hundred texts.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, by_slice, discard, materialize

WORDS = 5
SIMILARITY = 0.8
#: 20 bands of 4 components: a pair at 0.8 shares a band with probability 1 - (1 - 0.8**4)**20 > 0.99997.
BANDS, ROWS = 20, 4
#: Texts on each side of a cell of comparisons, about, and their code points.
BLOCK, BLOCK_CHARS = 256, 2_000_000
CACHED_WORDS = 200_000
#: Shingles of texts that a task keeps at hand.
CACHED_SHINGLES = 2_000_000
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_MASK = (1 << 64) - 1
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class WordHashes(dict):
    """word -> 64-bit hash; forgets all when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, as sorted hashes, and how often each stands; a text of fewer words is one shingle."""
    words = [w for w in _SPACE.split(text) if w]
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(WORDS, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total = _mix(total + h[i : len(h) - k + 1 + i] * _ODD[i])
    return np.unique(total, return_counts=True)


def bag_min_hash(elements: np.ndarray, weights: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """`size` components, each the first point of Poisson processes over time and weight.

    Weights are discretised at integers and cut into blocks [0,1), [1,2),
    [2,4), [4,8) and so on. Each block of an element is one process of rate
    size * width, seeded by element and block; its points fall in time order
    on a component and on a level of the block, and count where the level is
    below the weight. So a component of two bags agrees with the probability
    of their weighted Jaccard similarity. A process stops past the largest
    component found so far.
    """
    out = np.full(size, np.inf)
    if not len(elements):
        return out
    seeds, widths, inside = [], [], []
    low, width, block = 0, 1, 0
    while True:
        has = weights > low
        if not has.any():
            break
        seeds.append(_mix(elements[has] + np.uint64(block * int(_ODD[1]) & _MASK)))
        inside.append(np.minimum(weights[has] - low, width))
        widths.append(np.full(int(has.sum()), width, np.int64))
        low, width, block = low + width, (width if block == 0 else width * 2), block + 1
    seed, wide, level = np.concatenate(seeds), np.concatenate(widths), np.concatenate(inside)
    time, step = np.zeros(len(seed)), 0
    while len(seed):
        step += 1
        a = _mix(seed + np.uint64(step * int(_ODD[0]) & _MASK))
        b = _mix(a ^ _ODD[2])
        time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (size * wide)
        on = (b & np.uint64(0xFFFFFFFF)) % np.uint64(size)
        counts = ((b >> np.uint64(32)).astype(np.int64) % wide) < level
        np.minimum.at(out, on[counts].astype(np.int64), time[counts])
        go = time < out.max()
        seed, wide, level, time = seed[go], wide[go], level[go], time[go]
    return out


def band_keys(signature: np.ndarray) -> list[int]:
    """A 64-bit key for each band; the lowest bits of a component, where machines may differ, don't count."""
    if not np.isfinite(signature[0]):
        return []
    bits = signature.view(np.uint64) >> np.uint64(12)
    keys = np.arange(BANDS, dtype=np.uint64) * _ODD[3]
    for r in range(ROWS):
        keys = _mix(keys + bits[r::ROWS] * _ODD[r])
    return keys.view(np.int64).tolist()


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - both
    return both / either if either else 1.0


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    last: dict[bytes, list[int]] = {}

    def bands(node: bytes, text: str) -> list[int]:
        if node not in last:
            if len(last) > 4096:
                last.clear()
            last[node] = band_keys(bag_min_hash(*shingles(text, hashes)))
        return last[node]

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b["text"].to_pylist()
        found = [bands(n, t) for n, t in zip(b["node"].to_pylist(), texts, strict=True)]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([b["doc_id"], b["node"], sizes, pa.array(found, pa.list_(pa.int64()))], ["doc_id", "node", "chars", "bands"])

    yield from by_slice(work)(batches)


class _Cell:
    """The texts of one cell as they stream in: few asked (side 0) against many others (side 1)."""

    def __init__(self, key: int) -> None:
        self.key, self.asked, self.others = key, [], []

    def links(self, least: float) -> Iterator[tuple[bytes, bytes]]:
        """For each asked text, one pair with each other component that holds a text similar to it.

        The others' shingles are one sorted list with their owners, in which
        each asked text looks up its own: its overlaps with all of them come
        from the places where a shingle is shared.
        """
        if not self.asked or not self.others:
            return
        sizes = np.array([len(x[2][0]) for x in self.others])
        owner = np.repeat(np.arange(len(self.others)), sizes)
        shingle = np.concatenate([x[2][0] for x in self.others])
        weight = np.concatenate([x[2][1] for x in self.others])
        order = np.argsort(shingle, kind="stable")
        owner, shingle, weight = owner[order], shingle[order], weight[order]
        total = np.array([int(x[2][1].sum()) for x in self.others])
        for node, label, (own, times) in self.asked:
            low, high = np.searchsorted(shingle, own, "left"), np.searchsorted(shingle, own, "right")
            n = high - low
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            both = np.bincount(owner[at], np.minimum(weight[at], np.repeat(times, n)), len(self.others))
            told = {label}
            for k in np.flatnonzero((both > 0) & (both >= least * (total + int(times.sum()) - both))).tolist():
                other, theirs, _ = self.others[k]
                if theirs not in told:
                    told.add(theirs)
                    yield node, other


def _verified(least: float):
    """A mapInArrow function over rows (cell, side, node, label, text) in order of cell: the similar pairs (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bags, held = WordHashes(), {}, 0
        cell = _Cell(0)

        def bag(node: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            if node not in bags:
                if held >= CACHED_SHINGLES:
                    bags.clear()
                    held = 0
                bags[node] = shingles(text, hashes)
                held += len(bags[node][0])
            return bags[node]

        def told(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["u", "v"])

        for whole in batches:
            found: list[tuple[bytes, bytes]] = []
            for start in range(0, whole.num_rows, SLICE):
                b = whole.slice(start, SLICE)
                for key, side, node, label, text in zip(*(b[c].to_pylist() for c in ("cell", "side", "node", "label", "text")), strict=True):
                    if key != cell.key:
                        found += cell.links(least)
                        cell = _Cell(key)
                    (cell.others if side else cell.asked).append((node, label, bag(node, text)))
            yield told(found)
        yield told(list(cell.links(least)))

    return run


def _links(cells: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The similar pairs (u, v) of each cell, from rows (cell, side, node, label); texts: node, text."""
    rows = cells.join(texts, "node").select("cell", "side", "node", "label", "text")
    return materialize(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_verified(least), "u binary, v binary"))


def bucket_members(nodes: DataFrame) -> DataFrame:
    """node, chars, bucket and score of every member of a bucket of two or more, from rows (node, chars, bands); score: how full its buckets are."""
    rows = nodes.select("node", "chars", F.posexplode("bands").alias("i", "key")).select("node", "chars", F.xxhash64("i", "key").alias("bucket"))
    # sums are written out before they are joined: only then can a join split the rows of a hot bucket
    full = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    shared = materialize(rows.join(full, "bucket").select("node", "chars", "bucket", "n"))
    score = shared.groupBy("node").agg(F.sum("n").alias("score"))
    return materialize(shared.drop("n").join(score, "node"))


def _blocks(n: Column, chars: Column) -> Column:
    """Blocks for so many texts of so many code points."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(chars / BLOCK_CHARS))


def _dealt(node: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(5)), blocks)


def star_cells(members: DataFrame) -> DataFrame:
    """Cells of each bucket's most central member, whose buckets are fullest, and the other members.

    A text and its edited copies meet so even where two copies are too far
    apart. A centre's partners, each once however many buckets they share,
    are dealt to cells of about BLOCK; so the work is linear in the members.
    """
    centres = materialize(members.groupBy("bucket").agg(F.max_by("node", F.struct("score", "node")).alias("centre")))
    pairs = materialize(members.join(centres, "bucket").where("node <> centre").select("centre", "node", "chars").distinct())
    blocks = materialize(pairs.groupBy("centre").agg(_blocks(F.count("*"), F.sum("chars")).alias("blocks")))
    others = pairs.join(blocks, "centre").select(F.xxhash64("centre", _dealt("node", F.col("blocks"))).alias("cell"), F.lit(1).alias("side"), "node")
    asked = blocks.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b")).select(
        F.xxhash64("centre", "b").alias("cell"), F.lit(0).alias("side"), F.col("centre").alias("node")
    )
    return others.unionByName(asked).withColumn("label", F.col("node"))


def open_cells(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells that hold, between them, every pair that shares a bucket and whose texts lie in different components.

    Of each bucket the members outside its most frequent component are asked,
    against all members, both in blocks of about BLOCK; pairs within that
    component need no look, so a large family in one component costs nothing.
    """
    label = F.coalesce("label", "node").alias("label")
    of = materialize(members.select("node", "chars", "bucket").join(labels, "node", "left").select("node", "chars", "bucket", label))
    sizes = of.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    n, chars, most = F.col("n"), F.col("chars"), F.col("most")
    mixed = (
        sizes.groupBy("bucket")
        .agg(F.max(F.struct("n", "label", "chars")).alias("most"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.count("*").alias("k"))
        .where("k > 1")
        .select("bucket", most["label"].alias("main"), _blocks(n - most["n"], chars - most["chars"]).alias("rows"), _blocks(n, chars).alias("columns"))
    )
    mine = materialize(of.join(materialize(mixed), "bucket"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = mine.where("label <> main").select("bucket", "node", "label", _dealt("node", F.col("rows")).alias("r"), each("columns").alias("c"))
    others = mine.select("bucket", "node", "label", each("rows").alias("r"), _dealt("node", F.col("columns")).alias("c"))
    both = asked.withColumn("side", F.lit(0)).unionByName(others.withColumn("side", F.lit(1)))
    return both.select(F.xxhash64("bucket", "r", "c").alias("cell"), "side", "node", "label")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in links (u, v): label is the least node of its connected component.

    Labels spread to neighbours and jump to their label's label until none
    changes; each round is written out, and the one before deleted.
    """
    edges = materialize(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = materialize(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    before = labels
    while True:
        heard = edges.join(labels, edges["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, labels["node"] == heard["u"], "left").select(
            "node", F.least("label", "heard").alias("label"), F.col("label").alias("old")
        )
        up = nearer.select(F.col("node").alias("label"), F.col("label").alias("further"))
        now = materialize(nearer.join(up, "label", "left").select("node", F.least("label", "further").alias("label"), "old"))
        discard(before)
        if not now.where(F.col("label") != F.col("old")).limit(1).count():
            discard(edges)
            return now.select("node", "label")
        before, labels = now, now.select("node", "label")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), _node(docs))


def _node(docs: DataFrame) -> Column:
    return F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"))).alias("node")


def _id(doc_id: Column) -> Column:
    """An id as a join key that a null has too."""
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))


def _grouped(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node) of docs, and rows (node, first, n, label) of its different texts; label: the class."""
    keyed = _keyed(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = materialize(keyed.mapInArrow(_signed, f"doc_id {kind}, node binary, chars long, bands array<long>"))
    once = [F.first(c).alias(c) for c in ("chars", "bands")]
    nodes = materialize(signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), *once))
    members = bucket_members(nodes.select("node", "chars", "bands"))
    # a text comes from a row of its least id, so that a text of very many rows isn't shuffled as often
    sharing = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", _id(F.col("first")).alias("id"))
    own = keyed.select("node", _id(F.col("doc_id")).alias("id"), "text").join(sharing, ["node", "id"], "left_semi")
    texts = materialize(own.dropDuplicates(["node", "id"]).select("node", "text"))
    labels = components(_links(star_cells(members), texts, similarity))
    # what the stars leave: all pairs of a bucket that no chain of links joins yet
    more = _links(open_cells(members, labels), texts, similarity)
    of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
    merged = more.join(of("u"), "u", "left").join(of("v"), "v", "left").select(
        F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v")
    )
    last = components(merged).select(F.col("node").alias("before"), F.col("label").alias("after"))
    grouped = nodes.join(labels, "node", "left").select("node", "first", "n", F.coalesce("label", "node").alias("label"))
    grouped = grouped.join(last, grouped["label"] == last["before"], "left").select("node", "first", "n", F.coalesce("after", "label").alias("label"))
    grouped = materialize(grouped)
    discard(nodes, members, texts)
    return signed.select("doc_id", "node"), grouped


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size and n_texts of every row of docs.

    class_id is the least doc_id of the documents that equal texts and links
    of at least `similarity` join, class_size their number, n_texts the
    number of different texts. Null texts count as empty, empty texts equal
    each other and nothing else; texts of under five words are one shingle.
    Rows of one id are rows like others, and so are rows without an id; a
    class of null ids only has a null class_id. An empty table gives an empty
    result; other columns are ignored.
    """
    rows, grouped = _grouped(docs, similarity)
    joined = grouped.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("n_texts"))
    by_node = grouped.join(joined, "label").select("node", "class_id", "class_size", "n_texts")
    return rows.join(by_node, "node").select("doc_id", "class_id", "class_size", "n_texts")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class, with all its columns: one of the least doc_id, of these one of the least text hash.

    Null ids come last. Rows that repeat both the id and the text of the one
    that stays are copies too: any one of them stays.
    """
    _, grouped = _grouped(docs, similarity)
    kept = grouped.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("lacks"), "first", "node")).alias("x")).select("x.first", "x.node")
    stay = kept.select(F.col("node").alias("__node"), _id(F.col("first")).alias("__id"))
    own = docs.withColumns({"__node": _node(docs), "__id": _id(F.col("doc_id"))})
    return own.join(stay, ["__node", "__id"], "left_semi").dropDuplicates(["__node", "__id"]).select(*docs.columns)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
