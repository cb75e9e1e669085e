"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback.

The vocabulary comes from a SentencePiece model file, whose path is a
parameter; the driver reads it and ships it. Nothing is trained.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shipped, by_slice

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: What a character outside the vocabulary costs beyond the lowest score.
UNKNOWN_PENALTY = 10.0
CACHED_SEGMENTS = 300_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + n]
        at += n


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """(piece, score, kind) by id, and whether the model is a unigram one."""
    pieces, unigram = [], True
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            score = float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0
            pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
        elif number == 2:
            unigram = dict(_fields(value)).get(3, 1) == 1
    return pieces, unigram


def log_scores(pieces: list[tuple[str, float, int]], unigram: bool) -> list[float]:
    """Log scores by id: a unigram model's own; else minus the log of the merge rank, as Zipf's law has it."""
    if unigram:
        return [s for _, s, _ in pieces]
    total = sum(1 / (2 - s) for _, s, k in pieces if k == NORMAL)
    return [-math.log((2 - s) * total) for _, s, _ in pieces]


@dataclass
class Trie:
    """Double array over bytes: from state s, byte b leads to base[s] + b if check there is s."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # id of the piece that ends at a state, or -1


def build_trie(words: dict[bytes, int]) -> Trie:
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for word, i in words.items():
        node = 0
        for b in word:
            node_next = children[node].get(b)
            if node_next is None:
                node_next = children[node][b] = len(children)
                children.append({})
                ends.append(-1)
            node = node_next
        ends[node] = i
    size = 1024
    base, check, piece = [0] * size, [-1] * size, [-1] * size
    check[0] = -2  # the root is nobody's child
    first, todo = 1, [(0, 0)]
    while todo:
        node, state = todo.pop()
        piece[state] = ends[node]
        kids = sorted(children[node])
        if not kids:
            continue
        while first < size and check[first] != -1:
            first += 1
        slot, tries = first, 0
        while True:
            at = slot - kids[0]
            top = at + 256
            if top >= size:
                more = max(top + 1, size * 2) - size
                base += [0] * more
                check += [-1] * more
                piece += [-1] * more
                size += more
            if at >= 0 and check[slot] == -1 and all(check[at + k] == -1 for k in kids):
                break
            slot, tries = slot + 1, tries + 1
        if tries > 512:  # the front is nearly full: don't search it again
            first = slot
        base[state] = at
        for k in kids:
            check[at + k] = state
            todo.append((children[node][k], at + k))
    return Trie(np.array(base, np.int32), np.array(check, np.int32), np.array(piece, np.int32))


@dataclass
class Tokenizer:
    trie: Trie
    scores: np.ndarray
    byte_ids: list[int]
    surface: list[bytes]  # what each id decodes to
    unknown: float
    breaks: str  # characters that only stand alone as pieces
    apart: bool  # whether no piece has the marker after another character
    cache: dict[str, bytes] = field(default_factory=dict)

    def segments(self, text: str) -> list[str]:
        """Cuts marked text where no piece reaches across, so that each part has its own best path."""
        if not self.apart:
            return [text] if text else []
        return re.findall(f"{MARK}*[^{MARK}{self.breaks}]+|{MARK}+|[{self.breaks}]" if self.breaks else f"{MARK}*[^{MARK}]+|{MARK}+", text)

    def viterbi(self, parts: list[str]) -> list[bytes]:
        """Ids of the best path of each part, as packed int32; all parts step through the trie together."""
        coded = [p.encode() for p in parts]
        data = np.frombuffer(b"".join(coded), np.uint8)
        lengths = np.array([len(c) for c in coded], np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        stop = np.repeat(begins[1:], lengths)
        starts = np.flatnonzero((data & 0xC0) != 0x80)  # character boundaries
        width = np.diff(np.append(starts, len(data)))
        # walk the trie from every character at once
        at, state, depth = starts, np.zeros(len(starts), np.int64), 0
        which = np.arange(len(starts))
        single = np.zeros(len(starts), bool)
        hits = []
        while len(at):
            inside = at + depth < stop[at]
            at, state, which = at[inside], state[inside], which[inside]
            to = self.trie.base[state] + data[at + depth]
            ok = self.trie.check[to] == state
            at, state, which = at[ok], to[ok].astype(np.int64), which[ok]
            depth += 1
            piece = self.trie.piece[state]
            hit = piece >= 0
            hits.append((at[hit], np.full(int(hit.sum()), depth, np.int64), piece[hit], self.scores[piece[hit]]))
            single[which[hit & (width[which] == depth)]] = True
        lone = ~single  # not in the vocabulary: one step at a price
        hits.append((starts[lone], width[lone], np.full(int(lone.sum()), -1, np.int32), np.full(int(lone.sum()), self.unknown)))
        begin, size, piece, score = (np.concatenate(x) for x in zip(*hits, strict=True))
        # best paths, by position within the part; a part has one piece of a length at a position, so no two compete in a step
        part = np.repeat(np.arange(len(parts)), lengths)
        place = begin - begins[part[begin]]
        order = np.argsort(place, kind="stable")
        begin, size, piece, score, place = begin[order], size[order], piece[order], score[order], place[order]
        end = begin + size + part[begin]  # each part has one position more than bytes
        begin = begin + part[begin]
        best, back = np.full(len(data) + len(parts), -np.inf), np.full(len(data) + len(parts), -1, np.int64)
        best[begins[:-1] + np.arange(len(parts))] = 0.0
        cuts = np.flatnonzero(np.diff(place)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True):
            sums = best[begin[lo:hi]] + score[lo:hi]
            better = np.flatnonzero(sums > best[end[lo:hi]])
            best[end[lo:hi][better]] = sums[better]
            back[end[lo:hi][better]] = lo + better
        begin, piece, back = begin.tolist(), piece.tolist(), back.tolist()
        out = []
        for i, c in enumerate(coded):
            zero = int(begins[i]) + i
            now, path = zero + len(c), []
            while now > zero:
                k = back[now]
                if piece[k] >= 0:
                    path.append(piece[k])
                else:
                    path += [self.byte_ids[b] for b in reversed(c[begin[k] - zero : now - zero])]
                now = begin[k]
            out.append(np.array(path[::-1], np.int32).tobytes())
        return out

    def learn(self, parts: set[str]) -> None:
        """Caches the paths of parts it doesn't know."""
        new = sorted(p for p in parts if p not in self.cache)
        if len(self.cache) + len(new) > CACHED_SEGMENTS:
            self.cache.clear()
            new = sorted(parts)
        room = 1 << 20
        lo = 0
        while lo < len(new):  # about a megabyte of text at a time
            hi, total = lo, 0
            while hi < len(new) and (hi == lo or total < room):
                total += len(new[hi])
                hi += 1
            self.cache.update(zip(new[lo:hi], self.viterbi(new[lo:hi]), strict=True))
            lo = hi

    def marked(self, text: str) -> list[list[str]]:
        """Segments of each stretch of a text between literal markers."""
        if not text:
            return [[]]
        return [self.segments(x) for x in (" " + t if i == 0 else t for i, t in enumerate(text.split(MARK))) for x in [x.replace(" ", MARK)]]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed int32 ids of each text. A marker in the text itself becomes its bytes, so decoding gives the text back."""
        cut = [self.marked(t) for t in texts]
        literal = np.array([self.byte_ids[b] for b in MARK.encode()], np.int32).tobytes()
        self.learn({p for one in cut for stretch in one for p in stretch})
        return [literal.join(b"".join(map(self.cache.__getitem__, stretch)) for stretch in one) for one in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: markers become spaces, bytes join to characters, the space put in front goes."""
        whole = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return whole[1:] if whole.startswith(" ") else whole


def load(path: str = MODEL) -> Tokenizer:
    pieces, unigram = read_model(path)
    scores = np.array(log_scores(pieces, unigram))
    words = {p.encode(): i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER) and p}
    byte_ids = [-1] * 256
    surface = []
    for i, (p, _, k) in enumerate(pieces):
        if k == BYTE:
            byte_ids[int(p[3:5], 16)] = i
            surface.append(bytes([int(p[3:5], 16)]))
        else:
            surface.append(b"" if k in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode())
    if -1 in byte_ids:
        raise ValueError("the model has no byte pieces, so it can't give every text back")
    texts = [p for p, _, k in pieces if k in (NORMAL, USER)]
    if MARK not in texts:
        raise ValueError("the model has no piece for white space alone, so it can't give every text back")
    inner = {c for p in texts if len(p) > 1 for c in p}
    apart = not any(MARK in p.lstrip(MARK) for p in texts)
    normal = [scores[i] for i, (_, _, k) in enumerate(pieces) if k == NORMAL]
    return Tokenizer(build_trie(words), scores, byte_ids, surface, min(normal) - UNKNOWN_PENALTY, "".join(c for c in "\n\r\t" if c not in inner), apart)


def tokenize(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with tokens (ids), n_tokens, n_byte_tokens and round_trip, whether decoding gives exactly the text.

    Columns of these names in docs are replaced, all others stay. A null or
    empty text has no tokens and counts as given back. Texts are cut where no
    piece reaches across, and the paths of the parts are cached per task up to
    CACHED_SEGMENTS; a text without such cuts is one part, whatever its
    length. Rows are independent, so repeated rows and empty tables need
    nothing special.
    """
    shipped = Shipped(docs.sparkSession, load(model))
    added = [("tokens", "array<int>"), ("n_tokens", "int"), ("n_byte_tokens", "int"), ("round_trip", "boolean")]
    kept = docs.drop(*(n for n, _ in added))
    place = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shipped.value
        is_byte = np.zeros(len(t.surface), bool)
        is_byte[t.byte_ids] = True

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or "" for x in b.column(place).to_pylist()]
            coded = [np.frombuffer(c, np.int32) for c in t.encode_batch(texts)]
            same = [t.decode(c.tolist()) == x for c, x in zip(coded, texts, strict=True)]
            sizes = np.array([len(c) for c in coded], np.int32)
            ids = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(coded).astype(np.int32))
            )
            low = pa.array([int(is_byte[c].sum()) for c in coded], pa.int32())
            return pa.RecordBatch.from_arrays(
                [*b.columns, ids, pa.array(sizes), low, pa.array(same)], [*b.schema.names, *(n for n, _ in added)]
            )

        yield from by_slice(work, 64)(batches)

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    df = kept.withColumn("text", F.col("text").cast("string"))
    return df.mapInArrow(run, f"{head}, " + ", ".join(f"{n} {k}" for n, k in added))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
