"""Benchmark decontamination by greedy string tiling.

Tokens are runs of ASCII letters and digits and of characters beyond ASCII, lower-cased. A document and a test item that share a
seed (a run of MIN_TILE tokens, found by a running Karp-Rabin hash and compared token by token)
are tiled: the longest common runs of tokens not yet marked are marked in both, again and
again, down to MIN_TILE tokens. Coverage is the marked share of the item's tokens, so a passage
whose parts were moved about is still found. An item shorter than MIN_TILE is tiled with tiles
of its whole length.

The test set is read in slices of at most SLICE_TOKENS tokens, each broadcast and held against
all documents in one pass, so a test set of any size is covered and a broadcast never grows.

Null and empty texts and items match nothing. Repeated documents each get a row; equal rows of
``benchmark`` are one item. Null identifiers are carried through. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillproof.llm.common import map_batches
from tillproof.scale import written

MIN_TILE = 4
# A document is contaminated by an item of which it holds at least this share of the tokens.
THRESHOLD = 0.5
# Most tokens of test items that one pass over the documents carries.
SLICE_TOKENS = 2_000_000
# Tokens of a document hashed at a time.
CHUNK = 1 << 18
# All ASCII but letters and digits parts tokens.
SPACED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(SPACED).split() if text else []


def running_hash(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows of ``width`` known tokens (not 0), and their Karp-Rabin values modulo 2^64."""
    count = max(0, len(ids) - width + 1)
    known = ids > 0
    whole = known[:count].copy()
    for k in range(1, width):
        whole &= known[k:k + count]
    at = np.flatnonzero(whole)
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = out * BASE + ids[at + k]
    return at, out


def tile(doc: np.ndarray, item: np.ndarray, starts: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in doc, place in item, length), longest first.

    ``starts`` are the pairs of places at which a run of ``least`` equal tokens or more begins: the tokens
    before differ. A candidate runs as far as tokens agree and neither side is marked; ties go to the
    earliest place. Once the item has less than ``least`` tokens that are free, nothing can follow.
    """
    marked_doc: set[int] = set()
    marked_item = np.zeros(len(item), bool)
    tiles: list[tuple[int, int, int]] = []

    def free_run(i: int, j: int) -> int:
        n = 0
        while (i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]
               and i + n not in marked_doc and not marked_item[j + n]):
            n += 1
        return n

    queue: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, j in starts:
        queue[agreeing(doc[i:], item[j:])].append((i, j))
    free = len(item)
    for length in range(len(item), least - 1, -1):
        waiting = sorted(queue.pop(length, ()))
        for i, j in waiting:
            if free < least:
                return tiles
            # A run may have lost tokens to a longer tile: its free parts wait for their turn.
            k = 0
            while k < length:
                n = free_run(i + k, j + k)
                n = min(n, length - k)
                if n == length:
                    tiles.append((i, j, n))
                    marked_doc.update(range(i, i + n))
                    marked_item[j:j + n] = True
                    free -= n
                elif n >= least:
                    queue[n].append((i + k, j + k))
                k += n
                if k < length:
                    # On to the next token of the item that is free.
                    left = np.flatnonzero(~marked_item[j + k:j + length])
                    if not len(left):
                        break
                    k += max(int(left[0]), int(n == 0))
    return tiles


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many tokens agree from the start on."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        differ = a[at:min(at + step, n)] != b[at:min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return n


class Slice:
    """Test items with their seeds, as arrays that a task can search."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], least: int):
        self.words: dict[bytes, int] = {}
        self.items = [(i, np.array([self.words.setdefault(w, len(self.words) + 1) for w in t], np.uint64)) for i, t in items]
        self.least = least
        # An item of fewer tokens than a seed has a seed of its own length.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in {min(least, len(t)) for _, t in self.items}:
            hashes, owners, places = [], [], []
            for n, (_, t) in enumerate(self.items):
                if min(least, len(t)) == width:
                    at, found = running_hash(t, width)
                    hashes.append(found)
                    owners.append(np.full(len(found), n))
                    places.append(at)
            h, o, p = map(np.concatenate, (hashes, owners, places))
            order = np.argsort(h, kind="stable")
            self.seeds[width] = (h[order], o[order], p[order])

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int, list[tuple[int, int, int]]]]:
        """(item_id, tokens of the item, covered tokens, tiles, the tiles) per item with a seed in the text."""
        doc = np.fromiter(map(self.words.get, tokens(text), repeat(0)), np.uint64)
        pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        before = np.concatenate(([0], doc[:-1])) if len(doc) else doc
        for width, (hashes, owners, places) in self.seeds.items():
            parts = []
            for at in range(0, len(doc), CHUNK):
                where, values = running_hash(doc[at:at + CHUNK + width - 1], width)
                low = np.searchsorted(hashes, values, "left")
                hit = (low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == values)
                parts.append((where[hit] + at, values[hit], low[hit]))
            found, values, low = (np.concatenate(p) for p in zip(*parts)) if parts else ((),) * 3
            if not len(found):
                continue
            # All places of the text with one seed meet each place of an item with it at once. A run starts
            # where the tokens before differ, so a run of equal words is listed once per diagonal.
            order = np.argsort(low, kind="stable")
            found, low = found[order], low[order]
            edges = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1], [True])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = found[a:b]
                for s in range(int(low[a]), int(np.searchsorted(hashes, hashes[low[a]], "right"))):
                    n, j = int(owners[s]), int(places[s])
                    item = self.items[n][1]
                    begin = own if j == 0 else own[(own == 0) | (before[own] != item[j - 1])]
                    # Equal hashes are only a hint; the tokens decide.
                    pairs[n].extend((i, j) for i in begin.tolist() if np.array_equal(doc[i:i + width], item[j:j + width]))
        out = []
        for n, starts in pairs.items():
            item_id, item = self.items[n]
            found = tile(doc, item, starts, min(self.least, len(item)))
            out.append((item_id, len(item), sum(t[2] for t in found), len(found), found))
        return out


def slices(benchmark: DataFrame, limit: int) -> list[DataFrame]:
    """The distinct test items in parts of about ``limit`` characters, so at most as many tokens."""
    items = written(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
                    .filter("text IS NOT NULL"), "benchmark")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-size // limit))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [items.filter(place == n) for n in range(parts)]


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated by any item; all columns stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Texts are judged under a hash of their own, as identifiers may be null or repeated.
    judged = docs.select(F.xxhash64(text).alias("doc_id"), "text")
    bad = written(contamination(judged, benchmark, threshold).select(F.col("doc_id").alias("_llm_bad")).distinct(), "leaks")
    return docs.join(bad, F.xxhash64(text) == F.col("_llm_bad"), "left_anti")


def contamination(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = MIN_TILE,
    slice_tokens: int = SLICE_TOKENS,
) -> DataFrame:
    """doc_id, item_id, coverage, item_tokens, covered_tokens, tiles of every contaminated pair."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, coverage double, item_tokens int, covered_tokens int, tiles int"

    def one(items: DataFrame) -> DataFrame:
        rows = [(r.item_id, tokens(r.text)) for r in items.orderBy("item_id", "text").collect()]
        shared = spark.sparkContext.broadcast([(i, t) for i, t in rows if t])

        def make():
            look = Slice(shared.value, least)

            def work(batch):
                out: list[list] = [[] for _ in range(6)]
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for item_id, size, covered, count, _ in look.find(text):
                        if covered >= threshold * size:
                            for column, value in zip(out, (doc_id, item_id, covered / size, size, covered, count)):
                                column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                names = ["doc_id", "item_id", "coverage", "item_tokens", "covered_tokens", "tiles"]
                return pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
            return work

        return map_batches(source, make, schema)

    return reduce(DataFrame.unionByName, [one(part) for part in slices(benchmark, slice_tokens)])
