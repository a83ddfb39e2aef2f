"""Runs of repeated words: Lyndon arrays by grouping suffixes, Lyndon roots extended into runs.

A run is a stretch of words with smallest period q, as long as it can be, of at least
``least_length`` words and ``least_powers`` times q. By the runs theorem every run holds a longest
Lyndon word of length q that starts in it, under the order of the words or under the reversed
order. So a text is searched in three steps.

1. Words become numbers. A word of a run stands in it once in every period, so a word that occurs
   less than ``least_powers`` times bounds the runs; the stretches between such words are searched
   one by one, counted anew inside each. No run is lost and no extension changed by that.
2. ``lyndon_array`` groups the suffixes of a stretch as the first phase of a grouping suffix sorter
   does: groups are taken from the highest down, and the nearest suffix to the left of a lower group
   gains the group's own context. In the end a suffix's context is its longest Lyndon prefix, so the
   array comes without sorting suffixes. It is built for both orders.
3. Every Lyndon root that is followed by what a run of ``least_powers`` periods must show is extended
   to both sides by common extension of the places a period apart. Roots inside a stretch that is
   already known for their period are skipped, so a run is walked once.

Every row is worked on its own, in memory linear in its text; Spark deals the rows out.

Null text has no words. A null identifier is kept, and such a row's words are taken as they are.
Empty tables give an empty result; repeated rows each give a row. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillproof.llm.common import map_batches, raw_texts

LEAST_LENGTH, LEAST_POWERS = 6, 4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
# Rounds of splitting at rare words; more would only save time, never change a run.
SPLITS = 4
# Places compared at once while a root is extended; doubled as long as they agree.
STEP = 32


@dataclass(frozen=True)
class Run:
    """Words ``start`` to ``start + length`` repeat every ``period`` words."""

    start: int
    length: int
    period: int


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as its number in order of first occurrence."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def stretches(ids: np.ndarray, least_length: int, least_powers: int) -> list[tuple[int, int]]:
    """The (from, to) of the longest stretches whose words may all lie in runs."""
    done, open_ = [], [(0, len(ids), 0)]
    while open_:
        low, high, depth = open_.pop()
        if high - low < least_length:
            continue
        _, own, counts = np.unique(ids[low:high], return_inverse=True, return_counts=True)
        often = counts[own] >= least_powers
        if depth == SPLITS or often.all():
            done.append((low, high))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], often.view(np.int8), [0]))))
        open_.extend((low + a, low + b, depth + 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))
    return sorted(done)


def lyndon_array(ranks: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at every place of ``ranks``.

    Groups of suffixes stand in a linked list, ordered by context; ``below`` leads down. A group is
    final when it is taken. Its members' nearest open suffixes to the left then hold a context that
    ends where the member's begins, so they move up into a new group just above their old one, those
    with more members to their right higher. ``left`` finds the nearest open suffix by halving paths
    over the closed ones.
    """
    n = len(ranks)
    members: list[list[int]] = []
    below: list[int] = []
    width: list[int] = []
    by_rank: dict[int, list[int]] = {}
    for i, r in enumerate(ranks):
        by_rank.setdefault(r, []).append(i)
    of = [0] * n
    for g, r in enumerate(sorted(by_rank)):
        members.append(by_rank[r])
        below.append(g - 1)
        width.append(1)
        for i in by_rank[r]:
            of[i] = g
    # The group above each, so that a new group can be linked in.
    above = list(range(1, len(members))) + [-1]
    left = list(range(-1, n))  # left[i + 1]: i while open, else a place further left

    lengths = [0] * n
    group = len(members) - 1
    while group >= 0:
        own = [i for i in members[group] if of[i] == group]
        for i in own:
            lengths[i] = width[group]
            left[i + 1] = i - 1
        gained: dict[int, int] = {}
        for i in own:
            at = i
            # left[at] names the nearest open place before i.
            while left[at] != at - 1:
                step = left[at] + 1
                left[at] = left[step]
                at = left[at] + 1
            if at > 0:
                gained[at - 1] = gained.get(at - 1, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for i, n_right in gained.items():
            moves.setdefault((n_right, of[i]), []).append(i)
        for n_right, old in sorted(moves, reverse=True):
            moved = moves[n_right, old]
            new = len(members)
            members.append(moved)
            width.append(width[old] + n_right * width[group])
            over = above[old]
            below.append(old)
            above.append(over)
            above[old] = new
            if over >= 0:
                below[over] = new
            for i in moved:
                of[i] = new
        group = below[group]
    return lengths


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many places from the start on are equal."""
    n, at, step = min(len(a), len(b)), 0, STEP
    while at < n:
        differ = a[at:min(at + step, n)] != b[at:min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return n


def stretch_runs(ids: np.ndarray, least_length: int, least_powers: int) -> set[Run]:
    """All runs of ``ids`` by its Lyndon roots under both orders."""
    n = len(ids)
    _, ranks = np.unique(ids, return_inverse=True)
    found: set[Run] = set()
    back = ids[::-1]
    places = np.arange(n)
    for order in (ranks, -ranks):
        period = np.array(lyndon_array(order.tolist()), np.int64)
        # A run holds a root that starts in its first period, with least_powers - 1 whole periods
        # from there on, so the words one and two periods on are equal at the root's both ends.
        fits = np.flatnonzero(places + (least_powers - 1) * period <= n)
        p = period[fits]
        near = fits[(ids[fits] == ids[fits + p]) & (ids[fits + p - 1] == ids[fits + 2 * p - 1])
                    & (ids[fits] == ids[fits + (least_powers - 2) * p])]
        reached: dict[int, int] = {}
        for i in near.tolist():
            p = int(period[i])
            if i < reached.get(p, 0):
                continue
            right = _agreeing(ids[i:], ids[i + p:])
            left = _agreeing(back[n - i:], back[n - i - p:])
            start, end = i - left, i + p + right
            # Roots of this period that start before the last whole period are the same run's.
            reached[p] = max(reached.get(p, 0), end - p + 1)
            if end - start >= max(least_length, least_powers * p):
                found.add(Run(start, end - start, p))
    return found


def find_runs(ids: np.ndarray, least_length: int = LEAST_LENGTH, least_powers: int = LEAST_POWERS) -> list[Run]:
    """The runs of a sequence of word numbers by start, then period."""
    if least_powers < 3:
        raise ValueError("runs of less than three periods would need roots that this search passes over")
    runs = {Run(low + r.start, r.length, r.period) for low, high in stretches(ids, least_length, least_powers)
            for r in stretch_runs(ids[low:high], least_length, least_powers)}
    return sorted(runs, key=lambda r: (r.start, r.period))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        edges[r.start + r.period] += 1
        edges[r.start + r.length] -= 1
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    return b" ".join(words[i] for i in kept.tolist())


def repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a tenth of the documents, chosen by a hash of the identifier, made periodic."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def longest(runs: list[Run]) -> Run | None:
    return min(runs, key=lambda r: (-r.length, r.start, r.period), default=None)


RUN_COLUMNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def detect(docs: DataFrame, damaged: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), collapsed text of every row of ``docs``.

    ``damaged`` makes a tenth of the documents periodic first (``repeated``).
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, counts, runs, texts = batch.column(0).to_pylist(), [], [], []
            for doc_id, text in zip(ids, raw_texts(batch, "text")):
                words = WORD.findall(text)
                if damaged:
                    words = repeated(words, doc_id)
                found = find_runs(numbered(words))
                counts.append(len(words))
                runs.append([vars(r) for r in found])
                texts.append(collapsed(words, found).decode("utf-8", "replace"))
            return pa.record_batch({
                "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(counts, pa.int64()),
                "runs": pa.array(runs, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))),
                "collapsed": pa.array(texts, pa.string())})
        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, make, RUN_COLUMNS)


def digest(found: DataFrame) -> DataFrame:
    """One row per row of ``detect``: counts, the longest run, and digests of runs and kept words."""
    first = F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"])
                         .when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"]).cast("int"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = found.withColumn("_best", F.try_element_at(first, F.lit(1)))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
