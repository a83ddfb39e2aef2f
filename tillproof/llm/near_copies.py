"""Near copies by shingle sets: all pairs of similarity 0.8 or more, by fingerprints and rare prefixes.

A text is the set of its runs of WIDTH words; the similarity of two is what they share over what
they hold together. Sets whose fingerprints meet in the balls of op1, and are similar enough, are linked
first. For pairs too far apart for a ball, the members of all sets are put in one order, those that are common in a
sample last. Two sets that are similar enough share a member among the first fifth of each, so
only sets that meet there are compared, and then by their whole sets: nothing is estimated. The
order decides the work, never the result. Before whole sets move, bits are compared that tell how
many members fall into each cell, odd or even: sets differ in at least as many members as cells,
so a pair with too many cells apart is no near copy.

A large group of near copies would meet in all pairs. So every set is first compared with the
smallest it meets; what is linked by then is one group, and only sets of different groups that
meet are compared after that.

Words are as in simhash.py. A text of fewer words is one shingle, one without words the empty
shingle. Null text counts as empty. Repeated rows and rows without an identifier are rows like
any others. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from tillproof.llm.common import map_batches, raw_texts
from tillproof.llm.simhash import BITS, CHUNK, ball_links, components, text_hash
from tillproof.scale import written

SEED = 42
WIDTH = 5
# The least similarity is LEAST / OF.
LEAST, OF = 4, 5
# Texts that show which shingles are common, about, and in how many of them a common one is.
SAMPLE, COMMON = 10_000, 3
MOST_COMMON = 200_000


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    words = text.lower().split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    count = max(1, len(words) - WIDTH + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:count].tolist()
    ends = ends[-count:].tolist() or [0]
    digest = xxhash.xxh64_digest
    parts = [np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i:i + CHUNK], ends[i:i + CHUNK])]), ">i8")
             for i in range(0, count, CHUNK)]
    return np.unique(np.concatenate(parts).astype(np.int64))


def fingerprint(own: np.ndarray) -> int:
    """As in simhash.py, of the set: the bits set in over half the members."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(own), CHUNK):
        ones += np.unpackbits(own[i:i + CHUNK].astype(">i8").view(np.uint8).reshape(-1, BITS // 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(own)).tobytes(), "big", signed=True)


def prefix_length(size: int) -> int:
    return size - -(-size * LEAST // OF) + 1


def parity(own: np.ndarray) -> bytes:
    """One bit a cell: whether an odd number of members falls into it; two to four cells a member."""
    cells = max(64, 1 << (2 * len(own) - 1).bit_length())
    return np.packbits(np.bincount(own & (cells - 1), minlength=cells) & 1 != 0, bitorder="little").tobytes()


def cells_apart(a: bytes, b: bytes) -> int:
    """In how many cells two sets differ; the one with more cells is folded, which keeps odd and even."""
    one, other = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    least = min(len(one), len(other))
    fold = lambda bits: np.bitwise_xor.reduce(bits.reshape(-1, least), axis=0)
    return int(np.bitwise_count(fold(one) ^ fold(other)).sum())


def common_shingles(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles common in a bounded sample, and how many texts hold each."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).withColumn("mark", text_hash("text"))
    parts = max(1, -(-docs.count() // SAMPLE))
    sample = texts.filter(F.pmod("mark", F.lit(parts)) == 0)

    def make():
        def work(batch):
            own = [shingles(t) for t in raw_texts(batch, "text")]
            return pa.record_batch({"shingle": pa.array(np.concatenate(own) if own else np.empty(0, np.int64))})
        return work

    counts = map_batches(sample, make, "shingle long").groupBy("shingle").count().filter(F.col("count") >= COMMON)
    rows = counts.orderBy(F.col("count").desc(), "shingle").limit(MOST_COMMON).toPandas().sort_values("shingle")
    return rows["shingle"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)


def sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, mark (hash of the whole set), size, prefix, fp (fingerprint) and parity of every row."""
    known, often = common_shingles(docs, text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("text_hash", text_hash("text"))

    def first(own: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(own), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            rank = np.where(known[at] == own, often[at], 0)
        return own[np.lexsort((own, rank))[:prefix_length(len(own))]]

    def make():
        def work(batch):
            own = [shingles(t) for t in raw_texts(batch, "text")]
            return pa.record_batch({
                "doc_id": batch.column(0), "text_hash": batch.column(2),
                "mark": pa.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in own], pa.int64()),
                "size": pa.array([len(s) for s in own], pa.int64()),
                "prefix": pa.array([first(s) for s in own], pa.list_(pa.int64())),
                "fp": pa.array([fingerprint(s) for s in own], pa.int64()),
                "parity": pa.array([parity(s) for s in own], pa.binary())})
        return work

    return map_batches(source, make, "doc_id long, text_hash long, mark long, size long, prefix array<long>, fp long, parity binary")


def able(shared: str | None = None):
    """Whether sets of the sizes ``size_a`` and ``size_b`` can be similar enough.

    With the members that their prefixes share: what is shared besides stands after the prefix
    of one of them.
    """
    a, b = F.col("size_a"), F.col("size_b")
    fits = F.least(a, b) * OF >= F.greatest(a, b) * LEAST
    if shared is None:
        return fits
    after = F.greatest(F.ceil(a * LEAST / OF), F.ceil(b * LEAST / OF)) - 1
    return fits & ((F.col(shared) + after) * (LEAST + OF) >= (a + b) * LEAST)


def by_fingerprint(cells: DataFrame) -> DataFrame:
    """(a, b): every set with the smallest of its fingerprint, and those of fingerprints that meet in a ball."""
    least = written(cells.groupBy("fp").agg(F.min("mark").alias("least")), "fingerprints")
    same = cells.join(least, "fp").select(F.col("least").alias("a"), F.col("mark").alias("b"))
    links = ball_links(least.select("fp"))
    low = least.select(F.col("fp").alias("low"), F.col("least").alias("x"))
    high = least.select(F.col("fp").alias("high"), F.col("least").alias("y"))
    met = links.join(low, "low").join(high, "high").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(met).filter("a < b")


def possible(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """(a, b) of the ``pairs`` (a, b, size_a, size_b) whose parities (mark, parity) don't rule them out."""
    def side(name: str) -> DataFrame:
        return cells.select(F.col("mark").alias(name), F.col("parity").alias(f"of_{name}"))

    def make():
        def work(batch):
            a, b, sizes, of_a, of_b = (batch.column(i) for i in range(5))
            apart = np.array([cells_apart(x, y) for x, y in zip(of_a.to_pylist(), of_b.to_pylist())], np.int64)
            # Of all members of both, so many at most are in only one of them.
            fits = apart * (LEAST + OF) <= sizes.to_numpy() * (OF - LEAST)
            return pa.record_batch({"a": a, "b": b}).filter(pa.array(fits))
        return work

    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return map_batches(met.select("a", "b", (F.col("size_a") + F.col("size_b")).alias("sizes"), "of_a", "of_b"), make, "a long, b long")


def similar(pairs: DataFrame, cells: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(high, low) of the ``pairs`` (a, b, size_a, size_b) whose whole sets are similar enough."""
    pairs = written(possible(written(pairs, "pairs"), cells), "possible")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct()
    texts = written(rows.join(wanted, "mark").groupBy("mark").agg(F.min("text_hash").alias("text_hash")), "wanted")
    source = docs.select(F.col(text_col).cast("string").alias("text")).withColumn("text_hash", text_hash("text"))
    source = source.join(texts, "text_hash").dropDuplicates(["mark"]).select("mark", "text")

    def make():
        def work(batch):
            own = [shingles(t) for t in raw_texts(batch, "text")]
            return pa.record_batch({"mark": batch.column(0), "members": pa.array(own, pa.list_(pa.int64()))})
        return work

    members = written(map_batches(source, make, "mark long, members array<long>"), "members")
    met = pairs.join(members.select(F.col("mark").alias("a"), F.col("members").alias("of_a")), "a").join(
        members.select(F.col("mark").alias("b"), F.col("members").alias("of_b")), "b")
    enough = F.size(F.array_intersect("of_a", "of_b")) * (LEAST + OF) >= (F.size("of_a") + F.size("of_b")) * LEAST
    return written(met.filter(enough).select(F.col("b").alias("high"), F.col("a").alias("low")), "similar")


def near_copies(rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(node, root): the smallest mark of the group of every mark that is not the smallest itself."""
    distinct = rows.select("mark", "size", "prefix").dropDuplicates(["mark"])
    cells = written(rows.select("mark", "size", "fp", "parity").dropDuplicates(["mark"]), "cells")
    entries = distinct.select("mark", "size", F.explode("prefix").alias("shingle"))
    here = W.partitionBy("shingle")
    meetings = written(entries.withColumns({
        "n": F.count("*").over(here), "least": F.min(F.struct("mark", "size")).over(here),
    }).filter("n > 1"), "meetings")
    stars = meetings.select(
        F.col("least.mark").alias("a"), F.col("least.size").alias("size_a"), F.col("mark").alias("b"), F.col("size").alias("size_b"))
    stars = stars.filter((F.col("a") < F.col("b")) & able()).groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("shared"))
    balls = by_fingerprint(cells)
    for name in ("a", "b"):
        balls = balls.join(cells.select(F.col("mark").alias(name), F.col("size").alias(f"size_{name}")), name)
    met = balls.filter(able()).select("a", "b", "size_a", "size_b").unionByName(stars.filter(able("shared")).drop("shared")).distinct()
    links = similar(met, cells, rows, docs, text_col)
    roots = components(links, "stars")
    rooted = written(meetings.join(roots, F.col("mark") == F.col("node"), "left").select(
        "shingle", "mark", "size", F.coalesce("root", "mark").alias("root")), "rooted")

    def side(name: str) -> DataFrame:
        return rooted.select("shingle", *[F.col(c).alias(f"{c}_{name}") for c in ("mark", "size", "root")])

    crossed = side("a").join(side("b"), "shingle").filter("mark_a < mark_b AND root_a <> root_b").filter(able())
    crossed = crossed.groupBy(F.col("mark_a").alias("a"), F.col("mark_b").alias("b"), "size_a", "size_b").agg(F.count("*").alias("shared"))
    more = similar(crossed.filter(able("shared")).drop("shared"), cells, rows, docs, text_col)
    return components(links.unionByName(more), "copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with all columns of ``docs``; chosen as in simhash.py."""
    rows = written(sets(docs, id_col, text_col), "sets")
    roots = written(near_copies(rows, docs, text_col), "roots")
    key = F.struct(F.col("doc_id").isNull().alias("_llm_none"), F.coalesce("doc_id", F.lit(0)).alias("_llm_id"),
                   F.col("text_hash").alias("_llm_hash"))
    smallest = written(rows.groupBy("mark").agg(F.min(key).alias("first")), "smallest")
    grouped = smallest.join(roots, F.col("mark") == F.col("node"), "left")
    kept = written(grouped.groupBy(F.coalesce("root", "mark").alias("group")).agg(
        F.min("first").alias("first")).select("first.*"), "kept")
    number = F.col(id_col).cast("long")
    names = ["_llm_none", "_llm_id", "_llm_hash"]
    keyed = docs.withColumns(dict(zip(names, (number.isNull(), F.coalesce(number, F.lit(0)), text_hash(text_col)))))
    return keyed.join(kept, names).dropDuplicates(names).select(*docs.columns)
