"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2h`` bits have a common point within ``h`` bits of
both. Every distinct fingerprint is sent to all points of its ball of half the radius; the
fingerprints that meet at a point are by construction within the radius of each other, so a
point holds a bounded number of them and a star to the smallest one links them all.

Null text counts as empty. A text without words has fingerprint zero, and such rows link like
any others. A null identifier never names a group unless the whole group has none. Repeated
rows are kept, each with the same answer. Columns other than the two named are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillproof.llm.common import map_batches, raw_texts
from tillproof.scale import written

SEED = 42
BITS = 64
SHINGLE = 3
RADIUS = 2
# Shingles hashed and counted at a time, so one very long text needs little memory.
CHUNK = 1 << 16


def simhash(text: bytes, width: int = SHINGLE) -> bytes:
    """Eight bytes, most significant first: the bits set in over half the shingle hashes.

    Words are what ``bytes.split`` gives: runs of anything but space, tab and line ends.
    """
    words = text.lower().split()
    if not words:
        return bytes(BITS // 8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(1, len(words) - width + 1)
    starts, ends = starts[:count].tolist(), ends[-count:].tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, np.int64)
    for i in range(0, count, CHUNK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i:i + CHUNK], ends[i:i + CHUNK])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, BITS // 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > count).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): one row per row of ``docs``, the fingerprint as a signed long."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("text_hash", text_hash("text"))

    def make():
        def work(batch):
            values = [int.from_bytes(simhash(t), "big", signed=True) for t in raw_texts(batch, "text")]
            return pa.record_batch(
                {"doc_id": batch.column(0), "text_hash": batch.column(2), "fp": pa.array(values, pa.int64())})
        return work

    return map_batches(source, make, "doc_id long, text_hash long, fp long")


def text_hash(column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def ball_masks(half: int) -> list[int]:
    """Every pattern of at most ``half`` set bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for n in range(half + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def ball_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (high, low) that connect whatever is connected within an even ``radius``.

    ``distinct`` has one row per fingerprint ``fp``.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = F.array(*[F.lit(m) for m in ball_masks(radius // 2)])
    ball = distinct.select("fp", F.explode(masks).alias("mask")).select(
        F.col("fp").bitwiseXOR(F.col("mask")).alias("point"), "fp")
    star = ball.withColumn("low", F.min("fp").over(W.partitionBy("point"))).filter("fp > low")
    # One pair can meet at several points; it is verified once.
    return star.select(F.col("fp").alias("high"), "low").distinct().filter(
        F.bit_count(F.col("high").bitwiseXOR(F.col("low"))) <= radius)


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) for every node of ``links`` (high, low): root is the smallest reachable.

    Large-star and small-star rounds in turn until nothing changes: the number of rounds grows
    with the logarithm of the longest chain. Each half round is a written table, so a lost
    executor costs a read, and the driver sees a count and a checksum. Minima are written
    before they are joined, so that Spark can split the join at a node with very many links.
    A root itself is not a node of the result.
    """
    edges = written(links.filter("high > low").select("high", "low"), label)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = written(
            both.groupBy("high").agg(F.min("low").alias("m")).select(
                F.col("high").alias("node"), F.least("high", "m").alias("m")), label)
        large = written(
            both.filter("low > high").join(least, F.col("high") == F.col("node"))
            .select(F.col("low").alias("high"), F.col("m").alias("low")).distinct(), label)
        least = written(large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("m")), label)
        pair = F.array(F.struct("high", F.col("m").alias("low")), F.struct(F.col("low").alias("high"), F.col("m").alias("low")))
        edges = written(
            large.join(least, F.col("high") == F.col("node")).select(F.inline(pair))
            .filter("high > low").distinct(), label)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first()
        if now == before:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
        before = now


def group_fingerprints(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root) for every fingerprint of ``rows``: root is the smallest one of the group."""
    distinct = written(rows.select("fp").distinct(), "fingerprints")
    roots = components(ball_links(distinct, radius))
    return written(distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root")), "members")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id of the group)."""
    rows = written(fingerprints(docs, id_col, text_col), "simhash")
    members = group_fingerprints(rows, radius)
    # A fingerprint shared by very many rows becomes one row per task before anything moves.
    smallest = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "smallest")
    groups = written(members.join(smallest, "fp"), "groups")
    names = written(groups.groupBy("root").agg(F.min("first_id").alias("component_id")), "names")
    named = written(groups.join(names, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each near-duplicate group, with all columns of ``docs``.

    The row with the smallest identifier stays, rows without one coming last; rows that share
    an identifier are told apart by a hash of their text. Equal rows are the same document.
    """
    key = (F.col("doc_id").isNull().alias("_llm_none"), F.coalesce("doc_id", F.lit(0)).alias("_llm_id"),
           F.col("text_hash").alias("_llm_hash"))
    rows = written(fingerprints(docs, id_col, text_col), "simhash")
    members = group_fingerprints(rows, radius)
    first = F.min(F.struct(*key)).alias("first")
    smallest = written(rows.groupBy("fp").agg(first), "smallest")
    groups = members.join(smallest, "fp")
    kept = written(groups.groupBy("root").agg(F.min("first").alias("first")).select("first.*"), "kept")
    number = F.col(id_col).cast("long")
    keyed = docs.withColumns({
        "_llm_none": number.isNull(), "_llm_id": F.coalesce(number, F.lit(0)), "_llm_hash": text_hash(text_col)})
    names = ["_llm_none", "_llm_id", "_llm_hash"]
    return keyed.join(kept, names).dropDuplicates(names).select(*docs.columns)
