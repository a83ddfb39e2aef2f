"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected at random onto a few axes, shifted, cut into cells and ordered along a
Hilbert curve; this is done for several independent projections. Spark range-partitions each
ordering and numbers it. A query is held against the vectors in a window around its place on
every curve; the windows' best are merged and ranked by the exact measure.

The measure is the inner product. For the curves only, every vector is scaled by the largest
norm and given one more coordinate that makes it a unit vector, so that a large inner product
means a small distance; vectors that all have one length are not changed by this.

The window is a share of the ordering, so recall does not sink as the table grows, and at least
LEAST_WINDOW rows, so small tables are searched whole. Windows are worked off in blocks of
BLOCK vectors against the queries of a stretch of the curve; neither holds more rows than its
span, however the data lie.

Equal vectors are indexed once, with the smallest identifiers that a result can need. Rows whose
vector is null, zero, holds a null or a non-finite component, or has another length than most
vectors take no part, nor do rows without an identifier. Rows with the same identifier and
vector are one row. A table without valid vectors gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from tillproof.llm.common import map_batches
from tillproof.scale import number_rows, written

CURVES = 8
AXES = 8
BITS = 6
WINDOW_SHARE = 0.2
LEAST_WINDOW = 2000
BLOCK = 4096
# Rows of the ordering whose queries meet a block together: about BLOCK queries of every 20th row.
STRETCH = 20 * BLOCK
NEIGHBOURS = 20
QUERY_STEP = 20
# Vectors from which the spread of the projections is estimated; lowest hash first.
FIT_SAMPLE = 4096
SEED = 20240


def pack(rows: DataFrame) -> DataFrame:
    """(vec, ids, asked): valid vectors as bytes of doubles, equal ones of a batch together.

    ``ids`` are the smallest identifiers that a result can need, ``asked`` all that are queries.
    """
    source = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))

    def make():
        def work(batch):
            found: dict[bytes, list[int]] = {}
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            flat = column.flatten()
            values = np.where(np.asarray(flat.is_null()), np.nan, flat.fill_null(0.0).to_numpy(zero_copy_only=False)) + 0.0
            lengths = np.asarray(pa.compute.list_value_length(column).fill_null(0))
            ends = np.cumsum(lengths)
            for vec_id, end, n in zip(ids, ends, lengths):
                vector = values[end - n:end]
                if vec_id is not None and n and np.isfinite(vector).all() and vector.any():
                    found.setdefault(vector.tobytes(), []).append(vec_id)
            return pa.record_batch({
                "vec": pa.array(found, pa.binary()),
                "ids": pa.array([sorted(set(x))[:NEIGHBOURS + 1] for x in found.values()], pa.list_(pa.int64())),
                "asked": pa.array([sorted({i for i in x if i % QUERY_STEP == 0}) for x in found.values()], pa.list_(pa.int64()))})
        return work

    return map_batches(source, make, "vec binary, ids array<long>, asked array<long>")


def distinct_vectors(packed: DataFrame) -> DataFrame:
    """(gid, vec, ids, query): each vector once, named by its smallest identifier.

    A vector of very many rows comes as one row per batch, with a bounded list in it. Identifiers
    repeated for different vectors name neither, so the name is only unique with the vector.
    """
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, NEIGHBOURS + 1)
    each = packed.groupBy("vec").agg(smallest.alias("ids"), F.max(F.size("asked") > 0).alias("query"))
    lengths = packed.groupBy(F.length("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is not None:
        each = each.filter(F.length("vec") == lengths["n"])
    return number_rows(each, ["ids", "vec"], "gid", start=0)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of cell numbers along a Hilbert curve (Skilling's transposed form)."""
    x = cells.copy()
    axes = x.shape[1]
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for i in range(axes):
            turned = (x[:, i] & step) > 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            if i:
                x[:, i] ^= swap
        step >>= 1
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    flips = np.zeros(len(x), np.int64)
    step = 1 << (bits - 1)
    while step > 1:
        flips ^= np.where(x[:, -1] & step, step - 1, 0)
        step >>= 1
    x ^= flips[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[:, i] >> bit) & 1)
    return key


class Curves:
    """Projections with the spread of a sample; a vector has one key per curve."""

    def __init__(self, sample: np.ndarray, longest: float):
        self.longest = longest
        source = np.random.default_rng(SEED)
        size = sample.shape[1] + 1
        unit = self.lift(sample)
        self.parts = []
        for _ in range(CURVES):
            basis = np.linalg.qr(source.normal(size=(size, min(AXES, size))))[0]
            low, high = np.quantile(unit @ basis, [0.001, 0.999], axis=0)
            self.parts.append((basis, low, np.maximum(high - low, 1e-12), source.uniform(0, 0.25, basis.shape[1])))

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.longest
        return np.concatenate((scaled, np.sqrt(np.maximum(0.0, 1 - (scaled ** 2).sum(1)))[:, None]), axis=1)

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        unit = self.lift(vectors)
        out = []
        for basis, low, spread, shift in self.parts:
            place = np.clip(((unit @ basis - low) / spread + shift) / 1.25, 0, 1 - 1e-9)
            out.append(hilbert_key((place * (1 << BITS)).astype(np.int64), BITS))
        return out


def stacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    vectors = column.to_pylist()
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1) if vectors else np.zeros((0, 1))


def order(vectors: DataFrame, count: int) -> DataFrame:
    """(curve, pos, gid, vec, query): all vectors, numbered from 0 along every curve."""
    # At most FIT_SAMPLE vectors come to the driver.
    sample = stacked(pa.array([r.vec for r in vectors.orderBy(F.xxhash64("vec"), "gid").limit(FIT_SAMPLE).select("vec").collect()]))

    def norms(batches):
        longest = max((float(np.sqrt((stacked(b.column(0)) ** 2).sum(1)).max(initial=0.0)) for b in batches), default=0.0)
        yield pa.record_batch({"norm": pa.array([longest])})

    longest = vectors.select("vec").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]
    curves = Curves(sample, longest)

    def make():
        def work(batch):
            n = batch.num_rows
            keys = curves.keys(stacked(batch.column(1))) if n else [np.zeros(0, np.int64)] * CURVES
            repeat = pa.array(np.tile(np.arange(n), CURVES))
            return pa.record_batch(
                [pa.array(np.repeat(np.arange(CURVES), n), pa.int64()), pa.array(np.concatenate(keys), pa.int64()),
                 *[batch.column(i).take(repeat) for i in range(3)]], names=["curve", "key", "gid", "vec", "query"])
        return work

    keyed = map_batches(vectors.select("gid", "vec", "query"), make, "curve long, key long, gid long, vec binary, query boolean")
    numbered = number_rows(keyed, ["curve", "key", "gid"], "place", start=0)
    return written(numbered.select("curve", (F.col("place") - F.col("curve") * count).alias("pos"), "gid", "vec", "query"), "curves")


def window_best(curves: DataFrame, count: int) -> DataFrame:
    """(gid, near, score): for every query vector the best of each block that its windows reach."""
    reach = max(LEAST_WINDOW, int(np.ceil(WINDOW_SHARE * count / 2)))
    last = count - 1

    def span(low, high, width: int):
        first = F.floor(F.greatest(low, F.lit(0)) / width)
        return F.explode(F.sequence(first, F.floor(F.least(high, F.lit(last)) / width)))

    pos = F.col("pos")
    block = F.floor(pos / BLOCK)
    asked = curves.filter("query").select("curve", F.floor(pos / STRETCH).alias("stretch"), span(pos - reach, pos + reach, BLOCK).alias("block"), "pos", "gid", "vec")
    held = curves.select("curve", span(block * BLOCK - reach, (block + 1) * BLOCK - 1 + reach, STRETCH).alias("stretch"), block.alias("block"), "pos", "gid", "vec")
    keys = ("curve", "stretch", "block")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, places, names = stacked(left.column("vec")), left.column("pos").to_numpy(), left.column("gid").to_numpy()
        vectors, at, others = stacked(right.column("vec")), right.column("pos").to_numpy(), right.column("gid").to_numpy()
        keep = min(NEIGHBOURS + 1, len(others))
        out = [[], [], []]
        # Queries in slices, so that the table of products stays small.
        for i in range(0, len(names) if keep else 0, 512):
            own = queries[i:i + 512]
            products = own @ vectors.T
            products[np.abs(places[i:i + 512, None] - at[None, :]) > reach] = -np.inf
            top = np.argpartition(-products, keep - 1, axis=1)[:, :keep]
            row, col = np.nonzero(np.isfinite(np.take_along_axis(products, top, 1)))
            near = top[row, col]
            out[0].append(names[i + row])
            out[1].append(others[near])
            # The measure itself, added up in one order wherever a pair meets.
            out[2].append((own[row] * vectors[near]).sum(axis=1))
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(out, kinds)], names=["gid", "near", "score"])

    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(best, "gid long, near long, score double")


def search(rows: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row whose identifier is a multiple of QUERY_STEP."""
    packed = written(pack(rows), "packed")
    vectors = written(distinct_vectors(packed), "vectors")
    count = vectors.count()
    if not count:
        return packed.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"),
                             F.lit(0.0).alias("score")).limit(0)
    merged = window_best(order(vectors, count), count).groupBy("gid", "near").agg(F.max("score").alias("score"))
    # Equal vectors share a score, and the smallest of their identifiers come first.
    ids = vectors.select(F.col("gid").alias("near"), "ids")
    top = merged.withColumn("_n", F.row_number().over(W.partitionBy("gid").orderBy(F.desc("score"), "near"))).filter(F.col("_n") <= NEIGHBOURS + 1)
    entries = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("back"), i.alias("id")))))
    found = written(top.join(ids, "near").groupBy("gid").agg(F.array_sort(entries).alias("found")), "found")
    named = vectors.filter("query").select("vec", "gid").join(found, "gid").select("vec", F.slice("found", 1, 2 * NEIGHBOURS).alias("found"))
    queries = packed.select("vec", F.explode("asked").alias("query_id")).distinct()
    answers = queries.join(written(named, "answers"), "vec")
    others = F.slice(F.filter("found", lambda e: e["id"] != F.col("query_id")), 1, NEIGHBOURS)
    return answers.select("query_id", F.posexplode(others).alias("at", "e")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.back")).alias("score"))
