"""Mixing sources to target weights by packed blocks and index permutations.

The words of a source, document after document, are packed into blocks of BLOCK words. A mix is
a number of slots per source; a slot takes one block. Output shards draw their slots' sources
at random by the target shares (a multinomial draw per shard, from a hash of shard and slot).
The draws' sums are then settled against the targets: a source stops at its own number of
slots, and the last shard gets what it still lacks, so every source ends within two blocks of
its target. The slots of a source are numbered across shards; a slot's number goes through a
pseudorandom permutation of the source's blocks, a fresh one for every pass over them. Blocks
and slots meet by block number, never by source alone, so a source that holds much of the data
is spread like the rest. A target is at most twice its source, so a block is taken at most twice.
The slots of a shard are put in an order drawn by hash. The mix itself is a table of slots, each
with shard, place in it and its block; how much was taken of a document is counted by joining the
slots with the pieces of documents that their blocks hold. ``mixed`` gives the same slots with the
words of their blocks; only it moves texts.

Everything is a DataFrame expression. A text is read once for its size; layout, plan, slots and
counts work on rows of numbers. Documents of a source are laid out in hash buckets of about BUCKET
rows each, whatever their number. Rows that one task puts in order are: those of a bucket, those of
a shard, one per source, one per source and bucket, and one per source and shard.

Null text has size zero; documents of size zero take nothing. A null source is a source of its
own, last in order. Rows without an identifier and repeated rows are documents like any others.
Other columns are ignored. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillproof.scale import written

BLOCK = 128
# The weights of the sources in order of their names, again from the start.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
# Slots of one output shard.
SHARD_SLOTS = 4096
# Slots that one task permutes, about.
TASK_SLOTS = 1 << 15
# Wanted slots that one row of the lookup from slot to source spans.
STRETCH = 1024
# Documents fall into hash buckets of about so many rows, each with its own running sum.
BUCKET = 2_000
SPACES = "\\x20\\x09-\\x0D"


def word_count(text: Column) -> Column:
    """The number of runs of anything but space, tab and line ends."""
    inner = F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, 0).otherwise(
        F.size(F.split(inner, f"[{SPACES}]+"))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, number, target: ``sizes`` has one row (source, source_size) per source.

    Sharing by weight with a ceiling, where what is over is shared anew among the rest, ends
    with every source at its ceiling or at one common level times its weight. Sources in order
    of ceiling over weight reach their ceilings first; the level is that of the first source
    that does not.
    """
    names = W.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn("number", F.row_number().over(names)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("number") - 1) % len(WEIGHTS) + 1).cast("int"))
    ).withColumn("ceiling", MOST * F.col("source_size"))
    before = W.orderBy(F.col("ceiling") / F.col("weight"), "number").rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = weighed.select(
        "*", (SHARE * F.sum("source_size").over(all_rows)).alias("total"),
        F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)).alias("spent"),
        (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"))
    level = F.max((F.col("total") - F.col("spent")) / F.col("open"))
    # Levels rise while sources are at their ceilings and fall after, so the largest is the one.
    return filled.withColumn("level", level.over(all_rows)).select(
        "source", "source_size", "number", F.least("ceiling", F.col("level") * F.col("weight")).alias("target"))


def permuted(slot: Column, blocks: Column, keys: list[Column]) -> Column:
    """The place of ``slot`` in a pseudorandom permutation of 0 to ``blocks`` - 1.

    A Feistel network over a grid of at least ``blocks`` cells: each round shifts one coordinate
    by a hash of the other, which can be undone. A cell outside goes through the network again
    until one inside is found; the grid exceeds the blocks by less than one row of it.
    """
    rows = F.ceil(F.sqrt(blocks.cast("double"))).cast("long")
    columns = F.ceil(blocks / rows).cast("long")

    def shuffle(x: Column) -> Column:
        start = F.struct(F.floor(x / columns).cast("long").alias("a"), F.pmod(x, columns).alias("b"))

        def turn(s: Column, n: Column) -> Column:
            a = F.pmod(s["a"] + F.pmod(F.xxhash64(*keys, n, s["b"]), rows), rows)
            return F.struct(a.alias("a"), F.pmod(s["b"] + F.pmod(F.xxhash64(*keys, -n, a), columns), columns).alias("b"))

        return F.aggregate(F.array(*[F.lit(n) for n in (1, 2, 3)]), start, turn, lambda s: s["a"] * columns + s["b"])

    once = shuffle(slot)
    return F.when(once < blocks, once).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.lit(64)), once, lambda x, _: F.when(x < blocks, x).otherwise(shuffle(x))))


def words(text: Column) -> Column:
    """The runs that ``word_count`` counts, for text with at least one."""
    return F.split(F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", ""), f"[{SPACES}]+")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, text, size, mark of every document."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("text").cast("string").alias("text"),
        word_count(F.col("text").cast("string")).alias("size"), F.xxhash64("doc_id", "text").alias("mark"))


def in_buckets(sizes: DataFrame, documents: int) -> DataFrame:
    return sizes.withColumn("bucket", F.pmod("mark", F.lit(max(1, -(-documents // BUCKET)))))


def bucket_starts(sizes: DataFrame) -> DataFrame:
    """of, at, first: where the words of every bucket of a source begin."""
    buckets = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return written(buckets.select(
        F.col("source").alias("of"), F.col("bucket").alias("at"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("first")), "buckets")


def layout(sizes: DataFrame, starts: DataFrame) -> DataFrame:
    """``sizes`` with row and start: every document's place among the words of its source.

    A bucket starts where those before it end, and documents within one follow each other. Documents
    that share a place in the order are equal.
    """
    within = W.partitionBy("source", "bucket").orderBy("mark", "doc_id", "size")
    placed = sizes.withColumn("row", F.row_number().over(within)).withColumn(
        "before", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    return placed.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))).withColumn(
        "start", F.col("first") + F.col("before")).drop("of", "at", "first", "before", "mark")


def slots(plan: DataFrame) -> DataFrame:
    """shard, slot, number, block: the slots of every shard in order, and the block each takes.

    ``plan`` has number, blocks and wanted (slots) per source.
    """
    spark = plan.sparkSession
    total = plan.agg(F.sum("wanted")).first()[0] or 0
    shards = -(-total // SHARD_SLOTS)
    edge = W.orderBy("number").rowsBetween(W.unboundedPreceding, 0)
    # All wanted slots in a row, source after source, cut into stretches of equal length; a
    # stretch knows the sources that reach into it.
    shares = plan.filter("wanted > 0").select("number", "wanted", F.sum("wanted").over(edge).alias("upto")).select(
        "number", (F.col("upto") - F.col("wanted")).alias("above"), "upto")
    stretch = F.sequence(F.floor(F.col("above") / STRETCH), F.floor((F.col("upto") - 1) / STRETCH))
    urn = shares.select("number", "above", "upto", F.explode(stretch).alias("stretch"))
    # The multinomial draw of a shard: every one of its slots picks one of the wanted slots.
    draws = spark.range(total).select(
        F.floor(F.col("id") / SHARD_SLOTS).alias("shard"),
        F.pmod(F.xxhash64(F.lit("shard draw"), "id"), F.lit(max(1, total))).alias("pick"),
    ).withColumn("stretch", F.floor(F.col("pick") / STRETCH))
    named = draws.join(urn, "stretch").filter("pick >= above AND pick < upto")
    drawn = named.groupBy("number", "shard").count()
    upto = W.partitionBy("number").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    ranges = drawn.select("number", "shard", (F.sum("count").over(upto) - F.col("count")).alias("low"), F.sum("count").over(upto).alias("high"))
    settled = plan.join(ranges.groupBy("number").agg(F.max("high").alias("got")), "number", "left").select(
        "number", F.lit(shards).alias("shard"), F.coalesce("got", F.lit(0)).alias("low"), F.col("wanted").alias("high"))
    parts = ranges.unionByName(settled).join(plan, "number").select(
        "number", "blocks", "shard", F.col("low"), F.least("high", "wanted").alias("high")).filter("high > low")
    # A range never exceeds a shard's slots, or the little that the draws fell short. Ranges are
    # few beside their slots, so they are dealt out by the slots there will be.
    parts = parts.repartition(max(1, total // TASK_SLOTS), "number", "low")
    each = parts.select("number", "blocks", "shard", F.explode(F.sequence("low", F.col("high") - 1)).alias("own"))
    passes = each.select("*", F.floor(F.col("own") / F.col("blocks")).cast("long").alias("round"), F.pmod("own", "blocks").alias("place"))
    block = permuted(F.col("place"), F.col("blocks"), [F.col("number"), F.col("round")])
    # A multinomial draw with its counts known is any order of them, all alike likely.
    order = W.partitionBy("shard").orderBy(F.xxhash64(F.lit("slot order"), "number", "own"), "number", "own")
    return passes.select("shard", "number", "own", block.alias("block")).select(
        "shard", (F.row_number().over(order) - 1).cast("long").alias("slot"), "number", "block")


def in_blocks(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """``placed`` documents with words and the number of their source; ``spans`` are the blocks they reach."""
    numbered = placed.filter("size > 0").join(
        plan.select(F.col("source").alias("of"), "number"), F.col("source").eqNullSafe(F.col("of")))
    return numbered.withColumn("spans", F.sequence(
        F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)))


def _edges(b: Column) -> tuple[Column, Column]:
    """First word, in its source, and number of words that a document has in block ``b``."""
    low = F.greatest(F.col("start"), b * BLOCK)
    return low, F.least(F.col("start") + F.col("size"), (b + 1) * BLOCK) - low


def pieces(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """number, block, bucket, row, words: the part of every document in every block it reaches."""
    each = in_blocks(placed, plan).select("number", "bucket", "row", "start", "size", F.explode("spans").alias("block"))
    return each.select("number", "block", "bucket", "row", _edges(F.col("block"))[1].alias("words"))


def packed(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """number, source, block, text: the blocks of every source with their words. ``placed`` has the texts."""

    def cut(own: Column) -> Callable[[Column], Column]:
        def piece(b: Column) -> Column:
            low, n = _edges(b)
            return F.struct(b.alias("block"), low.alias("low"), F.array_join(
                F.slice(own, (low - F.col("start") + 1).cast("int"), n.cast("int")), " ").alias("text"))
        return piece

    # The words are bound to a name, so that a text is split once.
    found = F.transform(F.array(words(F.col("text"))), lambda own: F.transform("spans", cut(own)))[0]
    each = in_blocks(placed, plan).select("number", "source", F.inline(found))
    # A block has at most BLOCK pieces.
    return each.groupBy("number", "block").agg(
        F.first("source").alias("source"), F.array_sort(F.collect_list(F.struct("low", "text"))).alias("p")).select(
        "number", "source", "block", F.array_join(F.col("p.text"), " ").alias("text"))


def planned(placed: DataFrame) -> DataFrame:
    """source, source_size, number, target, blocks, wanted of every source."""
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    return written(targets(sizes).withColumns({
        "blocks": F.ceil(F.col("source_size") / BLOCK).cast("long"),
    }).withColumn("wanted", F.when(F.col("source_size") > 0, F.round(
        # The last block may be short, so slots are counted at the mean length of a block.
        F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")), "plan")


class Deal:
    """The layout of some documents, the plan of their sources, and the slots of the mix."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        sizes = written(sized(docs).drop("text"), "sizes")
        self.documents = sizes.count()
        bucketed = in_buckets(sizes, self.documents)
        self.starts = bucket_starts(bucketed)
        self.placed = written(layout(bucketed, self.starts), "layout")
        self.plan = planned(self.placed)
        # Written, so that counts and text come from the same slots and joins see their true size.
        self.slots = written(slots(self.plan.filter("blocks > 0").select("number", "blocks", "wanted")), "slots")

    def counted(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of every document, from its pieces in the slots' blocks."""
        taken = self.slots.join(pieces(self.placed, self.plan), ["number", "block"]).groupBy(
            "number", "bucket", "row").agg(F.sum("words").alias("taken"))
        # One row per source, so small beside the documents; Spark sees its size and picks the join.
        numbered = self.placed.join(self.plan.select(F.col("source").alias("of"), "source_size", "number", "target"),
                                    F.col("source").eqNullSafe(F.col("of")))
        return numbered.join(taken, ["number", "bucket", "row"], "left").select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def mixed(self) -> DataFrame:
        """shard, slot, source, block, text: shards read in order of their slots are the mix."""
        texts = layout(in_buckets(sized(self.docs), self.documents), self.starts)
        return self.slots.join(packed(texts, self.plan), ["number", "block"]).select("shard", "slot", "source", "block", "text")


def mixed(docs: DataFrame) -> DataFrame:
    return Deal(docs).mixed()


def mix(docs: DataFrame) -> DataFrame:
    return Deal(docs).counted()
