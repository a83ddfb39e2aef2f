"""Token identifiers of documents in ORC files, and what their indexes are good for.

Documents are range-partitioned and sorted by identifier, tokenised where they lie, and written as ORC:
one file per partition, files in order of identifiers, a row per document with its identifiers as an
array of integers (run-length encoded by ORC, version 2). ``before`` is the number of identifiers in the
file ahead of the row; with the totals of earlier files it gives a document's place in the whole stream
without any pass over the rows in order. Every stripe carries a row index with the least and greatest
doc_id of each ``ROW_GROUP`` rows and a Bloom filter on doc_id, so that a search for few documents skips
files, stripes and row groups by metadata, and a scan reads stripes in parallel.

Byte-level pieces never reach across a single space between two other characters, so a text is cut
there, and at single line ends; a distinct piece goes through the tokenizer once, as long as there is room
to remember it, and the results are laid end to end. Texts with other blanks are cut by a pattern that
leaves these whole. A piece of Latin letters, with marks
after it or none, is what the tokenizer's own cut would give and goes to its model at once. A tokenizer
of another kind encodes whole texts.

Rows of one identifier are ordered by text, so a hot identifier spreads over partitions. Null text is
empty: only the end identifier is written. Rows without an identifier come first. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import gc
import os
import re
import sys
import types
import zlib
from array import array
from collections.abc import Callable, Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tillproof.scale import new_folder

END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
# Rows between two entries of a stripe's row index, and bytes of a stripe.
ROW_GROUP, STRIPE = 1000, 16 << 20
FALSE_POSITIVES = 0.01
# Distinct pieces of either kind that a worker process remembers, about 200 bytes each.
REMEMBERED = 600_000
# Documents whose identifiers are handed over at once hold about so many letters.
LETTERS = 1 << 22
CUT = re.compile(r"(?<=\S) (?=\S)")
# Letters that every Unicode version since the first counts as such end before this one.
LATIN_END = "\u0250"
# Every blank but space and line end, as any Unicode version or Python has them.
OTHER_BLANK = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")
FILE_SCHEMA = "doc_id long, before long, n_tokens int, ids array<int>"
ARROW = pa.schema([("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Encoder:
    """Little-endian 32-bit identifiers of whole texts, without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        cut = self.tokenizer.pre_tokenizer
        self.by_piece = (isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space
                         and self.tokenizer.normalizer is None and isinstance(self.model, models.BPE))
        self.letters = byte_letters()
        # Pieces by their text; those after the first of a text are preceded by a space.
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.stops = {"": b""}
        self.line_end = self.whole(["\n"])[0]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str, known: dict[str, bytes], lead: str) -> bytes:
        """One piece's identifiers. Letters, and marks after them, are cut apart by the tokenizer too, so
        its model takes the letters as they are."""
        word = piece.rstrip(punctuation)
        if not word.isalpha() or not word.isascii() and max(word) >= LATIN_END:
            ids = self.whole([lead + piece])[0]
        else:
            stop = piece[len(word):]
            ids = known.get(word) if stop else None
            if ids is None:
                shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.model.tokenize(self.letters[32] + shown if lead else shown)]).tobytes()
                if stop and len(known) < REMEMBERED:
                    known[word] = ids
            if stop:
                if stop not in self.stops:
                    self.stops[stop] = self.whole([stop])[0]
                ids += self.stops[stop]
        # What comes early comes often, so the first pieces are those to remember.
        if len(known) < REMEMBERED:
            known[piece] = ids
        return ids

    def _line(self, pieces: list[str]) -> bytes:
        ids = list(map(self.later.get, pieces))
        ids[0] = self.first.get(pieces[0])
        if None in ids:
            for at, own in enumerate(ids):
                if own is None:
                    ids[at] = self._piece(pieces[at], self.later if at else self.first, " " if at else "")
        return b"".join(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self.whole(texts)
        out = []
        for text in texts:
            # So every blank is one space or one line end between other characters; a line end is then
            # a piece of its own.
            if len(text.split()) == text.count(" ") + text.count("\n") + 1 and not OTHER_BLANK.search(text):
                out.append(self.line_end.join([self._line(line.split(" ")) for line in text.split("\n")]))
            else:
                out.append(self._line(CUT.split(text)) if text else b"")
        return out


def encoder(path: str) -> Encoder:
    """The encoder of this worker process, which Spark uses for one task after the other."""
    held = sys.modules.setdefault("_tillproof_encoders", types.ModuleType("_tillproof_encoders"))
    if path not in vars(held):
        vars(held)[path] = Encoder(path)
    return vars(held)[path]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    low = letters = 0
    for at, text in enumerate(texts):
        letters += len(text)
        if letters > LETTERS or at + 1 == len(texts):
            yield ids[low:at + 1], texts[low:at + 1]
            low, letters = at + 1, 0


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, before, n_tokens, ids: sorted partitions, each with its own running total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before, end = encoder(path), 0, np.array([end_id], "<u4").tobytes()
        gc.disable()  # nothing here is cyclic, and the remembered pieces would be walked again and again
        for batch in batches:
            for ids, texts in _groups(batch):
                encoded = [e + end for e in own.encode(texts)]
                sizes = np.array([len(e) // 4 for e in encoded], np.int64)
                edges = np.concatenate(([0], np.cumsum(sizes)))
                values = pa.array(np.frombuffer(b"".join(encoded), "<u4").astype(np.int32))
                yield pa.record_batch([
                    pa.array(ids, pa.int64()), pa.array(edges[:-1] + before), pa.array(sizes, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)], schema=ARROW)
                before += int(edges[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = F.col("doc_id").asc_nulls_first()
    return rows.repartitionByRange(order, F.xxhash64("text")).sortWithinPartitions(order, F.xxhash64("text"), "text").mapInArrow(run, FILE_SCHEMA)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write the files. A lost task is run again and its file replaced, as by any Spark writer."""
    # A file is split by Spark at stripes when it is read, so its own size is no limit to parallel reads.
    tokenised(docs, tokenizer or tokenizer_path(), end_id).write.format("orc").options(**{
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(FALSE_POSITIVES),
        "orc.row.index.stride": str(ROW_GROUP), "orc.stripe.size": str(STRIPE), "compression": "zstd"}).save(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, before, n_tokens, ids and the file of every document; filters on doc_id prune by metadata."""
    return spark.read.schema(FILE_SCHEMA).orc(folder).select("*", F.col("_metadata.file_name").alias("file"))


def file_starts(tokens: DataFrame) -> DataFrame:
    """file, first: the identifiers in all files before. One row per file is ordered in one task."""
    totals = tokens.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    # Spark numbers a write's files by partition, and partitions are in order of doc_id.
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    earlier = W.orderBy(number, "file").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("file", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("first"))


def map_ids(tokens: DataFrame, make: Callable[[pa.Array], pa.Array], name: str, kind: str) -> DataFrame:
    """``tokens`` with ``ids`` replaced by one value of each row, ``make`` gets the arrays of a batch."""
    kept = [c for c in tokens.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("ids")
            yield pa.record_batch([b.column(b.schema.get_field_index(c)) for c in kept] + [make(b.column(at))], names=[*kept, name])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema if f.name != "ids")
    return tokens.mapInArrow(run, f"{fields}, {name} {kind}")


def _checksums(ids: pa.Array) -> pa.Array:
    raw, edges = np.asarray(ids.values, "<i4"), np.asarray(ids.offsets)
    view = memoryview(np.ascontiguousarray(raw)).cast("B")
    return pa.array([zlib.crc32(view[4 * a:4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.int64())


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    tokens = read_tokens(spark, folder)
    summed = map_ids(tokens, _checksums, "ids_crc32", "long")
    # A row per file; Spark sees how many there are and broadcasts them or not.
    return summed.join(file_starts(tokens), "file").select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def lookup_tokens(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of the documents asked for: ranges and Bloom filters leave the other row groups unread."""
    return read_tokens(spark, folder).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def encode_and_read_back(docs: DataFrame) -> DataFrame:
    """``catalogue`` of files written anew to the shared folder."""
    folder = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder)
    return catalogue(docs.sparkSession, folder)
