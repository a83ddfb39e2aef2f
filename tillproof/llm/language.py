"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ones and minus ones. A vector is bound into an n-gram by
rotating it once for each place that follows and multiplying; a text is the bundle (sum) of its
n-grams, a language the bundle of its texts. A text gets the language of the closest cosine.

Only letters count: everything else is one boundary symbol, and n-grams with a boundary in the
middle are skipped. Bundling is linear, so n-grams are counted first and bound once each; a
text of any length needs memory for its distinct n-grams and one chunk.

A null text, an empty one and one without a letter is ``und`` with score zero. Without any
training text every text is ``und``. Ties go to the smaller language name. Repeated rows and
rows without an identifier are judged like any others; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillproof.llm.common import held_out, map_batches

DIMENSIONS = 512
# Symbol 0 is the boundary, 1 to 26 are a to z, the rest is shared by all other letters.
SYMBOLS = 64
CODE_POINTS = 0x32400
CHUNK = 1 << 18
UNKNOWN = "und"


def symbol_table() -> np.ndarray:
    """The symbol of every code point; letters beyond the table are looked up one by one."""
    table = np.zeros(CODE_POINTS, np.int32)
    for point in range(CODE_POINTS):
        if chr(point).isalpha():
            low = ord(chr(point).lower()[0])
            table[point] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % (1 << 32) % (SYMBOLS - 27)
    return table


def letter_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all pairs of symbols in the first two places, and of symbols in the third."""
    bits = np.unpackbits(np.frombuffer(b"".join(
        hashlib.shake_128(b"letter %d" % s).digest(DIMENSIONS // 8) for s in range(SYMBOLS)), np.uint8))
    base = (bits.reshape(SYMBOLS, DIMENSIONS).astype(np.int8) * 2 - 1)
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    return (first[:, None, :] * second[None, :, :]).reshape(-1, DIMENSIONS), base


def ngram_ids(text: str, table: np.ndarray):
    """The n-gram numbers of a text, chunk by chunk; chunks overlap by two symbols."""
    tail = np.zeros(1, np.int32)
    for i in range(0, len(text) + 1, CHUNK):
        piece = text[i:i + CHUNK]
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = np.concatenate((tail, table[np.minimum(points, CODE_POINTS - 1)], [0] * (i + CHUNK > len(text))))
        keep = symbols > 0
        keep[1:] |= symbols[:-1] > 0
        keep[0] = True
        symbols = symbols[keep].astype(np.int32)
        ids = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
        yield ids[symbols[1:-1] > 0]
        tail = symbols[-2:]


def bundle(ids: np.ndarray, counts: np.ndarray, pairs: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The sum of bound n-grams, each as often as it occurs."""
    out = np.zeros(DIMENSIONS)
    for i in range(0, len(ids), 4096):
        part = ids[i:i + 4096]
        bound = pairs[part // SYMBOLS] * last[part % SYMBOLS]
        out += counts[i:i + 4096].astype(np.float32) @ bound.astype(np.float32)
    return out


def profiles(docs: DataFrame) -> dict[str, list[float]]:
    """One unit vector per language, learnt from all of ``docs`` (text, lang).

    A task sends one vector per language; Spark adds them, so the driver gets one number per
    language and dimension.
    """
    source = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")

    def run(batches):
        table, (pairs, last) = symbol_table(), letter_vectors()
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, []).extend(ngram_ids(text, table))
            for lang, ids in found.items():
                unique, counts = np.unique(np.concatenate(ids), return_counts=True)
                totals[lang] = totals.get(lang, 0) + bundle(unique, counts, pairs, last)
        langs = list(totals)
        yield pa.record_batch({
            "lang": pa.array([x for x in langs for _ in range(DIMENSIONS)], pa.string()),
            "dim": pa.array(list(range(DIMENSIONS)) * len(langs), pa.int32()),
            "value": pa.array(np.concatenate([totals[x] for x in langs]) if langs else [], pa.float64())})

    parts = source.mapInArrow(run, "lang string, dim int, value double")
    # Values are whole numbers, so the order of addition does not matter.
    rows = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    vectors: dict[str, list[float]] = {}
    for r in rows:
        vectors.setdefault(r.lang, [0.0] * DIMENSIONS)[r.dim] = r.value
    return {k: (np.array(v) / (np.linalg.norm(v) or 1.0)).tolist() for k, v in sorted(vectors.items())}


def predict(
    docs: DataFrame, vectors: dict[str, list[float]], columns: list[str], added: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``columns`` of ``docs`` and two more: the closest language and its cosine."""
    names = list(vectors)
    weights = np.array([vectors[n] for n in names], np.float64).reshape(len(names), DIMENSIONS)
    source = docs.select(*columns, F.col("text").cast("string").alias("_llm_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def make():
        table, (pairs, last) = symbol_table(), letter_vectors()

        def best(text: str | None) -> tuple[str, float]:
            if not text or not names:
                return UNKNOWN, 0.0
            parts = [np.unique(x, return_counts=True) for x in ngram_ids(text, table)]
            ids, counts = parts[0]
            if len(parts) > 1:
                ids, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([p[1] for p in parts]))
            if not len(ids):
                return UNKNOWN, 0.0
            vector = bundle(ids, counts, pairs, last)
            cosines = weights @ vector / (np.linalg.norm(vector) or 1.0)
            at = int(np.argmax(cosines))
            return names[at], float(min(1.0, max(0.0, cosines[at])))

        def work(batch):
            found = [best(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            return pa.record_batch(
                [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*columns, *added])
        return work

    return map_batches(source, make, f"{kinds}, `{added[0]}` string, `{added[1]}` double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learnt from rows that are not held out."""
    vectors = profiles(docs.filter(~held_out(F.col("doc_id"))))
    judged = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(judged, vectors, ["doc_id", "held_out"])


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is found; texts without a letter go. All columns stay, and a
    document without ``lang`` gets the language found."""
    vectors = profiles(docs.filter(~held_out(F.col("doc_id"))))
    found = predict(docs, vectors, docs.columns, ("_llm_lang", "_llm_score")).filter(F.col("_llm_lang") != UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "_llm_lang")).select(*docs.columns)
