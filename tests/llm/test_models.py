"""Language, toxicity and neighbour search: held-out accuracy, recall and edge cases."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillproof.llm import hilbert as N, language as G, toxicity as X
from tillproof.llm.common import held_out

FOLDER = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


def test_held_out_rule(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


@needs_data
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = G.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(i, t, g, 0.5) for i, (t, g) in enumerate(
        [("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de"), ("the dog", None), (None, "en"), ("", "de"),
         ("12 34 !!", "en"), ("und die katze", None), ("the " * 100_000, "en"), ("猫と犬", None)])] + [(None, "the cat", "en", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in G.predict(df, G.profiles(df), ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in range(8)] == ["en", "de", "en", "und", "und", "und", "de", "en"]
    assert got[3].score == 0 and got[8].lang_pred in ("de", "en") and got[None].lang_pred == "en"
    kept = G.keep_known(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 6, 7, 8, None}
    assert {r.lang_pred for r in G.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert G.identify(df.limit(0)).collect() == []


def test_ngrams_do_not_depend_on_chunks(monkeypatch):
    table, text = G.symbol_table(), "The cat, sat on  Émile's mat. " * 7
    whole = np.concatenate(list(G.ngram_ids(text, table)))
    monkeypatch.setattr(G, "CHUNK", 13)
    assert np.array_equal(np.concatenate(list(G.ngram_ids(text, table))), whole)


BAD = ("grotty", "vilest", "nastier")


def toxic_tables(spark):
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        own = list(rng.choice(plain, 30))
        if i % 5 == 0:
            own[int(rng.integers(30))] = str(rng.choice(BAD)) + str(rng.choice(["", "ly", "ness"]))
        rows.append((i, " ".join(own), 0.9))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1000, "you are grottty people", 0.1), (1001, None, 0.1), (1002, "", 0.1), (None, "vilest", 0.1),
             (1003, 'they said the word "vilest" of course', 0.1), (1004, "a " * 100_000 + "nastier", 0.1)]
    labels += [(5, 1, 1), (None, 1, 1), (7, 1, None)]
    return (spark.createDataFrame(rows, "doc_id long, text string, score double"),
            spark.createDataFrame(labels, "doc_id long, quality long, toxic long"))


def test_toxicity(spark):
    docs, labels = toxic_tables(spark)
    got = {r.doc_id: r for r in X.detect(docs, labels).collect()}
    assert len(got) == docs.count()
    out = [r for r in got.values() if r.held_out and (r.doc_id or 0) < 600]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in out) > 0.98 * len(out)
    # A misspelt term, one in quotation marks, and one at the end of a long text.
    assert got[1000].predicted == got[1004].predicted == got[None].predicted == 1 and got[1001].predicted == got[1002].predicted == 0
    assert got[1003].quoted_hits == 1 and got[1003].score < got[None].score
    empty = X.detect(docs.limit(0), labels.limit(0)).collect()
    assert empty == [] and {r.score for r in X.detect(docs, labels.limit(0)).collect()} == {0.0}


def test_automaton_is_edit_distance_one():
    terms, matcher = {"grotty": 1.0}, X.Matcher({"grotty": 1.0, "vile": 1.0}, frozenset({"grutty"}))

    def within_one(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        return a == b or any(a[:i] + c + a[i + k:] == b for i in range(len(a) + 1) for k in (0, 1) for c in ["", *b])

    for word in ("grotty", "groty", "grottty", "gr0tty", "rotty", "grott", "grttoy", "hrotty", "grottxx", "other", "gr"):
        assert bool(matcher.match({word})) == (word.startswith("grotty") or any(within_one(word, t) for t in terms)), word
    assert matcher.match({"grutty", "vilx", "viler"}) == {"viler"} and matcher.found["viler"] == ("vile", False)


def brute_nearest(ids, vectors, at):
    scores = vectors @ vectors[at]
    order = sorted((-scores[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[at])
    return [i for _, i in order[:N.NEIGHBOURS]]


@needs_data
def test_recall_over_larger_table(spark, monkeypatch):
    big = "/root/testdata/sf0.1/embeddings.parquet"
    df = spark.read.parquet(big if os.path.exists(big) else f"{FOLDER}/embeddings.parquet")
    monkeypatch.setattr(N, "LEAST_WINDOW", 10)  # windows by share alone, as in large tables
    monkeypatch.setattr(N, "BLOCK", 256)
    monkeypatch.setattr(N, "STRETCH", 512)
    got = {}
    for r in N.search(df).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    rows = df.collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    asked = [i for i, v in enumerate(ids) if v % 20 == 0]
    assert sorted(got) == sorted(ids[i] for i in asked)
    assert sum(len(set(got[ids[i]]) & set(brute_nearest(ids, vectors, i))) for i in asked) >= 0.9 * 20 * len(asked)


def test_vectors_that_take_part(spark):
    rng = np.random.default_rng(5)
    own = [(i, rng.normal(size=4).round(3).tolist(), "a") for i in range(60)]
    same = [(i, [1.0, 2.0, -0.0, 0.5], "a") for i in range(100, 160)]
    odd = [(200, None, "a"), (220, [0.0] * 4, "a"), (240, [1.0, None, 1.0, 1.0], "a"), (260, [float("nan")] * 4, "a"),
           (280, [float("inf"), 0.0, 0.0, 0.0], "a"), (300, [1.0], "a"), (320, [], "a"), (None, [9.0] * 4, "a")]
    df = spark.createDataFrame(own + same + odd, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in N.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, vectors = [r[0] for r in own + same], np.array([r[1] for r in own + same])
    assert sorted(got) == [0, 20, 40, 100, 120, 140]
    for q, found in got.items():
        at = ids.index(q)
        assert [i for _, i, _ in sorted(found)] == brute_nearest(ids, vectors, at)
        assert all(abs(s - vectors[ids.index(i)] @ vectors[at]) < 1e-12 for _, i, s in found)
    few = N.search(df.filter("vec_id IN (0, 1, 2)")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]
    assert N.search(df.limit(0)).collect() == []
