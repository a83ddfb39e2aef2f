"""The pipeline's near copies against all pairs of shingle sets."""

import random

import numpy as np

import corpus_pipeline
from tillproof.llm import near_copies as N


def shingle_set(text):
    own = (text or "").lower().split()
    return {" ".join(own[i:i + 5]) for i in range(max(1, len(own) - 4))}


def brute_kept(rows):
    own = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in own}
    changed = True
    while changed:
        changed = False
        for a in own:
            for b in own:
                if root[a] < root[b] and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]):
                    root[b], changed = root[a], True
    return sorted(i for i in own if root[i] == i)


def changed_text(words, places):
    return " ".join("changed" if n in places else w for n, w in enumerate(words))


def test_stage_keeps_one_of_all_near_copies(spark):
    rng = random.Random(5)
    rows, line = [], "a line that very many of the texts have in common with each other"
    for k in range(30):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice((60, 200, 900)))]
        for n in range(6):
            # Similarities from far below 0.8 to nearly 1.
            places = set(rng.sample(range(len(words)), max(1, len(words) * n // 120)))
            rows.append((len(rows), changed_text(words, places) + " " + line * (k % 2)))
    rows += [(500 + n, t) for n, t in enumerate(("", "few words", "Few  words", "é x y z a b", None))]
    # A chain: each is near the one before, the ends are not near each other.
    words = [f"c{i}" for i in range(120)]
    rows += [(1000 + n, changed_text(words, set(range(3 * n)))) for n in range(12)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, mark string")
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    want = brute_kept(rows)
    assert kept.columns == df.columns and len(want) < len(rows)
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_order_does_not_decide(spark, monkeypatch):
    words = [f"c{i}" for i in range(80)]
    rows = [(n, changed_text(words, {n})) for n in range(40)] + [(99, " ".join(words[:40]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(N, "COMMON", 10**6)
    assert sorted(r.doc_id for r in N.keep_one(df).collect()) == brute_kept(rows)
    assert N.keep_one(df.limit(0)).collect() == []


def test_cells_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    for _ in range(500):
        both = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, rng.integers(2, 400)))
        a, b = (np.sort(both[rng.random(len(both)) < share]) for share in (0.95, rng.random()))
        if len(a) and len(b):
            apart = len(np.setxor1d(a, b))
            assert N.cells_apart(N.parity(a), N.parity(b)) <= apart
            assert (N.cells_apart(N.parity(a), N.parity(b)) - apart) % 2 == 0
    assert N.cells_apart(N.parity(a), N.parity(a)) == 0


def test_fingerprints_of_sets_find_near_copies(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{rng.randrange(900)}" for _ in range(2000)]
    texts = [changed_text(words, {n}) for n in range(0, 2000, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # With prefixes that never meet, the balls alone find what is within two bits.
    monkeypatch.setattr(N, "prefix_length", lambda size: 0)
    assert 1 <= N.keep_one(df).count() < len(texts)
