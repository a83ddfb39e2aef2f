"""Runs against all stretches tried one by one, Lyndon arrays against their definition."""

import hashlib
import math
import random
import time
import zlib

import numpy as np

from tillproof.llm import periodic_runs as R


def brute_runs(words):
    """Every stretch that repeats with period q and can be extended to neither side."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            own = words[i:j + q]
            if length >= max(6, 4 * q) and not any(all(own[k] == own[k + s] for k in range(length - s)) for s in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def triples(words):
    return [(r.start, r.length, r.period) for r in R.find_runs(R.numbered(words))]


def sequences(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(6)):
            root = [rng.choice("abc") for _ in range(rng.randrange(1, 6))]
            words += (root * rng.randrange(1, 8))[rng.randrange(2):]
        yield [w.encode() for w in words]


def test_lyndon_array_is_next_smaller_suffix():
    for words in sequences(1, 400):
        ranks = [w[0] for w in words]
        for own in (ranks, [-r for r in ranks]):
            n = len(own)
            expected = [next((j for j in range(i + 1, n) if own[j:] < own[i:]), n) - i for i in range(n)]
            assert R.lyndon_array(own) == expected


def test_runs_against_brute_force():
    for words in sequences(2, 1500):
        assert triples(words) == brute_runs(words), words
    assert triples([]) == [] and triples([b"a"] * 5) == [] and triples([b"a"] * 6) == [(0, 6, 1)]
    # Runs of different periods that overlap and hold each other.
    nested = ([b"a"] * 7 + [b"b"]) * 5
    assert triples(nested) == brute_runs(nested) and len(triples(nested)) == 6


def test_long_texts_stay_linear():
    rng = random.Random(3)
    root = [str(rng.randrange(50)).encode() for _ in range(1000)]
    for words in ([b"a"] * 200_000, root * 200, (([b"a"] * 300 + [b"b"]) * 700), [b"ab"[i & (i >> 1) & 1:][:1] for i in range(200_000)]):
        begin = time.monotonic()
        found = triples(words)
        assert time.monotonic() - begin < 20 and (found or len(words) == 200_000)
    fib = [b"a", b"a", b"b"]
    while len(fib) < 100_000:
        fib = (fib + fib[:len(fib) * 2 // 3])[:100_000]
    begin = time.monotonic()
    triples(fib)
    assert time.monotonic() - begin < 20


def expected(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + math.floor((n - a) / (3 + g % 8))
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_operator(spark):
    rng = random.Random(4)
    hit = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:60]
    rows = [(i, " ".join(rng.choice(["la", "le", "lü", " x"]) for _ in range(rng.randrange(60)))) for i in [*range(60), *hit]]
    rows += [(7, "la " * 50), (7, "la " * 50), (9001, None), (9002, ""), (9003, " \t\n "), (9004, "a\x0bb\x0ca\rb a b a\tb a b ")]
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, runs string")
    got = sorted((tuple(r) for r in R.digest(R.detect(df, damaged=True)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)
    assert got == sorted((expected(*r) for r in rows), key=str)
    assert R.digest(R.detect(df.limit(0))).collect() == []
    none = R.digest(R.detect(spark.createDataFrame([(None, "a a a a a a")], "doc_id int, text string"), damaged=True)).first()
    assert none.doc_id is None and (none.n_runs, none.length) == (1, 6)
    kept = R.detect(df.filter("doc_id = 7 AND text LIKE 'la la la la%'")).first()
    assert kept.collapsed == "la"
