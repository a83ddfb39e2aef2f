"""Texts of a megabyte and more that repeat what the scans look for."""

import random
import time

import numpy as np

from tillproof.llm import decontaminate as D, licenses as L, pii as P


def test_license_scan_of_a_long_text():
    scanner = L.Scanner()
    text = (b"Some words, cc by and more. Licensed under the MIT license. All rights reserved. " * 25_000)
    begin = time.monotonic()
    words, places, first, last, base, labels, _ = scanner.scan(text)
    assert time.monotonic() - begin < 20 and words == 14 * 25_000
    assert (places, first, last) == (50_000, 2, words - 3) and base == "cc-by,reserved" and "mit" in labels.split(",")


def test_names_with_versions_stand_alone():
    scanner = L.Scanner()
    labels = lambda text: scanner.scan(text.encode())[5].split(",")
    assert "gpl-2.0" in labels("GPLv2+ only") and "apache-2.0" in labels("Apache-2.0") and "apache-2.0" in labels("it is Apache License, Version 2.0.")
    assert labels("the mit campus and an apache pilot") == [""]


def brute_tiles(doc, item, least):
    """Greedy string tiling by looking at all pairs of places again and again."""
    marked_doc, marked_item, tiles = set(), set(), []
    while True:
        best = []
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in marked_doc and j + n not in marked_item:
                    n += 1
                if n >= least:
                    best.append((-n, i, j))
        if not best:
            return tiles
        n, i, j = min(best)
        tiles.append((i, j, -n))
        marked_doc |= set(range(i, i - n))
        marked_item |= set(range(j, j - n))


def test_tiles_of_repetitive_texts():
    rng = random.Random(4)
    for _ in range(150):
        item = [rng.choice(["a", "b"]) for _ in range(rng.randrange(4, 14))]
        doc = [rng.choice(["a", "b", "c"]) for _ in range(rng.randrange(30))] + item[:rng.randrange(14)]
        look = D.Slice([(1, [w.encode() for w in item])], 3)
        found = look.find(" ".join(doc))
        want = brute_tiles(doc, item, min(3, len(item)))
        assert sorted(found[0][4] if found else []) == sorted(want), (doc, item)


def test_equal_words_against_a_long_item():
    look = D.Slice([(1, [b"la"] * 300), (2, [b"la", b"lo"] * 100)], D.MIN_TILE)
    for text in ("la " * 100_000, "la lo " * 50_000):
        begin = time.monotonic()
        found = {r[0]: r for r in look.find(text)}
        assert time.monotonic() - begin < 20
        assert any(covered == size for _, size, covered, *_ in found.values())


def test_personal_data_of_a_long_text(spark):
    lines = [(f"ü{i} reader{i}@site{i % 7}.com", f" wrote from 10.1.{i % 256}.7\U0001F600\n") for i in range(25_000)]
    text, listed, at = "".join(a + b for a, b in lines), [], 0
    for a, b in lines:
        mail, ip = a.index(" ") + 1, len(a) + b.index("10.")
        listed += [("email", at + mail, at + len(a)), ("ip", at + ip, at + len(a) + len(b) - 2)]
        at += len(a) + len(b)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begin = time.monotonic()
    (r,), (cleaned,) = P.detect(df).collect(), P.redact(df).collect()
    assert time.monotonic() - begin < 90
    assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(listed))
    assert cleaned.text == "".join(f"ü{i} [EMAIL] wrote from [IP]\U0001F600\n" for i in range(25_000))


def test_redaction_at_the_borders_of_pieces(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(60):
        n = rng.choice((0, 1, P.PIECE - 1, P.PIECE, P.PIECE + 1, 2 * P.PIECE, 700))
        texts.append("é" * n + " a@b.org " + "\U0001F600" * rng.choice((0, P.PIECE - 9, P.PIECE, 600)) + rng.choice(("", " 10.0.0.1", " a@b.org")))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in P.redact(df).collect():
        assert r.text == texts[r.doc_id].replace("a@b.org", "[EMAIL]").replace("10.0.0.1", "[IP]")
