"""License scans, decontamination and page extraction on small cases."""

import re

from tillproof.llm import decontaminate as D, html_extract as H, licenses as L


def license_rows(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in texts], "doc_id long, text string, labels string, score double")
    return {r.doc_id: r for r in L.scan(df).collect()}


def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        for i in range(len(own)):
            if own[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base_and_labels(spark):
    texts = [
        (1, "CC BY cc-by cc.by 4.0"), (2, "GNU General\nPublic; License v3"), (3, None), (4, ""), (5, "All rights reserved. é"),
        (6, "ccby general public licenses"), (7, "Released under the MIT License."), (8, "x " * 100_000 + "all rights reserved"),
        (9, "Licensed under the Apache License, Version 2.0"), (None, "cc by"), (10, "İ cc by\u00a0nc")]
    got = license_rows(spark, texts)
    for i, t in texts:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t), t
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[7].labels == "mit" and got[9].labels == "apache-2.0" and got[3].score == 0
    assert license_rows(spark, []) == {}


def test_overlaps_are_suppressed():
    scanner = L.Scanner()
    found = scanner.detections(" licensed under the gnu general public license version 3 ")
    assert [(a, b, r.label) for a, b, r in found] == [(0, 9, "gpl-3.0")]
    assert len(L.rules()) > 200
    # Ordinary words that are license names do not count alone.
    assert scanner.detections(" er geht mit der isc ") == []


ITEM = "the quick brown fox jumps over the lazy dog while seven green birds sing loudly near an old stone bridge"


def tiles_by_hand(doc, item, least):
    """Greedy string tiling by looking at every pair of places again and again."""
    used_doc, used_item, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while (i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]
                       and i + n not in used_doc and j + n not in used_item):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        used_doc |= set(range(i, i + n))
        used_item |= set(range(j, j + n))
        covered += n


def test_tiling_matches_brute_force():
    item = D.tokens(ITEM)
    moved = D.tokens("so " + " ".join(ITEM.split()[11:]) + " and then " + " ".join(ITEM.split()[:11]))
    broken = D.tokens(" ".join(w if i % 6 else "other" for i, w in enumerate(ITEM.split())))
    again = D.tokens((ITEM + " ") * 3)
    for doc in (item, moved, broken, again, [], D.tokens("nothing here at all")):
        found = D.Slice([(1, item)], D.MIN_TILE).find(b" ".join(doc).decode())
        assert sum(f[2] for f in found) == tiles_by_hand(doc, item, D.MIN_TILE)


def test_contamination(spark):
    docs = spark.createDataFrame(
        [(1, f"intro. {ITEM.upper()}! outro", 0.1), (2, " ".join(ITEM.split()[10:]) + " - " + " ".join(ITEM.split()[:10]), 0.2),
         (3, "the quick brown fox is another story", 0.3), (4, None, 0.4), (5, "", 0.5), (None, ITEM, 0.6), (1, ITEM, 0.7),
         (6, "word " * 300_000 + ITEM, 0.8), (7, "short one", 0.9)], "doc_id long, text string, coverage double")
    bench = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, "short one"), (12, None), (13, "")], "item_id long, text string")
    got = D.contamination(docs, bench).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in got) == [(-1, 10), (1, 10), (1, 10), (2, 10), (6, 10), (7, 11)]
    assert {r.tiles for r in got if r.doc_id == 2} == {2}
    # A test set in many slices gives the same.
    sliced = D.contamination(docs, bench, slice_tokens=40).collect()
    assert sorted(map(str, sliced)) == sorted(map(str, got))
    clean = D.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5]
    assert D.contamination(docs, bench.limit(0)).collect() == [] and D.contamination(docs.limit(0), bench).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav>
<div class="cookie-banner">We use cookies</div><div class="post post-17"><h1>Head &amp; line</h1><p>First <b>bold</b>
 text&nbsp;here<p>Second &eacute;&#233;<br>part</p><!-- no --><script>var x = "</p>";</script><ul><li>a<li>b</ul>
<div class="ad">Buy</div><form>Mail</form></div><div id="comments"><article class="comment"><p>Reader says</p></article></div>
<aside>See also</aside><footer>&copy;</footer></body></html>"""


def test_page_blocks():
    assert H.Page(PAGE).text(None) == "Head & line\nFirst bold text here\nSecond éé part\na\nb"
    for source, text in (("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("a < b &lt; c", "a < b < c"), ("x<a href='", "x"),
                         ("&amp;amp;", "&amp;"), ("<div hidden>n</div>y", "y"), ("<p>" * 3000 + "deep", "deep")):
        assert H.Page(source).text(None) == text


def test_hosts_vote(spark):
    def page(body):
        return f"<html><body><div class='menu-top'>m</div>{body}</body></html>"
    usual = page("<div class='story'><p>" + "prose " * 30 + "</p></div><div class='box'><p>other stuff</p></div>")
    odd = page("<div class='story'><p>short</p></div><div class='box'><p>" + "louder " * 40 + "</p></div>")
    rows = [(i, "https://a.example/x", usual, "z") for i in range(5)] + [(9, "http://A.example:80/y", odd, "z"), (10, None, "<p>alone", None),
            (11, "https://b.example/", None, None), (None, "https://b.example/", "<p>b &amp; c", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = {r.page_id: r for r in H.extract(df).collect()}
    # The page whose other box is longer is still read as its host's pages are.
    assert got[9].text == "short" and got[0].text == ("prose " * 30).strip()
    assert (got[10].text, got[11].text, got[None].text) == ("alone", "", "b & c")
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(H.extract(df).collect()) == len(rows)
    assert H.extract(df.limit(0)).collect() == []
