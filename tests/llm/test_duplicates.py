"""SimHash groups against brute force over all pairs, and the pipeline's choice of one row."""

import re

import pytest
import xxhash

from tillproof.llm import simhash as S

SCHEMA = "doc_id long, text string, component_id string, fp int"
WORDS = "one two three four five six seven eight nine ten eleven twelve".split()
LONG = " ".join(f"w{i % 977}" for i in range(200_000))
ROWS = [
    (3, " ".join(WORDS * 9)), (1, " ".join(WORDS * 9)), (2, " ".join(WORDS * 9) + " end"), (4, "A b C"), (5, "a  B\tc"),
    (6, "only two"), (7, ""), (8, None), (9, " \n"), (None, "A b C"), (10, "é\x0b中 x"), (11, LONG), (12, LONG + " tail"),
    (4, "A b C"), (13, "something else entirely, with words of its own"), (4, "another text of document four"), (None, None)]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(text):
    own = words(text)
    if not own:
        return 0
    shingles = [" ".join(own[i:i + 3]) for i in range(len(own) - 2)] or [" ".join(own)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def groups(prints, radius):
    """The smallest fingerprint reachable from each."""
    root = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(a ^ b).count("1") <= radius and root[a] < root[b]:
                    root[b], changed = root[a], True
    return root


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_fingerprints_and_groups(spark):
    prints = [brute(t) for _, t in ROWS]
    root = groups(set(prints), 2)
    smallest = {}
    for (i, _), p in zip(ROWS, prints):
        if i is not None:
            smallest[root[p]] = min(i, smallest.get(root[p], i))
    want = sorted((i is None, i or 0, format(p, "016x"), smallest.get(root[p])) for (i, _), p in zip(ROWS, prints))
    got = S.near_duplicates(frame(spark, ROWS)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in got) == want


def test_chains_join_and_far_ones_do_not(spark):
    # Each fingerprint is two bits from the one before, so the ends meet only by way of the rest.
    chain = [0] + [(1 << (2 * k)) - 1 for k in range(1, 12)]
    alone = [0xFFFFFFFF << 30]
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in chain + alone], "fp long")
    roots = {r.node: r.root for r in S.components(S.ball_links(df)).collect()}
    assert roots == {p: 0 for p in chain if p}


def test_every_pair_within_the_radius_is_linked(spark):
    base = 0x123456789ABCDEF
    near = [base] + [base ^ (1 << a) for a in (0, 17, 62)] + [base ^ (1 << 3) ^ (1 << b) for b in (9, 40)] + [base ^ 0b111]
    df = spark.createDataFrame([(p,) for p in near], "fp long")
    roots = {r.node: r.root for r in S.components(S.ball_links(df)).collect()}
    want = {p: r for p, r in groups(set(near), 2).items() if p != r}
    assert roots == want


def test_keep_one(spark):
    kept = S.keep_one(frame(spark, ROWS))
    assert kept.columns == ["doc_id", "text", "component_id", "fp"]
    rows = kept.collect()
    root = groups({brute(t) for _, t in ROWS}, 2)
    assert sorted(root[brute(r.text)] for r in rows) == sorted(set(root.values()))
    by_root = {root[brute(r.text)]: r.doc_id for r in rows}
    for i, t in ROWS:
        assert i is None or by_root[root[brute(t)]] <= i


def test_empty_table_and_odd_radius(spark):
    empty = frame(spark, [])
    assert S.near_duplicates(empty).collect() == [] and S.keep_one(empty).collect() == []
    with pytest.raises(ValueError):
        S.ball_links(empty.select("fp"), 3)
