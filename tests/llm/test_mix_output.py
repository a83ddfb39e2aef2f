"""The mix itself: slots of shards with the words of their blocks."""

import re
from collections import Counter, defaultdict

from tillproof.llm import mixing as M


def test_mixed_text_is_dealt_from_the_sources(spark):
    rows = [(i, " ".join(f"d{i}w{n}" for n in range(i * 37 % 301)), ("a", "b", None)[i % 3]) for i in range(120)]
    rows += [(3, rows[3][1], "a"), (900, None, "b"), (901, " \t", "b"), (902, "\n" + " ".join(f"big{n}" for n in range(20_000)) + "\x0b", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = M.mixed(df).collect()
    assert set(out[0].asDict()) == {"shard", "slot", "source", "block", "text"}
    shards, blocks = defaultdict(list), {}
    for r in out:
        shards[r.shard].append(r.slot)
        # A block is the same words in each slot that takes it.
        assert blocks.setdefault((r.source, r.block), r.text) == r.text
    assert all(sorted(own) == list(range(len(own))) for own in shards.values())
    assert max(Counter((r.source, r.block) for r in out).values()) <= 2
    # Sources alternate within a shard.
    first = [r.source for r in sorted(out, key=lambda r: (r.shard, r.slot)) if r.shard == 0]
    assert sum(a != b for a, b in zip(first, first[1:])) > 20
    owner, copies = {}, Counter()
    for i, text, source in rows:
        copies[i] += 1
        owner |= {w: (i, source) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")}
    mixed = Counter()
    for r in out:
        own = r.text.split(" ")
        assert 0 < len(own) <= M.BLOCK and all(owner[w][1] == r.source for w in own)
        mixed.update(owner[w][0] for w in own)
    taken = Counter()
    for r in M.mix(df).collect():
        taken[r.doc_id] += r.taken
    assert {i: n for i, n in taken.items() if n} == dict(mixed)
    assert M.mixed(df.limit(0)).collect() == []


def test_buckets_follow_the_number_of_documents(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (i % 40), "a") for i in range(500)], "doc_id long, text string, source string")
    whole = {r.doc_id: (r.size, r.target) for r in M.mix(df).collect()}
    monkeypatch.setattr(M, "BUCKET", 7)
    deal = M.Deal(df)
    assert deal.placed.select("bucket").distinct().count() > 60
    got = deal.counted().collect()
    assert {r.doc_id: (r.size, r.target) for r in got} == whole
    assert sum(len(r.text.split()) for r in deal.mixed().collect()) == sum(r.taken for r in got) and all(r.taken <= 2 * r.size for r in got)
