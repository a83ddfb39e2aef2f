"""The pipeline's stages on small documents: each works on what the one before kept."""

import os
import re

import corpus_pipeline as P
from tillproof.llm import decontaminate

FOLDER = "/root/testdata/sf0.001"


def runs_of_five(text):
    own = [w for w in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return {" ".join(own[i:i + 5]) for i in range(max(1, len(own) - 4))}


def brute_kept(docs, bench):
    """Rows left before personal data is replaced, decided one row at a time."""
    rows = [r for r in docs if any(c.isalpha() for c in r.text or "")]
    own = {r.doc_id: runs_of_five(r.text) for r in rows}
    left = []
    root = {i: i for i in own}
    near = [(a, b) for a in own for b in own if a < b and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    items = [(b.item_id, decontaminate.tokens(b.text)) for b in bench]
    look = decontaminate.Slice(items, decontaminate.MIN_TILE)
    for r in rows:
        if root[r.doc_id] == r.doc_id and not any(c >= decontaminate.THRESHOLD * n for _, n, c, *_ in look.find(r.text)):
            left.append(r)
    return left


def test_pipeline(spark):
    if not os.path.isdir(FOLDER):
        return
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "mixing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = brute_kept(docs.collect(), spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect())
    kept = docs
    for _, stage in P.STAGES[:3]:
        kept = stage(spark, kept, FOLDER)
        assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in left)
    cleaned = P.without_personal_data(spark, kept, FOLDER)
    texts = {r.doc_id: r for r in cleaned.collect()}
    assert not any(re.search(r"[\w.]+@[\w-]+\.\w", r.text) for r in texts.values())
    assert all(r.n_chars == len(r.text) for r in texts.values())
    # Texts without personal data are as they were.
    assert sum(texts[r.doc_id].text == r.text for r in left) > 0.8 * len(left)
    out = P.run(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in texts.items()}
    assert all(r.size == sizes[r.doc_id] and 0 <= r.taken <= 2 * r.size for r in out)


def test_corpus_is_written(spark, tmp_path):
    if not os.path.isdir(FOLDER):
        return
    corpus = P.write_corpus(spark, FOLDER, str(tmp_path / "mix"))
    taken = spark.read.parquet(str(tmp_path / "mix/taken"))
    assert corpus.columns == ["shard", "slot", "source", "block", "text"]
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in corpus.collect())
    assert words == taken.agg({"taken": "sum"}).first()[0] > 0


def test_language_is_filled_in(spark):
    rows = [(i, f"ab{'cd' * (i % 3)} abba cabba", "xx", "s") for i in range(40)] + [(90, "abba cabba", None, "s"), (91, "12 !", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.lang for r in P.known_language(spark, df, "").collect()}
    assert got.pop(90) == "xx" and 91 not in got and set(got.values()) == {"xx"}
