"""Token files against whole texts encoded one by one, and what their indexes skip."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tillproof.llm import token_files as T

ODD = ["", " ", "a", " a", "a ", "a  b", "a b", "a\n b", "a \nb", "\ta b\t", "it's we'll 12 345 ...!? x", "ü ß 漢字 かな 😀 😀", "a b c", "a 　 b",
       "x\x1c y \x1fz", "a <|endoftext|> b", "a<|endoftext|>b", "don 't  'll", "12 34\r\n 5", "a\nb c\nd", "\n", "a\n", "don' t's", "x.\" y,%%% z'", "a\n\nb", "a​ b", "\x00 a", "é é", "a \x85b"]


@pytest.fixture(scope="module")
def whole():
    own = Tokenizer.from_file(T.tokenizer_path())
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


def test_pieces_are_the_whole(whole):
    encoder = T.Encoder(T.tokenizer_path())
    assert encoder.by_piece
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "the", " ", " ", "\n", "'s", ".", "7", "ß", " ", "\x1d", "Ab", "-", ",", ":", "été", "ſt", "ʰ", "ǅ"]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole(text), repr(text)


def test_other_tokenizers_see_whole_texts():
    path = T.tokenizer_path("word_bpe_49k.json")
    encoder, own = T.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.by_piece
    texts = [t for t in ODD if "endoftext" not in t]
    assert [np.frombuffer(e, "<u4").tolist() for e in encoder.encode(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def expected(rows, whole):
    out, start = [], 0
    for doc_id, text in rows:
        ids = whole(text) + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_operator(spark, whole, monkeypatch):
    monkeypatch.setattr(T, "LETTERS", 40)
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(1000, "long " * 30_000), (-5, None)]
    df = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id int, ids int").repartition(5)
    got = T.encode_and_read_back(df).collect()
    assert sorted(map(tuple, got)) == expected(sorted(rows, key=lambda r: r[0]), whole)
    assert T.encode_and_read_back(df.limit(0)).collect() == []


def test_equal_and_missing_identifiers(spark, whole):
    rows = [(7, f"text {i % 50}") for i in range(3000)] + [(None, "x"), (8, "y"), (None, None)]
    got = T.encode_and_read_back(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert len(got) == len(rows) and sorted((r.doc_id, r.ids_crc32) for r in got if r.doc_id) == sorted(
        (d, zlib.crc32(np.array(whole(t) + [2], "<u4").tobytes())) for d, t in rows if d)
    spans = sorted((r.start, r.n_tokens, r.doc_id) for r in got)
    assert spans[0][0] == 0 and all(a + n == b for (a, n, _), (b, *_) in zip(spans, spans[1:]))
    assert [d for *_, d in spans] == [None] * 2 + [7] * 3000 + [8]


def rows_read(spark, df):
    plan = df._jdf.queryExecution()
    df.collect()
    nodes, total = [plan.executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        nodes.extend(node.children().apply(i) for i in range(node.children().size()))
    return total


def test_indexes_skip_rows(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "tokens")
    # Gaps of identifiers: 2 mod 5 are in no document, so ranges cannot rule them out but Bloom filters can.
    docs = spark.range(40_000).selectExpr("id * 5 AS doc_id", "concat('word ', id) AS text")
    T.write_tokens(docs, folder)
    tokens = T.read_tokens(spark, folder)
    assert tokens.count() == 40_000 and tokens.select("file").distinct().count() >= 1
    reader = spark._jvm.org.apache.orc.OrcFile
    conf = spark._jsc.hadoopConfiguration()
    import glob
    for name in glob.glob(f"{folder}/*.orc"):
        own = reader.createReader(spark._jvm.org.apache.hadoop.fs.Path(name), reader.readerOptions(conf))
        assert own.getRowIndexStride() == T.ROW_GROUP
    found = T.lookup_tokens(spark, folder, [500, 12_345, 199_995])
    assert rows_read(spark, found) <= 3 * T.ROW_GROUP * 2
    assert sorted(r.doc_id for r in found.collect()) == [500, 12_345, 199_995]
    missing = T.lookup_tokens(spark, folder, [100_002])
    assert "PushedFilters: [In(doc_id" in missing._jdf.queryExecution().toString() or "EqualTo(doc_id" in missing._jdf.queryExecution().toString()
    assert rows_read(spark, missing) == 0
