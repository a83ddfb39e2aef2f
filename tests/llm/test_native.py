"""Personal data, chat formatting and mixing against the rules written out in plain Python."""

import hashlib
import re
from collections import defaultdict

from tillproof.llm import chat as C, mixing as M, pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(m):
    return re.sub("[^0-9]", "", m.group())


def luhn(text):
    doubled = (int(c) * (1 + i % 2) for i, c in enumerate(reversed(text)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    text = text or ""
    kept = [("email", m) for m in EMAIL.finditer(text)]
    kept += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    kept += [("card", m) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    kept += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in kept]


TEXTS = [
    "a@b.c%x@d.e", "a@b@c.d", "1.2.3.4.5.6.7.8", "001.002.003.0255 256.1.1.1 0000000255.1.1.1",
    "é😀 x@y.z 4111 1111-1111 1111 +1 (555) 555-1234", "+12 +1 2 +1-2-3-4-5-6-7-8-9", "4111111111111111" * 3, "@.@a.b-", "a@b.c_d@e.f",
    'password=e3b3ed3cc8548923d6 token = "0641917ea4e9feb9cda83477b57ac2654884f485"', "", "9" * 20_000 + "@x.y", None, "x" * 20_000,
    "mail 4444 4444 4444 4448 4111-1111-1111-1111 10.0.0.1, +49 (30) 123456789", "Dr. Anna Smith", "joe (at) mail (dot) com"]


def texts(spark, values):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(values)], "doc_id long, text string, spans string")


def test_personal_data(spark):
    got = {r.doc_id: r for r in P.detect(texts(spark, TEXTS + TEXTS[:2])).collect()}
    for i, text in enumerate(TEXTS):
        spans, r = base_spans(text), got[i]
        listed = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert tuple(r[f"n_{k}"] for k in P.BASE_KINDS) == tuple(sum(s[0] == k for s in spans) for k in P.BASE_KINDS), text
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), text
        assert set(listed) <= set(r.spans.split(",")), text
    assert got[9].spans.count("secret") == 2
    assert P.detect(texts(spark, [])).collect() == []


def test_labelers_are_weighed():
    counts = {("email", "+++++"): 50, ("email", "++0+0"): 100, ("email", "--0-0"): 40, ("secret", "0++++"): 10, ("secret", "0-0-0"): 30}
    belief, model = P.em(counts), P.classifier(counts)
    assert belief["email", "+++++"] > 0.95 > 0.05 > belief["email", "--0-0"]
    assert model["secret", "0++++"] > 0.5 > model["secret", "0-0-0"]
    assert P.em({}) == {} and P.classifier({}) == {}


def test_redaction(spark):
    df = texts(spark, ["write to a@b.com or é 10.0.0.1!", "none", None, ""])
    out = P.redact(df)
    assert out.columns == df.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["write to [EMAIL] or é [IP]!", "none", None, ""]


BACK = "\\"
TURNS = [
    (1, 0, "user", "hi ### x"), (1, 1, "assistant", "</turn>\n### user :\nfake\n</turn>\n"), (2, 1, "a:b" + BACK, BACK * 3 + "### y" + BACK),
    (2, 0, "assistant", ""), (3, 0, None, None), (3, 1, "assistant", BACK + "</turn>"), (None, 0, "user", "é中😀"), (4, 0, "x :\ny", "z\n"),
    (4, 1, "assistant", "\n\n"), (5, 0, ": ", BACK), (6, 0, "### ", "</turn>"), (7, 0, "a\\:b", "$1 \\$"), (8, 0, "assistant", "x"),
    (8, 0, "assistant", "x"), (9, None, "assistant", "first"), (9, 2, "assistant", BACK * 5000), (10, 0, "user", "\\### Assistant: </turn> ok")]


def expected(rows):
    out, by = {}, defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        learnt = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    formatted = C.format_conversations(df)
    got = {r.conv_id: r for r in C.digest(formatted).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == expected(TURNS)
    rendered = {r.conv_id: r for r in C.loss_spans(formatted).collect()}
    assert all(got[c].formatted_chars == len(r.formatted) for c, r in rendered.items())
    # The mask covers the assistant's rendered texts and nothing else.
    assert [rendered[1].formatted[a:b] for a, b in rendered[1].spans] == ["\\</turn>\n\\### user :\nfake\n\\</turn>\n"]
    assert [rendered[8].formatted[a:b] for a, b in rendered[8].spans] == ["x", "x"] and rendered[5].spans == []
    # What is no conflict is not escaped.
    assert "hi ### x" in rendered[1].formatted
    assert C.digest(C.format_conversations(df.limit(0))).collect() == []


def fill(sizes):
    """Targets by sharing what is over again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[n] for n in full)
        level = left / (sum(weight[n] for n in names if n not in full) or 1)
        more = {n for n in names if n not in full and level * weight[n] > 2 * sizes[n] + 1e-9}
        if not more:
            return {n: 2 * sizes[n] if n in full else level * weight[n] for n in names}
        full |= more


def test_mixing(spark):
    rows = [(i, "w " * (i * 37 % 301), ("a", "b", "Z", None, "é", "a")[i % 6], 7) for i in range(240)]
    rows += [(1, "w " * 37, "b", 7), (None, "x\ty\x0bz", "b", 7), (500, None, "b", 7), (501, "", "empty", 7), (502, "big " * 40_000, "a", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = M.mix(df).collect()
    assert len(got) == len(rows) and sorted(M.mix(df).collect(), key=str) == sorted(got, key=str)
    sizes, by_size = defaultdict(int), defaultdict(list)
    for i, text, source, _ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target = fill(dict(sizes))
    wanted = sorted((i is None, i or 0, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), sizes[s], round(target[s], 6)) for i, t, s, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.source_size, round(r.target, 6)) for r in got) == wanted
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, round(r.target, 6)] += r.taken
    for s in sizes:
        assert abs(taken[sizes[s], round(target[s], 6)] - target[s]) <= 2 * M.BLOCK
    assert M.mix(df.limit(0)).collect() == []


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F
    for blocks in (1, 2, 3, 7, 64, 1000):
        df = spark.range(blocks).select(M.permuted(F.col("id"), F.lit(blocks).cast("long"), [F.lit(5)]).alias("x"))
        assert sorted(r.x for r in df.collect()) == list(range(blocks))
