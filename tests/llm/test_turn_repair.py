"""Cheapest repairs against a search over all edits, whole results against rows worked one by one."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

from tillproof.llm import turn_repair as T

GRAMMAR = re.compile(r"(s?(ua)+)?")


def brute_repair(rows):
    """(cost, audit, repaired) by trying all edits: rows are (initial, role, text, must_go, truncated)."""
    best = None
    limit = 3 * len(rows) + 4

    def legal_start(initials):
        return re.fullmatch(r"s?(ua)*u?", initials) is not None

    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, at, initials, out = heapq.heappop(heap)
        if at == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, out
        steps = [("I", 2, at, r[0], (r, "")) for r in ("user", "assistant")]
        if at < len(rows):
            initial, role, text, gone, cut = rows[at]
            steps.append(("D", 3, at + 1, "", None))
            if not gone:
                if initial:
                    steps.append(("K", int(cut), at + 1, initial, (role, text)))
                steps += [("R", 2 + int(cut), at + 1, r[0], (r, text)) for r in ("user", "assistant")]
        for letter, more, to, initial, row in steps:
            if cost + more <= limit and legal_start(initials + initial):
                heapq.heappush(heap, (cost + more, audit + letter, to, initials + initial, out + ((row,) if row else ())))
    return best


def brute(conv_rows, conv_id):
    """The contract for one conversation, a row at a time."""
    rows = []
    for turn, role, text in conv_rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        rows += [(turn, role, text)] * (2 if h == 3 else 1)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    n, seen, marked = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        marked.append((role[:1], role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, out = brute_repair(marked)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (conv_id, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha)


def test_solver_against_all_edits():
    rng = random.Random(1)
    strings = {"".join(rng.choice("dsuaxSUAX") for _ in range(rng.randrange(6))) for _ in range(400)}
    ordered = sorted(strings, key=lambda s: s[::-1])
    for letters, cost, audit, _ in T.solve(iter(ordered)):
        rows = [("" if c == "d" else c.lower(), c, "", c == "d", c.isupper()) for c in letters]
        assert (cost, audit) == brute_repair(rows)[:2], letters


def test_suffixes_are_computed_once():
    strings = ["ua", "uaua", "sua", "uaS", "xuaS", ""]
    ordered = sorted(strings, key=lambda s: s[::-1])
    solved = {s: new for s, _, _, new in T.solve(iter(ordered))}
    assert sum(solved.values()) == len({s[i:] for s in strings for i in range(len(s))})


def test_long_conversation_is_linear():
    letters = "uaUAdx" * 100_000
    (_, cost, audit, new), = T.solve(iter([letters]))
    assert new == len(letters) and len(audit) >= len(letters) and cost > 0


def test_operator(spark):
    rng = random.Random(2)
    texts = ["Yes.", "No", "Why?", "", " \t", "Go!\n", "ü. ", None, "...", "Then."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "umpire"]
    conversations = {c: [(t, rng.choice(roles[:2] if c % 3 else roles), rng.choice(texts)) for t in range(rng.randrange(1, 6))] for c in range(150)}
    conversations |= {None: [(0, "user", "Hi."), (1, "assistant", "Ho.")], 900: [(None, "user", "a."), (None, "assistant", "b."), (3, "user", "c.")],
                      901: [(0, "user", "a.")] * 3, 902: [(5, "assistant", "a."), (5, "assistant", "b"), (1, "system", "s.")]}
    rows = [(c, t, r, x, "e") for c, own in conversations.items() for t, r, x in own]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, audit string")
    got = T.repair(T.damaged(df)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    want = [brute(own, c) for c, own in conversations.items()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(r.audit == "" and r.cost == 0 for r in got)
    assert T.repair(T.damaged(df.limit(0))).collect() == []


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "b."), (1, 1, "user", "c."), (2, 0, "system", "s."), (3, 0, "user", "")],
                               "conv_id int, turn long, role string, text string")
    rows = T.rows_of(df).selectExpr("*", "false AS lost")
    turns = T.repaired_turns(rows, T.audit(rows).select("conv_id", "audit")).collect()
    assert sorted((r.conv_id, r.place, r.role, r.text) for r in turns) == [
        (1, 0, "user", ""), (1, 1, "assistant", "b."), (1, 2, "user", "c."), (1, 3, "assistant", "")]
