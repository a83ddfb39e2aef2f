"""Repairing the turns of conversations by cheapest edits, computed once per shared suffix.

A repaired conversation's roles read ``(s?(ua)+)?`` by their initials: perhaps a system turn, then
users and assistants in turn. A row may be kept (0), given the role user or assistant (2) or deleted
(3; a blank or repeated row must be), empty user or assistant turns may be put in anywhere (2), and
a truncated row that stays costs 1 more.

What decides is a row's signature: deleted anyway, or its initial and whether it is truncated. A
conversation is a string of such letters, and the cheapest way to repair the rest of it depends on
the rest alone. Distinct strings, read from the end, are range-partitioned and sorted, so strings
that share a suffix stand together: each task walks them in order and holds the automaton's path of
the string at hand. Only letters beyond the suffix shared with the string before become new nodes; a
node's cost and first edit are computed once for each grammar state. Copies of a conversation, few or
many, are one string. Paths are cut at task borders only.

In a grammar state every kind of edit leads to one next state, so the edits that begin with one letter
are one choice, and of equally cheap choices the least letter gives the least text.

Rows are read in order of conversation and turn by tasks that hold one row at a time; so are the hashes
of the repaired text computed. Rows of one conversation meet in one task, as one hash over all its text
asks for, and Spark's sort may spill them.

Null roles and texts count as one space. Rows without a turn come first; rows of one turn are ordered by
role and text. Rows without a conversation are a conversation of their own. An empty role has no
initial, so it cannot be kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillproof.scale import lookup, written

RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# Grammar states: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
# The role that user and assistant turns put in or given anew have in a state, and where they lead.
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (USER, USER, ASSISTANT, USER)
FINAL = (START, ASSISTANT)
# Letters of signatures: a row that must go, kept initials, and the same in capitals if truncated.
GONE, OTHER = "d", "x"
LEGAL_PAIRS = ("su", "ua", "au")
BLANK_SET = "\\x20\\x09-\\x0D"
# Records of one Arrow batch, at most.
BATCH = 5000

Node = tuple[tuple[int, str], ...]  # (cost, first edit) by grammar state


def _settled(costs: list[tuple[int, str]]) -> Node:
    """``costs`` without insertions, and what insertions before the rest can improve."""
    best = list(costs)
    for _ in STATES:
        for s in STATES:
            best[s] = min(best[s], (INSERT + best[NEXT_STATE[s]][0], "I"))
    return tuple(best)


def last_node() -> Node:
    """The node of the empty rest."""
    far = 1 << 40
    return _settled([(0, "") if s in FINAL else (far, "") for s in STATES])


def kept_state(state: int, initial: str) -> int | None:
    """Where a row of this initial leads if it is kept, if it may be."""
    if initial == "s" and state == START:
        return SYSTEM
    return NEXT_STATE[state] if initial == NEXT_ROLE[state][0] else None


def node_before(letter: str, rest: Node) -> Node:
    """The node of ``letter`` followed by what ``rest`` stands for."""
    out = []
    for s in STATES:
        choices = [(DELETE + rest[s][0], "D")]
        if letter != GONE:
            more, to = TRUNCATED * letter.isupper(), kept_state(s, letter.lower())
            if to is not None:
                choices.append((more + rest[to][0], "K"))
            choices.append((more + RETYPE + rest[NEXT_STATE[s]][0], "R"))
        out.append(min(choices))
    return _settled(out)


def follow(letters: str, path: list[Node]) -> str:
    """The edits of a whole string: ``path`` has the node of the empty rest first, then longer ones."""
    edits, state, at = [], START, len(letters)
    while True:
        edit = path[at][state][1]
        if not edit:
            return "".join(edits)
        edits.append(edit)
        if edit == "K":
            state = kept_state(state, letters[len(letters) - at].lower())
        elif edit in "IR":
            state = NEXT_STATE[state]
        if edit != "I":
            at -= 1


def solve(strings: Iterator[str]) -> Iterator[tuple[str, int, str, int]]:
    """(string, cost, edits, new nodes) of signatures that come sorted by their reversed text."""
    path, before = [last_node()], ""
    for letters in strings:
        shared = 0
        for a, b in zip(reversed(letters), reversed(before)):
            if a != b:
                break
            shared += 1
        del path[shared + 1:]
        for letter in reversed(letters[:len(letters) - shared]):
            path.append(node_before(letter, path[-1]))
        before = letters
        yield letters, path[-1][START][0], follow(letters, path), len(letters) - shared


def repairs(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit, new_nodes of every distinct ``signature``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in solve(s for b in batches for s in b.column(0).to_pylist()):
            rows.append(row)
            if len(rows) == BATCH:
                yield _batch(rows, SOLVED)
                rows = []
        if rows:
            yield _batch(rows, SOLVED)

    ordered = signatures.select("signature").distinct().withColumn("_back", F.reverse("signature"))
    ordered = ordered.repartitionByRange("_back").sortWithinPartitions("_back").select("signature")
    return ordered.mapInArrow(run, "signature string, cost long, audit string, new_nodes long")


SOLVED = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("new_nodes", pa.int64())])
COUNTED = pa.schema([("conv_id", pa.int64())] + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal")] + [("signature", pa.string())])
HASHED = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of at most BATCH rows or about 4 million letters of text."""
    held, letters = [], 0
    for row in rows:
        held.append(row)
        letters += sum(len(v) for v in row if isinstance(v, str))
        if len(held) == BATCH or letters > 1 << 22:
            yield _batch(held, schema)
            held, letters = [], 0
    if held:
        yield _batch(held, schema)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def rows_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as the operator reads them."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``rows_of`` with a fifth of the rows damaged, and ``lost`` for rows that are only a trace of their conversation."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows_of(conversations).select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("lost"), F.explode(times).alias("_copy")).drop("_copy")


def _last_mark(text: Column) -> Column:
    """The last character that is not blank; empty if there is none."""
    return F.regexp_extract(text, f"([^{BLANK_SET}])[{BLANK_SET}]*\\z", 1)


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, signature of every conversation.

    ``rows`` are those of ``damaged``, or of ``rows_of`` with ``lost`` false. Texts stay behind: a row goes
    on as its hash, its initial and its last mark. Rows are sorted twice in their partition, first with
    equal rows together, so that neither a set of rows seen nor a conversation is held in memory.
    """
    mark = _last_mark(F.col("text"))
    narrow = rows.select(
        "conv_id", "turn", "lost", F.substring("role", 1, 1).alias("initial"), (mark == "").alias("blank"),
        (~mark.isin(".", "!", "?")).alias("open"), "role",
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"),
    ).repartition("conv_id")
    # Partitioned by conversation already, so the window shuffles nothing.
    seen = narrow.withColumn("again", F.row_number().over(
        W.partitionBy("conv_id", "lost", "same").orderBy(F.col("turn").asc_nulls_first())) > 1)
    ordered = seen.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "same", "again").select(
        "conv_id", "turn", "lost", "initial", "blank", "open", "again")

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, started = None, False
        for conv_id, turn, lost, initial, blank, open_, again in _columns(batches):
            if not started or conv_id != conv:
                if started:
                    yield done()
                conv, started = conv_id, True
                low = high = last = None
                distinct, n, letters, before = 0, dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), [], None

                def done() -> tuple:
                    gaps = 0 if low is None else high - low + 1 - distinct
                    return conv, gaps, *n.values(), "".join(letters)
            if lost:
                continue
            if turn is not None:
                low, high = turn if low is None else low, turn
                distinct += turn != last
                last = turn
            fault = "blank" if blank else "duplicate" if again else "truncated" if open_ else None
            if fault:
                n[fault] += 1
            n["illegal"] += before is not None and before + initial not in LEGAL_PAIRS
            before = initial
            letter = initial if initial in ("s", "u", "a") else OTHER
            letters.append(GONE if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
        if started:
            yield done()

    return ordered.mapInArrow(
        lambda batches: _in_batches(conversations(batches), COUNTED),
        "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string")


def _repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows of every conversation in order, led by a row that has its edits."""
    head = audits.select("conv_id", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("turn"),
                         F.lit("").alias("role"), "audit", F.lit("").alias("same"))
    own = rows.filter("NOT lost").select(
        "conv_id", F.lit(1).alias("_kind"), "turn", "role", F.col("text").alias("audit"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"))
    return head.unionByName(own).repartition("conv_id").sortWithinPartitions(
        "conv_id", "_kind", F.col("turn").asc_nulls_first(), "role", "same").select("conv_id", "_kind", "role", "audit")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, place, role, text) of all repaired rows; place -1 opens a conversation."""
    conv, edits, at, state, place = None, "", 0, START, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(edits) and edits[at] == "I":
            yield conv, place, NEXT_ROLE[state], ""
            at, state, place = at + 1, NEXT_STATE[state], place + 1

    for conv_id, kind, role, text in _columns(batches):
        if kind == 0:
            conv, edits, at, state, place = conv_id, text, 0, START, 0
            yield conv, -1, "", ""
        else:
            edit, at = edits[at], at + 1
            if edit != "D":
                yield conv, place, NEXT_ROLE[state] if edit == "R" else role, text
                state = kept_state(state, role[:1]) if edit == "K" else NEXT_STATE[state]
                place += 1
        yield from inserted()


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the conversations after their edits."""
    return _repaired(rows, audits).mapInArrow(
        lambda batches: _in_batches((r for r in _edited(batches) if r[1] >= 0), REPAIRED),
        "conv_id long, place long, role string, text string")


def repaired_hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``role:text`` of the repaired rows, joined by line ends."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, running = None, None
        for conv_id, place, role, text in _edited(batches):
            if place < 0:
                if running is not None:
                    yield conv, running.hexdigest()
                conv, running = conv_id, hashlib.sha256()
            else:
                running.update(("\n" * (place > 0) + role + ":" + text).encode())
        if running is not None:
            yield conv, running.hexdigest()

    return _repaired(rows, audits).mapInArrow(
        lambda batches: _in_batches(hashes(batches), HASHED), "conv_id long, repaired_sha256 string")


def audit(rows: DataFrame) -> DataFrame:
    """``faults`` of every conversation with cost and audit (the initials of its cheapest edits), written."""
    found = written(faults(rows), "faults")
    return written(lookup(found, repairs(found).drop("new_nodes"), ["signature"]).drop("signature"), "audits")


def repair(rows: DataFrame) -> DataFrame:
    """``audit`` with the hash of each conversation's repaired text."""
    audits = audit(rows)
    hashed = repaired_hashes(rows, audits.select("conv_id", "audit"))
    # Conversations without an identifier are one row on either side.
    named = hashed.withColumnRenamed("conv_id", "_conv")
    return audits.join(named, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
