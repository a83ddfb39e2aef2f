"""Chat formatting with a grammar round trip.

A turn is rendered as ``### role :`` and a line end, the text, a line end and ``</turn>`` with a
line end. A deterministic parser cuts a rendered conversation at the turn ends, takes the role
up to the first free colon and undoes escapes. What it recovers is compared with the source: a
turn that comes back different is rendered again with its control strings escaped, and a
conversation that still differs is escaped throughout. The result is read back and compared
once more; a mismatch stops the job.

An escape is one more backslash before a control string, with however many stand there already,
so escaping can be undone and the parser knows a control string by the missing backslash. The
template puts a space or a line end, never a backslash, before its own control strings.

Everything is a DataFrame expression. A conversation is one row of the result, so its turns
meet in one row; nothing larger is gathered. Turns are ordered by turn, then role and text, so
ties have a defined order; nulls come first. A null text or role is empty. Rows without a
conversation identifier form one conversation. Repeated rows are repeated turns. An empty table
gives the conversations added by the caller only. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HEAD, END = "### ", "</turn>"
# Fixed value: the role whose text is under the loss mask.
LEARNT = "assistant"
# Control strings with the backslashes before them.
# A run of backslashes is met at its start only, so a long one costs no more than its length.
IN_TEXT = r"(?<!\\)(\\*+)(### |</turn>)"
IN_ROLE = r"(?<!\\)(\\*+)(### |</turn>|:)"
ESCAPED_TEXT = r"(?<!\\)\\(\\*+)(### |</turn>)"
ESCAPED_ROLE = r"(?<!\\)\\(\\*+)(### |</turn>|:)"


def escape(value: Column, pattern: str) -> Column:
    return F.regexp_replace(value, pattern, r"\\$1$2")


def unescape(value: Column, pattern: str) -> Column:
    return F.regexp_replace(value, pattern, "$1$2")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(" :\n"), text, F.lit("\n" + END + "\n"))


def pieces(rendered: Column) -> Column:
    """The turns of a rendered conversation without their ends; free text after the last one counts."""
    cut = F.split(rendered, r"(?<!\\)" + END + "\n", -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def read_turn(piece: Column) -> Column:
    """role and text of one turn; what does not follow the grammar comes back as null."""
    head = F.regexp_extract(piece, r"(?s)^### (.*?) (?<!\\):\n", 1)
    body = F.regexp_replace(piece, r"(?s)^### .*? (?<!\\):\n", "")
    fits = piece.rlike(r"(?s)^### .*? (?<!\\):\n") & piece.endswith("\n")
    return F.when(fits, F.struct(
        unescape(head, ESCAPED_ROLE).alias("role"),
        unescape(F.left(body, F.length(body) - 1), ESCAPED_TEXT).alias("text")))


def parse(rendered: Column) -> Column:
    return F.transform(pieces(rendered), read_turn)


def same(found: Column, turns: Column) -> Column:
    """True if the parsed turns are exactly the source turns."""
    plain = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return F.coalesce(found == plain, F.lit(False))


def format_turn(turn: Column) -> Column:
    """A turn as it is if it survives the round trip, else with its control strings escaped."""
    free = render(turn["role"], turn["text"])
    safe = render(escape(turn["role"], IN_ROLE), escape(turn["text"], IN_TEXT))
    conflict = turn["role"].rlike(IN_ROLE) | turn["text"].rlike(IN_TEXT)
    # A turn without any control string cannot conflict, so most turns are not parsed twice.
    return F.when(conflict & ~same(parse(free), F.array(turn)), safe).otherwise(free)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns (role, text in order) and formatted: the rendered conversation."""
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("turn"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    drawn = whole.withColumn("formatted", F.array_join(F.transform("turns", format_turn), ""))
    all_safe = F.array_join(F.transform("turns", lambda t: render(
        escape(t["role"], IN_ROLE), escape(t["text"], IN_TEXT))), "")
    return drawn.withColumn("formatted", F.when(same(parse(F.col("formatted")), F.col("turns")), F.col("formatted")).otherwise(all_safe))


def digest(formatted: DataFrame) -> DataFrame:
    """What the contract asks for, read back from the rendered text alone."""
    read = formatted.withColumn("found", parse(F.col("formatted")))
    checked = read.withColumn("found", F.when(same(F.col("found"), F.col("turns")), F.col("found")).otherwise(
        F.raise_error(F.concat(F.lit("conversation differs after its round trip: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))))
    learnt = F.array_join(F.transform(F.filter("found", lambda t: t["role"] == LEARNT), lambda t: t["text"]), "")
    said = F.array_join(F.transform("found", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return checked.select(
        "conv_id", F.size("found").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def loss_spans(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted and spans: code-point intervals of the rendered text under the loss mask."""
    starts = F.aggregate(
        pieces(F.col("formatted")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p) + len(END) + 1).alias("at"),
            F.when(read_turn(p)["role"] == LEARNT, F.concat(s["spans"], F.array(F.struct(
                (s["at"] + F.length(p) - F.length(F.regexp_replace(p, r"(?s)^### .*? (?<!\\):\n", ""))).alias("start"),
                (s["at"] + F.length(p) - 1).alias("stop"))))).otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    return formatted.select("conv_id", "formatted", starts.alias("spans"))


def added_rows(spark: SparkSession, conv_id: int, turns: list[tuple[str, str]]) -> DataFrame:
    rows = [spark.range(1).select(
        F.lit(conv_id).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"),
        F.lit(role).alias("role"), F.lit(text).alias("text")) for n, (role, text) in enumerate(turns)]
    return reduce(DataFrame.unionByName, rows)
