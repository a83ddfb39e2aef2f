"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs the labelers.

Candidates are the matches of the base patterns, kept or failed, and of wider ones (secrets,
disguised addresses, titled names). Five labelers vote yes, no or nothing on each: its checks,
a gazetteer, words before it, another candidate near it, and its length. A vote pattern is a
kind with five votes, so there are few of them however large the input: Spark counts them over
all spans, expectation-maximisation over the counts estimates how reliable each labeler is, and
a logistic span classifier is trained on the resulting soft labels. Spans whose pattern the
classifier accepts are added; valid base spans always stay.

Everything that touches a row is a DataFrame expression. Positions are code points: what stands
between matches is split off, and lengths are added up. The patterns are possessive and start
only where a run starts, so they take time in proportion to the text; n spans take n log n steps.

Null text is empty: no spans. Rows without an identifier and repeated rows are read like any
others; other columns are ignored. An empty table gives no rows and no patterns to train on.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tillproof.scale import written

# The base kinds in the order of their listing, then the kinds that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "disguised", "person")
KINDS = BASE_KINDS + ADDED_KINDS
# A whole name in any alphabet with capitals: Müller, O'Brien, McDonald, García-Lorca.
NAME = r"(?:\p{Lu}['’])?+\p{Lu}[\p{Ll}\p{M}]++(?:[-'’]?\p{Lu}[\p{Ll}\p{M}]++)*+(?![\p{L}\p{M}])"
# A part before @ starts at a run's start, or where the match before it ended inside the run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+",
    "disguised": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]++ ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z]{2,24}",
    "person": rf"(?<![\p{{L}}\p{{M}}])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Señora|Señor|Monsieur|Madame)\.? {NAME}(?: {NAME})?",
}
# Words before a span that speak for its kind.
HINTS = {
    "email": "mail|contact|write|@", "ip": "ip|host|server|address", "card": "card|visa|credit|pay|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax", "secret": "pass|pwd|token|secret|key|auth|api", "disguised": "mail|contact|write",
    "person": "name|by|dear|signed"}
# Listings: what the gazetteer knows of each kind.
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$", "ip": r"^(?!0|127\.|255\.|22[4-9]\.|2[34])",
    "card": r"^(?:4|5[1-5]|3[47]|6011|65|35|2[2-7])", "phone": r"^\+(?:1|33|34|44|49|7|8[126]|91)[ ().0-9-]",
    "secret": r"^[0-9a-f]{16,}$", "disguised": r"(?:com|org|net|edu|de|fr|es|uk)$", "person": r"^(?:Dr|Mr|Mrs|Ms|Frau|Herr)"}
VOTES = 5
NEAR = 60
CONTEXT = 24
# Digits of a base kind below which a failed match is not even a candidate.
LEAST_DIGITS = 9
# Letters of a piece of a text that is put together anew.
PIECE = 256
ACCEPT = 0.5
ROUNDS = 50
SPAN = "array<struct<start:int,stop:int,value:string,before:string>>"


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the check sum of a string of digits ends in 0."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n + 1 - i, F.lit(1)).cast("int") * (2 - i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + part(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The checks a match must pass; kinds without any pass."""
    if kind == "ip":
        def small(part: Column) -> Column:
            plain = F.regexp_replace(part, "^0+(?=.)", "")
            return (F.length(plain) <= 3) & (F.left(plain, F.lit(3)).cast("int") <= 255)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        digits = only_digits(value)
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(only_digits(value)).between(9, 15)
    return F.lit(True)


def likely_length(kind: str, value: Column) -> Column:
    n = F.length(value)
    return {"email": n.between(6, 64), "ip": n.between(7, 15), "card": n.between(14, 23), "phone": n.between(10, 20),
            "secret": n.isin(16, 18, 20, 24, 32, 40, 64), "disguised": n.between(10, 64), "person": n.between(5, 40)}[kind]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often the lambdas of ``use`` name it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The join of every element with all before it, in rounds that double what has been joined.

    A round is one transform, so n elements take n log n steps and no array is copied per element.
    """
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")

    def double(state: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(state, lambda x, i: F.when(i < back, x).otherwise(join(F.get(state, i - back), x)))

    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(F.sequence(F.lit(0), rounds - 1), values, double))


def located(found: Column, gaps: Column) -> Column:
    """Positions of all matches: ``gaps`` is what stands before, between and after them."""
    def place(both: Column) -> Column:
        lengths = F.transform(both["found"], lambda v, i: F.length(v) + F.length(F.get(both["gaps"], i)))
        return bound(running(lengths, lambda a, b: a + b), lambda stops: F.transform(both["found"], lambda v, i: F.struct(
            (F.get(stops, i) - F.length(v)).alias("start"), F.get(stops, i).alias("stop"), v.alias("value"),
            F.right(F.get(both["gaps"], i), F.lit(CONTEXT)).alias("before"))))

    return F.when(F.size(found) > 0, bound(F.struct(found.alias("found"), gaps.alias("gaps")), place)).otherwise(F.array().cast(SPAN))


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "+").when(no, "-").otherwise("0")


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _llm_spans: kind, start, stop, base and votes of all candidates.

    A text without a digit skips the patterns that need one, and likewise for @, + and brackets.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn("_llm_text", text).withColumn("_llm_digit", F.col("_llm_text").rlike("[0-9]"))
    text = F.col("_llm_text")
    needs = {"email": text.contains("@"), "phone": F.col("_llm_digit") & text.contains("+"),
             "disguised": text.contains("at)") | text.contains("at]"), "person": text.rlike(r"M[rs]|Dr|Herr|Frau|Señor|Monsieur|Madame")}
    none = F.array().cast("array<string>")
    rows = rows.withColumns({f"_llm_found_{k}": F.when(
        needs.get(k, F.col("_llm_digit")), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS})
    rows = rows.withColumns({f"_llm_gaps_{k}": F.when(
        F.size(f"_llm_found_{k}") > 0, F.split(text, PATTERNS[k], -1)).otherwise(none) for k in KINDS})
    rows = rows.withColumns({f"_llm_at_{k}": located(F.col(f"_llm_found_{k}"), F.col(f"_llm_gaps_{k}")) for k in KINDS})

    def judged(kind: str) -> Column:
        def one(s: Column) -> Column:
            value, before = s["value"], F.lower(s["before"])
            passes = valid(kind, value)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind_no"), s["start"].alias("start"), s["stop"].alias("stop"),
                (passes if kind in BASE_KINDS else F.lit(False)).alias("base"),
                F.concat(
                    vote(passes & F.lit(kind in BASE_KINDS), ~passes),
                    vote(value.rlike(GAZETTEER[kind]), F.lit(kind in BASE_KINDS)),
                    vote(before.rlike(HINTS[kind]), F.lit(False)),
                    vote(likely_length(kind, value), F.lit(True))).alias("votes"),
                F.length(only_digits(value)).alias("digits"))
        found = F.transform(F.col(f"_llm_at_{kind}"), one)
        return F.filter(found, lambda s: s["base"] | (s["digits"] >= LEAST_DIGITS)) if kind in BASE_KINDS else found

    rows = rows.withColumn("_llm_all", F.concat(*[judged(k) for k in KINDS]))
    # The last vote: personal data tends to stand together. The nearest start is that before or after
    # in order of the starts.
    ordered = F.array_sort(F.transform("_llm_all", lambda s: F.struct(
        s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["stop"].alias("stop"), s["base"].alias("base"), s["votes"].alias("votes"))))

    def company(spans: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            before = s["start"] - F.get(spans, i - 1)["start"]
            after = F.get(spans, i + 1)["start"] - s["start"]
            near = F.coalesce(before <= NEAR, F.lit(False)) | F.coalesce(after <= NEAR, F.lit(False))
            return F.struct(s["kind_no"].alias("kind_no"), s["start"].alias("start"), s["stop"].alias("stop"), s["base"].alias("base"),
                            F.concat(s["votes"], vote(near, F.lit(False))).alias("votes"))
        return F.array_sort(F.transform(spans, one))

    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(bound(ordered, company), lambda s: F.struct(
        F.get(names, s["kind_no"]).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["base"].alias("base"), s["votes"].alias("votes")))
    return rows.withColumn("_llm_spans", spans).select(*docs.columns, "_llm_spans")


def em(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """The chance of each vote pattern to be personal data, labelers being independent given the truth."""
    if not counts:
        return {}
    # The start is the majority of the votes.
    belief = {p: (1.0 + p[1].count("+")) / (2.0 + p[1].count("+") + p[1].count("-")) for p in counts}
    for _ in range(ROUNDS):
        prior, rate = {}, {}
        for kind in {p[0] for p in counts}:
            own = [p for p in counts if p[0] == kind]
            prior[kind] = (1 + sum(counts[p] * belief[p] for p in own)) / (2 + sum(counts[p] for p in own))
        for truth in (0, 1):
            weight = {p: counts[p] * (belief[p] if truth else 1 - belief[p]) for p in counts}
            total = sum(weight.values())
            for i in range(VOTES):
                for v in "+-0":
                    # A labeler is trusted to be right more often than not at the start of the count.
                    lean = 3.0 if v == ("+" if truth else "-") else 1.0
                    rate[truth, i, v] = (lean + sum(w for p, w in weight.items() if p[1][i] == v)) / (5.0 + total)
        for p in counts:
            odds = math.log(prior[p[0]] / (1 - prior[p[0]])) + sum(
                math.log(rate[1, i, v] / rate[0, i, v]) for i, v in enumerate(p[1]))
            belief[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief


def features(pattern: tuple[str, str]) -> list[float]:
    kind, votes = pattern
    return ([1.0] + [float(kind == k) for k in KINDS] + [float(v == "+") for v in votes] + [float(v == "-") for v in votes])


def classifier(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """A logistic model of the vote patterns, trained on the soft labels that EM gives them."""
    belief = em(counts)
    rows = [(features(p), math.log1p(counts[p]), belief[p]) for p in sorted(counts)]
    weights = [0.0] * len(features(("", "0" * VOTES)))

    def chance(x: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x))))))

    total = sum(w for _, w, _ in rows) or 1.0
    for _ in range(300):
        slope = [0.0] * len(weights)
        for x, w, y in rows:
            error = w * (y - chance(x))
            for i, value in enumerate(x):
                slope[i] += error * value
        weights = [b + 2.0 * s / total - 0.002 * b for b, s in zip(weights, slope)]
    return {p: chance(features(p)) for p in counts}


def train(spans: DataFrame) -> list[str]:
    """Accepted patterns ("kind votes") from all candidates of ``spans`` (_llm_spans).

    There are at most as many patterns as kinds times 3^VOTES, and that many rows are collected.
    """
    pattern = spans.select(F.explode("_llm_spans").alias("s")).groupBy("s.kind", "s.votes").count()
    model = classifier({(r["kind"], r["votes"]): r["count"] for r in pattern.collect()})
    return sorted(f"{kind} {votes}" for (kind, votes), p in model.items() if p >= ACCEPT)


def kept(spans: Column, accepted: list[str]) -> Column:
    """Valid base spans and accepted ones, by kind as listed, then start."""
    def stays(s: Column) -> Column:
        # A failed match of a base kind was ruled out by its own check and is not a span.
        added = ~s["kind"].isin(*BASE_KINDS) & F.concat_ws(" ", s["kind"], s["votes"]).isin(*accepted)
        return s["base"] | (added if accepted else F.lit(False))
    # Kinds are already in the order of the listing, and each is in order of its starts.
    return F.filter(spans, stays)


def part(pieces: Column, start: Column, stop: Column) -> Column:
    """What stands from ``start`` up to ``stop`` in a text cut into pieces of PIECE letters.

    A long text is not read from its start for each part of it.
    """
    first = F.floor(start / PIECE).cast("int")
    count = F.ceil(stop / PIECE).cast("int") - first
    return F.when(stop > start, F.substring(F.array_join(F.slice(pieces, first + 1, count), ""), start % PIECE + 1, stop - start)).otherwise("")


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(with_candidates(source).drop("text"), "candidates")
    spans = kept(F.col("_llm_spans"), train(found))
    base = F.filter("_llm_spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listing(base).cast("binary"), 256).alias("base_sha256"), listing(spans).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, overlapping ones by the first.

    Candidates are found twice, once to count patterns and once to replace, so that texts need
    not be written or joined; those to count are written alone. A null text stays null.
    """
    accepted = train(written(with_candidates(docs.select(text_col), text_col).select("_llm_spans"), "candidates"))
    spans = with_candidates(docs, text_col)
    chosen = F.array_sort(F.transform(kept(F.col("_llm_spans"), accepted), lambda s: F.struct(
        s["start"].alias("start"), (-s["stop"]).alias("back"), s["kind"].alias("kind"))))
    text = F.col(text_col)

    def hidden(own: Column) -> Column:
        # How far the spans up to each one reach; one that starts before that is hidden with them.
        reach = running(F.transform(own["spans"], lambda s: -s["back"]), lambda a, b: F.greatest(a, b))

        def parts(reach: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                at = F.coalesce(F.get(reach, i - 1), F.lit(0))
                return F.when(s["start"] >= at, F.concat(
                    part(own["pieces"], at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
            return F.concat(F.array_join(F.transform(own["spans"], one), ""), part(
                own["pieces"], F.element_at(reach, -1), PIECE * F.size(own["pieces"])))
        return bound(reach, parts)

    cleaned = bound(F.struct(F.col("_llm_chosen").alias("spans"), F.regexp_extract_all(
        text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces")), hidden)
    return spans.withColumn("_llm_chosen", chosen).withColumn(
        text_col, F.when(F.size("_llm_chosen") > 0, cleaned).otherwise(text)).select(*docs.columns)
