"""Toxicity by a learnt lexicon, Levenshtein automata over its trie, and context windows.

Training takes a bounded sample of labelled rows (SAMPLE per class, lowest hash first). The
lexicon holds prefixes of words that toxic texts contain and clean ones do not, so that
inflected forms share one stem; words that only copies of one text share are told apart by
the other words that go along. A text is searched for words that begin with a term, and for
words that begin with something within one edit of a whole term: an automaton row is carried down
the trie, and branches that can no longer match are left at once. Spellings seen in clean texts are not misspellings.

Every hit has a context: quoted or reported if quotation marks enclose it or a reporting word
precedes it within the window, else plain. How far a hit of each context counts is estimated
from the sample, with a prior that trusts plain hits more.

Null and empty texts, and texts without a hit, get the share of toxic texts among sampled texts
without a hit. Without labelled toxic texts there are no terms and every text gets that score.
Rows without an identifier are never trained on, and are not held out. Repeated rows are scored
alike; repeated labels of one document count as toxic if any is. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillproof.llm.common import held_out, map_batches
from tillproof.scale import written

# Most labelled rows of either class that training reads.
SAMPLE = 10_000
# A term must occur in so many sampled toxic texts, and in this share of them.
LEAST_TEXTS, LEAST_SHARE = 3, 0.003
# A term's share of toxic texts must exceed its share of clean texts by this factor.
LEAST_LIFT = 50.0
SHORTEST, LONGEST = 4, 12
# At most so many terms may be there by luck; so many terms that go along betray a copied text.
LUCK, COPIED = 0.0001, 5
# Only terms of this length are searched with an edit; shorter ones have too many neighbours.
FUZZY_LENGTH = 5
# And with an edit and any ending only terms of this length.
INFLECTED_LENGTH = 6
WINDOW = 5
THRESHOLD = 0.3
PLAIN, QUOTED = 0, 1
PRIOR = {PLAIN: (98.0, 100.0), QUOTED: (6.0, 10.0)}
MISSPELT = 0.9
WORD = re.compile(r"[^\W_]+")
# Marks that may close what a mark opens, and words that show report.
CLOSED_BY = {'"': '"', "'": "'", "“": "”", "”": "”", "„": "“”", "‘": "’", "’": "’", "‚": "‘’", "«": "»", "»": "«", "‹": "›", "›": "‹"}
QUOTE = re.compile(f"[{''.join(CLOSED_BY)}]")
REPORTING = frozenset("said says saying called calls calling wrote writes quoted quote quotes word term".split())


def marks(text: str, low: int, high: int) -> Iterator[tuple[str, bool]]:
    """(mark, opens) of the quotation marks from ``low`` to ``high``: a mark opens before a character if
    no letter stands before it, and closes after a character. Between letters it is an apostrophe."""
    for found in QUOTE.finditer(text, low, high):
        before, after = text[max(0, found.start() - 1):found.start()] or " ", text[found.end():found.end() + 1] or " "
        if before.isalnum() and after.isalnum():
            continue
        if not before.isalnum() and not after.isspace():
            yield found.group(), True
        elif not before.isspace():
            yield found.group(), False


def in_quotes(text: str, low: int, start: int, end: int, high: int) -> bool:
    """Whether a mark that is open at ``start``, opened after ``low``, is closed by its like before ``high``."""
    opened = None
    for mark, opens in marks(text, low, start):
        opened = mark if opens else None
    return opened is not None and any(not opens and mark in CLOSED_BY[opened] for mark, opens in marks(text, end, high))


@dataclass
class Model:
    """Terms with the share of toxic among texts that hold them, and what contexts are worth."""

    terms: dict[str, float] = field(default_factory=dict)
    base: float = 0.0
    contexts: dict[int, float] = field(default_factory=lambda: {k: a / n for k, (a, n) in PRIOR.items()})
    innocent: frozenset[str] = frozenset()


class Matcher:
    """Finds the term of a word: a prefix of it, or within one edit of a prefix of it."""

    def __init__(self, terms: dict[str, float], innocent: frozenset[str], room: int = 200_000):
        self.trie: dict = {}
        for term in terms:
            node = self.trie
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = term
        self.innocent, self.room = innocent, room
        self.seen: set[str] = set()
        self.found: dict[str, tuple[str, bool]] = {}
        # One edit leaves the first or the second half of a term as it is, the second half moved by
        # one place at most: by length, the halves that a word may begin with, and by place and
        # length, those that it may hold there.
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[tuple[int, int], set[str]] = {}
        for term in (t for t in terms if len(t) >= FUZZY_LENGTH):
            half = len(term) // 2
            self.heads.setdefault(half, set()).add(term[:half])
            for at in (half - 1, half, half + 1):
                self.tails.setdefault((at, len(term) - half), set()).add(term[half:])

    def match(self, words: set[str]) -> set[str]:
        """The words that match a term; ``found`` then has (term, misspelt) of each.

        Words seen before are not searched again; a bounded number of them is remembered.
        """
        if len(self.seen) > self.room:
            self.seen.clear()
            self.found.clear()
        new = words - self.seen
        self.seen |= new
        for word in new:
            hit = self._search(word)
            if hit is not None:
                self.found[word] = hit
        return words & self.found.keys()

    def _search(self, word: str) -> tuple[str, bool] | None:
        node, best = self.trie, None
        for letter in word:
            node = node.get(letter)
            if node is None:
                break
            best = node.get("", best)
        if best is not None:
            return best, False
        if word in self.innocent:
            return None
        if not any(word[:n] in own for n, own in self.heads.items()) and not any(
                word[at:at + n] in own for (at, n), own in self.tails.items()):
            return None
        # No prefix longer than the longest term and one letter more can be within an edit of one.
        word = word[:LONGEST + 1]
        term = self._within_one(self.trie, word, list(range(len(word) + 1)), False)
        return None if term is None else (term, True)

    def _within_one(self, node: dict, word: str, row: list[int], ends_alike: bool) -> str | None:
        """The first term, in letter order, whose automaton accepts the word, or a prefix of it if the
        term may be inflected. ``row`` has the edits to each prefix. An ending may follow only where the
        term's own last letter stands (``ends_alike``), or it would make up for a missing letter."""
        term = node.get("")
        if term is not None and (
                len(term) >= FUZZY_LENGTH and row[-1] <= 1 or len(term) >= INFLECTED_LENGTH and ends_alike):
            return term
        for letter in sorted(k for k in node if k):
            after = [row[0] + 1]
            alike = False
            for i, own in enumerate(word):
                after.append(min(after[i] + 1, row[i + 1] + 1, row[i] + (own != letter)))
                alike |= own == letter and row[i] <= 1
            if min(after) <= 1:
                found = self._within_one(node[letter], word, after, alike)
                if found is not None:
                    return found
        return None

    def hits(self, text: str) -> list[tuple[str, str, bool, int]]:
        """(word, term, misspelt, context) of every word of ``text`` that matches."""
        low = text.lower()
        if not self.match(set(WORD.findall(low))):
            return []
        out, spans = [], list(WORD.finditer(low))
        for n, span in enumerate(spans):
            hit = self.found.get(span.group())
            if hit is not None:
                first, last = spans[max(0, n - WINDOW)], spans[min(len(spans) - 1, n + WINDOW)]
                enclosed = in_quotes(low, max(0, first.start() - 1), span.start(), span.end(), last.end() + 3)
                reported = any(s.group() in REPORTING for s in spans[max(0, n - WINDOW):n])
                out.append((span.group(), *hit, QUOTED if enclosed or reported else PLAIN))
        return out


def prefixes(text: str) -> set[str]:
    return {w[:n] for w in set(WORD.findall(text.lower())) for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def sample_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(toxic, text) of at most ``most`` labelled rows of each class, never held-out ones."""
    own = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").alias("_llm_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = (F.xxhash64("_llm_id"), F.col("_llm_id"))
    chosen = written(own.filter("toxic = 1").orderBy(*order).limit(most).unionByName(
        own.filter("toxic = 0").orderBy(*order).limit(most)), "chosen")
    # At most twice SAMPLE pairs of numbers, whatever the input.
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return written(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_llm_id")).select("toxic", "text"), "labelled")


def count_prefixes(rows: DataFrame, among: set[str] | None) -> DataFrame:
    """(term, n): in how many texts each prefix occurs; ``among`` keeps only those prefixes."""

    def run(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = prefixes(text)
                counts.update(own if among is None else own & among)
        yield pa.record_batch({"term": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def choose(texts: list[set[int]], terms: list[str], clean: list[int], chance: float) -> list[int]:
    """Terms whose share of toxic texts is neither luck nor the work of copies.

    ``texts`` are the candidate terms of each toxic text. With ``chance`` the share of toxic
    texts in the sample, a term of n toxic texts and no others comes about by luck in chance^n
    of all terms; that must leave under LUCK false terms. ``clean`` counts clean texts. A term is a copy's if COPIED or more
    unrelated terms occur in much the same texts. A longer form that covers the texts
    nearly as well, or meets fewer clean ones, replaces it; longer forms of it are left out.
    """
    holders: dict[int, set[int]] = {}
    for n, own in enumerate(texts):
        for t in own:
            holders.setdefault(t, set()).add(n)
    needed = max(LEAST_TEXTS, math.ceil(math.log(LUCK / max(1, len(holders))) / math.log(min(0.9, max(chance, 1e-6)))))
    longer: dict[str, list[int]] = {}
    for t in holders:
        longer.setdefault(terms[t][:-1], []).append(t)
    chosen: list[int] = []
    stems: set[str] = set()
    for t in sorted(holders, key=lambda t: (-len(holders[t]), -len(terms[t]), terms[t])):
        if len(holders[t]) < needed:
            break
        if any(terms[t][:n] in stems for n in range(SHORTEST, len(terms[t]) + 1)):
            continue
        together = Counter(u for n in holders[t] for u in texts[n])
        beside = {terms[u][:SHORTEST] for u, n in together.items()
                  if n >= 0.6 * (len(holders[t]) + len(holders[u]) - n)} - {terms[t][:SHORTEST]}
        if len(beside) >= COPIED:
            continue
        while more := [u for u in longer.get(terms[t], ())
                       if len(holders[u]) >= (0.95 if clean[u] == clean[t] else 0.8) * len(holders[t])]:
            t = max(more, key=lambda u: (len(holders[u]), terms[u]))
        chosen.append(t)
        stems.add(terms[t])
    return chosen


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    rows = sample_rows(docs, labels, most)
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    model = Model(base=toxic / (toxic + clean) if toxic + clean else 0.0)
    if not toxic:
        return model
    bad, good = rows.filter("toxic = 1"), rows.filter("toxic = 0")
    least = max(LEAST_TEXTS, round(LEAST_SHARE * toxic))
    # What is collected is bounded by the sample: terms of its texts, and its texts' terms.
    n_bad = {r.term: r.n for r in count_prefixes(bad, None).filter(F.col("n") >= least).collect()}
    n_good = {r.term: r.n for r in count_prefixes(good, set(n_bad)).collect()}
    terms = sorted(t for t, n in n_bad.items() if n / toxic >= LEAST_LIFT * (n_good.get(t, 0) + 0.5) / (clean + 0.5))
    place = {t: i for i, t in enumerate(terms)}

    def held(batches):
        for batch in batches:
            own = [sorted(place[t] for t in prefixes(x) if t in place) for x in batch.column(0).to_pylist()]
            yield pa.record_batch({"terms": pa.array(own, pa.list_(pa.int32()))})

    texts = [set(r.terms) for r in bad.select("text").mapInArrow(held, "terms array<int>").collect()]
    counts = [n_good.get(t, 0) for t in terms]
    for at in choose(texts, terms, counts, toxic / (toxic + clean)):
        n = n_bad[terms[at]]
        model.terms[terms[at]] = (n + 0.5) / (n + counts[at] * toxic / max(1, clean) + 1.0)
    return weigh_contexts(rows, model, toxic, clean)


def weigh_contexts(rows: DataFrame, model: Model, toxic: int, clean: int) -> Model:
    """Count, in the sample, what hits of each context and misspelt words go with."""
    terms = model.terms

    def run(batches):
        matcher = Matcher(terms, frozenset())
        counts: Counter[tuple] = Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = matcher.hits(text)
                counts[("context", "", -1 if not hits else min(h[3] for h in hits), label)] += 1
                counts.update({("word", h[0], 0, label) for h in hits if h[2]})
        keys = list(counts)
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
        names = ["kind", "word", "context", "toxic"]
        yield pa.record_batch(
            [*[pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds)], pa.array([counts[k] for k in keys], pa.int64())],
            names=[*names, "n"])

    found = rows.select("toxic", "text").mapInArrow(run, "kind string, word string, context int, toxic int, n long")
    n = {(r.kind, r.word, r.context, r.toxic): r.n
         for r in found.groupBy("kind", "word", "context", "toxic").agg(F.sum("n").alias("n")).collect()}
    misspelt = {k[1] for k in n if k[0] == "word"}
    model.innocent = frozenset(
        w for w in misspelt if n.get(("word", w, 0, 0), 0) * toxic * LEAST_LIFT > n.get(("word", w, 0, 1), 0) * clean)
    for context, (a, total) in PRIOR.items():
        yes, no = (n.get(("context", "", context, label), 0) for label in (1, 0))
        # Clean texts count as often as they would beside as many toxic ones.
        model.contexts[context] = (yes + a) / (yes + no * toxic / max(1, clean) + total)
    yes, no = (n.get(("context", "", -1, label), 0) for label in (1, 0))
    model.base = (yes + 0.5) / (yes + no + 1.0)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, hits, quoted_hits of every row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def make():
        matcher = Matcher(model.terms, model.innocent)

        def judge(text: str) -> tuple[float, int, int]:
            hits = matcher.hits(text)
            doubt = 1 - model.base
            for _, term, misspelt, context in hits:
                doubt *= 1 - model.terms[term] * model.contexts[context] * (MISSPELT if misspelt else 1.0)
            return min(1.0, max(0.0, 1 - doubt)), len(hits), sum(h[3] == QUOTED for h in hits)

        def work(batch):
            out = list(zip(*[judge(t) for t in batch.column(1).to_pylist()])) or [(), (), ()]
            return pa.record_batch({
                "doc_id": batch.column(0), "score": pa.array(out[0], pa.float64()), "hits": pa.array(out[1], pa.int64()),
                "quoted_hits": pa.array(out[2], pa.int64())})
        return work

    judged = map_batches(source, make, "doc_id long, score double, hits long, quoted_hits long")
    return judged.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits", "quoted_hits")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
