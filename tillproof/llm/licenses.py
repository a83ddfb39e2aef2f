"""License scans with ordered signature rules.

A text is reduced to its words (lower-cased runs of digits, a to z and characters beyond ASCII)
joined by single spaces, so a rule sees neither line ends nor punctuation. An Aho-Corasick pass
over that form finds keywords, inside longer words too if a name may run on (gplv3, freebsd); only
rules whose keyword occurs are run, and every match of a rule contains its keyword. Each detection is an
interval of words with a label, a priority and a confidence. A detection inside a longer or
equal one of at least its priority is suppressed, and of two that overlap the one with the
higher priority stays.

Besides, three base phrases are counted at all their places, overlapping ones too; their labels
always stay.

Null text is empty: no words, no places, empty label lists, score zero. Rows without an
identifier and repeated rows are scanned like any others; other columns are ignored. Texts of
any length are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillproof.llm.common import map_batches, raw_texts

# The base phrases and their labels.
BASE_PHRASES = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}

# Word characters are kept, capitals lower-cased; all other ASCII parts words.
SPACED = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


# Label, keyword, the name as a pattern over words.
FAMILIES = (
    ("mit", "mit", r"mit"),
    ("mit-0", "mit no attribution", r"mit no attribution"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl ?v? ?1(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?v? ?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?v? ?3(?: 0)?"),
    ("gpl-2.0", "general public license", r"(?:gnu )?general public license(?: as published by the free software foundation(?: either)?)?(?: version| v)? ?2(?: 0)?"),
    ("gpl-3.0", "general public license", r"(?:gnu )?general public license(?: as published by the free software foundation(?: either)?)?(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2.1", "lesser general public", r"(?:gnu )?lesser general public license(?: version| v)? ?2 1"),
    ("lgpl-3.0", "lesser general public", r"(?:gnu )?lesser general public license(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?v? ?2 1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl ?v? ?3(?: 0)?"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl ?v? ?3(?: 0)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?"),
    ("gfdl-1.3", "free documentation license", r"(?:gnu )?free documentation license(?: version)? ?1 3"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd ?2(?: clause)?|2 clause bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd ?3(?: clause)?|3 clause bsd)"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd ?4(?: clause)?|4 clause bsd)"),
    ("isc", "isc", r"isc"),
    ("mpl-1.1", "mpl", r"mpl ?1 1"),
    ("mpl-2.0", "mpl", r"mpl ?2(?: 0)?"),
    ("mpl-2.0", "mozilla public", r"mozilla public license(?: version| v)? ?2(?: 0)?"),
    ("epl-1.0", "eclipse public", r"eclipse public license(?: version| v)? ?1(?: 0)?"),
    ("epl-2.0", "eclipse public", r"eclipse public license(?: version| v)? ?2(?: 0)?"),
    ("cddl-1.0", "cddl", r"cddl(?: version)? ?1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic license(?: version)? ?2(?: 0)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("bsl-1.0", "boost software", r"boost software license(?: version)?(?: 1 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "attribution sharealike", r"(?:creative commons )?attribution sharealike(?: [1-4] [05])?"),
    ("cc-by-nc", "attribution noncommercial", r"(?:creative commons )?attribution noncommercial(?: [1-4] [05])?"),
    ("cc-by", "creative commons attribution", r"creative commons attribution(?: [1-4] [05])?"),
    ("odbl-1.0", "open database license", r"open database license(?: 1 0)?"),
    ("ofl-1.1", "open font license", r"(?:sil )?open font license(?: version)?(?: 1 1)?"),
    ("upl-1.0", "universal permissive", r"universal permissive license"),
    ("elastic-2.0", "elastic license", r"elastic license(?: 2 0)?"),
    ("sspl-1.0", "server side public", r"server side public license"),
    ("proprietary", "proprietary", r"proprietary(?: and confidential)?"),
)
# Each family yields one rule per template: (pattern around the name, priority, confidence).
# A template of higher priority says more surely that the name is a grant.
TEMPLATES = (
    (r"spdx license identifier {name}", 90, 0.99),
    (r"(?:released|licensed|distributed|published|available|provided)(?: to you)? under (?:the )?(?:terms of )?(?:the )?{name}(?: license)?", 80, 0.95),
    (r"(?:subject to|in accordance with|pursuant to|governed by) (?:the )?(?:terms of )?(?:the )?{name}(?: license)?", 70, 0.9),
    (r"licen[sc]e (?:is )?{name}", 60, 0.85),
    (r"{name} licen[sc]ed?", 50, 0.8),
)
# What may follow a name with its version that stands alone.
ALONE = r"(?: only| or later| or any later version| plus)?"
# Phrases of licence texts and notices.
PHRASES = (
    ("mit", "permission is hereby granted free of charge", 85, 0.95),
    ("bsd", "redistribution and use in source and binary forms", 85, 0.95),
    ("isc", "permission to use copy modify and or distribute this software", 85, 0.95),
    ("warranty-disclaimer", "without warranty of any kind", 30, 0.6),
    ("warranty-disclaimer", "provided as is without", 30, 0.6),
    ("public-domain", "released into the public domain", 60, 0.85),
    ("public-domain", "dedicated to the public domain", 60, 0.85),
    ("gpl", "general public license", 40, 0.8),
    ("reserved", "all rights reserved", 40, 0.8),
    ("proprietary", "unauthorized copying", 60, 0.8),
    ("proprietary", "may not be reproduced", 50, 0.7),
)


def rules() -> list[Rule]:
    """Every family in every template, then phrases and the copyright notice; first is strongest."""
    made = [Rule(label, keyword, frame.replace("{name}", f"(?:{name})"), priority, confidence)
            for label, keyword, name in FAMILIES for frame, priority, confidence in TEMPLATES]
    # A name with its version stands for itself; one that is also a system's name does not.
    made += [Rule(label, keyword, f"(?:{name}){ALONE}", 45, 0.75) for label, keyword, name in FAMILIES if re.search("[0-9]", name) and "freebsd" not in name]
    made += [Rule(label, words, words, priority, confidence) for label, words, priority, confidence in PHRASES]
    made.append(Rule("copyright", "copyright", r"copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?", 20, 0.7))
    # Longer patterns first among equals, so the order of detections is defined.
    return sorted(made, key=lambda r: (-r.priority, -len(r.pattern), r.label, r.pattern))


def blank_places(spaced: bytes) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(spaced, np.uint8) == 32)


class Scanner:
    def __init__(self) -> None:
        self.rules = [(r, re.compile(f"(?<= )(?:{r.pattern})(?= )")) for r in rules()]
        self.gates = ahocorasick.Automaton()
        by_keyword: dict[str, list[int]] = {}
        for n, (rule, _) in enumerate(self.rules):
            # With a space that may be missing, the keyword need not stand alone.
            gate = rule.keyword if " ?" in rule.pattern else f" {rule.keyword} "
            by_keyword.setdefault(gate, []).append(n)
        for keyword, members in by_keyword.items():
            self.gates.add_word(keyword, members)
        self.gates.make_automaton()

    def detections(self, spaced: str) -> list[tuple[int, int, Rule]]:
        """Kept detections as word intervals (end exclusive) of a text with a space at both ends."""
        wanted = {n for _, members in self.gates.iter(spaced) for n in members}
        found = [(m.start(), m.end(), n) for n in sorted(wanted) for m in self.rules[n][1].finditer(spaced)]
        kept: list[tuple[int, int, int]] = []
        # Stronger first, then longer; what overlaps something kept before it is suppressed.
        # A weaker interval that contains a kept one says nothing of its own and goes as well.
        # Kept intervals are disjoint and in order, so only the neighbours can overlap.
        for start, end, n in sorted(found, key=lambda d: (-self.rules[d[2]][0].priority, d[0] - d[1], d[0], d[2])):
            at = bisect_left(kept, (start,))
            if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or end <= kept[at][0]):
                kept.insert(at, (start, end, n))
        if not kept:
            return []
        blanks = blank_places(spaced.encode("latin-1"))
        first, end = (np.searchsorted(blanks, [k[at] for k in kept]).tolist() for at in (0, 1))
        return [(a - 1, b, self.rules[n][0]) for a, b, (_, _, n) in zip(first, end, kept)]

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = text.translate(SPACED).split()
        spaced = b" " + b" ".join(words) + b" "
        starts: list[int] = []
        base: set[str] = set()
        for phrase, label in BASE_PHRASES.items():
            at = spaced.find(b" " + phrase + b" ")
            while at >= 0:
                starts.append(at)
                base.add(label)
                at = spaced.find(b" " + phrase + b" ", at + 1)
        # The number of a word is that of the spaces before it, found in one pass over the text.
        places = np.searchsorted(blank_places(spaced), starts).tolist() if starts else []
        # Bytes beyond ASCII become one character each, which no rule contains.
        kept = self.detections(spaced.decode("latin-1"))
        doubt = 1.0
        for _, _, rule in kept:
            doubt *= 1 - rule.confidence
        labels = base | {rule.label for _, _, rule in kept}
        score = max(1 - doubt, 0.5 if base else 0.0)
        return (len(words), len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), score)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def make():
        scanner = Scanner()

        def work(batch):
            columns = list(zip(*[scanner.scan(t) for t in raw_texts(batch, "text")])) or [()] * len(kinds)
            return pa.record_batch(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)
        return work

    return map_batches(source, make, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                     "base_labels string, labels string, score double")
