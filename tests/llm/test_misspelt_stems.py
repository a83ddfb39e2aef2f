"""Misspelt inflected forms of lexicon stems, against edit distances by the full table."""

import random

from tillproof.llm import toxicity as T

TERMS = {"stupid": 0.9, "worthless": 0.9, "contemptible": 0.9, "idiot": 0.9, "fool": 0.9}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        after = [i + 1]
        for j, y in enumerate(b):
            after.append(min(after[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = after
    return row[-1]


def brute(word):
    if any(word.startswith(t) for t in TERMS):
        return True
    if any(distance(t, word) <= 1 for t in TERMS if len(t) >= T.FUZZY_LENGTH):
        return True
    # An ending follows the term's own last letter.
    return any(word[n] == t[-1] and distance(t[:-1], word[:n]) <= 1 for t in TERMS if len(t) >= T.INFLECTED_LENGTH
               for n in range(len(word)))


def test_misspelt_inflected_forms_match():
    matcher = T.Matcher(TERMS, frozenset({"stupor"}))
    words = {"stupdity", "stuupidity", "stxpidly", "wortlessness", "worthlesness", "contemptably", "contmptibleness", "idoit", "idjotically"}
    assert {w for w in words if brute(w)} == matcher.match(words) >= words - {"idoit", "contemptably", "idjotically"}
    assert matcher.found["stupdity"] == ("stupid", True) and matcher.found.get("stupor") is None
    rng = random.Random(3)
    made = set()
    for _ in range(4000):
        word = list(rng.choice(list(TERMS)) + rng.choice(("", "s", "ness", "nesses", "ically")))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word))
            word[at:at + rng.randrange(2)] = rng.choice(("", "x", "e", "st"))
            word = word or ["x"]
        made.add("".join(word))
    made -= {"", "stupor"}
    assert T.Matcher(TERMS, frozenset()).match(made) == {w for w in made if brute(w)}


def test_quotation_marks_and_apostrophes():
    matcher = T.Matcher({"grotty": 0.9, "stupid": 0.9}, frozenset())
    context = lambda text: [h[3] for h in matcher.hits(text)]
    for text in ("I don't like this grotty thing, it's bad", "you're a stupid man, aren't you", "the boys' grotty dog's \"bone\"", "\"yes\" grotty \"no\"",
                 "grotty", "'tis grotty", "he is grotty.\" Then", "rock 'n' grotty roll"):
        assert context(text) == [T.PLAIN], text
    for text in ('"grotty"', "a \"stupid man\" came", "‘grotty’", "„grotty“ ist", "«grotty»", "“you're a stupid man,” it read", "'grotty.'", "she said grotty"):
        assert context(text) == [T.QUOTED], text
