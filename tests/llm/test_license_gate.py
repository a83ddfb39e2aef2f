"""The keyword gate of the license scanner against a scan that runs every rule."""

from itertools import product
from re import _parser

from tillproof.llm import licenses as L


def spellings(parsed):
    """All strings of a pattern made of letters, choices and optional parts; one digit stands for a set."""
    options = []
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            options.append([chr(value)])
        elif name == "IN":
            options.append([chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])])
        elif name == "SUBPATTERN":
            options.append(spellings(value[-1]))
        elif name == "BRANCH":
            options.append([s for branch in value[1] for s in spellings(branch)])
        else:
            assert name == "MAX_REPEAT" and value[:2] == (0, 1), name
            options.append(["", *spellings(value[2])])
    return ["".join(p) for p in product(*options)]


def test_gate_lets_every_spelling_through():
    gated, free = L.Scanner(), L.Scanner()
    free.gates = type(gated.gates)()
    free.gates.add_word(" ", list(range(len(free.rules))))
    free.gates.make_automaton()
    for label, _, name in L.FAMILIES:
        for spelling in spellings(_parser.parse(name)):
            for text in (f" licensed under {spelling} ", f" {spelling} license ", f" spdx license identifier {spelling} "):
                found = gated.detections(text)
                assert found == free.detections(text) and found, text
    for text in ("Licensed under GPLv3", "FreeBSD license", "license: MPL2", "BSD3 license", "licensed under LGPLv3"):
        assert gated.scan(text.encode())[5], text
