"""Keywords of the licence rules against an enumeration of what the patterns match."""

import itertools
import re
from re import _constants as c
from re import _parser as parser

import pytest

from sitlake.llm.license_rules import RULES
from sitlake.llm.license_scan import Detection, Matcher, resolve


def forms(tokens):
    """All strings of a pattern; long repeats stand for their least number and one more."""
    ways = [[""]]
    for op, arg in tokens:
        if op is c.LITERAL:
            ways.append([chr(arg)])
        elif op is c.NOT_LITERAL:
            ways.append(["é" if chr(arg) != "é" else "x"])
        elif op is c.IN:
            ways.append([chr(x) for kind, a in arg for x in ([a] if kind is c.LITERAL else [*a] if a[1] - a[0] < 3 else [a[0]])])
        elif op is c.BRANCH:
            ways.append([s for branch in arg[1] for s in forms(branch)])
        elif op is c.SUBPATTERN:
            ways.append(forms(arg[-1]))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, inner = arg
            own = forms(inner)
            ways.append([s * n for n in range(low, min(high, low + 1) + 1) for s in (own if n else [""])])
        elif op is not c.ASSERT_NOT:
            raise ValueError(op)
    return ["".join(x) for x in itertools.product(*ways)]


FORMS = {k: [f for f in forms(parser.parse(rule.pattern)) if re.fullmatch(rule.pattern, f)] for k, rule in enumerate(RULES)}


def ungated(text):
    """The detections that stand when every rule is tried."""
    starts = [0, *(m.end() for m in re.finditer(" ", text))]
    found = []
    for rule in RULES:
        for m in re.finditer(rf"(?<![^ ])(?:{rule.pattern})(?![^ ])", text):
            found.append(Detection(starts.index(m.start()), sum(s < m.end() for s in starts), rule.label, rule.priority, rule.score))
    return resolve(found)


def test_every_form_holds_its_keyword():
    assert all(FORMS.values())
    assert {(RULES[k].keyword, f) for k, own in FORMS.items() for f in own if RULES[k].keyword not in f} == set()


def test_gated_scan_equals_ungated():
    matcher = Matcher()
    for own in FORMS.values():
        for form in own:
            text = " ".join(f"x {form} y".split())
            assert matcher.scan([w.encode() for w in text.split()])[1] == ungated(text), form


def test_few_rules_are_plain_strings():
    plain = [rule.pattern for rule in RULES if len(FORMS[RULES.index(rule)]) == 1]
    assert len(plain) < len(RULES) / 4, plain


@pytest.mark.parametrize("text", ["all rights reserved", "copyright 2020 by x all rights reserved redistribution and use", "you can buy me a beer"])
def test_bare_notices_name_no_licence(text):
    assert {d.score for d in Matcher().scan([w.encode() for w in text.split()])[1]} <= {0.3}


def test_long_and_foreign_names_of_holders():
    text = "neither the name of the größe 日本 foundation of many words and more nor the names of its contributors may be used to endorse or promote products derived from this software"
    assert "bsd-3-clause" in {d.label for d in Matcher().scan([w.encode() for w in text.split()])[1]}


@pytest.mark.parametrize("text, label, score", [("llama 3 1 community license", "llama", 0.8), ("licensed under the mit license", "mit", 1.0)])
def test_forms_of_the_review(text, label, score):
    found = Matcher().scan([w.encode() for w in text.split()])[1]
    assert (label, score) in [(d.label, d.score) for d in found]
