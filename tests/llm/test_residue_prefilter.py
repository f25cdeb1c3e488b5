import random
import re
import sys
from re import _constants as C
from re import _parser

import pytest

from sheaf.llm import literals, residue
from test_residue_lines import records

PATTERNS = [(p, flags) for _, p, flags in residue.PATTERNS]
LINES = [
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.", "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Test headline", "Test paragraph", "Sample teaser", "Sample summary", "As an AI model, I do not have access to it.", "Please sign in again.", "The price: NaN.", "Your request is blocked", "Error 451: not here", "525 - handshake", "Non est, sed sit.", "PLEASE ſign in again",
    "JS is disabled in your browser.", "JS is required.", "This is a test caption", "Sample slogan", "Test slogan", "As an AI assistant model, I decline.", "Pellentesque habitant morbi tristique senectus et netus.", "Lorem dolor nullam quam semper porta",
    "Dear {{ name | default('you') }}, hello", "Hi {{user_name|upper}}", "Hi ${user.name:-x}", "HTTP 404", "Diese Seite existiert nicht", "Ein Fehler ist aufgetreten", "Une erreur est survenue", "With {{ " + "long_" * 40 + "name }}",
]


def sample(parts, r):
    """A text the parts are likely to match."""
    out = ""
    for op, av in parts:
        if op is C.LITERAL:
            out += chr(av)
        elif op is C.IN:
            chars = [c for k, v in av for c in ([chr(v)] if k is C.LITERAL else map(chr, range(v[0], v[1] + 1)) if k is C.RANGE else {C.CATEGORY_DIGIT: "0123456789", C.CATEGORY_WORD: "aZ7_", C.CATEGORY_SPACE: " \t"}.get(v, "-") if k is C.CATEGORY else "")]
            out += "-" if av[0][0] is C.NEGATE else r.choice(chars)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            out += "".join(sample(av[2], r) for _ in range(r.randint(av[0], min(av[1], av[0] + 2))))
        elif op is C.SUBPATTERN:
            out += sample(av[-1], r)
        elif op is C.BRANCH:
            out += sample(r.choice(av[1]), r)
        elif op is C.ASSERT and av[0] == 1:
            out += sample(av[1], r)
        elif op is C.ANY:
            out += r.choice("x ")
        elif op is C.NOT_LITERAL:
            out += "y"
    return out


@pytest.mark.parametrize("pattern,flags", PATTERNS)
def test_every_match_passes(pattern, flags):
    r, texts, tree, found = random.Random(1), residue._prefilter(), _parser.parse(pattern, flags), 0
    for _ in range(300):
        s = sample(tree, r)
        s = s.swapcase() if flags and r.random() < 0.3 else s
        if re.search(pattern, s, flags):
            found += 1
            assert texts.may(s) and PATTERNS.index((pattern, flags)) in texts.suspects(s)[0], s
    assert found > 5


def test_filler_of_any_words_passes():
    r, judge = random.Random(2), residue.Judge()
    for _ in range(3000):
        s = " ".join(r.choice(residue.FILLER_WORDS) if r.random() < 0.65 else "other" for _ in range(r.randint(4, 12)))
        assert residue._prefilter().suspects(s)[1] or not judge.kinds(s, ()), s


def test_letters_that_only_patterns_take_for_ascii():
    known = set(literals.unusual())
    used = {c for p, flags in PATTERNS for t in literals.needed(p, flags) for c in t if c.isalpha()}
    odd = re.compile("[" + "".join(used) + "]", re.I)
    assert [c for c in map(chr, range(128, sys.maxunicode + 1)) if odd.fullmatch(c) and c.lower() not in used and c.lower() not in known] == []


def test_a_pattern_without_literals_is_refused():
    with pytest.raises(ValueError):
        literals.needed(r"\w+\s*")


def test_lines_of_all_rules_are_found(spark):
    got = {r.item_id for r in residue.residue_records(records(spark, LINES)).collect()}
    assert [c for i, c in enumerate(LINES) if i not in got] == []
