"""What a text must hold for a pattern to match: the cheap tests in front of a scan.

Both tests are derived from a pattern's syntax tree, so they can't drift from it: the
least number of digits in any match, and a set of literals of which any match holds
one. They may let through texts without a match, but never hide one.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters whose case folds into a letter of another alphabet's range.
_ODD, _EVEN = "\u017f\u0131\u0130\u212a\u212b", "siik\u00e5"
#: Literals that stand for one place of a pattern, at most.
MOST = 48


def folded(text: Column) -> Column:
    """Lower case such that whatever a pattern takes for equal is equal."""
    return F.lower(F.translate(text, _ODD, _EVEN))


def n_digits(text: Column) -> Column:
    """Digits of any script."""
    return F.regexp_count(text, F.lit(r"(?U)\d"))


def _fold(c: int) -> str:
    return chr(c).translate(str.maketrans(_ODD, _EVEN)).lower()


def _is_digit(op, value) -> bool:
    if op is C.LITERAL:
        return chr(value).isdigit()
    if op is C.CATEGORY:
        return value is C.CATEGORY_DIGIT
    if op is C.RANGE:
        return chr(value[0]).isdigit() and chr(value[1]).isdigit()
    return False


def _digits(tree) -> int:
    """Digits in any match, at least."""
    n = 0
    for op, value in tree:
        if op is C.IN:
            n += value[0][0] is not C.NEGATE and all(_is_digit(*x) for x in value)
        elif op is C.BRANCH:
            n += min(_digits(x) for x in value[1])
        elif op is C.SUBPATTERN:
            n += _digits(value[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            n += value[0] * _digits(value[2])
        elif op is C.ATOMIC_GROUP:
            n += _digits(value)
        else:
            n += _is_digit(op, value)
    return n


def _worth(literals: frozenset[str]) -> tuple[int, int]:
    return min(map(len, literals)), -len(literals)


def _literals(tree) -> frozenset[str] | None:
    """Literals of which any match holds one; None if none are known."""
    found: list[frozenset[str]] = []
    run: list[set[str]] = []

    def end() -> None:
        while run:
            size = 1
            for i, x in enumerate(run):
                size *= len(x)
                if size > MOST:
                    found.append(frozenset(map("".join, product(*run[:i]))))
                    del run[:i]
                    break
            else:
                found.append(frozenset(map("".join, product(*run))))
                run.clear()

    for op, value in tree:
        if op is C.LITERAL:
            run.append({_fold(value)})
            continue
        if op is C.IN and len(value) <= 6 and all(x[0] is C.LITERAL for x in value):
            run.append({_fold(x[1]) for x in value})
            continue
        end()
        inner = None
        if op is C.BRANCH:
            each = [_literals(x) for x in value[1]]
            if None not in each and sum(map(len, each)) <= MOST:
                inner = frozenset().union(*each)
        elif op is C.SUBPATTERN:
            inner = _literals(value[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] >= 1:
            inner = _literals(value[2])
        elif op is C.ATOMIC_GROUP:
            inner = _literals(value)
        if inner:
            found.append(inner)
    end()
    return max((x for x in found if "" not in x), key=_worth, default=None)


@cache
def needs(regex: str) -> tuple[int, tuple[str, ...]]:
    """Digits, and literals of which one, that any match holds."""
    tree = _parser.parse(regex, re.UNICODE)
    every = _literals(tree) or frozenset()
    # a literal that holds another needs no test of its own
    return _digits(tree), tuple(sorted(x for x in every if not any(y != x and y in x for y in every)))


def may_match(regex: str, low: Column, digits: Column) -> Column:
    """The test, on the ``folded`` text and its ``n_digits``."""
    least, literals = needs(regex)
    out = digits >= least
    if literals:
        held = F.contains(low, F.lit(literals[0]))
        for x in literals[1:]:
            held = held | F.contains(low, F.lit(x))
        out = out & held
    return out
