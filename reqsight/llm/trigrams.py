"""Boolean trigram queries of regular expressions.

``query`` reads a regex through the standard library's parser and returns an OR of ANDs of lower-case trigrams:
every text with a match holds all trigrams of at least one clause. Each part of the regex is described by the exact
set of strings it matches while that is small, else by sets of beginnings and endings and the query met so far;
parts are put together by concatenation, alternation and repetition. What cannot be said (large character classes,
back references, look-arounds) is left open, which only makes the query weaker. An empty clause means that no
trigram is mandatory.

The patterns must mean the same to the parser and to Spark's regexes; letters are folded by A-Z only.
"""

from __future__ import annotations

import re._constants as kind
import re._parser as parser
from dataclasses import dataclass

#: Strings of an exact set, characters of an expanded class and clauses of a query, at most; beyond, the part is left open.
MAX_STRINGS = 64
MAX_CLASS = 4
MAX_CLAUSES = 64

Query = frozenset  # of clauses, each a frozenset of trigrams
OPEN: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Part:
    """What a part of a regex matches: ``exact`` strings, or (None) strings by ``first``, ``last`` and ``need``."""
    exact: frozenset | None
    first: frozenset = frozenset([""])
    last: frozenset = frozenset([""])
    need: Query = OPEN


ANY = Part(None)
NOTHING = Part(frozenset([""]))


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def simplest(clauses) -> Query:
    """Without clauses that hold only where a shorter one does; open if there are too many."""
    kept: list = []
    for c in sorted(set(clauses), key=len):
        if not any(k <= c for k in kept):
            kept.append(c)
    return frozenset(kept) if len(kept) <= MAX_CLAUSES else OPEN


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MAX_CLAUSES ** 2:
        return a  # the weaker query still holds
    joint = simplest(x | y for x in a for y in b)
    return a if joint == OPEN else joint


def holds(strings) -> Query:
    """A text that holds one of the strings holds the trigrams of one of them."""
    return simplest(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def inexact(p: Part) -> Part:
    if p.exact is None:
        return p
    return Part(None, frozenset(s[:2] for s in p.exact), frozenset(s[-2:] for s in p.exact), holds(p.exact))


def crossed(a: frozenset, b: frozenset) -> frozenset | None:
    return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= MAX_STRINGS else None


def follow(a: Part, b: Part) -> Part:
    """``a`` then ``b``."""
    if a.exact is not None and b.exact is not None:
        whole = crossed(a.exact, b.exact)
        if whole is not None:
            return Part(whole)
    left, right = inexact(a), inexact(b)
    need = both(left.need, right.need)
    middle = crossed(a.exact if a.exact is not None else a.last, b.exact if b.exact is not None else b.first)
    if middle is not None:
        need = both(need, holds(middle))
    # what begins (ends) the whole also reaches over a short exact part
    first = crossed(a.exact, right.first) if a.exact is not None else left.first
    last = crossed(left.last, b.exact) if b.exact is not None else right.last
    return Part(None, frozenset(s[:2] for s in first) if first else left.first,
                frozenset(s[-2:] for s in last) if last else right.last, need)


def either(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts):
        whole = frozenset().union(*(p.exact for p in parts))
        if len(whole) <= MAX_STRINGS:
            return Part(whole)
    parts = [inexact(p) for p in parts]
    first, last = frozenset().union(*(p.first for p in parts)), frozenset().union(*(p.last for p in parts))
    return Part(None, first, last, simplest(c for p in parts for c in p.need))


def repeated(p: Part, least: int, most: int) -> Part:
    if (least, most) == (0, 1):
        return either([p, NOTHING])
    if least == 0:
        return ANY
    if least == most == 1:
        return p
    one = inexact(p)
    return Part(None, one.first, one.last, one.need)


def one_of(chars, ignore_case: bool) -> Part:
    chars = frozenset(fold(c) for c in chars)
    if ignore_case and any(ord(c) > 127 for c in chars):
        return ANY
    return Part(chars) if 0 < len(chars) <= MAX_CLASS else ANY


def char_class(items, ignore_case: bool) -> Part:
    chars: set = set()
    for op, arg in items:
        if op is kind.LITERAL:
            chars.add(chr(arg))
        elif op is kind.RANGE and arg[1] - arg[0] < 2 * MAX_CLASS:
            chars.update(chr(c) for c in range(arg[0], arg[1] + 1))
        else:
            return ANY
    return one_of(chars, ignore_case)


def part_of(items, ignore_case: bool) -> Part:
    out = NOTHING
    for op, arg in items:
        if op is kind.LITERAL:
            nxt = one_of([chr(arg)], ignore_case)
        elif op is kind.IN:
            nxt = char_class(arg, ignore_case)
        elif op is kind.BRANCH:
            nxt = either([part_of(x, ignore_case) for x in arg[1]])
        elif op is kind.SUBPATTERN:
            _, on, off, inner = arg
            case = bool(on & int(kind.SRE_FLAG_IGNORECASE)) or (ignore_case and not off & int(kind.SRE_FLAG_IGNORECASE))
            nxt = part_of(inner, case)
        elif op is kind.ATOMIC_GROUP:
            nxt = part_of(arg, ignore_case)
        elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT, kind.POSSESSIVE_REPEAT):
            nxt = repeated(part_of(arg[2], ignore_case), int(arg[0]), int(arg[1]))
        elif op in (kind.AT, kind.ASSERT, kind.ASSERT_NOT):
            nxt = NOTHING  # no text of its own
        else:
            nxt = ANY
        out = follow(out, nxt)
    return out


def query(regex: str) -> list[frozenset]:
    """Clauses of which one holds for every text that ``regex`` matches somewhere; an empty one holds for every text."""
    tree = parser.parse(regex)
    whole = part_of(tree, bool(tree.state.flags & int(kind.SRE_FLAG_IGNORECASE)))
    return sorted(inexact(whole).need, key=sorted)
