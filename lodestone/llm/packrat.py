"""A small packrat parser: parsing expressions over a row of tokens, with every result remembered by rule and position.

A rule is a function of (tokens, position, memo) that gives (value, next position) or None. Each (rule, position) is tried once, so
parsing takes time in proportion to the tokens. Repetition runs in a loop, not in recursion, so long inputs are no problem.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any, NamedTuple


class Token(NamedTuple):
    kind: str
    start: int  # offset of its first character
    end: int
    line: int  # line of its first character, from 1
    last: int  # line of its last character


Result = tuple[Any, int] | None
Rule = Callable[[Sequence[Token], int, dict], Result]


def remembered(rule: Rule) -> Rule:
    key = object()

    def parse(tokens: Sequence[Token], at: int, memo: dict) -> Result:
        slot = (key, at)
        if slot not in memo:
            memo[slot] = rule(tokens, at, memo)
        return memo[slot]

    return parse


def token(*kinds: str) -> Rule:
    wanted = frozenset(kinds)
    return lambda t, i, m: (t[i], i + 1) if i < len(t) and t[i].kind in wanted else None


def sequence(*rules: Rule) -> Rule:
    def parse(t: Sequence[Token], i: int, m: dict) -> Result:
        out = []
        for rule in rules:
            r = rule(t, i, m)
            if r is None:
                return None
            out.append(r[0])
            i = r[1]
        return out, i

    return remembered(parse)


def choice(*rules: Rule) -> Rule:
    def parse(t: Sequence[Token], i: int, m: dict) -> Result:
        for rule in rules:
            r = rule(t, i, m)
            if r is not None:
                return r
        return None

    return remembered(parse)


def many(rule: Rule, least: int = 0) -> Rule:
    def parse(t: Sequence[Token], i: int, m: dict) -> Result:
        out = []
        while i < len(t):
            r = rule(t, i, m)
            if r is None or r[1] == i:
                break
            out.append(r[0])
            i = r[1]
        return (out, i) if len(out) >= least else None

    return remembered(parse)


def optional(rule: Rule) -> Rule:
    return lambda t, i, m: rule(t, i, m) or (None, i)


def absent(rule: Rule) -> Rule:
    """Succeeds without moving where the rule fails."""
    return lambda t, i, m: None if rule(t, i, m) is not None else (None, i)


def action(rule: Rule, give: Callable[[Any], Any]) -> Rule:
    def parse(t: Sequence[Token], i: int, m: dict) -> Result:
        r = rule(t, i, m)
        return None if r is None else (give(r[0]), r[1])

    return parse
