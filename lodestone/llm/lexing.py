"""Vectorised lexing of source text: token hashes, winnowed fingerprints and line shapes, all in numpy."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

from lodestone.functions.tokens import codepoints

WORD, SPACE, LINE, SYMBOL = 1, 2, 3, 4
#: Distances between lines of one shape that are tried as the period of a text, the most frequent ones.
STEPS = 6
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(1099511628211)


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """Lexical class of every code point: ASCII letters, digits, _ and all letters beyond ASCII form words."""
    t = np.full(0x110000, WORD, dtype=np.uint8)
    for cp in range(128):
        c = chr(cp)
        t[cp] = WORD if c.isalnum() or c == "_" else LINE if c == "\n" else SPACE if cp <= 32 or cp == 127 else SYMBOL
    t[[0x85, 0xA0, 0x3000, 0xFEFF]] = SPACE
    return t


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    out = np.empty(4096, dtype=np.uint64)
    p = np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(4096):
            out[i] = p
            p = p * _BASE
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of powers spread over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Lexed(NamedTuple):
    n: int  # characters
    spaces: int  # white space characters, line ends included
    start: np.ndarray  # first character of each token
    size: np.ndarray  # its length
    line: np.ndarray  # its line, from 0
    first: np.ndarray  # its first code point
    is_word: np.ndarray
    value: np.ndarray  # hash of its text
    quoted: np.ndarray  # characters of the token's line that stand between double quotes, on the line's first token
    lines: int


def lex(text: str) -> Lexed:
    """Tokens of a text: runs of word characters, and every other visible character alone."""
    cp = codepoints(text)
    n = len(cp)
    if not n:
        e = np.zeros(0, dtype=np.int64)
        return Lexed(0, 0, e, e, e, e.astype(np.uint32), e.astype(bool), e.astype(np.uint64), e, 0)
    cls = _table()[cp]
    word = cls == WORD
    begins = (cls == SYMBOL) | (word & np.concatenate([[True], ~word[:-1]]))
    start = np.flatnonzero(begins)
    line_of = np.cumsum(cls == LINE) - (cls == LINE)
    spaces = int(((cls == SPACE) | (cls == LINE)).sum())
    if not len(start):
        e = np.zeros(0, dtype=np.int64)
        return Lexed(n, spaces, e, e, e, e.astype(np.uint32), e.astype(bool), e.astype(np.uint64), e, int(line_of[-1]) + 1)
    visible = word | (cls == SYMBOL)
    at = np.flatnonzero(visible)
    owner = np.searchsorted(start, at, side="right") - 1
    powers = _powers()
    with np.errstate(over="ignore"):
        weighted = (cp[at].astype(np.uint64) + np.uint64(1)) * powers[(at - start[owner]) & 4095]
        bounds = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        value = mix(np.add.reduceat(weighted, bounds) * _MUL)
    size = np.diff(np.concatenate([bounds, [len(at)]]))
    line = line_of[start]
    # Characters between double quotes, by parity within the line.
    quote = cp == 34
    marks = np.cumsum(quote)
    line_starts = np.flatnonzero(np.concatenate([[True], (cls == LINE)[:-1]]))
    base = marks[line_starts] - quote[line_starts]
    inside = ((marks - base[line_of]) & 1).astype(bool) | quote
    inside &= visible
    per_line = np.bincount(line_of[inside], minlength=int(line_of[-1]) + 1)
    opens = np.concatenate([[True], line[1:] != line[:-1]])
    quoted = np.where(opens, per_line[line], 0)
    return Lexed(n, spaces, start, size, line, cp[start], word[start], value, quoted, int(line_of[-1]) + 1)


def _is_digit(first: np.ndarray) -> np.ndarray:
    return (first >= 48) & (first <= 57)


def comment_lines(x: Lexed, hash_comments: bool) -> np.ndarray:
    """For each token, whether its line starts as a comment (//, /*, * or, in languages that have it, #)."""
    if not len(x.start):
        return np.zeros(0, dtype=bool)
    opens = np.flatnonzero(np.concatenate([[True], x.line[1:] != x.line[:-1]]))
    a = x.first[opens]
    nxt = np.minimum(opens + 1, len(x.start) - 1)
    b = np.where((nxt != opens) & (x.line[nxt] == x.line[opens]) & (x.start[nxt] == x.start[opens] + 1), x.first[nxt], 0)
    comment = ((a == 47) & ((b == 47) | (b == 42))) | ((a == 42) & (b != 40))
    if hash_comments:
        comment |= a == 35
    group = np.cumsum(np.concatenate([[True], x.line[1:] != x.line[:-1]])) - 1
    return comment[group]


def fingerprints(x: Lexed, keep: np.ndarray, k: int, window: int) -> np.ndarray:
    """Winnowed fingerprints of the kept tokens, numbers made equal: the least hash of every window of k-grams.

    A stretch of k + window - 1 tokens that two texts share gives at least one common fingerprint. Texts shorter than k
    tokens have one fingerprint of all they hold; texts without tokens have none.
    """
    v = np.where(_is_digit(x.first) & x.is_word, np.uint64(7), x.value)[keep]
    if not len(v):
        return np.zeros(0, dtype=np.int64)
    k = min(k, len(v))
    with np.errstate(over="ignore"):
        grams = np.zeros(len(v) - k + 1, dtype=np.uint64)
        for i in range(k):
            grams = grams * _BASE + v[i : i + len(grams)]
        grams = mix(grams)
    w = min(window, len(grams))
    low = grams.copy()
    reach = 1
    while reach * 2 <= w:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    if reach < w:
        low = np.minimum(low[: len(low) - (w - reach)], low[w - reach :])
    return np.unique(low).view(np.int64)


class Shape(NamedTuple):
    chars: int
    space_share: float
    mean_line: float  # characters per line that is not blank
    period: float  # largest share of code lines that look like the line some fixed step before
    variety: float  # different line shapes per code line
    data_lines: float  # share of code lines made mostly of literals
    code_lines: int


def _steps(shapes: np.ndarray) -> list[int]:
    """The most frequent distances between a line and the last one of its shape, half of the lines at most."""
    order = np.argsort(shapes, kind="stable")
    same = shapes[order[1:]] == shapes[order[:-1]]
    gaps = (order[1:] - order[:-1])[same]
    gaps = gaps[gaps <= len(shapes) // 2]
    steps, n = np.unique(gaps, return_counts=True)
    return steps[np.argsort(-n, kind="stable")[:STEPS]].tolist()


def shape(x: Lexed, comment: np.ndarray) -> Shape:
    """Layout statistics that tell written code from emitted, packed or tabular text."""
    none = Shape(x.n, x.spaces / max(1, x.n), 0.0, 0.0, 1.0, 0.0, 0)
    if not len(x.start):
        return none
    used = len(np.unique(x.line))
    keep = ~comment
    if not keep.any():
        return none._replace(mean_line=x.n / used)
    line, first, size, word = x.line[keep], x.first[keep], x.size[keep], x.is_word[keep]
    digit = _is_digit(first) & word
    opens = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    group = np.cumsum(np.concatenate([[True], line[1:] != line[:-1]])) - 1
    at = np.arange(len(line)) - opens[group]
    kind = np.where(digit, np.uint64(2), np.where(word, np.uint64(1), first.astype(np.uint64) + np.uint64(16)))
    with np.errstate(over="ignore"):
        shapes = mix(np.add.reduceat(kind * _powers()[at & 4095], opens) * _MUL)
    literal = np.add.reduceat(np.where(digit, size, 0), opens)
    quoted = x.quoted[keep][opens]
    total = np.add.reduceat(size, opens)
    data = np.maximum(literal, quoted) + np.where(quoted > 0, np.minimum(literal, total - quoted), 0) >= 0.6 * total
    m = len(shapes)
    period = max((float((shapes[q:] == shapes[:-q]).mean()) for q in _steps(shapes)), default=0.0)
    return Shape(x.n, x.spaces / max(1, x.n), x.n / used, period, len(np.unique(shapes)) / m, float(data.mean()), m)
