"""Problem 2: cutting oversized texts at natural boundaries.

A text is a row of T01 atoms with boundaries between them, each of a strength (a blank line between blocks is strong, the inside of an
expression weak). Pieces are cut greedily: of all boundaries at which the piece has half the limit to the limit, a sparse-table
range-maximum query gives the strongest, the rightmost of equals; the next piece starts the stated overlap before that cut. Where none of
them ends a line, and the line that reaches beyond the limit fits whole into the next piece, the cut goes ahead of that line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.items import FileTexts, over_symbols
from lodestone.functions.tokens import ALNUM, BLANK, NEWLINE, PUNCT, atoms, codepoints, measure

# Strengths of boundaries.
LINE, AFTER_BLANK, AFTER_BLOCK, BEFORE_CLOSER, CONTINUED = 1000, 400, 150, -350, -300
#: A line's strength falls with its indent towards ``DEEPEST`` less, half of it at ``HALFWAY`` columns.
DEEPEST, HALFWAY = -720, 40
SENTENCE, STATEMENT, COMMA, GAP, PLAIN = 300, 250, 120, 60, 10


class RangeMax:
    """Sparse table over a row of strengths for ranges of at most ``longest`` entries; the rightmost of equals wins."""

    def __init__(self, strengths: np.ndarray, longest: int):
        n = len(strengths)
        self.n = n
        level = strengths.astype(np.int64) * (n + 1) + np.arange(n)
        self.levels = [level]
        reach = 1
        while reach * 2 <= min(n, max(1, longest)):
            level = np.maximum(level[: len(level) - reach], level[reach:])
            self.levels.append(level)
            reach *= 2

    def best(self, lo: int, hi: int) -> int:
        """Index of the greatest entry of lo..hi, both included."""
        k = min((hi - lo + 1).bit_length() - 1, len(self.levels) - 1)
        row, reach = self.levels[k], 1 << k
        top = row[lo]
        at = lo + reach
        while at + reach - 1 <= hi:  # only for ranges longer than twice the highest level
            top = max(top, row[at])
            at += reach
        return int(max(top, row[hi - reach + 1])) % (self.n + 1)


def _divide(start: np.ndarray, end: np.ndarray, cost: np.ndarray, kind: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts runs of letters and digits that cost more than ``most`` into stretches that cost ``most``, whose costs add up to no less."""
    if not len(cost) or cost.max() <= most:
        return start, end, cost, np.zeros(len(start), dtype=bool)
    step = 4 * (most - 1)
    parts = np.where(cost > most, -(-(end - start) // step), 1)
    owner = np.repeat(np.arange(len(start)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    s = start[owner] + nth * step
    e = np.where(nth + 1 < parts[owner], s + step, end[owner])
    size = e - s
    c = np.where(parts[owner] > 1, 1 + np.where(size >= 8, size // 4, 0), cost[owner])
    return s, e, c, nth > 0


def boundary_strengths(text: str, start: np.ndarray, end: np.ndarray, kind: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Strength of the boundary ahead of each atom; the one ahead of the first counts nothing."""
    n = len(start)
    cp = codepoints(text)
    first, last_of_prev = cp[start], np.concatenate([[0], cp[end[:-1] - 1]])
    prev_kind = np.concatenate([[0], kind[:-1]])
    out = np.full(n, PLAIN, dtype=np.int64)
    out[prev_kind == BLANK] = GAP
    before_gap = np.concatenate([[0, 0], cp[end[:-2] - 1]])[:n]
    out[(prev_kind == BLANK) & np.isin(before_gap, [ord(c) for c in ".!?。！？"])] = SENTENCE
    out[(prev_kind == PUNCT) & (last_of_prev == ord(","))] = COMMA
    out[(prev_kind == PUNCT) & np.isin(last_of_prev, [ord(c) for c in ";{}。！？"])] = STATEMENT
    newline = np.flatnonzero(cp == 10)
    if len(newline):
        lines = text.split("\n")
        indent = np.array([len(x) - len(x.lstrip(" \t")) + 3 * x[: len(x) - len(x.lstrip(" \t"))].count("\t") for x in lines])
        body = [x.strip() for x in lines]
        ends_block = np.array([x[-1:] in ("}", ";") or x == "end" for x in body])
        goes_on = np.array([x[-1:] in (",", "(", "[", "=", "+", "|", "&", "\\") for x in body])
        closer = np.array([x[:1] in ("}", ")", "]") for x in body])
        empty = np.array([not x for x in body])
        strength = LINE + DEEPEST * indent[1:] // (indent[1:] + HALFWAY) + AFTER_BLANK * empty[:-1] + AFTER_BLOCK * ends_block[:-1] + CONTINUED * goes_on[:-1] + BEFORE_CLOSER * closer[1:] - AFTER_BLANK * empty[1:]
        at = np.searchsorted(start, newline + 1, side="left")
        here = at < n
        np.maximum.at(out, at[here], strength[here])
    out[inner] = 0
    out[(kind == NEWLINE) & (out < LINE // 2)] = 0
    return out


def split_text(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int, int]]:
    """Pieces (first character, end, T01) that cover the text, each of at most ``limit`` tokens.

    Consecutive pieces share at least ``overlap`` tokens, and no more than the atom there makes necessary; only where
    atoms are so large that the next piece would not reach beyond this one do they share less. An empty text is one empty piece.
    """
    if limit < 4 or not 0 <= overlap < limit // 2:
        raise ValueError("limit must be 4 or more, and overlap less than half of it")
    start, end, cost, kind = atoms(text)
    total = int(cost.sum())
    if total <= limit:
        return [(0, len(text), max(1, total) if text else 0)]
    s, e, c, inner = _divide(start, end, cost, kind, max(3, limit // 8))
    k = np.full(len(s), ALNUM) if len(s) != len(start) else kind
    if len(s) != len(start):
        k = kind[np.searchsorted(start, s, side="right") - 1]
    strength = boundary_strengths(text, s, e, k, inner)
    sums = np.concatenate([[0], np.cumsum(c)])
    n = len(s)
    table = RangeMax(strength, limit)
    lines = np.flatnonzero(strength >= LINE // 4)  # boundaries at line ends, the deepest and least fit among them
    out: list[tuple[int, int, int]] = []
    i, done = 0, 0
    while True:
        hi = int(np.searchsorted(sums, sums[i] + limit, side="right")) - 1
        if hi >= n:
            out.append((i, n, int(sums[n] - sums[i])))
            break
        lo = int(np.searchsorted(sums, sums[i] + max(limit // 2, overlap + 1), side="left"))
        lo = min(max(lo, done + 1, i + 1), hi)
        j = table.best(lo, hi)
        if strength[j] < LINE // 4:
            least = max(done + 1, i + 1, int(np.searchsorted(sums, sums[i] + overlap + 1, side="left")))
            k = int(np.searchsorted(lines, lo, side="left"))
            if k and lines[k - 1] >= least:
                ends = int(lines[k]) if k < len(lines) else n
                j = int(lines[k - 1]) if sums[ends] - sums[lines[k - 1]] + overlap <= limit else j
        out.append((i, j, int(sums[j] - sums[i])))
        done = j
        back = int(np.searchsorted(sums, sums[j] - overlap, side="right")) - 1 if overlap else j
        i = max(back, i + 1, int(np.searchsorted(sums, sums[j + 1] - limit, side="left")))  # the next piece must pass this cut
    place = lambda b: 0 if b == 0 else len(text) if b == n else int(s[b])
    return [(place(a), place(b), t) for a, b, t in out]


def split_items(items: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pieces of every item whose ``text`` has more than ``limit`` tokens; other columns stay as they are.

    Adds ``piece`` (from 0), ``pieces``, ``char_start``, ``char_end`` (of the text, code points), ``line_start``, ``line_end`` (lines of the
    text, from 0) and ``tokens``. The items' own columns may not bear these names. Null and small texts give no rows. All
    texts of a batch are counted together, then the oversized ones are cut.
    """
    keep = [c for c in items.columns if c != "text"]
    added = "piece int, pieces int, char_start int, char_end int, line_start int, line_end int, tokens int"
    fields = [items.schema[c] for c in keep]
    # Long integers go as text, since pandas would make floats of them beside nulls.
    longs = {f.name: f.dataType for f in fields if isinstance(f.dataType, T.LongType)}
    sent = items.select(*[F.col(c).cast("string").alias(c) if c in longs else F.col(c) for c in items.columns])
    schema = T.StructType([*[T.StructField(f.name, T.StringType()) if f.name in longs else f for f in fields], *[T.StructField(c.split()[0], T.IntegerType()) for c in added.split(", ")]])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, at = [], []
            texts = b["text"].fillna("").tolist()
            for i in np.flatnonzero(measure(texts)[:, 0] > limit):
                text = texts[i]
                pieces = split_text(text, limit, overlap)
                breaks = np.flatnonzero(codepoints(text) == 10)
                for p, (x, y, t) in enumerate(pieces):
                    at.append(i)
                    rows.append((p, len(pieces), x, y, int(np.searchsorted(breaks, x)), int(np.searchsorted(breaks, max(x, y - 1))), t))
            out = b[keep].iloc[at].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(rows, columns=[f.split()[0] for f in added.split(", ")], dtype="int32")], axis=1)

    return sent.mapInPandas(cut, schema).withColumns({c: F.col(c).cast(kind) for c, kind in longs.items()})


def split_symbols(keys: DataFrame, files: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pieces of every symbol whose text has more than ``limit`` tokens, as ``split_items`` gives them; ``keys`` are ``path, qualified_name,
    start_line, end_line``. All symbols of a file are counted from one pass over it, and only the oversized ones are cut."""
    added = "piece int, pieces int, char_start int, char_end int, line_start int, line_end int, tokens int"
    names = [c.split()[0] for c in added.split(", ")]

    def work(file: FileTexts, rows: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> pd.DataFrame | None:
        out, at = [], []
        for i in np.flatnonzero(file.tokens(a, b) > limit):
            text = file.text[a[i] : b[i]]
            pieces = split_text(text, limit, overlap)
            breaks = np.flatnonzero(file.cp[a[i] : b[i]] == 10)
            for p, (x, y, t) in enumerate(pieces):
                at.append(i)
                out.append((p, len(pieces), x, y, int(np.searchsorted(breaks, x)), int(np.searchsorted(breaks, max(x, y - 1))), t))
        if not out:
            return None
        return pd.concat([rows.iloc[at].reset_index(drop=True), pd.DataFrame(out, columns=names, dtype="int32")], axis=1)

    return over_symbols(keys, files, work, added)
