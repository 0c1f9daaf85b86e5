"""T01, the project's token estimate, as one Catalyst expression and as numpy code for Arrow batches.

Definition: 0 for an empty text; else at least 1 and the number of matches of ``TOKEN`` plus floor(length / 4) for every
run of eight or more ASCII letters and digits. A letter outside ASCII matches nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The token pattern and its white space, which are the controls \t \n \f \r and all separators.
SPACE = r"\t\n\f\r\p{Z}"
TOKEN = rf"[a-zA-Z0-9]+|[\p{{P}}\p{{S}}]|\n|[{SPACE}]+"
QUARTER = "[a-zA-Z0-9]{4}"
SHORT = "(?<![a-zA-Z0-9])[a-zA-Z0-9]{4,7}(?![a-zA-Z0-9])"


def token_estimate(text: Column | str) -> Column:
    """T01 of a text as bigint; null for null.

    Every run of n characters holds floor(n / 4) matches of ``QUARTER``; runs of four to seven hold one each and don't
    count, so three counting passes give the sum without building an array of matches.
    """
    c = F.col(text) if isinstance(text, str) else text
    tokens = F.regexp_count(c, F.lit(TOKEN)) + F.regexp_count(c, F.lit(QUARTER)) - F.regexp_count(c, F.lit(SHORT))
    return F.when(c == "", F.lit(0)).when(c.isNotNull(), F.greatest(F.lit(1), tokens)).cast("bigint")


def counter_udf(counter: Callable[[str], int]) -> Callable[[Column], Column]:
    """A caller's own counter in place of the estimate, applied to Arrow batches. Null stays null."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(counter, na_action="ignore").astype("Int64")

    return count


# Classes of characters for the numpy version.
OTHER, ALNUM, PUNCT, NEWLINE, BLANK = range(5)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point, built once a worker."""
    import unicodedata

    out = np.zeros(0x110000, dtype=np.uint8)
    kind = {"P": PUNCT, "S": PUNCT, "Z": BLANK}
    for cp in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0x20000), *range(0xE0000, 0xE0200)]:
        c = kind.get(unicodedata.category(chr(cp))[0])
        if c is not None:
            out[cp] = c
    for c in "\t\f\r":
        out[ord(c)] = BLANK
    out[ord("\n")] = NEWLINE
    for lo, hi in ("09", "az", "AZ"):
        out[ord(lo) : ord(hi) + 1] = ALNUM
    return out


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def atoms(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, cost and class of each match of ``TOKEN`` in code points.

    The cost of a run of letters and digits includes its floor(length / 4), so that costs add up to T01 for any stretch
    that starts and ends at atoms.
    """
    cp = codepoints(text)
    empty = np.zeros(0, dtype=np.int64)
    if not len(cp):
        return empty, empty, empty, empty
    cls = _classes()[cp]
    n = len(cls)
    prev = np.empty(n, dtype=np.uint8)
    prev[0], prev[1:] = 255, cls[:-1]
    space = (cls == NEWLINE) | (cls == BLANK)
    was_space = (prev == NEWLINE) | (prev == BLANK)
    was_space[0] = False
    # In a run of white space every newline ahead of the first other blank stands alone; the rest is one atom.
    blanks = np.cumsum(cls == BLANK)
    run_start = space & ~was_space
    at = np.flatnonzero(run_start)
    before = np.zeros(n, dtype=np.int64)
    if len(at):
        base = blanks[at] - (cls[at] == BLANK)
        before = np.zeros(n, dtype=np.int64)
        before[at] = np.diff(np.concatenate([[0], base]))
        before = np.cumsum(before)
    earlier = blanks - (cls == BLANK) - before
    start = ((cls == ALNUM) & (prev != ALNUM)) | (cls == PUNCT) | (space & (earlier == 0))
    starts = np.flatnonzero(start)
    if not len(starts):
        return empty, empty, empty, empty
    # An atom ends where its class ends, or at the next atom's start.
    change = np.flatnonzero(np.concatenate([(cls[1:] != cls[:-1]) & ~(space[1:] & space[:-1]), [True]])) + 1
    ends = change[np.searchsorted(change, starts, side="right")]
    ends[:-1] = np.minimum(ends[:-1], starts[1:])
    kinds = cls[starts]
    length = ends - starts
    cost = 1 + np.where((kinds == ALNUM) & (length >= 8), length // 4, 0)
    return starts, ends, cost, kinds


def count_tokens(text: str | None) -> int | None:
    """T01 in Python, for use inside Arrow functions."""
    if text is None:
        return None
    return max(1, int(atoms(text)[2].sum())) if text else 0


#: What ``measure`` counts of a text.
MEASURES = ("tokens", "bytes", "words", "digits", "punctuation", "gaps", "ideographs", "letters_beyond_ascii")
#: Characters that are classified at once; bounds the memory of a batch.
CHUNK = 1 << 18


def is_ideograph(cp: np.ndarray) -> np.ndarray:
    """Which code points are ideographs, kana or hangul syllables."""
    return ((cp >= 0x3040) & (cp <= 0x30FF)) | ((cp >= 0x3400) & (cp <= 0x9FFF)) | ((cp >= 0xAC00) & (cp <= 0xD7AF)) | ((cp >= 0x20000) & (cp <= 0x3FFFF))


def _measure_chunk(texts: list[str]) -> np.ndarray:
    joined = "\0".join(texts)  # the separator matches nothing and ends every run
    start, end, cost, kind = atoms(joined)
    cp = codepoints(joined)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    last = np.cumsum(size + 1) - 1
    first = last - size
    out = np.zeros((len(texts), len(MEASURES)), dtype=np.int64)
    owner = np.searchsorted(last, start, side="right")

    def by_text(chosen: np.ndarray | None, weights: np.ndarray | None = None) -> np.ndarray:
        at = owner if chosen is None else owner[chosen]
        return np.bincount(at, weights=weights, minlength=len(texts)).astype(np.int64)

    def chars(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[last] - sums[first]

    out[:, 0] = np.maximum(by_text(None, cost), size > 0) if len(start) else size > 0
    beyond = chars(cp > 0x7F)
    out[:, 1] = size + beyond + chars(cp > 0x7FF) + chars(cp > 0xFFFF) if beyond.any() else size
    if len(start):
        out[:, 2] = by_text(kind == ALNUM)
        out[:, 4] = by_text(kind == PUNCT)
        out[:, 5] = by_text((kind == NEWLINE) | (kind == BLANK))
    out[:, 3] = chars((cp >= 48) & (cp <= 57))
    if beyond.any():
        out[:, 6] = chars(is_ideograph(cp))
        out[:, 7] = beyond - out[:, 6]
    return out


def measure(texts: list[str]) -> np.ndarray:
    """One row of ``MEASURES`` a text, T01 first; many short texts are classified together."""
    parts, now, size = [], [], 0
    for t in texts:
        now.append(t)
        size += len(t) + 1
        if size >= CHUNK:
            parts.append(_measure_chunk(now))
            now, size = [], 0
    if now:
        parts.append(_measure_chunk(now))
    return np.concatenate(parts) if parts else np.zeros((0, len(MEASURES)), dtype=np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def measures(texts: pd.Series) -> pd.Series:
    """``MEASURES`` of a text column as an array; a null text counts as empty.

    One pass over the characters, where the regular expressions of ``token_estimate`` take three; at corpus size this is several
    times cheaper in spite of the Arrow transfer.
    """
    return pd.Series(list(measure(texts.fillna("").tolist())))


@F.pandas_udf(T.LongType())
def counted_tokens(texts: pd.Series) -> pd.Series:
    """T01 of a text column by ``measure``; null stays null."""
    return pd.Series(measure(texts.fillna("").tolist())[:, 0], dtype="Int64").where(texts.notna().to_numpy())
