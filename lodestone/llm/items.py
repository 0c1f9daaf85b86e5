"""Texts that the problems work on: symbols with the text of their lines, and limits by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import source_lines, symbol_text
from lodestone.functions.tokens import atoms, codepoints, count_tokens
from lodestone.operators.current import current_files
from lodestone.operators.skew import salted

KEY = ["path", "qualified_name", "start_line", "end_line"]


def symbol_keys(symbols: DataFrame, *aggregates: Column) -> DataFrame:
    """Each symbol key once, with aggregates over its rows; repeated rows meet on the map side. Null paths have no text and go."""
    keyed = symbols.filter("path is not null")
    return keyed.groupBy(*KEY).agg(*aggregates) if aggregates else keyed.select(*KEY).distinct()


#: Characters of contents that are cut into atoms at once.
CHUNK = 1 << 22


class FileTexts:
    """Contents with their lines and atoms, of which the texts of all symbols are measured at once by differences of running sums.

    The contents stand behind each other, a line end between them, so that small files cost no more than large ones.
    """

    def __init__(self, contents: list[str | None]):
        parts = [(c or "").replace("\r\n", "\n") for c in contents]
        self.text = "\n".join(parts)
        self.cp = cp = codepoints(self.text)
        breaks = np.flatnonzero(cp == 10)
        self.line_start = np.concatenate([[0], breaks + 1])
        self.line_end = np.concatenate([breaks, [len(cp)]])
        begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in parts])])
        self.first_line = np.searchsorted(self.line_start, begins[:-1])  # of each content
        self.lines = np.diff(np.concatenate([self.first_line, [len(self.line_start)]]))
        self.shown = np.flatnonzero((cp != 32) & (cp != 9) & (cp != 13) & (cp != 10))
        self.start, self.end, self.cost, self.kind = atoms(self.text)

    def spans(self, which: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of lines first..last of contents, without blanks and line ends around; equal where there is nothing."""
        lo, hi = np.maximum(1, first), np.minimum(self.lines[which], last)
        there = lo <= hi
        a = self.line_start[self.first_line[which] + np.where(there, lo, 1) - 1]
        b = self.line_end[self.first_line[which] + np.where(there, hi, 1) - 1]
        if not len(self.shown):
            return np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        i, j = np.searchsorted(self.shown, a), np.searchsorted(self.shown, b)
        there &= i < j
        return np.where(there, self.shown[np.minimum(i, len(self.shown) - 1)], 0), np.where(there, self.shown[np.maximum(j, 1) - 1] + 1, 0)

    def _between(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Atoms from a to b, and where a or b lies inside an atom (among rarer blanks only), so that the text is counted by itself."""
        i, j = np.searchsorted(self.start, a), np.searchsorted(self.start, b)
        if not len(self.start):
            return i, j, np.zeros(len(a), dtype=bool)
        inside = ((i > 0) & (self.end[np.maximum(i, 1) - 1] > a)) | ((j > 0) & (self.end[np.maximum(j, 1) - 1] > b))
        return i, j, inside & (a < b)

    def tokens(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """T01 of the characters a..b."""
        i, j, inside = self._between(a, b)
        sums = np.concatenate([[0], np.cumsum(self.cost, dtype=np.int64)])
        out = np.maximum(sums[j] - sums[i], a < b)
        for n in np.flatnonzero(inside):
            out[n] = count_tokens(self.text[a[n] : b[n]])
        return out


def with_text(keys: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``text``: the symbol's lines in the current content of its path, '' where there are none.

    A content is cut into lines once, before the join; its symbols then take slices of the same array.
    """
    lines = current_files(files, ["path", "content"]).select("path", source_lines("content").alias("_lines"))
    return keys.join(lines, "path", "left").withColumn("text", symbol_text("_lines", "start_line", "end_line")).drop("_lines")


def over_symbols(keys: DataFrame, files: DataFrame, work: Callable[[FileTexts, pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame | None], added: str) -> DataFrame:
    """What ``work`` makes of symbol keys (with ``path, start_line, end_line`` and other columns) and the current content of their path.

    Contents and keys are laid out by path, each content ahead of its keys, and pass by once: a content is cut into atoms once for
    all of its symbols, no text is copied for them, and about ``CHUNK`` characters are held. A path with very many keys is spread, with
    its content. ``work`` gets contents, keys as they come and the spans of their texts; a key without file or lines has the empty text.
    """
    rest = [c for c in keys.columns if c != "path"]
    contents = current_files(files, ["path", "content"])
    one, copies = salted(keys, contents, ["path"])
    fields = [keys.schema[c] for c in keys.columns]
    blank = [F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in rest]
    rows = one.select("path", "_salt", *rest, F.lit(True).alias("_key"), F.lit(None).cast("string").alias("_content")).unionByName(copies.select("path", "_salt", *blank, F.lit(False).alias("_key"), F.col("content").alias("_content")))
    schema = T.StructType([*fields, *T.StructType.fromDDL(added).fields])
    columns, names = keys.columns, [f.name for f in schema.fields]

    def chunks(begins: np.ndarray, contents: list[str | None]) -> Iterator[tuple[int, int]]:
        lo, size = 0, 0
        for i, c in enumerate(contents):
            size += len(c or "")
            if size >= CHUNK or i + 1 == len(contents):
                yield lo, i + 1
                lo, size = i + 1, 0

    def pass_by(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str | None, str | None] = (None, None)
        for b in batches:
            path, is_key, content = b["path"].to_numpy(), b["_key"].to_numpy(), b["_content"].tolist()
            begins = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]) | ~is_key)
            contents = [content[i] if not is_key[i] else held[1] if held[0] == path[i] else None for i in begins]
            held = (path[-1], contents[-1])
            group = np.searchsorted(begins, np.arange(len(b)), side="right") - 1
            lines = b[["start_line", "end_line"]].apply(pd.to_numeric)
            known = lines.notna().all(axis=1).to_numpy()
            first, last = (lines[c].fillna(0).to_numpy(dtype=np.int64) for c in ("start_line", "end_line"))
            parts = []
            for lo, hi in chunks(begins, contents):
                at = np.flatnonzero((group >= lo) & (group < hi) & is_key)
                if len(at):
                    texts = FileTexts(contents[lo:hi])
                    done = work(texts, b[columns].iloc[at], *texts.spans(group[at] - lo, np.where(known[at], first[at], 1), np.where(known[at], last[at], 0)))
                    if done is not None and len(done):
                        parts.append(done)
            if parts:
                yield pd.concat(parts)[names]

    return rows.repartition("path", "_salt").sortWithinPartitions("path", "_salt", "_key").mapInPandas(pass_by, schema)


def limit_of(size_limits: DataFrame, name: str) -> tuple[int, int]:
    """``max_tokens`` and ``overlap_tokens`` of a named limit; a table of a few rows, of which one is read."""
    row = size_limits.filter(F.col("limit_name") == name).select("max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap")).orderBy("max_tokens").first()
    if row is None or row.max_tokens is None:
        raise ValueError(f"size_limits has no limit {name}")
    return int(row.max_tokens), int(row.overlap)
