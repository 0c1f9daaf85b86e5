"""Problem 7: texts that were cut before their end.

Every distinct text gives the features of its ending; the corpus gives four kinds of statistics, each over all distinct
texts: a vocabulary with its trie (known words and their proper prefixes), how often text starting like this reaches a full stop,
which lines and sorts of line are the last, and which lengths of a source are limits. Some endings are cut beyond doubt: a cut
mark, a broken character, a soft line break of a transfer, open braces, an open row of a table, a line of one letter. For all
others the evidence is weighed (``WEIGHTS``) and a text is cut whose evidence adds up to ``CUT``:

* ``prefix``: the final word is unknown and a proper prefix of known words (the trie); ``stump``: it is known, but also begins other words;
* ``limit``: the text's length is a limit of its source; ``unclosed``: its last line is of a sort that does not close texts;
* ``no_stop``: its final stretch has no full stop where stretches that begin alike nearly always have one;
* ``ellipsis``: it ends with dots that stand at no usual place; ``fence``: it ends in an open code block, on a line that does not close texts.

A text that ends with a full stop outside an open code block has no such evidence, nor has one that ends with a closing: a line that
many texts end with (greetings, "and so on ..."), if that is where its sort of line is found; texts at a limit have no say in
that. Null and empty texts are never cut; copies share their text's verdict; blanks and detached replacement characters at the end
don't count. Texts are told apart by 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.skew import skew_join
from lodestone.session import ensure_checkpoint_dir

#: Evidence of a cut; what adds up to ``CUT`` is enough.
WEIGHTS = {"prefix": 1.0, "no_stop": 1.0, "ellipsis": 1.0, "fence": 1.0, "limit": 0.5, "unclosed": 0.5, "stump": 0.25}
CUT = 1.0
#: A word is known from this many texts on.
KNOWN_TEXTS = 2
#: Stretches that begin alike: at least so many, and at least this share with a full stop.
HEADS, HEAD_SHARE = 8, 0.93
#: Texts that must share a last line for it to be a closing.
CLOSING_TEXTS = 3
#: Share of its occurrences at which a sort of line is the last one, for it to close texts.
CLOSES = 0.2
#: Longer lines are known by a hash.
SHOWN = 64
#: A length is a limit of its source if it has this multiple of the texts that lengths around it have; a round one needs three
#: texts at least, any other six standard deviations and four texts more than the mean.
LIMIT_TEXTS, LIMIT_FACTOR, LIMIT_REACH = 3, 4.0, 10
# Multiples of these are round lengths, as are powers of two and the numbers below them; 140 and 160 are those of short messages.
ROUND = (50, 140, 160)
#: Counts that a task holds before it hands them on.
HELD_COUNTS = 300_000

_ASCII_HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HUMP = re.compile(r"[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+(?![a-zß-öø-ÿ])|[^\W\d_]+")
_CLOSERS = r")\"'»”’*_`」』）\]"
_T = r"[^\W\d_぀-ヿ㐀-鿿가-힯]+|\d+|[぀-ヿ㐀-鿿가-힯]|[^\w\s]|_"
#: A stretch: where it starts (a line's start, a table's row), its first two tokens and its full stop. Stretches cover the whole text.
_STRETCH = re.compile(
    rf"(?:[^\S\n]*(\n)\s*|[^\S\n]+)?(\|)?(?:[>*#+•–—|\- \t]+|\d+[.)][ \t]+)?(?=({_T})?[^\S\n]*({_T})?)(?:[^\n.!?。！？]+|[.!?](?![{_CLOSERS}]*(?:\s|\Z)))*([.!?。！？]+[{_CLOSERS}]*)?"
)
_STOP = re.compile(rf"[.!?。！？][{_CLOSERS}]*$")
_WORD_MARKS = r"more|read more|show more|log clipped|clipped|message clipped|truncated|output truncated|cut|cut off|snip|snipped|continued|omitted|tbc|gekürzt|abgeschnitten|tronqué|coupé|truncado|cortado|recortado|以下略|省略|続く"
_MARK = re.compile(rf"(?:[\[(<{{]\s*(?:\.\.\.|…|(?:\w+ )?(?:{_WORD_MARKS})(?: \w+)?)[.…\s]*[\])>}}]|\b(?:read|show|view) more|continue reading|weiterlesen|lire la suite|leer más|ler mais|続きを読む)$", re.I)
_MARK_STARTS = re.compile(r"[\[(<{]|(?<!\w)(?:read|show|view) more$|continue reading$|weiterlesen$|lire la suite$|leer más$|ler mais$|続きを読む$", re.I)
_ELLIPSIS = ("…", "...", "&hellip;", "&#8230;", "&#x2026;")
_COMPLETE_CODE = re.compile(r"^return\b|[};)\]]$")
_CELL = re.compile(r"\|(?:\s*\([^()|]*\))?$")
_FENCE = re.compile(r"^\s*(?:```|~~~)", re.M)


def _clean_end(text: str) -> str:
    """Without blanks at the end, and without replacement characters that stand behind a blank there."""
    t = text.rstrip()
    while t.endswith("�") and (rest := t.rstrip("�"))[-1:].isspace():
        t = rest.rstrip()
    return t


def _last_word(line: str) -> str:
    """The letters that a line ends with; ideographs and syllables are no words."""
    at = len(line)
    while at and line[at - 1].isalpha() and not ("\u3040" <= line[at - 1] <= "\u30ff" or "\u3400" <= line[at - 1] <= "\u9fff" or "\uac00" <= line[at - 1] <= "\ud7af"):
        at -= 1
    return line[at:]


def _mark_at(line: str) -> int:
    """Where the cut mark starts that a line ends with; -1 if there is none."""
    if line[-1:] in "])>}":
        at = max(line.rfind(c) for c in "[(<{")
        return at if at >= 0 and _MARK.fullmatch(line, at) else -1
    m = _MARK.search(line, max(line.rfind(" ", 0, max(0, line.rfind(" "))), 0)) if line[-1:].isalpha() else None
    return m.start() if m else -1


def _sort(s: tuple[str, ...]) -> str:
    """Sort of a stretch: its first two tokens, numbers made equal; as a line's start, all rows of tables are one sort."""
    a, b = s[2], s[3]
    a, b = ("0" if a.isdigit() else a), ("0" if b.isdigit() else b)
    return f"{a} {b}" if b else a


def ending(text: str) -> tuple[dict, str, list[tuple[str, ...]], int] | None:
    """What a text's ending says by itself and the keys to look up; the cleaned text, its stretches, and from where on no word is learnt."""
    if not text or text.isspace():
        return None
    shown = text.rstrip()
    soft = shown[-1:] == "=" and shown[-2:-1].isalnum() and text[len(shown) :].lstrip("\r")[:1] == "\n"
    t = _clean_end(text)
    whole = t.rstrip("�")
    broken = len(whole) < len(t) and whole[-1:].isalnum()
    t = whole.rstrip()
    if not t:
        return None
    stretches = _STRETCH.findall("\n" + t)
    while stretches and not any(stretches[-1]):
        stretches.pop()
    last = t[t.rfind("\n") + 1 :].strip()
    # Writers forget closing fences, but not the braces of complete code.
    odd = ("```" in t or "~~~" in t) and len(_FENCE.findall(t)) % 2 == 1
    fence = odd and not _COMPLETE_CODE.search(last)
    brace = t.count("{") > t.count("}")
    row = last[:1] == "|" and not _CELL.search(last) and "\n|" in t[: -len(last)]
    letter = len(last) == 1 and last.isalpha() and last < "\u2e80" and len(t) > 1
    mark = _mark_at(last)
    dots = next((e for e in _ELLIPSIS if last.endswith(e)), "") if mark < 0 else ""
    bare = last[: len(last) - len(dots)].rstrip() if dots else last
    word = _last_word(bare)
    humps = _HUMP.findall(word)
    begins = len(stretches) - 1
    while begins > 0 and not stretches[begins][0]:
        begins -= 1
    final = stretches[-1] if stretches else ("",) * 5
    if dots and begins < len(stretches) - 1 and not final[2].strip("."):  # the dots alone are no stretch
        final = stretches[-2]
    head = _sort(final)
    sure = soft or broken or brace or mark >= 0 or row or letter
    out = {
        "certain": sure,
        "why": "transfer" if soft else "broken_character" if broken else "mark" if mark >= 0 else "open_block" if brace or row else "prefix" if letter else "",
        "fence": fence,
        "ellipsis": bool(dots),
        # A closing fence ends a text as a full stop does.
        "stopped": not dots and (_STOP.search(bare) is not None or (not odd and _FENCE.match(last) is not None)),
        "word": humps[-1] if humps else "",
        "head": head,
        "first": head.split(" ", 1)[0],
        "follows": len(stretches) - begins > 1,
        "line": last if len(last) <= SHOWN else f"{last[:SHOWN]}\n{hashlib.blake2b(last.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}",
        "row": "|" if stretches and stretches[begins][1] else _sort(stretches[begins]) if stretches else "",
    }
    # The last word is not learnt, nor is the one ahead of a mark.
    stop = len(t) - len(last) + mark if mark >= 0 else len(t) - len(last) + len(bare)
    learnt = t[:stop].rstrip(" .…([{<=")
    return out, t, stretches, len(learnt) - len(_last_word(learnt[learnt.rfind("\n") + 1 :]))


class Counts:
    """Statistics of texts, added up before they leave the task: (kind, key) -> [a, b]."""

    def __init__(self) -> None:
        self.words: Counter[str] = Counter()
        self.stretches: Counter[tuple[str, ...]] = Counter()
        self.moved: Counter[tuple[str, str, int]] = Counter()

    def __len__(self) -> int:
        return len(self.words) + len(self.stretches) + len(self.moved)

    def add(self, e: dict, t: str, stretches: list[tuple[str, ...]], learnt: int) -> None:
        """One text. Its last line and last stretch count by what is known of the ending; those of a text that is surely cut don't."""
        sure = e["certain"] or e["ellipsis"] or e["fence"]
        self.words.update(set((_ASCII_HUMP if t.isascii() else _HUMP).findall(t, 0, learnt)))
        self.stretches.update(stretches)
        if not stretches:
            return
        self.moved["row", e["row"], 1] -= 1
        self.moved["head", _sort(stretches[-1]), 0 if stretches[-1][4] else 1] -= 1
        if not sure:
            self.moved["row", e["row"], 0] += 1
            self.moved["head", e["head"], 0 if e["stopped"] else 1] += 1

    def rows(self) -> list[tuple[str, str, int, int]]:
        both: dict[tuple[str, str], list[int]] = {}
        slot = lambda kind, key: both.setdefault((kind, key), [0, 0])
        for s, n in self.stretches.items():
            key = _sort(s)
            if key:
                slot("head", key)[0 if s[4] else 1] += n
            if s[0]:
                slot("row", "|" if s[1] else key)[1] += n
        for (kind, key, at), n in self.moved.items():
            if key:
                slot(kind, key)[at] += n
        return [("word", w, n, 0) for w, n in self.words.items()] + [(kind, key, a, b) for (kind, key), (a, b) in both.items() if a or b]


_ENDING = "id bigint, mark bigint, certain boolean, why string, fence boolean, ellipsis boolean, stopped boolean, word string, head string, first string, follows boolean, line string, row string"
_STATISTIC = "kind string, key string, a bigint, b bigint"
_ENDS, _COUNTS = ([c.split()[0] for c in x.split(", ")] for x in (_ENDING, _STATISTIC))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over the texts: a row with the ending of each, and rows with the counts of all, added up before they leave."""
    counts = Counts()

    def frame(columns: list[str], rows: list[tuple]) -> pd.DataFrame:
        filled = dict(zip(columns, zip(*rows))) if rows else {}
        blank = [None] * len(rows)
        return pd.DataFrame({c: pd.Series(filled.get(c, blank), dtype=object) for c in (*_COUNTS, *_ENDS)})

    for b in batches:
        rows = []
        for i, mark, text in zip(b["id"], b["mark"], b["text"]):
            found = ending(text)
            if found is not None:
                counts.add(*found)
                rows.append(("end", i, mark, *found[0].values()))
        yield frame(["kind", *_ENDS], rows)
        if len(counts) > HELD_COUNTS:
            yield frame(_COUNTS, counts.rows())
            counts = Counts()
    if len(counts):
        yield frame(_COUNTS, counts.rows())


ID = ["id", "mark"]


def text_id(text: str = "text") -> list[Column]:
    """Two hashes of 64 bits that tell texts apart."""
    return [F.xxhash64(text).alias("id"), F.xxhash64(F.lit(1), text).alias("mark")]


def distinct_texts(documents: DataFrame) -> DataFrame:
    """``id, mark`` and ``text`` of every distinct text; copies meet on the map side first."""
    return documents.filter("text is not null and trim(text) != ''").select(*text_id(), "text").groupBy(*ID).agg(F.min("text").alias("text"))


def corpus_statistics(passed: DataFrame) -> DataFrame:
    """(kind, key, a, b) over all distinct texts, from what the pass over them gave; stretches also by their first token alone."""
    counted = passed.filter("kind <> 'end'").select("kind", "key", "a", "b")
    first = counted.filter("kind = 'head'").select(F.lit("first").alias("kind"), F.split_part("key", F.lit(" "), F.lit(1)).alias("key"), "a", "b")
    both = counted.unionByName(first).groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return both.filter((F.col("kind") != "word") | (F.col("a") >= KNOWN_TEXTS))  # rarer words are unknown ones


def prefix_nodes(statistics: DataFrame, asked: DataFrame) -> DataFrame:
    """The vocabulary's trie as a relation: proper prefixes of known words are nodes, with the words below them.

    Only nodes at depths that the words of ``asked`` have are made; n different depths take words of n (n + 1) / 2 letters at least.
    """
    depths = asked.agg(F.collect_set(F.length("word")).alias("depths"))  # one row
    known = statistics.filter(F.col("kind") == "word").crossJoin(F.broadcast(depths))
    node = F.explode(F.transform(F.filter("depths", lambda n: n < F.length("key")), lambda n: F.substring("key", F.lit(1), n)))
    return known.select(node.alias("key")).groupBy("key").agg(F.count("*").alias("a")).select(F.lit("node").alias("kind"), "key", "a", F.lit(0).cast("bigint").alias("b"))


def closing_lines(ends: DataFrame, limited: DataFrame) -> DataFrame:
    """Lines that texts end with, as statistics: ``a`` texts end with the line. Texts of ``limited`` and those surely cut have no say."""
    said = ends.filter((~F.col("certain") & ~F.col("fence")) | F.col("ellipsis")).filter(F.length("line") > 1).join(limited, ID, "left_anti")
    shared = said.groupBy(F.col("line").alias("key")).agg(F.count("*").alias("a")).filter(F.col("a") >= CLOSING_TEXTS)
    return shared.select(F.lit("line").alias("kind"), "key", "a", F.lit(0).cast("bigint").alias("b"))


def source_limits(lengths: DataFrame) -> DataFrame:
    """Lengths (source, unit, size) at which a source's texts pile up, from (source, unit, size, n)."""
    around = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-LIMIT_REACH, LIMIT_REACH)
    mean = (F.sum("n").over(around) - F.col("n")) / (2.0 * LIMIT_REACH)
    size = F.col("size")
    power = F.log2(size.cast("double")) % 1.0
    below = F.log2(size.cast("double") + 1) % 1.0
    is_round = reduce(or_, [size % n == 0 for n in ROUND], (power == 0) | (below == 0))
    high = F.when(is_round, F.col("n") >= LIMIT_TEXTS).otherwise(F.col("n") >= F.col("mean") + 6 * F.sqrt("mean") + 4)
    return lengths.withColumn("mean", mean).filter(high & (F.col("n") >= LIMIT_FACTOR * F.col("mean"))).select("source", "unit", "size")


def truncated(documents: DataFrame) -> DataFrame:
    """Verdicts: ``doc_id, source, cut, why``; every document once for each of its rows, source trimmed in lower case."""
    ensure_checkpoint_dir(documents.sparkSession)
    named = F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source")
    # Narrow tables, each read more than once below; texts are read for them once each and pass through Python once.
    shown = documents.select("doc_id", named, *text_id(), F.length("text").alias("chars"), F.octet_length("text").alias("bytes")).checkpoint()
    passed = distinct_texts(documents).mapInPandas(_read, f"{_STATISTIC}, {_ENDING}").checkpoint()
    ends = passed.filter("kind = 'end'").select(*_ENDS)
    pairs = shown.filter("chars > 0").groupBy("source", *ID).agg(F.max("chars").alias("chars"), F.max("bytes").alias("bytes"))
    sizes = pairs.select("source", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("size")) for u in ("chars", "bytes")])).alias("s"))
    limits = source_limits(sizes.groupBy("source", "s.unit", "s.size").agg(F.count("*").alias("n")))
    for unit in ("chars", "bytes"):
        pairs = skew_join(pairs, limits.filter(F.col("unit") == unit).select("source", F.col("size").alias(unit), F.lit(True).alias(f"at_{unit}")), ["source", unit])
    pairs = pairs.select("source", *ID, (F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False))).alias("at_limit")).checkpoint()

    open_ends = ends.filter(~F.col("certain") & (~F.col("stopped") | F.col("ellipsis") | F.col("fence")))
    statistics = corpus_statistics(passed).checkpoint()  # read for the trie and by all lookups
    facts = statistics.unionByName(prefix_nodes(statistics, open_ends)).unionByName(closing_lines(ends, pairs.filter("at_limit").select(*ID).distinct()))
    asked = open_ends.select(
        *ID, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in (("word", "word"), ("node", "word"), ("head", "head"), ("first", "first"), ("line", "line"), ("row", "row"))])).alias("q")
    )
    # Many texts end alike, so the keys are asked by a join that splits the frequent ones.
    told = skew_join(asked.select(*ID, "q.kind", "q.key").filter("key != ''"), facts, ["kind", "key"], "inner")
    pick = lambda k, c: F.coalesce(F.max(F.when(F.col("kind") == k, F.col(c))), F.lit(0)).alias(f"{k}_{c}")
    looked = told.groupBy(*ID).agg(*[pick(k, c) for k in ("word", "node", "head", "first", "line", "row") for c in "ab"])
    judged = open_ends.join(looked, ID, "left").na.fill(0).select(*ID, *evidence())
    sure = ends.filter("certain").select(*ID, *[F.lit(0.0).alias(c) for c in ("found", "unclosed")], "why")
    cut = pairs.join(judged.filter("found > 0 or unclosed > 0").unionByName(sure), ID)
    limit = F.when(F.col("at_limit"), F.lit(WEIGHTS["limit"])).otherwise(F.lit(0.0))
    score = F.col("found") + F.col("unclosed") + limit
    why = F.when(F.col("why") != "", F.col("why")).when(F.col("at_limit"), "limit")
    cut = cut.filter((score >= CUT) | (F.col("found") + F.col("unclosed") == 0)).select("source", *ID, why.alias("why"))
    # A text with very many copies is joined over many tasks.
    verdicts = skew_join(shown.select("doc_id", "source", *ID), cut, ["source", *ID])
    return verdicts.select("doc_id", "source", F.col("why").isNotNull().alias("cut"), "why")


def evidence() -> list[Column]:
    """Of a row with an open ending and what was looked up: ``found`` (weights but for limit and sort of line), ``unclosed``, ``why``."""
    c = F.col
    both = lambda k: c(f"{k}_a") + c(f"{k}_b")
    own = F.when(c("fence") | c("ellipsis"), 0).otherwise(1)  # what this text itself has added
    closes = (F.length("line") > 1) & (c("row_a") > own) & (c("row_a") - own >= CLOSES * (both("row") - own))
    closing = (c("line_a") >= CLOSING_TEXTS) & (c("line_a") >= CLOSES * (both("row")))
    # Stretches that begin alike, by two tokens where they are frequent enough, else by one; else any that follow a full stop.
    usual_stop = F.when(both("head") >= HEADS, c("head_a") >= HEAD_SHARE * both("head")).when(both("first") >= HEADS, c("first_a") >= HEAD_SHARE * both("first")).otherwise(c("follows"))
    open_ = ~closing & ~(c("stopped") & ~c("fence"))
    has = {
        "ellipsis": open_ & c("ellipsis"),
        "prefix": open_ & (c("word") != "") & (c("word_a") < KNOWN_TEXTS) & (c("node_a") > 0),
        "no_stop": open_ & ~c("ellipsis") & (usual_stop | (c("follows") & c("head").rlike(r"^\p{L}+$"))),
        "fence": open_ & c("fence") & ~c("stopped") & ~closes,
        "stump": open_ & (c("word_a") >= KNOWN_TEXTS) & (c("node_a") > 0),
    }
    names = {"ellipsis": "mark", "prefix": "prefix", "no_stop": "no_full_stop", "fence": "open_block"}
    why = F.coalesce(*[F.when(has[k], F.lit(n)) for k, n in names.items()], F.lit(""))
    weigh = lambda test, k: F.when(test, F.lit(WEIGHTS[k])).otherwise(F.lit(0.0))
    found = sum((weigh(has[k], k) for k in has), F.lit(0.0))
    # Of a sort that does not close texts: seldom the last line where it occurs.
    return [found.alias("found"), weigh(~c("stopped") & ~closes & ~closing, "unclosed").alias("unclosed"), why.alias("why")]
