"""Path, symbol and text search (F01-F08) and ranked retrieval.

Text search works inside each row: a content becomes an array of lines and the matching line is found there, so no line leaves its
row and nothing is shuffled but the final, limited order.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestone.functions.text import VECTOR_SIZE, split_lines
from lodestone.session import ensure_checkpoint_dir

# White space between the words of a vector, as in ``\\s`` of the SQL engine.
_BLANK = re.compile("[ \\t\\n\\x0b\\f\\r]+")
# Parameters of BM25 and of reciprocal rank fusion.
K1, B, FUSION = 1.2, 0.75, 60


def terms_of(query: str) -> list[str]:
    return query.split()


def _combine(tests: list[Column], strict: bool) -> Column:
    return reduce(and_ if strict else or_, tests) if tests else F.lit(False)


def like(column: Column | str, term: str, escape: bool = False) -> Column:
    """%term% without regard to case; % and _ in the term are wildcards unless escaped."""
    c = F.col(column) if isinstance(column, str) else column
    if escape:
        return F.lower(c).contains(term.lower())
    return F.lower(c).like(f"%{term.lower()}%".replace("\\", "\\\\"))


def files_like(files: DataFrame, query: str, strict: bool = False) -> DataFrame:
    """files whose path is like any (all, if strict) of the terms; none for an empty query."""
    return files.filter(_combine([like("path", t) for t in terms_of(query)], strict))


def symbols_like(symbols: DataFrame, query: str, strict: bool = False) -> DataFrame:
    """symbols whose name or qualified name is like any (all) of the terms."""
    return symbols.filter(_combine([like("name", t) | like("qualified_name", t) for t in terms_of(query)], strict))


def _patterns(query: str, regex: bool) -> list[str]:
    """Case-insensitive patterns of a query; invalid ones are dropped."""
    out = []
    for t in terms_of(query):
        p = t if regex else re.escape(t)
        try:
            re.compile(p)
        except re.error:
            continue
        out.append(f"(?i){p}")
    return out


# What makes a pattern see where a line begins or ends, or give up a match for what follows: anchors, groups other than (?:...) and possessive
# quantifiers. Escaped signs and character classes are taken out first.
_INERT = re.compile(r"\\[^AzZGR]|\[\^?\]?(?:[^\]\\]|\\.)*\]")
_LOOKS_AROUND = re.compile(r"[\^$]|\\[AzZGR]|\(\?(?!:)|[*+?}]\+|&&")


def matches_across_lines(pattern: str) -> bool:
    """Whether a text that holds a line which the pattern matches surely matches as a whole."""
    return not _LOOKS_AROUND.search(_INERT.sub("x", pattern.removeprefix("(?i)")))


def _may_hold(content: Column, patterns: list[str], strict: bool) -> Column:
    """A test of a whole content that no content with a matching line fails; it spares most files the split into lines."""
    sure = [p for p in patterns if matches_across_lines(p)]
    if not patterns:
        return F.lit(False)
    if len(sure) < len(patterns) and not strict:
        return content.isNotNull()
    return content.isNotNull() & (_combine([content.rlike(p) for p in sure], strict) if sure else F.lit(True))


def grep(files: DataFrame, query: str, regex: bool = False, strict: bool = False, limit: int | None = 100, column: str = "content") -> DataFrame:
    """the first line of each file that matches any (all) terms, with one line of context on either side.

    ``path, line, content, snippet``, ordered by path. Terms are literal unless ``regex``; a content that is null matches nothing.
    """
    return _first_lines(files, _patterns(query, regex), strict, limit, column)


def text_search(files: DataFrame, text: str, limit: int = 11, column: str = "content") -> DataFrame:
    """the first line of each file that holds a text literally, without regard to case."""
    return _first_lines(files, [f"(?i){re.escape(text)}"] if text.strip() else [], False, limit, column)


def _first_lines(files: DataFrame, patterns: list[str], strict: bool, limit: int | None, column: str) -> DataFrame:
    lines = F.col("_lines")
    candidates = files.filter(_may_hold(F.col(column), patterns, strict)).withColumn("_lines", split_lines(column))
    hit = F.filter(F.transform(lines, lambda x, i: F.when(_combine([x.rlike(p) for p in patterns], strict), i)), lambda i: i.isNotNull())
    found = candidates.withColumn("_at", F.try_element_at(hit, F.lit(1))).filter("_at is not null")

    def numbered(offset: int, mark: str) -> Column:
        i = F.col("_at") + offset + 1
        return F.when((i >= 1) & (i <= F.size(lines)), F.concat(F.lit(mark), F.lit("L"), i.cast("string"), F.lit(": "), F.try_element_at(lines, F.greatest(i, F.lit(1)))))

    snippet = F.concat_ws("\n", numbered(-1, "  "), numbered(0, "> "), numbered(1, "  "))
    out = found.select("path", (F.col("_at") + 1).alias("line"), F.try_element_at(lines, F.col("_at") + 1).alias("content"), snippet.alias("snippet"))
    return out.orderBy("path").limit(limit) if limit is not None else out


def may_match(files: DataFrame, query: str, regex: bool = False, strict: bool = False, column: str = "content") -> DataFrame:
    """Files whose content as a whole can hold a line that ``grep`` finds; a filter that needs no shuffle."""
    return files.filter(_may_hold(F.col(column), _patterns(query, regex), strict))


def grep_all(files: DataFrame, patterns: list[str], most: int = 500, column: str = "content") -> DataFrame:
    """every matching line once a pattern: ``path, line, content, pattern, truncated``.

    At most ``most`` rows by (path, line, pattern) come out; ``truncated`` says whether there were more.
    """
    valid = [p for p in patterns if _patterns(p, True)]
    lines = split_lines(column)
    wanted = files.filter(_may_hold(F.col(column), valid, False))
    each = wanted.select("path", F.posexplode(lines).alias("at", "content")).select("path", (F.col("at") + 1).alias("line"), "content")
    rows = each.select("*", F.explode(F.array_compact(F.array(*[F.when(F.col("content").rlike(p), F.lit(p)) for p in valid]))).alias("pattern"))
    top = rows.orderBy("path", "line", "pattern").limit(most + 1)
    more = top.agg((F.count("*") > most).alias("truncated"))
    kept = top.orderBy("path", "line", "pattern").limit(most)
    return kept.withColumn("_one", F.lit(1)).join(F.broadcast(more.withColumn("_one", F.lit(1))), "_one").drop("_one")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _equals(word: str) -> Callable[[Column], Column]:
    return lambda w: w == word


def _term_counts(documents: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    words = words_of(F.coalesce(F.col(text), F.lit("")))
    return documents.select(key, words.alias("_w")).select(key, F.size("_w").alias("_n"), *[F.size(F.filter("_w", _equals(t))).alias(f"_t{i}") for i, t in enumerate(terms)])


def _query_words(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def _bm25_scores(rows: DataFrame, counted: DataFrame, key: str, n: int) -> DataFrame:
    """``key, score`` of those ``rows`` that hold one of n terms, by the statistics of all that are ``counted``; only one row of these travels."""
    stats = counted.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_mean"), *[F.sum((F.col(f"_t{i}") > 0).cast("bigint")).alias(f"_d{i}") for i in range(n)])
    joined = rows.withColumn("_one", F.lit(1)).join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one")

    def part(i: int) -> Column:
        idf = F.log(1 + (F.col("_docs") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        return idf * F.col(f"_t{i}") * (K1 + 1) / (F.col(f"_t{i}") + K1 * (1 - B + B * F.col("_n") / F.col("_mean")))

    return joined.filter(reduce(or_, [F.col(f"_t{i}") > 0 for i in range(n)])).select(key, F.round(reduce(lambda a, b: a + b, [part(i) for i in range(n)]), 6).alias("score"))


def bm25(documents: DataFrame, query: str, key: str = "doc_id", text: str = "text", k: int | None = 10) -> DataFrame:
    """K04, lexical arm: ``key, score`` of documents with a query word, best first, ties by key.

    Term counts are taken in the row. Null texts count as empty documents.
    """
    terms = _query_words(query)
    if not terms:
        return documents.select(key, F.lit(0.0).alias("score")).limit(0)
    # Only documents that hold a term as a part are counted again for their score.
    near = documents.filter(reduce(or_, [F.lower(text).contains(t) for t in terms]))
    scored = _bm25_scores(_term_counts(near, key, text, terms), _term_counts(documents, key, text, terms), key, len(terms))
    return scored.orderBy(F.desc("score"), key).limit(k) if k is not None else scored


def _similarity_to(query: str) -> Callable[[Column | str], Column] | None:
    """Cosine of a text's hashed word counts to those of the query, rounded; None for a query without words.

    A word's bucket is looked up once a batch; a vector exists only as the counts of the document at hand.
    """
    bucket = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % VECTOR_SIZE
    wanted = Counter(bucket(w) for w in query.lower().split())
    length = sum(n * n for n in wanted.values()) ** 0.5
    if not wanted:
        return None

    @F.pandas_udf(DoubleType())
    def similarity(texts: pd.Series) -> pd.Series:
        seen: dict[str, int] = {}
        out = []
        for t in texts:
            counts: dict[int, int] = {}
            for w, n in Counter(_BLANK.split(t.lower()) if t else ()).items():
                if w:
                    b = seen.get(w)
                    if b is None:
                        b = seen[w] = bucket(w)
                    counts[b] = counts.get(b, 0) + n
            product = sum(n * counts.get(b, 0) for b, n in wanted.items())
            out.append(product / (sum(n * n for n in counts.values()) ** 0.5 * length) if product else 0.0)
        return pd.Series(out, dtype="float64")

    return lambda text: F.round(similarity(text), 6)


def proxy_similarity(documents: DataFrame, query: str, key: str = "doc_id", text: str = "text", k: int | None = 10) -> DataFrame:
    """K04, vector arm: cosine of hashed word counts between each document and the query, best first, ties by key."""
    similarity = _similarity_to(query)
    if similarity is None:
        return documents.select(key, F.lit(0.0).alias("score")).limit(0)
    scored = documents.select(key, similarity(text).alias("score")).filter("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(k) if k is not None else scored


def hybrid(documents: DataFrame, query: str, key: str = "doc_id", text: str = "text", k: int = 10, depth: int = 100) -> DataFrame:
    """Both arms fused by reciprocal rank over their first ``depth`` hits, which is what the fusion is defined on; ``key, score``, ties by key.

    Each text is read once: its length, its counts of the query's words and its similarity are kept as a narrow row, from which the
    statistics and both arms follow.
    """
    from pyspark.sql import Window

    terms, similarity = _query_words(query), _similarity_to(query)
    if similarity is None:
        return documents.select(key, F.lit(0.0).alias("score")).limit(0)
    ensure_checkpoint_dir(documents.sparkSession)
    counts = [F.size(F.filter("_w", _equals(t))).alias(f"_t{i}") for i, t in enumerate(terms)]
    words = documents.select(key, words_of(F.coalesce(F.col(text), F.lit(""))).alias("_w"), similarity(text).alias("_sim"))
    counted = words.select(key, F.size("_w").alias("_n"), "_sim", *counts).checkpoint()

    def arm(hits: DataFrame) -> DataFrame:  # depth rows at most, so one task orders them
        top = hits.orderBy(F.desc("score"), key).limit(depth)
        return top.select(key, (1.0 / (FUSION + F.row_number().over(Window.orderBy(F.desc("score"), key)))).alias("part"))

    both = arm(counted.filter("_sim > 0").select(key, F.col("_sim").alias("score")))
    if terms:
        both = both.unionByName(arm(_bm25_scores(counted, counted, key, len(terms))))
    return both.groupBy(key).agg(F.round(F.sum("part"), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def unified(files: DataFrame, symbols: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Files, symbols and text lines for one query, as ``source, path, item, line``; ``semantic:`` asks the ranked arm only."""
    if query.startswith("semantic:"):
        hits = hybrid(files.select("path", "content"), query.removeprefix("semantic:").strip(), "path", "content", limit)
        return hits.select(F.lit("semantic").alias("source"), "path", F.col("score").cast("string").alias("item"), F.lit(0).alias("line"))
    f = files_like(files, query).orderBy("path").limit(limit).select(F.lit("file").alias("source"), "path", F.col("path").alias("item"), F.lit(0).alias("line"))
    s = symbols_like(symbols, query).orderBy("qualified_name", "path", "start_line").limit(limit).select(F.lit("symbol").alias("source"), "path", F.col("qualified_name").alias("item"), F.col("start_line").alias("line"))
    t = grep(files, query, limit=limit).select(F.lit("text").alias("source"), "path", F.col("content").alias("item"), "line")
    return f.unionByName(s).unionByName(t)
