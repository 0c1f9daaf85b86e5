"""All queries of the core over whole tables, each with the DuckDB SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.tokens import counter_udf, token_estimate
from lodestone.operators import extract, index, links, packets, search, stats, symbols
from lodestone.operators.current import among_current, current_files
from lodestone.schema import FILES, KINDS, table
from lodestone.session import ensure_checkpoint_dir
from lodestone.sources.ignore import ScanOptions, gitignore_rules, is_build_script, kept
from lodestone.streaming.incremental import event_windows, read_state, stream_actions, stream_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# ------------------------------------------------------------------------------------------------------------ SQL parts
_LINES = r"'[\n\x0B\f\r\x{85}\x{2028}\x{2029}]'"
_CUR = "cur AS (SELECT * FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, sha256 DESC) = 1)"
_SYM = f"""sym AS (SELECT path, qualified_name, start_line, end_line, max(CASE WHEN kind IN ({', '.join(f"'{k}'" for k in KINDS)}) THEN kind ELSE 'function' END) AS kind,
  max(name) AS name, max(signature) AS signature, max(enclosing_type) AS enclosing_type, max(access_level) AS access_level, max(doc_comment) AS doc_comment,
  max(estimated_tokens) AS estimated_tokens FROM symbols GROUP BY path, qualified_name, start_line, end_line)"""


def _t01(c: str) -> str:
    return rf"""(CASE WHEN {c} = '' THEN 0 WHEN {c} IS NOT NULL THEN greatest(1, len(regexp_extract_all({c}, '[a-zA-Z0-9]+|[\p{{P}}\p{{S}}]|\n|[\t\n\f\r\p{{Z}}]+'))
  + coalesce(list_sum(list_transform(regexp_extract_all({c}, '[a-zA-Z0-9]{{8,}}'), lambda w: len(w) // 4)), 0)) END)::BIGINT"""


def _in(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _base(c: str) -> str:
    return rf"regexp_replace(regexp_extract({c}, '([^/]+)$', 1), '\.[^.]*$', '')"


_EXT = r"lower(regexp_extract(path, '\.([^./]+)$', 1))"
_LANG = f"CASE WHEN {_EXT} IN ('kt', 'kts') THEN 'kotlin' ELSE {_EXT} END"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _files(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_files(table(s, d, "files"), list(columns) or ["path", "content"])


def _grepped(s: SparkSession, d: str, query_: str, regex: bool = False, strict: bool = False) -> DataFrame:
    """Current files that may match: all rows are filtered first, then told by key whether they are current."""
    rows = table(s, d, "files").select("path", "indexed_at", "sha256", "content")
    return among_current(search.may_match(rows, query_, regex, strict), rows)


def _symbols(s: SparkSession, d: str) -> DataFrame:
    return symbols.unique_symbols(table(s, d, "symbols"))


def _refs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "symbol_refs")


# ------------------------------------------------------------------------------------------------------- scalar functions
@query(f"SELECT doc_id, {_t01('text')} AS tokens FROM documents")
def token_estimate_documents(s: SparkSession, d: str) -> DataFrame:
    """T01 of every document."""
    return table(s, d, "documents").select("doc_id", token_estimate("text").alias("tokens"))


@query("SELECT doc_id, length(text) AS counted FROM documents")
def own_counter(s: SparkSession, d: str) -> DataFrame:
    """Another counter, here of characters, in place of the estimate."""
    return table(s, d, "documents").select("doc_id", counter_udf(len)("text").alias("counted"))


@query(f"WITH {_CUR} SELECT path, {_t01('content')} AS tokens FROM cur")
def token_estimate_files(s: SparkSession, d: str) -> DataFrame:
    """T01 of every current file."""
    return _files(s, d).select("path", token_estimate("content").alias("tokens"))


@query(f"WITH {_CUR} SELECT path, sha256(content) AS sha256, octet_length(encode(content))::BIGINT AS size_bytes FROM cur")
def content_hash(s: SparkSession, d: str) -> DataFrame:
    """T03, T04."""
    return _files(s, d).select("path", T.content_hash("content").alias("sha256"), T.byte_size("content").alias("size_bytes"))


@query(
    rf"""WITH {_CUR}, l AS (SELECT path, list_filter(list_transform(regexp_split_to_array(content, {_LINES}), lambda x: regexp_replace(x, '^[\t\p{{Z}}]+|[\t\p{{Z}}]+$', '', 'g')), lambda x: x <> '') AS ls FROM cur)
SELECT path, len(list_filter(ls, lambda x: starts_with(x, '//')))::INT AS doc_lines, len(list_filter(ls, lambda x: NOT starts_with(x, '//')))::INT AS code_lines FROM l"""
)
def line_metrics(s: SparkSession, d: str) -> DataFrame:
    """T05, T06."""
    return _files(s, d).select("path", T.line_metrics("content").alias("m")).select("path", "m.*")


@query(
    f"""WITH p AS (SELECT DISTINCT path FROM files WHERE path IS NOT NULL), l AS (SELECT path, {_LANG} AS language FROM p)
SELECT path, language, CASE WHEN language IN ('swift', 'kotlin', 'java', 'html', 'css', 'json') THEN language WHEN language = 'js' THEN 'javascript' WHEN language = 'ts' THEN 'typescript'
  WHEN language = 'py' THEN 'python' WHEN language = 'md' THEN 'markdown' ELSE '' END AS fence FROM l"""
)
def path_language(s: SparkSession, d: str) -> DataFrame:
    """T07, T08."""
    p = table(s, d, "files").filter("path is not null").select("path").distinct()
    return p.select("path", T.language_of("path").alias("language"), T.fence_of("path").alias("fence"))


@query(
    f"""WITH {_CUR}, {_SYM}, l AS (SELECT path, regexp_split_to_array(content, {_LINES}) AS ls FROM cur)
SELECT s.path, qualified_name, start_line, end_line, name, CASE WHEN greatest(1, start_line) > least(len(ls), end_line) THEN '' ELSE coalesce(array_to_string(ls[greatest(1, start_line):end_line], chr(10)), '') END AS body
FROM sym s LEFT JOIN l USING (path)"""
)
def body_by_range(s: SparkSession, d: str) -> DataFrame:
    """T09, J02."""
    return symbols.symbol_bodies(table(s, d, "symbols"), table(s, d, "files"))


@query(
    f"""WITH {_SYM}, x AS (SELECT *, {_LANG} AS lang FROM sym), y AS (SELECT *, CASE lang WHEN 'swift' THEN len(string_split(qualified_name, '.')) - 1
  WHEN 'kotlin' THEN CASE WHEN coalesce(enclosing_type, '') = '' THEN 0 ELSE len(string_split(enclosing_type, '.')) END ELSE 0 END AS depth FROM x),
z AS (SELECT path, start_line, end_line, qualified_name, CASE WHEN lang = 'swift' AND coalesce(doc_comment, '') <> '' THEN repeat('  ', depth) || '/// ' || replace(doc_comment, chr(10), chr(10) || repeat('  ', depth) || '/// ') || chr(10) ELSE '' END
  || repeat('  ', depth) || coalesce(signature, name, '') || ' [L' || start_line || '-L' || end_line || ']' AS line FROM y)
SELECT path, string_agg(line, chr(10) ORDER BY start_line, end_line, qualified_name, line) AS outline, count(*) AS symbols FROM z GROUP BY path"""
)
def outline(s: SparkSession, d: str) -> DataFrame:
    """T10-T12, K08."""
    return packets.outlines(_symbols(s, d))


@query(r"SELECT DISTINCT name, regexp_replace(regexp_replace(name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^`(.*)`$', '\1') AS cleaned FROM symbols")
def clean_identifier(s: SparkSession, d: str) -> DataFrame:
    """T13."""
    return table(s, d, "symbols").select("name").distinct().select("name", T.clean_identifier("name").alias("cleaned"))


@query(
    rf"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE length(w) > 3 AND w NOT IN ({_in(T.TOPIC_STOP_WORDS)}) GROUP BY ALL), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) = 1)
SELECT d.doc_id, coalesce(w, 'General') AS topic FROM documents d LEFT JOIN b USING (doc_id)"""
)
def main_topic(s: SparkSession, d: str) -> DataFrame:
    """T14, A05."""
    return stats.main_topics(table(s, d, "documents"))


@query(
    r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, round(10.0 * len(list_distinct(ws)) / greatest(1, len(ws)) + length(text) / 5000.0, 6)::DOUBLE AS complexity FROM w"""
)
def complexity(s: SparkSession, d: str) -> DataFrame:
    """T15, A06."""
    return table(s, d, "documents").select("doc_id", F.round(T.complexity("text"), 6).alias("complexity"))


@query(f"WITH {_CUR} SELECT path, substr(content, 1, 2000) AS head FROM cur")
def content_prefix(s: SparkSession, d: str) -> DataFrame:
    """T20."""
    return _files(s, d).select("path", T.content_prefix("content").alias("head"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM documents")
def html_escape(s: SparkSession, d: str) -> DataFrame:
    """T22."""
    return table(s, d, "documents").select("doc_id", T.html_escape("text").alias("html"))


@query(
    r"""WITH p AS (SELECT DISTINCT path FROM files WHERE path IS NOT NULL) SELECT path, concat_ws(' / ', list_filter(string_split(path, '/'), lambda x: x NOT IN ('Sources', 'Tests', ''))[1], regexp_extract(path, '([^/]+)$', 1)) AS title FROM p"""
)
def module_title(s: SparkSession, d: str) -> DataFrame:
    """T23."""
    return table(s, d, "files").filter("path is not null").select("path").distinct().select("path", T.module_title("path").alias("title"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[\n\x0B\f\r\x{85}\x{2028}\x{2029}]')) AS x, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[\n\x0B\f\r\x{85}\x{2028}\x{2029}]'), 1) AS i FROM documents),
f AS (SELECT * FROM l WHERE contains(lower(x), 'error:') OR contains(lower(x), 'failed') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 10), g AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS failures FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(failures, 'No obvious failures found in log.') AS failures FROM documents d LEFT JOIN g USING (doc_id)"""
)
def failure_lines(s: SparkSession, d: str) -> DataFrame:
    """T18."""
    return packets.failure_lines(table(s, d, "documents"))


# ------------------------------------------------------------------------------------------------------------- extraction
def _regex_sql() -> str:
    parts = []
    for exts, patterns in extract.PATTERNS.items():
        for kind, p in patterns.items():
            two = kind == "function" and "js" in exts
            name = f"coalesce(nullif(regexp_extract(x, '{p}', 2), ''), regexp_extract(x, '{p}', 1))" if two else f"regexp_extract(x, '{p}', 1)"
            parts.append(f"SELECT path, i, x, '{kind}' AS kind, {extract.KIND_ORDER.index(kind)} AS o, {name} AS name FROM l WHERE e IN ({_in(exts)}) AND regexp_matches(x, '{p}')")
    return rf"""WITH {_CUR}, l AS (SELECT path, {_EXT} AS e, unnest(regexp_split_to_array(content, {_LINES})) AS x, generate_subscripts(regexp_split_to_array(content, {_LINES}), 1) AS i FROM cur),
m AS ({' UNION ALL '.join(parts)}), u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY path, i, name ORDER BY o) = 1)
SELECT path, kind, name, regexp_replace(x, '^[\t\p{{Z}}]+|[\t\p{{Z}}]+$', '', 'g') AS signature, i::INT AS line, {_t01('x')} AS tokens FROM u"""


@query(_regex_sql())
def regex_symbols(s: SparkSession, d: str) -> DataFrame:
    """X03-X07."""
    return extract.regex_symbols(_files(s, d))


@query()
def swift_symbols(s: SparkSession, d: str) -> DataFrame:
    """X09; tested on fixtures and against the given symbols."""
    return extract.scanned_symbols(_files(s, d).filter(T.extension("path") == "swift"))


@query()
def kotlin_symbols(s: SparkSession, d: str) -> DataFrame:
    """X10."""
    return extract.scanned_symbols(_files(s, d).filter(T.extension("path").isin("kt", "kts")))


@query(
    rf"""WITH {_CUR}, l AS (SELECT path, unnest(regexp_split_to_array(content, {_LINES})) AS x, generate_subscripts(regexp_split_to_array(content, {_LINES}), 1) AS i FROM cur WHERE {_EXT} IN ('kt', 'kts')),
m AS (SELECT path, i, x, 'class' AS kind, 0 AS o, regexp_extract(x, '\bclass\s+([a-zA-Z0-9_]+)', 1) AS name FROM l UNION ALL SELECT path, i, x, 'interface', 1, regexp_extract(x, '\binterface\s+([a-zA-Z0-9_]+)', 1) FROM l UNION ALL SELECT path, i, x, 'function', 2, regexp_extract(x, '\bfun\s+([a-zA-Z0-9_]+)', 1) FROM l),
u AS (SELECT * FROM m WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY path, i, name ORDER BY o) = 1)
SELECT path, kind, name, regexp_replace(x, '^[\t\p{{Z}}]+|[\t\p{{Z}}]+$', '', 'g') AS signature, i::INT AS line, {_t01('x')} AS tokens FROM u""".replace("\\\\", "\\")
)
def kotlin_line_symbols(s: SparkSession, d: str) -> DataFrame:
    """X11."""
    return extract.kotlin_line_symbols(_files(s, d))


_SCANNED = "WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('swift', 'kt', 'kts')"


@query(f"SELECT DISTINCT path, qualified_name, start_line, end_line FROM symbols {_SCANNED} AND kind IS DISTINCT FROM 'file'")
def recorded_declarations(s: SparkSession, d: str) -> DataFrame:
    """X09, X10 against the recorded symbols: every recorded key is found in the text. Kinds are not compared, as the table misstates some
    and calls functions of classes named ...TestsError tests; constants outside types, which it leaves out, are found besides."""
    found = extract.scanned_symbols(_files(s, d)).select("path", "qualified_name", "start_line", "end_line")
    return found.join(table(s, d, "symbols").select(*found.columns).distinct(), found.columns, "left_semi")


@query(f"SELECT DISTINCT path, name, start_line FROM symbol_refs {_SCANNED} AND name IS NOT NULL")
def recorded_calls(s: SparkSession, d: str) -> DataFrame:
    """References of X09 and X10 against the recorded ones, which hold calls only: every one of these is found in the text."""
    found = extract.scanned_references(_files(s, d)).select("path", "name", "start_line").distinct()
    return found.join(_refs(s, d).select("path", "name", "start_line").distinct(), ["path", "name", "start_line"], "left_semi")


@query()
def scanned_references(s: SparkSession, d: str) -> DataFrame:
    """References of X09 and X10, counted by file, name and context."""
    return extract.scanned_references(_files(s, d)).groupBy("path", "name", "context").agg(F.count("*").alias("uses"))


@query(
    f"""WITH x AS ({SQL['regex_symbols']}), {_CUR}, b AS (SELECT path, coalesce(content, '') AS content FROM cur ANTI JOIN x USING (path) WHERE {_EXT} NOT IN ('swift', 'kt', 'kts'))
SELECT path, 'file' AS kind, path AS name, path AS qualified_name, 'File: ' || path AS signature, NULL::VARCHAR AS enclosing_type, NULL::VARCHAR AS access_level, 1 AS start_line,
  len(regexp_split_to_array(content, {_LINES}))::INT AS end_line, NULL::VARCHAR AS doc_comment, {_t01('content')}::INT AS estimated_tokens FROM b"""
)
def file_fallback(s: SparkSession, d: str) -> DataFrame:
    """Files of languages without a scanner of which no line declares anything."""
    files = _files(s, d).filter(~T.extension("path").isin("swift", "kt", "kts"))
    return extract.file_fallback(files, extract.regex_symbols(files))


@query(
    f"""WITH x AS ({SQL['regex_symbols']}), f AS ({SQL['file_fallback']}) SELECT path, kind, name, name AS qualified_name, signature, line AS start_line, line AS end_line, tokens::INT AS estimated_tokens FROM x
UNION ALL SELECT path, kind, name, qualified_name, signature, start_line, end_line, estimated_tokens FROM f"""
)
def extracted_symbols(s: SparkSession, d: str) -> DataFrame:
    """Symbols of all files that are routed to line patterns or to the fallback."""
    found, _ = extract.extract(_files(s, d).filter(~T.extension("path").isin("swift", "kt", "kts")))
    return found.select("path", "kind", "name", "qualified_name", "signature", "start_line", "end_line", "estimated_tokens")


# ------------------------------------------------------------------------------------------------------------------ search
@query(f"WITH {_CUR} SELECT path, language FROM cur WHERE lower(path) LIKE '%registry%' OR lower(path) LIKE '%cache%'")
def files_like_any(s: SparkSession, d: str) -> DataFrame:
    """F01."""
    return search.files_like(_files(s, d, "path", "language"), "Registry cache")


@query(f"WITH {_CUR} SELECT path, language FROM cur WHERE lower(path) LIKE '%registry%' AND lower(path) LIKE '%auth%'")
def files_like_all(s: SparkSession, d: str) -> DataFrame:
    """F01, strict."""
    return search.files_like(_files(s, d, "path", "language"), "Registry auth", strict=True)


@query(f"WITH {_SYM} SELECT path, qualified_name, start_line, end_line, kind FROM sym WHERE lower(name) LIKE '%merge%' OR lower(qualified_name) LIKE '%merge%' OR lower(name) LIKE '%index%' OR lower(qualified_name) LIKE '%index%'")
def symbols_like_any(s: SparkSession, d: str) -> DataFrame:
    """F02."""
    return search.symbols_like(_symbols(s, d), "merge Index").select("path", "qualified_name", "start_line", "end_line", "kind")


@query(f"WITH {_SYM} SELECT path, qualified_name, start_line, end_line, kind FROM sym WHERE (lower(name) LIKE '%r_s%' OR lower(qualified_name) LIKE '%r_s%') AND (lower(name) LIKE '%lo%ed%' OR lower(qualified_name) LIKE '%lo%ed%')")
def symbols_like_wildcards(s: SparkSession, d: str) -> DataFrame:
    """strict, with wildcards in the terms."""
    return search.symbols_like(_symbols(s, d), "R_s lo%ed", strict=True).select("path", "qualified_name", "start_line", "end_line", "kind")


@query(f"WITH {_SYM} SELECT path, qualified_name, start_line, end_line, signature FROM sym WHERE name = 'init'")
def exact_symbol(s: SparkSession, d: str) -> DataFrame:
    """F04."""
    return _symbols(s, d).filter(F.col("name") == "init").select("path", "qualified_name", "start_line", "end_line", "signature")


def _grep_sql(test: str, limit: int) -> str:
    return f"""WITH {_CUR}, l AS (SELECT path, unnest(regexp_split_to_array(content, {_LINES})) AS x, generate_subscripts(regexp_split_to_array(content, {_LINES}), 1) AS i FROM cur),
h AS (SELECT path, min(i) AS i FROM l WHERE {test} GROUP BY path ORDER BY path LIMIT {limit}), k AS (SELECT path, regexp_split_to_array(content, {_LINES}) AS ls FROM cur)
SELECT path, i::INT AS line, ls[i] AS content, concat_ws(chr(10), CASE WHEN i > 1 THEN '  L' || (i - 1) || ': ' || ls[i - 1] END, '> L' || i || ': ' || ls[i], CASE WHEN i < len(ls) THEN '  L' || (i + 1) || ': ' || ls[i + 1] END) AS snippet
FROM h JOIN k USING (path)"""


@query(_grep_sql("regexp_matches(x, '(?i)oldest') OR regexp_matches(x, '(?i)budget\\.')", 100))
def grep_any(s: SparkSession, d: str) -> DataFrame:
    """literal terms, any of them."""
    return search.grep(_grepped(s, d, "oldest budget."), "oldest budget.")


@query(_grep_sql("regexp_matches(x, '(?i)return') AND regexp_matches(x, '(?i)value')", 100))
def grep_strict(s: SparkSession, d: str) -> DataFrame:
    """all terms on one line."""
    return search.grep(_grepped(s, d, "return Value", strict=True), "return Value", strict=True)


@query(_grep_sql("regexp_matches(x, '(?i)lock[A-Z][a-z]+\\(') OR regexp_matches(x, '(?i)^class')", 100))
def grep_regex(s: SparkSession, d: str) -> DataFrame:
    """regular expressions, an invalid one dropped."""
    terms = r"lock[A-Z][a-z]+\( ([ ^class"
    return search.grep(_grepped(s, d, terms, regex=True), terms, regex=True)


@query(_grep_sql("regexp_matches(x, '(?i)guard let')", 11))
def text_search(s: SparkSession, d: str) -> DataFrame:
    """first line with a literal text, eleven files at most."""
    return search.text_search(_grepped(s, d, "guard"), "guard let")


@query(
    f"""WITH {_CUR}, l AS (SELECT path, unnest(regexp_split_to_array(content, {_LINES})) AS x, generate_subscripts(regexp_split_to_array(content, {_LINES}), 1) AS i FROM cur), p AS (SELECT unnest(['freeze\\w+Owner', 'trace\\(']) AS p),
m AS (SELECT path, i::INT AS line, x AS content, p AS pattern FROM l, p WHERE regexp_matches(x, p)), t AS (SELECT *, count(*) OVER () > 500 AS truncated, row_number() OVER (ORDER BY path, line, pattern) AS rn FROM m)
SELECT path, line, content, pattern, truncated FROM t WHERE rn <= 500"""
)
def grep_all(s: SparkSession, d: str) -> DataFrame:
    """every line for each pattern, 500 rows at most, with a flag for more."""
    return search.grep_all(_grepped(s, d, r"freeze\w+Owner trace\(", regex=True), [r"freeze\w+Owner", r"trace\("])


@query(
    f"""WITH {_CUR}, {_SYM}, l AS (SELECT path, unnest(regexp_split_to_array(content, {_LINES})) AS x, generate_subscripts(regexp_split_to_array(content, {_LINES}), 1) AS i FROM cur),
h AS (SELECT path, min(i) AS i, min_by(x, i) AS x FROM l WHERE regexp_matches(x, '(?i)ledger') GROUP BY path ORDER BY path LIMIT 100)
SELECT * FROM (SELECT 'file' AS source, path, path AS item, 0 AS line FROM cur WHERE lower(path) LIKE '%ledger%' ORDER BY path LIMIT 100)
UNION ALL SELECT * FROM (SELECT 'symbol', path, qualified_name, start_line FROM sym WHERE lower(name) LIKE '%ledger%' OR lower(qualified_name) LIKE '%ledger%' ORDER BY qualified_name, path, start_line, end_line LIMIT 100)
UNION ALL SELECT 'text', path, x, i::INT FROM h"""
)
def unified_search(s: SparkSession, d: str) -> DataFrame:
    """F08, K05."""
    sym = _symbols(s, d)
    return search.unified(_files(s, d), sym, "ledger")


_BM25_TERMS = ("orphaned", "ledger", "retries")


def _bm25_sql(k: int) -> str:
    t = [f"len(list_filter(w, lambda x: x = '{x}'))" for x in _BM25_TERMS]
    idf = [f"ln(1 + (s.n - s.d{i} + 0.5) / (s.d{i} + 0.5))" for i in range(3)]
    parts = " + ".join(f"{idf[i]} * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * c.n / s.m))" for i in range(3))
    return rf"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, {', '.join(f'{x} AS t{i}' for i, x in enumerate(t))} FROM w), s AS (SELECT count(*) AS n, avg(n) AS m, {', '.join(f'sum((t{i} > 0)::INT) AS d{i}' for i in range(3))} FROM c),
bm AS (SELECT doc_id, round({parts}, 6) AS score FROM c, s WHERE t0 + t1 + t2 > 0 ORDER BY score DESC, doc_id LIMIT {k})"""


@query(f"WITH {_bm25_sql(20)} SELECT * FROM bm")
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    """K04, lexical."""
    return search.bm25(table(s, d, "documents"), " ".join(_BM25_TERMS), k=20)


_PROXY_SQL = r"""q AS (SELECT cast(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 128 AS b, count(*) AS n FROM (SELECT unnest(['orphaned', 'ledger', 'retries']) AS w) GROUP BY 1),
e AS (SELECT doc_id, cast(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 128 AS b, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
v AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM e GROUP BY doc_id), px AS (SELECT doc_id, round(sum(e.n * q.n) / (any_value(len) * (SELECT sqrt(sum(n * n)) FROM q)), 6) AS score FROM e JOIN q USING (b) JOIN v USING (doc_id) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {})"""


@query(f"WITH {_PROXY_SQL.format(20)} SELECT * FROM px")
def proxy_topk(s: SparkSession, d: str) -> DataFrame:
    """K04, hashed vectors."""
    return search.proxy_similarity(table(s, d, "documents"), " ".join(_BM25_TERMS), k=20)


@query(
    f"""WITH {_bm25_sql(100)}, {_PROXY_SQL.format(100)}, a AS (SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS p FROM bm UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM px)
SELECT doc_id, round(sum(p), 6) AS score FROM a GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10"""
)
def hybrid_rrf(s: SparkSession, d: str) -> DataFrame:
    """K04, both arms fused."""
    return search.hybrid(table(s, d, "documents"), " ".join(_BM25_TERMS))


@query(
    """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT q.vec_id AS query, e.vec_id AS item, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, item)::INT AS rank, item, score FROM p QUALIFY rank <= 5"""
)
def vector_topk(s: SparkSession, d: str) -> DataFrame:
    """K04 on stored vectors: nearest of every 50th vector among all, exactly."""
    e = table(s, d, "embeddings")
    return links.nearest_vectors(e, e.filter("vec_id % 50 = 0"))


@query(
    r"""WITH e AS (SELECT doc_id, cast(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 128 AS b, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
v AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM e GROUP BY doc_id), p AS (SELECT a.doc_id AS source, b.doc_id AS target, round(sum(a.n * b.n) / (any_value(va.len) * any_value(vb.len)), 6) AS s
FROM e a JOIN e b ON a.b = b.b AND a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id JOIN v va ON va.doc_id = a.doc_id JOIN v vb ON vb.doc_id = b.doc_id GROUP BY ALL),
l AS (SELECT * FROM p WHERE s >= 0.3), g AS (SELECT source, count(*) AS links, min_by(target, (-s, target)) AS target, max(s) AS strength FROM l GROUP BY source)
SELECT d.doc_id AS source, coalesce(links, 0) AS links, target, strength FROM documents d LEFT JOIN g ON g.source = d.doc_id WHERE d.doc_id % 50 = 0"""
)
def semantic_links(s: SparkSession, d: str) -> DataFrame:
    """Links of every 50th document to all documents."""
    docs = table(s, d, "documents").select("doc_id", "text")
    return links.link_counts(docs, docs.filter("doc_id % 50 = 0"), "doc_id", "text")


# ------------------------------------------------------------------------------------------------------------------- joins
@query("""WITH r AS (SELECT name, count(*) AS r FROM symbol_refs GROUP BY name), s AS (SELECT name, count(*) AS n FROM sym GROUP BY name) SELECT name, r AS "references", n AS definitions, r * n AS joined FROM r JOIN s USING (name)""".replace("WITH r", f"WITH {_SYM}, r"))
def definitions_referenced(s: SparkSession, d: str) -> DataFrame:
    """J01."""
    return symbols.definitions_referenced(_symbols(s, d), _refs(s, d))


@query(f"WITH {_SYM}, r AS (SELECT name, count(*) AS n FROM symbol_refs GROUP BY name) SELECT path, qualified_name, start_line, end_line, coalesce(n, 0) AS ref_count FROM sym LEFT JOIN r USING (name)")
def reference_counts(s: SparkSession, d: str) -> DataFrame:
    """J08, A04."""
    return symbols.reference_counts(_symbols(s, d), _refs(s, d)).select("path", "qualified_name", "start_line", "end_line", "ref_count")


@query(
    f"""WITH {_SYM} SELECT r.name, count(*) AS count FROM symbol_refs r JOIN sym s ON s.name = r.name WHERE s.kind IN ({_in(symbols.RANKED_KINDS)}) AND r.name NOT IN ({_in(symbols.PRIMITIVES)})
GROUP BY r.name ORDER BY count DESC, r.name LIMIT 20"""
)
def top_referenced(s: SparkSession, d: str) -> DataFrame:
    """A03, F13."""
    return symbols.top_referenced(_symbols(s, d), _refs(s, d))


_CALLABLE = ("function", "method", "initializer", "constructor", "test")


@query(
    f"""WITH {_SYM} SELECT r.name, count(*) AS count FROM symbol_refs r JOIN sym s ON s.name = r.name WHERE s.kind IN ({_in(_CALLABLE)}) AND r.name NOT IN ({_in(symbols.PRIMITIVES)})
GROUP BY r.name ORDER BY count DESC, r.name LIMIT 20"""
)
def top_referenced_callables(s: SparkSession, d: str) -> DataFrame:
    """A03, F13 for functions, to which the recorded references point."""
    return symbols.top_referenced(_symbols(s, d), _refs(s, d), kinds=_CALLABLE)


@query("SELECT path, start_line, end_line, context FROM symbol_refs WHERE name = 'trace'")
def references_of_name(s: SparkSession, d: str) -> DataFrame:
    """All references to the most used name."""
    return symbols.references_of(_refs(s, d), "trace").select("path", "start_line", "end_line", "context")


@query(f"WITH {_SYM} SELECT path, qualified_name, start_line, end_line, kind FROM sym WHERE kind NOT IN ('file', 'test') AND (name IS NULL OR name NOT IN (SELECT name FROM symbol_refs WHERE name IS NOT NULL))")
def unused_symbols(s: SparkSession, d: str) -> DataFrame:
    """A12."""
    return symbols.unused_symbols(_symbols(s, d), _refs(s, d)).select("path", "qualified_name", "start_line", "end_line", "kind")


@query(f"WITH {_SYM} SELECT path, qualified_name, start_line, end_line FROM sym WHERE path IN (SELECT path FROM files WHERE starts_with(path, 'velvet-falcon-0/'))")
def symbols_under_prefix(s: SparkSession, d: str) -> DataFrame:
    """J04, F11."""
    return symbols.symbols_under(_symbols(s, d), table(s, d, "files"), "velvet-falcon-0/").select("path", "qualified_name", "start_line", "end_line")


@query(f"WITH {_CUR} SELECT r.path, r.name, r.start_line, count(*) AS uses, any_value(c.path IS NOT NULL) AS indexed FROM symbol_refs r LEFT JOIN cur c USING (path) GROUP BY r.path, r.name, r.start_line")
def references_with_file(s: SparkSession, d: str) -> DataFrame:
    """J03."""
    used = _refs(s, d).groupBy("path", "name", "start_line").agg(F.count("*").alias("uses"))
    known = table(s, d, "files").select("path").distinct().withColumn("_there", F.lit(True))
    return used.join(known, "path", "left").select("path", "name", "start_line", "uses", F.col("_there").isNotNull().alias("indexed"))


@query(
    f"""WITH {_SYM}, r AS (SELECT path, name, start_line, end_line, count(*) AS n FROM symbol_refs WHERE path IS NOT NULL GROUP BY ALL)
SELECT r.path, r.name, r.start_line, r.end_line, r.n AS "references", s.qualified_name AS context FROM r LEFT JOIN sym s ON s.path = r.path AND s.start_line <= r.start_line AND s.end_line >= r.end_line AND s.start_line <= s.end_line
QUALIFY row_number() OVER (PARTITION BY r.path, r.name, r.start_line, r.end_line ORDER BY s.end_line - s.start_line, -length(s.qualified_name), s.qualified_name) = 1"""
)
def containment_context(s: SparkSession, d: str) -> DataFrame:
    """J09."""
    return symbols.enclosing_symbol(_refs(s, d), _symbols(s, d))


@query(
    f"""WITH {_SYM}, t AS (SELECT DISTINCT path, qualified_name AS q, start_line AS a, end_line AS b FROM sym WHERE kind IN ('class', 'struct', 'actor', 'enum', 'protocol', 'interface', 'extension', 'object', 'companion', 'dataClass', 'sealedClass', 'valueClass'))
SELECT s.path, s.qualified_name, s.start_line, s.end_line, coalesce(string_agg(q, ' > ' ORDER BY a, a - b, q), '') AS containers FROM sym s
LEFT JOIN t ON t.path = s.path AND a <= s.start_line AND b >= s.end_line AND (a <> s.start_line OR q <> s.qualified_name) GROUP BY ALL"""
)
def enclosing_types(s: SparkSession, d: str) -> DataFrame:
    """J09 for symbols."""
    return symbols.enclosing_types(_symbols(s, d))


_CARTS = "carts AS (SELECT DISTINCT name AS stage, split_part(i.path, '::', -1) AS path FROM (SELECT name, unnest(items) AS i FROM packs))"


def _carts(s: SparkSession, d: str) -> DataFrame:
    return packets.pack_items(table(s, d, "packs")).select(F.col("pack").alias("stage"), F.split_part("path", F.lit("::"), F.lit(-1)).alias("path")).distinct()


_CRAWL = f"""{_SYM}, {_CARTS}, n AS (SELECT DISTINCT stage, c.path AS f, r.name FROM carts c JOIN symbol_refs r USING (path)), x AS (SELECT stage, s.path, min(n.name) AS m FROM n JOIN sym s ON s.qualified_name = n.name AND s.path <> f GROUP BY ALL)"""


@query(f"WITH {_CRAWL} SELECT stage, path, 'Defines ' || m AS reason FROM x")
def dependency_crawl(s: SparkSession, d: str) -> DataFrame:
    """J05, for the files of every pack."""
    return symbols.dependency_crawl(_carts(s, d), _refs(s, d), _symbols(s, d))


@query(f"WITH {_CRAWL} SELECT stage, path, 'Defines ' || m AS reason FROM x ANTI JOIN carts USING (stage, path)")
def auto_expand(s: SparkSession, d: str) -> DataFrame:
    """J06."""
    return symbols.auto_expand(_carts(s, d), _refs(s, d), _symbols(s, d))


@query(
    f"""WITH {_SYM}, f AS (SELECT *, row_number() OVER (PARTITION BY qualified_name ORDER BY path, start_line, end_line, kind, signature) AS rn FROM sym)
SELECT r.name AS qualified_name, count(*)::DOUBLE AS score, any_value(f.path) AS path, any_value(f.start_line) AS start_line, any_value(f.end_line) AS end_line, any_value(f.kind) AS kind, any_value(f.signature) AS signature
FROM symbol_refs r JOIN f ON f.qualified_name = r.name AND rn = 1 GROUP BY r.name"""
)
def live_symbols(s: SparkSession, d: str) -> DataFrame:
    """Names as hits, scored by their references; names that no symbol bears are stale."""
    hits = _refs(s, d).filter("name is not null").groupBy(F.col("name").alias("qualified_name")).agg(F.count("*").cast("double").alias("score"))
    return symbols.live_symbols(hits, _symbols(s, d))


_MID = "SELECT quantile_disc(indexed_at, 0.5) AS t FROM files"
_SNAP = f"""mid AS ({_MID}), a AS (SELECT path, sha256 FROM files WHERE indexed_at <= (SELECT t FROM mid) QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, sha256 DESC) = 1), {_CUR},
j AS (SELECT path, CASE WHEN cur.path IS NULL THEN 'removed' WHEN a.path IS NULL THEN 'added' WHEN coalesce(a.sha256, '') = coalesce(cur.sha256, '') THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN cur USING (path))"""


def _changes(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "files")
    mid = files.selectExpr("percentile_disc(0.5) within group (order by unix_micros(cast(indexed_at as timestamp))) as t").first()[0]
    at = F.timestamp_micros(F.lit(int(mid))).cast("timestamp_ntz")
    before = current_files(files.filter(F.col("indexed_at") <= at), ["path", "sha256"])
    return index.diff(before, current_files(files, ["path", "sha256"]))


@query(f"WITH {_SNAP} SELECT path, status FROM j")
def incremental_diff(s: SparkSession, d: str) -> DataFrame:
    """The index of half time against the present."""
    return _changes(s, d)


@query(f"WITH {_SNAP} SELECT count(*) FILTER (status IN ('added', 'changed')) AS updated, count(*) FILTER (status = 'unchanged') AS skipped, count(*) FILTER (status = 'removed') AS removed FROM j")
def index_counters(s: SparkSession, d: str) -> DataFrame:
    """A08."""
    return index.run_counters(_changes(s, d))


@query(f"WITH {_SNAP}, {_SYM} SELECT s.path, count(*) AS symbols FROM sym s ANTI JOIN a USING (path) GROUP BY s.path")
def stale_symbols(s: SparkSession, d: str) -> DataFrame:
    """Symbols of paths that the index of half time does not hold."""
    held = _changes(s, d).filter("status in ('unchanged', 'changed')").select("path")
    return _symbols(s, d).join(held, "path", "left_anti").groupBy("path").agg(F.count("*").alias("symbols"))


# ------------------------------------------------------------------------------------------------------------------- stats
@query(f"WITH {_CUR}, {_SYM} SELECT count(*) AS files, sum(size_bytes)::BIGINT AS size_bytes, sum(doc_lines)::BIGINT AS doc_lines, sum(code_lines)::BIGINT AS code_lines, (SELECT count(*) FROM sym) AS symbols FROM cur")
def repo_stats(s: SparkSession, d: str) -> DataFrame:
    """A01."""
    return stats.repo_stats(_files(s, d, "path", "size_bytes", "doc_lines", "code_lines"), _symbols(s, d))


@query(f"WITH {_CUR}, {_SYM} SELECT count(*) AS files, coalesce(sum(size_bytes), 0)::BIGINT AS size_bytes, coalesce(sum(doc_lines), 0)::BIGINT AS doc_lines, coalesce(sum(code_lines), 0)::BIGINT AS code_lines, (SELECT count(*) FROM sym WHERE starts_with(path, 'lantern-core/')) AS symbols FROM cur WHERE starts_with(path, 'lantern-core/')")
def prefix_stats(s: SparkSession, d: str) -> DataFrame:
    """A01 with F11."""
    return stats.repo_stats(_files(s, d, "path", "size_bytes", "doc_lines", "code_lines"), _symbols(s, d), "lantern-core/")


@query(f"WITH {_SYM} SELECT kind, count(*) AS n FROM sym GROUP BY kind")
def kind_histogram(s: SparkSession, d: str) -> DataFrame:
    """A02."""
    return stats.kind_histogram(_symbols(s, d))


@query(f"WITH {_SYM} SELECT kind, count(*) AS n FROM sym GROUP BY kind ORDER BY n DESC, kind LIMIT 8")
def kinds_top8(s: SparkSession, d: str) -> DataFrame:
    """K06."""
    return stats.kind_histogram(_symbols(s, d), 8)


@query(f"WITH {_CUR} SELECT count(*) AS files, sum({_t01('content')})::BIGINT AS tokens FROM cur WHERE {_EXT} = 'swift'")
def naive_tokens(s: SparkSession, d: str) -> DataFrame:
    """A07."""
    return stats.naive_tokens(_files(s, d))


_ACTIONS = """act AS (SELECT * FROM actions QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS LAST, (coalesce(status, '') <> 'pending')::INT DESC, duration_ms DESC NULLS LAST, prompt DESC NULLS LAST,
  response DESC NULLS LAST, status DESC NULLS LAST, tokens_used DESC NULLS LAST, tool_name DESC NULLS LAST, type DESC NULLS LAST) = 1)"""


@query(f"WITH {_ACTIONS} SELECT id, status, tool_name, tokens_used, duration_ms, ts FROM act")
def latest_actions(s: SparkSession, d: str) -> DataFrame:
    """ST4."""
    return stats.latest_actions(table(s, d, "actions")).select("id", "status", "tool_name", "tokens_used", "duration_ms", "ts")


@query(f"WITH {_ACTIONS} SELECT id, prompt, status, ts FROM act ORDER BY ts DESC NULLS LAST, id LIMIT 50")
def recent_actions(s: SparkSession, d: str) -> DataFrame:
    """K02."""
    return stats.recent_actions(table(s, d, "actions")).select("id", "prompt", "status", "ts")


@query(
    f"""WITH {_ACTIONS}, p AS (SELECT *, 'prompt: ' || coalesce(prompt, '') AS x FROM act) SELECT coalesce(tool_name, '') AS tool, status, count(*) AS actions, coalesce(sum(tokens_used), 0)::BIGINT AS recorded_tokens,
sum({_t01('x')} + coalesce({_t01('response')}, 0))::BIGINT AS estimated_tokens, coalesce(sum(duration_ms), 0)::BIGINT AS duration_ms FROM p GROUP BY 1, 2"""
)
def action_costs(s: SparkSession, d: str) -> DataFrame:
    """A11."""
    return stats.action_costs(table(s, d, "actions"))


@query(f"WITH {_CUR} SELECT path, modified_at FROM cur ORDER BY modified_at DESC NULLS LAST, path LIMIT 10")
def recent_files(s: SparkSession, d: str) -> DataFrame:
    """K03."""
    return stats.recent_files(_files(s, d, "path", "modified_at"))


@query("SELECT name, description, created_at, len(items)::INT AS items FROM packs")
def recent_packs(s: SparkSession, d: str) -> DataFrame:
    """K01."""
    return stats.recent_packs(table(s, d, "packs")).select("name", "description", "created_at", F.size("items").alias("items"))


@query(
    f"""WITH {_CUR}, c AS (SELECT date_trunc('day', indexed_at) AS m, path, {_t01('content')} AS n FROM cur), {_SYM}, t AS (SELECT path, sum({_t01('signature')}) AS n FROM sym GROUP BY path),
h AS (SELECT row_number() OVER (ORDER BY m)::INT AS cycle, count(*) AS total_files, sum(c.n)::BIGINT AS naive_tokens, coalesce(sum(t.n), 0)::BIGINT AS map_tokens FROM c LEFT JOIN t USING (path) GROUP BY m)
SELECT *, CASE WHEN map_tokens > 0 THEN round(naive_tokens / map_tokens, 6) ELSE 0 END::DOUBLE AS compression_ratio FROM h"""
)
def compression_history(s: SparkSession, d: str) -> DataFrame:
    """Source tokens against signature tokens of the files last indexed on each day."""
    from pyspark.sql import Window

    files = _files(s, d, "path", "content", "indexed_at").select("path", F.date_trunc("day", "indexed_at").alias("m"), token_estimate("content").alias("n"))
    heads = _symbols(s, d).groupBy("path").agg(F.sum(token_estimate("signature")).alias("t"))
    by_month = files.join(heads, "path", "left").groupBy("m").agg(F.count("*").alias("total_files"), F.sum("n").alias("naive_tokens"), F.coalesce(F.sum("t"), F.lit(0)).alias("map_tokens"))
    numbered = by_month.select(F.row_number().over(Window.orderBy("m")).alias("cycle"), "total_files", "naive_tokens", "map_tokens")  # a row a day
    return stats.compression_history(numbered)


@query(SQL["compression_history"].replace("SELECT *, CASE", "SELECT max(r) AS best_ratio, max(cycle) AS last_cycle, max_by(map_tokens, cycle) AS last_map_tokens FROM (SELECT *, CASE").replace("AS compression_ratio FROM h", "AS r FROM h)"))
def best_compression(s: SparkSession, d: str) -> DataFrame:
    """A10."""
    return stats.best_compression(compression_history(s, d).drop("compression_ratio"))


@query(
    f"""WITH {_CUR}, {_SYM}, r AS (SELECT r.name, count(*) AS n FROM symbol_refs r JOIN sym s ON s.name = r.name WHERE s.kind IN ({_in(symbols.RANKED_KINDS)}) AND r.name NOT IN ({_in(symbols.PRIMITIVES)}) GROUP BY r.name),
t AS (SELECT count(*) AS f, sum(size_bytes)::BIGINT AS b, sum(doc_lines)::BIGINT AS dl, sum(code_lines)::BIGINT AS cl FROM cur)
SELECT 'totals' AS section, unnest([0, 1, 2, 3, 4])::INT AS ord, unnest(['files', 'symbols', 'size_bytes', 'doc_lines', 'code_lines']) AS label, unnest([f, (SELECT count(*) FROM sym), b, dl, cl])::VARCHAR AS value FROM t
UNION ALL SELECT 'types', (row_number() OVER (ORDER BY n DESC, name) - 1)::INT, name, n::VARCHAR FROM r QUALIFY row_number() OVER (ORDER BY n DESC, name) <= 15
UNION ALL SELECT 'kinds', (row_number() OVER (ORDER BY n DESC, kind) - 1)::INT, kind, n::VARCHAR FROM (SELECT kind, count(*) AS n FROM sym GROUP BY kind) QUALIFY row_number() OVER (ORDER BY n DESC, kind) <= 8
UNION ALL SELECT 'recent', (row_number() OVER (ORDER BY modified_at DESC NULLS LAST, path) - 1)::INT, path, strftime(modified_at, '%Y-%m-%d %H:%M:%S') FROM cur QUALIFY row_number() OVER (ORDER BY modified_at DESC NULLS LAST, path) <= 10"""
)
def project_report(s: SparkSession, d: str) -> DataFrame:
    """D12."""
    return stats.project_report(_files(s, d, "path", "size_bytes", "doc_lines", "code_lines", "modified_at"), _symbols(s, d), _refs(s, d))


# ----------------------------------------------------------------------------------------------------------- maps and carts
_CAND = rf"""{_SYM}, cand AS (SELECT *, contains(concat_ws(chr(10), lower(name), lower(doc_comment)), 'freeze') OR contains(concat_ws(chr(10), lower(name), lower(doc_comment)), 'ledger') AS mf FROM sym),
fc AS (SELECT *, coalesce(mf, false) AS matches_focus FROM cand WHERE coalesce(mf, false) OR (NOT contains(lower(regexp_extract(path, '([^/]+)$', 1)), 'test') AND kind IN ({_in(symbols.IMPORTANT_KINDS)})))"""
_ENTRY = rf"""CASE WHEN coalesce(doc_comment, '') = '' THEN '' ELSE '/// ' || replace(doc_comment, chr(10), chr(10) || '/// ') || chr(10) END
  || CASE WHEN lower({_base('path')}) = lower(name) THEN '' ELSE regexp_extract(path, '([^/]+)$', 1) || ': ' END || coalesce(signature, name) || ' [L' || start_line || '-L' || end_line || ']'"""
_ENTRIES = f"""{_CAND}, rc AS (SELECT name, count(*) AS n FROM symbol_refs GROUP BY name), ec AS (SELECT {_ENTRY} AS entry, path, start_line, kind, matches_focus, coalesce(n, 0) AS refs FROM fc LEFT JOIN rc USING (name)),
en AS (SELECT entry, arg_min(path, (path, start_line, kind)) AS path, arg_min(start_line, (path, start_line, kind)) AS start_line, arg_min(kind, (path, start_line, kind)) AS kind, bool_or(matches_focus) AS matches_focus, max(refs) AS refs FROM ec GROUP BY entry)"""
_FOCUS, _BUDGET = "freeze ledger", 2000


@query(f"WITH {_CAND} SELECT path, qualified_name, start_line, end_line, matches_focus FROM fc")
def map_candidates(s: SparkSession, d: str) -> DataFrame:
    """F09, F10, F12, with a focus."""
    return packets.map_candidates(_symbols(s, d), _FOCUS).select("path", "qualified_name", "start_line", "end_line", "matches_focus")


@query(
    f"""WITH {_SYM} SELECT path, qualified_name, start_line, end_line, false AS matches_focus FROM sym WHERE NOT contains(lower(regexp_extract(path, '([^/]+)$', 1)), 'test')
AND (kind IN ({_in(symbols.IMPORTANT_KINDS)}) OR access_level IS NULL OR access_level IN ('public', 'open') OR starts_with(lower(name), 'test'))"""
)
def map_candidates_plain(s: SparkSession, d: str) -> DataFrame:
    """F09 without a focus."""
    return packets.map_candidates(_symbols(s, d)).select("path", "qualified_name", "start_line", "end_line", "matches_focus")


def _entries(s: SparkSession, d: str) -> DataFrame:
    return packets.map_entries(symbols.reference_counts(packets.map_candidates(_symbols(s, d), _FOCUS), _refs(s, d)))


@query(f"WITH {_ENTRIES} SELECT * FROM en")
def dedup_entries(s: SparkSession, d: str) -> DataFrame:
    """T19, D02."""
    return _entries(s, d)


@query(f"WITH {_ENTRIES} SELECT * FROM en UNION ALL SELECT 'FOCUS: ' || entry, path, start_line, kind, matches_focus, refs FROM en WHERE matches_focus")
def focus_entries(s: SparkSession, d: str) -> DataFrame:
    """D03."""
    return packets.focus_entries(_entries(s, d))


@query(
    f"""WITH RECURSIVE {_ENTRIES}, sc AS (SELECT *, round(CASE WHEN matches_focus THEN 5.0 ELSE 0.0 END + ln(1 + refs) + CASE WHEN kind IN ({_in(symbols.IMPORTANT_KINDS)}) THEN 1.0 ELSE 0.0 END, 6)::DOUBLE AS score, {_t01('entry')} AS tokens FROM en),
o AS (SELECT row_number() OVER (ORDER BY score DESC, path, start_line, entry) AS rank, entry, score, tokens FROM sc), f AS (SELECT 0::BIGINT AS rank, 0::BIGINT AS used, false AS taken
UNION ALL SELECT o.rank, CASE WHEN f.used + o.tokens < {_BUDGET} THEN f.used + o.tokens ELSE f.used END, f.used + o.tokens < {_BUDGET} FROM f JOIN o ON o.rank = f.rank + 1)
SELECT o.rank::INT AS rank, entry, score, tokens FROM f JOIN o USING (rank) WHERE taken"""
)
def repo_map(s: SparkSession, d: str) -> DataFrame:
    """D05, K07, D06."""
    return packets.repo_map(_symbols(s, d), _refs(s, d), _BUDGET, _FOCUS)


_ITEMS = """it AS (SELECT name AS pack, unnest(items) AS i, generate_subscripts(items, 1) - 1 AS pos FROM packs), pi AS (SELECT pack, i.path AS path, i.kind AS kind, min(pos)::INT AS pos, (list(i.reason ORDER BY pos))[1] AS reason FROM it WHERE i.path IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_ITEMS} SELECT pack, path, kind, pos, reason FROM pi")
def pack_items(s: SparkSession, d: str) -> DataFrame:
    """J13, D04, D09."""
    return packets.pack_items(table(s, d, "packs"))


@query(
    f"""WITH {_SYM}, {_ITEMS}, k AS (SELECT pack, pos, list_filter(string_split(path, '::'), lambda x: x <> '') AS p FROM pi WHERE kind = 'symbol')
SELECT k.p[1] AS qualified_name, k.p[2] AS path, pack, pos, start_line, end_line, s.kind FROM k JOIN sym s ON s.qualified_name = k.p[1] AND s.path = k.p[2] WHERE len(k.p) = 2"""
)
def cart_symbols(s: SparkSession, d: str) -> DataFrame:
    """J14."""
    return packets.cart_symbols(packets.pack_items(table(s, d, "packs")), _symbols(s, d))


@query(
    f"""WITH {_SYM}, {_ITEMS}, n AS (SELECT path, min(qualified_name) AS q FROM sym GROUP BY path), k AS (SELECT pack, pos, path, q FROM pi JOIN n USING (path) WHERE kind = 'symbol')
SELECT q AS qualified_name, k.path, pack, pos, start_line, end_line, s.kind FROM k JOIN sym s ON s.qualified_name = q AND s.path = k.path"""
)
def cart_symbol_keys(s: SparkSession, d: str) -> DataFrame:
    """Symbol items under their full keys, each the first symbol of its path."""
    sym = _symbols(s, d)
    first = sym.groupBy("path").agg(F.min("qualified_name").alias("q"))
    items = packets.pack_items(table(s, d, "packs")).join(first, "path").select("pack", "pos", "kind", F.concat("q", F.lit("::"), "path").alias("path"))
    return packets.cart_symbols(items, sym)


@query("SELECT name FROM packs WHERE description IS NOT NULL")
def delete_packs(s: SparkSession, d: str) -> DataFrame:
    """Packs without those that have no description."""
    packs = table(s, d, "packs")
    return packets.delete_packs(packs, packs.filter("description is null")).select("name")


@query(f"WITH {_ITEMS} SELECT pack, coalesce(kind, 'file') AS kind, count(*) AS items, count(DISTINCT path) AS paths, min(path) AS first_path FROM pi GROUP BY 1, 2")
def cart_by_kind(s: SparkSession, d: str) -> DataFrame:
    """A09."""
    return packets.cart_by_kind(packets.pack_items(table(s, d, "packs")))


@query("SELECT name, coalesce(description, '(none)') AS description, CASE WHEN description IS NULL THEN created_at + INTERVAL 1 DAY ELSE created_at END AS created_at, CASE WHEN description IS NULL THEN 0 ELSE len(items)::INT END AS items FROM packs")
def save_packs(s: SparkSession, d: str) -> DataFrame:
    """Packs without a description saved again, later, described and empty."""
    packs = table(s, d, "packs")
    again = packs.filter("description is null").withColumns({"description": F.lit("(none)"), "created_at": F.expr("created_at + interval 1 day"), "items": F.slice("items", 1, 0)})
    return packets.save_packs(packs, again).select("name", "description", "created_at", F.size("items").alias("items"))


_OUTLINE = SQL["outline"].replace(f"WITH {_SYM}, ", "").rsplit("SELECT path, string_agg", 1)
_FENCE = "CASE WHEN l IN ('swift', 'kotlin', 'java', 'html', 'css', 'json') THEN l WHEN l = 'js' THEN 'javascript' WHEN l = 'ts' THEN 'typescript' WHEN l = 'py' THEN 'python' WHEN l = 'md' THEN 'markdown' ELSE '' END"
_SECTIONS = f"""{_CUR}, {_SYM}, {_ITEMS}, {_OUTLINE[0].strip()}, ol AS (SELECT path, string_agg{_OUTLINE[1]}),
cs AS (SELECT pack, pos, pi.path, pi.kind, coalesce(reason, 'Directly Added') AS r, content, outline FROM pi LEFT JOIN cur USING (path) LEFT JOIN ol USING (path)),
cm AS (SELECT *, CASE WHEN (contains(r, 'Defines') OR contains(r, 'Included')) AND outline IS NOT NULL THEN 'SKELETON' ELSE 'FULL' END AS mode, {_LANG} AS l FROM cs),
se AS (SELECT pack, pos, path, kind, mode, '## ' || path || ' (' || mode || ', ' || r || ')' || chr(10) || '```' || {_FENCE} || chr(10) || CASE WHEN mode = 'SKELETON' THEN outline ELSE coalesce(content, '') END || chr(10) || '```' || chr(10) AS section FROM cm)"""


def _cart_sections(s: SparkSession, d: str) -> DataFrame:
    items = packets.pack_items(table(s, d, "packs"))
    named = items.select("path").distinct()  # only what lies in a cart is read further
    files = current_files(table(s, d, "files").join(named, "path", "left_semi"), ["path", "content"])
    syms = symbols.unique_symbols(table(s, d, "symbols").join(named, "path", "left_semi"))
    return packets.cart_sections(items, files, packets.outlines(syms))


@query(f"WITH {_SECTIONS} SELECT *, {_t01('section')} AS tokens FROM se")
def cart_preview(s: SparkSession, d: str) -> DataFrame:
    """D10, D11."""
    return _cart_sections(s, d)


@query(
    f"""WITH RECURSIVE {_SECTIONS}, o AS (SELECT *, {_t01('section')} AS tokens, CASE WHEN mode = 'FULL' THEN 0 ELSE 1 END AS class FROM se), n AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY class, pos, path, kind) AS rn FROM o),
f AS (SELECT DISTINCT pack, 0::BIGINT AS rn, 0::BIGINT AS used, false AS taken FROM n UNION ALL SELECT n.pack, n.rn, CASE WHEN f.used + tokens < 6000 THEN f.used + tokens ELSE f.used END, f.used + tokens < 6000 FROM f JOIN n ON n.pack = f.pack AND n.rn = f.rn + 1)
SELECT n.pack, class, pos, path, kind, mode, tokens, f.taken, f.used FROM f JOIN n ON n.pack = f.pack AND n.rn = f.rn"""
)
def greedy_pack(s: SparkSession, d: str) -> DataFrame:
    """Which sections of every pack fit a budget."""
    return packets.packed_carts(_cart_sections(s, d), 6000)


@query(
    f"""WITH p AS ({SQL['greedy_pack']}), {_SECTIONS}, g AS (SELECT p.pack, count(*) FILTER (taken) AS sections, coalesce(string_agg(section, '' ORDER BY p.class, p.pos, section) FILTER (taken), '') AS body FROM p JOIN se ON se.pack = p.pack AND se.pos = p.pos GROUP BY p.pack),
t AS (SELECT pack, sections::INT AS sections, {_t01('body')} AS tokens, body FROM g) SELECT pack, sections, tokens, '# Context Packet (Tokens: ' || tokens || '/6000)' || chr(10) || chr(10) || body AS text FROM t"""
)
def packet_texts(s: SparkSession, d: str) -> DataFrame:
    """Every pack as one text, headed by its tokens."""
    return packets.rendered_carts(_cart_sections(s, d), 6000)


@query(
    f"""WITH {_SYM}, g AS (SELECT path, count(*) AS n, min(name) AS name, min(signature) AS signature FROM sym GROUP BY path) SELECT path, CASE WHEN n = 1 AND lower(name) = lower({_base('path')}) THEN signature ELSE path END AS heading FROM g"""
)
def skeleton_heading(s: SparkSession, d: str) -> DataFrame:
    """D07."""
    g = _symbols(s, d).groupBy("path").agg(F.count("*").alias("n"), F.min("name").alias("name"), F.min("signature").alias("signature"))
    one = F.when(F.col("n") == 1, F.array("name")).otherwise(F.array(F.lit(""), F.lit("")))
    return g.select("path", packets.skeleton_heading(F.col("path"), one, F.array("signature")).alias("heading"))


# ------------------------------------------------------------------------------------------------------------------ graphs
_EDGES = """fe AS (SELECT DISTINCT array_to_string(a[1:i], '/') AS child, CASE WHEN i = 1 THEN 'Project' ELSE array_to_string(a[1:i - 1], '/') END AS parent, CASE WHEN i = len(a) THEN 'file' ELSE 'folder' END AS grp
FROM (SELECT string_split(path, '/') AS a, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM files WHERE path IS NOT NULL))"""
_LINKS = "ul AS (SELECT least(source, target) AS source, greatest(source, target) AS target, coalesce(max(strength), 0) AS strength FROM links WHERE source <> target GROUP BY ALL)"


@query(f"WITH {_EDGES} SELECT * FROM fe")
def folder_edges(s: SparkSession, d: str) -> DataFrame:
    """D13, R14."""
    return links.folder_edges(table(s, d, "files").select("path"))


@query(f"WITH {_LINKS} SELECT * FROM ul")
def undirected_links(s: SparkSession, d: str) -> DataFrame:
    """Links without direction or repetition."""
    return links.undirected_links(table(s, d, "links"))


_TOPICS = rf"""tw AS (SELECT path, unnest(regexp_split_to_array(lower(content), '[^\p{{L}}\p{{N}}]+')) AS w FROM cur), tc AS (SELECT path, w, count(*) AS n FROM tw WHERE length(w) > 3 AND w NOT IN ({_in(T.TOPIC_STOP_WORDS)}) GROUP BY ALL),
tp AS (SELECT path, w AS topic FROM tc QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, w) = 1)"""


@query(f"WITH {_EDGES}, {_LINKS}, {_CUR}, {_TOPICS}, u AS (SELECT parent AS source, child AS target, 'tree' AS relation, 1.0::DOUBLE AS strength FROM fe UNION ALL SELECT source, target, 'semantic', strength FROM ul) SELECT u.*, coalesce(topic, 'General') AS topic FROM u LEFT JOIN tp ON tp.path = u.source")
def graph_merge(s: SparkSession, d: str) -> DataFrame:
    """D14."""
    topics = stats.main_topics(_files(s, d), "path", "content")
    return links.merged_graph(links.folder_edges(table(s, d, "files").select("path")), links.undirected_links(table(s, d, "links")), topics)


@query(f"WITH {_EDGES} SELECT parent, row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN grp = 'folder' THEN 0 ELSE 1 END, child)::INT AS place, child, grp FROM fe")
def tree_order(s: SparkSession, d: str) -> DataFrame:
    """K09."""
    return links.tree_order(links.folder_edges(table(s, d, "files").select("path")))


# ----------------------------------------------------------------------------------------------------------------- sources
@query(
    r"""WITH p AS (SELECT DISTINCT path FROM files WHERE path IS NOT NULL), q AS (SELECT path, regexp_matches(path, '^(?:.*/)?(?:\.build|\.git|DerivedData|node_modules)/.*$|^(?:.*/)?\.DS_Store(?:/.*)?$|^(?:.*/)?dist/.*$') AS bad, regexp_matches(path, '^(?:.*/)?Generated(?:/.*)?$') AS inc,
regexp_matches(path, '^(?:.*/)?Generated/.*$|^(?:.*/)?[^/]*\.min\.[^/]*(?:/.*)?$') AS git, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS e FROM p)
SELECT path, (NOT (bad OR (NOT inc AND git)) AND NOT regexp_matches(path, '\.gradle/|\.idea/|\.kotlin/|captures/|\.cxx/') AND e IN ('swift', 'h', 'm', 'mm', 'c', 'cpp', 'hpp', 'js', 'ts', 'json', 'md', 'yaml', 'yml', 'skill', 'html', 'css', 'kt', 'kts', 'java')
AND NOT regexp_matches(path, '(^|/)\.[^/]')) AS kept FROM q"""
)
def scan_filter(s: SparkSession, d: str) -> DataFrame:
    """S02-S11 over a table of paths."""
    options = ScanOptions(exclude=["dist/"], include_folders=["Generated/"], gitignore=["Generated/", "*.min.*"], gradle=True, include_generated=True)
    p = table(s, d, "files").filter("path is not null").select("path").distinct()
    return p.select("path", kept("path", options).alias("kept"))


@query("SELECT DISTINCT path, (contains(path, 'Store') OR contains(path, '-cache')) AND NOT regexp_matches(path, '(^|/)(node_modules|DerivedData|[.][^/]*)(/|$)') AS kept FROM files WHERE path IS NOT NULL")
def scan_include(s: SparkSession, d: str) -> DataFrame:
    """Parts of names to include take the place of the extensions."""
    p = table(s, d, "files").filter("path is not null").select("path").distinct()
    return p.select("path", kept("path", ScanOptions(include=["Store", "-cache"])).alias("kept"))


_IGNORE_FILE = "# what tools write\n\n  dist/ \n!dist/keep.js\n/lantern-core/unit-*/web\r\n*.min.js\nSources/**/Sync\n"


@query(
    r"""WITH p AS (SELECT DISTINCT path, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS e FROM files WHERE path IS NOT NULL)
SELECT path, NOT regexp_matches(path, '(^|/)(node_modules|DerivedData)/|(^|/)\.[^/]') AND e IN ('swift', 'h', 'm', 'mm', 'c', 'cpp', 'hpp', 'js', 'ts', 'json', 'md', 'yaml', 'yml', 'skill', 'html', 'css')
  AND (regexp_matches(path, '^lantern-core/unit-00001/web(/|$)') OR NOT (regexp_matches(path, '(^|/)dist/') OR regexp_matches(path, '^lantern-core/unit-[^/]*/web(/|$)') OR regexp_matches(path, '(^|/)[^/]*\.min\.js(/|$)') OR regexp_matches(path, '^Sources/.*/Sync(/|$)'))) AS kept FROM p"""
)
def scan_ignore_file(s: SparkSession, d: str) -> DataFrame:
    """The text of an ignore file, with a folder below an ignored one taken in again."""
    p = table(s, d, "files").filter("path is not null").select("path").distinct()
    options = ScanOptions(gitignore=gitignore_rules(_IGNORE_FILE), include_folders=["/lantern-core/unit-00001/web/"])
    return p.select("path", kept("path", options).alias("kept"))


def _own_folder(s: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(s).rstrip('/')}/{name}-{uuid4().hex}"


@query(f"WITH {_CUR} SELECT path, sha256, indexed_at FROM cur")
def stored_index(s: SparkSession, d: str) -> DataFrame:
    """The index of half time is built and then brought up to date; only buckets with changes are written again."""
    files = table(s, d, "files")
    mid = files.selectExpr("percentile_disc(0.5) within group (order by unix_micros(cast(indexed_at as timestamp))) as t").first()[0]
    store = _own_folder(s, "index")
    for rows in (files.filter(F.col("indexed_at") <= F.timestamp_micros(F.lit(int(mid))).cast("timestamp_ntz")), files):
        index.update_index(s, store, current_files(rows, FILES.names).select(*FILES.names))
    return index.read_index(s, store)["files"].select("path", "sha256", "indexed_at")


@query(f"WITH {_CUR} SELECT path, sha256, indexed_at FROM cur")
def streamed_files(s: SparkSession, d: str) -> DataFrame:
    """ST1, ST2: the files table as a stream; its state is the current rows. The place is written as a pattern, as a table can be one file."""
    store = _own_folder(s, "stream")
    stream_files(s, f"{d}/files.parque[t]", f"{store}/state", f"{store}/log").awaitTermination()
    return read_state(s, f"{store}/state", "files").select("path", "sha256", "indexed_at")


@query(SQL["latest_actions"])
def streamed_actions(s: SparkSession, d: str) -> DataFrame:
    """ST4: the actions table as a stream."""
    store = _own_folder(s, "stream")
    stream_actions(s, f"{d}/actions.parque[t]", f"{store}/state", f"{store}/log").awaitTermination()
    return read_state(s, f"{store}/state", "actions").select("id", "status", "tool_name", "tokens_used", "duration_ms", "ts")


@query(rf"WITH {_CUR} SELECT path, ({_EXT} = 'kts' AND (regexp_extract(path, '([^/]+)$', 1) IN ('build.gradle.kts', 'settings.gradle.kts') OR contains(path, 'buildSrc/') OR regexp_matches(substr(content, 1, 4096), '(plugins|dependencies|kotlin) \{{'))) AS build_script FROM cur")
def build_scripts(s: SparkSession, d: str) -> DataFrame:
    """S12."""
    return _files(s, d).select("path", is_build_script("path", "content").alias("build_script"))


# -------------------------------------------------------------------------------------------------------------- extensions
@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_windows_hourly(s: SparkSession, d: str) -> DataFrame:
    """Extension: windows over events."""
    return event_windows(table(s, d, "events"))


@query(
    """SELECT event_type, CASE WHEN grouping(h) = 0 THEN h END AS hour, count(*) AS events, round(sum(value), 4) AS value, count(DISTINCT user_id) AS users FROM (SELECT event_type, hour(ts)::INT AS h, value, user_id FROM events) GROUP BY ROLLUP (event_type, h)"""
)
def event_rollup(s: SparkSession, d: str) -> DataFrame:
    """Extension: totals by type and hour of day, by type, and over all."""
    e = table(s, d, "events").select("event_type", F.hour("ts").alias("hour"), "value", "user_id")
    return e.rollup("event_type", "hour").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"), F.countDistinct("user_id").alias("users"))


@query(
    f"""WITH {_ACTIONS}, d AS (SELECT coalesce(tool_name, '') AS tool, duration_ms FROM act WHERE status = 'completed')
SELECT tool, count(*) AS actions, quantile_cont(duration_ms, 0.5) AS median_ms, quantile_cont(duration_ms, 0.9) AS p90_ms FROM d GROUP BY tool"""
)
def lead_times(s: SparkSession, d: str) -> DataFrame:
    """Extension: median and ninth decile of the duration of completed actions by tool."""
    a = stats.latest_actions(table(s, d, "actions")).filter("status = 'completed'").select(F.coalesce("tool_name", F.lit("")).alias("tool"), "duration_ms")
    return a.groupBy("tool").agg(F.count("*").alias("actions"), F.percentile("duration_ms", 0.5).alias("median_ms"), F.percentile("duration_ms", 0.9).alias("p90_ms"))
